r"""Personal data: what patterns find, and what co-occurrence in the corpus discloses. DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. Each value found is a protected entity. A term (a run of letters
and digits with a letter, of three characters at least) that stands within REACH characters of a mention of an entity c is a
candidate for disclosing it. Over all word occurrences of the corpus, p(c) is the share that stands by c and p(c|t) the share of
t's occurrences that do. The information content of the entity is IC(c) = -log2 p(c), and what t gives away of it is their pointwise
mutual information PMI(c;t) = log2 p(c|t) / p(c). The disclosure is PMI / IC: 1 if t never stands elsewhere, so that it
reveals c completely; 0 if it tells nothing. A term is judged only on evidence from MIN_CONTEXTS different contexts, which keeps words met once, and copies
of one text, out. Terms at or above GENERALISE are generalised wherever they occur, those at or above REMOVE removed.

The patterns are those of the base definition in a form that Java reads in linear time: possessive, and started at the first
character of a run only, or where the match before ended. Places come from the lengths of the gaps between matches, and running sums are
made in blocks, so that neither long texts nor thousands of matches in one text cost quadratic time.

Edge cases: null and empty texts have no spans (the digest of the empty string) and stay as they are; repeated rows get a row each,
and count each in the corpus; an empty table gives an empty result; other columns are ignored by ``spans`` and kept by ``sanitised``, also if
their names clash with those used within; places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, hinted, id_and_text

REACH, MIN_CONTEXTS, GENERALISE, REMOVE = 80, 3, 0.9, 0.98
KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every text with a match contains; looked for first, as it costs less than the pattern.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"[\p{L}\p{N}]++"
_LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}


def running(a: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """The running totals of a non-empty array<bigint>, in blocks; 0 must be neutral to combine."""
    zero = F.lit(0).cast("long")

    def each(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(part, first, lambda acc, y: F.struct(combine(acc["s"], y).alias("s"), F.concat(acc["o"], F.array(combine(acc["s"], y))).alias("o")), lambda acc: acc["o"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
    part = lambda b: F.slice(a, b * block + 1, F.lit(block))
    before = F.slice(F.concat(F.array(zero), each(F.transform(blocks, lambda b: F.aggregate(part(b), zero, combine)), zero)), F.lit(1), F.size(blocks))
    return F.flatten(F.zip_with(blocks, before, lambda b, o: each(part(b), o)))


def _matches(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df (with text) and for each kind m_, the matches, g_, the gaps around them (null without a match), and e_, the ends of the matches."""
    none = F.array().cast("array<string>")
    df = df.withColumns({f"m_{k}": F.when(F.contains("text", F.lit(_NEEDS.get(k, ""))), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in kinds.items()})
    df = df.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)) for k, p in kinds.items()})
    length = lambda m, g: (F.char_length(m) + F.char_length(g)).cast("long")
    df = df.withColumns({f"w_{k}": F.zip_with(f"m_{k}", F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), length) for k in kinds})
    return df.withColumns({f"e_{k}": F.when(F.size(f"m_{k}") > 0, running(F.col(f"w_{k}"), lambda x, y: x + y)) for k in kinds})


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    digit = lambda i: F.substr(d, -i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(F.get(doubled, digit(i)))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    if kind == "card":
        return F.when(F.length(m) <= 37, F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)).otherwise(False)
    return F.length(_digits(m)).between(9, 15) if kind == "phone" else F.lit(True)


def _around(before: Column, after: Column) -> Column:
    """What stands within REACH characters, without cut words, in lower case."""
    left = F.when(F.length(before) > REACH, F.regexp_replace(F.substring(before, -REACH, REACH), r"^[\p{L}\p{N}]+", "")).otherwise(before)
    right = F.when(F.length(after) > REACH, F.regexp_replace(F.substring(after, 1, REACH), r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.lower(F.concat(left, F.lit(" "), right))


def _mentions(kind: str) -> Column:
    m, g, e = f"m_{kind}", F.col(f"g_{kind}"), F.col(f"e_{kind}")

    def one(x: Column, i: Column) -> Column:
        entity = F.lower(x) if kind == "email" else x if kind == "ip" else _digits(x)
        return F.struct(
            F.lit(kind).alias("kind"), (F.get(e, i) - F.char_length(x)).alias("start"), F.get(e, i).alias("end"), F.concat(F.lit(f"{kind}:"), entity).alias("entity"),
            _around(F.get(g, i), F.get(g, i + 1)).alias("around"), _valid(kind, x).alias("ok"),
        )

    return F.filter(F.transform(m, one), lambda s: s["ok"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and k1, k2: 128 bits that tell rows of different id or text apart."""
    return id_and_text(docs).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("second"), "text", "doc_id")})


def base(keyed: DataFrame) -> DataFrame:
    """keyed and base: the base spans, by kind as listed, then start, with their entities and surroundings."""
    names = keyed.columns
    return _matches(keyed, _PATTERNS).withColumn("base", F.concat(*map(_mentions, KINDS))).select(*names, "base")


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda t: (F.length(t) >= 3) & F.rlike(t, F.lit(r"\p{L}")))


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """term, disclosure of the terms to sanitise (the largest over all entities); found: base() of docs. None: there are none."""
    by = found.select(F.explode("base").alias("s")).select("s.entity", F.xxhash64("s.around").alias("context"), F.explode(_terms(F.col("s.around"))).alias("term"))
    by = by.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("contexts"))
    by = checkpointed(by)
    pairs = by.where(F.col("contexts") >= MIN_CONTEXTS).join(by.groupBy("entity").agg(F.sum("n_ct").alias("n_c")), "entity")
    terms = checkpointed(pairs.select("term").distinct())
    rows = terms.count()
    if not rows:
        return None
    words = docs.select(F.explode(_terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term"))
    known = terms.withColumn("known", F.lit(True))
    if rows <= BROADCAST_ROWS:
        words = words.join(F.broadcast(known), "term", "left").groupBy(F.when(F.col("known"), F.col("term")).alias("term")).agg(F.count("*").alias("n_t"))
    else:
        words = words.groupBy("term").agg(F.count("*").alias("n_t"))
    words = checkpointed(words)
    total = words.agg(F.sum("n_t")).first()[0]
    content = -F.log2(F.col("n_c") / F.lit(float(total)))
    share = F.least(F.col("n_ct") / F.col("n_t"), F.lit(1.0))
    disclosure = F.when(content > 0, 1 + F.log2(share) / content).otherwise(0.0)
    risky = pairs.join(words, "term").groupBy("term").agg(F.max(disclosure).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    risky = checkpointed(risky)
    return None if risky.isEmpty() else risky


def _term_spans(keyed: DataFrame, risky: DataFrame) -> DataFrame:
    """k1, k2, added: the spans of risky terms, by kind, then start, of each distinct row with any."""
    risky = risky.select("term", F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("term").alias("kind"))
    hits = keyed.select("k1", "k2", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(hinted(risky, risky.count()), "term")
    hits = checkpointed(hits.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("terms")))
    texts = keyed.join(hinted(hits, hits.count()), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    spans = F.transform("m_t", lambda x, i: F.struct(F.try_element_at("terms", F.lower(x)).alias("kind"), (F.get("e_t", i) - F.char_length(x)).alias("start"), F.get("e_t", i).alias("end")))
    return _matches(texts, {"t": _TERM}).select("k1", "k2", F.array_sort(F.filter(spans, lambda s: s["kind"].isNotNull())).alias("added"))


def _all_spans(keyed: DataFrame) -> DataFrame:
    """keyed (without text), base and added; texts that disclosing terms stand in are read again, others not."""
    found = checkpointed(base(keyed).select(*(c for c in keyed.columns if c != "text"), "base"))
    risky = disclosing(keyed, found)
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    if risky is None:
        return found.withColumn("added", none)
    free = lambda a, b: ~F.exists(b, lambda s: (s["start"] < a["end"]) & (s["end"] > a["start"]))
    joined = found.join(_term_spans(keyed.select("doc_id", "text", "k1", "k2"), risky), ["k1", "k2"], "left")
    return joined.withColumn("added", F.filter(F.coalesce("added", none), lambda a: free(a, F.col("base"))))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (digest of the base spans), spans (base ones, then added terms), n_terms."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = map(count, KINDS)
    both = F.concat_ws(",", F.when(F.size("base") > 0, _joined(F.col("base"))), F.when(F.size("added") > 0, _joined(F.col("added"))))
    return _all_spans(_keyed(docs)).select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), both.alias("spans"), F.size("added").cast("long").alias("n_terms"))


def _rebuilt(block: int = 256) -> Column:
    """text with a label in the place of each stretch that cuts cover; the first span of a stretch names it.

    Each block of spans is cut from its own region of the text, as finding a place in a string takes time in proportion to the place."""
    labels = F.create_map(*(F.lit(x) for kind in _LABELS.items() for x in kind))
    done = lambda i: F.when(i > 0, F.get("reach", i - 1)).otherwise(F.lit(0).cast("long"))
    cut = lambda text, a, n: F.substr(text, (a + 1).cast("int"), n.cast("int"))

    def region(b: Column) -> Column:
        first, last = b * block, F.least((b + 1) * block, F.size("cuts")) - 1
        length = F.greatest(F.get("cuts", last)["start"] - done(first), F.lit(0))
        return F.struct(b.alias("b"), done(first).alias("at"), cut(F.col("text"), done(first), length).alias("text"))

    def pieces(z: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = done(z["b"] * block + i)
            return F.when(s["start"] >= before, F.concat(cut(z["text"], before - z["at"], s["start"] - before), F.element_at(labels, s["kind"]))).otherwise("")

        return F.array_join(F.transform(F.slice("cuts", z["b"] * block + 1, F.lit(block)), piece), "")

    blocks = F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / block).cast("int"))
    last = F.element_at("reach", -1)
    return F.concat(F.array_join(F.transform(F.transform(blocks, region), pieces), ""), cut(F.col("text"), last, F.char_length("text") - last))


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the same rows and columns, in whose texts labels stand for base spans and generalised terms; removed terms are left out."""
    keyed = _keyed(docs)
    found = checkpointed(base(keyed).select("base"))  # unfiltered: a pushed filter would hold the whole computation, inlined
    risky = disclosing(keyed, found)
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("second"), "text", "doc_id")})
    rows = base(rows)
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    cuts = F.transform("base", span)
    if risky is not None:
        added = checkpointed(_term_spans(keyed, risky))
        rows = rows.join(hinted(added, added.count()), ["k1", "k2"], "left")
        cuts = F.concat(cuts, F.coalesce(F.transform("added", span), F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")))
    rows = rows.select("row", "text", F.array_sort(cuts).alias("cuts"))
    some = F.size("cuts") > 0
    rows = rows.withColumn("reach", F.when(some, running(F.transform("cuts", lambda s: s["end"]), lambda x, y: F.greatest(x, y))))
    new = F.when(some, _rebuilt()).otherwise(F.col(f"row.{text_col}"))
    return rows.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
