"""The text operators against brute-force versions, round trips and held-out accuracy, with the edge cases of each."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from domainscope.llm import ann, bpe, chat, decontaminate, html_text, minhash, pii, substring_dedup, token_fst, toxicity

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "same words here twice"), (5, "same words here twice"), (6, "ünï cödé ​ 😀 x"), (None, "no id at all here")]


def docs(spark, rows):
    """With extra columns whose names clash with those that operators use within."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(7).alias("t"), F.lit("x").alias("root"), F.lit(None).cast("string").alias("key"), F.lit(1.5).alias("row"))


def words(t):
    return SPACE.findall(t or "")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def rows(real):
    return [tuple(r) for r in real.collect()]


# -- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if ok(k, m[0])]


TRICKY = [
    "a@b.c_d@e.f.. x@y@z.w a.b@c-d.e, @no a@b", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4 1.1.1.256", "+1 (743) 555-3824-- +12 +1 2 3 4 5 6 7 8 9 +123456789012345678",
    "4111 1111 1111 1111 +4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111", "4111111111111111 4111111111111111", "😀 é a@b.co", "9" * 9000 + " " + "a" * 9000 + "@ " + "x@y.zz " * 300,
]


def test_base_spans(spark, rows):
    given = [*rows, *EDGES, *((100_000 + i, t) for i, t in enumerate(TRICKY))]
    expect = sorted((str(i), sha(",".join("%s:%d:%d" % s for s in base_spans(t)))) for i, t in given)
    got = pii.spans(docs(spark, given)).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == expect
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len([x for x in r["spans"].split(",") if x]) - r["n_terms"] for r in got)


def disclosing_corpus():
    rng = np.random.default_rng(0)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    out = []
    for i in range(120):
        text = " ".join(rng.choice(vocabulary, 30))
        if i < 8:
            text += f" {vocabulary[i]} Zorblax mail ann@corp.example.org {vocabulary[i + 30]} " + " ".join(rng.choice(vocabulary, 10))
        out.append((i, text))
    out.append((500, "the Zorblax plant, and zorblax again"))
    return out


def test_disclosing_terms_are_found_wherever_they_are(spark):
    given = disclosing_corpus()
    got = {r["doc_id"]: r for r in pii.spans(docs(spark, given)).collect()}
    assert got[500]["n_terms"] == 2 and got[500]["spans"] == "removed:4:11,removed:23:30" or got[500]["spans"].startswith("term:4:11")
    assert got[3]["n_email"] == 1 and got[3]["n_terms"] >= 1
    assert all(got[i]["n_terms"] == 0 for i in range(20, 120))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, given)).collect()}
    assert "orblax" not in clean[500] and "orblax" not in clean[3] and "ann@" not in clean[3] and "[EMAIL]" in clean[3]
    assert clean[50] == given[50][1]


def test_copies_of_one_text_disclose_nothing(spark):
    text = "alpha beta gamma joe@corp.example.org delta epsilon"
    assert all(r["n_terms"] == 0 for r in pii.spans(docs(spark, [(i, text) for i in range(9)])).collect())


def test_sanitised_against_brute_force(spark, rows):
    given = [*rows[:80], *EDGES, *((100_000 + i, t) for i, t in enumerate(TRICKY))]
    df = docs(spark, given)
    got = pii.sanitised(df)
    assert got.columns == df.columns

    def cut(t):
        out, done = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in base_spans(t)):
            out += t[done:a] + f"[{k.upper()}]" if a >= done else ""
            done = max(done, b)
        return None if t is None else out + t[done:]

    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(cut(t))) for i, t in given)


# -- toxicity


def toxic_corpus(n=400):
    rng = np.random.default_rng(1)
    plain, bad = [f"plain{i}" for i in range(300)], ["vilescum", "hatefool", "rotbrain", "stinkwort", "foulmouth", "dreckface"]
    out, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 60))
        y = int(i % 4 == 0)
        if y:
            for at in rng.integers(0, 60, 8):
                w[at] = str(rng.choice(bad))
        out.append((i, " ".join(w)))
        labels.append((i, y))
    return out, labels


def test_toxicity_on_held_out_rows(spark):
    given, labels = toxic_corpus()
    df, lab = docs(spark, given), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(df, lab)
    got = {r["doc_id"]: r for r in toxicity.scores(df, model).collect()}
    import zlib

    held = [i for i, _ in given if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] == (i in held) for i in got)
    truth = dict(labels)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    left = toxicity.without_toxic(df, model)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}
    edge = toxicity.scores(docs(spark, EDGES), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edge)


def test_toxicity_of_windows_against_brute_force(spark):
    """Every score from its definition: windows cut by hand, each compressed with both dictionaries by fresh compressors."""
    import math

    import zstandard

    given, labels = toxic_corpus(240)
    given += [(1000, None), (1001, ""), (1002, "one"), (1003, "vilescum " * 30_000), (1003, "vilescum " * 30_000), (1004, "x" * 500 + " hatefool")]
    df = docs(spark, given)
    model = toxicity.fitted(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model == toxicity.fitted(df, spark.createDataFrame(labels, "doc_id long, toxic int")) and model.toxic and toxicity.WINDOW > 1
    half, o = len(model.ordinary) // 2, model.ordinary

    def length(content, x):
        kind = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=kind)
        return len(zstandard.ZstdCompressor(compression_params=kind, dict_data=d).compress(x))

    def score(t):
        w = [x[i : i + 48] for x in (t or "").lower().encode().split() for i in range(0, len(x), 48)]
        size, step = toxicity.WINDOW, toxicity.STEP
        cut = [w[i : i + size] for i in range(0, len(w), step) if i == 0 or i + size - step < len(w)]
        known = {}
        for x in map(b" ".join, cut):
            framed = o[-120:-60] + b" " + x + b" " + o[-1000:-960]
            if x not in known:
                known[x] = length(o, framed) - length(o[:half] + model.toxic + o[half:], framed)
        reach = [sum(known[b" ".join(x)] >= k for x in cut) for k in model.thresholds]
        z = sum(a * b for a, b in zip(model.weights, [1, *map(math.log1p, reach), *(min(100 * r / len(cut), 10) if cut else 0 for r in reach), math.log1p(len(cut))]))
        return 1 / (1 + math.exp(-z)), len(cut)

    some = [r for r in given if r[0] is None or r[0] % 12 == 0 or r[0] >= 1000]
    got = sorted((str(r["doc_id"]), round(r["score"], 9), r["n_windows"]) for r in toxicity.scores(docs(spark, some), model).collect())
    assert got == sorted((str(i), round(score(t)[0], 9), score(t)[1]) for i, t in some)


def test_held_out_labels_are_not_read(spark):
    given, labels = toxic_corpus(200)
    df = docs(spark, given)
    flipped = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fitted(df, spark.createDataFrame(labels, "doc_id long, toxic int")), toxicity.fitted(df, flipped)
    assert a == b


def test_no_labels_of_a_class(spark):
    df = docs(spark, EDGES)
    for labels, score in (([], 0.0), ([(5, 0), (4, 0)], 0.0)):
        model = toxicity.fitted(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r["score"] == score for r in toxicity.scores(df, model).collect())


# -- near duplicates


def components_by_force(given, k, percent):
    sets = []
    for i, t in given:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    groups = {}
    for a, (i, s) in enumerate(sets):
        if s and i is not None:
            groups.setdefault(root(a), []).append(i)
    least = {r: min(v) for r, v in groups.items()}
    return sorted((str(i), len(s), str(least[root(a)] if s and root(a) in least else i)) for a, (i, s) in enumerate(sets))


def variants():
    """A crowd around one text, chains, copies, and distant texts."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)]
    base, out = list(rng.choice(vocabulary, 80)), []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 9)):
            w[at] = str(rng.choice(vocabulary))
        out.append((1000 + i, " ".join(w)))
    chain = list(rng.choice(vocabulary, 60))
    for i in range(12):
        out.append((2000 - i, " ".join(chain)))
        chain[(5 * i) % 60] = f"new{i}"
    out += [(3000 + i, "A short text" if i % 2 else "a SHORT text") for i in range(6)]
    out += [(4000 + i, " ".join(rng.choice(vocabulary, 40))) for i in range(30)]
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    given = [*variants(), *EDGES]
    got = minhash.near_duplicates(docs(spark, given), k, 80)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == components_by_force(given, k, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_of_real_texts(spark, rows):
    got = minhash.near_duplicates(docs(spark, rows), 4, 80)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == components_by_force(rows, 4, 80)


def test_one_row_of_each_group_stays(spark):
    given = [*variants(), *EDGES, (7, "a very different text than others"), (7, "a very different text than others"), (8, "a very different text than others")]
    df = docs(spark, given)
    left = minhash.deduplicated(df, 5, 80)
    assert left.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in left.collect())
    expect = {c for _, n, c in components_by_force(given, 5, 80) if n}
    assert [i for i in ids if i in expect and i != "None"] == sorted(x for x in expect if x != "None")
    assert ids.count("7") == 1 and "8" not in ids and ids.count("5") == 1 and {"1", "2", "3", "None"} <= set(ids)


def test_one_id_with_several_texts_loses_no_link(spark):
    """30 ids with two texts each, and a near copy of the second under another id; every text stays once."""
    rng = np.random.default_rng(8)
    text = lambda: list(rng.choice([f"w{i}" for i in range(5000)], 60))
    given = []
    for i in range(30):
        a, b = text(), text()
        given += [(10 * i, " ".join(a)), (10 * i, " ".join(b)), (10 * i + 7, " ".join([*b[:-1], "other"]))]
    got = minhash.near_duplicates(docs(spark, given), 4, 80).collect()
    assert all(r["component_id"] == r["doc_id"] // 10 * 10 for r in got) and len(got) == 90
    left = minhash.deduplicated(docs(spark, given), 4, 80).collect()
    assert sorted(r["text"] for r in left) == sorted(t for i, t in given if i % 10 == 0)


def test_a_filter_misses_none_of_its_texts(spark):
    """Others come along, all of them if the filter is full."""
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("text"))
    for n, most in ((500, 1_500), (40_000, 40_000)):
        bits = minhash._filter(rows.where(F.col("id") < n).select("h"), n if n < 1_000 else 1)
        among = minhash._among(rows, F.col("h"), bits)
        found = {r["id"] for r in among.collect()}
        assert among.columns == rows.columns and found >= set(range(n)) and len(found) <= most


def test_texts_are_not_shuffled_and_sets_once(spark):
    """Of long texts, one in five with a near copy, much less is shuffled than they are long."""
    rng = np.random.default_rng(12)
    vocabulary = np.array([f"word{i}" for i in range(20_000)])
    given = []
    for i in range(400):
        words = rng.choice(vocabulary, 2000)
        given += [(i, " ".join(words)), *([(1000 + i, " ".join([*words[:-20], "other"]))] if i % 5 == 0 else [])]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = minhash.near_duplicates(docs(spark, given), 4, 80).collect()
    assert sum(r["component_id"] != r["doc_id"] for r in got) == 80 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert written() - before < 0.9 * sum(len(t) for _, t in given)


def test_pairs_within_the_guaranteed_distance_share_a_key(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, minhash.CHUNKS * (minhash.ERRORS + 1) - 1, replace=False)
        row[at] += 1
    both = spark.createDataFrame([(x.view(np.int64).tolist(), y.view(np.int64).tolist()) for x, y in zip(a, b)], "a array<long>, b array<long>")
    keys = lambda c: both.withColumnRenamed(c, "chunks").select(minhash.index_keys().alias("k")).collect()
    assert all(set(x["k"]) & set(y["k"]) and len(set(x["k"])) == minhash.SYMBOLS for x, y in zip(keys("a"), keys("b"), strict=True))


# -- nearest neighbours


def test_neighbours_recall_ties_and_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:140] = x[100]
    given = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0] * 3), (5080, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(given + odd, "vec_id long, embedding array<double>").withColumn("block", F.lit(1))
    got = ann.neighbours(df).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = []
    for q, g in got.sort_values("rank").groupby("query_id"):
        top = np.lexsort((np.arange(3000), -s[q]))[:20]
        hits.append(len(set(top) & set(g.vec_id)) / 20)
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[q][g.vec_id.to_numpy()])
    assert len(hits) == 150 and np.mean(hits) > 0.9
    assert got[got.query_id == 120].vec_id.tolist()[:5] == [100, 101, 102, 103, 104]


@pytest.mark.parametrize("sf", ["sf0.1", "sf0.01"])
def test_recall_on_the_real_table(spark, sf):
    """All queries of the table against brute force; a session setting changes nothing."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    given = [(r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] is not None]
    ids, x = np.array([i for i, _ in given]), np.array([v for _, v in given], np.float64)
    keep = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ids, x = ids[keep], x[keep]
    got = ann.neighbours(table).toPandas()
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got.vec_id[got.query_id == q])) / 20)
    assert len(hits) == got.query_id.nunique() and np.mean(hits) >= 0.9
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = ann.neighbours(table).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = ["query_id", "rank"]
    assert got.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True))


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.4, 0.5]), (2, [0.5, 0.5]), (20, [1.0, 0.0])], kind)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    near = ann.neighbours(few, k=1, metric="l2").where("query_id = 0").first()
    assert near["vec_id"] == 20 and near["score"] == 0


# -- byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = ["ab" * 30_000, " " * 5000, "x" * 20_001 + "é" * 999, "don't  stop\r\n\n  1234567 ½ 你好 مرحبا ퟿"]


def test_bpe_against_the_library(spark, rows):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = [*rows, *EDGES, *((100_000 + i, t) for i, t in enumerate(LONG))]
    got = bpe.digests(docs(spark, given), RANKS, public_tokenizers.PATTERN).collect()
    expect = []
    for i, t in given:
        ids = enc.encode_ordinary(t or "")
        expect.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(expect)


def test_bpe_round_trip(spark):
    given = [(i, t) for i, t in enumerate(LONG)]
    encoded = bpe.encode(docs(spark, given), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()} == dict(given)
    both = bpe.round_trips(docs(spark, given), RANKS, public_tokenizers.PATTERN).collect()
    assert all(r["decoded_sha256"] == sha(given[r["doc_id"]][1]) and len(r["ids"]) == r["n_tokens"] for r in both)


def merged_by_force(ranks, piece):
    """The leftmost pair of the lowest rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return tuple(ranks[x] for x in parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("shuffled", [False, True])
def test_rank_queue_against_brute_force(shuffled, monkeypatch):
    """Many pieces in one queue; with shuffled ranks longer tokens may come before their parts."""
    rng = np.random.default_rng(5)
    ranks = bpe.ByteBpe.from_bytes(open(RANKS, "rb").read(), public_tokenizers.PATTERN).ranks
    if shuffled:
        ranks = dict(zip(ranks, rng.permutation(len(ranks)).tolist()))
    codec, taken = bpe.ByteBpe(ranks, public_tokenizers.PATTERN), []
    take = codec.queue.take
    monkeypatch.setattr(codec.queue, "take", lambda: taken.append(1) or take())
    pieces = [bytes(rng.choice(list(b"aeinrst \xc3\xa9"), n)) for n in (1, 2, 3, 17, 60) for _ in range(40)] + [b"aaaaaaa", b"a" * 500]
    assert codec.merge(pieces) == [merged_by_force(ranks, p) for p in pieces]
    assert taken and not codec.queue.buckets and not any(codec.queue.low) and not any(codec.queue.mid)


def test_every_piece_of_several_tokens_goes_through_the_queue(monkeypatch):
    codec, seen = bpe.ByteBpe.from_bytes(open(RANKS, "rb").read(), public_tokenizers.PATTERN), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda pieces: seen.extend(pieces) or merge(pieces))
    text = "some quxly wordths and blorfing of snarks"
    ids = codec.encode(text)
    assert set(seen) == {p.encode() for p in codec.pattern.findall(text) if p.encode() not in codec.ranks} and seen and codec.decode(ids) == text.encode()


def test_groups_of_texts_and_long_ones_give_the_same_ids(monkeypatch):
    codec = bpe.ByteBpe.from_bytes(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    texts = ["", "abc def", "one quxly two " * 50, *LONG, "blorf " * 9]
    expect = [codec.encode(t) for t in texts]
    for group, keep in ((1, 3), (80, 0), (700, 10)):
        monkeypatch.setattr(bpe.ByteBpe, "GROUP", group)
        monkeypatch.setattr(bpe.ByteBpe, "KEEP", keep)
        assert [[x for part in parts for x in part] for _, parts in codec.groups(enumerate(texts))] == expect


def test_pieces_that_come_again_and_again_are_merged_once(monkeypatch):
    """With more different pieces than are remembered; the rare ones go, and the queue is shared by a few at a time."""
    codec, seen = bpe.ByteBpe.from_bytes(open(RANKS, "rb").read(), public_tokenizers.PATTERN), []
    texts = [f" quxly zq{a}{b}vx quxly blorfgh{b}{a}jk" for a in "abcdefghij" for b in "klmnopqrst"]
    expect = [codec.encode(t) for t in texts]
    codec = bpe.ByteBpe.from_bytes(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda pieces: seen.append(pieces) or merge(pieces))
    codec.GROUP, codec.KEEP, codec.QUEUED = 60, 20, 30
    assert [[x for part in parts for x in part] for _, parts in codec.groups(enumerate(texts))] == expect
    assert [p for pieces in seen for p in pieces].count(b" quxly") == 1 and len(codec.known) + len(codec.older) < 40
    assert all(len(pieces) == 1 or sum(map(len, pieces)) <= 30 for pieces in seen) and max(map(len, seen)) > 1


# -- decontamination


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def leaky(n=40):
    rng = np.random.default_rng(6)
    vocabulary = [f"t{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(8, 50)))) for i in range(n)]
    out = []
    for i, t in items:
        w = t.split()
        for _ in range(int(len(w) * 0.25 * rng.random())):
            at = int(rng.integers(len(w)))
            kind = rng.integers(3)
            if kind == 0:
                w[at] = "edited"
            elif kind == 1 and len(w) > 3:
                del w[at]
            else:
                w.insert(at, "added")
        out.append((i, " ".join([*rng.choice(vocabulary, 30), *w, *rng.choice(vocabulary, 30)])))
        out.append((1000 + i, " ".join(rng.choice(vocabulary, 90))))
    return items, out


def test_leaks_reach_their_recall_and_nothing_else(spark):
    items, given = leaky()
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "too short"), (903, items[0][1])], "item_id long, text string")
    df = docs(spark, [*given, *EDGES])
    got = decontaminate.leaks(df, bench).collect()
    assert all(r["doc_id"] == r["item_id"] or (r["doc_id"], r["item_id"]) == (0, 903) for r in got)
    assert len({r["doc_id"] for r in got}) >= 0.95 * len(items)
    texts, item = dict(given), dict(items)
    for r in got:
        if r["item_id"] != 903:
            span = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
            assert edits(span, item[r["item_id"]].split()) == r["distance"] <= 0.25 * r["item_words"]
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and left.count() == df.count() - len({r["doc_id"] for r in got})


def test_exact_leaks_by_brute_force(spark, real, rows, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    norm = lambda t: " " + " ".join((t or "").lower().encode().translate(decontaminate._BLANK).decode().split()) + " "
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    expect = {(i, j) for i, t in rows for j, x in items if x in norm(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(real, bench).where("distance = 0").collect()}
    assert got == expect


@pytest.mark.parametrize("m", [4, 9, 12])
def test_items_of_4m_words_with_m_edits_beside_one_of_4m_less_1(m):
    """m substitutions with two words or more between them leave just as many pairs as the lemma says."""
    found = 0
    for trial in range(20):
        beside, item, around = (" ".join(f"{what}{trial}x{i}" for i in range(n)) for what, n in (("a", 4 * m - 1), ("b", 4 * m), ("c", 60)))
        edited = item.split()
        edited[1 : 3 * m : 3] = [f"e{i}" for i in range(m)]
        doc = decontaminate.words(" ".join([around, *edited, around]))
        got = decontaminate.Index([decontaminate.words(beside), decontaminate.words(item)], 0.25).search(doc, np.array([0, len(doc)]))
        found += [x[:3] for x in got] == [(0, 1, m)]
    assert found == 20


@pytest.mark.parametrize("n_items", [24, 1200])
@pytest.mark.parametrize("size", [60, 120, 250])
def test_items_at_the_edit_limit_whatever_their_length_and_number(size, n_items):
    """A full quarter of the words substituted: every leak is found, in benchmarks of any size."""
    rng = np.random.default_rng(size + n_items)
    items = [[f"i{n}x{j}" for j in range(size)] for n in range(24)]
    given = []
    for item in items:
        edited = list(item)
        for j in rng.choice(size, size // 4, replace=False):
            edited[j] = f"e{j}"
        given.append(decontaminate.words(" ".join(["before"] * 20 + edited + ["after"] * 20)))
    more = [[f"m{n}x{j}" for j in range(8)] for n in range(n_items - len(items))]
    index = decontaminate.Index([decontaminate.words(" ".join(x)) for x in [*items, *more]], 0.25)
    got = index.search(np.concatenate(given), np.cumsum([0, *map(len, given)]))
    assert [x[:2] for x in got] == [(n, n) for n in range(24)] and all(x[2] <= size // 4 for x in got)


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_keys_reach_their_recall_at_the_edit_limit(kind):
    """All edits that are allowed, substitutions, deletions, insertions or any: 0.99 of the leaks are found."""
    rng, found, total = np.random.default_rng(kind), 0, 0
    for size in (8, 11, 15, 16, 23, 31, 32, 47, 90):
        items = [[f"i{n}x{j}" for j in range(size)] for n in range(60)]
        given = []
        for n, item in enumerate(items):
            w = list(item)
            for j in sorted(rng.choice(size, size // 4, replace=False).tolist(), reverse=True):
                what = kind if kind < 3 else int(rng.integers(3))
                w[j : j + (what < 2)] = [] if what == 1 else [f"e{n}x{j}"]
            given.append(decontaminate.words(" ".join(["before"] * 9 + w + ["after"] * 9)))
        index = decontaminate.Index([decontaminate.words(" ".join(x)) for x in items], 0.25)
        got = {x[:2] for x in index.search(np.concatenate(given), np.cumsum([0, *map(len, given)]))}
        found, total = found + len(got & {(n, n) for n in range(60)}), total + 60
    assert found >= 0.99 * total


def test_leaks_of_real_tables_by_full_edit_matrices(rows, sf_dir, spark, real):
    """Every document against every item, without any index."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], decontaminate.words(r["text"])) for r in bench.collect()]
    expect = set()
    for d, t in rows:
        doc = decontaminate.words(t or "")
        column = np.arange(len(doc) + 1)
        for i, item in items:
            row = np.zeros(len(doc) + 1, np.int64)
            for x in item:
                step = np.minimum(row[1:] + 1, row[:-1] + (doc != x))
                row = np.minimum.accumulate(np.r_[row[0] + 1, step] - column) + column
            if row.min() <= len(item) // 4:
                expect.add((d, i, int(row.min())))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(real, bench).collect()}
    assert got == expect and expect


def test_no_documents_and_a_very_long_one(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    none = docs(spark, EDGES).limit(0)
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.without_leaks(none, bench).columns == none.columns
    text = "filler words " * 400_000 + "one two three 4 five six seven eight nine ten " + "more " * 9
    got = decontaminate.leaks(docs(spark, [(1, text), (1, text), (None, text)]), bench).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and {(r["distance"], r["start_word"]) for r in got} == {(1, 800_000)}


def test_leaks_by_brute_force():
    """Few different words, so that places are many and near the limit; any kind of edit."""
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{i}" for i in rng.integers(0, 12, n)]
    items, given = [some(rng.integers(8, 21)) for _ in range(25)], []
    for n in range(50):
        w = list(items[n % 25])
        for _ in range(rng.integers(0, len(w) // 3 + 1)):
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(2))] = some(int(rng.integers(2)))
        given.append(some(rng.integers(0, 15)) + w + some(rng.integers(0, 15)))

    def closest(item, doc):
        row = [0] * (len(doc) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    expect = {(d, i, k) for d, doc in enumerate(given) for i, item in enumerate(items) if (k := closest(item, doc)) <= len(item) // 4}
    flat = [decontaminate.words(" ".join(x)) for x in given]
    found = decontaminate.Index([decontaminate.words(" ".join(x)) for x in items], 0.25).search(np.concatenate(flat), np.cumsum([0, *map(len, flat)]))
    assert {x[:3] for x in found} == expect and len(expect) > 25


def test_short_items_and_texts_without_spaces(spark):
    chinese, thai = "水的沸点在海平面上是摄氏一百度吗", "น้ำเดือดที่อุณหภูมิเท่าไร"
    bench = spark.createDataFrame([(1, "Who wrote Hamlet, then?"), (2, chinese), (3, thai), (4, "日本の首都は?"), (5, "pangram"), (6, " .,; "), (7, "three little words")], "item_id long, text string")
    given = [
        (10, "asked: who wrote (Hamlet) then"), (11, "who wrote Hamlet and then"), (12, "题目：" + chinese[:5] + "，" + chinese[5:] + "。答"), (13, chinese.replace("海", "河") + "！"), (14, chinese[:8]),
        (15, "ก" + thai + "ก"), (16, "問「日本の首都は？」答"), (17, "日本の首都"), (18, "Pangram"), (19, "a pangram"), (20, "pangrams"), (21, "three little words three little words"), (22, "three little"), (23, "words"), (24, "."),
    ]
    df = docs(spark, given)
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start_word"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(10, 1, 0, 1), (12, 2, 0, 2), (13, 2, 1, 0), (15, 3, 0, 1), (16, 4, 0, 1), (18, 5, 0, 0), (19, 5, 0, 1), (21, 7, 0, 0)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()} == {11, 14, 17, 20, 22, 23, 24}
    one = decontaminate.words("pangram")
    assert decontaminate.Index([one], 0.25).search(one, np.array([0, 1])) == [(0, 0, 0, 0, 1)]


def test_a_benchmark_in_several_blocks(spark, monkeypatch):
    items, given = leaky(12)
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs(spark, given)
    one = {tuple(r) for r in decontaminate.leaks(df, bench).collect()}
    left = {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 500)
    assert decontaminate._item_blocks(bench)[0] > 3
    assert {tuple(r) for r in decontaminate.leaks(df, bench).collect()} == one and {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()} == left


def test_no_benchmark(spark):
    assert decontaminate.leaks(docs(spark, EDGES), spark.createDataFrame([], "item_id long, text string")).count() == 0


# -- substrings


def removed_by_force(given, k=13):
    first = {}
    for i, t in given:
        w = words(t)
        for j in range(len(w) - k + 1):
            key, i_ = tuple(w[j : j + k]), -(1 << 63) if i is None else i
            first[key] = min(first.get(key, i_), i_)
    out = []
    for i, t in given:
        w, gone = words(t), set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (-(1 << 63) if i is None else i):
                gone |= set(range(j, j + k))
        out.append((str(i), len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out)


def test_removals_against_brute_force(spark, rows):
    passage = " ".join(f"p{i}" for i in range(40))
    more = [(50_000 + i, f"before{i} " * 3 + passage + f" after{i}" * 5) for i in range(30)] + [(49_999, passage[:60]), (49_998, passage + " " + passage)]
    for given in ([*rows, *more, *EDGES], []):
        got = substring_dedup.removals(docs(spark, given))
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == removed_by_force(given)


def test_windows_of_equal_first_hash_are_told_apart(monkeypatch):
    """Every first hash collides; chunks and buckets by hand, as the workers run them."""
    import pyarrow as pa
    import zstandard

    real = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda h, k, base: real(h, k, base) * np.uint64(base == substring_dedup.SECOND))
    rng = np.random.default_rng(5)
    given = [(i, " ".join(rng.choice([f"w{j}" for j in range(300)], 60))) for i in range(8)]
    given += [(20 + i, f"a{i} " + given[i][1][:150] + f" b{i}") for i in range(4)] + [(30, given[0][1])]
    press, buckets = zstandard.ZstdCompressor().compress, 3
    chunks = [pa.table({"chunk": pa.array([n] * len(x), pa.int32()), "doc_id": [i for i, _ in x], "packed": [press(t.encode()) for _, t in x]}) for n, x in enumerate((given[::2], given[1::2]))]
    sent = pa.concat_tables([substring_dedup._send(13, buckets)(c) for c in chunks])
    answers = pa.concat_tables([substring_dedup._answer(sent.filter(pa.array([b == n for b in sent.column("bucket").to_pylist()]))) for n in sorted(set(sent.column("bucket").to_pylist()))])
    got = []
    for n, c in enumerate(chunks):
        own = answers.filter(pa.array([x == n for x in answers.column("chunk").to_pylist()], pa.bool_()))
        got += [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup._remove(13, buckets)(c, own).to_pylist()]
    assert sorted(got) == removed_by_force(given)


# -- pages


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/a">More</a></li></ul></nav><div class="cookie-banner">We use cookies &amp; more</div>
<main><article><h2>The &eacute;vent</h2><p>First   paragraph with enough <b>text</b> to be dense, and some more of it.</p><p>Second one,<br>with a break &#128512;.</p>
<div class="ad">Buy now</div><form>Name <input></form></article></main><aside>Related</aside><section class="comments"><p>I disagree with all of this, said a reader.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "The évent\nFirst paragraph with enough text to be dense, and some more of it.\nSecond one, with a break 😀."


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="a hidden gem"', 'data-role="banner"', "data-class='ad'", 'data-x="class=ad"', 'id="related-work"', 'class="notice"', "class=social-history", 'class="widget share"', 'hidden="until-found"'])
def test_attributes_that_hide_nothing(attrs):
    text = "A paragraph of the article with enough text to be dense, and some more."
    page = "<html><body><div class='content'{}><p{}>" + text + "</p><p>" + text + " <a href='/x?id=menu&class=ad'>A link</a> ends it.</p></div></body></html>"
    expect = text + "\n" + text + " A link ends it."
    assert html_text.extract(page.format(" " + attrs if "class" not in attrs else "", "")) == html_text.extract(page.format("", " " + attrs)) == expect


@pytest.mark.parametrize("block", ["<div hidden>Hidden text of a paragraph that nobody is to see</div>", '<div data-a="x" ROLE="Navigation">Text of a paragraph that leads elsewhere on this site</div>', "<p class=x id=side_ad>Text of an advert that is long enough to be dense</p>", '<div class="related"><ul><li><a href="/1">Another article of this site</a></li><li><a href="/2">One more article of it</a></li></ul></div>', '<div class="share">Share it</div>'])
def test_attributes_that_hide(block):
    text = "A paragraph of the article with enough text to be dense, and some more."
    assert html_text.extract(f"<html><body><article><p>{text}</p>{block}<p>{text}</p><h2 id='related-work'>Related work</h2></article></body></html>") == f"{text}\n{text}\nRelated work"


@pytest.mark.parametrize("page", ["<div class='content has-sidebar'><p>{}</p></div>", "<div class='no-sidebar'><p>{}</p></div>", "<div class='related-posts-page'><article><p>{}</p></article></div>", "<section id=comments><div class=comment><p>{}</p></div></section>"])
def test_a_wrapper_stays_whatever_its_name(page):
    assert html_text.extract(f"<html><body>{page}</body></html>".format("Real article text here.")) == "Real article text here."


@pytest.mark.parametrize("noise", ["<div class='comments'><p>" + "A reader says so. " * 40 + "</p></div>", "<div id='sidebar'><p>" + "Text beside it. " * 40 + "</p></div>", "<ul>" + "<li><a href='/x'>Another page of this site</a></li>" * 30 + "</ul>"])
def test_pages_without_an_article_element(noise):
    parts = [f"Paragraph {i} of the text, which is long enough to be dense as the others are." for i in range(6)]
    text = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in parts[:3]) + "<div>" + "".join(f"<p>{x}</p>" for x in parts[3:]) + "</div>"
    assert html_text.extract(f"<html><body><div id=top><a href='/'>Home</a></div><div id=page>{text}</div>{noise}</body></html>") == "\n".join(["Head", *parts])


def random_dom(rng, depth=0):
    """A tree of (tag, kids), whose kids are trees and texts, of tags that need no repair."""
    tag = "div" if depth == 0 else str(rng.choice(["div", "section", "ul", "b", "a", "span"]))
    inline = tag in ("b", "a", "span")
    kids = []
    for _ in range(rng.integers(1, 5)):
        if depth < 5 and not inline and rng.random() < 0.6:
            kids.append(random_dom(rng, depth + 1))
        else:
            kids.append(" ".join(rng.choice(["so", "many", "words", "stand", "here"], rng.integers(1, 15))))
    return tag, kids


def counts_by_force(node, blocks=True):
    """Characters, tags, characters in links, link tags below; without blocks: not those of blocks."""
    c = t = lc = lt = 0
    for kid in node[1]:
        if isinstance(kid, str):
            c += len(kid)
        elif blocks or kid[0] in ("b", "a", "span"):
            x = counts_by_force(kid, blocks)
            c, t, lc, lt = c + x[0], t + x[1] + 1, lc + (x[0] if kid[0] == "a" else x[2]), lt + x[3] + (kid[0] == "a")
    return c, t, c if node[0] == "a" else lc, lt


def density_by_force(counts, body):
    c, t, lc, lt = (max(x, 1) for x in counts)
    if not counts[0]:
        return 0
    base = np.log(c / max(1, c - lc) * lc + max(body[2], 1) / max(body[0], 1) * c + np.e)
    return c / t * np.log(c / lc * t / lt) / np.log(base)


def test_density_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        tree = ("body", [random_dom(rng) for _ in range(rng.integers(1, 4))])
        html = lambda n: n if isinstance(n, str) else f"<{n[0]}>" + "".join(map(html, n[1])) + f"</{n[0]}>"  # noqa: E731, B023
        body, nodes = counts_by_force(tree), []

        def visit(n):
            inline = n[0] in ("b", "a", "span")
            below = [visit(k) for k in n[1] if not isinstance(k, str)]
            total = sum(d if block else s for block, d, s in below)
            d = density_by_force(counts_by_force(n), body)  # noqa: B023
            if not inline:
                total += density_by_force(counts_by_force(n, False), body)  # noqa: B023
                nodes.append((n, d, total))  # noqa: B023
            return not inline, d, total

        visit(tree)
        order, _ = html_text._measure(html_text.parse("<html>" + html(tree) + "</html>"))
        got = [x for x in order if x.tag in ("body", "div", "section", "ul")]
        assert sorted((x.tag, round(x.density, 6), round(x.sum, 6)) for x in got) == sorted((n[0], round(float(d), 6), round(float(t), 6)) for n, d, t in nodes)
        best = max(got, key=lambda x: x.sum)
        assert abs(best.sum - max(t for _, _, t in nodes)) < 1e-6


def test_odd_pages(spark):
    given = [(1, "u", None), (2, "u", ""), (3, None, "plain text only"), (4, "u", "<p>one<p>two"), (5, "u", "<div>" * 5000 + "<p>deep text here</p>"), (6, "u", "<p>cut <a href='x"), (7, "u", "<script>only</script>"), (8, "u", "<p>" + "long text " * 300_000 + "</p>"), (9, "u", PAGE), (9, "u", PAGE)]
    df = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = html_text.main_text(df).collect()
    got = {r["page_id"]: r for r in found}
    assert sum(r["text"] == html_text.extract(PAGE) for r in found if r["page_id"] == 9) == 2 and got[8]["n_chars"] == 2_999_999
    assert [got[i]["text"] for i in (1, 2, 3, 4, 7)] == ["", "", "plain text only", "one\ntwo", ""]
    assert got[5]["text"] == "deep text here" and got[6]["text"] == "cut"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# -- token counts


def test_counts_against_the_library(spark, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    given = [*rows, *EDGES, *((100_000 + i, t) for i, t in enumerate(["ab" * 40_000, "a  b   c ▁ ▁▁x", "</s><s>[INST]", "x" * 70_000 + " y", "你好 " * 30_000]))]
    got = token_fst.counts(docs(spark, given), token_fst.load(path)).collect()
    expect = sorted((str(i), len((t or "").encode()), n := len(sp.encode(t or "", num_threads=1)), n > 4096) for i, t in given)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == expect


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def transducer():
    return token_fst.Transducer(token_fst.load(PIECES))


def test_chunk_maps_compose_by_the_scan(transducer):
    """Every prefix of the scan has the count of one walk over the text so far, and ends where whatever follows counts the same."""
    t, start = transducer, transducer.states[0]
    for text in (" the cat  sat on a matter of facts, unbelievably so" * 3, " x" + "abcde" * 40 + " y", " " * 40, "unbroken" * 30):
        for size in (1, 3, 7, 20):
            chunks = [text[i : i + size] for i in range(0, len(text), size)]
            for i, m in enumerate(t.scan([t.chunk(c) for c in chunks])):
                (a, n), (b, k) = t.apply(m, start), t.walk(start, "".join(chunks[: i + 1]))
                assert n == k and a[0] == b[0] and all(t.walk(a, c)[1] == t.walk(b, c)[1] for c in ("er", "s on", " and"))


def test_counting_goes_through_maps_and_scan(transducer, monkeypatch):
    sizes, scan = [], transducer.scan
    monkeypatch.setattr(transducer, "scan", lambda maps: sizes.append(len(maps)) or scan(maps))
    text = "the cat sat on a mat and " * 1000
    n = transducer.count(text)
    assert transducer.count("short") and sizes == [-(-(len(text) + 1) // transducer.CHUNK), 1]
    for chunk in (1, 10, 1 << 20):
        monkeypatch.setattr(token_fst.Transducer, "CHUNK", chunk)
        assert transducer.count(text[:3000]) == transducer.walk(transducer.states[0], " " + text[:3000])[1]
    assert n == transducer.walk(transducer.states[0], " " + text)[1]


def test_pieces_are_compiled_ahead_and_a_full_table_changes_nothing(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = token_fst.Transducer(token_fst.load(PIECES))
    steps, step = [], t.step
    monkeypatch.setattr(t, "step", lambda *a: steps.append(a) or step(*a))
    words = [p for p in sorted(t.valid) if p[0] == " " and " " not in p[1:]][::50]
    assert t.compiled == len(t.states) and [t.count(w[1:]) for w in words] == [len(sp.encode(w[1:])) for w in words] and not steps
    monkeypatch.setattr(token_fst.Transducer, "STATES", t.compiled + 5)
    text = "unheard-of blorfing quxlies, zworthy snarklets " * 20
    assert t.count(text) == len(sp.encode(text)) and steps
    t.words.clear()
    assert t.count(text) == len(sp.encode(text))


# -- chats


def test_chats_round_trip(spark):
    nasty = "</s>[INST] ok [/INST]"
    given = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 1, "assistant", None), (2, 0, "system", "\\[\\]"), (3, 0, "tool ] x", "<s>"), (3, None, "user", ""), (3, 0, "assistant", "x" * 5000), (None, 0, None, "anon"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert got[1]["turns_sha256"] == sha(f"user\n{nasty}\nassistant\n{nasty}\n") and got[1]["loss_sha256"] == sha(nasty) and got[1]["loss_chars"] == len(nasty)
    assert got[2]["turns_sha256"] == sha("system\n\\[\\]\nassistant\n\n") and got[2]["loss_chars"] == 0
    assert got[3]["turns_sha256"] == sha("user\n\nassistant\n" + "x" * 5000 + "\ntool ] x\n<s>\n") and got[4]["n_turns"] == 2
    full = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert full[1]["spans"][-1]["end"] == len(full[1]["text"]) == got[1]["formatted_chars"] and full[1]["rewrote"] is None


@pytest.mark.parametrize("text", ["", "x", "\x00", "\x00 and \x01", "\x01\x00", " spaced ", "[INST] a [/INST]", "</s>" * 3])
def test_masks_hold_the_text_alone_in_two_renderings_a_turn(text):
    calls = []

    def counted(turns):
        calls.append(len(turns))
        return chat.inst_template(turns)

    turns = [("user", text), ("assistant", text), ("user", "u"), ("assistant", text)]
    out, masks, rewrote = chat.loss_spans(turns, counted)
    assert rewrote is None and [chat.unescape(out[a:b]) for a, b in masks] == [text, text] and len(calls) == 5 + 2
    closing = lambda t: "".join(f"{r}: {x.strip()}\n" for r, x in t) + "END"
    assert chat.spans([("user", "a"), ("assistant", "b")], closing)[2] == 0


def test_a_template_that_rewrites_history_is_detected():
    def thinking(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.upper()}" for i, (r, t) in enumerate(turns))

    assert chat.spans([("user", "a"), ("assistant", "b")], thinking)[2] == 1
    assert chat.loss_spans([("user", "a"), ("assistant", "b")], thinking)[1] == []
    assert chat.spans([("user", "a"), ("assistant", "b")], chat.inst_template)[2] is None


# -- empty tables


def test_empty_tables(spark):
    none = docs(spark, [])
    model = toxicity.Model(b"", b"", (b"", b""), (), 0.0)
    for df in (
        pii.spans(none), pii.sanitised(none), toxicity.scores(none, model), minhash.near_duplicates(none), minhash.deduplicated(none), bpe.digests(none, RANKS, public_tokenizers.PATTERN), substring_dedup.removals(none),
        token_fst.counts(none, (("a", 0.0),)), chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0
