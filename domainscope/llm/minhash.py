"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles (64-bit hashes). Documents of equal sets form a class, known by a 128-bit
digest and numbered; only the classes go on. A class gets a signature of K symbols of b = 16 bits, one MinHash each. The
signature is split into M chunks; by the pigeonhole principle two signatures that differ in at most M (E + 1) - 1
symbols agree in some chunk up to E errors, so each chunk is indexed under every way of leaving out E of its symbols.
That finds *all* pairs within this distance: with K = 40, M = 10, E = 1 up to 19 of 40, where a similarity of 0.8 is
expected at 8 and exceeds 19 in fewer than one pair in 10,000.

Pairs within an index key aren't all emitted. First, each member is compared with CENTRES members of its key, the class that meets
most others over all keys and some by hash, and what is confirmed is merged into components. Then every pair of one key whose components
still differ is compared, so that no link between different components is lost; links within a component change nothing. Two sets of different
components can only share shingles that are met in more than one component, c(x) of x's; so nothing with c(x) below the share of
its size has a link left, and a pair's intersection is at most the smaller c. Both tests lose nothing, and they clear the crowds
of distant variants around a much copied text.
Before the comparison of full sets, two tests that lose nothing are made: the ratio of the set sizes, and the parities of the sets' elements
by hash bucket, which bound their difference from below. A pair that shares several keys is compared at the first only.

Full sets are made of one text of each class that shares a key. A filter on the ids and texts wanted keeps the others from being shuffled; the sets
are written parted by class, and pairs are sent to them.

Edge cases: null and empty texts, and texts of white space only, have an empty set, are linked with nothing and are kept. With fewer
words than a shingle the whole sequence is the one shingle. Rows repeated with one doc_id fall into one class and each keep their row; an id
that comes with different texts stands in the class of each, links them all the same, and each row has the component of its own text. A null
doc_id gets a row as everyone does: components are named by the smallest doc_id that is not null. An empty table gives
an empty result; other columns are ignored; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, give_back, hinted, id_and_text, release, small_batches
from .words import U, hashes, mix, parts, windows

SYMBOLS, CHUNKS, ERRORS, CENTRES = 40, 10, 1, 3
#: Bits of the filter that tells which texts are read again: for each such text, and in all, 8 MB, at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 26
#: Bytes of the table for each part of the sets.
PART_BYTES = 16 << 20
PARITY_BITS = 512
_rng = np.random.default_rng(20240117)
_ODD = [U(int(x) | 1) for x in _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.int64)]


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = text.lower().split()  # A-Z and the six white space characters, as bytes have it
    if not words:
        return np.empty(0, U)
    h = hashes(words)
    if len(h) >= k:
        return np.unique(windows(h, k))
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], U)


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For the sets that begin at starts in flat: (sets, K) 16-bit symbols."""
    symbols = np.empty((len(starts), SYMBOLS), np.uint16)
    for i, a in enumerate(_ODD):
        symbols[:, i] = (mix(np.minimum.reduceat(flat * a, starts)) >> U(48)).astype(np.uint16)
    return symbols


def parities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, PARITY_BITS / 64): for each set, whether the number of its elements in a hash bucket is odd.

    Two sets differ in at least as many elements as their parities in bits, whatever they share."""
    bucket = np.repeat(np.arange(len(sizes)) * PARITY_BITS, sizes) + (mix(flat) >> U(65 - PARITY_BITS.bit_length())).astype(np.int64)
    odd = np.bincount(bucket, minlength=len(sizes) * PARITY_BITS).reshape(len(sizes), PARITY_BITS) & 1
    return np.packbits(odd.astype(bool), axis=1).view(">i8").astype(np.int64)


def index_keys() -> Column:
    """The index keys of a signature (chunks): for each chunk and each symbol left out of it, a hash of the others; the last six bits are its number.

    Computed where they are exploded, so that 40 numbers a class are neither stored nor shuffled."""
    size = SYMBOLS // CHUNKS
    others = [F.lit(int(np.int64(~(0xFFFF << 16 * j)) if j < size - 1 else 0xFFFFFFFFFFFF)).cast("long") for j in range(size)]
    number = lambda i, j: F.lit(size * i + j).cast("long")
    return F.array(*(F.xxhash64(number(i, j), F.get("chunks", i).bitwiseAND(others[j])).bitwiseAND(F.lit(-64).cast("long")).bitwiseOR(number(i, j)) for i in range(CHUNKS) for j in range(size)))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("chunks", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])


def _digest(elements: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(elements), np.int64).tolist())


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), h1, h2 (digest of the set, null if empty),
    chunks (the signature, four symbols in a number), parity (of the number of shingles in each of PARITY_BITS buckets)."""

    def batch(ids: list, t: pa.Array, texts: list[str]) -> pa.RecordBatch:
        sets = [shingles(t.encode(), k) for t in texts]
        n = np.array([len(s) for s in sets], np.int64)
        full = [i for i in range(len(sets)) if n[i]]
        cols: list[list] = [[None] * len(sets) for _ in range(4)]
        if full:
            sizes = n[full]
            flat = np.concatenate([sets[i] for i in full])
            packed, odd = signatures(flat, np.r_[0, np.cumsum(sizes)[:-1]]).view(np.int64), parities(flat, sizes)
            for at, i in enumerate(full):
                cols[0][i], cols[1][i] = _digest(sets[i])
                cols[2][i], cols[3][i] = packed[at], odd[at]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, t, n, *cols], _SIGNED.types, strict=True)], schema=_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):  # about 2 MB of text, and 1,000 documents, at a time
                end, size = at, 0
                while end < len(ids) and (end == at or end < at + 1000 and size + len(texts[end]) < 2_000_000):
                    size += len(texts[end])
                    end += 1
                yield batch(ids[at:end], b.column(2).slice(at, end - at), texts[at:end])
                at = end
            del b, ids, texts
        give_back()

    return id_and_text(small_batches(docs)).withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, n long, h1 long, h2 long, chunks array<long>, parity array<long>")


def _filter(hashed: DataFrame, n: int) -> np.ndarray:
    """The bits at the remainders of n numbers (the only column) by how many bits there are, as bytes.

    Each stretch of 32,768 bits is put together in one task, so that what is shuffled are the numbers and not bitmaps of every task."""
    size = 1 << 15
    while size < min(FILTER_BITS * n, FILTER_MOST):
        size *= 2
    at = hashed.select(F.pmod(F.col(hashed.columns[0]), F.lit(size)).alias("at"))
    stretches = at.select(F.shiftright("at", 15).alias("part"), F.col("at").bitwiseAND(F.lit(32767)).alias("bit")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit"))
    out = np.zeros((size >> 15, 4096), np.uint8)
    for part, bitmap in stretches.collect():
        out[part] = np.frombuffer(bitmap, np.uint8)
    return out.ravel()


def _among(docs: DataFrame, hashed: Column, bits: np.ndarray) -> DataFrame:
    """The rows of docs whose hash is in a filter: all that were put in, and a few more. The others don't reach a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            del b
        give_back()

    marked = docs.withColumn("at", F.pmod(hashed, F.lit(8 * len(bits))).cast("long"))
    return small_batches(marked).mapInArrow(run, marked.schema).select(docs.columns)


@contextmanager
def _as_planned(spark: SparkSession) -> Iterator[None]:
    """Without adaptive plans: of frames that these write, Spark doesn't know how the rows were parted."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """c, elements: the sets of texts (c, text) as ascending 64-bit hashes. A c that a task meets again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                new = {c: t for c, t in zip(b.column(0).slice(at, 200).to_pylist(), b.column(1).slice(at, 200).to_pylist(), strict=True) if c not in seen}
                seen.update(new)
                sets = [shingles(t.encode(), k).view(np.int64) for t in new.values()]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "elements"])
                del new, sets
            del b
        give_back()

    return small_batches(texts).mapInArrow(run, "c long, elements array<long>")


def _alike_in_size(a: str, b: str, percent: int) -> Column:
    return (F.least(f"{a}.n", f"{b}.n") * 100) >= (F.greatest(f"{a}.n", f"{b}.n") * percent)


def _little_apart(a: str, b: str, percent: int) -> Column:
    """What can still be a link, from the parities: sets of this similarity differ in at most (100 - percent) / (100 + percent) of their sizes' sum."""
    apart = sum((F.bit_count(F.col(f"{a}.q{i}").bitwiseXOR(F.col(f"{b}.q{i}"))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def _first_met(a: str, b: str) -> Column:
    """Whether the key of two joined rows is the first that they share, and their signatures are within the guaranteed distance.

    Of the four 16-bit symbols in a number, those that differ are found by adding 2**15 - 1 to each without its top bit."""
    low, top = 0x00007FFF7FFF7FFF, 0x0000800080008000
    distance, first = F.lit(0), []
    for i in range(CHUNKS):
        x = F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))
        three = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(top))
        last = F.shiftrightunsigned(x, 48) != 0
        n = F.bit_count(three) + last.cast("int")
        which = F.when(last, 3).when(three == 0x8000, 0).when(three == 0x80000000, 1).otherwise(2)
        first.append(F.when(n == 0, 4 * i).when(n == 1, which + 4 * i))
        distance = distance + n
    return (distance < CHUNKS * (ERRORS + 1)) & (F.coalesce(*first) == F.col(f"{a}.key").bitwiseAND(F.lit(63)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("elements").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return joined.where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")


def _in_other_components(sets: DataFrame) -> DataFrame:
    """c, shared: how many shingles of each set (c, elements, root) are in a set with another root, too."""
    tokens = sets.select("c", "root", F.explode("elements").alias("token"))
    both = tokens.groupBy("token").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first < last").select("token")
    return tokens.join(both, "token", "left_semi").groupBy("c").agg(F.count("*").alias("shared"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the undirected edges (a, b) with the smallest node that it is connected with.

    Alternating large-star and small-star steps until nothing changes, each a minimum by key and a join; every step's result
    is checkpointed. The rows of a node with many neighbours are split by the skew join."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        new = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        now = after
        if tuple(new) == mark:
            break
        mark = tuple(new)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t, n, root (the smallest doc_id of the component) and component (its number; none of empty sets) of every row."""
    all_docs = checkpointed(signed(docs, k))
    full = all_docs.where("h1 is not null")
    # equal sets have equal signatures, so that any of them will do; the number c of a class holds once it is written
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    classes = full.groupBy("h1", "h2").agg(least.alias("m"), F.min("n").alias("n"), F.first("chunks").alias("chunks"), F.first("parity").alias("parity"))
    classes = checkpointed(classes.select("h1", "h2", F.col("m.doc_id").alias("rep"), F.col("m.t").alias("t"), "n", "chunks", "parity", F.monotonically_increasing_id().alias("c")))
    every = classes.select("c", "n", F.explode(index_keys()).alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(every.join(shared, "key"))
    named = checkpointed(classes.select("c", "rep", F.col("t").alias("u")).join(members.groupBy("c").agg(F.sum("size").alias("weight")), "c"))
    weight = named.select("c", "weight")
    texts = _among(id_and_text(docs).withColumn("t", F.xxhash64("text")), F.xxhash64("doc_id", "t"), _filter(named.select(F.xxhash64("rep", "u")), named.count()))
    texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t") == F.col("u"))).select("c", "text")
    with _as_planned(docs.sparkSession):  # parted by c once and for all: what joins them later comes to them
        sets = checkpointed(_sets(texts, k).repartition(parts(docs, PART_BYTES), "c").dropDuplicates(["c"]))

    orders = [F.col("weight"), *(F.xxhash64("c", F.lit(i)) for i in range(CENTRES - 1))]
    centres = members.join(weight, "c").groupBy("key").agg(F.array_distinct(F.array(*(F.max(F.struct(o.alias("o"), F.negative("c").alias("order"), F.struct("c", "n").alias("m")))["m"] for o in orders))).alias("m"))
    tried = (
        members.alias("x").join(centres.select("key", F.explode("m").alias("m")).select("key", "m.*").alias("y"), "key").where((F.col("x.c") != F.col("y.c")) & _alike_in_size("x", "y", percent))
        .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    )
    odd = classes.select("c", "n", *(F.get("parity", i).alias(f"q{i}") for i in range(PARITY_BITS // 64)))
    tried = checkpointed(tried)
    near = tried.join(odd.alias("x"), F.col("a") == F.col("x.c")).join(odd.alias("y"), F.col("b") == F.col("y.c")).where(_little_apart("x", "y", percent)).select("a", "b")
    stars = checkpointed(_confirmed(near, sets, percent))

    merged = components(stars)
    placed = checkpointed(members.join(merged.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")))
    centre = placed.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.mode("root").alias("centre")).where("first < last").select("key", "centre")
    open_keys = checkpointed(placed.join(centre, "key"))
    others = _in_other_components(sets.join(open_keys.select("c", "root").distinct(), "c"))
    chunks = classes.select("c", *(F.get("chunks", i).alias(f"p{i}") for i in range(CHUNKS)))
    open_keys = open_keys.join(others, "c").where(F.col("shared") * 100 >= F.col("n") * percent).join(chunks, "c").join(odd.drop("n"), "c")
    open_keys = checkpointed(open_keys)
    fits = (F.least("x.shared", "y.shared") * (100 + percent)) >= ((F.col("x.n") + F.col("y.n")) * percent)
    rest = (
        open_keys.where("root <> centre").alias("x").join(open_keys.alias("y"), F.col("x.key") == F.col("y.key")).where((F.col("x.root") != F.col("y.root")) & fits & _alike_in_size("x", "y", percent) & _little_apart("x", "y", percent) & _first_met("x", "y"))
        .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    )
    links = stars.unionByName(_confirmed(rest.join(tried, ["a", "b"], "left_anti"), sets, percent))
    roots = components(links).withColumnRenamed("node", "c").join(classes.select("c", "rep"), "c")
    roots = roots.join(roots.groupBy("root").agg(F.min("rep").alias("least")), "root").select("c", "root", "least")
    names = classes.select("c", "h1", "h2", "rep").join(roots, "c", "left").select("h1", "h2", F.coalesce("root", "c").alias("component"), F.coalesce("least", "rep").alias("root"))
    found = full.select("doc_id", "t", "n", "h1", "h2").join(names, ["h1", "h2"]).select("doc_id", "t", "n", "root", "component")
    alone = all_docs.where("h1 is null").select("doc_id", "t", "n", F.col("doc_id").alias("root"), F.lit(None).cast("long").alias("component"))
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id)."""
    kept = F.col("doc_id").eqNullSafe(F.col("root"))
    return _rooted(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, all columns unchanged: the smallest doc_id's; of several texts under it, the one of the
    smallest hash; of rows that repeat both, any one. Rows without words or without a doc_id all stay."""
    rows = _rooted(docs, k, percent).where("n > 0 and doc_id is not null").groupBy("component", "doc_id", "t").agg(F.count("*").alias("copies"))
    rows = checkpointed(rows)
    stay = rows.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("s")).select("s.*")
    gone = checkpointed(rows.select("doc_id", "t").join(stay, ["doc_id", "t"], "left_anti"))
    twice = rows.where("copies > 1").select("doc_id", "t").join(stay, ["doc_id", "t"], "left_semi")
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("row")).withColumns({"doc_id": F.col("row.doc_id").cast("long"), "t": F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))})
    left = keyed.join(hinted(gone, gone.count()), ["doc_id", "t"], "left_anti")
    if (n := twice.count()):
        again = left.join(hinted(twice, n), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
        left = left.join(hinted(twice, n), ["doc_id", "t"], "left_anti").unionByName(again)
    return left.select(*(F.col("row").getField(c).alias(c) for c in names))
