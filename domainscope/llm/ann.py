"""Nearest neighbours by additive quantisation with exact reranking.

A vector is coded as a sum of M full-dimensional codewords, one of each codebook. The codebooks are trained one after
another by k-means on what the ones before leave over (a bounded sample: the SAMPLE vectors whose id has the smallest hash); a
vector's codes are searched with a beam, which keeps the BEAM best partial sums at each codebook. Codes and the norms of
the sums are stored. A query makes one table of its inner products with all codewords; a row's approximate score is the
sum of M table entries (and, for Euclidean distance, its stored norm). The best of each block are scored again on the
original vectors in double precision.

Every row is indexed: rows are dealt to blocks by the hash of their id, and each block meets the whole query set, a block of
queries at a time, in an equi-join on the block's number; a row's block depends on its id and the number of rows only. A block returns its k best for each query; the k best of these are the result. Equal
vectors of a block are one entry with its k + 1 smallest ids: with ties going to the smaller id no further one can be among
the k nearest of any query, so a vector that many rows share neither fills the candidate list nor loses a neighbour.

Edge cases: vectors that are null, all zero, hold a null or non-finite component, or have another length than most (the longer
of equally frequent ones) take no part, nor do rows without an id. Rows repeated with one id count once, as the greatest
of their vectors in component order. With at most k candidates a query gets all of them; without any, no row. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOKS, WORDS, BEAM, SAMPLE, ROUNDS = 12, 256, 4, 20_000, 8
#: Rows of a block and queries of a block, about, and how many of a block's entries are scored exactly. No session setting changes them.
ROWS, QUERIES, POOL = 8192, 4096, 384


class Codebooks(NamedTuple):
    words: np.ndarray  # (BOOKS, WORDS, dimension), float32


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", words, words)
    return np.concatenate([np.argmax(x[i : i + 4096] @ words.T - half, axis=1) for i in range(0, len(x), 4096)])


def train(sample: np.ndarray, seed: int = 7) -> Codebooks:
    """Residual codebooks by Lloyd rounds; a codeword that nothing is near is set on the vector with the largest residual."""
    rng, rest = np.random.default_rng(seed), sample.astype(np.float32).copy()
    books = np.zeros((BOOKS, WORDS, sample.shape[1]), np.float32)
    for m in range(BOOKS):
        words = books[m]
        pick = rng.permutation(len(rest))[:WORDS]
        words[: len(pick)] = rest[pick]
        for _ in range(ROUNDS):
            at = _nearest(rest, words)
            counts = np.bincount(at, minlength=WORDS)
            order = np.argsort(at, kind="stable")
            full = np.flatnonzero(counts)
            words[full] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(counts[full])[:-1]], axis=0) / counts[full, None]
            if len(empty := np.flatnonzero(counts == 0)):
                far = np.argsort(-np.einsum("ij,ij->i", rest, rest), kind="stable")[: len(empty)]
                words[empty[: len(far)]] = rest[far]
        rest -= words[_nearest(rest, words)]
    return Codebooks(books)


def encode(x: np.ndarray, books: Codebooks, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, BOOKS) and the squared norms of the coded sums, by beam search."""
    codes, norms = [], []
    for i in range(0, len(x), 1024):
        c, n = _encode(x[i : i + 1024].astype(np.float32), books.words, beam)
        codes.append(c)
        norms.append(n)
    return np.concatenate(codes) if codes else np.empty((0, BOOKS), np.uint8), np.concatenate(norms) if norms else np.empty(0, np.float32)


def _encode(x: np.ndarray, words: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, d = x.shape
    rest, codes = x[:, None, :], np.empty((n, 1, 0), np.uint8)
    row = np.arange(n)[:, None]
    for m, book in enumerate(words):
        width = rest.shape[1]
        gain = (rest.reshape(-1, d) @ book.T) * -2 + np.einsum("ij,ij->i", book, book)
        cost = (gain.reshape(n, width, -1) + np.einsum("nbd,nbd->nb", rest, rest)[:, :, None]).reshape(n, -1)
        keep = beam if m < len(words) - 1 else 1
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        source, word = best // WORDS, best % WORDS
        rest = rest[row, source] - book[word]
        codes = np.concatenate([codes[row, source], word[:, :, None].astype(np.uint8)], axis=2)
    coded = x - rest[:, 0]
    return codes[:, 0], np.einsum("ij,ij->i", coded, coded)


def _exact(columns: np.ndarray, near: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(queries, candidates) scores in double precision, summed over the components in their order, so that every engine that does gets the same."""
    out = np.zeros(near.shape)
    for column, v in zip(columns, q.T, strict=True):
        out += column[near] * v[:, None] if metric == "ip" else np.square(column[near] - v[:, None])
    return out if metric == "ip" else -out


def search_block(queries: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: Codebooks, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores) of the k best of one block for each query, best first; ids ascend, so that ties do."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    new = np.r_[True, np.any(vectors[order][1:] != vectors[order][:-1], axis=1)]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(order)])
    first = order[starts]
    columns, code = np.ascontiguousarray(vectors[first].T.astype(np.float64)), [np.ascontiguousarray(c, np.intp) for c in codes[first].T]
    pool = min(len(first), POOL)
    few = np.minimum(sizes, k + 1)
    for i in range(0, len(queries), 64):
        q = queries[i : i + 64]
        tables = np.einsum("qd,mwd->mqw", q.astype(np.float32), books.words, optimize=True)
        if pool < len(first):
            score = np.take(tables[0], code[0], axis=1)
            for table, c in zip(tables[1:], code[1:], strict=True):
                score += np.take(table, c, axis=1)
            if metric == "l2":
                score -= 0.5 * norms[first]
            near = np.argpartition(-score, pool - 1, axis=1)[:, :pool]
        else:
            near = np.broadcast_to(np.arange(len(first)), (len(q), len(first)))
        for j, (at, exact) in enumerate(zip(near, _exact(columns, near, q.astype(np.float64), metric), strict=True)):
            if len(at) > k + 1:
                least = np.partition(exact, len(exact) - k - 1)[-k - 1]
                at, exact = at[exact >= least], exact[exact >= least]
            n = few[at]
            places = np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found, value = ids[order[places]], np.repeat(exact, n)
            other = found != q_ids[i + j]
            found, value = found[other], value[other]
            top = np.lexsort((found, -value))[:k]
            yield np.full(len(top), q_ids[i + j]), found[top], value[top]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, v array<double>) of the rows that take part, their number and their length."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return good, 0, 0
    return good.where(F.size("v") == sizes["d"]), sizes["n"], sizes["d"]


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, d) if column.num_chunks else np.empty((0, d))


def _once(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and vectors, one for each id."""
    ids, x = table.column("id").to_numpy(), _matrix(table.column("v"), d)
    order = np.lexsort((*x.T[::-1], ids))
    last = np.r_[ids[order][1:] != ids[order][:-1], True]
    return ids[order][last], x[order][last]


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, metric: str = "ip", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k nearest other rows.

    metric: "ip", the largest inner product, or "l2", the least Euclidean distance (the score is minus its square)."""
    if metric not in ("ip", "l2"):
        raise ValueError(f"metric {metric!r}: ip or l2")
    spark = vectors.sparkSession
    good, total, d = usable(vectors, id_col, vector_col)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = good.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE).select("v").toArrow()
    books = train(_matrix(sample.column("v"), d))
    blocks, query_blocks = -(-total // ROWS), -(-total // (every * QUERIES))

    def indexed(table: pa.Table) -> pa.Table:
        ids, x = _once(table, d)
        codes, norms = encode(x, books)
        return pa.table({"block": table.column("block")[:1], "ids": [ids.tobytes()], "vectors": [x.tobytes()], "codes": [codes.tobytes()], "norms": [norms.tobytes()]}, schema=_INDEXED)

    def packed(table: pa.Table) -> pa.Table:
        ids, x = _once(table, d)
        return pa.table({"q_block": table.column("q_block")[:1], "q_ids": [ids.tobytes()], "q_vectors": [x.tobytes()]}, schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: E731, B023
                parts = list(search_block(f("q_vectors", float).reshape(-1, d), f("q_ids", np.int64), f("ids", np.int64), f("vectors", float).reshape(-1, d), f("codes", np.uint8).reshape(-1, BOOKS), f("norms", np.float32), books, k, metric))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=_FOUND)

    index = good.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(indexed, "block int, ids binary, vectors binary, codes binary, norms binary")
    queries = good.where(F.pmod("id", F.lit(every)) == 0).withColumn("q_block", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_blocks)).cast("int"))
    queries = queries.groupBy("q_block").applyInArrow(packed, "q_block int, q_ids binary, q_vectors binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.hint("shuffle_merge").join(queries, "block").select("ids", "vectors", "codes", "norms", "q_ids", "q_vectors").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


_INDEXED = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("norms", pa.binary())])
_PACKED = pa.schema([("q_block", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
