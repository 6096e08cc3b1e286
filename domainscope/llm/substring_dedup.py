"""Exact substring deduplication: word windows that also start in an earlier document are removed.

Documents are dealt into chunks by doc_id. A chunk reduces its 13-word windows to the distinct Rabin-Karp hashes, each
with the smallest doc_id that has it here, and sends them packed, one blob for each hash bucket. A bucket counts the
hashes over all chunks and answers each chunk with the entries that a smaller doc_id of another chunk has. So a passage
that a third of all documents share costs one entry a chunk, never a group of all its occurrences; texts move once (compressed), hashes
once, answers are small. The covered windows merge into maximal removal intervals.

Two rolling hashes with their own word hashes and bases tell windows apart. A chunk compares all 128 bits; between chunks travel 64 bits of the first and 16 of the
second, whose other bits choose the bucket: 80 bits and the logarithm of the number of buckets, which grows with the input.
Among 10^13 windows, in 2^24 buckets, one pair by chance is expected in 4 * 10^5 such corpora.

Chunks and buckets hold a constant amount of data each, whatever the input. A blob shrinks as the number of buckets grows, down to one window of
26 bytes and about as much again for its row, three times what a window costs in a large blob.

Edge cases: null and empty texts have no words and keep nothing (the digest of the empty string); a text of fewer words
than a window loses nothing, and a window repeated within one document alone stays; rows repeated with one doc_id are not
earlier than each other, so they lose nothing to each other; a null doc_id sorts before all others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_and_text, small_batches
from .words import BASE, SECOND, U, parts, two_hashes, windows

_NULL_ID = np.iinfo(np.int64).min
_PART_BYTES = 4 << 20
_LOW = U((1 << 48) - 1)


def _packed(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, doc_id, text as a zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            part = None
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([press.compress(t.encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["chunk", "doc_id", "packed"])
            del b, part
        give_back()

    dealt = id_and_text(small_batches(docs)).select(F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")
    return dealt.mapInArrow(run, "chunk int, doc_id long, packed binary")


class _Chunk:
    """The documents of a chunk by ascending doc_id, and the distinct windows by bucket. Texts stay packed; words are cut again when they are needed."""

    def __init__(self, table: pa.Table, k: int, buckets: int):
        ids = np.array([_NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        self.packed, self.order = table.column("packed"), np.argsort(ids, kind="stable")
        self.ids, sizes = ids[self.order], []
        hashed: tuple[list, list] = [], []
        for n in range(len(ids)):
            for h, base, each in zip(two_hashes(self.words(n)), (BASE, SECOND), hashed, strict=True):
                each.append(windows(h, k, base))
            sizes.append(len(hashed[0][-1]))
        self.sizes, self.ends = np.array(sizes, np.int64), np.cumsum(sizes, dtype=np.int64)
        self.one, self.two = (np.concatenate(x) if x else np.empty(0, U) for x in hashed)
        del hashed
        #: an order of the places by window, where each distinct window starts in it, and its first place (so the smallest doc_id)
        self.places, self.starts = _grouped(self.one, self.two)
        self.first = self.places[self.starts]
        self.one, self.two = self.one[self.first], self.two[self.first]
        self.first_id = self.ids[np.searchsorted(self.ends, self.first, "right")]
        bucket = ((self.two & _LOW) % U(buckets)).astype(np.int32)
        self.by_bucket = np.lexsort((self.first, bucket)).astype(np.int32)
        self.edges = np.searchsorted(bucket[self.by_bucket], np.arange(buckets + 1))

    def words(self, n: int) -> list[bytes]:
        """Of the n-th document."""
        return zstandard.ZstdDecompressor().decompress(self.packed[int(self.order[n])].as_py(), max_output_size=(1 << 31) - 1).split()

    def flagged(self, later: np.ndarray) -> np.ndarray:
        """The places whose window a smaller doc_id has; later: the distinct windows that one of another chunk has."""
        out = np.empty(len(self.places), bool)
        each = np.diff(np.r_[self.starts, len(self.places)])
        own = np.repeat(self.ids, self.sizes)[self.places]
        out[self.places] = np.repeat(later, each) | (np.repeat(self.first_id, each) < own)
        return out


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, each by ascending place, and where each distinct pair starts in it."""
    def differ(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = one[order], two[order]
        return a[1:] != a[:-1], b[1:] != b[:-1]

    order = np.argsort(one, kind="stable").astype(np.int32)
    a, b = differ(order)
    if (b & ~a).any():  # equal first hashes of different windows
        order = np.lexsort((two, one)).astype(np.int32)
        a, b = differ(order)
    return order, np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), a | b]).astype(np.int32)


def _send(k: int, buckets: int):
    """For each bucket a blob: the number of owners, the owners, the number of each one's windows, and the windows' two hashes."""

    def run(table: pa.Table) -> pa.Table:
        give_back()  # of the chunk before
        c = _Chunk(table, k, buckets)
        chunk, rows, short = table.column("chunk")[0].as_py(), [], (c.two >> U(48)).astype(np.uint16)
        for b in np.flatnonzero(np.diff(c.edges)).tolist():
            at = c.by_bucket[c.edges[b] : c.edges[b + 1]]
            owners = c.first_id[at]
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            runs = np.diff(np.r_[starts, len(at)]).astype(np.uint32)
            rows.append((b, chunk, np.uint32(len(starts)).tobytes() + owners[starts].tobytes() + runs.tobytes() + c.one[at].tobytes() + short[at].tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, _SENT.types, strict=True)], schema=_SENT)

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a blob the owner and the two hashes."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    owners, runs = np.frombuffer(blob, np.int64, n, 4), np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    total, at = int(runs.sum()), 4 + 12 * n
    return np.repeat(owners, runs), np.frombuffer(blob, U, total, at), np.frombuffer(blob, np.uint16, total, at + 8 * total)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("places", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk the places in its blob whose window a smaller doc_id of another chunk has."""
    owners, one, two = zip(*(_unpacked(x.as_py()) for x in table.column("blob")), strict=True)
    edges, d = np.cumsum([0, *map(len, one)]), np.concatenate(owners)
    order, starts = _grouped(np.concatenate(one), np.concatenate(two))
    least = np.minimum.reduceat(d[order], starts)
    later = np.empty(len(d), bool)
    later[order] = np.repeat(least, np.diff(np.r_[starts, len(order)])) < d[order]
    bucket, rows = table.column("bucket")[0].as_py(), []
    for chunk, a, b in zip(table.column("chunk").to_pylist(), edges, edges[1:]):
        places = np.flatnonzero(later[a:b])
        if len(places):
            rows.append((chunk, bucket, places.astype(np.uint32).tobytes()))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, _ANSWER.types, strict=True)], schema=_ANSWER)


def _intervals(flagged: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that the flagged windows of one document cover; the ends are exclusive."""
    at = np.flatnonzero(flagged)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > k)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + k).tolist()))


def _remove(k: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _DONE.empty_table()
        give_back()
        c = _Chunk(table, k, buckets)
        later = np.zeros(len(c.first), bool)
        for b, places in zip(answers.column("bucket").to_pylist(), answers.column("places").to_pylist(), strict=True):
            later[c.by_bucket[c.edges[b] : c.edges[b + 1]][np.frombuffer(places, np.uint32)]] = True
        flagged, rows, at = c.flagged(later), [], 0
        for n, (i, size) in enumerate(zip(c.ids.tolist(), c.sizes.tolist(), strict=True)):
            words, cuts = c.words(n), _intervals(flagged[at : at + size], k)
            at += size
            kept, last = [], 0
            for a, b in cuts:
                kept += words[last:a]
                last = b
            kept = kept + words[last:] if cuts else words
            rows.append((None if i == _NULL_ID else i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in cuts]))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _DONE.types, strict=True)], schema=_DONE)

    return run


_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def removals(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (intervals of word numbers, ends exclusive) of every row."""
    chunks = buckets = parts(docs.select("doc_id", "text"), _PART_BYTES)
    packed = _packed(docs, chunks)
    sent = packed.groupBy("chunk").applyInArrow(_send(k, buckets), "bucket int, chunk int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, places binary")
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(k, buckets), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>")
