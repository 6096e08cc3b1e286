"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Texts and items are lower-cased sequences of words, ASCII and CJK punctuation read as white space; in scripts that set no spaces each
character is a word. A document holds an item if some run of
its words is within an edit distance (insertions, deletions, substitutions of words) of at most a share of the item's length. Items under MIN_WORDS words are held only
by documents that have them word for word: the hash of the whole item is looked up at every word.

The CGK embedding walks over a word sequence: step j copies the word at the pointer and moves on if the random bit of (j, word) is
set. Two walks with the same bits fall into step again after an edit, so that a small edit distance becomes a small Hamming
distance between the copies. The longer a walk, the less often it is in step: so an item is cut into parts of SEGMENT to 2 SEGMENT - 1 words (a shorter item
is one part), one of which has no more than its share of the item's edits, by the pigeonhole principle. Windows of the size of a part start at every word of a
document; a key is the copies at SAMPLED random steps of one of WALKS walks, and a window that agrees with a part in any of KEYS keys is a candidate. A leak
with all the edits that are allowed, spread at random, has a key in common with its item in 0.99 of cases or more at every length and number of items (measured in the
tests), an exact copy always, and so does what has fewer edits nearly always.

Before any walk, windows are ruled out by the q-gram lemma, which loses nothing: k edits leave at least L - 1 - 2 k of the
L - 1 word pairs of a part, so a window with fewer pairs that occur in any item can hold none; nor can a candidate with fewer pairs, first of any and then
of its own item. What is left is verified exactly, with free ends in the document.

Items are held in memory in blocks of about ITEM_BYTES, one at a time; each block is one pass over the documents, without any shuffle, whose result is written
if there are several.

Edge cases: null and empty texts hold nothing; items without words are held by nothing; an item with
repeated rows gives a row for each of them, as a repeated document does; of several places in one document the closest,
then first, is reported; an empty table gives an empty result; other columns are ignored. A text is read whole whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, id_and_text, kept, small_batches
from .words import BASE, U, hashes, mix, windows

#: A quarter of an item's words may be edited, none of an item under MIN_WORDS.
SHARE, MIN_WORDS = 0.25, 8
SEGMENT, WALKS, SAMPLED, KEYS = 16, 16, 3, 64
ITEM_BYTES = 16 << 20
_PIECE, _FLAT, _WINDOWS, _COPIES, _HITS = 1 << 20, 400_000, 20_000, 2_000_000, 1_000_000
_BLANK = bytes(32 if c < 33 or c == 127 or c < 127 and not chr(c).isalnum() else c for c in range(256))
_END = U(0x5851F42D4C957F2D)
#: Thai, Lao, Myanmar, Khmer, kana, Han; and the punctuation between them.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af]")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def _spaced(text: str) -> str:
    return text if text.isascii() else _UNSPACED.sub(r" \g<0> ", _MARKS.sub(" ", text))


def words(text: str) -> np.ndarray:
    """The hashes of a text's words, a piece of the text at a time."""
    found, at = [], 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end] not in " \t\n\r":
            end += 1
        found.append(hashes(_spaced(text[at:end]).lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()))
        at = end
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, U)


def allowed(length: np.ndarray | int, share: float):
    """The most edits for an item of so many words."""
    length = np.asarray(length)
    return np.where(length < MIN_WORDS, 0, np.floor(length * share + 1e-9)).astype(np.int64)


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * BASE + h[1:])


class Known:
    """Hashes as a bitmap of their first bits: what is not set is not among them."""

    def __init__(self, h: np.ndarray):
        bits = max(20, int(len(h) * 32).bit_length())
        self.shift, self.set = U(64 - bits), np.zeros(1 << bits, bool)
        self.set[(h >> self.shift).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.set[(h >> self.shift).astype(np.int64)]


class Parts(NamedTuple):
    """Parts of items of about one length: the words of the longest, the edits allowed to it and the fewest pairs that any of them keeps;
    the steps that keys sample (none: a key is the hash of all words); the keys, ascending, the item of each and the part's place there."""

    size: int
    edits: int
    pairs: int
    steps: np.ndarray | None
    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray


def cgk_keys(flat: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(keys, windows): the LSH keys of the walks that start there; key i samples its steps of walk i % WALKS."""
    last, end = int(steps.max()) + 1, len(flat) - 1
    walks = np.arange(WALKS, dtype=U)[:, None]
    copies, at = np.empty((last, WALKS, len(starts)), U), np.tile(starts, (WALKS, 1))
    for j in range(last):
        word = copies[j] = flat[np.minimum(at, end)]
        if not j % 64:
            seed = mix((walks << U(32)) + U(j + 1))
        at += ((mix(word ^ seed) >> U(j % 64)) & U(1)).astype(np.int64)
    out = np.empty((len(steps), len(starts)), U)
    for i, sampled in enumerate(steps):
        key = np.full(len(starts), U(i), U)
        for j in sampled:
            key = key * BASE + copies[j, i % WALKS]
        out[i] = mix(key)
    return out


class Index:
    def __init__(self, items: list[np.ndarray], share: float, seed: int = 11):
        self.items = items
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.edits = allowed(self.sizes, share)
        usable = np.flatnonzero(self.sizes)
        self.known = Known(np.concatenate([pairs(items[i]) for i in usable])) if len(usable) else None
        short: dict[int, list[tuple[int, int, int, int]]] = {}
        cut: list[tuple[int, int, int, int]] = []  # words and edits of a part, item, place
        for i in usable.tolist():
            size = int(self.sizes[i])
            if size < MIN_WORDS:
                short.setdefault(size, []).append((size, 0, i, 0))
                continue
            n = max(1, size // SEGMENT)
            bounds = (np.arange(n + 1) * size // n).tolist()
            cut += [(b - a, int(self.edits[i]) // n, i, a) for a, b in zip(bounds, bounds[1:])]
        self.parts = [self._parts(members, None) for members in short.values()]
        cut.sort()
        rng, at = np.random.default_rng(seed), 0
        while at < len(cut):
            end = at
            while end < len(cut) and cut[end][0] <= cut[at][0] * 1.15:
                end += 1
            self.parts.append(self._parts(cut[at:end], np.sort(rng.random((KEYS, max(SAMPLED, cut[at][0]))).argsort(axis=1)[:, :SAMPLED], axis=1)))
            at = end

    def _parts(self, members: list[tuple[int, int, int, int]], steps: np.ndarray | None) -> Parts:
        sizes, edits, items, places = (np.array(c, np.int64) for c in zip(*members, strict=True))
        words = [self.items[i][a : a + n] for n, _, i, a in members]
        if steps is None:
            keys = np.array([windows(w, len(w))[0] for w in words], U)
        else:
            ended = [np.r_[w, np.full(int(steps.max()) + 1, _END)] for w in words]
            keys = cgk_keys(np.concatenate(ended), np.cumsum([0, *map(len, ended[:-1])]), steps).ravel()
            items, places = np.tile(items, len(steps)), np.tile(places, len(steps))
        order = np.argsort(keys, kind="stable")
        return Parts(int(sizes.max()), int(edits.max()), int((sizes - 1 - 2 * edits).min()), steps, keys[order], items[order], places[order])

    def _looked_up(self, flat: np.ndarray, edges: np.ndarray, present: np.ndarray, parts: Parts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window starts, places in parts.keys) that share a key, some at a time."""
        at = np.arange(len(flat))
        if parts.steps is None:
            starts = np.flatnonzero(at + parts.size <= edges[np.searchsorted(edges, at, "right")])
        else:
            ends = np.minimum(at[:-1] + parts.size + parts.edits - 1, len(flat) - 1)
            starts = np.flatnonzero(present[ends] - present[:-1] >= parts.pairs)
        whole = windows(flat, parts.size) if parts.steps is None else None
        some = _WINDOWS if parts.steps is None else max(16, min(_WINDOWS, _COPIES // (parts.size * WALKS)))
        for i in range(0, len(starts), some):
            now = starts[i : i + some]
            keys = (whole[now] if whole is not None else cgk_keys(flat, now, parts.steps)).ravel()
            first = np.searchsorted(parts.keys, keys, "left")
            n = np.searchsorted(parts.keys, keys, "right") - first
            hit = np.flatnonzero(n)
            cut = np.flatnonzero(np.diff(np.cumsum(n[hit]) // _HITS)) + 1  # so many hits at a time
            for h in np.split(hit, cut) if len(hit) else []:
                m = n[h]
                yield np.repeat(now[h % len(now)], m), np.repeat(first[h], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)

    def candidates(self, flat: np.ndarray, edges: np.ndarray, present: np.ndarray) -> np.ndarray:
        """(document, item, start): where a part of the item may be, and around it enough pairs of any item; the start is that of the item if
        nothing before the part is edited. present: running sum over pairs of items, with a 0 before."""
        found = [np.empty((0, 3), np.int64)]
        for parts in self.parts:
            for at, place in self._looked_up(flat, edges, present, parts):
                item, doc = parts.items[place], np.searchsorted(edges, at, "right") - 1
                start = at - parts.places[place]
                k, size = self.edits[item], self.sizes[item]
                low, high = np.maximum(edges[doc], start - 2 * k), np.minimum(edges[doc + 1], start + size + 3 * k)
                good = (high > low) & (present[np.maximum(high - 1, low)] - present[low] >= size - 1 - 2 * k)
                found.append(np.unique(np.stack([doc, item, start], axis=1)[good], axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def with_own_pairs(self, jobs: list[tuple[int, int, int, int]], flat: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The (document, item, from, to) where enough pairs are those of the item itself."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for job in jobs:
            by.setdefault(job[1], []).append(job)
        out, there = [], pairs(flat)
        for i, own in by.items():
            known, least = np.unique(pairs(self.items[i])), self.sizes[i] - 1 - 2 * self.edits[i]
            if least <= 0:
                out += own
                continue
            for n in range(0, len(own), 512):
                some = own[n : n + 512]
                a, b = (np.array([job[c] for job in some]) for c in (2, 3))
                at = a[:, None] + np.arange(max(1, (b - a).max() - 1))
                h = there[np.minimum(at, len(there) - 1)]
                same = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                enough = (same & (at < b[:, None] - 1)).sum(axis=1) >= least
                out += [job for job, good in zip(some, enough, strict=True) if good]
        return out

    def search(self, flat: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) for the documents flat[edges[i]:edges[i + 1]]; the places count from the document's start."""
        if not len(flat) or not self.parts:
            return []
        there = self.known(pairs(flat))
        inner = edges[1:-1]
        there[inner[(inner > 0) & (inner < len(flat))] - 1] = False
        jobs, last = [], None
        for d, i, s in self.candidates(flat, edges, np.r_[0, np.cumsum(there, dtype=np.int32)]).tolist():
            k = int(self.edits[i])
            if last is not None and last[:2] == (d, i) and s <= last[2] + k:
                continue
            last = (d, i, s)
            jobs.append((d, i, max(int(edges[d]), s - 2 * k), min(int(edges[d + 1]), s + int(self.sizes[i]) + 4 * k)))
        jobs = self.with_own_pairs(jobs, flat)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (d, i, a, _), (dist, start, end) in zip(jobs, verify(flat, [(self.items[i], a, b) for _, i, a, b in jobs]), strict=True):
            if dist <= self.edits[i]:
                new = (dist, a + start - int(edges[d]), a + end - int(edges[d]))
                best[d, i] = min(best.get((d, i), new), new)
        return [(d, i, *x) for (d, i), x in sorted(best.items())]


def _rows(items: np.ndarray, texts: np.ndarray, free: bool) -> np.ndarray:
    """The last row of the edit matrix of each item (a row, padded with zeros at the end of shorter ones by the caller) and text."""
    n, t = texts.shape
    column = np.arange(t + 1, dtype=np.int32)
    row = np.zeros((n, t + 1), np.int32) if free else np.tile(column, (n, 1))
    for i in range(items.shape[1]):
        step = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != items[:, i : i + 1]))
        step = np.concatenate([row[:, :1] + 1, step], axis=1)
        row = np.minimum.accumulate(step - column, axis=1) + column
    return row


def verify(flat: np.ndarray, jobs: list[tuple[np.ndarray, int, int]]) -> list[tuple[int, int, int]]:
    """For each (item, a, b): the least edit distance of the item to a run of words in flat[a:b], and the run's start and end in it.

    Of equally close runs the one that ends first is taken, then the shortest."""
    out: list = [None] * len(jobs)
    by: dict[int, list[int]] = {}
    for n, (item, _, _) in enumerate(jobs):
        by.setdefault(len(item), []).append(n)
    for size, members in by.items():
        for i in range(0, len(members), 512):
            some = members[i : i + 512]
            width = max(jobs[n][2] - jobs[n][1] for n in some)
            texts = np.full((len(some), width), _END)
            for r, n in enumerate(some):
                texts[r, : jobs[n][2] - jobs[n][1]] = flat[jobs[n][1] : jobs[n][2]]
            items = np.stack([jobs[n][0] for n in some])
            last = _rows(items, texts, True)
            ends = last.argmin(axis=1)
            far = int(ends.max())
            back = np.full((len(some), far), _END)
            for r, e in enumerate(ends):
                back[r, :e] = texts[r, :e][::-1]
            lengths = _rows(items[:, ::-1], back, False)
            for r, n in enumerate(some):
                e, d = int(ends[r]), int(last[r].min())
                out[n] = d, e - int(np.flatnonzero(lengths[r, : e + 1] == d)[0]), e
    return out


def _index(texts: tuple[str, ...], share: float) -> Index:
    return kept(("leaks", texts, share), lambda: Index([words(t) for t in texts], share))


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_words", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def _searched(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, start, end) for the texts of a batch, about _FLAT words at a time."""
    at, flat, size = 0, [], 0
    for row, t in enumerate(texts):
        flat.append(words(t.as_py() or ""))
        size += len(flat[-1])
        if size >= _FLAT or row == len(texts) - 1:
            for d, *x in index.search(np.concatenate(flat), np.cumsum([0, *map(len, flat)])):
                yield (at + d, *x)
            at, flat, size = row + 1, [], 0


def _scan(docs: DataFrame, ids: list, texts: tuple[str, ...], share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(texts, share)
        for b in batches:
            who = b.column(0).to_pylist()
            rows = [(who[r], ids[i], dist, int(index.sizes[i]), start, end) for r, i, dist, start, end in _searched(b.column(1), index)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)], schema=_FOUND)
            del b, rows
        give_back()

    return id_and_text(small_batches(docs)).mapInArrow(run, "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long")


def _item_blocks(benchmark: DataFrame) -> tuple[int, Iterator[tuple[list, tuple[str, ...]]]]:
    """How many blocks of about ITEM_BYTES the items make, and the ids and texts of each, collected one after another."""
    items = id_and_text(benchmark, "item_id").where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // ITEM_BYTES)

    def each() -> Iterator[tuple[list, tuple[str, ...]]]:
        for n in range(blocks):
            some = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).orderBy("item_id", "text").collect()  # about ITEM_BYTES
            yield [r["item_id"] for r in some], tuple(r["text"] for r in some)

    return blocks, each()


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, distance, item_words, start_word, end_word (exclusive): the items that each document holds."""
    blocks, each = _item_blocks(benchmark)
    passes = [found if blocks == 1 else checkpointed(found) for ids, texts in each for found in [_scan(docs, ids, texts, share)]]  # of several blocks the driver holds one
    if not passes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long")
    return reduce(DataFrame.unionByName, passes)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, all their columns unchanged."""
    blocks, each = _item_blocks(benchmark)
    for _, texts in each:

        def run(batches: Iterator[pa.RecordBatch], texts: tuple[str, ...] = texts) -> Iterator[pa.RecordBatch]:
            index = _index(texts, share)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in _searched(b.column(b.schema.get_field_index(text_col)), index)]] = False
                yield b.filter(pa.array(keep))
                del b
            give_back()

        docs = small_batches(docs).mapInArrow(run, docs.schema)
        docs = docs if blocks == 1 else checkpointed(docs)
    return docs
