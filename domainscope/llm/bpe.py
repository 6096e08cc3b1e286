"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

Pieces are cut by a pre-tokenisation pattern; inside a piece the adjacent pair of lowest rank merges first, the
leftmost of equals. The queue has one bucket for each merge rank; a three-level bitmap over the ranks gives the next
rank by find-first-set. Buckets hold positions of a doubly linked list of parts. An entry whose part is gone or whose
pair has another rank by now is stale and skipped, so nothing is ever deleted from the middle of a bucket. A piece of
n bytes takes O(n log n) steps whatever its length, so a single run of a million letters is no special case.

One queue serves many pieces: the pieces of a group of texts that aren't remembered lie behind one another, with a barrier
after each that no pair reaches over. Merges in different pieces don't touch, so that the lowest rank of all is the lowest of its
piece, too, and a rank's bits are set and found once for all pieces; a bucket's merges are made together, as array operations, up to the first in each
piece after which a lower rank would be next. Texts are read GROUP characters at a time or so; what is
held beside a text and its ids doesn't grow with either.

Remembered pieces have their ids as packed bytes, so that the ids of a text are one join. The memory has two generations: a piece met again is moved to the
new one, and what hasn't been met since the last turn goes. Texts have more different pieces than fit, of which a few are most of the text; they stay.

Edge cases: null text is empty; an empty text gives no ids, the digest of the empty string, and decodes to b"".
Repeated rows each get their own result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import file_bytes, id_and_text, kept, map_rows


class RankQueue:
    """Buckets of positions by merge rank, and a bitmap of three levels over the ranks whose bucket is open."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position to the bucket of its rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:], strict=False):
            self.push(r, positions[a:b])

    def take(self) -> tuple[int, np.ndarray]:
        """The lowest open rank and its positions, ascending, each once; its bucket is closed."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        rank = (b << 6) + (word & -word).bit_length() - 1
        self.low[b] = word & (word - 1)
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        if len(bucket) == 1:  # pushed at once: ascending, each once
            return rank, bucket[0]
        positions = np.sort(np.concatenate(bucket))
        fresh = np.ones(len(positions), bool)
        np.not_equal(positions[1:], positions[:-1], out=fresh[1:])
        return rank, positions[fresh]


class ByteBpe:
    """ranks: token bytes to id, where the id is the merge rank. pattern cuts a text into pieces."""

    #: Pieces up to so many characters are remembered, about KEEP of them at most, in two generations.
    SHORT, KEEP = 24, 300_000
    #: Characters of the texts that are encoded together.
    GROUP = 4 << 20
    #: Bytes of the pieces that share a queue, but for a piece of more.
    QUEUED = 1 << 20
    _NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes((a,)), self._NONE) for a in range(256)], np.int32)
        get = ranks.get
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        left, right, merged = np.array(pairs, np.int32).reshape(-1, 3).T
        #: Of each two tokens that make one: the other's id and the rank, by the one on the left and by the one on the right.
        self.by_left, self.by_right = self._index(left, right, merged), self._index(right, left, merged)
        #: The rank of each two bytes.
        self.byte_ranks = np.array([get(bytes((a, b)), self._NONE) for a in range(256) for b in range(256)], np.int32)
        #: The ids of pieces, four bytes each: those met since ``older`` was closed, and those of the time before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def from_bytes(cls, data: bytes, pattern: str) -> ByteBpe:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        return cls(ranks, pattern)

    def _index(self, one: np.ndarray, other: np.ndarray, merged: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        order = np.lexsort((other, one))
        return np.searchsorted(one[order], np.arange(self.size + 1)).tolist(), other[order], merged[order]

    def _rank_of(self, index: tuple[list[int], np.ndarray, np.ndarray], one: int, others: np.ndarray) -> np.ndarray:
        """The rank of token one beside each of the others."""
        starts, ids, merged = index
        a, b = starts[one], starts[one + 1]
        if a == b:
            return np.full(len(others), self._NONE, np.int32)
        ids = ids[a:b]
        at = ids.searchsorted(others)
        np.minimum(at, b - a - 1, out=at)
        return np.where(ids[at] == others, merged[a:b][at], self._NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, by one queue for all of them."""
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        n, barriers = len(data), np.cumsum([len(p) + 1 for p in pieces]) - 1
        none, queue = self._NONE, self.queue
        token, alive = self.byte_ids[data], np.ones(n, bool)
        token[barriers] = self.size  # a barrier is a token that makes none with any other
        alive[barriers] = False
        if (token == none).any():
            raise ValueError("the vocabulary lacks a byte")
        now = np.full(n, none, np.int32)  # the rank of the pair that starts here
        now[:-1] = self.byte_ranks[data[:-1] * np.int32(256) + data[1:]]
        now[barriers] = now[barriers - 1] = none
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # the last slot is a barrier, and so is the one before the first
        start = np.flatnonzero(now != none).astype(np.int32)
        if len(start):
            queue.push_all(now[start], start)
        del start, data
        while queue.top:
            rank, at = queue.take()
            at = at[now[at] == rank]
            if not len(at):
                continue
            second = after[at]
            if len(at) > 1 and (touching := second[:-1] == at[1:]).any():  # in a run of overlapping pairs every second is left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(np.r_[True, ~touching], place, 0))) % 2 == 0]
                second = after[at]
            right, left = after[second], before[at]
            left_token = token[left]
            if len(at) > 1 and (follows := right[:-1] == at[1:]).any():
                left[1:][follows] = at[:-1][follows]
                left_token[1:][follows] = rank
            rank_right, rank_left = self._rank_of(self.by_left, rank, token[right]), self._rank_of(self.by_right, rank, left_token)
            if (lower := np.minimum(rank_right, rank_left) < rank).any():  # in these pieces another rank is next after the first such merge
                piece = np.searchsorted(barriers, at)
                seen = np.cumsum(lower) - lower
                first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                stay = seen == np.repeat(seen[first], np.diff(np.r_[first, len(at)]))
                if not stay.all():
                    queue.push(rank, at[~stay])
                    at, second, right, left, rank_right, rank_left = (x[stay] for x in (at, second, right, left, rank_right, rank_left))
            token[at] = rank
            now[second] = none
            alive[second] = False
            after[at] = right
            before[right] = at
            now[at] = rank_right
            now[left] = rank_left  # none at a barrier
            for ranks, places in ((rank_right, at), (rank_left, left)):
                if len(open_ := np.flatnonzero(ranks != none)):
                    queue.push_all(ranks[open_], places[open_])
        ids = token[alive].tolist()
        ends = np.cumsum(np.add.reduceat(alive, np.r_[0, barriers[:-1] + 1], dtype=np.int64)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Has the ids of all these pieces, none of which is known, in ``known``."""
        queued, known, rank_of = [], self.known, self.ranks.get
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            if (whole := rank_of(b)) is not None:
                known[p] = array("i", (whole,)).tobytes()
            else:
                queued.append((p, b))
        while queued:
            size, n = 0, 0
            while n < len(queued) and (not n or size + len(queued[n][1]) <= self.QUEUED):
                size += len(queued[n][1])
                n += 1
            some, queued = queued[:n], queued[n:]
            known.update((p, array("i", ids).tobytes()) for (p, _), ids in zip(some, self.merge([b for _, b in some]), strict=True))

    def forget(self, pieces: Iterable[str]) -> None:
        """Long pieces, and if there are many the generation before: what hasn't been met since it was closed."""
        for p in pieces:
            if len(p) > self.SHORT:
                del self.known[p]
        if len(self.known) > self.KEEP // 2:
            self.known, self.older = {}, self.known

    def _all_ids(self, cut: Iterable[list[str]]) -> list[np.ndarray]:
        """The ids of texts that are cut into pieces. A text's pieces are looked up while they are at hand, and only the unknown are held, each once."""
        known, older, texts, new = self.known, self.older.get, [], {}
        for pieces in cut:
            found, holes = list(map(known.get, pieces)), []
            for i, ids in enumerate(found):
                if ids is None:
                    if (ids := older(p := pieces[i])) is not None:
                        known[p] = found[i] = ids
                    else:
                        found[i] = new.setdefault(p, p)
                        holes.append(i)
            texts.append((found, array("q", holes)))
        self.learn(new)
        for found, holes in texts:
            for i in holes:
                found[i] = known[found[i]]
        self.forget(new)
        return [np.frombuffer(b"".join(found), np.int32) for found, _ in texts]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of some texts, which are held together."""
        return self._all_ids(map(self.pattern.findall, texts))

    def encode_long(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text of any length, some pieces at a time."""
        found = (m.group() for m in self.pattern.finditer(text))
        while cut := list(islice(found, 1 + self.GROUP // 8)):
            yield self._all_ids([cut])[0]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x.tolist() for x in (self.encode_all([text]) if len(text) <= self.GROUP else self.encode_long(text))))

    def groups(self, rows: Iterable[tuple[object, str]]) -> Iterator[tuple[object, Iterable[np.ndarray]]]:
        """(key, its ids in one or more arrays) of (key, text) rows, in their order."""
        some, size = [], 0
        for key, text in rows:
            if size + len(text) > self.GROUP and some:
                yield from zip((k for k, _ in some), ([x] for x in self.encode_all([t for _, t in some])), strict=True)
                some, size = [], 0
            if len(text) > self.GROUP:
                yield key, self.encode_long(text)
            else:
                some.append((key, text))
                size += len(text)
        if some:
            yield from zip((k for k, _ in some), ([x] for x in self.encode_all([t for _, t in some])), strict=True)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def joined(parts: Iterable[np.ndarray]) -> np.ndarray:
    parts = list(parts)
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])


def _codec(data: bytes, pattern: str, small: bool = False) -> tuple[ByteBpe, dict[int, str]]:
    """small: for operators that return ids, which hold those of many rows beside a group."""

    def make():
        codec = ByteBpe.from_bytes(data, pattern)
        if small:
            codec.GROUP //= 2
        return codec, {i: str(i) for i in codec.tokens}

    return kept(("bpe", data, pattern, small), make)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every text."""
    data = file_bytes(path)

    def make():
        codec, _ = _codec(data, pattern, small=True)
        return lambda rows: ((d, joined(parts)) for d, parts in codec.groups(rows))

    return map_rows(id_and_text(docs), make, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), rows=200)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every list of ids; bytes that are no UTF-8 become U+FFFD."""
    data = file_bytes(path)

    def make():
        codec, _ = _codec(data, pattern)
        return lambda rows: ((d, codec.decode(ids or ()).decode("utf-8", "replace")) for d, ids in rows)

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, decodes the ids again, in one pass."""
    data = file_bytes(path)

    def make():
        codec, names = _codec(data, pattern)
        name = names.__getitem__

        def work(rows) -> Iterator[tuple]:
            for d, parts in codec.groups(rows):
                n, told, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in map(np.ndarray.tolist, parts):
                    told.update((("," if n and ids else "") + ",".join(map(name, ids))).encode())
                    decoded.update(codec.decode(ids))
                    n += len(ids)
                yield d, n, told.hexdigest(), decoded.hexdigest()

        return work

    return map_rows(
        id_and_text(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    )


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded_sha256 of every text."""
    data = file_bytes(path)

    def make():
        codec, _ = _codec(data, pattern, small=True)
        return lambda rows: ((d, len(ids), ids, hashlib.sha256(codec.decode(ids.tolist())).hexdigest()) for d, parts in codec.groups(rows) for ids in [joined(parts)])

    return map_rows(
        id_and_text(docs), make, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string",
        pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]), rows=200,
    )
