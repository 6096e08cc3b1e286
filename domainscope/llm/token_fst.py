"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A text is a string of characters with a space before it (the model's dummy prefix). The transducer's state after a
prefix holds what the future can depend on: the longest suffix that still begins some piece, and for each position in
it the last token of the encoding up to there with its count. Reading a character moves to one next state and emits
the change of the token count, which may be negative when tokens fuse. That is exact because an encoding is valid if
and only if each neighbouring pair of its tokens is left alone by the merges, so that the last token of each prefix
follows from those of the shorter ones. All states on the way through every piece of the vocabulary are compiled ahead, when a worker
loads it; those beyond, of which there is no small bound, are compiled when a text first reaches them and kept by content (a table that is full is
compiled anew).

No piece has a space after another character, so every space after a non-space is a reset: what follows is read from the start
state, and the emitted count of a whole word is remembered. A text is cut into chunks of CHUNK characters, wherever that is. A chunk's map takes
any incoming state to the state after it and the count it emits: its head up to the first reset depends on the state that comes in, the
rest is fixed. Such maps compose associatively, so that a prefix scan combines them in a logarithmic number of rounds of
independent compositions; the last prefix, applied to the start state, is the text's count, and the others are those at the chunks' ends.

Edge cases: null text is empty; an empty text has 0 tokens; repeated rows count each; an empty table gives an empty
result; other columns are ignored; a text's length is not limited, and one without any space is one long head, walked once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_bytes, kept, map_rows

State = tuple[str, tuple[tuple[str, int], ...]]


class Map:
    """What a stretch of text does to a state: it reads head (a string, or two maps one after the other) from it, and after that, if there is
    a reset, ends in a state that is known, with a count that is. ``known`` holds where states have been found to go."""

    __slots__ = ("head", "count", "end", "known")

    def __init__(self, head: str | tuple[Map, Map], count: int = 0, end: State | None = None):
        self.head, self.count, self.end = head, count, end
        self.known: dict[State, tuple[State, int]] = {}


_RESET = re.compile(r"(?<=[^ ]) ")
_WORD = re.compile(r" *[^ ]+| +")


class Transducer:
    """pieces: (text with U+2581 for a space, score); the highest score merges first, the leftmost of equals."""

    STATES, WORDS, CHUNK = 300_000, 400_000, 4096

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        order = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.ranks = {p.replace("▁", " "): order[s] for p, s in pieces}
        self.none = len(order)
        if any(re.search("[^ ] ", p) for p in self.ranks):
            raise ValueError("a piece has a space after another character: words are no resets")
        self.valid = {p for p in self.ranks if len(p) == 1 or self.merge(p) == [p]}
        self.starts = {p[:n] for p in self.valid for n in range(1, len(p))}
        self.longest = max(map(len, self.ranks), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.compile()

    def compile(self) -> None:
        """The states on the way through every piece, from the start of a word and after its space."""
        #: A state: (suffix, for each position from its start to its end: (last token, its count less the end's)).
        self.states: list[State] = [("", (("", 0),))]
        self.ids = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        for p in sorted(self.valid):
            self._read(0, p if p[0] == " " else " " + p)
        self.compiled = len(self.states)

    def state(self, content: State) -> int:
        if (i := self.ids.get(content)) is None:
            i = self.ids[content] = len(self.states)
            self.states.append(content)
            self.moves.append({})
        return i

    def merge(self, s: str) -> list[str]:
        """The merges carried out one by one: the definition that states are compiled from."""
        get, none, at = self.ranks.get, self.none, list(range(len(s) + 1))
        now = [get(s[i : i + 2], none) for i in range(len(s) - 1)]
        while now and (r := min(now)) != none:
            i = now.index(r)
            del at[i + 1], now[i]
            if i < len(now):
                now[i] = get(s[at[i] : at[i + 2]], none)
            if i:
                now[i - 1] = get(s[at[i - 1] : at[i + 1]], none)
        return [s[a:b] for a, b in zip(at, at[1:])]

    def fits(self, a: str, b: str) -> bool:
        """Whether the merges leave the tokens a and b alone when they stand together."""
        if not a:
            return True
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.WORDS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def step(self, state: int, c: str) -> tuple[int, int]:
        suffix, last = self.states[state]
        if c not in self.valid:
            return 0, len(c.encode("utf-8", "surrogatepass"))  # one token for each byte; no piece reaches over it
        grown = suffix + c
        for n in range(min(len(grown), self.longest), 0, -1):
            token = grown[-n:]
            if token in self.valid and self.fits(last[len(last) - n][0], token):
                break
        else:
            raise AssertionError("no token fits: the vocabulary is no proper BPE vocabulary")
        delta = last[len(last) - n][1] + 1
        last = (*((t, k - delta) for t, k in last), (token, 0))
        while grown and grown not in self.starts:
            grown, last = grown[1:], last[1:]
        new = (grown, last[-len(grown) - 1 :])
        move = self.moves[state][c] = self.state(new), delta
        return move

    def _read(self, state: int, s: str) -> tuple[int, int]:
        total, moves = 0, self.moves
        for c in s:
            state, delta = moves[state].get(c) or self.step(state, c)
            total += delta
        return state, total

    def walk(self, state: State, s: str) -> tuple[State, int]:
        """The state after s, and the change of the count."""
        total = 0
        for i in range(0, len(s), 100_000):  # a stretch adds no more states than characters
            if len(self.states) > self.STATES:
                self.compile()
            at, n = self._read(self.state(state), s[i : i + 100_000])
            state, total = self.states[at], total + n
        return state, total

    def of_words(self, s: str) -> int:
        """The tokens of s from the start state, by whole words."""
        total, known = 0, self.words
        for word in _WORD.findall(s):
            if (n := known.get(word)) is None:
                n = self.walk(self.states[0], word)[1]
                if len(word) <= 40:
                    if len(known) >= self.WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def chunk(self, s: str) -> Map:
        """The map of a chunk."""
        first = _RESET.search(s)
        if first is None:
            return Map(s)
        cut = s.rfind(" ")
        while cut > first.start() and s[cut - 1] == " ":
            cut -= 1
        cut = max(cut, first.start())
        end, n = self.walk(self.states[0], s[cut:])
        return Map(s[: first.start()], n + self.of_words(s[first.start() : cut]), end)

    def apply(self, m: Map, state: State) -> tuple[State, int]:
        if (found := m.known.get(state)) is None:
            if isinstance(m.head, str):
                at, n = self.walk(state, m.head)
            else:
                at, n = self.apply(m.head[0], state)
                at, more = self.apply(m.head[1], at)
                n += more
            found = m.known[state] = (at, n) if m.end is None else (m.end, n + m.count)
        return found

    def compose(self, a: Map, b: Map) -> Map:
        """First a, then b."""
        if a.end is None:
            return Map((a, b if b.end is None else Map(b.head)), b.count, b.end)
        end, n = self.apply(b, a.end)
        return Map(a.head, a.count + n, end)

    def scan(self, maps: list[Map]) -> list[Map]:
        """Prefix compositions of the maps: each round composes with the one 1, 2, 4, ... places before."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        if not text:
            return 0
        s = " " + text.replace("▁", " ")
        return self.apply(self.scan([self.chunk(s[i : i + self.CHUNK]) for i in range(0, len(s), self.CHUNK)])[-1], self.states[0])[1]


def load(path: str) -> tuple[tuple[str, float], ...]:
    """The normal pieces of a sentencepiece BPE model with byte fallback, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=file_bytes(path))
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))


def _transducer(pieces: tuple) -> Transducer:
    return kept(("tokens", pieces), lambda: Transducer(pieces))


def counts(docs: DataFrame, pieces: tuple, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def make():
        t = _transducer(pieces)
        return lambda rows: ((d, n, k := t.count(s), k > limit) for d, s, n in rows)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n")), make,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
        pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]),
    )
