r"""Chat formatting with loss masks found by incremental rendering.

A template is a black box: a function from a list of (role, text) to a string. The renderer is called on the first 0,
1, 2, ... turns; where one output begins with the one before, what was added is the span of the newest turn, and where
it does not, the template rewrites history: the turn at which this first happens is reported, and spans are then only
what follows the longest common prefix. Within an assistant's span, the loss covers the text itself: its place is found
by rendering the turn once more with a probe in its place.

The template of this module marks turns with `[INST] ... [/INST]`, `... </s>`, and `[SYS] ... [/SYS]`, any other role by
its name. Inside texts and role names a backslash follows each `[`, `]`, `<` and backslash, so no control string can occur there and
the escape is undone by dropping the character after each of the four.

Edge cases: null text or role is empty; a conversation is the rows of one conv_id (null is a conversation of its own),
ordered by turn, nulls first, then role and text, so that ties and repeated rows have one defined order; an empty table gives an empty
result; other columns are ignored. Rendering every prefix costs turns times length; conversations are grouped whole, as
their output is one string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_SPECIAL = re.compile(r"[\[\]<\\]")
_ESCAPED = re.compile(r"([\[\]<\\])\\")


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def inst_template(turns: list[Turn]) -> str:
    """The module's own template; it only ever appends."""
    marks = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
    out = ["<s>"]
    for role, text in turns:
        before, after = marks.get(role) or (f"[ROLE {escape(role)}] ", " [/ROLE]")
        out += (before, escape(text), after)
    return "".join(out)


_READ = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|\[ROLE (?P<role>.*?)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S)


def read_back(out: str) -> list[Turn]:
    """The turns of an output of inst_template."""
    turns, at = [], len("<s>")
    while at < len(out):
        m = _READ.match(out, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], int | None]:
    """The output, each turn's span in it, and the first turn that rewrote history (None: none did)."""
    before, found, rewrote = template([]), [], None
    for i in range(len(turns)):
        now = template(turns[: i + 1])
        start = len(before)
        if not now.startswith(before):
            start = len(commonprefix([before, now]))
            rewrote = i if rewrote is None else rewrote
            found = [(min(a, start), min(b, start)) for a, b in found]
        found.append((start, len(now)))
        before = now
    return before, found, rewrote


def loss_spans(turns: list[Turn], template: Template, role: str = "assistant") -> tuple[str, list[tuple[int, int]], int | None]:
    """The output, the place of each text of the role, and the first turn that rewrote history.

    A turn's text is located by rendering the turn once more with a probe in its place, one character that the text neither begins nor ends with: what both
    share at the start and the end of the span is the template's. History that was rewritten leaves no masks, as spans found earlier no longer hold."""
    out, where, rewrote = spans(turns, template)
    if rewrote is not None:
        return out, [], rewrote
    masks = []
    for i, ((r, text), (a, b)) in enumerate(zip(turns, where, strict=True)):
        if r != role:
            continue
        probe = next(c for c in "\x00\x01\x02" if c not in (text[:1], text[-1:]))
        now, other = out[a:b], template([*turns[:i], (r, probe)])[a:]
        head = len(commonprefix([now, other]))
        tail = len(commonprefix([now[head:][::-1], other[head:][::-1]]))
        masks.append((a + head, b - tail))
    return out, masks, None


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, text (the formatted conversation), spans, loss (array<struct<start,end>> in code points), rewrote."""
    conv = _grouped(conversations)
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(rows):
            for c, turns in rows:
                t = _ordered(turns)
                out, where, _ = spans(t, inst_template)
                _, loss, rewrote = loss_spans(t, inst_template)
                yield c, out, [dict(zip(("start", "end"), x)) for x in where], [dict(zip(("start", "end"), x)) for x in loss], rewrote

        return work

    return map_rows(
        conv, make, "conv_id long, text string, spans array<struct<start: long, end: long>>, loss array<struct<start: long, end: long>>, rewrote int",
        pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("spans", pairs), ("loss", pairs), ("rewrote", pa.int32())]),
    )


def _grouped(conversations: DataFrame) -> DataFrame:
    cols = [F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(*cols).alias("turn")).groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))


def _ordered(turns: list[dict]) -> list[Turn]:
    key = lambda x: (x["turn"] is not None, x["turn"] or 0, x["role"], x["text"])
    return [(x["role"], x["text"]) for x in sorted(turns, key=key)]


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""

    def make():
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def work(rows):
            for c, turns in rows:
                out, loss, _ = loss_spans(_ordered(turns), inst_template)
                back = read_back(out)
                learned = "".join(unescape(out[a:b]) for a, b in loss)
                yield c, len(back), sha("".join(f"{r}\n{t}\n" for r, t in back)), len(learned), sha(learned), len(out)

        return work

    return map_rows(
        _grouped(conversations), make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]),
    )
