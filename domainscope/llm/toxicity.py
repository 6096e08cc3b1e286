"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries are trained apart, one on ordinary and one on toxic labelled text. Toxic text is mostly ordinary, too, so
that the toxic dictionary is then refined by compression: of the words of toxic text only those stay that a compressor with it shortens more
than it does all but 1 - REFINE of the words of ordinary text of their length, and that stand in a share SPREAD of the toxic texts.

A window is WINDOW consecutive words, one at every STEP-th word, lower-cased and without punctuation, framed by ordinary text that both compressors know, since
zstandard only starts matches some bytes before the end of a block. Its gain is its compressed length with the ordinary dictionary, less
that with the toxic one beside it. Thresholds for gains are calibrated: quantiles QUANTILES of the gains of ordinary windows. A document is
described by how many of its windows reach each threshold, by their shares, and by its number of windows; a logistic regression on labelled
rows makes this a probability. (Two compressors with one dictionary each tell toxic from ordinary text hardly better than chance where most words are
ordinary in both: what either dictionary happens to hold of them outweighs the rest.)

Fitting uses a bounded sample of the labelled rows: at most TOXIC and ORDINARY documents of at most MAX_CHARS characters, those
with the smallest hash of the id, and runs in one task. Half of them trains the dictionaries, half calibrates. The class shares come from all labels. Rows whose
crc32(doc_id) mod 4 is 2 are held out; labels, lang, source and doc_id never enter a score.

Every text is scored whole. Edge cases: null text is empty and scores like any text without a gain; repeated rows score alike; with
no labels of one of the classes the score is the share of toxic labels (0 without labels); words over 48 bytes are cut into words of 48; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_and_text, kept, map_rows, small_batches

TOXIC, ORDINARY, MAX_CHARS = 1500, 3000, 20_000
THRESHOLD = 0.3
WINDOW, STEP = 8, 4
#: Bytes of the dictionaries as trained, and of the toxic one as refined.
ORDINARY_BYTES, TOXIC_BYTES, REFINED_BYTES = 110_000, 32_768, 4096
REFINE, SPREAD = 0.98, 0.025
QUANTILES = (0.9, 0.99, 0.999, 0.9999)
_LONGEST = 48
_PUNCTUATION = bytes(c for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in "'-@")
_LOWER = bytes(range(256)).lower()
_LONG = re.compile(rb"\S{49,}")


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, ...]
    weights: tuple[float, ...]
    prior: float


def words(text: str) -> list[bytes]:
    """The words, lower-cased, without punctuation; cut where they are very long."""
    data = text.encode("utf-8", "replace").translate(_LOWER, _PUNCTUATION)
    found = data.split()
    if _LONG.search(data):
        found = [w[i : i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


def windows(found: list[bytes]) -> list[bytes]:
    """The windows of a list of words; the last may be shorter."""
    return [b" ".join(found[i : i + WINDOW]) for i in range(0, max(len(found) - WINDOW + STEP, min(len(found), 1)), STEP)]


class Gains:
    """Compressed lengths with the ordinary dictionary, less those with the toxic one beside it."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        half = len(ordinary) // 2
        self.before, self.after = ordinary[-120:-60] + b" ", b" " + ordinary[-1000:-960]
        self.without = self._lengths(ordinary)
        self.with_toxic = self._lengths(ordinary[:half] + toxic + ordinary[half:])

    @staticmethod
    def _lengths(content: bytes):
        params = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        compress = zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).compress
        return lambda x: len(compress(x))

    def of(self, window: bytes) -> int:
        x = self.before + window + self.after
        return self.without(x) - self.with_toxic(x)

    def counted(self, text: str) -> tuple[int, Counter]:
        """The number of windows of a text, and how many have each gain."""
        found = Counter(windows(words(text)))
        gains: Counter = Counter()
        for w, n in found.items():
            gains[self.of(w)] += n
        return sum(found.values()), gains


def _features(n: int, gains: Counter, thresholds: tuple[int, ...]) -> list[float]:
    at_least = [sum(c for g, c in gains.items() if g >= k) for k in thresholds]
    return [1.0, *(math.log1p(c) for c in at_least), *(min(100.0 * c / n, 10.0) if n else 0.0 for c in at_least), math.log1p(n)]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * len(y) / 1000 * np.eye(len(b)) + 1e-9 * np.eye(len(b)), x.T @ (w * (y - p)) - ridge * len(y) / 1000 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _quantiles(counts: Counter, shares: tuple[float, ...]) -> list[int]:
    """The least values that so large a share of the counted doesn't exceed."""
    values = sorted(counts)
    total = np.cumsum([counts[v] for v in values])
    return [values[int(np.searchsorted(total, s * total[-1]))] for s in shares]


def _refined(trained: bytes, ordinary: bytes, plain: list[list[bytes]], bad: list[list[bytes]]) -> bytes:
    """What is left of the toxic dictionary: words of toxic texts by the number of texts, most frequent last."""
    spread, gain = Counter(w for x in bad for w in set(x) if len(w) > 1), Gains(ordinary, trained).of
    usual: dict[int, Counter] = defaultdict(Counter)
    for w, n in Counter(w for x in plain for w in x).items():
        usual[len(w)][gain(w)] += n
    limits = {size: _quantiles(c, (REFINE,))[0] for size, c in usual.items()}
    stay = [w for w, n in spread.items() if n >= max(3, SPREAD * len(bad)) and gain(w) > limits.get(len(w), max(limits.values()))]
    return b"".join(b" " + w + b" " for w in sorted(stay, key=lambda w: (spread[w], w)))[-REFINED_BYTES:]


def fit(sample: list[tuple[int, str, int]], share: float) -> Model:
    """sample: (order, text, toxic) of labelled documents; share: of toxic ones among all labels."""
    sample = sorted({t: (i, t, y) for i, t, y in sample}.values())
    train, rest = sample[::2], sample[1::2]
    plain, bad = ([words(t) for _, t, y in train if y == k] for k in (0, 1))
    if not any(plain) or not any(bad) or len({y for _, _, y in rest}) < 2:
        return Model(b"", b"", (), (), share)
    lines = lambda texts: [b" ".join(x[i : i + 16]) for x in texts for i in range(0, len(x), 16)]
    ordinary = _trained(lines(plain), ORDINARY_BYTES)
    toxic = _refined(_trained(lines(bad), TOXIC_BYTES), ordinary, plain, bad)
    gains = Gains(ordinary, toxic)
    counted = [gains.counted(t) for _, t, _ in rest]
    usual: Counter = Counter()
    for (_, c), (_, _, k) in zip(counted, rest, strict=True):
        usual.update(c if not k else {})
    thresholds = tuple(sorted({max(0, g) + 1 for g in _quantiles(usual, QUANTILES)})) if usual else (1,)
    x = np.array([_features(n, c, thresholds) for n, c in counted])
    y = np.array([k for _, _, k in rest], float)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(ordinary, toxic, thresholds, tuple(_logistic(x, y, w).tolist()), share)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples[:200_000], k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the bounded sample of labelled rows that aren't held out, in a task of its own; only the model comes to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    total = {y: n for y, n in known.groupBy("toxic").count().collect()}
    if not total:
        return Model(b"", b"", (), (), 0.0)
    share = total.get(1, 0) / sum(total.values())
    order = F.xxhash64("doc_id", F.lit("fit"))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(ORDINARY)).distinct()
    texts = id_and_text(docs).where(F.length("text").between(1, MAX_CHARS))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min(order).alias("order"), F.max("toxic").alias("toxic"))

    def run(sample: pa.Table) -> pa.Table:  # at most TOXIC + ORDINARY ids' texts; the same in every run
        rows = zip(*(sample.column(c).to_pylist() for c in ("order", "text", "toxic")), strict=True)
        return pa.table({"model": [pickle.dumps(tuple(fit(list(rows), share)))]})

    found = rows.select("order", "text", "toxic").groupBy().applyInArrow(run, "model binary").first()
    return Model(*pickle.loads(found["model"])) if found else Model(b"", b"", (), (), share)


def _gains(model: Model) -> Gains:
    return kept(("toxicity", model), lambda: Gains(model.ordinary, model.toxic))


def score(model: Model, text: str, gains: Gains | None = None) -> tuple[float, int, int]:
    """The probability, the number of windows, and how many of them reach the lowest threshold."""
    if not model.weights:
        return model.prior, len(windows(words(text))), 0
    n, found = (gains or _gains(model)).counted(text)
    z = sum(a * b for a, b in zip(model.weights, _features(n, found, model.thresholds), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n, sum(c for g, c in found.items() if g >= model.thresholds[0])


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, n_gains of every whole text."""

    def make():
        gains = _gains(model) if model.weights else None
        return lambda rows: ((d, held, s[0], int(s[0] >= threshold), s[1], s[2]) for d, t, held in rows for s in [score(model, t, gains)])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return map_rows(
        id_and_text(docs).withColumn("held", held), make, "doc_id long, held_out boolean, score double, predicted int, n_windows long, n_gains long",
        pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_windows", pa.int64()), ("n_gains", pa.int64())]),
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score stays below the threshold, all their columns unchanged."""
    names = docs.columns

    def run(batches):
        gains = _gains(model) if model.weights else None
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([score(model, t or "", gains)[0] < threshold for t in texts], pa.bool_()))
            del b, texts
        give_back()

    return small_batches(docs).mapInArrow(run, docs.schema).select(*names)
