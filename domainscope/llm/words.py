"""Words and word windows as 64-bit hashes, by numpy over whole batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

U = np.uint64
#: The base of the rolling polynomial; odd, so that it is invertible modulo 2**64.
BASE = U(0x9E3779B97F4A7C15)
#: That of a second, independent one.
SECOND = U(0xC2B2AE3D27D4EB4F)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), U, len(words))


def two_hashes(words: list[bytes]) -> np.ndarray:
    """(2, words): two independent hashes of each word."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), ">u8").astype(U).reshape(-1, 2).T


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hashes of the k-word windows that start at each word, mixed; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= base
        out += h[j : j + n]
    return mix(out)


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """What the optimiser takes the size of df to be, which for a plain scan is that of its files; where it knows nothing
    and says something near the largest number there is, the bytes of the texts are summed."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 56:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]


def parts(df: DataFrame, each: int) -> int:
    """How many parts of about ``each`` bytes df makes, and no fewer than there are shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // each))
