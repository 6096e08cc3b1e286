"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return rows with the columns of documents:

toxicity           drops documents whose score reaches the threshold; the model is fitted on the labelled rows that are not held out.
near_duplicates    keeps one document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id.
decontamination    drops documents that hold a benchmark item within the edit threshold.
pii                puts labels in the place of personal data and of terms that disclose it; n_chars follows the text.
byte_bpe           token ids of each text, their number, and the digest of what they decode to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainscope.llm import bpe, decontaminate, minhash, pii, toxicity
from domainscope.llm.common import remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score below the threshold, unchanged. The model is fitted on the labelled rows of docs that aren't held out.

    Null and empty texts score as texts without toxic windows; repeated rows stay or go together; without labels, or of one class only, the share of toxic labels
    is every row's score; empty docs give none; other columns are kept whatever their names."""
    return toxicity.without_toxic(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest doc_id, unchanged; of several texts of that id in one group one, of repeated rows one.

    Rows without words or without a doc_id all stay; empty docs give none; other columns are kept whatever their names."""
    return minhash.deduplicated(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, unchanged.

    Null and empty texts hold none; items without words are held by none; repeated rows stay or go together; an empty benchmark drops
    nothing; other columns are kept whatever their names."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, with labels in the texts where personal data and terms that disclose it were; n_chars is that of the new text.

    A null text stays null and keeps its n_chars; repeated rows change alike; empty docs give none; other columns are kept whatever their names."""
    clean = pii.sanitised(docs)
    length = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", length)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every row; a null text is empty, and has no ids; repeated rows get a row each; other columns are ignored."""
    return bpe.round_trips(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", sanitise),
    ("byte_bpe", tokenise),
]

#: Compressors, sketches and rank queues are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the others return is written below the shared folder of the cluster, and removed when the next one's is
    written; that of the last but one stays, as the rows returned are computed from it."""
    docs, top, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, before)
        before = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
