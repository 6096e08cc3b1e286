"""Scoring rows or tiles as they arrive against a saved training model. Stateless: each row's result depends on it and the model alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from domainscope.operators.applicability import TrainDI, aoa


def scored_stream(spark: SparkSession, path: str, schema: str, model: TrainDI, lpd: bool = False) -> DataFrame:
    """The Parquet files that arrive below path, with di, aoa and, if asked for, lpd."""
    return aoa(spark.readStream.schema(schema).parquet(path), model, lpd=lpd).rows


def score_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a scored stream as Parquet; once: what is there now, then ends."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
