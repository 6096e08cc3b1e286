"""The example tables as the operators' inputs: points, features, times, predictions, vectors. Integer arithmetic, the same in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(column: str) -> F.Column:
    return (F.floor(F.col(column) / 10) % 5 + 1).cast("int")


def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, unit, train, fold: projected points of customers."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), ((key * 7919) % 100003).cast("double").alias("x"), ((key * 104729) % 100003).cast("double").alias("y"), F.col("c_nationkey").alias("unit"), (key % 10 == 0).alias("train"), (F.col("c_nationkey") % 5 + 1).cast("int").alias("fold")
    )


def ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, train."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (((key * 7919) % 36000).cast("double") / 100 - 180).alias("lon"), (((key * 104729) % 18000).cast("double") / 100 - 90).alias("lat"), (key % 10 == 0).alias("train"))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, a, b, c, train, fold: two numbers and a category of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.col("p_type").alias("c"), (F.col("p_partkey") % 10 == 0).alias("train"), _fold("p_partkey").alias("fold"))


def tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, unit, ts, day, kind, train: events; the first 20 days train."""
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("unit"), "ts", day.alias("day"), F.col("event_type").alias("kind"), (day < F.lit("2024-01-21").cast("date")).alias("train"))


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, pred, fold and predictors: pooled held-out predictions of a regression."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * 1500).alias("pred"), (F.col("l_suppkey") % 10).cast("int").alias("fold"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_linenumber").cast("double").alias("n")
    )


def cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, pred: of a classification."""
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("obs"), F.col("toxic").alias("pred"))


def vec(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """id, v0.., fold, train: vectors, a column for each component."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get("embedding", i).cast("double").alias(f"v{i}") for i in range(n)), F.col("label").alias("fold"), (F.col("vec_id") % 4 == 0).alias("train"))


#: The same views for an engine that speaks SQL, as parts of a WITH clause.
SQL = {
    "xy": "xy AS (SELECT c_custkey AS id, CAST((c_custkey*7919)%100003 AS DOUBLE) AS x, CAST((c_custkey*104729)%100003 AS DOUBLE) AS y, c_nationkey AS unit, c_custkey%10=0 AS train, c_nationkey%5+1 AS fold FROM customer)",
    "ll": "ll AS (SELECT c_custkey AS id, CAST((c_custkey*7919)%36000 AS DOUBLE)/100-180 AS lon, CAST((c_custkey*104729)%18000 AS DOUBLE)/100-90 AS lat, c_custkey%10=0 AS train FROM customer)",
    "feat": "feat AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, p_type AS c, p_partkey%10=0 AS train, (p_partkey//10)%5+1 AS fold FROM part)",
    "tm": "tm AS (SELECT event_id AS id, user_id AS unit, ts, CAST(ts AS DATE) AS day, event_type AS kind, CAST(ts AS DATE) < DATE '2024-01-21' AS train FROM events)",
    "reg": "reg AS (SELECT l_extendedprice AS obs, l_quantity*1500 AS pred, CAST(l_suppkey%10 AS INTEGER) AS fold, l_quantity AS q, l_discount AS d, l_tax AS t, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem)",
    "cls": "cls AS (SELECT quality AS obs, toxic AS pred FROM labels)",
    "vec": "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS fold, vec_id%4=0 AS train FROM embeddings)",
}
