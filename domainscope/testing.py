"""Running a query and its SQL side by side."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])).rstrip(os.pathsep)
    base = {
        "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in order, floats to 9 places."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype) in ("Int32", "Int64"):
            df[c] = df[c].astype(float)
        if df[c].dtype.kind == "f" or df[c].dtype == object and df[c].map(lambda v: isinstance(v, float)).any():
            df[c] = df[c].astype(float).round(9) + 0.0
    return df.sort_values(list(df.columns), ignore_index=True)


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con.execute(sql).df()


def difference(found: DataFrame, sf_dir: str, sql: str) -> str | None:
    """What differs between a query's rows and those of its SQL; None: nothing."""
    a, b = canonical(found.toPandas()), canonical(oracle(sf_dir, sql))
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    try:
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.5e-6)
    except AssertionError as e:
        return str(e)
    return None
