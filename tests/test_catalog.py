"""Every catalogued query runs, and agrees with its SQL where it has one."""

from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from domainscope import catalog, views
from domainscope.testing import difference


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    assert difference(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.ORACLES[name]) is None


#: Searches whose training sample is too small in the smallest tables.
LARGER = {"knndm_kmeans", "knndm_hclust", "knndm_split", "knndm_summary"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    where = "/root/testdata/sf0.01" if name in LARGER else sf_dir
    assert catalog.QUERIES[name](spark, where).count() > 0


def test_entry(spark):
    assert {"id", "di", "aoa", "lpd"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_times_across_folds_are_of_all_training_events(spark, sf_dir):
    train = views.tm(spark, sf_dir).where("train").select("id", "unit", "ts").toPandas()
    hours, fold = train["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) / 3600e6, train["unit"].to_numpy() % 5
    gaps = np.where(fold[:, None] == fold[None, :], np.inf, np.abs(hours[:, None] - hours[None, :]))
    got = catalog.QUERIES["nn_time_cv"](spark, sf_dir).toPandas().set_index("id")
    assert sorted(got.index) == sorted(train["id"])
    assert np.allclose(got.loc[train["id"], "dist"], gaps.min(axis=1), atol=1e-6)
    assert (got.loc[train["id"], "fold"].to_numpy() == fold).all()


def test_matching_is_over_all_training_points(spark):
    where = "/root/testdata/sf0.01"
    ids = {r["id"] for r in views.xy(spark, where).where("train").select("id").collect()}
    assert catalog.QUERIES["nndm_indices"](spark, where).count() == len(ids) ** 2
    for name in ("knndm_kmeans", "knndm_hclust", "knndm_split"):
        assert {r["row_id"] for r in catalog.QUERIES[name](spark, where).collect()} == ids
    sizes = catalog.QUERIES["knndm_summary"](spark, where).first()["fold_sizes"]
    assert sum(map(int, sizes.split(", "))) == len(ids)


@pytest.fixture(scope="module")
def alike(sf_dir, tmp_path_factory):
    """The tables with every part six times, so that the nearest training row of most is one that is alike, and the threshold 0."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    top = tmp_path_factory.mktemp("alike")
    for path in Path(sf_dir).glob("*.parquet"):
        if path.stem != "part":
            (top / path.name).symlink_to(path)
    part = pq.read_table(f"{sf_dir}/part.parquet")
    at, key = part.schema.get_field_index("p_partkey"), part.column("p_partkey")
    pq.write_table(pa.concat_tables([part.set_column(at, "p_partkey", pc.add(key, i * part.num_rows)) for i in range(6)]), top / "part.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["aoa_normalized", "aoa_flag", "error_profile_window", "error_profile_lm", "error_profile_log", "error_profile_isotonic", "train_lpd", "knn_ids", "aoa_categorical"])
def test_agrees_with_sql_where_rows_are_alike(spark, alike, name):
    assert difference(catalog.QUERIES[name](spark, alike), alike, catalog.ORACLES[name]) is None


def test_no_row_inside_gives_no_spline(spark, alike):
    found = catalog.QUERIES["error_profile_spline"](spark, alike)
    assert found.columns == ["rank", "di", "rmse", "fitted"] and found.count() == 0
