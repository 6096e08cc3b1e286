"""Fixtures with known answers, invariants, and edge cases of the operators."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from domainscope.errors import DomainError, DomainWarning
from domainscope.functions.metrics import Metric, Rows
from domainscope.operators import applicability, cluster, folds, geodist, learners, matching, profiles, selection, validation
from domainscope.plans.cells import nearest_in_plane
from domainscope.plans.neighbours import Features, nearest
from domainscope.sources import grid

SIX = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 3.0), (1.0, 4.0), (5.0, 4.0)]


def points(spark, rows, start=0):
    return spark.createDataFrame([(start + i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, x double, y double")


def geo():
    return geodist.Comparer.geographical(geodist.Geo(), "euclidean")


def values(df, column="dist"):
    return np.array([r[column] for r in df.collect()], float)


def test_regular_grid_is_its_spacing_apart(spark):
    cells = grid.Grid(0, 1000, 20, 50, 50).cells(spark)
    d = values(geodist.self_distances(cells, geo(), "cell_id"))
    assert len(d) == 2500 and d.mean() == pytest.approx(20)


def test_six_points(spark):
    assert values(geodist.self_distances(points(spark, SIX), geo(), "id")).mean() == pytest.approx((4 + 2**0.5 + 10**0.5) / 6)


def test_six_points_in_feature_space(spark):
    g = grid.Grid(0, 10, 1, 10, 10)
    cells = g.cells(spark).withColumn("v", (F.col("cell_id") + 1).cast("double"))
    at = g.extract(points(spark, [(x + 0.5, y + 0.5) for x, y in SIX]), cells, ["v"])
    assert [r["v"] for r in at.orderBy("id").collect()] == [82, 72, 73, 63, 52, 56]
    assert values(geodist.self_distances(at, geodist.Comparer.feature(at, ["v"], "euclidean"), "id")).mean() == pytest.approx(0.3814, abs=1e-4)


def test_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    x = points(spark, rng.integers(0, 30, size=(90, 2)))
    q = points(spark, rng.integers(0, 30, size=(40, 2)), 1000)
    f = Features([F.col("x"), F.col("y")])
    for how in ({"k": 7, "threshold": 4.0}, {"k": 3}):
        a, b = (nearest(q, x, f, Metric("euclidean"), "id", limit=limit, **how).orderBy("id").toPandas() for limit in (1000, 20))
        assert np.allclose(a["nn_dist"], b["nn_dist"]) and np.allclose(a["sum_dist"], b["sum_dist"]) and (a["n_under"] == b["n_under"]).all()
        assert [list(v) for v in a["nn_ids"]] == [list(v) for v in b["nn_ids"]]
    a, b = (nearest(x, x, f, Metric("euclidean"), "id", rule="other", limit=limit).orderBy("id").toPandas() for limit in (1000, 20))
    assert np.allclose(a["nn_dist"], b["nn_dist"]) and (a["n_dist"] == 89).all() and (b["n_dist"] == 89).all()


def alike(n, seed, missing=True):
    """Rows of two numbers, a category and a fold; many are alike, some miss a value."""
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), "xyz"[c], None if f == 4 else int(f)) for i, (a, b, c, f) in enumerate(rng.integers(0, [7, 5, 3, 5], size=(n, 4)))]
    return rows + [(n, None, 1.0, "x", 1), (n + 1, 1.0, 1.0, None, 2)] * missing


@pytest.mark.parametrize("limit", [None, 150, 40])
def test_a_tree_finds_what_all_pairs_have(spark, limit):
    """Whether references travel as rows, as the different ones, or by blocks."""
    schema = "id long, a double, b double, c string, f int"
    x, q = spark.createDataFrame(alike(300, 21), schema), spark.createDataFrame(alike(200, 22), schema).withColumn("a", F.col("a") * 0.7)
    numbers, mixed = Features([F.col("a"), F.col("b")]), Features([F.col("a"), F.col("b")], [F.col("c")])
    for metric, f in ((Metric("euclidean"), numbers), (Metric("great_circle"), numbers), (Metric("gower", ranges=(6.0, 4.0)), mixed), (Metric("euclidean"), Features([F.col(v) for v in "ab"] * 7))):
        for queries, how in ((q, {}), (q, {"k": 7, "threshold": 2.5}), (x, {"rule": "other", "threshold": 0.5}), (x, {"rule": "out_of_fold", "fold": "f", "threshold": 2.0})):
            new, old = (nearest(queries, x, f, metric, "id", limit=n, sums=s, **how).orderBy("id").toPandas() for n, s in ((limit, False), (1000, True)))
            assert new["id"].tolist() == old["id"].tolist()
            for c in ("nn_dist", "n_dist", "n_under"):
                assert np.allclose(new[c].astype(float), old[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), (metric.name, how, c)
            assert [None if v is None else list(v) for v in new["nn_ids"]] == [None if v is None else list(v) for v in old["nn_ids"]]
    other = spark.createDataFrame(alike(300, 21), schema)
    new, old = (nearest(a, x, mixed, Metric("gower", ranges=(6.0, 4.0)), "id", rule="other").orderBy("id").toPandas() for a in (x, other))
    assert np.allclose(new["sum_dist"], old["sum_dist"], equal_nan=True) and new["sum_dist"].isna().sum() == 2 and (new["n_dist"].dropna() == old["n_dist"].dropna()).all()


def test_few_pairs_are_compared(spark, monkeypatch):
    """The cost of a search: of 20,000 queries and as many references a few pairs in a thousand, and none twice for rows that are alike."""
    from domainscope.plans.neighbours import Points

    rng, pairs = np.random.default_rng(5), []
    x = Rows(rng.random((20_000, 2)), np.empty((20_000, 0), np.int64))
    between = Metric.between
    monkeypatch.setattr(Metric, "between", lambda self, an, ac, bn, bc: pairs.append(np.prod(np.broadcast_shapes(an.shape, bn.shape)[:-1])) or between(self, an, ac, bn, bc))
    Points.of(x, np.ones(20_000, np.int64), None, None, Metric("euclidean"), 0).search(Metric("euclidean")).least(x, place=1)
    assert sum(pairs) < 200 * 20_000
    assert len(Points.of(Rows(np.tile(x.numeric[:9], (50, 1)), np.empty((450, 0), np.int64)), np.ones(450, np.int64), None, None, Metric("euclidean"), 0).rows) == 9


def test_vectors_are_compared_by_products_first(monkeypatch):
    """Of 64 numbers: hardly more than the nearest pairs go through the metric itself, and the result is the metric's; also for vectors far from the origin."""
    from domainscope.plans.neighbours import Points

    rng, metric, pairs = np.random.default_rng(6), Metric("euclidean"), []
    between = Metric.between
    for shift, scale in ((0.0, 1.0), (1000.0, 1.0), (0.0, 1e-9), (0.0, 1e14)):
        x, q = (Rows((rng.normal(size=(n, 64)) + shift) * scale, np.empty((n, 0), np.int64)) for n in (900, 300))
        points = Points.of(x, np.ones(900, np.int64), None, None, metric, 0)
        d = metric.distances(q, points.rows)
        with monkeypatch.context() as m:
            m.setattr(Metric, "between", lambda self, an, ac, bn, bc: pairs.append(np.prod(np.broadcast_shapes(an.shape, bn.shape)[:-1])) or between(self, an, ac, bn, bc))
            got = points.search(metric).least(q)
        assert np.array_equal(got, d.min(axis=1))
    assert sum(pairs) < 4 * 300 * 5


@pytest.mark.parametrize("other", [False, True])
def test_cells_give_the_same(spark, other):
    rng = np.random.default_rng(14)
    x = points(spark, np.vstack([rng.normal(0, 0.01, (150, 2)), rng.random((30, 2)) * 100, [[1.0, 1.0]] * 3]))
    q = x if other else points(spark, np.vstack([rng.random((40, 2)) * 300 - 100, rng.normal(0, 0.01, (40, 2))]), 1000).unionByName(spark.createDataFrame([(5, None, 1.0)], "id long, x double, y double"))
    a = {r["row_id"]: r["dist"] for r in (geodist.self_distances(x, geo(), "id") if other else geodist.distances_to(q, x, geo(), "id")).collect()}
    b = {r["id"]: r["dist"] for r in nearest_in_plane(q, x, "id", other=other).collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) if a[i] is not None else b[i] is None for i in a)
    assert nearest_in_plane(q, x.limit(0), "id").where("dist is not null").count() == 0


def test_duplicates_ties_and_missing(spark):
    x = points(spark, [(0, 0), (0, 0), (2, 0), (-2, 0)])
    d = {r["row_id"]: r["dist"] for r in geodist.self_distances(x, geo(), "id").collect()}
    assert d[0] == d[1] == 0 and d[2] == 2
    q = spark.createDataFrame([(9, 0.0, 0.0), (8, None, 0.0), (7, float("nan"), 1.0)], "id long, x double, y double")
    got = {r["id"]: r for r in nearest(q, x, Features([F.col("x"), F.col("y")]), Metric("euclidean"), "id", k=3).collect()}
    assert got[9]["nn_ids"] == [0, 1, 2]
    assert got[8]["nn_dist"] is None and got[7]["nn_dist"] is None and got[8]["nn_ids"] is None


def test_time_units(spark):
    rows = spark.createDataFrame([(i, 86400 * v) for i, v in enumerate([0, 1, 4, 4, 10])], "id long, s long").select("id", F.timestamp_seconds("s").alias("t"))
    days, hours = (values(geodist.time_distances(rows, None, "t", "id", u).orderBy("row_id")) for u in ("days", "hours"))
    assert days.tolist() == [1, 1, 0, 0, 6] and np.allclose(hours, days * 24)


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_times_of_other_folds_in_one_pass(spark, monkeypatch, bucket_rows):
    """Runs of one fold over several buckets, equal times, a fold of its own for rows without, and a time that is missing."""
    from domainscope.plans import ordered

    monkeypatch.setattr(ordered, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(41)
    rows = [(i, int(s), None if f == 3 else int(f)) for i, (s, f) in enumerate(zip(rng.integers(0, 90, 120), rng.integers(0, 4, 120)))] + [(200 + i, 100 + i, 1) for i in range(30)] + [(300, None, 1), (301, 500, 2)]
    x = spark.createDataFrame(rows, "id long, s long, f int").select("id", "f", F.timestamp_seconds("s").alias("t"))
    monkeypatch.setattr(geodist, "cv_distances", None)  # no pairs are compared
    got = {r["row_id"]: (r["fold"], r["dist"]) for r in geodist.time_cv_distances(x, "t", "id", "f", "secs").collect()}
    assert sorted(got) == [i for i, _, f in rows if f is not None]
    for i, (f, d) in got.items():
        s = {r[0]: r[1] for r in rows}[i]
        assert d is None if s is None else d == pytest.approx(min(abs(s - o) for _, o, g in rows if o is not None and g != f))
    one = x.where("f = 1")
    assert geodist.time_cv_distances(one, "t", "id", "f", "secs").where("dist is not null").count() == 0


def test_cv_is_no_nearer_than_self(spark):
    rng = np.random.default_rng(2)
    x = points(spark, rng.random((60, 2))).withColumn("f", (F.col("id") % 4).cast("int"))
    own = {r["row_id"]: r["dist"] for r in geodist.self_distances(x, geo(), "id").collect()}
    assert all(r["dist"] >= own[r["row_id"]] for r in geodist.cv_distances(x, geo(), "id", fold="f").collect())


def test_a_single_fold_has_no_neighbour(spark):
    assert geodist.cv_distances(points(spark, SIX).withColumn("f", F.lit(1)), geo(), "id", fold="f").where("dist is not null").count() == 0


def test_geodist_errors(spark):
    x = points(spark, SIX)
    with pytest.raises(DomainError):
        geodist.geodist(x, x, "id", space="lunar")
    with pytest.raises(DomainError):
        geodist.geodist(x, x, "id", geo=geodist.Geo(crs="EPSG:4326"), metric="euclidean")
    with pytest.raises(DomainError):
        geodist.geodist(x, x, "id", geo=geodist.Geo(crs="EPSG:3857"), pred_geo=geodist.Geo(crs="EPSG:25832"))
    with pytest.raises(DomainError):
        geodist.geodist(x, x, "id", space="feature", variables=["nope"])
    with pytest.warns(DomainWarning):
        geodist.geodist(x, x, "id")


# -- applicability


def parts(spark, n=80, seed=4):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(a), float(b), "xyz"[i % 3], i % 4) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))], "id long, a double, b double, c string, f int")


@pytest.fixture(scope="module")
def model(spark):
    return applicability.train_di(parts(spark), "id", ["a", "b"], fold="f", lpd=True)


def test_training_invariants(model):
    rows = model.rows.toPandas()
    assert (rows["train_di"] >= 0).all() and model.threshold <= rows["train_di"].max() + 1e-12
    assert (rows.loc[rows["lpd"] > 0, "train_di"] < model.threshold).all()
    assert model.avg_lpd == round(rows["lpd"].mean())


def test_training_rows_are_inside(spark, model):
    got = applicability.aoa(parts(spark), model, lpd=True).rows.toPandas()
    assert (got["di"] == 0).all() and (got["aoa"] == 1).all() and (got["lpd"] >= 1).all()


def test_applicability_invariants_and_partitions(spark, model):
    new = parts(spark, 300, 9).withColumn("a", F.col("a") * 3)
    one, many = (applicability.aoa(new.repartition(n), model, lpd=True, indices=True).rows.orderBy("id").toPandas() for n in (1, 6))
    assert np.array_equal(one["di"], many["di"]) and [list(v) for v in one["nn_ids"]] == [list(v) for v in many["nn_ids"]]
    assert ((one["di"] <= model.threshold) == (one["aoa"] == 1)).all()
    assert (one.loc[one["lpd"] > 0, "di"] < model.threshold).all()
    assert [len(v) for v in one["nn_ids"]] == one["lpd"].tolist()


def test_threshold_is_inclusive_for_aoa_and_strict_for_lpd(spark):
    train = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 2, 3])], "id long, a double")
    m = applicability.train_di(train, "id", ["a"])
    sd = np.std([0, 1, 2, 3], ddof=1)
    edge = 3 + m.threshold * m.dbar * sd
    new = spark.createDataFrame([(1, float(edge) - 1e-12), (2, float(edge) + 1e-6)], "id long, a double")
    got = {r["id"]: r for r in applicability.aoa(new, m, lpd=True).rows.collect()}
    assert got[1]["aoa"] == 1 and got[2]["aoa"] == 0 and got[2]["lpd"] == 0


def test_one_row_unseen_category_and_missing(spark):
    m = applicability.train_di(parts(spark), "id", ["a", "b", "c"])
    new = spark.createDataFrame([(1, 0.0, 0.0, "new")], "id long, a double, b double, c string")
    assert applicability.aoa(new, m).rows.first()["di"] > 0
    hole = spark.createDataFrame([(1, 0.0, 0.0, None), (2, None, 0.0, "x")], "id long, a double, b double, c string")
    assert all(r["di"] is None and r["aoa"] is None for r in applicability.aoa(hole, m).rows.collect())


def test_normalised_threshold_is_one(spark, model):
    a = applicability.aoa(parts(spark, 50, 8), model)
    n = applicability.normalised(a)
    assert n.threshold == 1
    assert np.allclose(values(a.rows.orderBy("id"), "di") / model.threshold, values(n.rows.orderBy("id"), "di"))


def test_rows_that_no_fold_tests(spark):
    x = parts(spark).withColumn("f", F.when(F.col("id") != 5, F.col("f")))
    rows = {r["row_id"]: r for r in applicability.train_di(x, "id", ["a", "b"], fold="f").rows.collect()}
    assert rows[5]["train_di"] is None and rows[5]["avg_dist"] is not None


def test_fold_column_and_lists_agree(spark):
    x = parts(spark)
    test = {f: [i for i in range(80) if i % 4 == f] for f in range(4)}
    lists = folds.FoldLists.of(list(range(80)), test, None)
    assert applicability.train_di(x, "id", ["a", "b"], folds=lists).threshold == pytest.approx(applicability.train_di(x, "id", ["a", "b"], fold="f").threshold)
    both = folds.folds_of_column(x.withColumn("f", F.col("f") + 1), "id", "f")
    assert applicability.train_di(x, "id", ["a", "b"], folds=both).threshold == pytest.approx(applicability.train_di(x, "id", ["a", "b"], fold="f").threshold)


def test_training_errors(spark):
    x = parts(spark)
    with pytest.raises(DomainError):
        applicability.train_di(x.limit(1), "id", ["a", "b"])
    with pytest.raises(DomainError):
        applicability.train_di(x.withColumn("a", F.lit(1.0)), "id", ["a", "b"])
    with pytest.raises(DomainError):
        applicability.train_di(x, "id", ["a", "nope"])
    with pytest.raises(DomainError):
        applicability.train_di(x, "id", ["a", "b"], {"a": 0.0, "b": -1.0})
    with pytest.raises(DomainError):
        applicability.train_di(x, "id", ["a", "b"], folds=folds.FoldLists.of([0, 1, 2], {1: [0, 1], 2: [1, 2]}, None))
    with pytest.warns(DomainWarning):
        applicability.train_di(x, "id", ["a", "b"], {"a": 1.0})
    with pytest.warns(DomainWarning):
        applicability.train_di(x, "id", ["a", "b"], {"a": 1.0, "b": -2.0})


@pytest.mark.parametrize("bad", [0, -1, 0.001, 1.5, 81, "many", True])
def test_bad_max_lpd(bad):
    with pytest.raises(DomainError):
        applicability.checked_max_lpd(bad, 80)


def test_max_lpd():
    assert applicability.checked_max_lpd(1, 80) == 80 and applicability.checked_max_lpd(0.5, 80) == 40 and applicability.checked_max_lpd(80, 80) == 80


def test_missing_columns_in_new_rows(spark, model):
    with pytest.raises(DomainError):
        applicability.aoa(parts(spark).drop("a"), model)


# -- folds


def test_leave_location_and_time_out(spark):
    x = spark.createDataFrame([(i, i % 6, i % 5) for i in range(90)], "id long, s long, t long")
    f = folds.spacetime_folds(x, "id", "s", "t", k=3)
    rows = f.table.join(x, F.col("row_id") == F.col("id")).toPandas()
    for _, g in rows.groupby("fold"):
        train, test = g[g.role == "train"], g[g.role == "test"]
        assert not set(train.s) & set(test.s) and not set(train.t) & set(test.t) and len(test)
    assert (rows[rows.role == "test"].groupby("row_id").size() == 1).all()


def test_fewer_units_than_folds(spark):
    x = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, s long")
    with pytest.warns(DomainWarning):
        assert folds.spacetime_folds(x, "id", "s", k=10).k == 3


def test_numeric_class(spark):
    with pytest.raises(DomainError):
        folds.spacetime_folds(spark.createDataFrame([(1, 1, 2)], "id long, s long, c long"), "id", "s", by_class="c")
    with pytest.raises(DomainError):
        folds.spacetime_folds(spark.range(3), "id")


# -- clusters and matching


def test_merge_trees_against_direct_definitions():
    rng = np.random.default_rng(6)
    x = rng.random((25, 2))
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    for linkage in cluster.LINKAGES:
        groups = {i: [i] for i in range(25)}
        heights = []
        while len(groups) > 1:
            def height(a, b):
                block = d[np.ix_(groups[a], groups[b])]
                if linkage == "ward.D2":
                    n, m = len(groups[a]), len(groups[b])
                    return np.sqrt(2 * n * m / (n + m)) * np.linalg.norm(x[groups[a]].mean(axis=0) - x[groups[b]].mean(axis=0))
                return {"single": block.min, "complete": block.max, "average": block.mean}[linkage]()

            h, a, b = min((height(a, b), a, b) for a in groups for b in groups if a < b)
            heights.append(h)
            groups[a] += groups.pop(b)
        tree = cluster.merge_tree(d, linkage)
        assert np.allclose(np.sort(tree[:, 2]), np.sort(heights)), linkage
        assert len(set(cluster.cut(tree, 25, 4).tolist())) == 4


def test_clusterings_find_separate_groups():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.1, size=(20, 2)) for c in (0, 5, 10)])
    truth = np.repeat([0, 1, 2], 20)
    c = truth.reshape(-1, 1) % 2
    for got in (cluster.kmeans(x, 3), cluster.kprototypes(x, c, 3), cluster.cut(cluster.merge_tree(np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))), 60, 3)):
        assert len({(a, b) for a, b in zip(got.tolist(), truth.tolist(), strict=True)}) == 3
    with pytest.raises(DomainError):
        cluster.kmeans(np.zeros((5, 2)), 2)


def test_nndm_matches_and_feeds_geodist(spark):
    rng = np.random.default_rng(8)
    x = points(spark, rng.random((40, 2)) * 10)
    pred = points(spark, rng.random((300, 2)) * 100, 1000)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = matching.nndm(x, pred, "id")
        assert (got.gjstar >= got.gj - 1e-12).all()
        assert (got.kept.sum(axis=1) / 40 > 0.5 - 2 / 40).all()
        test, train = got.lists()
        d = geodist.cv_distances(x, geo(), "id", lists=folds.FoldLists(test, train))
        assert values(d).mean() == pytest.approx(got.gjstar.mean())
        near = matching.nndm(x, x.withColumn("x", F.col("x") + 1e-3), "id")
        assert near.kept.sum() == 40 * 39
    roles = got.table(spark).groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("role") == "test").cast("int")).alias("t")).collect()
    assert all(r["n"] == 40 and r["t"] == 1 for r in roles)


def test_knndm(spark):
    rng = np.random.default_rng(9)
    centres = rng.random((8, 2)) * 100
    x = points(spark, np.vstack([rng.normal(c, 1.0, size=(12, 2)) for c in centres]))
    pred = points(spark, rng.random((400, 2)) * 100, 1000)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for how in ({}, {"clustering": "kmeans"}):
            got = matching.knndm(x, pred, "id", k=4, nk_len=12, **how)
            shares = np.bincount(got.folds)[1:] / 96
            assert len(shares) == 4 and shares.max() <= 0.5 and got.w >= 0 and "clusters" in got.q
            random = matching.fold_distances(matching.Sample.collect(x, geo(), "id", 1000).rows, Metric("euclidean"), matching._dealt(np.arange(96), 1) % 4 + 1)
            assert got.w < matching.w1(random, got.gij)
        split = matching.knndm(x, pred, "id", test_prop=0.3, nk_len=12)
        assert set(split.folds.tolist()) == {1, 2}
        same = matching.knndm(x, x.withColumn("x", F.col("x") + 0.3), "id", k=4)
        assert same.q == "random CV" and np.bincount(same.folds)[1:].tolist() == [24] * 4


def test_folds_are_fitted_at_once(spark, monkeypatch):
    import threading

    together = threading.Barrier(3, timeout=30)

    class Mean:
        def fit(self, rows):
            together.wait()  # breaks where one fit waits for the one before
            self.mean = rows.agg(F.avg("__y")).first()[0]
            return self

        def transform(self, rows):
            return rows.withColumn("pred", F.lit(self.mean))

    monkeypatch.setattr(learners, "estimator", lambda method, **options: Mean())
    x = spark.createDataFrame([(float(i), float(i), i % 3) for i in range(9)], "a double, y double, f int")
    got = {r["a"]: r["pred"] for r in learners.held_out(x, ["a"], "y", "f", [0, 1, 2], "lm").collect()}
    assert got == {float(i): (36 - sum(j for j in range(9) if j % 3 == i % 3)) / 6 for i in range(9)}


def test_points_on_edges_of_a_polygon(spark):
    """On the vertical edge to the right and on the lower edge: inside; on the slanted one above, also where its slope is no binary fraction: not."""
    ring = [(0.0, 0.0), (60_000.0, 0.0), (60_000.0, 90_000.0)]
    rows = [(1, 60_000, 1), (2, 60_000, 89_999), (3, 30_000, 0), (4, 60_001, 5), (5, 59_999, 5)] + [(10 + i, 2 * i, 3 * i) for i in range(1, 3000, 7)] + [(4000 + i, 2 * i, 3 * i - 1) for i in range(1, 3000, 7)]
    x = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in rows], "id long, x double, y double")
    got = {r["id"] for r in x.where(grid.in_polygon(F.col("x"), F.col("y"), ring)).collect()}
    assert got == {1, 2, 3, 5} | {4000 + i for i in range(1, 3000, 7)}
    third = [(0.0, 0.0), (90_000.0, 0.0), (90_000.0, 60_000.0)]
    slanted = x.where("id >= 10 and id < 4000").select(F.col("y").alias("x"), F.col("x").alias("y"))
    assert slanted.count() > 400 and slanted.where(grid.in_polygon(F.col("x"), F.col("y"), third)).count() == 0


def test_matching_without_a_matrix(spark, monkeypatch):
    """The same roles, clusters and distances as from a matrix, also where rows are alike; and no row too many."""
    rng = np.random.default_rng(31)
    for x in (rng.integers(0, 9, size=(60, 2)), rng.random((50, 2)) * 9, np.repeat(rng.random((3, 2)), 5, axis=0)):
        rows = Rows(x.astype(float), np.empty((len(x), 0), np.int64))
        sample = matching.Sample(np.arange(len(x)), rows, Metric("euclidean"))
        d = sample.matrix()
        off = d + np.where(np.eye(len(x)), np.inf, 0)
        assert np.array_equal(matching.own_distances(rows, sample.metric), off.min(axis=1))
        fold = rng.integers(0, 4, len(x))
        assert np.array_equal(matching.fold_distances(rows, sample.metric, fold), matching.fold_distances(rows, sample.metric, fold, d))
        assert matching.farthest(spark, sample) == d.max()
        for far, share in ((1, 0.5), (6, 0.5), (30, 0.0), (3, 0.9)):
            gij = rng.random(200) * far
            kept, star = matching.match_loo(d, gij, 100.0, share)
            np.fill_diagonal(kept, False)
            gj, got, left = matching.matched(sample, gij, 100.0, share)
            assert np.array_equal(got, star) and np.array_equal(gj, off.min(axis=1)) and np.array_equal(left, kept.sum(axis=1))
            assert np.array_equal(matching.Nndm(sample, left, gij, gj, got, 100.0).kept, kept)
    spread = np.vstack([rng.random((40, 2)) * 9, rng.random((3, 2))[[0, 1, 1, 2, 2, 2]]])
    for linkage in cluster.LINKAGES:
        for metric in ("euclidean", "gower"):
            sample = matching.Sample(np.arange(46), Rows(spread, np.empty((46, 0), np.int64)), Metric(metric, ranges=(9.0, 9.0)))
            one, two = cluster.merge_tree(sample.matrix(), linkage), matching.merges(sample, linkage)
            assert np.allclose(one[:, 2], two[:, 2])
            for k in (2, 5, 9, 20):
                assert np.array_equal(cluster.cut(one, 46, k), cluster.cut(two, 46, k)), (linkage, metric, k)


def test_matching_has_no_bound_where_no_matrix_is_needed(spark):
    rng = np.random.default_rng(32)
    x = points(spark, rng.random((matching.MATRIX_ROWS + 200, 2)) * 1000)
    pred = points(spark, rng.random((300, 2)) * 1000, 10_000)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = matching.nndm(x, pred, "id")
        assert got.table(spark).where("fold <= 3").groupBy("role").count().where("role = 'test'").first()["count"] == 3
        assert matching.knndm(x, x.withColumn("x", F.col("x") + 0.1), "id", k=4).q == "random CV"
        far = points(spark, rng.random((300, 2)) * 9000, 10_000)
        split = matching.knndm(x, far, "id", k=4, nk_len=2)
        assert "clusters" in split.q and len(split.folds) == matching.MATRIX_ROWS + 200


def test_all_prediction_distances_count(spark, monkeypatch):
    """At any number of prediction rows, repeated distances included; the limit is that of an earlier version, which went over to quantiles."""
    monkeypatch.setattr(matching, "PREDICTION_ROWS", 100, raising=False)
    rng = np.random.default_rng(4)
    at, new = rng.uniform(0, 100, (20, 2)), rng.integers(0, 30, (500, 2))
    x, pred = points(spark, at), points(spark, new, 1000)
    expect = np.sort(np.sqrt(np.square(new[:, None] - at[None]).sum(axis=2)).min(axis=1))
    found = matching.nndm(x, pred, "id")
    assert len(found.gij) == 500 and np.allclose(found.gij, expect)
    assert len(np.unique(expect)) < 500
    assert len(matching.knndm(x, pred, "id", k=3).gij) == 500


def test_matching_errors(spark):
    x = points(spark, SIX)
    for bad in ({"maxp": 0.25, "k": 4}, {"clustering": "magic"}, {"nk_len": 0}, {"test_prop": 1.2}, {"k": 5, "maxp": 1.0}):
        with pytest.raises(DomainError):
            matching.knndm(x, x, "id", **bad)
    with pytest.raises(DomainError):
        matching.knndm(x, x, "id", k=3, clustering="kmeans", geo=geodist.Geo(crs="EPSG:4326"))
    for bad in ({"phi": -1}, {"phi": "some"}, {"min_train": 2}):
        with pytest.raises(DomainError):
            matching.nndm(x, x, "id", **bad)


# -- validation, profiles, selection


def test_classification_figures():
    got = validation.classification_metrics([("a", "a", 40), ("a", "b", 10), ("b", "b", 30), ("b", "a", 20)])
    assert got["accuracy"] == pytest.approx(0.7) and got["kappa"] == pytest.approx(0.4)
    assert got["accuracy_lower"] == pytest.approx(0.6002, abs=1e-3) and got["accuracy_upper"] == pytest.approx(0.7876, abs=1e-3)
    assert got["mcnemar_p_value"] == pytest.approx(0.1003, abs=1e-3)
    assert validation.classification_metrics([("a", "a", 3)])["kappa"] == 0
    with pytest.raises(DomainError):
        validation.classification_metrics([])
    with pytest.raises(DomainError):
        validation.global_validation(None)


@pytest.mark.parametrize("window", [1, 4, 5])
def test_moving_error_windows(spark, window):
    rng = np.random.default_rng(11)
    o, p, v = rng.random(30), rng.random(30), rng.integers(0, 9, 30)
    df = spark.createDataFrame([(i, float(v[i]), float(o[i]), float(p[i])) for i in range(30)], "id long, di double, obs double, pred double")
    got = {r["rank"]: r["rmse"] for r in validation.moving_error(df, "di", window, ["id"]).collect()}
    order = np.lexsort((np.arange(30), v))
    back = (window - 1) // 2
    expect = {i + 1: np.sqrt(np.mean((o[order] - p[order])[i - back : i - back + window] ** 2)) for i in range(back, 30 - window // 2)}
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k]) for k in got)


@pytest.mark.parametrize("kind", ["isotonic", "spline"])
def test_calibrated_errors_are_monotone(spark, kind):
    rng = np.random.default_rng(12)
    di = np.sort(rng.random(120))
    df = spark.createDataFrame([(i, float(di[i]), 0.0, float(rng.normal(0, 0.2 + di[i]))) for i in range(120)], "id long, di double, obs double, pred double")
    m = profiles.error_profile(df, "id", "di", 1.0, calibration=kind, window=7)
    y = [k[1] for k in m.knots]
    assert all(a <= b + 1e-9 for a, b in zip(y, y[1:], strict=False)) and y[-1] > y[0]
    fitted = m.plot_data().orderBy("di").toPandas()["fitted"].to_numpy()
    assert (np.diff(fitted) >= -1e-9).all()
    with pytest.raises(DomainError):
        profiles.error_profile(df, "id", "di", 1.0, calibration="exp")
    with pytest.raises(DomainError):
        profiles.error_profile(df, "id", "lpd")


def test_multi_cv_holds_out_every_cluster(spark):
    """As many clusters as rows: leave-one-out, against direct fits and distances; and 14 clusters against direct fits."""
    rng = np.random.default_rng(8)
    n = 24
    x, place = rng.normal(size=(n, 2)), rng.uniform(0, 100, (n, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=n)
    train = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "x": place[:, 0], "y": place[:, 1], "obs": y}))
    design = np.column_stack([np.ones(n), x])
    loo = [design[i] @ np.linalg.lstsq(np.delete(design, i, 0), np.delete(y, i), rcond=None)[0] for i in range(n)]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    d = np.sqrt(np.square(z[:, None] - z[None]).sum(axis=2)) + np.diag([np.inf] * n)
    di = d.min(axis=1) / np.mean([np.delete(r, i).mean() for i, r in enumerate(d)])
    got, threshold = profiles.multi_cv_predictions(train, "id", ["a", "b"], "obs", length=2)
    last = got.where(F.col("n_clusters") == n).toPandas().set_index("id")
    assert sorted(last.index) == np.flatnonzero(di <= threshold).tolist()
    assert np.allclose(last["pred"], np.array(loo)[last.index]) and np.allclose(last["di"], di[last.index])
    some = profiles.multi_cv_predictions(train, "id", ["a", "b"], "obs", length=3)[0].where("n_clusters = 14").toPandas().set_index("id")
    clusters = cluster.kmeans(z, 14, 1)
    pred = [design[i] @ np.linalg.lstsq(design[clusters != clusters[i]], y[clusters != clusters[i]], rcond=None)[0] for i in range(n)]
    assert len(some) and np.allclose(some["pred"], np.array(pred)[some.index])
    dense = profiles.multi_cv_predictions(train, "id", ["a", "b"], "obs", length=2, variable="lpd")[0].toPandas()
    assert len(dense) and (dense["lpd"] > 0).all()
    far = profiles.multi_cv_predictions(train, "id", ["a", "b"], "obs", length=2, variable="geodist")[0].where(F.col("n_clusters") == n).toPandas().set_index("id").sort_index()
    gap = np.sqrt(np.square(place[:, None] - place[None]).sum(axis=2)) + np.diag([np.inf] * n)
    assert len(far) == n and np.allclose(far["geodist"], gap.min(axis=1))


def test_moving_kappa(spark):
    rows = spark.createDataFrame([(i, float(i), "ab"[i % 2], "ab"[i % 2] if i < 5 else "a") for i in range(10)], "id long, di double, obs string, pred string")
    got = {r["rank"]: r["kappa"] for r in validation.moving_kappa(rows, "di", 4, ["id"]).collect()}
    assert got[2] == 1 and got[8] == 0


def linear(spark, n=200, p=4, seed=13):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = 2 * x[:, 0] - x[:, 2] + 0.1 * rng.normal(size=n)
    names = [f"v{i}" for i in range(p)]
    return spark.createDataFrame([(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y, strict=True))], ", ".join(f"{v} double" for v in names) + ", y double, fold int"), names, x, y


def test_gram_evaluator_against_direct_fits(spark):
    df, names, x, y = linear(spark)
    f = np.arange(200) % 5
    for metric in ("rmse", "rsquared"):
        got = learners.LinearEvaluator(df, names, "y", "fold", metric)(("v0", "v2"))
        each = []
        for k in range(5):
            a = np.c_[np.ones(200), x[:, [0, 2]]]
            b = np.linalg.lstsq(a[f != k], y[f != k], rcond=None)[0]
            e = a[f == k] @ b
            each.append(np.sqrt(np.mean((e - y[f == k]) ** 2)) if metric == "rmse" else np.corrcoef(e, y[f == k])[0, 1] ** 2)
        assert got.value == pytest.approx(np.mean(each), rel=1e-8) and got.se == pytest.approx(np.std(each, ddof=1) / 5**0.5, rel=1e-6)


def test_selection(spark):
    df, names, *_ = linear(spark)
    evaluate = learners.LinearEvaluator(df, names, "y", "fold")
    f = selection.forward(names, evaluate, "rmse", False)
    assert {"v0", "v2"} <= set(f.selected)
    b = selection.all_subsets(names, evaluate, "rmse", False)
    assert len(b.tried) == 2**4 - 5 and b.performance.value <= f.performance.value + 1e-9
    assert selection.forward(names, evaluate, "rmse", False, within_se=True).selected == ("v0", "v2")
    assert len(selection.forward(names, evaluate, "rmse", False, min_var=4).tried) == 1
    assert f.perf_all(spark).count() == len(f.tried) and f.plot_data(spark).count() == len(f.path)


def test_budget():
    names = list("abcdefg")
    tried = selection.forward(names, lambda s: learners.Performance(float(len(s)), 0.1), "rmse", False, early_stopping=False, threads=1).tried
    assert len(tried) == selection.budget(7) == 36


def test_ml_learners(spark):
    df, names, *_ = linear(spark, 60, 3)
    p = learners.MlEvaluator(df, "y", "fold", "lm", "rmse")(("v0", "v1"))
    assert p.value > 0
    with pytest.raises(DomainError):
        learners.MlEvaluator(df, "y", "fold", "oracle", "rmse")


# -- grids


def test_polygon_and_samples(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    p = grid.sample_points(spark, (0, 0, 10, 10), 200, "random", ring)
    assert p.count() == 200 and p.where("x + y > 10").count() == 0
    assert grid.polygon_area(ring) == 50
    a, b = (grid.random_points(spark, (0, 0, 1, 1), 50).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert a == b
    with pytest.raises(DomainError):
        grid.sample_points(spark, (0, 0, 1, 1), 5, "magic")


def test_model_domains(spark):
    cells = grid.Grid(0, 100, 5, 20, 20).cells(spark).withColumn("v", F.when(F.col("col") < 10, F.col("cell_id")))
    raster = grid.Domain(cells=cells, layers=("v",))
    assert raster.points(spark, 50, "random").count() == 50 and raster.points(spark, 50).where("v is null").count() == 0
    assert 30 <= raster.points(spark, 50).count() <= 80
    x = points(spark, np.random.default_rng(15).random((30, 2)) * 20)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert geodist.geodist(x, None, "id", modeldomain=grid.Domain(box=(0, 0, 100, 100)), samplesize=100).w_sample > 0
        assert len(matching.nndm(x, None, "id", modeldomain=grid.Domain(ring=((0, 0), (100, 0), (0, 100))), samplesize=100).ids) == 30
    with pytest.raises(DomainError):
        geodist.geodist(x, None, "id")


def test_clustered_points(spark):
    p = grid.clustered_points(spark, (0, 0, 100, 100), 53, 5, 3.0).toPandas()
    assert len(p) == 5 * (1 + round(48 / 5)) and p["id"].is_unique
    tops = p[p.id < 5].set_index("parent")
    far = np.hypot(p.x - tops.loc[p.parent, "x"].to_numpy(), p.y - tops.loc[p.parent, "y"].to_numpy())
    assert (far <= 3 + 1e-9).all() and p.x.between(0, 100).all()


def test_points_outside_the_grid(spark):
    g = grid.Grid(0, 10, 1, 10, 10)
    cells = g.cells(spark).withColumn("v", F.col("cell_id"))
    got = [r["v"] for r in g.extract(points(spark, [(-1, 5), (10, 0), (3, 11)]), cells, ["v"]).orderBy("id").collect()]
    assert got == [None, 99, None]


def test_grid_files(spark, tmp_path):
    cells = grid.Grid(0, 4, 1, 4, 4).cells(spark)
    grid.write_grid(cells, str(tmp_path / "g"), tile=2)
    assert grid.read_grid(spark, str(tmp_path / "g")).where("tile_row = 1 and tile_col = 0").count() == 4


def test_polygons_with_holes_and_parts(spark):
    """An outer ring, a hole, an island in it, and a part apart, against counting by hand; samples keep to it."""
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    polygon = [square(0.5, 0.5, 20), square(5.5, 5.5, 10)[::-1], square(8.5, 8.5, 3), square(30.5, 0.5, 6)]
    within = lambda x, y, s: s[0][0] <= x < s[2][0] and s[0][1] <= y < s[2][1]
    boxes = [square(0.5, 0.5, 20), square(5.5, 5.5, 10), square(8.5, 8.5, 3), square(30.5, 0.5, 6)]
    points = spark.range(40 * 25).select((F.col("id") % 40).cast("double").alias("x"), F.floor(F.col("id") / 40).cast("double").alias("y"))
    got = {tuple(r) for r in points.where(grid.in_polygon(F.col("x"), F.col("y"), polygon)).collect()}
    assert got == {(x, y) for x in range(40) for y in range(25) if sum(within(x, y, b) for b in boxes) % 2}
    assert grid.polygon_area(polygon) == 400 - 100 + 9 + 36
    for how in ("regular", "random"):
        some = grid.Domain(ring=polygon).points(spark, 200, how).collect()
        assert all(sum(within(r["x"], r["y"], b) for b in boxes) % 2 for r in some) and (len(some) == 200 if how == "random" else abs(len(some) - 200) < 40)


def test_a_fitted_model_carries_all(spark):
    """Predictions, validation, dissimilarity and profile from one object agree with the pieces put together by hand."""
    from domainscope.operators import model

    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(3 * a - b + rng.normal(0, 0.1)), i % 4) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, f int")
    m = model.fitted(df, "id", ["a", "b"], "y", "f")
    x, y, f = np.array([[1, r[1], r[2]] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    held = np.empty(80)
    for k in range(4):
        held[f == k] = x[f == k] @ np.linalg.lstsq(x[f != k], y[f != k], rcond=None)[0]
    got = {r["id"]: r["pred"] for r in m.predictions.collect()}
    assert np.allclose([got[i] for i in range(80)], held, atol=1e-6)
    assert abs(m.global_validation().first()["rmse"] - np.sqrt(np.mean((held - y) ** 2))) < 1e-6
    whole = np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(m.weights["a"] - abs(whole[1])) < 1e-4 and np.allclose([r["pred"] for r in m.predict(df).orderBy("id").collect()], x @ whole, atol=1e-4)
    by_hand = applicability.train_di(df, "id", ["a", "b"], m.weights, fold="f")
    assert abs(m.train_di().threshold - by_hand.threshold) < 1e-12 and m.aoa(df).rows.where("aoa = 1").count() >= 60
    assert m.error_profile(calibration="lm", window=5).points.count() > 40
    best = model.fitted(df, "id", ["a", "b"], "y", "f", method="rf", grid=[{"numTrees": 1, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 5}], seed=1)
    assert best.setting["maxDepth"] == 5
    with pytest.raises(DomainError):
        model.fitted(df.where("f = 1"), "id", ["a", "b"], "y", "f")


def test_rasters_and_features_from_text(spark, tmp_path):
    from domainscope.sources import files

    values = np.arange(12.0).reshape(3, 4)
    text = "NCOLS 4\nNROWS 3\nXLLCORNER 100\nYLLCORNER 200\nCELLSIZE 10\nNODATA_VALUE -9999\n" + "\n".join(" ".join(f"{v:g}" if v != 5 else "-9999" for v in row) for row in values) + "\n"
    (tmp_path / "a.asc").write_text(text)
    (tmp_path / "b.asc").write_text(text.replace("XLLCORNER 100", "xllcenter 105").replace("-9999\n", "-1\n", 1).replace(" 7\n", " 70\n"))
    g, cells = files.read_rasters(spark, {"a": str(tmp_path / "a.asc"), "b": str(tmp_path / "b.asc")})
    got = cells.orderBy("cell_id").collect()
    assert (g.xmin, g.ymax) == (100, 230) and [r["cell_id"] for r in got] == list(range(12))
    assert [r["a"] for r in got] == [None if v == 5 else v for v in values.ravel()] and got[7]["b"] == 70 and got[5]["b"] == -9999
    assert [(r["x"], r["y"]) for r in got] == [(105 + 10 * c, 225 - 10 * r) for r in range(3) for c in range(4)]
    points = spark.createDataFrame([(1, 116.0, 213.0), (2, 99.0, 213.0)], "id long, x double, y double")
    assert {r["id"]: r["a"] for r in g.extract(points, cells, ["a"]).collect()} == {1: None, 2: None}
    (tmp_path / "cut.asc").write_text(text[:-4])
    with pytest.raises(DomainError):
        files.read_raster(spark, str(tmp_path / "cut.asc"), "a")
    feature = '{"type":"Feature","geometry":{"type":"%s","coordinates":%s},"properties":{"id":%d,"soil":"s%d"}}'
    square = "[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[3,3],[3,6],[6,6],[6,3],[3,3]]]"
    (tmp_path / "f.geojsonl").write_text("\n".join([feature % ("Point", "[1.5,2.5]", 1, 1), feature % ("Polygon", square, 2, 2), feature % ("MultiPolygon", "[[[[20,0],[22,0],[22,2],[20,2],[20,0]]]]", 3, 3), ""]))
    rows = files.read_points(spark, str(tmp_path / "f.geojsonl"), "id: bigint, soil: string").where("x is not null").collect()
    assert [(r["x"], r["y"], r["id"], r["soil"]) for r in rows] == [(1.5, 2.5, 1, "s1")]
    polygon = files.read_polygon(spark, str(tmp_path / "f.geojsonl"))
    assert len(polygon) == 3 and grid.polygon_area(polygon) == 81 - 9 + 4
