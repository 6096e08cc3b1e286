import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.functions import distributions
from domainscope.functions.metrics import Metric, Rows, check, whitening
from domainscope.functions.scaling import Dummies, Scaler
from domainscope.plans import ordered


def column(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_quantile_threshold(spark):
    df = column(spark, [1.0, 2.0, 4.0, 8.0, 16.5, 3.3])
    assert df.agg(F.percentile("v", 0.75)).first()[0] == pytest.approx(7.0)
    assert distributions.upper_whisker(df, "v") == pytest.approx(7.0 + 1.5 * (7.0 - 2.325))


def test_threshold_is_at_most_the_largest(spark):
    assert distributions.upper_whisker(column(spark, [1.0, 1.0, 5.0, 5.0]), "v") == 5.0


def test_wasserstein_against_arrays(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=60).round(1), rng.normal(1, 2, size=45).round(1)
    one, two = column(spark, a.tolist()), column(spark, b.tolist())
    assert distributions.wasserstein(one, "v", two, "v") == pytest.approx(distributions.w1(a, b))
    assert distributions.wasserstein(one, "v", one, "v") == 0
    assert distributions.wasserstein(two, "v", one, "v") == pytest.approx(distributions.w1(a, b))


def test_wasserstein_of_an_empty_sample(spark):
    with pytest.raises(DomainError):
        distributions.wasserstein(column(spark, []), "v", column(spark, [1.0]), "v")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30), st.lists(st.floats(-5, 5), min_size=1, max_size=30))
def test_w1_is_a_distance(a, b):
    a, b = np.array(a), np.array(b)
    assert distributions.w1(a, a) == pytest.approx(0, abs=1e-12)
    assert distributions.w1(a, b) >= 0
    assert distributions.w1(a, b) == pytest.approx(distributions.w1(b, a))


def test_ks_exact_by_enumeration():
    from itertools import combinations

    n, m, d = 4, 5, 0.55
    hits = 0
    for places in combinations(range(n + m), n):
        i = j = 0
        top = 0.0
        for p in range(n + m):
            if p in places:
                i += 1
            else:
                j += 1
            top = max(top, i / n - j / m)
        hits += top >= d - 1e-9
    assert distributions.ks_p_value(d, n, m).p_value == pytest.approx(hits / math.comb(n + m, n))


def test_ks_asymptotic():
    t = distributions.ks_p_value(0.1, 200, 300)
    assert not t.exact and t.p_value == pytest.approx(math.exp(-2 * 0.01 * 60000 / 500))


def test_density_integrates_to_one(spark):
    d = distributions.kernel_density(column(spark, np.random.default_rng(0).normal(size=300).tolist()), "v").toPandas()
    assert np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=0.01)


def test_histogram_counts_all(spark):
    h = distributions.histogram(column(spark, [0.0, 1.0, 1.0, 9.0, 10.0]), "v", 5).toPandas()
    assert h["n"].sum() == 5 and len(h) == 5


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(0, 3)), min_size=2, max_size=12))
def test_mahalanobis_is_whitened_l2(rows):
    x = np.array(rows, float)
    s = np.cov(x.T)
    got = Metric("mahalanobis", whiten=whitening(s))
    p = got.prepared(Rows(x, np.empty((len(x), 0), np.int64)))
    d = got.distances(p, p)
    inverse = np.linalg.pinv(s, rcond=np.sqrt(np.finfo(float).eps))
    diff = x[:, None] - x[None]
    assert np.allclose(d, np.sqrt(np.maximum(0, np.einsum("ijk,kl,ijl->ij", diff, inverse, diff))), atol=1e-6)


def test_legal_combinations():
    check("geographical", "great_circle", False, True)
    for bad in (("geographical", "gower", False, False), ("geographical", "euclidean", False, True), ("feature", "great_circle", False, False), ("feature", "euclidean", True, False), ("feature", "cosine", False, False)):
        with pytest.raises(DomainError):
            check(*bad)


def test_scaler_without_variance(spark):
    with pytest.raises(DomainError):
        Scaler.fit(column(spark, [2.0, 2.0]), ["v"]).check()


def test_dummies(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, c string")
    rows = {r["id"]: r for r in Dummies.fit(df.where("id < 3"), ["c"]).apply(df.unionByName(spark.createDataFrame([(4, "z")], df.schema))).collect()}
    assert (rows[1]["c_x"], rows[1]["c_y"]) == (1, 0)
    assert (rows[4]["c_x"], rows[4]["c_y"]) == (0, 0)
    assert rows[3]["c_x"] is None


def test_ranks_and_totals_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(i, float(v)) for i, v in enumerate(rng.integers(0, 40, size=500))]
    expect = {i: r for r, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, v double").repartition(parts)
        assert {r["id"]: r["rank"] for r in ordered.with_rank(df, "v", ["id"]).collect()} == expect
        totals = ordered.running_totals(df.withColumn("n", F.lit(1.0)), "v", ["n"]).orderBy("v").collect()
        assert [r["n"] for r in totals] == [float(sum(v <= t["v"] for _, v in rows)) for t in totals]
        assert [t["next"] for t in totals] == [t["v"] for t in totals[1:]] + [None]


def test_hash_rank_is_a_permutation(spark):
    ranks = [r["rank"] for r in ordered.hash_rank(spark.range(300).select(F.col("id").cast("string").alias("u")), "u", 9).collect()]
    assert sorted(ranks) == list(range(1, 301))


def test_nearest_1d_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(i, float(v), bool(r)) for i, (v, r) in enumerate(zip(rng.integers(0, 60, 300), rng.random(300) < 0.3, strict=True))]
    refs = [(i, v) for i, v, r in rows if r]
    for x in ordered.nearest_1d(spark.createDataFrame(rows, "id long, v double, ref boolean"), "v", "ref").collect():
        gaps = [abs(v - x["v"]) for i, v in refs if i != x["id"]]
        got = [abs(x[c] - x["v"]) for c in ("below", "above") if x[c] is not None]
        assert min(got) == min(gaps)
    expect = {i: r for r, (i, *_) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1)}
    ranked = ordered.with_rank(spark.createDataFrame(rows, "id long, v double, ref boolean").repartition(5), "v", ["id"])
    assert {r["id"]: r["rank"] for r in ranked.collect()} == expect


def test_nearest_1d(spark):
    rows = [(0.0, True), (1.0, False), (4.0, True), (4.0, False), (9.0, False)]
    got = {(r["v"], r["ref"]): (r["below"], r["above"]) for r in ordered.nearest_1d(spark.createDataFrame(rows, "v double, ref boolean"), "v", "ref").collect()}
    assert got[1.0, False] == (0.0, 4.0)
    assert 4.0 in got[4.0, False]
    assert got[9.0, False] == (4.0, None)
