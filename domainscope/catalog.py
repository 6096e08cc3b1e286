"""A query for each operator over the example views, most with the same in SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domainscope import views
from domainscope.errors import DomainWarning
from domainscope.functions import distributions
from domainscope.functions.scaling import Dummies, Scaler
from domainscope.operators import applicability, folds, geodist, learners, matching, model, profiles, selection, validation
from domainscope.plans.stable import kept, shared_dir
from domainscope.sources import grid
from domainscope.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Registers a query; needs: the views that its SQL reads."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", DomainWarning)
                return f(spark, sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + ", ".join(views.SQL[n] for n in needs) + (", " if needs and not sql.lstrip().upper().startswith("SELECT") else " ") if needs else "") + sql.strip()
        return f

    return add


def r6(c: str | Column, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# -- scaling and dummies


@query("SELECT 'a' AS variable, round(avg(a),6) AS mean, round(stddev_samp(a),6) AS sd FROM feat WHERE train UNION ALL SELECT 'b', round(avg(b),6), round(stddev_samp(b),6) FROM feat WHERE train", "feat")
def scale_fit(spark, d):
    train = views.feat(spark, d).where("train")
    return Scaler.fit(train, ["a", "b"]).table(train).select("variable", r6("mean", "mean"), r6("sd", "sd"))


@query("s AS (SELECT avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb FROM feat WHERE train) SELECT id, round((a-ma)/sa,6) AS a, round((b-mb)/sb,6) AS b FROM feat, s", "feat")
def scale_apply(spark, d):
    f = views.feat(spark, d)
    return Scaler.fit(f.where("train"), ["a", "b"]).apply(f).select("id", r6("a", "a"), r6("b", "b"))


def _long_dummies(df: DataFrame, dummies: Dummies) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in dummies.columns().items()))
    return df.select("id", F.explode(each).alias("s")).select("id", "s.name", F.col("s.value").alias("value"))


@query("l AS (SELECT DISTINCT c AS level FROM feat WHERE train) SELECT id, 'c_'||level AS name, CAST(c=level AS DOUBLE) AS value FROM feat, l WHERE train", "feat")
def onehot_train(spark, d):
    train = views.feat(spark, d).where("train")
    return _long_dummies(train, Dummies.fit(train, ["c"]))


@query("l AS (SELECT DISTINCT c AS level FROM feat WHERE train AND c<>'ECONOMY') SELECT id, CAST(sum(CAST(c=level AS INTEGER)) AS DOUBLE) AS n_set FROM feat, l GROUP BY id", "feat")
def onehot_unseen(spark, d):
    f = views.feat(spark, d)
    dummies = Dummies.fit(f.where("train and c <> 'ECONOMY'"), ["c"])
    return f.select("id", sum(dummies.columns().values(), F.lit(0.0)).alias("n_set"))


# -- nearest neighbours

_Z = "s AS (SELECT avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb FROM feat WHERE train), z AS (SELECT id, train, fold, c, (a-ma)/sa AS a, (b-mb)/sb AS b FROM feat, s), t AS (SELECT * FROM z WHERE train)"
_D = "sqrt((i.a-j.a)*(i.a-j.a)+(i.b-j.b)*(i.b-j.b))"
_XY = "sqrt((i.x-j.x)*(i.x-j.x)+(i.y-j.y)*(i.y-j.y))"


def _geo() -> geodist.Comparer:
    return geodist.Comparer.geographical(geodist.Geo(), "euclidean")


def _dist(df: DataFrame, digits: int = 6, fold: bool = False) -> DataFrame:
    return df.select(F.col("row_id").alias("id"), *([F.col("fold")] if fold else []), F.round("dist", digits).alias("dist"))


@query(f"SELECT i.id, round(min({_XY}),6) AS dist FROM xy i, xy j WHERE NOT i.train AND j.train GROUP BY i.id", "xy")
def nn_pred_l2(spark, d):
    p = views.xy(spark, d)
    return _dist(geodist.distances_to(p.where("not train"), p.where("train"), _geo(), "id"))


@query(f"{_Z} SELECT i.id, round(min({_D}),6) AS dist FROM t i, t j WHERE i.id<>j.id GROUP BY i.id", "feat")
def nn_self_l2(spark, d):
    train = views.feat(spark, d).where("train")
    return _dist(geodist.self_distances(train, geodist.Comparer.feature(train, ["a", "b"], "euclidean"), "id"))


@query(f"SELECT i.id, i.fold, round(min({_XY}),6) AS dist FROM xy i, xy j WHERE i.train AND j.train AND i.fold<>j.fold GROUP BY ALL", "xy")
def nn_cv_l2(spark, d):
    return _dist(geodist.cv_distances(views.xy(spark, d).where("train"), _geo(), "id", fold="fold"), fold=True)


@query(f"SELECT i.id, CAST(i.fold AS BIGINT) AS fold, round(min({_XY}),6) AS dist FROM xy i, xy j WHERE i.train AND j.train AND j.fold = i.fold%5+1 GROUP BY ALL", "xy")
def nn_cv_explicit_train(spark, d):
    train = views.xy(spark, d).where("train")
    ids: dict[int, list[int]] = {}
    for i, f in train.select("id", "fold").collect():  # fold lists are for training tables of bounded size
        ids.setdefault(f, []).append(i)
    lists = folds.FoldLists(ids, {f: ids.get(f % 5 + 1, []) for f in ids})
    return _dist(geodist.cv_distances(train, _geo(), "id", lists=lists), fold=True)


_HAV = "2*6371010.0*asin(sqrt(least(1.0, pow(sin((radians(j.lat)-radians(i.lat))/2),2)+cos(radians(i.lat))*cos(radians(j.lat))*pow(sin((radians(j.lon)-radians(i.lon))/2),2))))"


def _sphere() -> geodist.Comparer:
    return geodist.Comparer.geographical(geodist.Geo("lon", "lat", "EPSG:4326"), "great_circle")


@query(f"SELECT i.id, round(min({_HAV}),3) AS dist FROM ll i, ll j WHERE NOT i.train AND j.train GROUP BY i.id", "ll")
def nn_great_circle_pred(spark, d):
    p = views.ll(spark, d)
    return _dist(geodist.distances_to(p.where("not train"), p.where("train"), _sphere(), "id"), 3)


@query(f"SELECT i.id, round(min({_HAV}),3) AS dist FROM ll i, ll j WHERE i.train AND j.train AND i.id<>j.id GROUP BY i.id", "ll")
def nn_great_circle_self(spark, d):
    return _dist(geodist.self_distances(views.ll(spark, d).where("train"), _sphere(), "id"), 3)


_GOWER = "(abs(i.a-j.a)/ra + abs(i.b-j.b)/rb + CAST(i.c<>j.c AS INTEGER))/3"
_RANGE = "w AS (SELECT max(a)-min(a) ra, max(b)-min(b) rb FROM feat)"
_RANGE_T = "w AS (SELECT max(a)-min(a) ra, max(b)-min(b) rb FROM feat WHERE train)"


@query(f"{_RANGE} SELECT i.id, round(min({_GOWER}),6) AS dist FROM feat i, feat j, w WHERE NOT i.train AND j.train GROUP BY i.id", "feat")
def nn_gower_pred(spark, d):
    f = views.feat(spark, d)
    train, pred = f.where("train"), f.where("not train")
    return _dist(geodist.distances_to(pred, train, geodist.Comparer.feature(train, ["a", "b", "c"], "gower", other=pred), "id"))


@query(f"{_RANGE_T} SELECT i.id, round(min({_GOWER}),6) AS dist FROM feat i, feat j, w WHERE i.train AND j.train AND i.id<>j.id GROUP BY i.id", "feat")
def nn_gower_self(spark, d):
    train = views.feat(spark, d).where("train")
    return _dist(geodist.self_distances(train, geodist.Comparer.feature(train, ["a", "b", "c"], "gower"), "id"))


@query(f"{_RANGE_T} SELECT i.id, CAST(i.fold AS INTEGER) AS fold, round(min({_GOWER}),6) AS dist FROM feat i, feat j, w WHERE i.train AND j.train AND i.fold<>j.fold GROUP BY ALL", "feat")
def nn_gower_cv(spark, d):
    train = views.feat(spark, d).where("train")
    return _dist(geodist.cv_distances(train, geodist.Comparer.feature(train, ["a", "b", "c"], "gower"), "id", fold="fold"), fold=True)


_MAHA = "sqrt(greatest(0,(vb*(i.a-j.a)*(i.a-j.a) - 2*vab*(i.a-j.a)*(i.b-j.b) + va*(i.b-j.b)*(i.b-j.b))/(va*vb-vab*vab)))"


@query(f"{_Z}, v AS (SELECT var_samp(a) va, var_samp(b) vb, covar_samp(a,b) vab FROM t) SELECT i.id, round(min({_MAHA}),6) AS dist FROM z i, t j, v WHERE NOT i.train GROUP BY i.id", "feat")
def nn_mahalanobis_pred(spark, d):
    f = views.feat(spark, d)
    train = f.where("train")
    return _dist(geodist.distances_to(f.where("not train"), train, geodist.Comparer.feature(train, ["a", "b"], "mahalanobis"), "id"))


_GAP = "min(abs(epoch_us(i.ts)-epoch_us(j.ts)))/3600e6"


@query(f"SELECT i.id, round({_GAP},6) AS dist FROM tm i, tm j WHERE NOT i.train AND j.train GROUP BY i.id", "tm")
def nn_time_pred(spark, d):
    e = views.tm(spark, d)
    return _dist(geodist.time_distances(e.where("not train"), e.where("train"), "ts", "id", "hours"))


@query(f"SELECT i.id, round({_GAP},6) AS dist FROM tm i, tm j WHERE i.train AND j.train AND i.id<>j.id GROUP BY i.id", "tm")
def nn_time_self(spark, d):
    return _dist(geodist.time_distances(views.tm(spark, d).where("train"), None, "ts", "id", "hours"))


@query(
    "tr AS (SELECT id, epoch_us(ts) AS t, unit%5 AS f FROM tm WHERE train), rf AS (SELECT g.f, r.t FROM (SELECT DISTINCT f FROM tr) g JOIN tr r ON r.f<>g.f), "
    "ne AS (SELECT i.id, i.f, i.t-r.t AS gap FROM tr i ASOF JOIN rf r ON i.f=r.f AND i.t>=r.t UNION ALL SELECT i.id, i.f, r.t-i.t FROM tr i ASOF JOIN rf r ON i.f=r.f AND i.t<=r.t) "
    "SELECT id, CAST(any_value(f) AS BIGINT) AS fold, round(min(gap)/3600e6,6) AS dist FROM ne GROUP BY id", "tm",
)
def nn_time_cv(spark, d):
    train = views.tm(spark, d).where("train").withColumn("fold", F.col("unit") % 5)
    return _dist(geodist.time_cv_distances(train, "ts", "id", "fold", "hours"), fold=True)


@query("SELECT i.id, round(min(list_distance(i.v, j.v)),6) AS dist FROM vec i, vec j WHERE NOT i.train AND j.train GROUP BY i.id", "vec")
def nn_vec_l2(spark, d):
    v = views.vec(spark, d)
    train = v.where("train")
    comparer = geodist.Comparer.feature(train, [f"v{i}" for i in range(64)], "euclidean", scale=False)
    return _dist(geodist.distances_to(v.where("not train"), train, comparer, "id"))


@query(f"{_Z}, p AS (SELECT i.id, j.id AS near, row_number() OVER (PARTITION BY i.id ORDER BY round({_D},9), j.id) AS place FROM z i, t j WHERE NOT i.train) SELECT id, near, place FROM p WHERE place<=5", "feat")
def knn_ids(spark, d):
    f = views.feat(spark, d)
    train = f.where("train")
    found = geodist.Comparer.feature(train, ["a", "b"], "euclidean").nearest(f.where("not train"), train, "id", k=5)
    return found.select("id", F.posexplode("nn_ids").alias("place", "near")).select("id", "near", (F.col("place") + 1).cast("long").alias("place"))


# -- dissimilarity and applicability

_PR = f"pr AS (SELECT i.id, j.id AS jid, {_D} AS d, i.fold AS fi, j.fold AS fj FROM t i, t j WHERE i.id<>j.id), av AS (SELECT id, avg(d) AS avg_dist FROM pr GROUP BY id), g AS (SELECT avg(avg_dist) AS dbar FROM av)"
_TH = "th AS (SELECT least(quantile_cont(train_di,0.75)+1.5*(quantile_cont(train_di,0.75)-quantile_cont(train_di,0.25)), max(train_di)) AS thr FROM di)"
_DI = f"{_Z}, {_PR}, di AS (SELECT id, min(d)/any_value(dbar) AS train_di, min(d) AS min_dist FROM pr, g GROUP BY id), {_TH}"
_DICV = f"{_Z}, {_PR}, di AS (SELECT id, min(d)/any_value(dbar) AS train_di, min(d) AS min_dist FROM pr, g WHERE fi<>fj GROUP BY id), {_TH}"
_NEW = f"n AS (SELECT i.id, min({_D})/any_value(dbar) AS di, count(*) FILTER ({_D}/dbar < thr) AS lpd FROM z i, t j, g, th WHERE NOT i.train GROUP BY i.id)"


def _model(spark, d, **how) -> tuple[DataFrame, applicability.TrainDI]:
    f = views.feat(spark, d)
    how.setdefault("variables", ["a", "b"])
    return f, applicability.train_di(f.where("train"), "id", **how)


@query(f"{_DI} SELECT id, round(avg_dist,6) AS avg_dist FROM av", "feat")
def train_avgdist(spark, d):
    return _model(spark, d)[1].rows.select(F.col("row_id").alias("id"), r6("avg_dist", "avg_dist"))


@query(f"{_DI} SELECT id, round(min_dist,6) AS min_dist, round(train_di,6) AS train_di FROM di", "feat")
def train_di(spark, d):
    return _model(spark, d)[1].rows.select(F.col("row_id").alias("id"), r6("min_dist", "min_dist"), r6("train_di", "train_di"))


@query(f"{_DICV} SELECT id, round(min_dist,6) AS min_dist, round(train_di,6) AS train_di FROM di", "feat")
def train_di_cv(spark, d):
    return _model(spark, d, fold="fold")[1].rows.select(F.col("row_id").alias("id"), r6("min_dist", "min_dist"), r6("train_di", "train_di"))


@query(f"{_DI} SELECT (SELECT count(*) FROM t) AS n, round((SELECT dbar FROM g),6) AS avg_distance, round((SELECT thr FROM th),6) AS threshold", "feat")
def train_threshold(spark, d):
    return _model(spark, d)[1].summary().select("n", r6("avg_distance", "avg_distance"), r6("threshold", "threshold"))


@query(f"{_DICV} SELECT id, count(*) FILTER (d/dbar < thr) AS lpd FROM pr, g, th WHERE fi<>fj GROUP BY id", "feat")
def train_lpd(spark, d):
    return _model(spark, d, fold="fold", lpd=True)[1].rows.select(F.col("row_id").alias("id"), "lpd")


@query(f"{_DI}, {_NEW} SELECT id, round(di,6) AS di FROM n", "feat")
def aoa_di(spark, d):
    f, model = _model(spark, d)
    return applicability.aoa(f.where("not train"), model).rows.select("id", r6("di", "di"))


@query(f"{_DICV}, {_NEW} SELECT id, CAST(di<=thr AS INTEGER) AS aoa FROM n, th", "feat")
def aoa_flag(spark, d):
    f, model = _model(spark, d, fold="fold")
    return applicability.aoa(f.where("not train"), model).rows.select("id", "aoa")


@query(f"{_DICV}, {_NEW} SELECT id, least(lpd, 12) AS lpd FROM n", "feat")
def aoa_lpd(spark, d):
    f, model = _model(spark, d, fold="fold")
    return applicability.aoa(f.where("not train"), model, lpd=True, max_lpd=12).rows.select("id", "lpd")


@query(f"{_DICV}, q AS (SELECT i.id, j.id AS near, row_number() OVER (PARTITION BY i.id ORDER BY round({_D},9), j.id) AS place, {_D}/dbar AS dd FROM z i, t j, g WHERE NOT i.train) SELECT id, near, place FROM q, th WHERE dd<thr AND place<=4", "feat")
def aoa_indices(spark, d):
    f, model = _model(spark, d, fold="fold")
    found = applicability.aoa(f.where("not train"), model, lpd=True, max_lpd=4, indices=True).rows
    return found.select("id", F.posexplode("nn_ids").alias("place", "near")).select("id", "near", (F.col("place") + 1).cast("long").alias("place"))


_W = _DI.replace("(a-ma)/sa AS a, (b-mb)/sb AS b", "2*(a-ma)/sa AS a, 0.5*(b-mb)/sb AS b")


@query(f"{_W}, {_NEW} SELECT id, round(di,6) AS di, CAST(di<=thr AS INTEGER) AS aoa FROM n, th", "feat")
def aoa_weighted(spark, d):
    f, model = _model(spark, d, weights={"a": 2.0, "b": 0.5})
    return applicability.aoa(f.where("not train"), model).rows.select("id", r6("di", "di"), "aoa")


@query(f"{_DI}, {_NEW} SELECT id, CASE WHEN id%7<>0 THEN round(di,6) END AS di, CASE WHEN id%7<>0 THEN CAST(di<=thr AS INTEGER) END AS aoa FROM n, th", "feat")
def aoa_null_rows(spark, d):
    f, model = _model(spark, d)
    holes = f.where("not train").withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    return applicability.aoa(holes, model).rows.select("id", r6("di", "di"), "aoa")


_LEVELS = "lv AS (SELECT DISTINCT c AS level FROM feat WHERE train)"
_CAT = f"{_LEVELS}, oh AS (SELECT id, train, level, CAST(c=level AS DOUBLE) AS x FROM feat, lv), oz AS (SELECT id, train, level, (x-m)/s AS x FROM oh JOIN (SELECT level, avg(x) m, stddev_samp(x) s FROM oh WHERE train GROUP BY level) USING (level)), {_Z}, cd AS (SELECT i.id, j.id AS jid, sum((i.x-j.x)*(i.x-j.x)) AS q FROM oz i JOIN oz j USING (level) WHERE j.train GROUP BY ALL), dd AS (SELECT cd.id, cd.jid, sqrt(q+(i.a-j.a)*(i.a-j.a)+(i.b-j.b)*(i.b-j.b)) AS d, i.train FROM cd JOIN z i ON i.id=cd.id JOIN z j ON j.id=cd.jid), g AS (SELECT avg(m) AS dbar FROM (SELECT avg(d) AS m FROM dd WHERE train AND id<>jid GROUP BY id))"


@query(f"{_CAT} SELECT id, round(min(d)/any_value(dbar),6) AS di FROM dd, g WHERE NOT train GROUP BY id", "feat")
def aoa_categorical(spark, d):
    f, model = _model(spark, d, variables=["a", "b", "c"])
    return applicability.aoa(f.where("not train"), model).rows.select("id", r6("di", "di"))


@query(f"{_DI}, {_NEW} SELECT id, round(di/thr,6) AS di, CAST(di<=thr AS INTEGER) AS aoa, 1.0::DOUBLE AS threshold FROM n, th", "feat")
def aoa_normalized(spark, d):
    f, model = _model(spark, d)
    found = applicability.normalised(applicability.aoa(f.where("not train"), model))
    return found.rows.select("id", r6("di", "di"), "aoa", F.lit(found.threshold).alias("threshold"))


_MD = _DI.replace(f"{_D} AS d", f"{_MAHA} AS d").replace("FROM t i, t j WHERE", "FROM t i, t j, v WHERE").replace("pr AS (", "v AS (SELECT var_samp(a) va, var_samp(b) vb, covar_samp(a,b) vab FROM t), pr AS (", 1)


@query(f"{_MD} SELECT i.id, round(min({_MAHA})/any_value(dbar),6) AS di FROM z i, t j, g, v WHERE NOT i.train GROUP BY i.id", "feat")
def aoa_mahalanobis(spark, d):
    f, model = _model(spark, d, method="MD")
    return applicability.aoa(f.where("not train"), model).rows.select("id", r6("di", "di"))


@query(f"{_DI}, {_NEW} SELECT count(*) AS n, count(di) AS scored, sum(CAST(di<=thr AS BIGINT)) AS inside, round(avg(di),6) AS mean_di, round(max(di),6) AS max_di, round(any_value(thr),6) AS threshold FROM n, th", "feat")
def aoa_summary(spark, d):
    f, model = _model(spark, d)
    s = applicability.aoa(f.where("not train"), model).summary()
    return s.select("n", "scored", F.col("inside").cast("decimal(38,0)").cast("long").alias("inside"), *(r6(c, c) for c in ("mean_di", "max_di", "threshold")))


@query(f"{_DI}, {_NEW} SELECT id, CASE WHEN id%3<>0 THEN round(di,6) END AS di, CASE WHEN id%3<>0 THEN CAST(di<=thr AS INTEGER) END AS aoa FROM n, th", "feat")
def aoa_grid_masked(spark, d):
    f, model = _model(spark, d)
    new = f.where("not train").withColumn("layer", F.when(F.col("id") % 3 != 0, F.col("a")))
    return applicability.masked(applicability.aoa(new, model), "layer").select("id", r6("di", "di"), "aoa")


def _kde(values: str, name: str) -> str:
    """CTEs up to `name`: x and density of a Gaussian kernel estimate of the column v of `values`, counted in 8,192 cells, at 512 points."""
    return f"""{name}_s AS (SELECT count(v)::DOUBLE AS n, stddev_samp(v) AS sd, (quantile_cont(v,0.75)-quantile_cont(v,0.25))/1.34 AS iqr, min(v) AS lo, max(v) AS hi FROM {values}),
    {name}_h AS (SELECT *, 0.9*least(nullif(sd,0),nullif(iqr,0))*pow(n,-0.2) AS h, (hi-lo)/8192 AS wd FROM {name}_s),
    {name}_c AS (SELECT any_value(lo)+(least(floor((v-lo)/wd),8191)+0.5)*any_value(wd) AS mid, count(*) AS k FROM {values}, {name}_h WHERE v IS NOT NULL GROUP BY least(floor((v-lo)/wd),8191)),
    {name}_x AS (SELECT lo-3*h+i*((hi-lo+6*h)/511) AS x, h, n FROM range(512) r(i), {name}_h),
    {name} AS (SELECT round(x,6) AS x, round(sum(exp(-0.5*((x-mid)/h)*((x-mid)/h))*k)/any_value(n*h*sqrt(2*pi())),9) AS density FROM {name}_x, {name}_c GROUP BY x)"""


def _curve(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)} | ({"threshold": F.round("threshold", 6)} if "threshold" in df.columns else {}))


@query(
    f"{_DICV}, {_NEW}, tl AS (SELECT id, count(*) FILTER (d/dbar < thr) AS lpd FROM pr, g, th WHERE fi<>fj GROUP BY id), v1 AS (SELECT train_di AS v FROM di), v2 AS (SELECT di AS v FROM n), v3 AS (SELECT lpd::DOUBLE AS v FROM tl), "
    f"v4 AS (SELECT lpd::DOUBLE AS v FROM n), {_kde('v1', 'k1')}, {_kde('v2', 'k2')}, {_kde('v3', 'k3')}, {_kde('v4', 'k4')} "
    "SELECT x, density, 'train' AS what, round(thr,6) AS threshold FROM k1, th UNION ALL SELECT x, density, 'target', round(thr,6) FROM k2, th UNION ALL SELECT x, density, 'train', NULL FROM k3 UNION ALL SELECT x, density, 'target', NULL FROM k4", "feat",
)
def aoa_plot(spark, d):
    f, model = _model(spark, d, fold="fold", lpd=True)
    found = applicability.aoa(f.where("not train"), model, lpd=True)
    return _curve(found.plot_data("di").unionByName(found.plot_data("lpd")))


@query(f"{_DI}, v1 AS (SELECT train_di AS v FROM di), {_kde('v1', 'k1')} SELECT x, density, round(thr,6) AS threshold FROM k1, th", "feat")
def train_di_plot(spark, d):
    return _curve(_model(spark, d)[1].plot_data())


# -- distance distributions

_OWN = f"own AS (SELECT i.id, min({_XY}) AS v FROM xy i, xy j WHERE i.train AND j.train AND i.id<>j.id GROUP BY i.id)"
_PRED = f"pred AS (SELECT i.id, min({_XY}) AS v FROM xy i, xy j WHERE NOT i.train AND j.train GROUP BY i.id)"
_CVD = f"cvd AS (SELECT i.id, min({_XY}) AS v FROM xy i, xy j WHERE i.train AND j.train AND i.fold<>j.fold GROUP BY i.id)"


def _w_sql(a: str, b: str, n: str) -> str:
    return f"""{n}_p AS (SELECT v, sum(na) AS na, sum(nb) AS nb FROM (SELECT v, 1.0::DOUBLE AS na, 0.0::DOUBLE AS nb FROM {a} UNION ALL SELECT v, 0.0, 1.0 FROM {b}) GROUP BY v),
    {n}_s AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(na) OVER (ORDER BY v)/(SELECT count(*) FROM {a}) AS fa, sum(nb) OVER (ORDER BY v)/(SELECT count(*) FROM {b}) AS fb FROM {n}_p)"""


@query(f"{_OWN}, {_PRED}, {_CVD} SELECT round(v,6) AS dist, 'sample-to-sample' AS what, 'geographical' AS dist_type FROM own UNION ALL SELECT round(v,6), 'prediction-to-sample', 'geographical' FROM pred UNION ALL SELECT round(v,6), 'CV-distances', 'geographical' FROM cvd", "xy")
def geodist_long(spark, d):
    p = views.xy(spark, d)
    found = geodist.geodist(p.where("train"), p.where("not train"), "id", fold="fold")
    return found.rows.select(r6("dist", "dist"), "what", "dist_type")


@query(f"{_OWN}, {_PRED}, {_CVD}, {_w_sql('own', 'pred', 'o')}, {_w_sql('cvd', 'pred', 'c')} SELECT round((SELECT sum(abs(fa-fb)*(nx-v)) FROM o_s),4) AS w_sample, round((SELECT sum(abs(fa-fb)*(nx-v)) FROM c_s),4) AS w_cv", "xy")
def geodist_w1(spark, d):
    p = views.xy(spark, d)
    found = geodist.geodist(p.where("train"), p.where("not train"), "id", fold="fold")
    return spark.createDataFrame([(round(found.w_sample, 4), round(found.w_cv, 4))], "w_sample double, w_cv double")


@query(f"{_OWN}, {_PRED} SELECT what, count(v) AS n, round(avg(v),6) AS mean, round(min(v),6) AS min, round(max(v),6) AS max FROM (SELECT 'sample-to-sample' AS what, v FROM own UNION ALL SELECT 'prediction-to-sample', v FROM pred) GROUP BY what", "xy")
def geodist_summary(spark, d):
    p = views.xy(spark, d)
    return geodist.geodist(p.where("train"), p.where("not train"), "id").summary().select("what", "n", *(r6(c, c) for c in ("mean", "min", "max")))


_X = "one AS (SELECT x AS v FROM xy WHERE train), two AS (SELECT y AS v FROM xy WHERE NOT train)"


@query(f"{_X}, {_w_sql('one', 'two', 'o')} SELECT round(sum(abs(fa-fb)*(nx-v)),6) AS w FROM o_s", "xy")
def wasserstein(spark, d):
    p = views.xy(spark, d)
    return spark.createDataFrame([(round(distributions.wasserstein(p.where("train"), "x", p.where("not train"), "y"), 6),)], "w double")


@query(f"{_X}, {_w_sql('one', 'two', 'o')}, k AS (SELECT greatest(0, max(fa-fb)) AS stat, CAST((SELECT count(*) FROM one) AS DOUBLE) AS n, CAST((SELECT count(*) FROM two) AS DOUBLE) AS m FROM o_s) SELECT round(stat,6) AS statistic, round(exp(-2*stat*stat*n*m/(n+m)),6) AS p_value FROM k", "xy")
def ks_greater(spark, d):
    p = views.xy(spark, d)
    found = distributions.ks_greater(p.where("train"), "x", p.where("not train"), "y", exact=False)
    return spark.createDataFrame([(round(found.statistic, 6), round(found.p_value, 6))], "statistic double, p_value double")


@query("SELECT v, round(CAST(sum(n) OVER (ORDER BY v) AS DOUBLE)/sum(n) OVER (),6) AS f FROM (SELECT x AS v, count(*) AS n FROM xy GROUP BY x)", "xy")
def ecdf_points(spark, d):
    return distributions.ecdf(views.xy(spark, d), "x").select("v", r6("f", "f"))


@query("w AS (SELECT min(x) lo, (max(x)-min(x))/20 wd, count(*) n FROM xy), b AS (SELECT least(CAST(floor((x-lo)/wd) AS INTEGER), 19) AS bin, count(*) AS k FROM xy, w GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(lo+i*wd,6) AS left, round(lo+(i+1)*wd,6) AS right, coalesce(k,0) AS n, round(coalesce(k,0)/(w.n*wd),9) AS density FROM range(20) r(i) CROSS JOIN w LEFT JOIN b ON b.bin=i", "xy")
def density_hist(spark, d):
    return distributions.histogram(views.xy(spark, d), "x", 20).select("bin", r6("left", "left"), r6("right", "right"), "n", F.round("density", 9).alias("density"))


@query(f"v1 AS (SELECT x AS v FROM xy), {_kde('v1', 'k1')} SELECT x, density FROM k1", "xy")
def density_kernel(spark, d):
    return _curve(distributions.kernel_density(views.xy(spark, d), "x"))


# -- folds


def _deal(units: str, name: str, k: str = "10", seed: int = 1) -> str:
    return f"{name} AS (SELECT u, CAST((row_number() OVER (ORDER BY md5('{seed}:'||u), u)-1)%{k}+1 AS INTEGER) AS f FROM (SELECT DISTINCT CAST({units} AS VARCHAR) AS u FROM tm))"


def _table(found: folds.Folds) -> DataFrame:
    return found.table.select("fold", "row_id", "role")


@query(f"{_deal('unit', 's')} SELECT CAST(i AS INTEGER) AS fold, id AS row_id, CASE WHEN f=i THEN 'test' ELSE 'train' END AS role FROM tm JOIN s ON u=CAST(unit AS VARCHAR), range(1,11) r(i)", "tm")
def folds_space(spark, d):
    return _table(folds.spacetime_folds(views.tm(spark, d), "id", space="unit", k=10))


@query(f"{_deal('day', 's')} SELECT CAST(i AS INTEGER) AS fold, id AS row_id, CASE WHEN f=i THEN 'test' ELSE 'train' END AS role FROM tm JOIN s ON u=CAST(day AS VARCHAR), range(1,11) r(i)", "tm")
def folds_time(spark, d):
    return _table(folds.spacetime_folds(views.tm(spark, d), "id", time="day", k=10))


@query(f"{_deal('unit', 's', '5')}, {_deal('day', 't', '5')} SELECT CAST(i AS INTEGER) AS fold, id AS row_id, CASE WHEN s.f=i AND t.f=i THEN 'test' WHEN s.f<>i AND t.f<>i THEN 'train' ELSE 'exclude' END AS role FROM tm JOIN s ON s.u=CAST(unit AS VARCHAR) JOIN t ON t.u=CAST(day AS VARCHAR), range(1,6) r(i)", "tm")
def folds_llto(spark, d):
    return _table(folds.spacetime_folds(views.tm(spark, d), "id", space="unit", time="day", k=5))


@query(
    """p AS (SELECT DISTINCT CAST(unit AS VARCHAR) AS u, kind AS c FROM tm), q AS (SELECT u, c, CAST((row_number() OVER (PARTITION BY c ORDER BY md5('1:'||u||'|'||c), u||'|'||c)-1)%5+1 AS VARCHAR) AS g FROM p),
    s AS (SELECT g, CAST((row_number() OVER (ORDER BY md5('1:'||g), g)-1)%5+1 AS INTEGER) AS f FROM (SELECT DISTINCT g FROM q)) SELECT id AS row_id, f AS test_fold FROM tm JOIN q ON u=CAST(unit AS VARCHAR) AND c=kind JOIN s USING (g)""", "tm",
)
def folds_class(spark, d):
    return folds.spacetime_folds(views.tm(spark, d), "id", space="unit", by_class="kind", k=5).assigned.select("row_id", "test_fold")


@query(f"{_deal('kind', 's', '(SELECT count(DISTINCT kind) FROM tm)')} SELECT id AS row_id, f AS test_fold FROM tm JOIN s ON u=kind", "tm")
def folds_k_clamp(spark, d):
    return folds.spacetime_folds(views.tm(spark, d), "id", space="kind", k=99).assigned.select("row_id", "test_fold")


@query("SELECT id AS row_id, CAST((row_number() OVER (ORDER BY md5('1:'||CAST(id AS VARCHAR)), id)-1)%7+1 AS INTEGER) AS test_fold FROM tm", "tm")
def random_cv_balanced(spark, d):
    return folds.random_folds(views.tm(spark, d), "id", 7).assigned.select("row_id", "test_fold")


@query("SELECT fold AS test_fold, count(*) AS n, round(count(*)/CAST((SELECT count(*) FROM xy) AS DOUBLE),6) AS share FROM xy GROUP BY fold", "xy")
def fold_sizes(spark, d):
    return folds.fold_sizes(folds.folds_of_column(views.xy(spark, d), "id", "fold")).select(F.col("test_fold"), "n", r6("share", "share"))


@query("c AS (SELECT unit, count(*) AS n, avg(x) AS m FROM xy GROUP BY unit), b AS (SELECT *, n >= (SELECT count(*) FROM xy)/22.0 AS big FROM c), k AS (SELECT unit, CASE WHEN big THEN row_number() OVER (PARTITION BY big ORDER BY m, unit) END AS bigfold, row_number() OVER (PARTITION BY big ORDER BY m, unit) AS place, (SELECT count(*) FROM b WHERE big) AS used, big FROM b) SELECT unit, CAST(CASE WHEN big THEN bigfold ELSE used + (place-1)%(22-used) + 1 END AS BIGINT) AS fold FROM k", "xy")
def cluster_merge_round_robin(spark, d):
    import numpy as np

    sizes = views.xy(spark, d).groupBy("unit").agg(F.count("*").alias("n"), F.avg("x").alias("m")).orderBy("m", "unit").collect()  # a row for each cluster
    clusters = np.repeat(np.arange(len(sizes)), [r["n"] for r in sizes])
    merged = matching.merge_clusters(clusters, np.arange(len(sizes)), 22)
    first = np.searchsorted(clusters, np.arange(len(sizes)))
    return spark.createDataFrame([(r["unit"], int(f)) for r, f in zip(sizes, merged[first], strict=True)], "unit int, fold long")


# -- validation


@query("SELECT round(sqrt(avg((obs-pred)*(obs-pred))),6) AS rmse, round(pow(corr(obs,pred),2),6) AS rsquared, round(avg(abs(obs-pred)),6) AS mae FROM reg", "reg")
def global_validation_reg(spark, d):
    return validation.global_validation(views.reg(spark, d)).select(*(r6(c, c) for c in ("rmse", "rsquared", "mae")))


@query("m AS (SELECT fold, sqrt(avg((obs-pred)*(obs-pred))) AS v FROM reg GROUP BY fold) SELECT round(avg(v),6) AS mean, round(stddev_samp(v)/sqrt(count(v)),6) AS se FROM m", "reg")
def per_fold_metric_se(spark, d):
    return validation.mean_and_se(validation.per_fold(views.reg(spark, d), "fold"), "rmse").select(r6("mean", "mean"), r6("se", "se"))


@query("k AS (SELECT count(*)::DOUBLE n, sum((obs=pred)::INT)::DOUBLE r, sum((obs=1)::INT)::DOUBLE o1, sum((pred=1)::INT)::DOUBLE p1 FROM cls), c AS (SELECT r/n acc, (o1*p1+(n-o1)*(n-p1))/(n*n) ch, greatest(o1,n-o1)/n nul FROM k) SELECT round(acc,6) AS accuracy, round((acc-ch)/(1-ch),6) AS kappa, round(nul,6) AS accuracy_null FROM c", "cls")
def global_validation_cls(spark, d):
    return validation.global_validation(views.cls(spark, d), classification=True).select(*(r6(c, c) for c in ("accuracy", "kappa", "accuracy_null")))


def _scored(spark, d) -> tuple[DataFrame, float]:
    f, model = _model(spark, d)
    rows = applicability.aoa(f.where("not train"), model, lpd=True).rows
    return rows.select("id", F.col("b").alias("obs"), (F.col("a") * 2 + 850).alias("pred"), F.round("di", 9).alias("di"), "lpd"), model.threshold


_SC = f"{_DI}, {_NEW}, sc AS (SELECT n.id, b AS obs, a*2+850 AS pred, round(di,9) AS di, lpd FROM n JOIN feat ON feat.id=n.id)"
_WIN = "w AS (SELECT row_number() OVER o AS rank, {v}, sqrt(avg((obs-pred)*(obs-pred)) OVER f) AS rmse, count(*) OVER f AS k FROM sc {where} WINDOW o AS (ORDER BY {v}, id), f AS (ORDER BY {v}, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"
_WDI, _WLPD = _WIN.format(v="di", where=", th WHERE di<=thr"), _WIN.format(v="lpd", where="WHERE lpd>0")


@query(f"{_SC}, {_WDI} SELECT rank, round(di,6) AS di, round(rmse,6) AS rmse FROM w WHERE k=5", "feat")
def error_profile_window(spark, d):
    rows, t = _scored(spark, d)
    return validation.moving_error(validation.inside(rows, "di", t), "di", 5, ["id"]).select("rank", r6("di", "di"), r6("rmse", "rmse"))


def _line(spark, found: validation.ErrorModel) -> DataFrame:
    """Nulls, where there is nothing to fit a line to."""
    return spark.createDataFrame([tuple(None if v is None else round(v, 4) for v in found.knots[0])], "intercept double, slope double")


@query(f"{_SC}, {_WDI} SELECT round(regr_intercept(rmse, di),4) AS intercept, round(regr_slope(rmse, di),4) AS slope FROM w WHERE k=5", "feat")
def error_profile_lm(spark, d):
    rows, t = _scored(spark, d)
    return _line(spark, profiles.error_profile(rows, "id", "di", t, calibration="lm"))


@query(f"{_SC}, {_WLPD} SELECT round(regr_intercept(rmse, ln(lpd)),4) AS intercept, round(regr_slope(rmse, ln(lpd)),4) AS slope FROM w WHERE k=5", "feat")
def error_profile_log(spark, d):
    rows, t = _scored(spark, d)
    return _line(spark, profiles.error_profile(rows, "id", "lpd", t, calibration="exp"))


#: The closest monotone sequence by its min-max formula, over the means of 2,000 cells; between cells on a line.
_ISO = f"""{_SC}, {_WDI}, p AS (SELECT rank, di, rmse FROM w WHERE k=5), lim AS (SELECT min(di) AS lo, (max(di)-min(di))/2000 AS wd FROM p),
    ce AS (SELECT row_number() OVER (ORDER BY v) AS i, * FROM (SELECT avg(di) AS v, avg(rmse) AS y, count(*)::DOUBLE AS nw FROM p, lim GROUP BY floor((di-lo)/wd))), cu AS (SELECT *, sum(nw) OVER (ORDER BY i) AS sw, sum(nw*y) OVER (ORDER BY i) AS sy FROM ce),
    pa AS (SELECT a.i AS j, b.i AS k, (b.sy-a.sy+a.nw*a.y)/(b.sw-a.sw+a.nw) AS m FROM cu a, cu b WHERE a.i<=b.i), lo AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM pa), iso AS (SELECT k AS i, max(m) AS fit FROM lo GROUP BY k),
    kn AS (SELECT v, fit, lead(v) OVER (ORDER BY v) AS v1, lead(fit) OVER (ORDER BY v) AS fit1 FROM iso JOIN ce USING (i)), en AS (SELECT min(v) AS first, min(fit) AS low FROM kn)"""


@query(f"{_ISO} SELECT rank, round(di,6) AS di, round(rmse,6) AS rmse, round(CASE WHEN di<first THEN low WHEN v1 IS NULL THEN fit ELSE fit+(di-v)*((fit1-fit)/(v1-v)) END,6) AS fitted FROM en, p ASOF LEFT JOIN kn ON p.di>=kn.v", "feat")
def error_profile_isotonic(spark, d):
    rows, t = _scored(spark, d)
    found = profiles.error_profile(rows, "id", "di", t, calibration="isotonic").plot_data()
    return found.select("rank", *(r6(c, c) for c in ("di", "rmse", "fitted")))


@query()
def error_profile_spline(spark, d):
    rows, t = _scored(spark, d)
    return profiles.error_profile(rows, "id", "di", t).plot_data()


@query()
def error_profile_multi_cv(spark, d):
    f = views.feat(spark, d).where("train").withColumn("y", F.col("b") * 2 + F.col("a"))
    return profiles.multi_cv_predictions(f, "id", ["a", "b"], "y", length=3)[0]


# -- selection

_G = ["1", "q", "d", "obs"]
_GRAM = ", ".join(f"round(sum({'1.0' if a == '1' else a}*{'1.0' if b == '1' else b})/1e6,6)::DOUBLE AS g_{i}_{j}" for i, a in enumerate(_G) for j, b in enumerate(_G) if i <= j)


@query(f"SELECT fold, count(*) AS n, {_GRAM} FROM reg GROUP BY fold", "reg")
def gram_by_fold(spark, d):
    g = learners.gram_by_fold(views.reg(spark, d), ["q", "d"], "obs", "fold")
    return g.select("fold", "n", *(r6(F.col(c) / 1e6, c) for c in g.columns if c.startswith("g_")))


@query("f AS (SELECT k.fold, regr_slope(obs, q) AS b1, regr_intercept(obs, q) AS b0 FROM (SELECT DISTINCT fold FROM reg) k JOIN reg ON reg.fold<>k.fold GROUP BY k.fold), e AS (SELECT reg.fold, sqrt(avg((obs-b0-b1*q)*(obs-b0-b1*q))) AS v FROM reg JOIN f USING (fold) GROUP BY reg.fold) SELECT round(avg(v),4) AS rmse, round(stddev_samp(v)/sqrt(count(*)),4) AS se FROM e", "reg")
def lm_single_cv(spark, d):
    p = learners.LinearEvaluator(views.reg(spark, d), ["q", "d"], "obs", "fold")(("q",))
    return spark.createDataFrame([(round(p.value, 4), round(p.se, 4))], "rmse double, se double")


@query("v(x, i) AS (VALUES ('q',1),('d',2),('t',3),('n',4)), s AS (SELECT a.x||','||b.x AS variables, 2 AS nvar FROM v a, v b WHERE a.i<b.i UNION ALL SELECT a.x||','||b.x||','||c.x, 3 FROM v a, v b, v c WHERE a.i<b.i AND b.i<c.i UNION ALL SELECT 'q,d,t,n', 4) SELECT variables, CAST(nvar AS BIGINT) AS nvar FROM s", "reg")
def subset_grid(spark, d):
    tried = _bss(spark, d).tried
    return spark.createDataFrame([(",".join(t.variables), len(t.variables)) for t in tried], "variables string, nvar long")


def _bss(spark, d) -> selection.Selection:
    return selection.all_subsets(_PREDICTORS, learners.LinearEvaluator(views.reg(spark, d), _PREDICTORS, "obs", "fold"), "rmse", False, threads=1)


def _ols_sql(names: list[str]) -> str:
    """CTEs up to `perf`: the held-out error of ordinary least squares for every subset of two predictors or more.

    One elimination for all subsets and folds: a predictor that a subset leaves out has a unit row, so that its coefficient is 0."""
    x, n = ["1.0", *names], len(names) + 1
    at = [(i, j) for i in range(n) for j in range(i, n)]
    sums = ", ".join([f"sum({x[i]}*{x[j]}) AS s{i}{j}" for i, j in at] + [f"sum({x[i]}*obs) AS y{i}" for i in range(n)] + ["sum(obs*obs) AS yy", "count(*)::DOUBLE AS rows"])
    keep = lambda i: f"in{i}" if i else "1"
    first = ", ".join([f"{keep(i)}*{keep(j)}*(t.s{i}{j}-g.s{i}{j}){f' + (1-{keep(i)})' if i == j else ''} AS a{i}{j}" for i, j in at] + [f"{keep(i)}*(t.y{i}-g.y{i}) AS b{i}" for i in range(n)])
    totals = ", ".join(f"sum({c}) AS {c}" for c in [f"s{i}{j}" for i, j in at] + [f"y{i}" for i in range(n)])
    ctes = [
        f"bit AS (SELECT m, {', '.join(f'(m >> {i - 1}) & 1 AS in{i}' for i in range(1, n))}, bit_count(m) AS nvar FROM range(1, {2 ** (n - 1)}) r(m) WHERE bit_count(m) > 1)",
        f"g AS MATERIALIZED (SELECT fold, {sums} FROM reg GROUP BY fold)", f"tot AS (SELECT {totals} FROM g)",
        f"e0 AS (SELECT m, fold, {first} FROM bit, g, tot t)",
    ]
    for k in range(n - 1):
        old = [f"a{i}{j}" for i, j in at if i <= k] + [f"b{i}" for i in range(k + 1)]
        new = [f"a{i}{j} - a{k}{i}*a{k}{j}/a{k}{k} AS a{i}{j}" for i, j in at if i > k] + [f"b{i} - a{k}{i}*b{k}/a{k}{k} AS b{i}" for i in range(k + 1, n)]
        ctes.append(f"e{k + 1} AS (SELECT m, fold, {', '.join(old + new)} FROM e{k})")
    for k in reversed(range(n)):
        rest = "".join(f" - a{k}{j}*c{j}" for j in range(k + 1, n))
        ctes.append(f"c{k}_ AS (SELECT *, (b{k}{rest})/a{k}{k} AS c{k} FROM {f'c{k + 1}_' if k < n - 1 else f'e{n - 1}'})")
    square = " + ".join(f"{'' if i == j else '2*'}c{i}*c{j}*g.s{i}{j}" for i, j in at)
    ctes.append(f"f AS (SELECT m, fold, sqrt((g.yy - 2*({' + '.join(f'c{i}*g.y{i}' for i in range(n))}) + {square})/g.rows) AS v FROM c0_ JOIN g USING (fold))")
    ctes.append("perf AS (SELECT m, round(avg(v),4) AS rmse, round(stddev_samp(v)/sqrt(count(*)),4) AS se, any_value(nvar) AS nvar FROM f JOIN bit USING (m) GROUP BY m)")
    return ", ".join(ctes)


_PREDICTORS = ["q", "d", "t", "n"]
_OLS = _ols_sql(_PREDICTORS)
_NAMES = f"[{', '.join(repr(p) for p in _PREDICTORS)}]"
#: The predictors of a subset in their order; all subsets by size, then in the order of combinations.
_SUBSETS = f"{_OLS}, sub AS (SELECT *, list_filter({_NAMES}, lambda x, i: (m >> (i - 1)) & 1 = 1) AS vars, list_filter(range(1, 5), lambda i: (m >> (i - 1)) & 1 = 1) AS places FROM perf)"
#: The forward search without early stopping: b2, b3 and b4 are the best of each size on its path, try3 what its third round tried.
_FFS = f"""{_SUBSETS}, two AS (SELECT *, row_number() OVER (ORDER BY places) AS run FROM sub WHERE nvar=2), b2 AS (SELECT * FROM two ORDER BY rmse, run LIMIT 1),
    try3 AS (SELECT s.*, list_append(b2.vars, list_filter(s.vars, lambda x: NOT list_contains(b2.vars, x))[1]) AS path, 6 + row_number() OVER (ORDER BY list_filter(s.places, lambda x: NOT list_contains(b2.places, x))[1]) AS run FROM sub s, b2 WHERE s.nvar=3 AND (s.m & b2.m) = b2.m),
    b3 AS (SELECT * FROM try3 ORDER BY rmse, run LIMIT 1), b4 AS (SELECT s.*, list_append(b3.path, list_filter(s.vars, lambda x: NOT list_contains(b3.path, x))[1]) AS path FROM sub s, b3 WHERE s.nvar=4)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("rmse", "se") if c in df.columns})


@query(f"{_SUBSETS}, top AS (SELECT *, min(rmse) OVER (PARTITION BY nvar) AS least FROM sub) SELECT CAST(nvar AS BIGINT) AS nvar, rmse, array_to_string(vars, ', ') AS variables FROM top WHERE rmse=least", "reg")
def best_per_size(spark, d):
    return _rounded(_bss(spark, d).best_per_size(spark))


@query(f"{_SUBSETS} SELECT row_number() OVER (ORDER BY nvar, places) AS run, vars[1] AS var1, vars[2] AS var2, vars[3] AS var3, vars[4] AS var4, rmse, se, CAST(nvar AS BIGINT) AS nvar FROM sub", "reg")
def bss_lm(spark, d):
    return _rounded(_bss(spark, d).perf_all(spark))


@query(
    f"{_FFS}, u AS (SELECT run, vars AS path, rmse, se, nvar FROM two UNION ALL SELECT run, path, rmse, se, nvar FROM try3 UNION ALL SELECT 9, path, rmse, se, nvar FROM b4) "
    "SELECT run, path[1] AS var1, path[2] AS var2, path[3] AS var3, path[4] AS var4, rmse, se, CAST(nvar AS BIGINT) AS nvar FROM u", "reg",
)
def ffs_lm(spark, d):
    return _rounded(selection.forward(_PREDICTORS, learners.LinearEvaluator(views.reg(spark, d), _PREDICTORS, "obs", "fold"), "rmse", False, early_stopping=False, threads=1).perf_all(spark))


@query(
    f"{_FFS} SELECT CAST(1 AS BIGINT) AS step, array_to_string(vars, ' + ') AS label, rmse, se FROM b2 UNION ALL SELECT 2, array_to_string(b3.path, ' + '), b3.rmse, b3.se FROM b3, b2 WHERE b3.rmse < b2.rmse "
    "UNION ALL SELECT 3, array_to_string(b4.path, ' + '), b4.rmse, b4.se FROM b4, b3, b2 WHERE b3.rmse < b2.rmse AND b4.rmse < b3.rmse", "reg",
)
def ffs_plot(spark, d):
    return _rounded(selection.forward(_PREDICTORS, learners.LinearEvaluator(views.reg(spark, d), _PREDICTORS, "obs", "fold"), "rmse", False, threads=1).plot_data(spark))


@query(f"{_OLS} SELECT round(sqrt(sum(v*v*rows)/sum(rows)),3) AS rmse FROM f JOIN g USING (fold) WHERE m=3", "reg")
def model_validation(spark, d):
    """Of the held-out predictions that a fitted model carries."""
    rows = views.reg(spark, d).withColumn("id", F.monotonically_increasing_id())
    return model.fitted(rows, "id", ["q", "d"], "obs", "fold").global_validation().select(F.round("rmse", 3).alias("rmse"))


@query()
def ffs_rf(spark, d):
    """Forward selection of a random forest, with a tuning grid; y is known from a and b, the others are noise."""
    f = views.feat(spark, d).where("train").withColumns({"y": F.col("b") + F.col("a") * 3, "n1": F.pmod(F.col("id") * 7919, F.lit(101)).cast("double"), "n2": F.pmod(F.col("id") * 104729, F.lit(97)).cast("double")})
    with kept() as keep:  # read once for all fits
        evaluate = learners.MlEvaluator(keep(f.select("a", "b", "n1", "n2", "y", "fold")), "y", "fold", "rf", "rmse", [{"maxDepth": 3}, {"maxDepth": 6}], numTrees=5, seed=1)
        return _rounded(selection.forward(["a", "b", "n1", "n2"], evaluate, "rmse", False).perf_all(spark))


@query()
def ffs_class(spark, d):
    """The same for a class, judged by kappa."""
    f = views.feat(spark, d).where("train").withColumns({"y": (F.col("a") > 25).cast("int"), "n1": F.pmod(F.col("id") * 7919, F.lit(101)).cast("double")})
    evaluate = learners.MlEvaluator(f, "y", "fold", "rf_class", "kappa", numTrees=5, seed=1)
    return selection.forward(["a", "b", "n1"], evaluate, "kappa", True).perf_all(spark)


@query()
def rf_weighted_aoa(spark, d):
    f = views.feat(spark, d).withColumn("y", F.col("b") + F.col("a") * 3)
    fitted = learners.estimator("rf", numTrees=10, seed=1).fit(learners.assembled(f.where("train"), ["a", "b"], "y"))
    model = applicability.train_di(f.where("train"), "id", ["a", "b"], learners.importance_weights(fitted, ["a", "b"]))
    return applicability.aoa(f.where("not train"), model).rows.select("id", "di", "aoa")


# -- distance matching


def _points(spark, d) -> tuple[DataFrame, DataFrame]:
    p = views.xy(spark, d)
    return p.where("train"), p.where("not train")


#: The greedy removal as steps over pointers: a row's neighbours go nearest first, so that its state is how many of its distances are gone. Distances
#: of a row that are equal go together, and a row's last distance is followed by infinity.
def _nndm_sql(pred: str, rows: str, metric: str) -> str:
    """CTEs up to `fin`, the last pointers and nearest distances; rows: the numbers that metric compares, of the training rows."""
    return f"""{pred}, tr AS ({rows}), ti AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM tr), pr AS (SELECT i.i AS i, j.i AS j, {metric} AS v FROM ti i, ti j WHERE i.i<>j.i), cnt AS (SELECT count(*) AS n FROM ti),
    gs AS (SELECT list(v ORDER BY v) AS s, max(v) AS top, count(*) AS m FROM pred), phi AS (SELECT greatest(max(v), any_value(top))+1e-9 AS phi FROM pr, gs),
    dv AS (SELECT i, v, count(*) AS k FROM pr GROUP BY i, v), dl AS (SELECT i, list(v ORDER BY v) || ['Infinity'::DOUBLE] AS vs, list(k ORDER BY v) AS ks FROM dv GROUP BY i),
    mat AS MATERIALIZED (SELECT list(vs ORDER BY i) AS vs, list(ks ORDER BY i) AS ks FROM dl),
    near(step, r, p, nr, lft) AS (
        SELECT 0, list_min(list_transform(vs, lambda x: x[1])), list_transform(vs, lambda x: 1), list_transform(vs, lambda x: x[1]), list_transform(vs, lambda x: n-1) FROM mat, cnt
        UNION ALL
        SELECT step+1, list_min(list_filter(q.nr2, lambda x: CASE WHEN q.go THEN x>=q.r ELSE x>q.r END)), q.p2, q.nr2, q.lft2 FROM (
            SELECT *, CASE WHEN go THEN p[:j-1] || [p[j]+1] || p[j+1:] ELSE p END AS p2, CASE WHEN go THEN nr[:j-1] || [vs[j][p[j]+1]] || nr[j+1:] ELSE nr END AS nr2, CASE WHEN go THEN lft[:j-1] || [lft[j]-ks[j][p[j]]] || lft[j+1:] ELSE lft END AS lft2 FROM (
                SELECT *, coalesce((len(list_filter(nr, lambda x: x<=r))-1)/n::DOUBLE >= len(list_filter(gs.s, lambda x: x<=r))/m::DOUBLE AND lft[j]/n::DOUBLE > 0.5, false) AS go
                FROM (SELECT *, list_position(nr, r) AS j FROM near, phi WHERE r<=phi AND NOT isinf(r)), mat, cnt, gs)) q),
    fin AS (SELECT p, nr FROM near ORDER BY step DESC LIMIT 1)"""


_NNDM = _nndm_sql(_PRED, "SELECT id, x, y FROM xy WHERE train", _XY)
_ROLES = "SELECT CAST(a.i AS INTEGER) AS fold, b.id AS row_id, CASE WHEN a.i=b.i THEN 'test' WHEN pr.v < nr[a.i] THEN 'exclude' ELSE 'train' END AS role FROM fin, ti a CROSS JOIN ti b LEFT JOIN pr ON pr.i=a.i AND pr.j=b.i"


@query(f"{_NNDM} {_ROLES}", "xy")
def nndm_indices(spark, d):
    x, pred = _points(spark, d)
    return matching.nndm(x, pred, "id").table(spark)


@query(
    f"{_NNDM}, {_OWN}, gg AS (SELECT 'Gij' AS what, v FROM pred UNION ALL SELECT 'Gj', v FROM own UNION ALL SELECT 'Gj*', unnest(nr) FROM fin), ru AS (SELECT what, v AS r FROM gg, phi WHERE v<=phi UNION SELECT DISTINCT what, 0.0::DOUBLE FROM gg UNION SELECT DISTINCT what, phi FROM gg, phi), "
    "ff AS (SELECT ru.what, r, count(*) FILTER (v<=r)/count(*)::DOUBLE AS f FROM ru JOIN gg USING (what) GROUP BY ALL), la AS (SELECT CASE WHEN min(f) FILTER (r=phi)>=1 THEN max(r) FILTER (f<1) ELSE any_value(phi) END AS last FROM ff, phi) "
    "SELECT what, round(r,6) AS r, round(f,6) AS f FROM ff, la WHERE r<=last", "xy",
)
def nndm_plot(spark, d):
    x, pred = _points(spark, d)
    return matching.nndm(x, pred, "id").plot_data(spark).select("what", r6("r", "r"), r6("f", "f"))


@query()
def knndm_kmeans(spark, d):
    x, pred = _points(spark, d)
    return matching.knndm(x, pred, "id", k=4, clustering="kmeans").table(spark)


@query()
def knndm_hclust(spark, d):
    x, pred = _points(spark, d)
    return matching.knndm(x, pred, "id", k=4).table(spark)


@query()
def knndm_split(spark, d):
    x, pred = _points(spark, d)
    return matching.knndm(x, pred, "id", test_prop=0.3).table(spark)


@query()
def knndm_summary(spark, d):
    x, pred = _points(spark, d)
    return matching.knndm(x, pred, "id", k=4).summary(spark).withColumn("w", F.round("w", 4))


#: Random folds: to places just beside the samples it is no further than from sample to sample, as the test finds; without that no row.
_ALL = f"be AS (SELECT id, x+10 AS x, y FROM xy WHERE train), pred AS (SELECT i.id, min({_XY}) AS v FROM be i, xy j WHERE j.train GROUP BY i.id)"
_KS = f"ks AS (SELECT exp(-2*pow(greatest(0,max(fa-fb)),2)*(any_value(n)*any_value(m)/(any_value(n)+any_value(m)))) AS p FROM o_s, (SELECT count(*)::DOUBLE AS n FROM own), (SELECT count(*)::DOUBLE AS m FROM pred))"
_DEALT = "od AS (SELECT *, row_number() OVER (ORDER BY md5('1:'||id), id)-1 AS place, count(*) OVER () AS n FROM {v} WHERE train)"
_RANDOM = f"{_OWN}, {_ALL}, {_w_sql('own', 'pred', 'o')}, {_KS}, {_DEALT.format(v='xy')}, fo AS (SELECT id, x, y, CAST(place%4+1 AS INTEGER) AS deal FROM od, ks WHERE p>=0.05)"
_STAR = f"st AS (SELECT i.id, min({_XY}) AS v FROM fo i, fo j WHERE i.deal<>j.deal GROUP BY i.id), {_w_sql('st', 'pred', 's')}"


@query(f"{_RANDOM} SELECT id AS row_id, deal AS fold FROM fo", "xy")
def knndm_random(spark, d):
    x, _ = _points(spark, d)
    return matching.knndm(x, x.withColumn("x", F.col("x") + 10), "id", k=4).table(spark)


@query(f"{_RANDOM} SELECT id AS row_id, CASE WHEN place < floor(0.3*n) THEN 2 ELSE 1 END AS fold FROM od, ks WHERE p>=0.05", "xy")
def knndm_random_split(spark, d):
    x, _ = _points(spark, d)
    return matching.knndm(x, x.withColumn("x", F.col("x") + 10), "id", test_prop=0.3).table(spark)


@query(f"{_RANDOM}, {_STAR} SELECT 'geographical' AS space, 'kmeans' AS clustering, 'random CV' AS intermediate, round((SELECT sum(abs(fa-fb)*(nx-v)) FROM s_s),4) AS w, (SELECT string_agg(k, ', ' ORDER BY deal) FROM (SELECT deal, count(*) AS k FROM fo GROUP BY deal)) AS fold_sizes", "xy")
def knndm_random_summary(spark, d):
    x, _ = _points(spark, d)
    return matching.knndm(x, x.withColumn("x", F.col("x") + 10), "id", k=4, clustering="kmeans").summary(spark).withColumn("w", F.round("w", 4))


_FEATURE_KS = f"own AS (SELECT i.id, min({{m}}) AS v FROM {{t}} i, {{t}} j{{w}} WHERE i.train AND j.train AND i.id<>j.id GROUP BY i.id), pred AS (SELECT i.id, min({{m}}) AS v FROM {{t}} i, {{t}} j{{w}} WHERE j.train GROUP BY i.id), {_w_sql('own', 'pred', 'o')}, {_KS}, {_DEALT.format(v='feat')}"
_FEATURE = "SELECT id AS row_id, CAST(place%5+1 AS INTEGER) AS fold FROM od, ks WHERE p>=0.05"


@query(f"{_Z}, {_FEATURE_KS.format(m=_D, t='z', w='')} {_FEATURE}", "feat")
def knndm_feature(spark, d):
    """In the space of scaled predictors."""
    f = views.feat(spark, d)
    return matching.knndm(f.where("train"), f, "id", k=5, space="feature", variables=["a", "b"]).table(spark)


@query(f"{_RANGE_T}, {_FEATURE_KS.format(m=_GOWER, t='feat', w=', w')} {_FEATURE}", "feat")
def knndm_feature_mixed(spark, d):
    """With a category, by Gower's distance."""
    f = views.feat(spark, d)
    return matching.knndm(f.where("train"), f, "id", k=5, space="feature", metric="gower", variables=["a", "b", "c"]).table(spark)


@query(
    f"{_OWN}, gp AS (SELECT i AS id, (i%32+0.5)*3125.0 AS x, (i//32+0.5)*3125.0 AS y FROM range(1024) r(i)), pd AS (SELECT i.id, min({_XY}) AS v FROM gp i, xy j WHERE i.x < 100000.0-i.y AND j.train GROUP BY i.id) "
    "SELECT round(v,6) AS dist, 'sample-to-sample' AS what, 'geographical' AS dist_type FROM own UNION ALL SELECT round(v,6), 'prediction-to-sample', 'geographical' FROM pd", "xy",
)
def geodist_domain(spark, d):
    """Against a sample of a polygon instead of prediction rows."""
    found = geodist.geodist(views.xy(spark, d).where("train"), None, "id", modeldomain=grid.Domain(ring=((0.0, 0.0), (100_000.0, 0.0), (0.0, 100_000.0))), samplesize=500)
    return found.rows.select(r6("dist", "dist"), "what", "dist_type")


@query(
    f"{_OWN}, {_PRED}, u AS (SELECT 'sample-to-sample' AS what, v FROM own UNION ALL SELECT 'prediction-to-sample', v FROM pred), c AS (SELECT what, v/1000.0 AS v, count(*) AS k FROM u GROUP BY ALL) "
    "SELECT round(v,9) AS v, round(sum(k) OVER (PARTITION BY what ORDER BY v)/sum(k) OVER (PARTITION BY what)::DOUBLE,6) AS f, what FROM c", "xy",
)
def geodist_plot(spark, d):
    p = views.xy(spark, d)
    return geodist.geodist(p.where("train"), p.where("not train"), "id").plot_data("ecdf", km=True).select(F.round("v", 9).alias("v"), r6("f", "f"), "what")


# -- grids and samples

_GRID = "cells AS (SELECT i AS cell_id, i//40 AS row, i%40 AS col, (i%40+0.5)*2500.0 AS x, 100000.0-(i//40+0.5)*2500.0 AS y, (i*37)%101 AS layer FROM range(1600) r(i))"


def _grid(spark) -> tuple[grid.Grid, DataFrame]:
    g = grid.Grid(0.0, 100_000.0, 2500.0, 40, 40)
    return g, g.cells(spark).withColumn("layer", (F.col("cell_id") * 37) % 101)


@query(f"{_GRID} SELECT id, layer FROM xy LEFT JOIN cells ON xy.x<100000 AND xy.y<=100000 AND row=CAST(floor((100000-xy.y)/2500) AS BIGINT) AND col=CAST(floor(xy.x/2500) AS BIGINT) AND NOT (xy.y=0)", "xy")
def raster_extract(spark, d):
    g, cells = _grid(spark)
    p = views.xy(spark, d).withColumn("y", F.when(F.col("y") == 0, -1.0).otherwise(F.col("y"))).withColumn("x", F.when(F.col("x") >= 100_000, 200_000.0).otherwise(F.col("x")))
    return g.extract(p.drop("train"), cells, ["layer"]).select("id", "layer")


@query("SELECT i AS id, (i%10+0.5)*10.0 AS x, (i//10+0.5)*10.0 AS y FROM range(100) r(i)")
def regular_sample(spark, d):
    return grid.regular_points(spark, (0.0, 0.0, 100.0, 100.0), 100).select("id", r6("x", "x"), r6("y", "y"))


@query("SELECT i AS id, round(((i*(360*(sqrt(5)-1)/2)+180) - 360*floor((i*(360*(sqrt(5)-1)/2)+180)/360)) - 180, 6) AS x, round(degrees(asin((2*i+1)/500.0-1)),6) AS y FROM range(500) r(i)")
def fibonacci_sample(spark, d):
    return grid.fibonacci_points(spark, 500).select("id", r6("x", "x"), r6("y", "y"))


@query("SELECT id FROM xy WHERE x BETWEEN 0 AND 60000 AND y BETWEEN 0 AND 90000 AND y < 1.5*x AND NOT (y=0)", "xy")
def points_in_polygon(spark, d):
    p = views.xy(spark, d).where("y <> 0")
    return p.where(grid.in_polygon(F.col("x"), F.col("y"), [(0.0, 0.0), (60_000.0, 0.0), (60_000.0, 90_000.0)])).select("id")


def _uniform_sql(key: str, stream: int) -> str:
    return f"(('0x'||substr(md5('1:{stream}:'||{key}),1,12))::BIGINT/281474976710656.0)"


_SQUARE = "(x BETWEEN {0} AND {1} AND y BETWEEN {2} AND {3})"


@query(f"SELECT id FROM xy WHERE x < 60000.5 AND y > 0.5 AND y-0.5 < 1.5*(x-0.5) AND NOT {_SQUARE.format(30000.5, 45000.5, 10000.5, 25000.5)} OR {_SQUARE.format(70000.5, 90000.5, 50000.5, 70000.5)}", "xy")
def points_in_parts(spark, d):
    """A triangle with a hole, and a square apart from it."""
    square = lambda x0, x1, y0, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    polygon = [[(0.5, 0.5), (60_000.5, 0.5), (60_000.5, 90_000.5)], square(30_000.5, 45_000.5, 10_000.5, 25_000.5), square(70_000.5, 90_000.5, 50_000.5, 70_000.5)]
    return views.xy(spark, d).where(grid.in_polygon(F.col("x"), F.col("y"), polygon)).select("id")


@query(f"SELECT i AS id, round({_uniform_sql('i', 0)},6) AS x, round({_uniform_sql('i', 1)},6) AS y FROM range(1000) r(i)")
def random_sample(spark, d):
    return grid.random_points(spark, (0.0, 0.0, 1.0, 1.0), 1000).select("id", r6("x", "x"), r6("y", "y"))


@query(
    f"WITH top AS (SELECT i+1 AS parent, {_uniform_sql('i', 0)}*100 AS x, {_uniform_sql('i', 1)}*100 AS y FROM range(10) r(i)), ch AS (SELECT parent, x AS px, y AS py, c, t, parent||'-'||c||'-'||t AS key FROM top, range(19) q(c), range(200) w(t)), "
    f"dr AS (SELECT parent, px, py, c, t, px+sqrt({_uniform_sql('key', 2)})*5*cos({_uniform_sql('key', 3)}*2*pi()) AS x, py+sqrt({_uniform_sql('key', 2)})*5*sin({_uniform_sql('key', 3)}*2*pi()) AS y FROM ch), "
    "ok AS (SELECT parent, c, arg_min(x, t) AS x, arg_min(y, t) AS y FROM dr WHERE x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 100 GROUP BY ALL) "
    "SELECT CAST(parent-1 AS BIGINT) AS id, round(x,6) AS x, round(y,6) AS y, parent FROM top UNION ALL SELECT 10+(parent-1)*19+c, round(coalesce(ok.x, top.x),6), round(coalesce(ok.y, top.y),6), parent FROM (SELECT parent, c, top.x, top.y FROM top, range(19) q(c)) top LEFT JOIN ok USING (parent, c)"
)
def clustered_sample(spark, d):
    return grid.clustered_points(spark, (0.0, 0.0, 100.0, 100.0), 200, 10, 5.0).select("id", r6("x", "x"), r6("y", "y"), "parent")


@query(f"{_DI}, {_NEW} SELECT id, round(di,6) AS di, CAST(di<=thr AS INTEGER) AS aoa FROM n, th", "feat")
def stream_scoring(spark, d):
    """The new rows as a stream of files, scored and written; what was written is the result."""
    f, model = _model(spark, d)
    top = f"{shared_dir(spark)}/stream-{f'{id(f):x}'}-{spark.sparkContext.startTime}"
    f.where("not train").write.mode("overwrite").parquet(f"{top}/in")
    stream = scoring.scored_stream(spark, f"{top}/in", f.schema.simpleString()[7:-1].replace(":", " "), model)
    scoring.score_to(stream, f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("id", r6("di", "di"), "aoa")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dissimilarity, applicability and local density of nine tenths of the parts against one tenth, under five folds."""
    f, model = _model(spark, sf_dir, fold="fold")
    return applicability.aoa(f.where("not train"), model, lpd=True).rows.select("id", "di", "aoa", "lpd")


__all__ = ["ORACLES", "QUERIES", "flagship"]
