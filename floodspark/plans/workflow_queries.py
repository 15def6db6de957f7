"""Queries of the directional filter, robust fits, permanent water, filled depths, weighted fusion and workflows."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import floods, focal, scaling, segments, timeseries, workflows
from ..sources import datasets
from ..streaming.daily import daily_means as streamed_daily_means
from .filter_queries import _FLAT
from .catalogue import _OFF_TIES_6, _TIME, YX, query, rounded

_FIT = "regr_intercept(CASE WHEN k THEN y END, t) OVER w AS a, regr_slope(CASE WHEN k THEN y END, t) OVER w AS b"


def _refit(source: str) -> str:
    return f"""SELECT pixel, t, y, coalesce(r <= 2.795::double * s / 0.6745::double, true) AS k FROM (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY pixel) AS s
      FROM (SELECT *, abs(y - a - b * t) AS r FROM (SELECT *, {_FIT} FROM ({source}) WINDOW w AS (PARTITION BY pixel))))"""


@query(f"""SELECT pixel, round(regr_slope(y, t), 3) + 0.0 AS time, count(*) AS n FROM ({_refit(_refit(f"SELECT pixel, y, {_TIME} AS t, true AS k FROM obs"))}) WHERE k GROUP BY 1""")
def robust_trend(spark, d):
    o = timeseries.prep_inputs(view(spark, d, "obs"), ["y"])
    return timeseries.robust_trend(o, ["pixel"], "y", rounds=2).select("pixel", (F.round("time", 3) + 0.0).alias("time"), "n")


_HISTORY = "SELECT 2015 + scene_id % 8 AS year, y, x, max(qa_pixel % 4)::int AS water_class FROM opt_px GROUP BY ALL"


@query(f"""SELECT s.scene_id, s.y, s.x, ((vv < -20)::int = 1 AND coalesce(p, 0) = 0)::int AS flood FROM sar_px s LEFT JOIN (
  SELECT y, x, max((water_class = 3)::int) AS p FROM ({_HISTORY}) WHERE year IN (SELECT DISTINCT year FROM ({_HISTORY}) WHERE year < 2021 ORDER BY year DESC LIMIT 5)
  GROUP BY ALL) USING (y, x)""")
def extract_flood_yearly(spark, d):
    opt = view(spark, d, "opt_px")
    history = opt.groupBy((2015 + F.col("scene_id") % 8).alias("year"), "y", "x").agg(F.max(F.col("qa_pixel") % 4).alias("water_class"))
    px = view(spark, d, "sar_px").withColumn("w", (F.col("vv") < -20).cast("int"))
    return floods.extract_flood_yearly(px, "w", history, 2021).select(*YX, "flood")


@query("""SELECT s.scene_id, s.y, s.x, ((vv < -20)::int = 1 AND coalesce((occurrence + m > 75)::int, 0) = 0)::int AS flood FROM sar_px s
  LEFT JOIN (SELECT y, x, occurrence, m FROM occurrence, (SELECT unnest(range(1, 13)) AS m)) o ON s.y = o.y AND s.x = o.x AND month(s.ts) = o.m""")
def extract_flood_seasonal(spark, d):
    months = view(spark, d, "occurrence").withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    recurrence = months.select("month", "y", "x", (F.col("occurrence") + F.col("month")).alias("recurrence"))
    px = view(spark, d, "sar_px").withColumn("w", (F.col("vv") < -20).cast("int"))
    return floods.extract_flood_seasonal(px, "w", recurrence).select(*YX, "flood")


def _around(source: str, inner: str, r: int = 1) -> str:
    near = f"abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r}"
    return f"SELECT a.scene_id, a.y, a.x, {inner} FROM {source} a JOIN {source} b ON a.scene_id = b.scene_id AND {near} GROUP BY a.scene_id, a.y, a.x"


@query(f"""SELECT * FROM (WITH p AS (SELECT scene_id, y, x, elevation AS z, (vv < -20)::int AS w FROM sar_px JOIN dem USING (y, x)),
  e AS ({_around('p', 'any_value(a.z) AS z, any_value(a.w) AS w, any_value(a.w) = 1 AND min(b.w) = 0 AS edge')}),
  g AS (SELECT *, CASE WHEN w = 0 OR edge THEN z END AS ground FROM e),
  l AS ({_around('g', 'any_value(a.z) AS z, any_value(a.w) AS w, CASE WHEN any_value(a.edge) THEN avg(b.ground) END AS l')}),
  l1 AS ({_around('l', 'any_value(a.z) AS z, any_value(a.w) AS w, CASE WHEN any_value(a.w) = 1 THEN avg(b.l) END AS l')}),
  l2 AS ({_around('l1', 'any_value(a.z) AS z, any_value(a.w) AS w, CASE WHEN any_value(a.w) = 1 THEN avg(b.l) END AS l')}),
  r AS (SELECT *, CASE WHEN l IS NOT NULL THEN greatest(l - z, 0) END AS d FROM l2)
  {_around('r', f'round(CASE WHEN any_value(a.w) = 1 THEN avg(b.d) + {_OFF_TIES_6} END, 5) + 0.0 AS depth')}) /* sar_px dem */""")
def fill_depth(spark, d):
    px = view(spark, d, "sar_px").select(*YX, (F.col("vv") < -20).cast("int").alias("w"))
    got = floods.fill_depth(px, "w", view(spark, d, "dem"), steps=2)
    return rounded(got.select(*YX, (F.col("depth") + _OFF_TIES_6).alias("depth")), 5)


def _conv(source: str, value: str, out: str, keep: str, r: int) -> str:
    w = "(1 + sqrt((a.y - b.y) ^ 2 + (a.x - b.x) ^ 2) / 0.5::double)"
    kept = ", ".join(f"any_value(a.{k}) AS {k}" for k in keep.split())
    return _around(source, f"{kept}, sum({w} * b.{value}) / nullif(sum(CASE WHEN b.{value} IS NOT NULL THEN {w} END), 0) AS {out}", r)


def _starfm_sql(r: int) -> str:
    return f"""SELECT * FROM (WITH base AS (SELECT y, x, arg_max(nir, epoch_us(ts)::hugeint * 100000 + scene_id) AS base, max(ts) AS t0 FROM opt_px
    WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2023-11-20' GROUP BY ALL),
  old AS (SELECT y, x, arg_max(red, epoch_us(ts)::hugeint * 100000 + scene_id) AS old FROM opt_px
    WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2023-11-20' GROUP BY ALL),
  c0 AS (SELECT scene_id, y, x, base, abs(red - old) AS away, (epoch_us(ts) - epoch_us(t0)) / 86400000000.0::double AS since
    FROM opt_px JOIN base USING (y, x) JOIN old USING (y, x) WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25'),
  c1 AS ({_conv('c0', 'away', 's', 'base since', r)}), c2 AS (SELECT *, s * since AS st FROM c1),
  c3 AS ({_conv('c2', 'st', 'c', 'base s', r)}), c4 AS (SELECT *, 1 / nullif(c, 0) AS ic FROM c3),
  c5 AS ({_conv('c4', 'ic', 'icm', 'base s ic', r)}), c6 AS (SELECT *, ic / nullif(icm, 0) AS w FROM c5),
  c7 AS ({_conv('c6', 'w', 'wm', 'base s', r)})
  SELECT scene_id, y, x, round(base / nullif(wm, 0) + s, 4) + 0.0 AS predicted FROM c7) /* opt_px */"""


def _starfm(spark, d, r):
    opt = view(spark, d, "opt_px")
    coarse = opt.select("scene_id", "y", "x", "ts", F.col("red").alias("nir"))
    return rounded(floods.starfm(coarse, opt, "nir", "2024-01-20", r=r).select(*YX, "predicted"), 4)


@query(_starfm_sql(1))
def starfm(spark, d):
    return _starfm(spark, d, 1)


@query(_starfm_sql(16))
def starfm_wide(spark, d):
    """With its own 33 x 33 windows."""
    return _starfm(spark, d, 16)


def _modis(px):
    fields = sum(((F.col("c") % 3 == 0).cast("long") * F.lit(1 << b) for b in (2, 14)), F.lit(0))
    return px.withColumns({"state_1km": (F.col("k") % 5 * 4).cast("long"), "zenith": F.lit(100), "c": F.col("k") % 7}).withColumn("qc_500m", fields)


@query("SELECT scene_id, count(CASE WHEN k % 5 % 2 = 0 AND k % 7 % 3 <> 0 THEN nir END) AS n_good FROM (SELECT *, y * 31 + x AS k FROM opt_px) GROUP BY 1")
def modis_qa(spark, d):
    px = _modis(view(spark, d, "opt_px").withColumn("k", F.col("y") * 31 + F.col("x")))
    return datasets.Modis(px).qa(px).groupBy("scene_id").agg(F.count("nir").alias("n_good"))


_PREDICTED = f"(0.1::double + 0.01::double * t + 0.05::double * cos({2 * pi} * t) - 0.02::double * sin({2 * pi} * t))"
_T_DAY = "epoch_us(TIMESTAMP '2024-01-25') / 86400000000.0::double / 365.25::double"


def _fused(spark, d):
    """Optical pixels' index, and the normalised difference of the corrected radar bands in its place."""
    sar = workflows.radar_features(view(spark, d, "sar_px"), floods.terrain(view(spark, d, "dem")))
    return workflows.fuse(view(spark, d, "opt_px"), sar, lambda px: px.withColumn("mndwi", F.col("ndpi")))


_FUSED = f"""SELECT y, x, ts, (green - swir1) / nullif(green + swir1, 0) AS v FROM opt_px UNION ALL
  SELECT y, x, ts, (vv - vh) / nullif(vv + vh, 0) AS v FROM ({_FLAT})"""


def _product(spark, d):
    one = {"constant": 0.1, "time": 0.01, "cos_1": 0.05, "sin_1": -0.02, "mean_x": 53.0, "residual_x": 4.0, "residual_y": 0.2}
    coefficients = view(spark, d, "dem").select("y", "x", *[F.lit(v).alias(c) for c, v in one.items()], F.lit(9).alias("n"))
    return workflows.fusion_product(_fused(spark, d), "mndwi", coefficients, "2024-01-25", look_back=20, lag=4, n_cycles=1)


_PRODUCT = f"""o AS (SELECT y, x, date_trunc('day', ts) AS ts, quantile_cont(v, 0.5) AS v FROM ({_FUSED})
    WHERE v IS NOT NULL AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-22' GROUP BY ALL),
  r AS (SELECT y, x, t, {_PREDICTED} - v AS e FROM (SELECT *, {_TIME} AS t FROM o) SEMI JOIN dem USING (y, x)),
  f AS (SELECT y, x, regr_intercept(e, t) AS a, regr_slope(e, t) AS b, count(*) AS n, avg(t) AS mx, regr_sxx(e, t) AS rx,
        sqrt(greatest(regr_syy(e, t) - coalesce(regr_sxy(e, t) ^ 2 / nullif(regr_sxx(e, t), 0), 0), 0) / count(*)) AS ry FROM r GROUP BY ALL),
  g AS (SELECT *, {_PREDICTED} - (a + b * t) AS product FROM (SELECT *, {_T_DAY} AS t FROM f) WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"""SELECT * FROM (WITH {_PRODUCT} SELECT y, x, n, round(product, 3) + 0.0 AS fused_product, round(ry, 4) + 0.0 AS residual_y FROM g) /* opt_px dem */""")
def fusion_product(spark, d):
    got = _product(spark, d)
    return got.select("y", "x", "n", (F.round("fused_product", 3) + 0.0).alias("fused_product"), (F.round("residual_y", 4) + 0.0).alias("residual_y"))


def _band(error: str, n: str, mean: str, spread: str) -> str:
    return f"coalesce({error} * sqrt(1 + 1 / {n} + (t - {mean}) ^ 2 / nullif({spread}, 0)), 0)"


_DRAW = "2 * ((i * {0}::double + (y * 73 + x * 37) % 101 / 101.0::double) % 1.0::double) - 1"


@query(f"""SELECT * FROM (WITH {_PRODUCT}, w AS (SELECT g.*, coalesce((occurrence > 75)::int, 0) AS p, {_band('ry', 'n::double', 'mx', 'rx')} AS short,
    {_band('0.2::double', '9.0::double', '53.0::double', '4.0::double')} AS long FROM g LEFT JOIN occurrence USING (y, x)),
  c AS (SELECT y, x, floor(sum((product + short * 1.96::double * ({_DRAW.format(0.6180339887498949)}) + long * 1.96::double * ({_DRAW.format(0.41421356237309515)}) > 0)::int))::int AS sure
        FROM w, (SELECT unnest(range(1, 101)) AS i) GROUP BY ALL)
  SELECT y, x, (product > 0 OR p = 1)::int AS water, CASE WHEN product > 0 OR p = 1 THEN 1 - p ELSE 0 END AS flood, sure AS confidence
  FROM w JOIN c USING (y, x)) /* opt_px dem occurrence */""")
def daily_surface_water(spark, d):
    permanent = view(spark, d, "occurrence").select("y", "x", (F.col("occurrence") > 75).cast("int").alias("permanent"))
    return workflows.daily_surface_water(_product(spark, d), permanent, 0.0, "2024-01-25")


@query()
def daily_water_by_edges(spark, d):
    """With the map's own threshold."""
    permanent = view(spark, d, "occurrence").select("y", "x", (F.col("occurrence") > 75).cast("int").alias("permanent"))
    return workflows.daily_surface_water(_product(spark, d), permanent, None, "2024-01-25", length=5)


@query("""SELECT stratum, count(*) AS n, least(count(*), 20) AS n_taken FROM (SELECT least(floor(occurrence / 20), 4)::int + 1 AS stratum
  FROM opt_px JOIN occurrence USING (y, x)) GROUP BY 1""")
def fusion_samples(spark, d):
    opt, occurrence = view(spark, d, "opt_px"), view(spark, d, "occurrence")
    taken = workflows.fusion_samples(opt, occurrence, 20).groupBy("stratum").agg(F.count("*").alias("n_taken"))
    whole = opt.join(occurrence.select("y", "x", workflows.water_strata(F.col("occurrence")).alias("stratum")), ["y", "x"])
    return whole.groupBy("stratum").agg(F.count("*").alias("n")).join(taken, "stratum")


_COVER = "(y * 5 + x) % 17 + 1"
_LAND = ", ".join(map(str, workflows.LAND_CLASSES))


@query(f"""SELECT stratum, count(*) AS n, least(count(*), 20) AS n_taken FROM (
  SELECT coalesce(CASE WHEN occurrence > 30 THEN least(floor(occurrence / 20), 4)::int + 1 END, 5 + ([{_LAND}])[({_COVER})::int]) AS stratum
  FROM opt_px LEFT JOIN occurrence USING (y, x)) GROUP BY 1""")
def fusion_samples_by_cover(spark, d):
    """Water strata where water was seen, land classes elsewhere."""
    opt = view(spark, d, "opt_px")
    occurrence = view(spark, d, "occurrence").select("y", "x", F.when(F.col("occurrence") > 30, F.col("occurrence")).alias("occurrence"))
    cover = opt.select("y", "x").distinct().withColumn("cover", F.expr(_COVER))
    taken = workflows.fusion_samples(opt, occurrence, 20, cover=cover).groupBy("stratum").agg(F.count("*").alias("n_taken"))
    both = opt.join(occurrence, ["y", "x"], "left").join(cover, ["y", "x"])
    whole = both.select(workflows.strata(F.col("occurrence"), F.col("cover")).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))
    return whole.join(taken, "stratum")


def _sums():
    """A model of three outputs."""
    weights = np.array([[1.0, 0.0, 0.5], [0.0, 1.0, 0.5], [0.25, 0.25, 0.0]])
    return lambda x: x @ weights


@query("""SELECT scene_id, y, x, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class FROM (
  SELECT scene_id, y, x, nir + 0.25::double * blue AS a, red + 0.25::double * blue AS b, 0.5::double * nir + 0.5::double * red AS c FROM opt_px)""")
def apply_model(spark, d):
    return scaling.apply_model(view(spark, d, "opt_px"), ["nir", "red", "blue"], _sums, ["a", "b", "c"]).select(*YX, "class")


@query()
def water_harmonics(spark, d):
    return workflows.water_harmonics(_fused(spark, d), n_cycles=1)


@query()
def radar_water(spark, d):
    dem = view(spark, d, "dem")
    sand = view(spark, d, "occurrence").select("y", "x", F.col("occurrence").alias("sand"))
    return workflows.radar_water(view(spark, d, "sar_px"), floods.terrain(dem), dem, sand)


@query()
def semisupervised_extent(spark, d):
    got = segments.semisupervised_extent(view(spark, d, "sar_px"), ["vv", "vh"], n=200, sizes=(3, 6), trees=10)
    return rounded(got.select(*YX, "water_proba"), 4)


@query()
def kmeans_extent(spark, d):
    px = view(spark, d, "sar_px").join(view(spark, d, "dem"), ["y", "x"])
    return scaling.kmeans_extent(px, "vv", "hand", -23.3, n=200).select(*YX, "water")


def _model_query(name, fit):
    def run(spark, d):
        px = view(spark, d, "opt_px")
        assembler, model = fit(px, ["blue", "green"], "nir")
        return rounded(model.transform(assembler.transform(px)).select(*YX, "prediction"), 6)

    run.__name__ = name
    query()(run)


_model_query("random_forest", lambda px, x, y: scaling.random_forest(px, x, y, n_trees=5))
_model_query("gradient_boosting", lambda px, x, y: scaling.gradient_boosting(px, x, y, rounds=3))


@query("SELECT date_trunc('day', ts) AS day, y, x, round(avg(vv), 4) + 0.0 AS mean, count(vv) AS n FROM sar_px GROUP BY ALL")
def daily_means(spark, d):
    got = streamed_daily_means(view(spark, d, "sar_px"), "vv")
    return rounded(got.withColumn("day", F.col("day").cast("timestamp_ntz")), 4)


# --- collections ---------------------------------------------------------------------------------------

_AZIMUTH = "(100 + scene_id * 17 % 90)"
_RAY = f"sin(radians({_AZIMUTH} + 180))", f"-cos(radians({_AZIMUTH} + 180))"


@query(f"""SELECT * FROM (WITH p AS (SELECT scene_id, y, x, green, nir, qa_pixel, ((y * 7 + x * 3 + scene_id) % 10 = 0 AND qa_pixel < 64) OR (y BETWEEN 8 AND 12 AND x BETWEEN 4 AND 9) AS cloud,
    nir * 0.3::double < 0.175::double AND scene_id % 3 <> 6 AND (y + x) % 4 <> 3 AS dark, floor(x * ({_RAY[1]}) - y * ({_RAY[0]}) + 0.5) AS ray,
    round(x * ({_RAY[0]}) + y * ({_RAY[1]}), 6) AS along FROM opt_px),
  s AS (SELECT *, max(CASE WHEN cloud THEN along END) OVER (PARTITION BY scene_id, ray ORDER BY along RANGE UNBOUNDED PRECEDING) AS last FROM p),
  b AS (SELECT *, (cloud OR coalesce(along - last <= 6 AND dark, false))::int AS bad FROM s),
  c AS (SELECT a.scene_id, a.y, a.x, any_value(a.green) AS green, (any_value(a.bad) = 1 AND
        count(*) FILTER (b.bad = 0 AND (a.y - b.y) ^ 2 + (a.x - b.x) ^ 2 <= 1) = 0)::int AS core
        FROM b a JOIN b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
  SELECT a.scene_id, a.y, a.x, round(CASE WHEN count(*) FILTER (b.core = 1 AND (a.y - b.y) ^ 2 + (a.x - b.x) ^ 2 <= 4) = 0 THEN any_value(a.green) END, 9) + 0.0 AS green
  FROM c a JOIN c b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL) /* opt_px */""")
def cloud_shadow_mask(spark, d):
    """The shadow mask of the 10 m optical sensor."""
    cloud = ((F.col("y") * 7 + F.col("x") * 3 + F.col("scene_id")) % 10 == 0) & (F.col("qa_pixel") < 64)
    cloud = cloud | (F.col("y").between(8, 12) & F.col("x").between(4, 9))
    px = view(spark, d, "opt_px").withColumns({
        "cloud_probability": F.when(cloud, 90).otherwise(10), "azimuth": 100 + F.col("scene_id") * 17 % 90,
        "scl": F.when((F.col("y") + F.col("x")) % 4 == 3, 6).otherwise(4), "nir": F.col("nir") * 0.3,
    })
    return rounded(datasets.Sentinel2.shadow_mask(px, reach=6, shrink=1, grow=2).select(*YX, "green"), 9)


@query("""SELECT scene_id, count(CASE WHEN k % 5 <> 0 AND k % 7 <> 3 AND k % 11 <> 2 AND k % 13 <> 1 AND k % 17 <> 4 THEN nir END) AS n_good
  FROM (SELECT *, y * 31 + x AS k FROM opt_px) GROUP BY 1""")
def viirs_qa(spark, d):
    k = F.col("k")
    bit = lambda column, value, at: F.when(k % column == value, 1 << at).otherwise(0)
    px = view(spark, d, "opt_px").withColumn("k", F.col("y") * 31 + F.col("x"))
    px = px.withColumns({"qf1": bit(5, 0, 2) + 1, "qf2": bit(7, 3, 3) + 4, "qf3": bit(11, 2, 3) + 4, "qf4": bit(13, 1, 2) + 32, "zenith": F.when(k % 17 == 4, -7000).otherwise(5999)})
    return datasets.Viirs(px).qa(px).groupBy("scene_id").agg(F.count("nir").alias("n_good"))


@query("SELECT scene_id, count(*) AS n, round(min(vv), 6) AS least FROM sar_px WHERE scene_id % 2 = 1 GROUP BY 1")
def descending_scenes(spark, d):
    px = view(spark, d, "sar_px").withColumn("orbit", F.when(F.col("scene_id") % 2 == 0, "ASCENDING").otherwise("DESCENDING"))
    got = datasets.Sentinel1(px).pass_only(F.col("orbit"), "DESCENDING").pixels
    return rounded(got.groupBy("scene_id").agg(F.count("*").alias("n"), F.min("vv").alias("least")))


_BOXES = """SELECT n_name, n_regionkey, c_acctbal AS w, CAST(c_custkey AS DOUBLE) / 10 AS s, c_acctbal + 2 AS e, CAST(c_custkey AS DOUBLE) / 10 + 1 AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(f"SELECT round(min(w), 2) AS w, round(min(s), 2) AS s, round(max(e), 2) AS e, round(max(n), 2) AS n FROM ({_BOXES}) WHERE n_name = (SELECT min(n_name) FROM nation)")
def admin_box(spark, d):
    """The box of a named area, over all its parts."""
    customer, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    boxes = spark.sql(_BOXES.replace("customer", "{customer}", 1).replace("nation ON", "{nation} ON"), customer=customer, nation=nation)
    name = nation.agg(F.min("n_name")).first()[0]
    return rounded(datasets.admin_bbox(boxes.withColumnRenamed("n_name", "ADM1_NAME"), name), 2)
