"""Queries of fusion, matching, filling, baselines and metadata, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import fusion, timeseries
from ..sources import datasets
from .catalogue import _OFF_TIES_6, _OTSU, YX, query, rounded

# A second run of the threshold's common table expressions, under names of its own.
_OTSU_2 = _OTSU
_RENAMED = (
    ("h AS (", "h2 AS ("), ("FROM h\n", "FROM h2\n"), ("p AS (", "p2 AS ("), ("FROM p)", "FROM p2)"),
    ("q AS (", "q2 AS ("), ("FROM q ", "FROM q2 "), ("cut AS (", "cut2 AS ("),
)
for _a, _b in _RENAMED:
    _OTSU_2 = _OTSU_2.replace(_a, _b)


@query(f"""SELECT * FROM (WITH t AS (SELECT *, y // 5 AS ty, x // 5 AS tx, vv < -23.3::double AS low FROM sar_px),
  k AS (SELECT scene_id, ty, tx FROM t GROUP BY ALL HAVING count(*) FILTER (low) > 5 AND count(*) FILTER (NOT low) > 5),
  i AS (SELECT t.* FROM t SEMI JOIN k USING (scene_id, ty, tx)), {_OTSU.format(band='vv', source='i')},
  j AS (SELECT i.* FROM i JOIN cut USING (scene_id) WHERE vv < threshold), {_OTSU_2.format(band='vv', source='j')},
  m AS (SELECT scene_id, (cut.threshold + cut2.threshold) / 2 AS mid FROM cut JOIN cut2 USING (scene_id))
  SELECT scene_id, y, x, round(CASE WHEN vv < mid THEN 1 ELSE exp(-0.2::double * (vv - mid) ^ 2) END, 4) + 0.0 AS water
  FROM sar_px LEFT JOIN m USING (scene_id))""")
def fuzzy_otsu(spark, d):
    return rounded(fusion.fuzzy_otsu(view(spark, d, "sar_px"), "vv", -23.3, least=5).select(*YX, "water"), 4)


@query("""SELECT * FROM (WITH hp AS (SELECT nir AS v, count(*) AS n FROM opt_px GROUP BY 1), ht AS (SELECT red AS v, count(*) AS n FROM opt_px GROUP BY 1),
  cp AS (SELECT v, (sum(n) OVER (ORDER BY v) * (SELECT sum(n) FROM ht))::hugeint AS k FROM hp),
  ct AS (SELECT v, (sum(n) OVER (ORDER BY v) * (SELECT sum(n) FROM hp))::hugeint AS k FROM ht),
  m AS (SELECT cp.v, ct.v AS dn FROM cp ASOF JOIN ct ON cp.k <= ct.k)
  SELECT scene_id, y, x, round(dn, 6) + 0.0 AS dn FROM opt_px JOIN m ON nir = v) /* opt_px */""")
def histogram_matching(spark, d):
    return rounded(fusion.match_histograms(view(spark, d, "opt_px"), "nir", "red").select(*YX, "dn"))


def _stats(px, band):
    return px.groupBy("y", "x").agg(F.avg(band).alias("mean"), F.stddev_pop(band).alias("std"))


@query("""SELECT scene_id, y, x, round(greatest(-3.75::double, least(3.75::double, 0.8::double * (nir - 0.5::double) + 0.6::double * (mm - (nir - m) / nullif(s, 0) * ms + 23))), 5) + 0.0 AS df_index
  FROM opt_px JOIN (SELECT y, x, avg(nir) AS m, stddev_pop(nir) AS s FROM opt_px GROUP BY ALL) USING (y, x)
  JOIN (SELECT y, x, avg(vv) AS mm, stddev_pop(vv) AS ms FROM sar_px GROUP BY ALL) USING (y, x)""")
def pca_fusion(spark, d):
    opt, sar = view(spark, d, "opt_px"), view(spark, d, "sar_px")
    got = fusion.pca_fusion(opt, "nir", _stats(opt, "nir"), _stats(sar, "vv"), (0.5, -23.0), (0.8, 0.6))
    return rounded(got.select(*YX, "df_index"), 5)


_LEVELS = "SELECT scene_id, y, x, CASE WHEN vv >= -20 THEN elevation END AS level, (vv < -16)::int AS inside FROM sar_px JOIN dem USING (y, x)"


def _levels(spark, d):
    px = view(spark, d, "sar_px").join(view(spark, d, "dem"), ["y", "x"])
    return px.select(*YX, F.when(F.col("vv") >= -20, F.col("elevation")).alias("level"), (F.col("vv") < -16).cast("int").alias("inside"))


@query(f"""SELECT * FROM (WITH e AS ({_LEVELS}) SELECT a.scene_id, a.y, a.x, round(CASE WHEN any_value(a.inside) = 1 THEN avg(b.level) END, 5) + 0.0 AS filled
  FROM e a JOIN e b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.scene_id, a.y, a.x) /* sar_px dem */""")
def mean_fill_step(spark, d):
    return rounded(fusion.mean_fill_step(_levels(spark, d), "level", "inside", "filled").select(*YX, "filled"), 5)


@query(f"""SELECT * FROM (WITH e AS ({_LEVELS}) SELECT a.scene_id, a.y, a.x, round(CASE WHEN any_value(a.inside) = 1 THEN coalesce(
  min(b.level) FILTER (a.y = b.y AND a.x = b.x), min(b.level) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 1), min(b.level)) END, 5) + 0.0 AS filled
  FROM e a JOIN e b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.scene_id, a.y, a.x) /* sar_px dem */""")
def nearest_fill_step(spark, d):
    return rounded(fusion.nearest_fill_step(_levels(spark, d), "level", "inside", "filled").select(*YX, "filled"), 5)


_YEARS = "epoch_us(ts) / 86400000000.0::double / 365.25::double"


@query(f"""SELECT pixel, ts, y, round(pixel + 2 * t + cos(6.283185307179586::double * t) - 3 * sin(6.283185307179586::double * t), 5) + 0.0 AS predicted
  FROM (SELECT *, {_YEARS} AS t FROM obs)""")
def predict_harmonics(spark, d):
    o = timeseries.add_harmonics(timeseries.prep_inputs(view(spark, d, "obs"), ["y"]), 1)
    c = o.select("pixel").distinct().withColumns({"constant": F.col("pixel").cast("double"), "time": F.lit(2.0), "cos_1": F.lit(1.0), "sin_1": F.lit(-3.0)})
    got = timeseries.predict_harmonics(o, c, ["pixel"], ["constant", "time", "cos_1", "sin_1"])
    return got.select("pixel", "ts", "y", (F.round("predicted", 5) + 0.0).alias("predicted"))


@query(f"SELECT scene_id, y, x, round(vv - avg(vv) OVER (PARTITION BY y, x) + {_OFF_TIES_6}, 5) + 0.0 AS anomaly FROM sar_px")
def baseline_anomalies(spark, d):
    px = view(spark, d, "sar_px")
    base = px.groupBy("y", "x").agg(F.avg("vv").alias("normal"))
    got = timeseries.anomalies(px, base, ["y", "x"], "vv", "normal", "anomaly")
    return rounded(got.select(*YX, (F.col("anomaly") + _OFF_TIES_6).alias("anomaly")), 5)


@query("SELECT scene_id, y, x, round(nir * 0.9::double + 0.01::double, 6) AS nir, round(red * 1.1::double, 6) AS red FROM opt_px")
def band_pass_adjustment(spark, d):
    ds = datasets.Dataset(view(spark, d, "opt_px")).band_pass({"nir": 0.9, "red": 1.1}, {"nir": 0.01})
    return rounded(ds.pixels.select(*YX, "nir", "red"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::date END AS day FROM orders""")
def decode_date(spark, d):
    day, form = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(form == 0, F.date_format(day, "yyyyMMdd")).when(form == 1, F.date_format(day, "yyyy-MM-dd")).when(
        form == 2, F.date_format(day, "yyyy-MM-dd'T'00:00:00")
    ).otherwise("no date")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", F.to_date(datasets.decode_date(text)).alias("day"))
