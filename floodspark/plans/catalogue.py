"""The queries of the raster operators over the derived views, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import fuzzy, pixel
from ..operators import floods, focal, ranks, scaling, threshold, timeseries
from ..sources import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
YX = ["scene_id", "y", "x"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with NaN and -0.0 made plain, for comparison with SQL."""
    return df.withColumns({c: F.round(F.nullif(F.col(c), F.lit(float("nan"))), digits) + 0.0 for c, t in df.dtypes if t == "double"})


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


# --- flagship ---------------------------------------------------------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = view(spark, sf_dir, "sar_px")
    px = datasets.Sentinel1(px).qa(px).select("scene_id", "y", "x", "vv")
    mean = focal.box_stats(px, "vv", 1, "f_").withColumn("f", F.when(F.col("vv").isNotNull(), F.round("f_mean", 4)))
    water = threshold.otsu_extent(mean, "f", width=0.25)
    counts = water.groupBy("y", "x").agg(F.sum("water").alias("n_water"), F.count("water").alias("n_valid"))
    mode = F.when(F.col("n_valid") > 0, (2 * F.col("n_water") > F.col("n_valid")).cast("int"))
    return counts.select("y", "x", F.coalesce("n_water", F.lit(0)).alias("n_water"), "n_valid", mode.alias("mode_water"))


_QA = "SELECT scene_id, y, x, CASE WHEN angle > 30.63993 AND angle < 45.23993 THEN vv END AS vv FROM sar_px"
_OTSU = """
h AS (SELECT scene_id, floor({band} / 0.25) AS bucket, count(*) AS n, avg({band}) AS mean FROM {source}
      WHERE {band} IS NOT NULL GROUP BY ALL),
p AS (SELECT *, sum(n) OVER b AS n1, sum(n * mean) OVER b AS s1, sum(n) OVER a AS n2, sum(n * mean) OVER a AS s2 FROM h
      WINDOW b AS (PARTITION BY scene_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY scene_id)),
q AS (SELECT scene_id, mean, bucket,
      coalesce(round(n1 * (s1 / n1 - s2 / n2) ^ 2 + (n2 - n1) * ((s2 - s1) / nullif(n2 - n1, 0) - s2 / n2) ^ 2, 6), -1) AS bss FROM p),
cut AS (SELECT scene_id, mean AS threshold FROM q QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY bss DESC, bucket) = 1)
"""
ORACLE_SQL["water_frequency"] = with_views(
    f"""SELECT * FROM (WITH qa AS ({_QA}),
m AS (SELECT a.scene_id, a.y, a.x, CASE WHEN any_value(a.vv) IS NOT NULL THEN round(avg(b.vv), 4) END AS f
      FROM qa a JOIN qa b ON a.scene_id = b.scene_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
      GROUP BY a.scene_id, a.y, a.x), {_OTSU.format(band='f', source='m')}
SELECT y, x, coalesce(count(*) FILTER (f < threshold), 0)::bigint AS n_water, count(f)::bigint AS n_valid,
       CASE WHEN count(f) > 0 THEN (2 * count(*) FILTER (f < threshold) > count(f))::int END AS mode_water
FROM m LEFT JOIN cut USING (scene_id) GROUP BY y, x) /* sar_px */"""
)
QUERIES["water_frequency"] = flagship


# --- pointwise ---------------------------------------------------------------------------------

_WET = "nir + swir1 + swir2"
_OPTICAL_SQL = {
    "ndvi": _div("nir - red", "nir + red"),
    "evi": _div("2.5 * (nir - red)", "nir + 6 * red - 7.5 * blue + 1"),
    "mndwi": _div("green - swir1", "green + swir1"),
    "nwi": _div(f"blue - ({_WET})", f"blue + ({_WET})"),
    "gwi": "(green + red) - (nir + swir1)",
    "aewinsh": "4 * (green - swir1) - (0.25::double * nir + 2.75::double * swir2)",
    "aewish": "blue + 2.5::double * green - 1.5::double * (nir + swir1) - 0.25::double * swir2",
    "lswi": _div("nir - swir1", "nir + swir1"),
    "wri": _div("green + red", "nir + swir1"),
    "mbwi": "3 * green - red - nir - swir1 - swir2",
    "mwi": f"1 - ({_div('nir - red', 'nir + red')} - {_div('green - swir1', 'green + swir1')})",
}
_RADAR_SQL = {
    "rvi": _div("4 * vh", "vv + vh"),
    "vv_vh_ratio": _div("vv", "vh"),
    "vv_vh_abs_sum": "abs(vv + vh)",
    "ndpi": _div("vv - vh", "vv + vh"),
    "nvvi": _div("vv", "vv + vh"),
    "nvhi": _div("vh", "vv + vh"),
}


def _index_query(name: str, source: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(pixel.add_indices(view(spark, sf_dir, source), [name]).select(*YX, name))

    run.__name__ = f"index_{name}"
    query(f"SELECT scene_id, y, x, {_r(sql, name)} FROM {source}")(run)


for _name, _sql in _OPTICAL_SQL.items():
    _index_query(_name, "opt_px", _sql)
for _name, _sql in _RADAR_SQL.items():
    _index_query(_name, "sar_px", _sql)


@query(f"""SELECT scene_id, y, x, {_r('vv * 0.0001::double + 1', 'scaled', 9)}, {_r('pow(10.0::double, vv / 10)', 'power')},
       {_r('10 * CASE WHEN angle > 0 THEN log10(angle) END', 'db')} FROM sar_px""")
def pixel_units(spark, d):
    px = view(spark, d, "sar_px")
    v = F.col("vv")
    scaled = F.round(pixel.rescale(v, 0.0001, 1.0), 9).alias("scaled")
    units = rounded(px.select(*YX, pixel.db_to_power(v).alias("power"), pixel.power_to_db(F.col("angle")).alias("db")))
    return units.join(px.select(*YX, scaled), YX)


@query("SELECT scene_id, y, x, (qa_pixel & 8)::int AS one, ((qa_pixel & 12) >> 2)::int AS two FROM opt_px")
def extract_bits(spark, d):
    px = view(spark, d, "opt_px")
    q = F.col("qa_pixel")
    return px.select(*YX, pixel.extract_bits(q, 3).cast("int").alias("one"), pixel.extract_bits(q, 2, 4).cast("int").alias("two"))


_FUZZY_SQL = {
    "gaussian": "exp(-2.0::double * (nir - 0.5::double) ^ 2)",
    "near": "1 / (1 + 2.0::double * (nir - 0.5::double) ^ 2)",
    "large": "1 / (1 + nullif(CASE WHEN nir > 0 THEN pow(nir / 0.5::double, -2.0::double) END, 0))",
    "small": "1 / (1 + pow(nir / 0.5::double, 2.0::double))",
    "linear": "greatest(0, least(1, (nir - 0.2::double) / (0.8::double - 0.2::double)))",
    "zmf": """CASE WHEN nir < 0.2::double THEN 1 WHEN nir >= 0.8::double THEN 0 WHEN nir < (0.2::double + 0.8::double) / 2
        THEN 1 - 2 * ((nir - 0.2::double) / (0.8::double - 0.2::double)) ^ 2
        ELSE 2 * ((nir - 0.8::double) / (0.8::double - 0.2::double)) ^ 2 END""",
    "either": "greatest(nir, red, blue)",
    "both": "least(nir, red, blue)",
    "product": "nir * red * blue",
    "total": "1 - (1 - nir) * (1 - red) * (1 - blue)",
    "gamma": "pow(1 - (1 - nir) * (1 - red) * (1 - blue), 0.5::double) * pow(nir * red * blue, 0.5::double)",
    "weighted": "nir * 0.5::double + red * 0.3::double + blue * 0.2::double",
}


@query(f"SELECT scene_id, y, x, {', '.join(_r(s, n) for n, s in _FUZZY_SQL.items())} FROM opt_px WHERE nir > 0")
def fuzzy_memberships(spark, d):
    x, layers = F.col("nir"), [F.col(b) for b in ("nir", "red", "blue")]
    out = {
        "gaussian": fuzzy.gaussian(x, 0.5, 2.0), "near": fuzzy.near(x, 0.5, 2.0), "large": fuzzy.large(x, 0.5, 2.0),
        "small": fuzzy.small(x, 0.5, 2.0), "linear": fuzzy.linear(x, 0.2, 0.8), "zmf": fuzzy.zmf(x, 0.2, 0.8),
        "either": fuzzy.fuzzy_or(*layers), "both": fuzzy.fuzzy_and(*layers), "product": fuzzy.product(*layers),
        "total": fuzzy.fuzzy_sum(*layers), "gamma": fuzzy.gamma(*layers), "weighted": fuzzy.weighted(layers, [0.5, 0.3, 0.2]),
    }
    return rounded(view(spark, d, "opt_px").where("nir > 0").select(*YX, *[c.cast("double").alias(n) for n, c in out.items()]))


@query(f"""SELECT scene_id, y, x, {_r('(1 - s / nullif(nir - m + s, 0)) * (nir >= m)::int', 'mslarge', 4)},
       {_r('(s / nullif(nir - m + s, 0)) * (nir >= m)::int', 'mssmall', 4)}
       FROM (SELECT *, avg(nir) OVER (PARTITION BY scene_id) AS m, stddev_pop(nir) OVER (PARTITION BY scene_id) AS s FROM opt_px)""")
def fuzzy_by_moments(spark, d):
    px = view(spark, d, "opt_px")
    return rounded(fuzzy.mssmall(fuzzy.mslarge(px, "nir", "mslarge"), "nir", "mssmall").select(*YX, "mslarge", "mssmall"), 4)


@query("""SELECT scene_id, y, x, ((nir + 0.00135::double) / nullif(red + 0.10811::double, 0) < 0.7 AND red < 0.2027 AND swir2 < 0.06757)::int AS flood
       FROM opt_px""")
def modis_flood(spark, d):
    return view(spark, d, "opt_px").select(*YX, threshold.modis_flood().alias("flood"))


# --- datasets -----------------------------------------------------------------------------------

@query("""SELECT scene_id, count(*) AS n, count(CASE WHEN (qa_pixel & 63) = 0 AND qa_radsat = 0 THEN nir END) AS n_good FROM opt_px GROUP BY 1""")
def landsat_qa(spark, d):
    px = view(spark, d, "opt_px")
    return datasets.Landsat(px).qa(px).groupBy("scene_id").agg(F.count("*").alias("n"), F.count("nir").alias("n_good"))


@query("""SELECT scene_id, count(CASE WHEN angle > 30.63993 AND angle < 45.23993 THEN vv END) AS n_good,
       CASE WHEN scene_id % 2 = 0 THEN 1 ELSE 0 END AS orbit_band FROM sar_px GROUP BY scene_id""")
def sentinel1_qa(spark, d):
    px = view(spark, d, "sar_px").withColumn("orbit", F.when(F.col("scene_id") % 2 == 0, "ASCENDING").otherwise("DESCENDING"))
    good = datasets.Sentinel1.add_orbit_band(datasets.Sentinel1(px).qa(px))
    return good.groupBy("scene_id").agg(F.count("vv").alias("n_good"), F.max("orbit_band").alias("orbit_band"))


@query("SELECT scene_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS date FROM sar_px GROUP BY 1")
def scene_dates(spark, d):
    return datasets.Dataset.load(view(spark, d, "sar_px")).dates()


@query("""SELECT scene_id, count(*) AS n FROM opt_px WHERE y BETWEEN 5 AND 14 AND x BETWEEN 3 AND 19
       AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def load_region_period(spark, d):
    ds = datasets.Dataset.load(view(spark, d, "opt_px"), (5, 3, 15, 20), "2024-01-05", "2024-01-20")
    return ds.pixels.groupBy("scene_id").agg(F.count("*").alias("n"))


@query("SELECT scene_id, count(*) AS n, count(vv) AS n_vv, count(nir) AS n_nir FROM (SELECT scene_id, vv, NULL AS nir FROM sar_px UNION ALL SELECT scene_id + 1000, NULL, nir FROM opt_px) GROUP BY 1")
def merge_collections(spark, d):
    a = datasets.Dataset(view(spark, d, "sar_px").select("scene_id", "y", "x", "ts", "vv"))
    b = datasets.Dataset(view(spark, d, "opt_px").select((F.col("scene_id") + 1000).alias("scene_id"), "y", "x", "ts", "nir"))
    return a.merge(b).pixels.groupBy("scene_id").agg(F.count("*").alias("n"), F.count("vv").alias("n_vv"), F.count("nir").alias("n_nir"))


_SCENES = "SELECT scene_id, min(ts) AS ts, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM {} GROUP BY 1"


@query(f"""SELECT a.scene_id, b.scene_id AS other_id FROM ({_SCENES.format('opt_px')}) a JOIN ({_SCENES.format('sar_px')}) b
       ON b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 1 DAY AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.x0 <= b.x1 AND b.x0 <= a.x1""")
def join_pairs(spark, d):
    a, b = (datasets.Dataset(view(spark, d, n)) for n in ("opt_px", "sar_px"))
    return a.pairs(b).select("scene_id", "other_id")


@query(f"""SELECT o.scene_id, o.y, o.x, round(s.vv, 6) AS vv FROM opt_px o JOIN (
       SELECT p.scene_id, s.y, s.x, arg_max(s.vv, p.k) AS vv FROM (
         SELECT a.scene_id, b.scene_id AS other_id, (epoch_us(b.ts)::hugeint * 100000 + b.scene_id) AS k
         FROM ({_SCENES.format('opt_px')}) a JOIN ({_SCENES.format('sar_px')}) b
         ON b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 1 DAY) p JOIN sar_px s ON s.scene_id = p.other_id
       GROUP BY ALL) s USING (scene_id, y, x)""")
def join_collections(spark, d):
    a = datasets.Dataset(view(spark, d, "opt_px").select("scene_id", "y", "x", "ts", "nir"))
    b = datasets.Dataset(view(spark, d, "sar_px").select("scene_id", "y", "x", "ts", "vv"))
    return rounded(a.join(b).pixels.select(*YX, "vv"))


@query("SELECT date_trunc('day', ts) AS ts, y, x, round(avg(vv), 4) + 0.0 AS vv FROM sar_px GROUP BY ALL")
def aggregate_daily(spark, d):
    ds = datasets.Dataset(view(spark, d, "sar_px").select("scene_id", "y", "x", "ts", "vv"))
    return rounded(ds.aggregate_time().withColumn("ts", F.col("ts").cast("timestamp_ntz")), 4)


@query("""SELECT y, x, max(vv) AS hi, min(vv) AS lo, count(vv) AS n, round(quantile_cont(vv, 0.5), 6) AS med, round(arg_max(vv, epoch_us(ts)), 6) AS top
       FROM sar_px GROUP BY ALL""")
def collection_reducers(spark, d):
    ds = datasets.Dataset(view(spark, d, "sar_px").select("scene_id", "y", "x", "ts", "vv"))
    v = F.col("vv")
    out = ds.reduce(hi=F.max(v), lo=F.min(v), n=F.count(v), med=F.round(F.percentile(v, F.lit(0.5)), 6))
    return out.join(ds.mosaic().select("y", "x", F.round("vv", 6).alias("top")), ["y", "x"])


@query("""SELECT scene_id // 2 AS take, y, x, round(arg_max(nir, scene_id), 6) AS nir, count(*) AS n FROM opt_px GROUP BY ALL""")
def deduplicate(spark, d):
    px = view(spark, d, "opt_px")
    out = datasets.deduplicate(px, F.floor(F.col("scene_id") / 2), F.col("scene_id"), ["nir"])
    n = px.groupBy(F.floor(F.col("scene_id") / 2).alias("take"), "y", "x").agg(F.count("*").alias("n"))
    return out.join(n, ["take", "y", "x"]).select("take", "y", "x", F.round("nir", 6).alias("nir"), "n")


@query("""SELECT w, s, w + 0.5 AS e, s + 0.5 AS n FROM (SELECT unnest(range(204, 216)) * 0.5::double AS w), (SELECT unnest(range(20, 30)) * 0.5::double AS s)""")
def tile_region(spark, d):
    return datasets.tile_region(spark, (102.3335, 10.4045, 107.6277, 14.69), 0.5)


# Means and variances of decimals often end in an exact 5 at the digit that is rounded, where the order of a
# sum decides. Both sides of ``focal_box`` and ``yearly_anomalies`` add a constant that is off that grid.
_OFF_TIES_8, _OFF_TIES_6 = 3e-11, 1e-9


# --- focal and thresholds --------------------------------------------------------------------------

@query(f"""SELECT a.scene_id, a.y, a.x, round(avg(b.vv) + {_OFF_TIES_8}, 8) + 0.0 AS mean, round(var_pop(b.vv) + {_OFF_TIES_8}, 8) + 0.0 AS var, count(b.vv) AS count
       FROM sar_px a JOIN sar_px b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL""")
def focal_box(spark, d):
    got = focal.box_stats(view(spark, d, "sar_px"), "vv", 1)
    return rounded(got.select(*YX, *[(F.col(c) + _OFF_TIES_8).alias(c) for c in ("mean", "var")], "count"), 8)


@query("""SELECT scene_id, y, x, round((a + b) / 2, 8) + 0.0 AS med FROM (SELECT a.scene_id, a.y, a.x,
       quantile_cont(b.vv, 0.5) FILTER (a.y = b.y OR a.x = b.x) AS a, quantile_cont(b.vv, 0.5) FILTER (abs(a.y - b.y) = abs(a.x - b.x)) AS b
       FROM sar_px a JOIN sar_px b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)""")
def p_median(spark, d):
    return rounded(focal.p_median(view(spark, d, "sar_px"), "vv", "med").select(*YX, "med"), 8)


_BINARY = "SELECT scene_id, y, x, (vv < -20)::int AS w FROM sar_px"
_STEP = "SELECT a.scene_id, a.y, a.x, {f}(b.{c}) AS {out} FROM {t} a JOIN {t} b ON a.scene_id = b.scene_id AND (a.y - b.y) ^ 2 + (a.x - b.x) ^ 2 {op} 4 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL"


@query(f"SELECT * FROM (WITH b AS ({_BINARY}), e AS ({_STEP.format(f='min', c='w', out='e', t='b', op='<=')}) {_STEP.format(f='max', c='e', out='opened', t='e', op='<')}) /* sar_px */")
def open_binary(spark, d):
    px = view(spark, d, "sar_px").select(*YX, (F.col("vv") < -20).cast("int").alias("w"))
    return focal.open_binary(px, "w", "opened", 2).select(*YX, "opened")


@query(f"SELECT * FROM (WITH b AS ({_BINARY}), e AS ({_STEP.format(f='max', c='w', out='e', t='b', op='<')}) {_STEP.format(f='min', c='e', out='closed', t='e', op='<=')}) /* sar_px */")
def close_binary(spark, d):
    px = view(spark, d, "sar_px").select(*YX, (F.col("vv") < -20).cast("int").alias("w"))
    return focal.close_binary(px, "w", "closed", 2).select(*YX, "closed")


@query(f"SELECT * FROM (WITH s AS (SELECT * FROM sar_px), {_OTSU.format(band='vv', source='s')} SELECT scene_id, round(threshold, 4) + 0.0 AS threshold FROM cut)")
def otsu(spark, d):
    px = view(spark, d, "sar_px")
    return rounded(threshold.otsu(threshold.histogram(px, "vv", 0.25, ["scene_id"]), ["scene_id"]), 4)


@query(f"""SELECT * FROM (WITH m AS (SELECT scene_id, min(floor(vv * 512)) AS a, max(floor(vv * 512)) AS b FROM sar_px WHERE vv IS NOT NULL GROUP BY 1),
  w AS (SELECT scene_id, min(k) AS k FROM m, (SELECT unnest(range(0, 60)) AS k) WHERE floor(b / pow(2, k)) - floor(a / pow(2, k)) < 256 GROUP BY 1),
  h AS (SELECT scene_id, floor(floor(vv * 512) / pow(2, k)) AS bucket, count(*) AS n, avg(vv) AS mean FROM sar_px JOIN w USING (scene_id) WHERE vv IS NOT NULL GROUP BY ALL),
  {_OTSU[_OTSU.index('p AS ('):]} SELECT scene_id, round(threshold, 4) + 0.0 AS threshold FROM cut) /* sar_px */""")
def otsu_adaptive(spark, d):
    """Buckets whose width doubles while a scene has more than 256."""
    px = view(spark, d, "sar_px")
    return rounded(threshold.otsu(threshold.adaptive_histogram(px, "vv", ["scene_id"]), ["scene_id"]), 4)


@query(f"""SELECT * FROM (WITH t AS (SELECT *, y // 5 AS ty, x // 5 AS tx, vv < -23.3::double AS low FROM sar_px),
  s AS (SELECT scene_id, ty, tx, avg(low::int) AS p, coalesce(avg(vv) FILTER (low), -25) AS m1, coalesce(avg(vv) FILTER (NOT low), 0) AS m2, var_pop(vv) AS v FROM t GROUP BY ALL),
  k AS (SELECT scene_id, ty, tx, round((CASE WHEN p = 0 THEN 0.9999 ELSE p END) * (1 - (CASE WHEN p = 0 THEN 0.9999 ELSE p END)) * (m1 - m2) ^ 2 / (CASE WHEN v = 0 THEN 2 ELSE v END), 6) AS bmax FROM s),
  c AS (SELECT scene_id, ty, tx FROM k WHERE bmax > 0.5 QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY bmax DESC, ty, tx) <= 10),
  i AS (SELECT t.* FROM t SEMI JOIN c USING (scene_id, ty, tx)), {_OTSU.format(band='vv', source='i')}
  SELECT scene_id, round(threshold, 4) + 0.0 AS threshold FROM cut) /* sar_px */""")
def bmax_otsu(spark, d):
    return rounded(threshold.bmax_otsu(view(spark, d, "sar_px"), "vv", -23.3, least=0.5, max_boxes=10), 4)


def _scored(grid: int, least: float) -> str:
    """The squares of ``grid`` pixels that are bimodal."""
    p = "(CASE WHEN p = 0 THEN 0.9999 ELSE p END)"
    return f"""SELECT scene_id, ty, tx, round({p} * (1 - {p}) * (m1 - m2) ^ 2 / (CASE WHEN v = 0 THEN 2 ELSE v END), 6) AS bmax FROM (
      SELECT scene_id, y // {grid} AS ty, x // {grid} AS tx, avg((vv < -23.3::double)::int) AS p, coalesce(avg(vv) FILTER (vv < -23.3::double), -25) AS m1,
             coalesce(avg(vv) FILTER (vv >= -23.3::double), 0) AS m2, var_pop(vv) AS v FROM sar_px GROUP BY ALL) WHERE bmax > {least}"""


@query(f"""SELECT * FROM (WITH a AS ({_scored(8, 0.45)}), b AS ({_scored(4, 0.45)}), c AS ({_scored(2, 0.45)}),
  k AS (SELECT c.* FROM c SEMI JOIN (SELECT b.* FROM b SEMI JOIN a ON a.scene_id = b.scene_id AND a.ty = b.ty // 2 AND a.tx = b.tx // 2) b
        ON b.scene_id = c.scene_id AND b.ty = c.ty // 2 AND b.tx = c.tx // 2),
  r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY bmax DESC, ty, tx) <= 100),
  i AS (SELECT s.* FROM sar_px s SEMI JOIN r ON r.scene_id = s.scene_id AND r.ty = s.y // 2 AND r.tx = s.x // 2), {_OTSU.format(band='vv', source='i')}
  SELECT scene_id, y, x, (vv > coalesce(threshold, -20))::int AS water FROM sar_px LEFT JOIN cut USING (scene_id))""")
def bmax_otsu_iters(spark, d):
    """Three grids, each half of the one before; water above the threshold, -20 where no square is bimodal."""
    px = view(spark, d, "sar_px")
    cuts = threshold.bmax_otsu(px, "vv", -23.3, grid=8, least=0.45, iters=3, thresh_no_data=-20.0)
    return threshold.threshold_extent(px, "vv", cuts, invert=True).select(*YX, "water")


# --- time series ----------------------------------------------------------------------------------

_TIME = "epoch_us(ts) / 86400000000.0::double / 365.25::double"


def _obs(spark, d):
    return timeseries.prep_inputs(view(spark, d, "obs"), ["y"])


@query(f"SELECT pixel, round(regr_intercept(y, t), 2) + 0.0 AS constant, round(regr_slope(y, t), 4) + 0.0 AS time, count(*) AS n FROM (SELECT *, {_TIME} AS t FROM obs) GROUP BY 1")
def linear_trend(spark, d):
    got = timeseries.linear_trend(_obs(spark, d), ["pixel"], "y")
    return got.select("pixel", (F.round("constant", 2) + 0.0).alias("constant"), (F.round("time", 4) + 0.0).alias("time"), "n")


@query(f"""SELECT pixel, count(*) AS n, round(sum(t), 3) AS st, round(sum(cos({2 * pi} * t)), 4) + 0.0 AS sc, round(sum(y * sin({4 * pi} * t)) / 1000, 2) + 0.0 AS sy
       FROM (SELECT *, {_TIME} AS t FROM obs) GROUP BY 1""")
def harmonic_sums(spark, d):
    o = timeseries.add_harmonics(_obs(spark, d))
    g = timeseries.gram(o, ["pixel"], ["constant", "time", "cos_1", "sin_1", "cos_2", "sin_2"], "y")
    return g.select("pixel", "n", F.round("g_0_1", 3).alias("st"), (F.round("g_0_2", 4) + 0.0).alias("sc"), (F.round(F.col("h_5") / 1000, 2) + 0.0).alias("sy"))


@query()
def harmonic_trend(spark, d):
    return rounded(timeseries.harmonic_trend(timeseries.add_harmonics(_obs(spark, d)), ["pixel"], "y"), 3)


@query(f"""SELECT * FROM (WITH o AS (SELECT pixel, y, {_TIME} AS t FROM obs),
  s AS (SELECT a.pixel, quantile_cont((b.y - a.y) / (b.t - a.t), 0.5) AS m FROM o a JOIN o b ON a.pixel = b.pixel AND b.t > a.t GROUP BY 1)
  SELECT o.pixel, round(any_value(m), 4) + 0.0 AS time FROM o JOIN s USING (pixel) GROUP BY 1) /* obs */""")
def sen_slope(spark, d):
    return timeseries.sen_slope(_obs(spark, d), ["pixel"], "y").select("pixel", (F.round("time", 4) + 0.0).alias("time"))


@query("SELECT pixel, ts, y, count(y) OVER w AS n, min(y) OVER w AS lo FROM obs WINDOW w AS (PARTITION BY pixel ORDER BY epoch_us(ts) RANGE BETWEEN 432000000000 PRECEDING AND 431999999999 FOLLOWING)")
def temporal_smoothing(spark, d):
    o = view(spark, d, "obs")
    return timeseries.temporal_smoothing(timeseries.temporal_smoothing(o, ["pixel"], "y", "n", 10, F.count), ["pixel"], "y", "lo", 10, F.min)


@query("""SELECT pixel, count(*) AS n, count(CASE WHEN y > a - 1.5 * (b - a) AND y < b + 1.5 * (b - a) THEN 1 END) AS n_kept
       FROM (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY pixel) AS a, quantile_cont(y, 0.75) OVER (PARTITION BY pixel) AS b FROM obs) GROUP BY 1""")
def temporal_iqr_filter(spark, d):
    return timeseries.iqr_filter(view(spark, d, "obs"), ["pixel"], ["y"]).groupBy("pixel").agg(F.count("*").alias("n"), F.count("y").alias("n_kept"))


@query(f"SELECT pixel, ts, y, round(y - avg(y) OVER w + {_OFF_TIES_6}, 6) + 0.0 AS y_mean, round(y - quantile_cont(y, 0.05) OVER w + {_OFF_TIES_6}, 6) + 0.0 AS y_p5 FROM obs WINDOW w AS (PARTITION BY pixel, year(ts))")
def yearly_anomalies(spark, d):
    got = timeseries.yearly_anomalies(view(spark, d, "obs"), ["pixel"], ["y"])
    return got.select("pixel", "ts", "y", *[(F.round(F.col(c) + _OFF_TIES_6, 6) + 0.0).alias(c) for c in ("y_mean", "y_p5")])


@query(f"""SELECT day, 1.0::double AS constant, round({_TIME.replace('ts', 'day')}, 6) AS time
       FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-03-02', INTERVAL 1 DAY))::date AS day)""")
def dummy_days(spark, d):
    return rounded(timeseries.dummy_days(spark, "2024-01-01", "2024-03-01"))


# --- floods, terrain, fusion ------------------------------------------------------------------------

@query("""SELECT s.scene_id, s.y, s.x, CASE WHEN s.vv IS NOT NULL THEN ((s.vv < -20)::int + 2 * coalesce((occurrence > 75)::int, 0) = 1)::int END AS flood
       FROM sar_px s LEFT JOIN occurrence USING (y, x)""")
def extract_flood(spark, d):
    px = view(spark, d, "sar_px").withColumn("w", (F.col("vv") < -20).cast("int"))
    return floods.extract_flood(px, "w", view(spark, d, "occurrence")).select(*YX, "flood")


@query("SELECT y, x, date_diff('day', min(ts::date), max(ts::date))::int AS days FROM sar_px WHERE vv < -20 GROUP BY ALL")
def flood_duration(spark, d):
    return floods.flood_duration(view(spark, d, "sar_px").withColumn("w", (F.col("vv") < -20).cast("int")), "w")


@query(f"SELECT scene_id, y, x, {_r('log10(sqrt(pow(10.0::double, vv / 10)) / sqrt(pow(10.0::double, vh / 10)))', 'ratio')} FROM sar_px")
def log_amplitude_ratio(spark, d):
    return rounded(view(spark, d, "sar_px").select(*YX, floods.log_amplitude_ratio(F.col("vv"), F.col("vh")).alias("ratio")))


@query("""SELECT * FROM (WITH d AS (SELECT scene_id, y, x, elevation AS z, CASE WHEN red < 0.4 THEN 0 ELSE nir END AS f FROM opt_px JOIN dem USING (y, x)),
  r AS (SELECT a.scene_id, a.y, a.x, any_value(a.z) AS z, any_value(a.f) AS f, min(b.z) FILTER (b.f > 0) AS lo, max(b.z) FILTER (b.f > 0) AS hi
        FROM d a JOIN d b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)
  SELECT scene_id, y, x, (z >= lo AND z < lo + (hi - lo) * f)::int AS water FROM r) /* opt_px dem */""")
def downscale_fraction(spark, d):
    px = view(spark, d, "opt_px").withColumn("f", F.when(F.col("red") < 0.4, 0.0).otherwise(F.col("nir")))
    return floods.downscale_fraction(px, "f", view(spark, d, "dem"), 2).select(*YX, "water")


@query("SELECT y, x, round(arg_max(nir, epoch_us(ts)::hugeint * 100000 + scene_id), 6) AS nir FROM opt_px WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2023-11-20' GROUP BY ALL")
def latest_before(spark, d):
    return rounded(floods.latest_before(view(spark, d, "opt_px"), "nir", "2024-01-20"))


# --- scaling -----------------------------------------------------------------------------------------

@query(f"SELECT scene_id, y, x, {_r('(nir - a) / nullif(b - a, 0)', 'nir')} FROM opt_px, (SELECT min(nir) AS a, max(nir) AS b FROM opt_px)")
def minmax_scaling(spark, d):
    px = view(spark, d, "opt_px")
    return rounded(scaling.scale(px, ["nir"], scaling.minmax_dict(px, ["nir"])).select(*YX, "nir"))


@query("SELECT scene_id, y, x, round((nir - a) / nullif(b, 0), 4) + 0.0 AS nir FROM opt_px, (SELECT avg(nir) AS a, stddev_pop(nir) AS b FROM opt_px)")
def standard_scaling(spark, d):
    px = view(spark, d, "opt_px")
    return rounded(scaling.scale(px, ["nir"], scaling.standard_dict(px, ["nir"]), "standard").select(*YX, "nir"), 4)


@query("SELECT vec_id, " + ", ".join(f"(label = {i})::int AS b{i}" for i in range(10)) + " FROM embeddings")
def onehot_encoding(spark, d):
    return scaling.onehot(spark.read.parquet(f"{d}/embeddings.parquet"), "label", list(range(10))).select("vec_id", *[f"b{i}" for i in range(10)])


@query("SELECT round(covar_pop(nir, nir), 6) AS nir_nir, round(covar_pop(nir, red), 6) + 0.0 AS nir_red, round(covar_pop(red, red), 6) AS red_red FROM opt_px")
def covariance(spark, d):
    return rounded(scaling.covariance(view(spark, d, "opt_px"), ["nir", "red"]))


@query("SELECT scene_id, y, x, round(cume_dist() OVER (PARTITION BY scene_id ORDER BY nir), 6) AS cdf FROM opt_px")
def cumulative_share(spark, d):
    return rounded(ranks.cumulative_share(view(spark, d, "opt_px"), ["scene_id"], "nir").select(*YX, "cdf"))


@query("SELECT scene_id, y, x, CASE WHEN nir >= red AND nir >= blue THEN 0 WHEN red >= blue THEN 1 ELSE 2 END AS best FROM opt_px")
def argmax(spark, d):
    return view(spark, d, "opt_px").select(*YX, scaling.argmax(["nir", "red", "blue"]).alias("best"))


_SPREAD = "(a - c) / 2"


@query(f"""SELECT * FROM (WITH s AS (SELECT avg(nir) AS mn, avg(red) AS mr, var_pop(nir) AS a, covar_pop(nir, red) AS b, var_pop(red) AS c FROM opt_px),
  e AS (SELECT *, (a + c) / 2 + sqrt({_SPREAD} * {_SPREAD} + b * b) AS top FROM s), v AS (SELECT *, b AS x, top - a AS y FROM e),
  u AS (SELECT *, x / sqrt(x * x + y * y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS wn,
               y / sqrt(x * x + y * y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS wr FROM v)
  SELECT scene_id, o.y, o.x, round(((nir - mn) * wn + (red - mr) * wr) / sqrt(top), 4) + 0.0 AS pc_0 FROM opt_px o, u) /* opt_px */""")
def pca(spark, d):
    px, names = view(spark, d, "opt_px"), ["nir", "red"]
    centre, components, values = scaling.pca(px, names)
    return rounded(scaling.apply_pca(px, names, centre, components, values).select(*YX, "pc_0"), 4)


@query()
def pca_bands(spark, d):
    """All six bands; tests compare both methods."""
    px, names = view(spark, d, "opt_px"), list(datasets.OPTICAL_BANDS)
    centre, components, values = scaling.pca(px, names)
    return rounded(scaling.apply_pca(px, names, centre, components, values).select(*YX, *[f"pc_{i}" for i in range(len(names))]), 4)
