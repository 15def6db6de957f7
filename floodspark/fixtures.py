"""Raster views derived from the raw tables: the same SQL text runs in Spark and in DuckDB.

A raster is a DataFrame with one row for each scene and pixel (scene_id, y, x), one DOUBLE column
for each band, and NULL where a pixel is masked. A scene here has 25 x 25 pixels; ``wide_px`` is one scene
that grows with the table. The cells of ``dem`` and ``occurrence`` take all rows of their tables: the highest
elevation, the least height above drainage and the greatest occurrence of the rows that fall in a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_GRID = "CAST(({k} - {k} % 625) / 625 AS BIGINT) AS scene_id, CAST(({k} % 625 - {k} % 25) / 25 AS INT) AS y, CAST({k} % 25 AS INT) AS x"

VIEWS = {
    "sar_px": f"""SELECT {_GRID.format(k='event_id')}, ts, value / 20.0 - 25.0 AS vv,
        value / 20.0 - 28.0 - user_id % 7 AS vh, CAST(29 + user_id % 18 AS DOUBLE) AS angle FROM events""",
    "opt_px": f"""SELECT scene_id, y, x, TIMESTAMP '2024-01-01 10:30:00' + CAST(scene_id % 30 AS INT) * INTERVAL '1' DAY AS ts,
        CAST(c % 997 AS DOUBLE) / 997.0 AS blue, CAST(c % 991 AS DOUBLE) / 991.0 AS green,
        CAST(c % 983 AS DOUBLE) / 983.0 AS red, CAST(c % 977 AS DOUBLE) / 977.0 AS nir,
        CAST(c % 971 AS DOUBLE) / 971.0 AS swir1, CAST(c % 967 AS DOUBLE) / 967.0 AS swir2, qa_pixel, qa_radsat
        FROM (SELECT {_GRID.format(k='o_orderkey')}, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c,
              CAST(CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 64 ELSE 64 END AS INT) AS qa_pixel,
              CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS qa_radsat FROM orders) t""",
    "dem": """SELECT CAST((k - k % 25) / 25 AS INT) AS y, CAST(k % 25 AS INT) AS x, MAX(p_retailprice - 900.0 + p_size / 10.0) AS elevation,
        CAST(MIN(p_size) AS DOUBLE) AS hand FROM (SELECT p_partkey % 625 AS k, p_retailprice, p_size FROM part) t GROUP BY k""",
    "occurrence": """SELECT CAST((k - k % 25) / 25 AS INT) AS y, CAST(k % 25 AS INT) AS x, MAX(ABS(c_acctbal)) / 100.0 AS occurrence
        FROM (SELECT c_custkey % 625 AS k, c_acctbal FROM customer) t GROUP BY k""",
    "wide_px": """SELECT CAST(0 AS BIGINT) AS scene_id, CAST((o_orderkey - o_orderkey % 300) / 300 AS INT) AS y, CAST(o_orderkey % 300 AS INT) AS x,
        CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 977 AS DOUBLE) / 977.0 AS nir FROM orders""",
    "obs": "SELECT l_suppkey AS pixel, l_shipdate AS ts, l_extendedprice AS y FROM lineitem",
}
_SOURCE = {"sar_px": "events", "opt_px": "orders", "dem": "part", "occurrence": "customer", "wide_px": "orders", "obs": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/{_SOURCE[name]}.parquet")
    sql = VIEWS[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace(f"FROM {_SOURCE[name]}", "FROM {raw}")
    return spark.sql(sql, raw=raw)


def with_views(sql: str) -> str:
    """``sql`` with the views that it names as common table expressions."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in sql]
    return f"WITH {', '.join(used)} {sql}" if used else sql
