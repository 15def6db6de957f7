"""Ranks of any number of values: running counts over range partitions, with no window over a whole table or scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def running_counts(counts: DataFrame, by: list[str], value: str, n: str = "n", out: str = "upto") -> DataFrame:
    """``counts`` with the sum of ``n`` over the rows of the same ``by`` up to each row's ``value``; values are distinct.

    Rows are dealt into ranges of (by, value), which the windows do not leave; what the ranges before add is a sum
    by range, one row for each range and group.
    """
    ranged = cut_lineage(counts.repartitionByRange(*[F.col(c) for c in [*by, value]]).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__range").agg(F.sum(n).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # At most one row for each range and group.
    joined = ranged.withColumn("__own", F.sum(n).over(within)).join(offsets, [*by, "__range"])
    return joined.withColumn(out, F.col("__own") + F.col("__offset")).drop("__own", "__offset", "__range")


def next_value(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the first non-null ``value`` at or after each row in ``order``, across ranges of rows."""
    ranged = cut_lineage(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()))
    after = Window.partitionBy("__range").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    found = ranged.withColumn("__here", F.first(value, ignorenulls=True).over(after))
    firsts = ranged.where(F.col(value).isNotNull()).groupBy("__range").agg(F.min_by(value, F.struct(*order)).alias("__first"))
    # One row for each range that has a value: no more than there are partitions.
    listed = firsts.agg(F.sort_array(F.collect_list(F.struct("__range", "__first"))).alias("__firsts"))
    later = F.filter("__firsts", lambda f: f["__range"] > F.col("__range"))
    got = found.crossJoin(F.broadcast(listed))
    return got.withColumn(out, F.coalesce("__here", F.try_element_at(later, F.lit(1))["__first"])).drop("__here", "__firsts", "__range")


def quantile(px: DataFrame, by: list[str], value: str, share: float, out: str, order: str | None = None) -> DataFrame:
    """(by, out): the value at ``share`` of each group, interpolated between neighbouring ranks; NULL values do not count.

    Exact for any values, however uneven: equal ones are counted first and the counts ranked. ``order`` may
    name a column that rises with ``value`` and is cheaper to sort; by default the values themselves.
    """
    order = order or value
    counts = px.where(F.col(value).isNotNull()).groupBy(*by, F.col(order).alias("__o")).agg(F.count("*").alias("n"), F.min(value).alias("__v"))
    ranked = running_counts(counts, by, "__o")
    total = ranked.groupBy(*by).agg(F.sum("n").alias("__n"))
    at = F.lit(float(share)) * (F.col("__n") - 1)
    placed = ranked.join(total, by).withColumn("__at", at)
    ends = [F.min(F.when(F.col("upto") > F.least(F.floor("__at") + k, F.col("__n") - 1), F.col("__v"))).alias(f"__{k}") for k in (0, 1)]
    # Only the values around the rank are left before they meet.
    near = placed.where((F.col("upto") > F.floor("__at")) & (F.col("upto") - F.col("n") <= F.floor("__at") + 1))
    found = near.groupBy(*by).agg(*ends, F.first("__at").alias("__at"))
    return found.select(*by, (F.col("__0") + (F.col("__at") - F.floor("__at")) * (F.col("__1") - F.col("__0"))).alias(out))


def cumulative_share(df: DataFrame, by: list[str], value: str, out: str = "cdf") -> DataFrame:
    """``df`` with the share of its group's rows up to each row's value; NULL values come first, as one value."""
    counts = df.groupBy(*by, F.col(value).isNotNull().alias("__known"), F.col(value).alias("__v")).agg(F.count("*").alias("n"))
    order = F.struct("__known", "__v").alias("__key")
    ranked = running_counts(counts.select(*by, "n", order), by, "__key")
    shares = ranked.join(ranked.groupBy(*by).agg(F.sum("n").alias("__n")), by).select(*by, F.col("__key.__v").alias("__v"), (F.col("upto") / F.col("__n")).alias(out))
    same = [df[c].eqNullSafe(shares[c]) for c in by] + [df[value].eqNullSafe(shares["__v"])]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(shares, condition).select(*[df[c] for c in df.columns], shares[out])
