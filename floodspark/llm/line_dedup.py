"""Line deduplication by overlapping three-line windows.

Every ``window`` consecutive non-blank lines of a text form a window. Windows are compared over the
whole corpus by a 128-bit digest; the first occurrence in the order (doc_id, text digest, position)
stays, and all lines that some later occurrence covers are removed. Overlapping occurrences merge,
so a repeated passage of any length of at least three lines goes as one.

Shuffles: one of the windows with map-side minimum, one of the windows against the repeated digests
(a join, which Spark can split where one digest is hot) and one of the texts.

Defined cases: null and empty texts have no lines and pass unchanged (null stays null); texts of
fewer than three non-blank lines have no window; blank lines never count and are kept as they are;
a null doc_id sorts first; rows equal in doc_id and text count as one document, and all of them keep
or lose the same lines; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_windows(documents: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, digest, key, pos, covered): one row per window, ``covered`` its line numbers."""
    numbered = documents.select("doc_id", "text").select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("digest"),
        F.filter(
            F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at"))),
            lambda s: s["line"].rlike(r"[^\x20\x09-\x0D]"),
        ).alias("lines"),
    )
    n_windows = F.greatest(F.size("lines") - (window - 1), F.lit(0))
    parts = [F.slice("lines", F.lit(i + 1), n_windows) for i in range(window)]
    zipped = F.arrays_zip(*[p.alias(f"l{i}") for i, p in enumerate(parts)])
    names = [f"l{i}" for i in range(window)]
    rows = numbered.select("doc_id", "digest", F.posexplode(zipped).alias("pos", "w"))
    return rows.select(
        "doc_id",
        "digest",
        F.md5(F.concat_ws("\n", *[F.col(f"w.{n}.line") for n in names])).alias("key"),
        "pos",
        F.array(*[F.col(f"w.{n}.at") for n in names]).alias("covered"),
    )


def repeated_lines(documents: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, digest, removed): the line numbers (from 0) that later occurrences cover."""
    windows = line_windows(documents, window)
    first = (
        windows.groupBy("key")
        .agg(F.min(F.struct("doc_id", "digest", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", "first")
    )
    later = windows.join(first, "key").where(~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "digest").agg(
        F.array_distinct(F.flatten(F.collect_set("covered"))).alias("removed")
    )


def dedup_lines(documents: DataFrame, window: int = 3) -> DataFrame:
    """``documents`` with ``text`` cleaned, and two more columns: ``n_lines`` and ``n_removed``.

    Their names give way to columns of the input: a clash gets the suffix ``_dedup``.
    """
    taken = set(documents.columns)
    n_lines, n_removed = (c if c not in taken else f"{c}_dedup" for c in ("n_lines", "n_removed"))
    removed = repeated_lines(documents, window).select(
        F.col("doc_id").alias("__doc"), F.col("digest").alias("__key"), F.col("removed").alias("__removed")
    )
    left = documents.withColumn("__digest", F.xxhash64("doc_id", "text"))
    joined = left.join(
        removed, (left["__digest"] == removed["__key"]) & left["doc_id"].eqNullSafe(removed["__doc"]), "left"
    ).withColumn("__lines", F.split("text", "\n"))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed")),
        lambda i: F.get(F.col("__lines"), i),
    )
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lines = F.when(F.length("text") > 0, F.size("__lines")).otherwise(0).cast("long")
    out = joined.select(
        *[text.alias("text") if c == "text" else documents_col(joined, c) for c in documents.columns],
        lines.alias(n_lines),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias(n_removed),
    )
    return out


def documents_col(joined: DataFrame, name: str):
    return joined[f"`{name}`"]
