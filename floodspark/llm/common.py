"""Shared helpers of the text operators: lineage cuts, label joins, bounded samples."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(df: DataFrame) -> str:
    """The checkpoint folder, set if it is not.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only a session on one
    machine may leave that unset, and gets a temporary folder: executors could not share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that driver and executors share."""
    _shared_folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again: smaller than a checkpoint."""
    path = f"{_shared_folder(df)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Bounds the bytes of the Arrow batches of what is computed within it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (never more), chosen by a hash of ``key``; all rows when there are fewer.

    The choice depends on the key alone, so it is the same for any partitioning.
    """
    n = rows.count()
    if n > bound:
        share = int(1_000_000 * 0.97 * bound / n)
        rows = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < share)
    return rows.limit(bound)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the held-out fold.

    Null labels and null ids are left out; of repeated label rows of one document the largest
    label counts, and of repeated rows of one doc_id the text that sorts first. The chosen labels are
    bounded by ``bound`` and therefore safe to broadcast.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(fold("doc_id", folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = bounded_sample(known, "doc_id", bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
