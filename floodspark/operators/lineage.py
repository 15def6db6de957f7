"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is made only in a session on one machine that has none set: executors could not share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local-cluster") and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()
