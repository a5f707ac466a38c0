"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset, a session on
    one machine (master ``local``) gets a temporary folder; any other one is refused, since
    a folder of one machine would be lost with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terracell-"))
    return df.checkpoint(eager=True)
