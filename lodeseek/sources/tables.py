"""Reading the given tables and finding the shared folder for cut lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; columns are pruned by whoever selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``. Where none is set, make one, but only if all of
    Spark runs on this machine (as in tests): a folder of one machine of a cluster is lost with it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodeseek-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A copy of ``df`` in the shared folder, so that later reads neither recompute it nor need a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
