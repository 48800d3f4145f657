"""Session and scratch-space helpers shared by every subpackage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Usual size of a Parquet row group, which is the least that a task can read.
ROW_GROUP = 128 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below ``sf_dir`` (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on.

    A small table in fewer files than the session has cores (so perhaps of one row group) is
    dealt out evenly; any other is read as it lies, without a shuffle.
    """
    table = read_table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = size < cores * ROW_GROUP and len(table.inputFiles()) < cores
    return table.repartition(cores) if small else table


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data.

    It is the one that ``spark.checkpoint.dir`` names. Only a local session without that setting
    (tests) gets a temporary folder; on a cluster that would be another one on each machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievetext-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs only a re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
