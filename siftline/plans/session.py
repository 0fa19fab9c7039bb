"""Where intermediate results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local master has one in its warehouse if none is set."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or f"{session.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: few large row groups are dealt out before work that reads every text. Inputs with as many parts as cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
