"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's folder, or the cluster's that spark.checkpoint.dir names. Without either, the job ends here; a local master gets one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def clear(*rows: DataFrame) -> str:
    """The shortest run of underscores that begins no column of rows: helper columns named with it clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for df in rows for c in df.columns):
        prefix += "_"
    return prefix


def identity(*columns: Column) -> Column:
    """A digest of the columns' values together, by which rows are found again. Nulls and empty strings differ."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared checkpoint folder, read again."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table that written() has made."""
    context = table.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if folder is not None and str(folder.toString()).startswith(str(context.getCheckpointDir())):
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes and not only by rows, so that very long texts don't add up; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not any(key == k for k, _ in spark.sparkContext.getConf().getAll()):
        spark.conf.set(key, "16m")


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., tuple]],
    schema: str,
    piece: int = 256,
) -> DataFrame:
    """Each row of df through the function that make() returns once per task; rows move in Arrow batches.

    The function takes the columns of df in order and returns a tuple for the columns of schema. Results
    are handed back every `piece` rows, so that memory follows the longest texts and not the batch.
    """
    bounded_batches(df.sparkSession)
    target = DDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, piece):
                part = batch.slice(start, piece)
                rows = [work(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                if rows:
                    yield target.batch(list(zip(*rows)))

    return df.mapInArrow(run, schema)


class DDL:
    """Arrow types of a flat DDL string, picklable."""

    ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}

    def __init__(self, schema: str) -> None:
        pairs = [x.split() for x in schema.split(",")]
        self.names = [n for n, _ in pairs]
        self.kinds = [k for _, k in pairs]

    def arrow(self, kind: str) -> pa.DataType:
        if kind.startswith("array<"):
            return pa.list_(self.arrow(kind[6:-1]))
        return self.ARROW[kind]

    def batch(self, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, self.arrow(k)) for c, k in zip(columns, self.kinds)], names=self.names)
