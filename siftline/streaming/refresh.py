"""Postings kept up to date with a stream of page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.index import postings
from ..plans.session import checkpointed

BUCKETS = 64
SCHEMA = "page_id string, url string, text string, last_crawled timestamp, gone boolean"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New page files (JSON lines) of a folder. Copies and late pages need no watermark, which would lose a page first seen late: the stored versions tell them."""
    return spark.readStream.schema(SCHEMA).json(folder)


def bucket(page: str = "page_id") -> Column:
    return F.pmod(F.xxhash64(page), F.lit(BUCKETS)).cast("int")


def versions(table: str) -> str:
    """The table of page_id, last_crawled, gone and bucket that says which version of each page the postings are of."""
    return f"{table}_versions"


def _overwrite(spark: SparkSession, rows: DataFrame, table: str, buckets: list[int]) -> None:
    """rows in place of what the buckets hold. A bucket that has no rows any more is emptied, which an overwrite of partitions alone wouldn't do."""
    if not spark.catalog.tableExists(table):
        rows.write.partitionBy("bucket").saveAsTable(table, format="parquet")
        return
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")  # of the batch's own session
    rows.select(spark.table(table).columns).write.insertInto(table, overwrite=True)
    for b in sorted(set(buckets) - {r["bucket"] for r in rows.select("bucket").distinct().collect()}):  # BUCKETS at most
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (bucket = {b})")


def replace_postings(batch: DataFrame, table: str) -> None:
    """The postings of the batch's pages in place of their old ones, where the batch has a newer version or the same one again.

    A page that is gone, or whose text is null or empty, leaves its version and no postings; one older than the stored version changes nothing. Only the buckets of
    changed pages are written anew. Postings are written before versions: a batch that is repeated after a crash between the two does the same again.
    """
    spark = batch.sparkSession
    newest = batch.where("page_id is not null").groupBy("page_id").agg(F.max_by(F.struct("text", F.coalesce("gone", F.lit(False)).alias("gone")), "last_crawled").alias("x"), F.max("last_crawled").alias("last_crawled"))
    newest = newest.select("page_id", "x.text", "x.gone", "last_crawled", bucket().alias("bucket"))
    known = spark.catalog.tableExists(versions(table))
    if known:
        spark.catalog.refreshTable(versions(table))
        stored = spark.table(versions(table)).select("page_id", F.col("last_crawled").alias("stored"))
        newest = newest.join(stored, "page_id", "left").where("stored is null or last_crawled >= stored").drop("stored")
    changed = checkpointed(newest)
    buckets = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # BUCKETS at most
    if not buckets:
        return
    held = changed.where("not gone").select(F.col("page_id").alias("chunk_id"), "text")
    new = postings(held, ["text"]).withColumnRenamed("chunk_id", "page_id").withColumn("bucket", bucket())
    told = changed.select("page_id", "last_crawled", "gone", "bucket")

    def with_others(rows: DataFrame, stored: str) -> DataFrame:
        if not spark.catalog.tableExists(stored):
            return rows
        spark.catalog.refreshTable(stored)  # another session may have written it
        old = spark.table(stored).where(F.col("bucket").isin(buckets)).join(changed.select("page_id"), "page_id", "left_anti")
        return checkpointed(rows.unionByName(old.select(rows.columns)))

    _overwrite(spark, with_others(new, table), table, buckets)
    _overwrite(spark, with_others(told, versions(table)), versions(table), buckets)


def start(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """All files that are there, then the end; run it again for more."""
    return (
        pages.writeStream.foreachBatch(lambda batch, _: replace_postings(batch, table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class Progress(StreamingQueryListener):
    """Follows streams: rows read so far, batches, and whether each has ended. Add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
