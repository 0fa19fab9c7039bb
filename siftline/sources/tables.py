"""Reading and writing of pages, chunks and indexes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_file
from ..operators.retrieve import Indexes, Limits
from ..operators.search import BLOCK_ORDER, SHARD_CHUNKS, SearchIndex, bucketed, opened

PAGE = (
    "page_id string, url string, slug string, title string, h1 string, meta_description string, page_type string, author string, headings array<struct<level:string,text:string>>, "
    "content map<string,string>, content_sections map<string,string>, full_text string, faq array<struct<question:string,answer:string>>, keywords array<string>, "
    "internal_links array<string>, last_crawled string, content_hash string, word_count int, section_count int"
)
CHUNK = (
    "chunk_id string, page_id string, page_title string, url string, section string, section_type string, text string, word_count int, keywords array<string>, "
    "important_entities array<string>, priority_score double, content_hash string"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records of either generation from JSON files, one object each; missing fields get their defaults."""
    own = spark.read.schema(PAGE).option("multiLine", True).json(path)
    text = {c: F.coalesce(c, F.lit("")) for c in ("slug", "title", "h1", "meta_description", "page_type", "author", "full_text")}
    return own.withColumns(text).withColumn("content_sections", F.coalesce("content_sections", "content"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON files, one object each; missing lists are empty, a missing priority is 0.5."""
    own = spark.read.schema(CHUNK).option("multiLine", True).json(path)
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("keywords", "important_entities")}
    return own.withColumns(lists).withColumn("priority_score", F.coalesce("priority_score", F.lit(0.5)))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page records (url and more) as JSON lines, each with the `file` that a sink of one file a page would give it. Many pages share a file here."""
    write_json(pages.withColumn("file", page_file(F.col("url"))), path)


def write_index(index: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """An index as Parquet, sorted by its key within files, so that a lookup skips row groups."""
    dealt = index.repartitionByRange(files, key) if files else index.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, path: str, target: str, key: str, files: int) -> None:
    """An index that has grown by small files, as `files` sorted ones in another folder."""
    write_index(spark.read.parquet(path), target, key, files)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def latest_version(spark: SparkSession, folder: str) -> Row | None:
    """version, name, stemmed, n, avgdl, buckets, k1 and b of the newest complete version; of two with one number, that with the larger name."""
    done = _table(spark, f"{folder}/complete")
    return None if done is None else done.orderBy(F.desc("version"), F.desc("name")).first()


def write_snapshot(spark: SparkSession, own: Indexes, folder: str, files: int | None = None) -> int:
    """All indexes as a new version in a folder of its own name, so that two writers never share one. It is announced last: readers see it whole, or the one before."""
    last = latest_version(spark, folder)
    version, name = (last["version"] if last else 0) + 1, uuid.uuid4().hex
    for table, key in Indexes.KEYS.items():
        write_index(getattr(own, table), f"{folder}/{name}/{table}", key, files)
    found = own.search
    buckets = files or max(1, min(found.n // SHARD_CHUNKS + 1, 4096))
    bucketed(found.blocks, "shard", BLOCK_ORDER, buckets, "search_blocks", f"{folder}/{name}/search_blocks")
    write_index(found.placed, f"{folder}/{name}/search_placed", "shard", files)
    write_index(found.terms, f"{folder}/{name}/search_terms", "term", files)
    row = [(version, name, own.stemmed, found.n, found.avgdl, buckets, found.k1, found.b)]
    spark.createDataFrame(row, "version int, name string, stemmed boolean, n long, avgdl double, buckets int, k1 double, b double").coalesce(1).write.mode("append").parquet(f"{folder}/complete")
    return version


def read_snapshot(spark: SparkSession, folder: str, limits: Limits = Limits()) -> Indexes | None:
    """The newest complete version; None if there is none. Its postings are still bucketed by shard, and lengths, frequencies and the corpus are stored."""
    if (last := latest_version(spark, folder)) is None:
        return None
    read = lambda table: spark.read.parquet(f"{folder}/{last['name']}/{table}")
    place = f"{folder}/{last['name']}/search_blocks"
    blocks = opened(spark, read("search_blocks"), "shard", BLOCK_ORDER, last["buckets"], "search_blocks", place)
    stored = SearchIndex(blocks, read("search_placed"), read("search_terms"), last["n"], last["avgdl"], last["k1"], last["b"])
    return Indexes(stemmed=last["stemmed"], limits=limits, search=stored, **{table: read(table) for table in Indexes.KEYS})


def snapshot_or_build(spark: SparkSession, folder: str, build: Callable[[], Indexes]) -> Indexes:
    """The newest version of the indexes in a folder, built first if there is none."""
    if (found := read_snapshot(spark, folder)) is None:
        write_snapshot(spark, build(), folder)
        found = read_snapshot(spark, folder)
    return found
