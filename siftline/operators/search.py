"""Top-k search in postings that lie by shard.

The index deals chunks to shards of about SHARD_CHUNKS by a hash of their ids. In a shard they are numbered in the order of their ids. A row of `blocks` is one term's
postings in one shard: numbers and counts; it is a table bucketed by shard, so that searching moves no postings, and the shards' numbers are chosen so that each bucket has
one. The row of the term '' has the lengths, ids and pages of the shard's chunks. `terms` has the document frequencies; no search counts them again.

A search takes the batch's queries in parts of QUERIES to all shards; a query is its id, a few terms with their weights, and the pages that it is routed to. In a shard the
postings of a query's terms are added up in arrays, and the best of each kind of results that is asked for are kept. Where all terms must match, only the chunks of the rarest
term are looked up in the others' postings. Results of all shards meet by query.

Null and empty texts have no postings. Queries without terms have no results. Repeated terms count twice, as in the sum over all postings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpointed, shared_folder

SHARD_CHUNKS = 24_576
#: A shard's chunks are looked through by the best of groups of so many first.
GROUP = 32
QUERIES = 100_000
BLOCK_ORDER = ["shard", "term"]
#: What rounding to six places may add to a score or take from it.
ROUNDING = 1e-6


@dataclass(frozen=True)
class SearchIndex:
    """blocks (shard, term, n, nums, tfs, ids, pages), placed (shard, num, chunk_id, page_id, len), terms (term, df), and the statistics n and avgdl; k1 and b are BM25's.

    n is a term's chunks in the shard. The row of the term '' tells of a shard's chunks by number: length (nums), page (tfs, as a place in pages), id (ids).
    """

    blocks: DataFrame
    placed: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    k1: float = 1.2
    b: float = 0.75


def bucketed(rows: DataFrame, key: str, order: list[str], buckets: int, name: str, path: str | None = None, dealt: bool = False) -> DataFrame:
    """rows as a table bucketed by key and sorted within buckets, of a name of its own; at path, or in the shared folder. dealt: each task has whole buckets already, which stay in their order."""
    table = f"{name}_{uuid.uuid4().hex}"
    place = path or f"{shared_folder(rows.sparkSession)}/{table}"
    writer = rows.write.bucketBy(buckets, key) if dealt else rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order)
    writer.option("path", place).saveAsTable(table, format="parquet")
    return rows.sparkSession.table(table)


def opened(spark: SparkSession, rows: DataFrame, key: str, order: list[str], buckets: int, name: str, path: str) -> DataFrame:
    """The bucketed table whose files lie at path, for a session that doesn't know it yet. rows: the files, for the columns."""
    table = f"{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _shard_rows(rows: pa.Table) -> pa.Table:
    """A shard's bags (shard, chunk_id, page_id, terms, tfs) as postings by term, after the row that tells of its chunks."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).chunk(0)
    by_id = pc.sort_indices(column("chunk_id"))
    size = np.diff(column("terms").offsets.to_numpy())
    said = column("terms").flatten().dictionary_encode()
    code, tf = said.indices.to_numpy(), column("tfs").flatten().to_numpy()
    number = np.empty(len(size), np.int32)
    number[by_id.to_numpy()] = np.arange(len(size))
    num = np.repeat(number, size)
    order = np.argsort(code.astype(np.int64) * len(size) + num)
    ends = np.cumsum(np.bincount(code, minlength=len(said.dictionary)))
    length = np.add.reduceat(tf, np.cumsum(size) - size)[by_id.to_numpy()]  # each has a term
    page = column("page_id").take(by_id).dictionary_encode("encode")
    first = len(size)
    lists = lambda told, own: pa.ListArray.from_arrays(pa.array(np.concatenate(([0, first], first + ends)), pa.int32()), pa.array(np.concatenate((told, own[order])), pa.int32()))
    terms = pa.concat_arrays([pa.array([""]), said.dictionary.cast(pa.string())])
    rest = pa.nulls(len(ends))
    told = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), rest.cast(pa.list_(values.type))])
    return pa.table([
        pa.array(np.full(len(terms), column("shard")[0].as_py())), terms, pa.array(np.concatenate(([0], np.diff(ends, prepend=0)))), lists(length, num), lists(page.indices.to_numpy(), tf),
        told(column("chunk_id").take(by_id)), told(page.dictionary),
    ], names=["shard", "term", "n", "nums", "tfs", "ids", "pages"])


def shard_numbers(spark: SparkSession, shards: int) -> list[int]:
    """As many numbers as shards, each in a bucket of its own of as many buckets."""
    found: list[int] = []
    for most in (16, 64, 256, 1024):
        bucket = F.pmod(F.hash("id"), F.lit(shards))
        found = [r["id"] for r in spark.range(most * shards).groupBy(bucket.alias("bucket")).agg(F.min("id").alias("id")).orderBy("bucket").collect()]
        if len(found) == shards:
            return found
    return [*found, *range(-1, len(found) - shards - 1, -1)]


def search_index(postings: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75, shard_chunks: int = SHARD_CHUNKS, buckets: int | None = None) -> SearchIndex:
    """The index of postings (term, chunk_id, tf) over chunks (chunk_id, page_id)."""
    bags = postings.groupBy("chunk_id").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("l")).join(chunks.select("chunk_id", "page_id"), "chunk_id")
    return bags_index(bags.select("chunk_id", "page_id", F.col("l.term").alias("terms"), F.col("l.tf").alias("tfs")), chunks.count(), k1, b, shard_chunks, buckets)


def bags_index(bags: DataFrame, n_chunks: int, k1: float = 1.2, b: float = 0.75, shard_chunks: int = SHARD_CHUNKS, buckets: int | None = None) -> SearchIndex:
    """The index of bags (chunk_id, page_id, terms, tfs), of about n_chunks chunks. Each goes to its shard once, as one row."""
    spark = bags.sparkSession
    # As many as keep shards small, and one a core where chunks are few.
    shards = max(1, -(-n_chunks // shard_chunks), min(spark.sparkContext.defaultParallelism, -(-n_chunks // 512)))
    buckets = buckets or min(shards, 4096)
    number = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)) + 1
    named = F.element_at(F.array(*[F.lit(k).cast("long") for k in shard_numbers(spark, shards)]), number.cast("int"))
    dealt = bags.where(F.size("terms") > 0).select(named.alias("shard"), "chunk_id", "page_id", "terms", "tfs")
    kinds = dict(bags.dtypes)
    schema = f"shard long, term string, n long, nums array<int>, tfs array<int>, ids array<{kinds['chunk_id']}>, pages array<{kinds['page_id']}>"
    table = bucketed(dealt.repartition(buckets, "shard").groupBy("shard").applyInArrow(_shard_rows, schema), "shard", BLOCK_ORDER, buckets, "search_blocks", dealt=True)
    told = table.where("term = ''")
    n, total = told.agg(F.coalesce(F.sum(F.size("nums")), F.lit(0)), F.coalesce(F.sum(F.aggregate("nums", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
    each = told.select("shard", "pages", F.posexplode(F.arrays_zip("nums", "tfs", "ids")).alias("num", "x"))
    placed = each.select("shard", "num", F.col("x.ids").alias("chunk_id"), F.element_at("pages", F.col("x.tfs") + 1).alias("page_id"), F.col("x.nums").cast("long").alias("len"))
    return SearchIndex(table, placed, checkpointed(table.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))), n, total / n if n else 0.0, k1, b)


class Shard:
    """A shard's postings for the terms of a batch."""

    def __init__(self, rows: pa.Table, avgdl: float, k1: float, b: float) -> None:
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).chunk(0)
        terms = column("term").to_pylist()
        offsets = column("nums").offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        nums, tfs = column("nums").flatten().to_numpy(), column("tfs").flatten().to_numpy()
        at = terms.index("")
        own = slice(offsets[at], offsets[at + 1])
        self.page = tfs[own].astype(np.int64)
        self.ids, pages = column("ids")[at].values, column("pages")[at].values
        self.page_no = {p: k for k, p in enumerate(pages.to_pylist())}
        norm = k1 * (1 - b + b * nums[own] / avgdl)
        self.size = len(norm)
        self.nums = nums.copy()
        self.nums[own] = 0  # that row has no numbers of chunks, and is never looked at
        self.impacts = tfs * (k1 + 1) / (tfs + norm[self.nums])
        self.rows = {t: (a, e) for t, a, e in zip(terms, offsets[:-1].tolist(), offsets[1:].tolist()) if t}
        self.routed: dict[tuple, np.ndarray | None] = {}

    def inside(self, pages: list) -> np.ndarray | None:
        """Which chunks lie on the pages; None if all do."""
        own = tuple(sorted(k for k in map(self.page_no.get, pages) if k is not None))
        if own not in self.routed:
            if len(self.routed) > 256:
                self.routed.clear()
            on = np.zeros(len(self.page_no), bool)
            on[list(own)] = True
            self.routed[own] = None if on.all() else on.take(self.page)
        return self.routed[own]

    def whole(self, own: list[tuple[int, int, float]]) -> np.ndarray:
        """The chunks that all terms have, by number."""
        by_size = sorted(own, key=lambda x: x[1] - x[0])
        left = self.nums[by_size[0][0] : by_size[0][1]]
        for a, e, _ in by_size[1:]:
            if not len(left):
                break
            there = self.nums[a:e]
            at = np.searchsorted(there, left)
            at[at == len(there)] = 0
            left = left[there[at] == left]
        return left

    def whole_scores(self, own: list[tuple[int, int, float]], found: np.ndarray) -> np.ndarray:
        return sum((self.impacts[a + np.searchsorted(self.nums[a:e], found)] * w for a, e, w in own), np.zeros(len(found)))

    def best(self, terms: list[tuple[str, float]], n_terms: int, pages: list | None, kind: str, most: int, few: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int, bool, int]]:
        """num, score, n_match, inside of the `most` best chunks of each kind, and how many postings were read. pages: None if the query has none, and all count as inside."""
        own = [(*self.rows[t], w) for t, w in terms if t in self.rows]
        if not own or kind == "routed" and pages is None:
            return
        inside = None if pages is None else self.inside(pages)
        if kind == "all":
            if len(own) == n_terms and len(nums := self.whole(own)):
                score = rounded(self.whole_scores(own, nums))
                best = first_of(nums, score, most)
                yield nums[best], score[best], n_terms, True, n_terms * len(nums)
            return
        nums = np.concatenate([self.nums[a:e] for a, e, _ in own]).astype(np.int64)
        score = np.bincount(nums, np.concatenate([self.impacts[a:e] * w for a, e, w in own]), self.size)
        count = np.bincount(nums, minlength=self.size)
        given = lambda at, there: (at, rounded(score[at]), count[at], there, len(nums))
        if kind == "any" or kind == "routed":
            yield given(top(score if kind == "any" or inside is None else score * inside, most), True)
            return
        # Full matches are few, and are taken out of the others' scores. What tiers ask for: full ones outside while there are few inside,
        # others while there are few full ones, others outside while there are few inside.
        full = np.flatnonzero(count == n_terms) if len(own) == n_terms else np.zeros(0, int)
        there = np.ones(len(full), bool) if inside is None else inside[full]
        tiers = kind == "tiers"
        for is_inside in (True, False):
            at = full[there == is_inside]
            if len(at) and not (tiers and not is_inside and there.sum() >= few):
                yield given(at[first_of(at, rounded(score[at]), most)], is_inside)
        if tiers and len(full) >= few:
            return
        rest = score
        if len(full):
            rest = score.copy()
            rest[full] = 0.0
        at = top(rest if inside is None else rest * inside, most)
        if len(at):
            yield given(at, True)
        if inside is not None and not (tiers and len(at) >= few):
            yield given(top(rest * ~inside, most), False)


def top(score: np.ndarray, most: int) -> np.ndarray:
    """The numbers of the `most` best by score, rounded, and then number. Chunks that don't match have no score at all."""
    least = 0.0
    if len(score) > GROUP * most:
        # The best of `most` groups are `most` chunks, so the last place is no lower.
        groups = score[: len(score) // GROUP * GROUP].reshape(GROUP, -1).max(axis=0)
        least = np.partition(groups, len(groups) - most)[len(groups) - most] - 2 * ROUNDING
    at = np.flatnonzero(score >= least if least > 0 else score)
    return at[first_of(at, rounded(score[at]), most)]


def rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


def first_of(nums: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best by score and then number; nums ascend."""
    if len(nums) > 8 * most:
        near = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        return near[np.argsort(-score[near], kind="stable")[:most]]
    return np.argsort(-score, kind="stable")[:most]


#: Kinds of results, each with its own places: by all terms and page, the same as far as tiers of at least `few` need them, all together, with all terms only, on the query's pages only.
KINDS = ("each", "tiers", "any", "all", "routed")
FOUND = {"score": "double", "n_match": "long", "n_terms": "long", "inside": "boolean", "has_route": "boolean", "read": "long"}


def found(wanted: DataFrame, own: SearchIndex, kind: str, most: int, routes: DataFrame | None = None, queries: int = QUERIES, few: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, n_match, n_terms, whole, inside, has_route, read (postings read in the shard for the query): the best of each shard.

    wanted: query_id, term, n_terms. routes: query_id, page_id. The best `most` of all are among these; ties go to the smaller chunk_id. few: the tiers
    are made with this number, so kinds that they then don't ask for are left out; None: all four kinds.
    """
    odds = F.log((own.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = wanted.join(own.terms, "term", "left").withColumn("w", F.when(odds > 0, odds).otherwise(1e-6))
    each = F.collect_list(F.when(F.col("df").isNotNull(), F.struct("term", "w")))  # a query's few terms
    asked = weighed.groupBy("query_id").agg(F.count("*").alias("n_terms"), each.alias("l")).where(F.size("l") > 0)
    if routes is None:
        routes = wanted.select("query_id", F.lit(None).alias("page_id")).limit(0)
    asked = asked.join(routes.groupBy("query_id").agg(F.collect_list("page_id").alias("routes")), "query_id", "left")
    asked = checkpointed(asked.select("query_id", "n_terms", F.col("l.term").alias("terms"), F.col("l.w").alias("weights"), "routes"))
    parts = max(1, -(-asked.count() // queries))
    out = [_part(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k) if parts > 1 else asked, own, kind, most, few) for k in range(parts)]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def _part(asked: DataFrame, own: SearchIndex, kind: str, most: int, few: int | None) -> DataFrame:
    spark, kind = asked.sparkSession, "each" if kind == "tiers" and few is None else kind
    avgdl, k1, b, at_least = own.avgdl, own.k1, own.b, few or 0
    kinds = {"query_id": dict(asked.dtypes)["query_id"], "chunk_id": dict(own.blocks.dtypes)["ids"][len("array<") : -1]}
    if kind not in KINDS:
        raise ValueError(f"kinds are {', '.join(KINDS)}")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nums, scores, counts, insides, reads, rows = [], [], [], [], [], []
        ids = right.column("query_id").combine_chunks()
        n_terms, terms, weights, routes = (right.column(c).to_pylist() for c in ("n_terms", "terms", "weights", "routes"))
        shard = Shard(left, avgdl, k1, b) if left.num_rows else None
        for k, (n, ts, ws, pages) in enumerate(zip(n_terms, terms, weights, routes) if shard else ()):
            for num, score, count, inside, read in shard.best(list(zip(ts, ws)), n, pages, kind, most, at_least):
                nums.append(num)
                scores.append(score)
                counts.append(np.full(len(num), count) if isinstance(count, int) else count)
                insides.append(inside)
                reads.append(read)
                rows.append(k)
        if not rows:
            return pa.table({c: pa.array([], pa.int64()) for c in (*kinds, *FOUND)}).cast(empty)
        size = [len(x) for x in nums]
        row = np.repeat(rows, size)
        has = np.array([x is not None for x in routes])
        columns = [ids.take(pa.array(row)), shard.ids.take(pa.array(np.concatenate(nums))), *map(pa.array, (np.concatenate(scores), np.concatenate(counts).astype(np.int64), np.array(n_terms)[row], np.repeat(insides, size), has[row], np.repeat(reads, size)))]
        return pa.table(columns, names=[*kinds, *FOUND])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join(f"{c} {k}" for c, k in (kinds | FOUND).items())
    empty = to_arrow_schema(spark.createDataFrame([], schema).schema)
    own_terms = asked.select(F.explode("terms").alias("term")).distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    lists = own.blocks.join(F.broadcast(own_terms), "term", "left_semi").select(*own.blocks.columns)  # broadcast: terms of QUERIES queries
    to_all = asked.crossJoin(F.broadcast(own.blocks.where("term = ''").select(F.col("shard").alias("to"))))
    hits = lists.groupBy("shard").cogroup(to_all.groupBy("to")).applyInArrow(run, schema)
    return hits.withColumn("whole", F.col("n_match") == F.col("n_terms"))
