"""Ranked lexical search by hybrid TAAT-DAAT over index segments.

1. Index: the documents of a partition go into segments of SEGMENT_BYTES of text. A segment holds, for each term that a query has, its documents
   (ordinals, ascending) and frequencies, and each document's length. It is one row of a table in the shared folder.
2. Statistics: the number of documents with terms, their lengths and each query term's document frequency are summed over all segments.
3. Search, segment by segment, with each query's best so far kept for its threshold. Lists that hold at most one document in SHORT are read whole,
   term at a time: their summed accumulators become one list. It and the long lists are then read together, document at a time in blocks of BLOCK
   ordinals. Every list has its largest contribution a block; a block whose bounds sum up to less than the threshold is skipped in all lists.
4. The best of all segments meet by query in two steps, first within groups of segments, so that no task gets a query's rows from all of them.

Scores are 64-bit integers, so neither order of summation nor partitions change them. The queries' terms are taken from the driver in blocks of about
QUERY_TERMS (query, term) pairs; each block has its own index, which holds its terms only.

Null texts have no terms; documents and items without terms are in no result. Rows of documents are documents, also when they repeat: each takes a
place. A null doc_id comes after all others in ties. Rows of one item_id, null included, are one item with all their terms. Texts are read whole, one at a
time; a text beyond SEGMENT_BYTES is a segment of its own. Empty tables give an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DDL, bounded_batches, dropped, table, written

TOP = 50
SEGMENT_BYTES = 32_000_000
QUERY_TERMS = 200_000
#: A list is short if it holds at most one in so many of a segment's documents.
SHORT = 32
#: Ordinals in a block, and blocks that are read before the threshold is looked at again.
BLOCK, STRIDE = 128, 16
#: Groups of segments whose best results meet first.
GROUPS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same terms in lower-cased UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = "segment long, n_docs long, n_terms long, doc_ids binary, no_id binary, lengths binary, terms binary, counts binary, gaps binary, tfs binary"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold them all, compressed. The first byte tells how many."""
    most = int(values.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.compress(values.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), dtype=f"u{data[0]}").astype(np.int64)


class Writer:
    """Documents to a segment's row."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        self.terms = terms
        self.clear()

    def clear(self) -> None:
        self.bytes = self.n_docs = self.n_terms = 0
        self.ids, self.no_id, self.lengths = array("q"), array("b"), array("q")
        self.term, self.at, self.tf = array("i"), array("i"), array("q")

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = TERM.findall(text.lower())
        self.bytes += len(text)
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        at, before = len(self.ids), len(self.term)
        for word, count in Counter(words).items():
            if (k := self.terms.get(word)) is not None:
                self.term.append(k)
                self.at.append(at)
                self.tf.append(count)
        if len(self.term) > before:
            self.ids.append(doc_id or 0)
            self.no_id.append(doc_id is None)
            self.lengths.append(len(words))

    def row(self, segment: int) -> tuple:
        term, at, tf = (np.frombuffer(x, dtype=x.typecode) if len(x) else np.zeros(0, np.int64) for x in (self.term, self.at, self.tf))
        order = np.argsort(term, kind="stable")
        terms, counts = np.unique(term, return_counts=True)
        gaps = np.diff(at[order], prepend=0)
        starts = np.cumsum(counts) - counts
        gaps[starts] = at[order][starts]
        ids = np.frombuffer(self.ids, dtype=np.int64) if len(self.ids) else np.zeros(0, np.int64)
        return segment, self.n_docs, self.n_terms, zstandard.compress(ids.tobytes(), 1), packed(np.array(self.no_id, np.int64)), packed(np.array(self.lengths, np.int64)), packed(terms), packed(counts), packed(gaps), packed(tf[order])


def indexed(documents: DataFrame, terms: list[bytes], segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of documents (doc_id, text) for the terms."""
    bounded_batches(documents.sparkSession)
    numbers, target = {t: k for k, t in enumerate(terms)}, DDL(INDEX)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, segment = Writer(numbers), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own.add(doc_id, text.as_py() or b"")
                if own.bytes >= segment_bytes:
                    yield target.batch([[x] for x in own.row(segment)])
                    segment += 1
                    own.clear()
        if own.bytes:
            yield target.batch([[x] for x in own.row(segment)])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX)


def frequencies(segments: DataFrame) -> DataFrame:
    """term (its number), df of all segments."""
    target = DDL("term long, df long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                yield target.batch([unpacked(terms), unpacked(counts)])

    return segments.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Listed:
    """One list: ordinals and contributions, where each block begins, and the largest contribution of each."""

    def __init__(self, at: np.ndarray, value: np.ndarray, blocks: int) -> None:
        self.at, self.value = at, value
        self.begin = np.searchsorted(at, np.arange(blocks + 1) * BLOCK)
        self.most = np.zeros(blocks, np.int64)
        if len(at):
            some = np.flatnonzero(np.diff(self.begin))
            self.most[some] = np.maximum.reduceat(value, self.begin[some])


class Best:
    """A query's best documents so far, and the least score that still counts."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 1
        self.score, self.doc, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, no_id = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.no_id, no_id)))
        order = np.lexsort((doc, no_id, -score))[: self.top]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]
        if len(order) == self.top:
            self.least = max(1, int(self.score[-1]))


class Reader:
    """A segment's lists as contributions to scores."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int) -> None:
        self.ids, self.no_id = np.frombuffer(zstandard.decompress(row["doc_ids"]), np.int64), unpacked(row["no_id"]).astype(bool)
        self.blocks = -(-len(self.ids) // BLOCK)
        m = 50 + (50 * unpacked(row["lengths"]) * n) // max(total, 1)
        terms, counts, gaps, tfs = (unpacked(row[x]) for x in ("terms", "counts", "gaps", "tfs"))
        ends = np.cumsum(counts)
        self.lists = {}
        for term, start, end in zip(terms.tolist(), (ends - counts).tolist(), ends.tolist()):
            at, tf = np.cumsum(gaps[start:end]), tfs[start:end]
            self.lists[term] = Listed(at, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at])), self.blocks)

    def search(self, terms: list[int], best: Best, short: int = SHORT) -> int:
        """Adds the segment's documents that are among the best; gives the number of blocks read."""
        lists = [x for t in terms if (x := self.lists.get(t)) is not None]
        few = [x for x in lists if len(x.at) * short <= len(self.ids)]
        # Term at a time: the short lists' sums are one list with bounds of its own.
        if few:
            at, where = np.unique(np.concatenate([x.at for x in few]), return_inverse=True)
            value = np.zeros(len(at), np.int64)
            np.add.at(value, where, np.concatenate([x.value for x in few]))
            lists = [Listed(at, value, self.blocks), *(x for x in lists if len(x.at) * short > len(self.ids))]
        if not lists:
            return 0
        # Document at a time: all lists together, past the blocks that can't reach the threshold.
        bound = np.sum([x.most for x in lists], axis=0)
        block, read = 0, 0
        while len(ahead := np.flatnonzero(bound[block:] >= best.least)):
            first = block + int(ahead[0])
            same = ahead[:STRIDE] - ahead[0] == np.arange(min(len(ahead), STRIDE))
            last = first + int(same.sum())
            base = first * BLOCK
            score = np.zeros((last - first) * BLOCK, np.int64)
            for x in lists:
                a, b = x.begin[first], x.begin[last]
                score[x.at[a:b] - base] += x.value[a:b]
            hit = np.flatnonzero(score >= best.least)
            if len(hit):
                best.add(score[hit], self.ids[base + hit], self.no_id[base + hit])
            read += last - first
            block = last
        return read


def searched(segments: DataFrame, queries: list[tuple[object, list[int]]], weights: np.ndarray, n: int, total: int, top: int, kind: str) -> DataFrame:
    """item_id, doc_id, score, part: the best of the segments of each task."""
    schema = f"item_id {kind}, doc_id long, score long, part long"
    names, target = INDEX.replace(" long", "").replace(" binary", "").split(", "), DDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [Best(top) for _ in queries]
        for batch in batches:
            for k in range(batch.num_rows):
                own = Reader(dict(zip(names, (c[k].as_py() for c in batch.columns))), weights, n, total)
                for (_, terms), b in zip(queries, best):
                    own.search(terms, b)
        part = TaskContext.get().partitionId()
        for (item, _), b in zip(queries, best):
            if len(b.score):
                yield target.batch([[item] * len(b.score), pa.array(b.doc, mask=b.no_id), b.score, [part] * len(b.score)])

    return segments.select(*names).mapInArrow(run, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the different terms of each item."""
    terms = F.split(F.translate("text", UPPER, LOWER), NO_TERM)
    return items.select("item_id", F.explode(terms).alias("term")).where("term <> ''").distinct()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, query_terms: int = QUERY_TERMS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of every item. The result's tables stay in the shared folder for it."""
    spark = documents.sparkSession
    pairs = written(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // query_terms))
    kind = {"bigint": "long"}.get(k := dict(items.dtypes)["item_id"], k)
    found = []
    for block in range(blocks):
        own: dict[object, list[str]] = {}
        for item, term in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # a block of the stated query set
            own.setdefault(item, []).append(term)
        terms = sorted({t for ts in own.values() for t in ts})
        numbers = {t: k for k, t in enumerate(terms)}
        segments = written(indexed(documents, [t.encode() for t in terms], segment_bytes), "lexical-segments")
        n, total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = dict(frequencies(segments).collect())  # a row a query term of the block
        weights = np.array([weight(n, df.get(k, 0)) for k in range(len(terms))], np.int64)
        queries = [(item, [numbers[t] for t in ts]) for item, ts in own.items()]
        found.append(written(searched(segments, queries, weights, n, total, top, kind), "lexical-best"))
        dropped(segments)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    some = every.withColumn("_g", F.pmod("part", F.lit(GROUPS))).withColumn("_r", place("item_id", "_g")).where(F.col("_r") <= top)
    return some.withColumn("rank", place("item_id")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_TERM.replace('[', '[^', 1)}')"

OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, {SQL_TERMS} AS ts FROM documents
), sized AS (
  SELECT k, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM docs WHERE len(ts) > 0
), totals AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized
), wanted AS (
  SELECT DISTINCT item_id, unnest({SQL_TERMS}) AS term FROM benchmark
), postings AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY k, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, nn
), scored AS (
  SELECT item_id, k, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN sized USING (k), totals GROUP BY item_id, k
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN sized USING (k) WHERE score > 0
)
SELECT * FROM placed WHERE rank <= {TOP}
"""
