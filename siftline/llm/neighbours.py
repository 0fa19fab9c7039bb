"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one candidate first: only the k + 1 smallest of their ids can be in any result. Each of several curves turns
directions by a random rotation, keeps DIMS coordinates, evens them out by the corpus's own mean and spread, shifts them, and
orders the vectors along a Hilbert curve. Every curve is cut into LEAST_RANGES ranges or more, of about BLOCK vectors each, by quantiles of all
keys. A query is compared with the neighbouring ranges around its own place, on every curve; at a curve's end the window shifts inwards, so that every
window holds `share` of the curve. The ranges' best are merged, and ranked by the inner product of the original vectors in double precision.
Small and large tables go the same way. Beyond MOST_RANGES ranges their vectors are dealt into parts of PART, so that a task's group stays bounded.

How wide the windows must be depends on the data. Where vectors have few directions in common, as in the test tables, no
low-dimensional order keeps neighbours together, and the windows of 24 curves together hold most vectors (README has figures).
Vectors with structure need far less; share is a parameter.

Null vectors, zero vectors, vectors that hold null or non-finite components, and those whose length isn't the most common one take
no part. Queries without partners give no rows. Rows that repeat an id with the same vector count once. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DDL, checkpointed, table

DIMS = 8
BITS = 7
TIE_BITS = 7
BLOCK = 1024
LEAST_RANGES, MOST_RANGES = 128, 4096
PART = 65_536
#: Points for each range that the quantiles tell apart.
ACCURACY = 50
SEED = 42


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of whole-number points (rows) below 2 ** bits in each coordinate."""
    axes = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k, axis in enumerate(axes):
            up = (axis >> level & 1).astype(bool)
            swap = np.where(up, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(up, axes[0] ^ low, axes[0]) ^ swap
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] >> level & 1, turn ^ ((1 << level) - 1), turn)
    place = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | ((axis ^ turn) >> level & 1)
    return place


class Curves:
    """The orderings: rotations and shifts by the seed, evened out by the corpus's statistics."""

    def __init__(self, n: int, length: int, mean: np.ndarray | None = None, spread: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(SEED)
        self.dims = min(DIMS, length)
        self.turns = [np.linalg.qr(rng.normal(size=(length, length)))[0][:, : self.dims] for _ in range(n)]
        self.shifts = [rng.uniform(0, 0.25, self.dims) for _ in range(n)]
        self.mean, self.spread = mean, spread

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        return units @ np.concatenate(self.turns, axis=1)

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A key for each vector (row) and curve (column); ties on a curve are ordered by a hash of the id."""
        normal = (self.projected(vectors) - self.mean) / self.spread
        even = 1 / (1 + np.exp(-1.702 * normal))  # the logistic curve is near enough to the normal one
        tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        out = np.empty((len(vectors), len(self.turns)), np.int64)
        for c, shift in enumerate(self.shifts):
            cells = ((even[:, c * self.dims : (c + 1) * self.dims] * 0.75 + shift) * (1 << BITS)).astype(np.int64)
            out[:, c] = hilbert(cells, BITS) << TIE_BITS | tie
        return out


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """rep (the least id), ids (the k + 1 smallest) and vector (bytes of doubles) of every distinct usable vector."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).where("vec_id IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return usable.select(F.lit(0).cast("long").alias("rep"), F.array("vec_id").alias("ids"), "v").where("false")
    own = usable.where(F.size("v") == sizes[0]["n"]).distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = own.withColumn("_k", first).where(F.col("_k") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def packed(distinct: DataFrame) -> DataFrame:
    """The vectors as bytes, which travel faster than arrays."""
    target = DDL("rep long, ids array<long>, vector binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield target.batch([batch.column(0), batch.column(1), [np.array(v, np.float64).tobytes() for v in batch.column(2).to_pylist()]])

    return distinct.mapInArrow(run, "rep long, ids array<long>, vector binary")


def statistics(vectors: DataFrame, curves: Curves) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors there are, and mean and spread of each projected coordinate over all of them."""
    size = curves.dims * len(curves.turns)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(size), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                p = curves.projected(matrix(batch.column(0)))
                n, one, two = n + len(p), one + p.sum(axis=0), two + (p * p).sum(axis=0)
        yield DDL("n long, k int, one double, two double").batch([[n] * size, range(size), one, two])

    rows = vectors.select("vector").mapInArrow(summed, "n long, k int, one double, two double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).orderBy("k").collect()
    n = rows[0]["n"]
    mean = np.array([r["one"] for r in rows]) / n
    return n, mean, np.sqrt(np.maximum(np.array([r["two"] for r in rows]) / n - mean**2, 1e-12))


def borders(vectors: DataFrame, curves: Curves, blocks: int) -> list[np.ndarray]:
    """For each curve the keys that part it into `blocks` ranges, from quantiles over all vectors."""
    n = len(curves.turns)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = curves.keys(matrix(batch.column(1)), batch.column(0).to_numpy())
                yield DDL("curve int, key long").batch([np.tile(np.arange(n, dtype=np.int32), len(keys)), keys.ravel()])

    at = [k / blocks for k in range(1, blocks)]
    # at most n_curves * MOST_RANGES numbers
    rows = vectors.select("rep", "vector").mapInArrow(keyed, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", at, ACCURACY * blocks).alias("cuts")).collect()
    found = {r["curve"]: np.array(r["cuts"], np.int64) for r in rows}
    return [found[c] for c in range(n)]


def nearest(vectors: DataFrame, is_query, k: int = 20, n_curves: int = 24, share: float = 0.062) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each id for which the column function is_query holds.

    What comes to the driver is statistics of the curves' coordinates and their range borders, not rows.
    """
    result = "query_id long, vec_id long, score double"
    distinct = checkpointed(packed(distinct_vectors(vectors, k)))
    spark = vectors.sparkSession
    if distinct.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = len(distinct.select("vector").first()["vector"]) // 8
    curves = Curves(n_curves, length)
    n, curves.mean, curves.spread = statistics(distinct, curves)
    blocks, width, parts = windows(n, share)
    cuts = borders(distinct, curves, blocks)

    # All ids of the queries, also those beyond the k + 1 smallest of equal vectors.
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).where(is_query(F.col("vec_id"))).where(F.size("v") == length).distinct()
    usable = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    queries = packed(asked.where(usable).select(F.col("vec_id").alias("rep"), F.array("vec_id").alias("ids"), "v"))

    candidates = distinct.mapInArrow(_placing(curves, cuts, blocks, 1, parts, False), PLACED)
    asking = queries.mapInArrow(_placing(curves, cuts, blocks, width, parts, True), PLACED)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["query"].to_numpy()
        mine, theirs = rows[asks], rows[~asks]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        whole = np.frombuffer(b"".join(theirs["vector"]), np.float64).reshape(len(theirs), -1)
        ids, reps = list(theirs["ids"]), theirs["rep"].to_numpy()
        out_q, out_v, out_s = [], [], []
        for start in range(0, len(mine), 256):
            part = mine.iloc[start : start + 256]
            asked = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), -1)
            about = asked @ whole.T
            for q, vector, row in zip(part["rep"], asked, about):
                # All that may be among the best k + 1 distinct ones; then exact scores, which are alike for equal vectors.
                edge = np.partition(row, -(k + 1))[-(k + 1)] - 1e-9 if len(row) > k + 1 else -np.inf
                few = np.flatnonzero(row >= edge)
                exact = np.add.reduce(np.ascontiguousarray(whole[few] * vector), axis=1)
                n_found, last = 0, np.inf
                for j in np.lexsort((reps[few], -exact)):
                    if n_found >= k and exact[j] < last:
                        break
                    for v in ids[few[j]]:
                        if v != q:
                            out_q.append(q)
                            out_v.append(v)
                            out_s.append(exact[j])
                            n_found += 1
                    last = exact[j]
        return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, float)})

    found = candidates.unionByName(asking).groupBy("curve", "block", "part").applyInPandas(compare, result)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PLACED = "curve int, block int, part int, query boolean, rep long, ids array<long>, vector binary"


def windows(n: int, share: float) -> tuple[int, int, int]:
    """For n vectors: ranges of a curve, ranges in a window, parts of a range."""
    blocks = min(n, max(LEAST_RANGES, min(MOST_RANGES, math.ceil(n / BLOCK))))
    half = max(1, math.ceil((share * blocks - 1) / 2))
    return blocks, min(blocks, 2 * half + 1), max(1, math.ceil(n / blocks / PART))


def _placing(curves: Curves, cuts: list[np.ndarray], blocks: int, width: int, parts: int, asks: bool):
    """Candidates to their range on each curve and to one of its parts; queries to all parts of the `width` ranges around their own."""
    target = DDL(PLACED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column(0).to_numpy()
            keys = curves.keys(matrix(batch.column(2)), reps)
            mine = (reps.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(parts)
            for c in range(len(cuts)):
                own = np.searchsorted(cuts[c], keys[:, c], side="right")
                first = np.clip(own - width // 2, 0, blocks - width) if asks else own
                for step in range(width):
                    for part in range(parts) if asks else [mine.astype(np.int32)]:
                        where = np.full(batch.num_rows, part, np.int32) if asks else part
                        yield target.batch([np.full(batch.num_rows, c, np.int32), (first + step).astype(np.int32), where, np.full(batch.num_rows, asks), *batch.columns])

    return run


def op5_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
