"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a reproducible random order, form blocks. Weights w are taken as they are, as exact fractions of their sum.
Block j of a source is released at floor(j / w) and due at ceil((j + 1) / w). Earliest deadline first
gives every slot to a block within its window (the weights sum to one, so that always works out): after any number T of slots
a source has had more than w * T - 1 and fewer than w * T + 1 blocks, however large T is. The schedule goes through the blocks in
turn, so one task makes it, as rows that it hands on; it holds one block a source, and sees counts and weights only.

Every row stays. `balanced` tells whether its slot lies before the first slot that a source which has run out leaves empty; up
to there the mix keeps the weights. From there on sources that have run out have no blocks in the schedule, the others keep their windows.
Null sources are a source of their own. Null and very long texts and repeated rows are rows as any; ties of the random order go by
id and digest. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DDL, clear, identity, table, written
from .ordering import numbered


def pfair_schedule(sources: list[tuple[str | None, float, int, int]]) -> Iterator[tuple[str | None, int, int, bool]]:
    """(source, block, slot, balanced) in order of slots, for sources as (name, weight, blocks, full blocks).

    By earliest deadline among the released blocks, ties by name.
    """
    own = sorted(((n, Fraction(w), b, f) for n, w, b, f in sources if w > 0), key=lambda x: (x[0] is None, x[0] or ""))
    scale = lcm(*(w.denominator for _, w, _, _ in own)) if own else 1
    shares = [int(w * scale) for _, w, _, _ in own]
    total, balanced, slot = sum(shares), True, 0
    waiting = [(0, k, 0) for k in range(len(own))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            # Sources that have run out take part until one of them would get a slot.
            if balanced or j < own[k][2]:
                heapq.heappush(ready, (-(-(j + 1) * total // shares[k]), k, j))
        if not ready:
            continue
        deadline, k, j = heapq.heappop(ready)
        if not balanced and j >= own[k][2]:
            continue
        if slot >= deadline:
            raise ValueError("a block missed its deadline")
        balanced = balanced and j < own[k][3]
        if j < own[k][2]:
            yield own[k][0], j, slot, balanced
        if balanced or j + 1 < own[k][2]:
            heapq.heappush(waiting, ((j + 1) * total // shares[k], k, j + 1))
        slot += 1


def tempered_weights(rows: DataFrame, source: str, power: float) -> DataFrame:
    """source, weight: in proportion to the sources' row counts to a power below 1, which lifts small sources."""
    return rows.groupBy(source).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight")).select(F.col(source).alias("source"), "weight")


def scheduled(rows: DataFrame, source: str, weights: DataFrame, block_rows: int) -> DataFrame:
    """_source, _block, slot, balanced of every block of the sources with a weight."""
    target = DDL("_source string, _block long, slot long, balanced boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = [(s, w, -(-n // block_rows), n // block_rows) for b in batches for s, w, n in zip(*(c.to_pylist() for c in b.columns))]
        blocks = pfair_schedule(sources)
        while some := list(islice(blocks, 10_000)):
            yield target.batch(list(zip(*some)))

    counts = rows.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("n"))
    each = weights.join(counts, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.col("weight").cast("double").alias("weight"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return each.where("weight > 0").repartition(1).mapInArrow(run, "_source string, _block long, slot long, balanced boolean")


NAMES = ("block", "slot", "place", "balanced")


def mixed(rows: DataFrame, key: str, source: str, weights: dict[str | None, float] | DataFrame, ties: list[str] = (), block_rows: int = 32, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """rows with block (number within the source), slot (of the block), place (within the block) and balanced, named by `names`.

    Sources without a weight come last, after all slots (slot null). Columns of rows that have one of the names give way to the result's.
    """
    if isinstance(weights, dict):
        weights = rows.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
    own = rows.drop(*names)
    p = clear(own)
    dealt = numbered(own, key, [source], list(ties), f"{p}number", f"{p}rows")
    return in_blocks(dealt, own.columns, f"{p}number", source, scheduled(own, source, weights, block_rows), block_rows, names)


def in_blocks(dealt: DataFrame, columns: list[str], number: str, source: str, plan: DataFrame, block_rows: int, names: tuple[str, str, str, str]) -> DataFrame:
    """The columns of rows that are numbered within their source, with their block, place in it, and its slot and balanced by the schedule."""
    block, slot, place, balanced = names
    p = clear(dealt)
    plan = plan.toDF(*(p + x for x in ("source", "block", "slot", "balanced")))
    blocks = dealt.withColumn(block, F.floor(F.col(number) / block_rows).cast("long")).withColumn(place, (F.col(number) % block_rows).cast("int"))
    slotted = blocks.join(plan, F.col(source).eqNullSafe(F.col(f"{p}source")) & (F.col(block) == F.col(f"{p}block")), "left")
    return slotted.select(*columns, block, F.col(f"{p}slot").alias(slot), place, F.coalesce(f"{p}balanced", F.lit(False)).alias(balanced))


def with_slots(rows: DataFrame, power: float = 0.7, names: tuple[str, str, str] = NAMES[1:]) -> DataFrame:
    """All rows (doc_id, source, text and more) with slot, place and balanced, named by `names`; columns of these names give way.

    Numbers are given to ids and digests, not to whole rows; full copies are told apart by a counter. Texts move once, by the
    digest that both the counter and the join go by.
    """
    own = rows.drop(*names)
    p = clear(own)
    alike, copy = f"{p}alike", f"{p}copy"
    copies = Window.partitionBy(alike).orderBy(F.lit(0))
    same = identity(F.col("doc_id"), F.col("source"), F.col("text"))
    counted = own.withColumn(alike, same).withColumn(copy, F.row_number().over(copies))
    light = own.select("doc_id", "source", same.alias("alike")).withColumn("copy", F.row_number().over(Window.partitionBy("alike").orderBy(F.lit(0))))
    slots = mixed(light, "doc_id", "source", tempered_weights(own, "source", power), ["alike", "copy"]).select(
        F.col("alike").alias(f"{p}same"), F.col("copy").alias(f"{p}k"), *[F.col(a).alias(b) for a, b in zip(NAMES[1:], names)]
    )
    # The counter is compared after the join, so that the texts stay where the digest has put them.
    found = counted.join(slots, (F.col(alike) == F.col(f"{p}same")) & (F.col(copy) - F.col(f"{p}k") == 0))
    return found.select(*own.columns, *names)


#: Under this name the column source tells, in its metadata, by what rule its rows were laid out.
RULE = "mix"


def in_mix_order(rows: DataFrame, power: float = 0.7) -> DataFrame:
    """All rows (doc_id, source, text and more), laid out in the order of the mix: partitions and rows follow the slots.

    The rule goes with them as metadata of the column source, which Parquet tables keep.
    """
    p = clear(rows)
    names = (f"{p}slot", f"{p}place", f"{p}balanced")
    laid = with_slots(rows, power, names).repartitionByRange(*names[:2]).sortWithinPartitions(*names[:2]).select(*rows.columns)
    return laid.withMetadata("source", {**rows.schema["source"].metadata, RULE: {"power": float(power), "block_rows": 32}})


def laid_slots(rows: DataFrame, names: tuple[str, str, str] = NAMES[1:]) -> DataFrame:
    """All rows of a table written from in_mix_order with slot, place and balanced, named by `names`, as they were laid out there; columns of these names give way.

    A source's rows are numbered as its files and the rows in them follow each other, whatever order Spark reads them in; slots
    are those of the rule that came with the rows. Rows without a rule are in no mix: slot and place are null. What
    in_mix_order returns is written first, if it wasn't yet: only a table of files has places. Texts move once.
    """
    own = rows.drop(*names)
    rule = own.schema["source"].metadata.get(RULE)
    if rule is None:
        return own.select("*", F.lit(None).cast("long").alias(names[0]), F.lit(None).cast("int").alias(names[1]), F.lit(False).alias(names[2]))
    p = clear(own)
    file, at, rank, offset, number = (p + x for x in ("file", "at", "rank", "offset", "number"))
    try:
        placed = with_places(own, file, at)
    except AnalysisException:
        placed = with_places(own := written(own, "mix"), file, at)
    light = placed.select("source", file, at).withColumn(rank, F.row_number().over(Window.partitionBy(file, "source").orderBy(at)) - 1)
    before = Window.partitionBy("source").orderBy(F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long"), file).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("source", file).agg(F.count("*").alias(rank))
    offsets = sizes.select(F.col("source").alias(f"{p}of"), F.col(file).alias(f"{p}in"), F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(offset))
    dealt = light.join(offsets, F.col("source").eqNullSafe(F.col(f"{p}of")) & (F.col(file) == F.col(f"{p}in"))).withColumn(number, F.col(offset) + F.col(rank))
    plan = scheduled(own, "source", tempered_weights(own, "source", rule["power"]), rule["block_rows"])
    slots = in_blocks(dealt, [file, at], number, "source", plan, rule["block_rows"], (f"{p}block", f"{p}slot", f"{p}place", f"{p}balanced"))
    found = placed.join(slots.withColumnsRenamed({file: f"{p}f", at: f"{p}a"}), (F.col(file) == F.col(f"{p}f")) & (F.col(at) == F.col(f"{p}a")))
    return found.select(*own.columns, *[F.col(f"{p}{a}").alias(b) for a, b in zip(NAMES[1:], names)])


def with_places(rows: DataFrame, file: str, at: str) -> DataFrame:
    """Rows of a table of files with the path of their file and their number in it."""
    where = rows.metadataColumn("_metadata")
    return rows.select("*", where.getField("file_path").alias(file), where.getField("row_index").alias(at))


def op3_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, place, balanced of every document; weights by row counts to the power 0.7."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(rows, "doc_id", "source", tempered_weights(rows, "source", 0.7))
