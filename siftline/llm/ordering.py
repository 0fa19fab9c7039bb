"""Row numbers without a sort of everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear

#: Rows that a bucket holds at most on average.
BUCKET_ROWS = 50_000


def spread(key: str) -> Column:
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


def digits(n: int) -> int:
    """Hex digits that tell buckets of BUCKET_ROWS rows apart; 3 at least."""
    count = 3
    while n > BUCKET_ROWS * 16**count:
        count += 1
    return count


def numbered(rows: DataFrame, key: str, group: list[str], ties: list[str], number: str, total: str) -> DataFrame:
    """rows with their number within `group` from 0, in the order of MD5(key), and the group's row count.

    A group's rows are dealt to buckets by the first hex digits of the MD5, even at any distribution of ids; there are as many buckets as the row
    count asks for. Buckets are counted, the counts summed up in order, and rows are numbered within their bucket only; so a group with a
    third of all rows is spread out too. `ties` order rows with the same key; rows alike in them all are interchangeable.
    Helper columns have names that rows don't use; `number` and `total` are the caller's to choose.
    """
    p = clear(rows)
    order, bucket, count, offset, rank = (p + x for x in ("spread", "bucket", "count", "offset", "rank"))
    dealt = rows.withColumn(order, spread(key)).withColumn(bucket, F.substring(order, 1, digits(rows.count())))
    sizes = dealt.groupBy(*group, bucket).agg(F.count("*").alias(count))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"{p}of_{g}") for g in group],
        F.col(bucket).alias(f"{p}b"),
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias(offset),
        F.sum(count).over(Window.partitionBy(*group)).alias(total),
    )
    within = Window.partitionBy(*group, bucket).orderBy(order, *[F.col(t).asc_nulls_first() for t in [key, *ties]])
    ranked = dealt.withColumn(rank, F.row_number().over(within) - 1)
    on = F.col(bucket) == F.col(f"{p}b")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"{p}of_{g}"))
    out = ranked.join(offsets, on)
    return out.withColumn(number, F.col(offset) + F.col(rank)).select(*rows.columns, number, total)
