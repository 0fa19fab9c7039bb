"""When a crawl fetches what: a pause per host, tries with growing gaps, and what became of each attempt.

Times are whole milliseconds. Within a host, pages are taken by the time from which they may be fetched, then depth, then URL; each waits for its own time and for
the pause after the one before. The k-th page's time is then k pauses more than the largest of `last` (the host's last fetch, so far) and of all due times up to it,
each less as many pauses as its place: a running maximum, and no loop over a queue.

A host with a third of all pages is one sorted window; its pages can't be fetched side by side anyway. Null URLs and URLs without a host are left out; a URL that
waits twice is fetched once, at its earlier time. Hosts that were never fetched have no row in `hosts`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host
from ..plans.session import checkpointed

PAUSE, BACK_OFF, TRIES = 2000, 3000, 3
#: Outcomes of an attempt: a page, an answer that tells to stay away, and an error, after which the next try follows.
READ, REFUSED, FAILED = "read", "refused", "failed"


def scheduled(waiting: DataFrame, hosts: DataFrame | None = None, pause: int = PAUSE) -> DataFrame:
    """url, host, depth, fetch_at of waiting (url, depth, due). hosts: host, last."""
    once = waiting.groupBy("url").agg(F.min("due").alias("due"), F.min("depth").alias("depth")).withColumn("host", host(F.col("url"))).where("host <> ''")
    own = once.withColumn("last", F.lit(None).cast("long")) if hosts is None else once.join(hosts.select("host", "last"), "host", "left")
    order = Window.partitionBy("host").orderBy("due", "depth", "url")
    placed = own.withColumn("k", F.row_number().over(order))
    latest = F.max(F.col("due") - F.col("k") * pause).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("url", "host", "depth", (F.col("k") * pause + F.greatest(latest, "last")).cast("long").alias("fetch_at"))


def attempts(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], hosts: DataFrame | None = None, pause: int = PAUSE, back_off: int = BACK_OFF, tries: int = TRIES) -> DataFrame:
    """url, host, depth, attempt, fetch_at, outcome of every attempt to fetch seeds (url, depth, due).

    fetch takes url, attempt and fetch_at and gives url and status: below 400 a page, from 400 on a refusal, which isn't tried again, null or no row an error. The n-th
    error of a page puts it off by n times back_off at least; a round's retries begin when the host's round is over. Rounds are `tries` in number.
    """
    waiting, log = seeds.select("url", "depth", F.col("due").cast("long").alias("due")), None
    for attempt in range(1, tries + 1):
        due = checkpointed(scheduled(waiting, hosts, pause).withColumn("attempt", F.lit(attempt)))
        told = due.join(fetch(due.select("url", "attempt", "fetch_at")).select("url", "status"), "url", "left")
        outcome = F.when(F.col("status") < 400, READ).when(F.col("status") >= 400, REFUSED).otherwise(FAILED)
        done = checkpointed(told.select("url", "host", "depth", "attempt", "fetch_at", outcome.alias("outcome")))
        log = done if log is None else log.unionByName(done)
        failed = done.where(F.col("outcome") == FAILED)
        if attempt == tries or failed.isEmpty():
            break
        ended = log.groupBy("host").agg(F.max("fetch_at").alias("last"))
        hosts = ended if hosts is None else ended.unionByName(hosts.select("host", "last")).groupBy("host").agg(F.max("last").alias("last"))
        waiting = failed.select("url", "depth", (F.col("fetch_at") + attempt * back_off).alias("due"))
    return log
