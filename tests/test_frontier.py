"""Schedules against a queue gone through step by step."""

import random

import pytest

from siftline.operators import frontier

SCHEMA = "url string, depth long, due long"


def queue(waiting, last, pause):
    """One host after another, page by page."""
    earliest = {}
    for url, depth, due in waiting:
        old = earliest.get(url, (due, depth))
        earliest[url] = (min(due, old[0]), min(depth, old[1]))
    out, clock = {}, dict(last)
    for url, (due, depth) in sorted(earliest.items(), key=lambda x: (x[1][0], x[1][1], x[0])):
        own = url.split("/")[2]
        at = max(due, clock[own] + pause) if own in clock else due
        clock[own] = out[url] = at
    return out


@pytest.fixture(scope="module")
def waiting():
    r = random.Random(2)
    return [(f"https://h{int(r.paretovariate(0.7)) % 9}.org/{k % 150}", r.choice((0, 1, 2)), r.choice((0, 5, 5, 700, 40_000))) for k in range(400)]


def test_schedule_by_a_queue(spark, waiting):
    rows = spark.createDataFrame([*waiting, (None, 0, 1), ("nowhere", 0, 1)], SCHEMA).repartition(4)
    last = {"h1.org": 3000, "h2.org": 90_000, "other.org": 5}
    hosts = spark.createDataFrame(list(last.items()), "host string, last long")
    for known, table in ((last, hosts), ({}, None)):
        found = {r["url"]: r["fetch_at"] for r in frontier.scheduled(rows, table, 1500).collect()}
        assert found == queue(waiting, known, 1500)
    assert frontier.scheduled(rows.where("false")).count() == 0


def test_attempts(spark, waiting):
    rows = spark.createDataFrame(waiting, SCHEMA)
    answers = {}
    r = random.Random(3)
    for url, *_ in waiting:
        answers[url] = [r.choice((200, 200, None, None, 404)) for _ in range(3)]
    table = spark.createDataFrame([(u, k + 1, s) for u, x in answers.items() for k, s in enumerate(x)], "url string, attempt int, status int")
    log = frontier.attempts(rows, lambda x: x.join(table, ["url", "attempt"]).where("status is not null"), pause=1000, back_off=5000).collect()
    by_url, by_host = {}, {}
    for x in sorted(log, key=lambda x: x["attempt"]):
        by_url.setdefault(x["url"], []).append(x)
        by_host.setdefault(x["host"], []).append(x["fetch_at"])
    assert set(by_url) == set(answers)
    for url, tried in by_url.items():
        told = []
        for s in answers[url]:
            told.append("failed" if s is None else "read" if s < 400 else "refused")
            if told[-1] != "failed":
                break
        assert [x["outcome"] for x in tried] == told
        assert all(b["fetch_at"] - a["fetch_at"] >= 5000 * a["attempt"] for a, b in zip(tried, tried[1:]))
    for times in by_host.values():
        times.sort()
        assert all(b - a >= 1000 for a, b in zip(times, times[1:]))


def test_file_names_of_both_generations(spark):
    from siftline.functions.text import page_file
    from siftline.operators import crawl

    long = "https://h.org/" + "x" * 100
    rows = spark.createDataFrame([(1, long), (2, long + "?a"), (3, long + "y"), (4, "https://h.org/"), (5, "https://o.org")], "page_id long, url string")
    name = {r["page_id"]: r["file"] for r in crawl.page_files(rows).collect()}
    assert name[1] == "x" * 80 + ".json" and name[4] == "home.json"
    assert name[2].startswith("x" * 70 + "_page_") and name[3].startswith("x" * 70 + "_page_") and name[5].startswith("home_page_")
    assert len({*name.values()}) == 5
    second = rows.select(page_file(rows.url)).first()[0]
    assert second.startswith("x" * 70 + "_page_") and second.endswith(".json")
