"""Ranked search against brute force: ties, nulls, repeats, long texts, small segments, skipped blocks."""

import math
import random
import re

import numpy as np
import pytest

from siftline.llm import lexical

DOCS = "doc_id long, text string, rank string, term string"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    own = [(doc, ts) for doc, text in docs if (ts := terms_of(text))]
    n, total = len(own), sum(len(ts) for _, ts in own)
    df = {}
    for _, ts in own:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, ts in wanted.items():
        scored = []
        for doc, words in own:
            m = 50 + (50 * len(words) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * words.count(t)) // (1000 * words.count(t) + 20 * m)) for t in ts & set(words))
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        rows += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(6000)]
    docs = [(k, " ".join(r.choices(words, k=r.choice((1, 5, 30, 200))))) for k in range(900)]
    docs += [(k + 900, docs[7][1]) for k in range(60)] + [docs[3], docs[3], (None, docs[7][1]), (None, None), (2000, None), (2001, ""), (2002, " .,-[]{}~ \n"), (2003, "w1 w2 " * 20_000)]
    docs += [(2004, "Große STRASSE ÉTÉ naïve 日本語 a-b_c"), (2005, "große strasse été NAÏVE x9")]
    items = [(k, " ".join(r.choices(words, k=12))) for k in range(25)]
    items += [(100, docs[7][1]), (101, None), (102, "..."), (103, "unheardof"), (104, "Große ÉTÉ NAïVE 日本語 B_C"), (None, "w1 w5"), (5, "w7 w9"), (5, "w7 w9"), (105, "w1")]
    return docs, items


@pytest.mark.parametrize("segment_bytes,query_terms", [(lexical.SEGMENT_BYTES, lexical.QUERY_TERMS), (20_000, 60)])
def test_search_by_brute_force(spark, tables, segment_bytes, query_terms):
    docs, items = tables
    rows = spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    found = [tuple(r) for r in lexical.ranked(rows, asked, 20, query_terms, segment_bytes).collect()]
    assert sorted(found, key=str) == brute(docs, items, 20)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "one", "", "")], DOCS), spark.createDataFrame([(1, "one", "")], ITEMS)
    assert lexical.ranked(docs.where("false"), items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical.ranked(docs, items).collect()] == [(1, 1, 1)]


def test_blocks_are_skipped():
    """One list with its high contributions at the start: later blocks are passed over, and the best stay the same."""
    size = lexical.BLOCK * 200
    reader = lexical.Reader.__new__(lexical.Reader)
    reader.ids, reader.no_id, reader.blocks = np.arange(size), np.zeros(size, bool), 200
    r = np.random.default_rng(1)
    value = r.integers(1, 1000, size)
    value[:300] += 5000
    rare = np.sort(r.choice(size, 40, replace=False))
    extra = r.integers(1, 9000, 40)
    reader.lists = {0: lexical.Listed(np.arange(size), value, 200), 1: lexical.Listed(rare, extra, 200)}
    best = lexical.Best(50)
    read = reader.search([0, 1, 2], best)
    whole = value.copy()
    whole[rare] += extra
    assert best.doc.tolist() == np.lexsort((np.arange(size), -whole))[:50].tolist()
    assert read < 60


def test_packed_numbers():
    for values in ([], [0], [255, 3], [256], [70_000, 1], [2**40, 0]):
        assert lexical.unpacked(lexical.packed(np.array(values, np.int64))).tolist() == values
