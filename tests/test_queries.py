"""Queries against their SQL in DuckDB on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = "word_count url_slug page_type headings internal_links chunk_pack all_chunks keyword_index faq_index processed_queries faq_match bm25_tiered retrieve answers link_bfs sections_v1 section_key crawl_resume index_lookup token_overlap".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows, columns):
    own = lambda x: "" if x is None else round(x, 6) if isinstance(x, float) else str(x)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(own(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", PICKED)
def test_query(spark, duck, name):
    from siftline.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)
