"""The block-max search against scores of all postings, what it reads, its plan, and its stored form."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import index, retrieve, search
from siftline.operators.chunks import keywords
from siftline.sources import tables

CHUNKS = "chunk_id long, page_id string, url string, section string, section_type string, text string, priority_score double"


@pytest.fixture(scope="module")
def own(spark):
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.5)) % 400}x" for _ in range(8000)]
    rows = [(k, f"p{k % 37}", "u", "S", "general", " ".join(r.choices(words, k=r.choice((3, 10, 40, 300)))), 0.5) for k in range(1500)]
    rows += [(1500 + k, "p1", "u", "S", "general", rows[5][5], 0.5) for k in range(80)] + [(1600, "p2", "u", "S", "general", "", 0.5), (1601, "p2", "u", "S", "general", None, 0.5)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    chunks = chunks.join(keywords(chunks, ["chunk_id"], F.coalesce("text", F.lit(""))), "chunk_id")
    empty = lambda schema: spark.createDataFrame([], schema)
    posted = index.postings(chunks, ["text"])
    return retrieve.Indexes(
        chunks=chunks, keyword=index.keyword_index(chunks), url=empty("slug string, page_id string"), intent=empty("intent string, page_id string"), faq=index.faq_index(chunks), postings=posted,
        search=search.search_index(posted, chunks, shard_chunks=400),
    )


@pytest.fixture(scope="module")
def wanted(spark, own):
    r = random.Random(7)
    terms = [f"w{k}x" for k in range(1, 60)] + ["w300x", "w399x", "unheard"]
    rows = [(f"q{k}", r.sample(terms, r.choice((1, 2, 3, 6)))) for k in range(60)] + [("none", ["unheard"]), ("twice", ["w1x", "w1x", "w2x"])]
    df = spark.createDataFrame(rows, "query_id string, terms array<string>")
    return df.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def exhaustive(wanted, own):
    """Every chunk that has a term of the query, scored by all postings."""
    length = index.lengths(own.postings)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = index.document_frequency(own.postings).join(F.broadcast(index.corpus(length))).withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf))
    s = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avgdl")))
    rows = wanted.join(own.postings.join(terms, "term").join(length, "chunk_id").select("term", "chunk_id", s.alias("s")), "term")
    return rows.groupBy("query_id", "chunk_id").agg(T.rounded(F.sum("s"), 6).alias("score"), F.count("*").alias("n_match"), F.max("n_terms").alias("n_terms")).join(own.chunks.select("chunk_id", "page_id"), "chunk_id")


def routes_of(spark):
    r = random.Random(9)
    return spark.createDataFrame([(f"q{k}", f"p{p}") for k in range(0, 60, 2) for p in r.sample(range(45), 3)], "query_id string, page_id string")


@pytest.mark.parametrize("kind,most,queries", [("any", 25, search.QUERIES), ("all", 25, 20), ("routed", 5, search.QUERIES), ("tiers", 25, search.QUERIES), ("tiers", 3, 20)])
def test_best_of_each_kind(spark, own, wanted, kind, most, queries):
    routes = routes_of(spark)
    by = {"tiers": ["query_id", "whole", "inside"]}.get(kind, ["query_id"])
    every = exhaustive(wanted, own).withColumn("whole", F.col("n_match") == F.col("n_terms"))
    every = every.join(routes.withColumn("on", F.lit(True)), ["query_id", "page_id"], "left").join(routes.select("query_id", F.lit(True).alias("has")).distinct(), "query_id", "left")
    every = every.withColumn("inside", F.coalesce("on", F.lit(False)) | F.col("has").isNull())
    every = {"all": every.where("whole"), "routed": every.where("on")}.get(kind, every)
    found = search.found(wanted, own.search, kind, most, routes if kind in ("tiers", "routed") else None, queries)
    best = lambda rows: sorted(map(tuple, retrieve.ranked(rows, by, retrieve.best_first()).where(F.col("rank") <= most).select("query_id", "chunk_id", "score", "n_match", *by[1:], "rank").collect()))
    assert best(found) == best(every)


def test_few_postings_are_read(spark, own):
    """A rare word beside common ones: the bounds leave most blocks unread."""
    common = [r["term"] for r in own.search.terms.orderBy(F.desc("df")).limit(3).collect()]
    rows = [(f"q{k}", [*common, t["term"]]) for k, t in enumerate(own.search.terms.where("df between 30 and 40").limit(10).collect())]
    wanted = spark.createDataFrame(rows, "query_id string, terms array<string>").select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    read = search.found(wanted, own.search, "any", 5).groupBy("query_id", F.xxhash64("query_id")).agg(F.max("read").alias("read")).agg(F.sum("read")).first()[0]
    every = wanted.join(own.search.terms, "term").agg(F.sum("df")).first()[0]
    assert read < 0.5 * every


def test_postings_are_not_shuffled(own, wanted, spark):
    """The plan reads the postings bucketed by shard: no exchange above their scan."""
    lists = own.search.blocks.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    spots = spark.createDataFrame([], "shard long, query_no int, page_no int")
    plan = lists.groupBy("shard").cogroup(spots.groupBy("shard")).applyInArrow(lambda a, b: a.select(["shard"]), "shard long")._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("FileScan parquet")].rsplit("FlatMapCoGroupsInArrow", 1)[1]
    assert "Exchange hashpartitioning(shard" not in scan and "Bucketed: true" in plan


def test_stored_index(spark, own, wanted, tmp_path):
    folder = str(tmp_path / "indexes")
    tables.write_snapshot(spark, own, folder)
    again = tables.read_snapshot(spark, folder)
    rows = lambda x: sorted(map(tuple, search.found(wanted, x.search, "any", 10).drop("read").collect()))
    assert rows(again) == rows(own)
    assert (again.search.n, again.search.avgdl) == (own.search.n, own.search.avgdl)


def test_shards_have_buckets_of_their_own(spark, own):
    """Else some tasks search several shards, one after the other, while others have none."""
    made = search.search_index(own.postings, own.chunks, shard_chunks=90)
    shards = made.blocks.where("term = ''").select(F.pmod(F.hash("shard"), F.lit(18)).alias("bucket")).collect()
    assert len(shards) == 18 == len({r["bucket"] for r in shards})


def test_tiers_need_few_kinds(spark, own, wanted):
    """Kinds that the tiers don't ask for aren't sent, and the tiers are the same without them."""
    by = ["query_id", "whole", "inside"]
    best = lambda few: retrieve.ranked(search.found(wanted, own.search, "tiers", 25, routes_of(spark), few=few), by, retrieve.best_first()).where("rank <= 25").localCheckpoint()
    some, every = best(3), best(None)
    tiers = lambda rows: sorted(map(tuple, retrieve.tiered(rows).collect()))
    assert some.count() < every.count() and tiers(some) == tiers(every)


def test_bags_index_is_that_of_postings(spark, own, wanted):
    made = search.bags_index(index.bags(own.chunks, ["text"]), own.chunks.count(), shard_chunks=400)
    rows = lambda x: sorted(map(tuple, search.found(wanted, x, "any", 10).drop("read").collect()))
    assert rows(made) == rows(own.search) and (made.n, made.avgdl) == (own.search.n, own.search.avgdl)


def test_search_of_nothing(spark, own):
    nothing = spark.createDataFrame([], "query_id string, term string, n_terms int")
    assert search.found(nothing, own.search, "any", 5).count() == 0
    empty = search.search_index(spark.createDataFrame([], "term string, chunk_id long, tf long"), own.chunks)
    one = spark.createDataFrame([("q", "w1x", 1)], "query_id string, term string, n_terms int")
    assert search.found(one, empty, "any", 5).count() == 0


@pytest.mark.parametrize("value,expected", [(0.125, 0.12), (0.375, 0.38), (0.565, 0.56), (0.715, 0.71), (0.575, 0.57), (0.29, 0.29), (0.0, 0.0), (1.0, 1.0), (0.995, 0.99), (0.005, 0.01)])
def test_rounding_of_halves(spark, value, expected):
    assert spark.range(1).select(T.rounded_exactly(F.lit(value), 2)).first()[0] == expected == round(value, 2)


def test_rounding_by_brute_force(spark):
    r = random.Random(1)
    values = [k / 200 for k in range(401)] + [r.random() for _ in range(2000)] + [min(0.5 + b + min(n / 700, 1) * 0.15, 1.0) for b in (0.0, 0.1, 0.2) for n in range(0, 700, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.rounded_exactly(F.col("v"), 2).alias("r"))
    assert all(x["r"] == round(x["v"], 2) for x in rows.collect())


def test_priority_as_measured(spark):
    rows = spark.createDataFrame([("requirements", 70), ("legal", 490)], "kind string, n int")
    assert [r[0] for r in rows.select(T.priority(F.col("kind"), F.col("n"))).collect()] == [0.71, 0.7]


def test_faq_by_brute_force(spark):
    """All pairs, as the pairs that meet at a rare word must give them; and pairs that aren't alike are dealt out nowhere: likeness is asked where sets meet."""
    r = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nrt"]
    said = lambda: " ".join(r.choices(vocabulary[: r.choice((12, 30, 120))], k=r.randint(1, 14)))
    faq = spark.createDataFrame([(k, said()) for k in range(90)] + [(90, ""), (91, None)], "chunk_id long, question string")
    queries = spark.createDataFrame([(f"q{k}", said()) for k in range(120)] + [("none", ""), ("null", None)], "query_id string, text string")
    likeness = F.round(T.jaccard(index.question_words(F.col("text")), index.question_words(F.col("question"))), 6)
    every = retrieve.ranked(queries.crossJoin(faq).withColumn("likeness", likeness).where("likeness >= 0.4"), ["query_id"], [F.desc("likeness"), F.col("chunk_id")])
    found = retrieve.faq_matches(queries, faq)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.where("rank = 1").select("query_id", "chunk_id", "likeness").collect()))
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Join " in x or x.startswith("Join")]
    assert "w#" in joins[0]


@pytest.mark.parametrize("most", [1, 3, 25])
def test_like_search_by_brute_force(spark, most):
    """Words in words, odd words, empty and missing texts, ids in no order."""
    r = random.Random(13)
    texts = [" ".join("".join(r.choices("abcÉ7", k=r.randint(1, 7))) for _ in range(r.randint(0, 9))) for _ in range(120)] + ["", None, "a c&d"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    words = ["ab", "bc", "cab", "abc", "aaaa", "é", "7", "c&d", "zz", "a b", "bcab", "c"]
    asked = [(f"q{k}", r.sample(words, r.randint(0, 5))) for k in range(30)]
    found = retrieve.like_search(spark.createDataFrame(asked, "query_id string, keywords array<string>"), spark.createDataFrame(rows, "chunk_id long, text string"), most)
    every = [(q, k) for q, own in asked for k in sorted(k for k, t in rows if t is not None and any(w in t.lower() for w in own[:3]))[:most]]
    assert sorted((x["query_id"], x["chunk_id"]) for x in found.collect()) == sorted(every)


def test_like_search_reads_each_text_once(spark):
    """No row for each piece of a text: what is dealt out are the words' first chunks."""
    found = retrieve.like_search(spark.createDataFrame([("q", ["ab"])], "query_id string, keywords array<string>"), spark.createDataFrame([(1, "xaby")], "chunk_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "explode(array_distinct" not in plan


def test_no_text_is_dealt_out_for_the_index(spark):
    """The index's texts are made row by row, as the chunks are."""
    from siftline.plans import corpus

    rows = [(k, t, f"s{k % 3}", lang) for k, (t, lang) in enumerate([("Que la que é 12 Que", "fr"), ("", "en"), (None, "de"), ("the alpha alpha beta " * 30, "es")])]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    own = corpus.indexed_texts(documents)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
    bags = lambda x: sorted((r["chunk_id"], r["page_id"], sorted(zip(r["terms"], r["tfs"]))) for r in index.bags(x, corpus.INDEXED).collect())
    assert bags(own) == bags(corpus.document_chunks(documents))


def test_all_terms_from_the_rarest(spark, own):
    """Of chunks with all terms, only those of the rarest term are looked up in the others."""
    common = [r["term"] for r in own.search.terms.orderBy(F.desc("df")).limit(3).collect()]
    rare = own.search.terms.where("df between 30 and 40").orderBy("df", "term").limit(5).collect()
    rows = [(r["term"], [*common, r["term"]], r["df"]) for r in rare]
    wanted = spark.createDataFrame(rows, "query_id string, terms array<string>, df long").select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    found = search.found(wanted, own.search, "all", 25).groupBy("query_id").agg(F.max("read").alias("read")).collect()
    assert found and all(r["read"] <= 4 * dict((x[0], x[2]) for x in rows)[r["query_id"]] for r in found)
