"""The training-data operators against brute force, and on nulls, empty tables, repeats and long texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import bpe, licences, mixing, neighbours, privacy, quality, sharding, simhash, substrings, wrappers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _number string"
WORDS = "the of and to in is that for it as with be on by at stone river walks under seven lights gather slowly around open gates".split()


def text_of(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [text_of(k, 60 + k) for k in range(12)]
    return [
        *base, base[0], base[0], base[1].replace("stone", "Stone", 1), base[2] + " and more", None, "", "   \n\t ", "one", "x" * 3000, text_of(99, 5000),
        "word " * 400, "日本語 テキスト 🎉 " + base[3], base[4][:40] + base[5], "###$$$ &&& " * 60,
    ]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(k, t, "en" if k % 5 else None, ["a", "a", "b", None][k % 4], 0, "clash") for k, t in enumerate(texts)]
    rows += [(None, texts[7], "xx", "a", 0, "clash"), rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_base_counts_by_brute_force(documents):
    def brute(text):
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        covered = brute_windows(words)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)

    def brute_windows(words):
        count = {}
        for i in range(len(words) - 7):
            count.setdefault(tuple(words[i : i + 8]), []).append(i)
        return {j for at in count.values() if len(at) > 1 for i in at for j in range(i, i + 8)}

    for r in documents.collect():
        text = r["text"] or ""
        assert quality.base_counts(text, text.encode(), text.encode().split()) == brute(text)


def test_quality_verdicts(documents, nothing):
    rules = quality.QualityRules()
    got = {r["doc_id"]: r for r in quality.judged(documents, ["doc_id"], rules).collect()}
    n = len(got)
    assert got[0]["kept"] and not got[20]["kept"]
    assert not got[n - 2]["kept"]  # symbols only
    assert got[16]["base_failed"] and not got[16]["kept"]
    assert quality.judged(nothing, ["doc_id"]).count() == 0
    kept = quality.passing(documents)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def test_verdicts_by_brute_force(documents):
    """Histograms, references, distances and limits by plain dictionaries."""
    rules = quality.QualityRules()

    def kind(c):
        if c in " \t\n\x0b\x0c\r":
            return "space"
        if c in "0123456789":
            return "digit"
        if c in ".,;:'\"?-":
            return "mark"
        if ord(c) >= 0x250:
            return "beyond"
        if c.isalpha() and c.islower():
            return "lower"
        if c.isalpha() and c.isupper():
            return "upper"
        return "ascii" if ord(c) < 128 else "latin"

    common = {w for v in quality.COMMON_WORDS.values() for w in v.split()}

    def tally(values):
        out = {}
        for v in values:
            out[v] = out.get(v, 0) + 1
        return out

    def histogram(text):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        return tally(map(kind, text)), tally(w if w in common else None for w in words), len(words)

    def distance(p, q):
        p, q = ({k: n / sum(h.values()) for k, n in h.items()} for h in (p, q))
        return math.sqrt(max(0, sum(x.get(k, 0) * math.log2(2 * x[k] / (p.get(k, 0) + q.get(k, 0))) for x in (p, q) for k in x) / 2))

    rows, verdicts = documents.collect(), {(r["doc_id"], r["n_words"]): r for r in quality.judged(documents, ["doc_id"], rules).collect()}
    failed = lambda r: next(v["base_failed"] for (k, n), v in verdicts.items() if k == r["doc_id"] and n == histogram(r["text"] or "")[2])
    refs = {}
    for r in rows:
        a, b, n = histogram(r["text"] or "")
        if r["lang"] in rules.languages and n >= rules.min_words and not failed(r):
            for old, new in zip(refs.setdefault(r["lang"], ({}, {})), (a, b)):
                for k, x in new.items():
                    old[k] = old.get(k, 0) + x
    assert sum(refs["en"][1].values()) >= rules.reference_words
    for r in rows:
        a, b, n = histogram(r["text"] or "")
        worst = min((max(distance(a, x) / max(0.2, 0.1 + 1.1 / n**0.5), distance(b, y) / max(0.2, 0.1 + 2.1 / n**0.5)) for x, y in refs.values()), default=0) if n else 0
        got = verdicts[r["doc_id"], n]
        assert got["kept"] == (not failed(r) and (n < rules.min_words or worst <= 1))
        assert not n or max(got["class_excess"], got["word_excess"]) == pytest.approx(worst)


def test_js_distance():
    p = np.array([1.0, 0, 3])
    assert quality.js_distances(p, np.array([[2.0, 0, 6], [0, 5, 0], [0, 0, 0]])).round(9).tolist() == [0, 1, 1]


def fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    root = {k: k for k in prints}
    order = list(prints)
    changed = True
    while changed:
        changed = False
        for a in order:
            for b in order:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash_by_brute_force(documents, nothing):
    rows = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] is not None}
    prints = {k: fingerprint(t) for k, t in rows.items()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    assert {k: int(got[k]["fingerprint"], 16) for k in rows} == prints
    assert {k: got[k]["component_id"] for k in rows} == groups(prints)
    assert got[None]["component_id"] == 7
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.first_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(prints).values()))


def test_balls_meet_at_three_bits(spark):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(30)]
    prints = {}
    for k, c in enumerate(centre):
        for d in (0, 1, 2, 3, 4, 5):
            prints[len(prints)] = c ^ sum(1 << b for b in r.sample(range(64), d))
    df = spark.createDataFrame([(simhash.signed(p),) for p in set(prints.values())], "fingerprint long")
    roots = {r["fingerprint"]: r["root"] for r in simhash.near_groups(df).collect()}
    same = {}
    for k, g in groups(prints).items():
        assert same.setdefault(g, roots[simhash.signed(prints[k])]) == roots[simhash.signed(prints[k])]
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, None: 2}, {"a": 1}, {str(k): k + 1 for k in range(20)}])
def test_pfair_windows(weights):
    total = sum(weights.values())
    had = dict.fromkeys(weights, 0)
    for k, (s, j, slot, _) in enumerate(mixing.pfair_schedule([(s, w, w, w) for s, w in weights.items()])):
        assert slot == k and j == had[s] and j * total // weights[s] <= slot < math.ceil((j + 1) * total / weights[s])
        had[s] += 1
        assert all(abs(had[x] - weights[x] * (slot + 1) / total) < 1 for x in weights)
    assert had == weights


def test_pfair_deviation_from_the_weights():
    counts = {"a": 400_000, "b": 90_000, "c": 77_777, None: 12_345, "tiny": 40}
    weights = {s: n**0.7 for s, n in counts.items()}
    total = sum(weights.values())
    had, end, slots = dict.fromkeys(counts, 0), {s: -(-n // 32) for s, n in counts.items()}, set()
    for s, j, slot, balanced in mixing.pfair_schedule([(s, weights[s], end[s], n // 32) for s, n in counts.items()]):
        assert j == had[s] and slot not in slots and j * total / weights[s] - 1.001 < slot < (j + 1) * total / weights[s] + 1.001
        slots.add(slot)
        had[s] += 1
        if balanced:
            assert slot == len(slots) - 1 and all(abs(had[x] - weights[x] / total * (slot + 1)) < 1.000001 for x in counts)
    assert had == end
    long = {s: 10**9 for s in "abc"}
    own = {"a": 0.70037, "b": 0.29951, "c": 0.00012}  # the last is below a thousandth, and none is a whole number of them
    had = dict.fromkeys(long, 0)
    for k, (s, _, slot, balanced) in enumerate(mixing.pfair_schedule([(s, own[s], n, n) for s, n in long.items()])):
        had[s] += 1
        assert slot == k and balanced and all(abs(had[x] - own[x] * (k + 1)) < 1.000001 for x in own)
        if k == 50_000:
            break


def test_mixing_many_sources(spark):
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"))
    got = mixing.mixed(rows, "doc_id", "source", mixing.tempered_weights(rows, "source", 0.7), block_rows=1)
    assert sorted(r["slot"] for r in got.collect()) == list(range(12_000))


def test_mixing_keeps_all_rows(documents, nothing):
    rows = mixing.mixed(documents.select("doc_id", "source", "text"), "doc_id", "source", {"a": 2, "b": 1, None: 1}, ["text"], block_rows=2)
    got = rows.collect()
    assert len(got) == documents.count()
    for s in ("a", "b", None):
        own = sorted((r["block"], r["place"]) for r in got if r["source"] == s)
        assert own == [(k // 2, k % 2) for k in range(len(own))]
    slots = {(r["source"], r["block"]): r["slot"] for r in got}
    assert len(set(slots.values())) == len(slots)
    ordered = mixing.in_mix_order(documents)
    assert ordered.columns == documents.columns and ordered.count() == documents.count()
    assert mixing.in_mix_order(nothing).count() == 0


HELPERS = "_own _copy _alike _same _k slot place balanced block _number _total _image _spread _bucket _count _offset _rank _rows _source _slot shard fingerprint digest alike copy first root row names terms text_key found spans parts".split()


def test_clashing_columns(documents):
    """Columns with the names of helpers and results come out as they went in, and don't change what is decided."""
    plain = documents.select("doc_id", "text", "lang", "source", "n_chars")
    clash = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in HELPERS])
    own = lambda rows: sorted(map(str, rows))
    for stage in (quality.passing, simhash.first_of_each, privacy.sanitised, mixing.in_mix_order):
        got = stage(clash)
        assert got.columns == clash.columns
        got = got.collect()
        assert own(r[:5] for r in got) == own(tuple(r) for r in stage(plain).collect()), stage
        assert all(r[c] == (f"{c}:{r['doc_id']}" if r["doc_id"] is not None else None) for r in got for c in HELPERS)
    for made, n in ((mixing.mixed(clash, "doc_id", "source", {"a": 1}, ["text"]), 4), (sharding.sharded(clash, "doc_id", ["text"]), 2)):
        assert len(set(made.columns)) == len(made.columns) and made.count() == documents.count() and made.columns[-1] in ("balanced", "slot")


def test_bpe_round_trip(documents, nothing):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = bpe.encoded(documents.withColumn("own", F.col("text")), ["own"], path, P.PATTERN).collect()
    assert len(got) == documents.count()
    for r in got:
        assert r["ids"] == theirs.encode_ordinary(r["own"] or "") and r["decoded"] == (r["own"] or "") and r["n_tokens"] == len(r["ids"])
    empty = next(r for r in bpe.digested(documents, ["doc_id"]).collect() if r["doc_id"] == 16)
    assert empty["ids_sha256"] == hashlib.sha256(b"").hexdigest() == empty["decoded_sha256"]
    assert bpe.digested(nothing, ["doc_id"]).count() == 0


def test_bpe_odd_words():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.encoder_of(path, P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(2)
    words = ["".join(r.choice(["th", "e", "in", "é", "🎉", "a", "zz", "1"]) for _ in range(n)) for n in (1, 3, 9, 40, 600) for _ in range(20)]
    words += ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "ACGT", "abcdefghij", "=-", "aA", "lo", "日本") for n in (31, 33, 34, 35, 40, 64, 100, 333) for _ in range(4)]
    words += ["a" * n for n in range(30, 80)] + ["=" * 3001, "ha" * 999, "ACGT" * 5000, "".join(r.choice("ACGT") for _ in range(20_000))]
    words = sorted({w for x in words for w in own.words(x)})
    ids = [x.tolist() for x in own.coded(words)]
    assert ids == [theirs.encode_ordinary(w) for w in words]
    flat = np.concatenate([np.array(x, np.int32) for x in ids])
    assert own.decoded(np.repeat(np.arange(len(ids)), [len(x) for x in ids]), flat) == [w.encode() for w in words]
    for text in ("it's  I'LL\n\n \tx½² Ⅷ\x1c ", "a b​c  d", "don't   stop  "):
        assert own.words(text) == own.full.findall(text)


def test_neighbours_recall(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 16))
    x = np.concatenate([centres[r.integers(0, 60, 3000)] + r.normal(size=(3000, 16)) * 0.4, np.repeat(centres[:1], 40, axis=0)]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0] * 3), (9080, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for q in neighbours.nearest(df, lambda i: i % 20 == 0).collect():  # production parameters
        got.setdefault(q["query_id"], {})[q["rank"]] = (q["vec_id"], q["score"])
    ids = range(0, len(x), 20)
    assert set(got) == set(ids)
    d = x.astype(float) @ x.astype(float).T
    found = 0
    for i in ids:
        d[i, i] = -np.inf
        best = np.lexsort((np.arange(len(x)), -d[i].round(9)))[:20]
        assert sorted(got[i]) == list(range(1, 21))
        found += len({v for v, _ in got[i].values()} & set(best.tolist()))
        for v, s in got[i].values():
            assert s == pytest.approx(d[i, v])
    assert found / (20 * len(ids)) >= 0.9
    for own in got.values():  # nearest first, ties to smaller ids; row 3000 and on are copies
        order = [(-own[k][1], own[k][0]) for k in range(1, 21)]
        assert order == sorted(order)
    assert neighbours.nearest(df.where("vec_id >= 9000 and vec_id <> 9060"), lambda i: i % 20 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id < 5"), lambda i: i % 20 == 0).count() == 4


def test_windows_hold_their_share():
    for n in (1, 2, 5, 127, 128, 500, 2000, 130_000, 5_000_000, 10**9):
        blocks, width, parts = neighbours.windows(n, 0.062)
        assert blocks <= neighbours.MOST_RANGES and 0.062 <= width / blocks and n / blocks / parts <= neighbours.PART
        assert n < 500 or width / blocks < 0.08


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = neighbours.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_sharding_is_a_permutation(spark, documents, nothing):
    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "_number").withColumnRenamed("_number", "other")
    got = sharded = sharding.sharded(rows, "doc_id", ["size"], shards=5)
    got = got.collect()
    assert len(got) == documents.count()
    places = sorted((r["shard"], r["slot"]) for r in got)
    sizes = [sum(p[0] == s for p in places) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1 and places == [(s, k) for s in range(5) for k in range(sizes[s])]
    assert sorted(map(str, got)) == sorted(map(str, sharding.sharded(rows.repartition(7), "doc_id", ["size"], shards=5).collect()))
    assert sharding.sharded(rows.where("false"), "doc_id", ["size"]).count() == 0
    for n in (1, 2, 3, 5, 17, 100):
        own = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), "7").alias("p"))
        assert sorted(r["p"] for r in own.collect()) == list(range(n))


def substring_brute(rows):
    first = {}
    for i in sorted(rows):
        b = (rows[i] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in rows.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_substrings_by_brute_force(spark, documents, nothing):
    r = random.Random(4)
    pieces = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (48, 49, 50, 51, 80, 200)]
    more = [(100 + k, "".join(r.choice([*pieces, "".join(r.choice("xyz") for _ in range(r.randint(1, 40)))]) for _ in range(6))) for k in range(40)]
    df = documents.select("doc_id", "text").where("doc_id is not null").distinct().unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = {x["doc_id"]: x["text"] for x in df.collect()}
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.deduplicated(df.repartition(5)).collect()}
    assert got == substring_brute(rows)
    weak = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.deduplicated(df.repartition(3), mask=3).collect()}
    assert weak == got  # hashes of two bits
    by_null = {x["n_bytes"]: x["n_removed"] for x in substrings.deduplicated(documents).where("doc_id is null").collect()}
    assert all(n == k for n, k in by_null.items())  # its text is that of a smaller id
    assert substrings.deduplicated(documents).count() == documents.count()
    assert substrings.deduplicated(nothing).count() == 0


def test_string_names_are_ranks():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1500] = data[200:700]
    at = np.arange(len(data) - 49)
    strings = [data[k : k + 50].tobytes() for k in at]
    rank = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert substrings.string_names(data, at).tolist() == [rank[x] for x in strings]
    wide = r.integers(0, 1 << 30, 500)
    assert substrings.triples(np.concatenate((wide, [1 << 25])), np.arange(400), 7, 50).tolist() == substrings.triples(substrings.named(wide), np.arange(400), 7, 50).tolist()


def test_least_words():
    block = np.random.default_rng(4).integers(0, 1 << 62, 300).astype(np.uint64)
    assert substrings.least_words(block).tolist() == [int(block[k : k + 35].min()) for k in range(266)]


def test_difference_cover():
    shifts = {(a - b) % substrings.MODULUS for a in substrings.COVER for b in substrings.COVER}
    assert shifts == set(range(substrings.MODULUS))


def test_licences(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "SPDX-License-Identifier: BSD-3-Clause", "he renewed his licence at the office", "The general public was under the bridge."]
    rows = [(k, f"{text_of(k, 30)}\n{line}\n{text_of(k + 50, 30)}") for k, line in enumerate(lines)] + [(50, None), (51, ""), (52, "\n".join(lines[:2]))]
    rows += [(100 + k, text_of(k, 40)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x["family"] for x in r["found"]] for r in licences.scanned(df, ["doc_id"]).collect()}
    assert [got[k] for k in range(7)] == [["apache-2.0"], ["mit"], ["gpl-3.0"], ["cc-by-nc"], ["bsd"], [], []]
    assert got[50] == got[51] == [] and got[52] == ["apache-2.0", "mit"]
    assert not any(got[100 + k] for k in range(40))
    assert licences.scanned(df.where("false"), ["doc_id"]).count() == 0


def test_wrapped_licences(spark):
    wrap = lambda words, n, mark: "\n".join(mark + " ".join(words[k : k + n]) for k in range(0, len(words), n))
    rows, want = [], []
    for k, (family, at) in enumerate([("gpl-3.0", 0), ("gpl-2.0", 0), ("lgpl", 0), ("mit", 0), ("apache-2.0", 0), ("bsd", 2), ("cc-by-sa", 1), ("cc-by-nc", 1), ("isc", 0)]):
        for mark in ("", " * ", "# ", "// "):
            rows.append((len(rows), f"{text_of(k, 30)}\n\n{wrap(licences.TEMPLATES[family][at].split(), 9, mark)}\n\n{text_of(k + 9, 30)}"))
            want.append(family)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash")).withColumn("_text", F.lit("clash"))
    got = {r["doc_id"]: [x["family"] for x in r["found"]] for r in licences.scanned(df, ["doc_id"]).collect()}
    right = [set(got[k]) == {w} for k, w in enumerate(want)]
    assert sum(right) >= 0.9 * len(want), [(w, got[k]) for k, w in enumerate(want) if set(got[k]) != {w}]


@pytest.mark.parametrize("family,notice", [("mit", 0), ("apache-2.0", 1), ("bsd", 4), ("isc", 0)])
def test_licences_of_any_width(spark, family, notice):
    """An exact notice is found whatever its lines' width: from one word a line to one line."""
    words = licences.TEMPLATES[family][notice].split()
    widths = [1, 2, 3, 4, 5, 6, 8, 10, 12, len(words)]
    rows = [(n, f"{text_of(n, 40)}\n\n" + "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n)) + f"\n\n{text_of(n + 9, 40)}") for n in widths]
    got = {r["doc_id"]: {x["family"] for x in r["found"]} for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [n for n in widths if got[n] != {family}] == []


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_base_spans_by_brute_force():
    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        return (True, all(int(x) <= 255 for x in s.split(".")) if k == 1 else True, 12 <= len(d) <= 19 and privacy.luhn(d), 9 <= len(d) <= 15)[k]

    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice(["a", "@", ".", "-", "_", "1", "23", "255", "256", " ", "+", "(", "b.c", "é", "\n", "4111111111111111"]) for _ in range(r.randint(1, 25)))
        assert privacy.base_spans(t) == sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, t) if good(k, m[0]))


def test_disclosing_terms(spark, nothing):
    rows = [(k, f"plain the words {k} here\n{'alpha beta gamma delta'.split()[k % 4]} the Zorblax wrote from zed@example.com to {WORDS[k % 9]}") for k in range(12)]
    rows += [(20 + k, f"the {text_of(k, 20)} at noon") for k in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long"))
    got = {r["doc_id"]: r for r in privacy.found(df, ["doc_id"]).collect()}
    assert got[0]["n_email"] == 1 and "term:" in got[0]["spans"] and got[0]["base_sha256"] == hashlib.sha256(got[0]["spans"].split(",")[[x.split(":")[0] for x in got[0]["spans"].split(",")].index("email")].encode()).hexdigest()
    assert got[25]["spans"] == "" == got[900]["spans"]
    clean = {r["doc_id"]: r for r in privacy.sanitised(df.withColumn("terms", F.lit(1)).withColumn("text_key", F.lit(2))).collect()}
    assert "[EMAIL]" in clean[0]["text"] and "Zorblax" not in clean[0]["text"] and " the " in clean[0]["text"]
    assert clean[25]["text"] == rows[17][1] and clean[900]["text"] is None and clean[0]["n_chars"] == len(clean[0]["text"])
    assert privacy.found(nothing, ["doc_id"]).count() == 0 == privacy.sanitised(nothing).count()


def disclosed_brute(texts, rules):
    """What stands in the place of each term, by text: counts over lines, by plain loops."""
    import collections

    lines_with, both, holders, around, n_lines = collections.Counter(), {}, {}, {}, 0
    letters = lambda x: [m for m in re.finditer(r"[^\W\d_]{3,}", x)]
    wider = lambda t: [f"{t[:n]}*" for n in privacy.LEVELS if len(t) > n]
    lines = [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    for i, k, line in lines:
        n_lines += 1
        for x in {y for m in letters(line) for y in (m[0].lower(), *wider(m[0].lower()))}:
            lines_with[x] += 1
        spans = [(m.start(), kind, m.end()) for kind, p in enumerate(BASE) for m in re.finditer(p, line)]
        spans = [s for s in spans if s in privacy.base_spans(line)]
        free = [m for m in letters(line) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        for a, kind, b in spans:
            near = [m for m in free if m.start() < a][-privacy.REACH :] + [m for m in free if m.start() > a][: privacy.REACH]
            said = " ".join(m[0].lower() for m in near)
            entity = privacy.entity_of(line, (a, kind, b))
            holders.setdefault(entity, set()).add((i, k))
            for x in {y for m in near for y in (m[0].lower(), *wider(m[0].lower()))}:
                both.setdefault((entity, x), set()).add((i, k))
                around.setdefault((entity, x), set()).add(said)
    score = {
        (e, x): 1 - math.log(len(at) / lines_with[x]) / math.log(len(holders[e]) / n_lines)
        for (e, x), at in both.items() if len(around[e, x]) >= rules.support
    }
    out = {}
    for (e, x), s in score.items():
        if s >= rules.generalise and not x.endswith("*"):
            put = "" if s >= rules.remove else next((c for c in wider(x) if score[e, c] < rules.generalise), "?")
            for i in {i for i, _ in holders[e]}:
                out[i, x] = max(out.get((i, x), (0, "")), (s, put))
    return {k: put for k, (_, put) in out.items()}


def test_disclosing_terms_by_brute_force(spark):
    r = random.Random(12)
    people = {"ann@x.org": "annabelle", "bob@y.org": "bobsworth", "+44 20 7946 0958": "carlotta"}
    texts = []
    for k in range(150):
        mail, name = r.choice(list(people.items()))
        if r.random() < 0.25:
            name = r.choice(["annabellina", "bobswell", "carlos", "Annabelle"])
        lines = [text_of(k * 3 + j, 8) for j in range(2)]
        if k % 3:
            lines[k % 2] += f" {name if r.random() < 0.9 else 'nobody'} at {mail} " + text_of(k, 9)
        if k % 7 == 0:
            lines.append(f"{r.choice(list(people.values()))} on their own")
        texts.append("\n".join(lines))
    texts += [texts[1], None, "", f"{'far ' * 30}annabelle " + "w " * 13 + "ann@x.org"]
    rules = privacy.DisclosureRules(generalise=0.6, remove=0.85)
    want = disclosed_brute(texts, rules)
    assert {"", "?"} < set(want.values()) and any(v.endswith("*") for v in want.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in privacy.sanitised(df, rules).collect()}
    spans = {r["doc_id"]: r["spans"] for r in privacy.found(df, ["doc_id"], rules).collect()}
    for i, t in enumerate(texts):
        base = privacy.base_spans(t or "")
        marks = [(s, e, f"[{privacy.KINDS[k].upper()}]", privacy.KINDS[k]) for s, k, e in base]
        for m in re.finditer(r"[^\W\d_]{3,}", t or ""):
            put = want.get((i, m[0].lower()))
            if put is not None and not any(a < m.end() and m.start() < b for a, _, b in base):
                marks.append((m.start(), m.end(), put.replace("?", "[NAME]" if m[0][0].isupper() else "[WORD]"), "term"))
        text = t
        for s, e, mark, _ in sorted(marks, reverse=True):
            text = text[:s] + mark + text[e:]
        assert got[i] == text and spans[i] == ",".join(f"{k}:{s}:{e}" for s, e, _, k in sorted(marks))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li>menu</ul></nav><header>Top</header>
<div class="ad banner">Buy</div><aside>side</aside><article><h1>Head {0} &amp; more</h1><p><b>Bold {0}.<br>next <p>Second&nbsp;para</p><div class="comments"><p>reader says</p></div><form>send</form></article><footer>foot</footer></body></html>"""


def test_main_text(spark):
    bare = "<html><body><div>Site name</div><p>Story {0} of the day</p><div class='cookie-notice'>We use</div></body></html>"
    rows = [(k, f"https://a.org/{k}", PAGE.format(k)) for k in range(4)] + [(10 + k, f"https://b.org/{k}", bare.format(k)) for k in range(3)]
    rows += [(20, None, None), (21, "https://c.org", ""), (22, "https://c.org/x", "plain text & <b>bold</b>"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df, ["page_id"]).collect()}
    assert got[2] == "Head 2 & more\n\nBold 2. next\n\nSecond para"
    assert got[11] == "Story 1 of the day"
    assert got[20] == got[21] == "" and got[22] == "plain text & bold"
    assert wrappers.extracted(df, ["page_id"]).count() == len(rows)
    assert wrappers.extracted(df.where("false"), ["page_id"]).count() == 0


def test_wrapper_decides_in_articles(spark):
    page = "<body><article><h1>Head {0}</h1><p class='byline'>By <b>our staff</b>.</p><p>Story {0}</p><p>More of {0}</p>{1}</article></body>"
    box = "<div class='box'><p>Read our other pages</p></div>"
    rows = [(k, f"https://a.org/{k}", page.format(k, box if k % 2 else "")) for k in range(20)]
    rows += [(100 + k, f"https://b.org/{k}", page.format(k % 3, "")) for k in range(20)]  # three different pages: too few
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df, ["page_id"]).collect()}
    assert all(got[k] == f"Head {k}\n\nStory {k}\n\nMore of {k}" for k in range(20))
    assert got[101] == "Head 1\n\nBy our staff.\n\nStory 1\n\nMore of 1"


def test_main_text_names_and_repeats(spark):
    rows = [(1, "https://a.org/1", "<body><h1>Title</h1><p>Story one.</p></body>")] * 2
    rows += [(k, f"https://b{k}.org/", f"<body><div class='{c}'><p>Story text</p></div></body>") for k, c in enumerate(["layout has-sidebar", "post-with-comments", "no-ads", "unadvertised"], 10)]
    rows += [(k, f"https://c{k}.org/", f"<body><p>Story text</p><div class='{c}'><p>Other</p></div></body>") for k, c in enumerate(["sidebar", "sidebar-left x", "cookie_banner", "site-footer", "comments", "related-posts", "ad-2"], 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("_host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in wrappers.extracted(df, ["page_id", "_host"]).collect()]
    assert got.count((1, "Title\n\nStory one.")) == 2
    assert sorted(x for x in got if x[0] > 1) == [(k, "Story text") for k in (10, 11, 12, 13, *range(20, 27))]


def test_main_text_data_attributes_and_unclosed_tags(spark):
    import time

    page = '<article><p data-id="comments">Hello world</p><p data-role="sidebar">two</p><p id="comments">no</p></article>'
    df = spark.createDataFrame([(1, None, page), (2, "https://h/x", "<article><p>text</p>" + "<a " * 8000)], "page_id long, url string, html string")
    start = time.time()
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df, ["page_id"]).collect()}
    assert got[1] == "Hello world\n\ntwo" and got[2].startswith("text")
    assert time.time() - start < 60


def test_wrappers_do_not_depend_on_partitions(spark):
    r = random.Random(9)
    part = lambda k: r.choice(["<p>Box</p>", "<ul><li>a<li>b</ul>", f"<h2>n{k}</h2>", "<div class='x'><p>Same</p></div>", ""])
    rows = [(k, f"https://h{k % 3}.org/{k}", f"<body><h1>T{k % 40}</h1>{part(k)}<p>text {k}</p>{part(k)}{part(k)}<p>Imprint</p></body>") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first, *others = [sorted(map(tuple, wrappers.host_wrappers(x).collect())) for x in (df.repartition(1), df.repartition(7, "page_id"), df.union(df).orderBy(F.desc("page_id")))]
    assert len(first) == 3 and all(x == first for x in others)


def plain_text_of(html):
    """Blocks of the article by the standard library's parser, for pages of few kinds of elements."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.blocks, self.held = 0, [], []

        def flush(self):
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                self.blocks.append(text)

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if tag in ("article", "p", "h1", "div"):
                self.flush()
            if tag == "br":
                self.held.append(" ")

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1", "div"):
                self.flush()
            if tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth:
                self.held.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return "\n\n".join(reader.blocks)


def test_given_pages_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = wrappers.op10_wrapper_extraction(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == plain_text_of(rows[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_wrapper_alignment():
    a = wrappers.skeleton("<ul><li>x<li>y</ul><p>same</p><p>one</p>")
    b = wrappers.skeleton("<ul><li>z</ul><p>same</p><h2>extra</h2>")
    w = wrappers.aligned(a, b)
    assert ["some", [["tag", "li"], ["text", None]]] in w
    assert any(x[0] == "maybe" for x in w)
    assert wrappers.aligned(w, a) and len(wrappers.aligned(w, b)) == len(w)


def test_pipeline_tells_the_mix(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    common = "the of and to in is that for it as with be on by at".split()
    made = lambda: " ".join(r.choice(common) if k % 2 else "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(70))
    rows = [(k, made(), "en", "a" if k % 4 else "b", 0) for k in range(1200)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    counts = {s: sum(x["source"] == s for x in got) for s in "ab"}
    assert min(counts.values()) > 100
    weights = {s: n**0.7 for s, n in counts.items()}
    slots = {}
    for x in got:
        slots.setdefault(x["slot"], []).append((x["source"], x["place"], x["balanced"]))
    had, balanced = dict.fromkeys(counts, 0), sorted(k for k, v in slots.items() if v[0][2])
    assert balanced == list(range(len(balanced))) and len(balanced) >= 6
    for k in balanced:
        assert len({(s, b) for s, _, b in slots[k]}) == 1 and sorted(p for _, p, _ in slots[k]) == list(range(32))
        had[slots[k][0][0]] += 1
        assert all(abs(had[s] - (k + 1) * weights[s] / sum(weights.values())) < 1 for s in had)


def slots_by_brute_force(ids, weights, block_rows):
    """(slot, place) of each id, and how many slots are balanced: each slot goes to the released block that is due first."""
    from fractions import Fraction

    own = {s: sorted(x, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s, x in ids.items()}
    w = {s: Fraction(weights[s]) / sum(map(Fraction, weights.values())) for s in own}
    end, full = {s: -(-len(x) // block_rows) for s, x in own.items()}, {s: len(x) // block_rows for s, x in own.items()}
    had, at, slot, balanced, n_balanced = dict.fromkeys(own, 0), {}, 0, True, 0
    while any(had[s] < end[s] for s in own):
        open_ = [(math.ceil((had[s] + 1) / w[s]), s) for s in sorted(own) if had[s] / w[s] < slot + 1 and math.floor(had[s] / w[s]) <= slot and (balanced or had[s] < end[s])]
        if open_:
            s = min(open_)[1]
            balanced = balanced and had[s] < full[s]
            if balanced or had[s] < end[s]:
                for place, i in enumerate(own[s][had[s] * block_rows : (had[s] + 1) * block_rows]):
                    at[i] = (slot, place)
                n_balanced += balanced
                had[s] += 1
        slot += 1
    return at, n_balanced


def test_pipeline_by_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline

    r = random.Random(21)
    texts = {}
    for k in range(260):
        text = text_of(k, 70)
        if k % 5 == 0:
            text += f"\n{r.choice(['the Zorblax', 'Quomble'])} wrote from {['zed@example.com', 'q@mail.org'][k % 2]} to " + text_of(k + 900, 6)
        texts[k] = text if k % 29 else text_of(k, 12)  # some too short
    texts |= {260: texts[1], 261: texts[2].upper(), 262: None, 263: ""}
    rows = [(k, t, "en", "a" if k % 3 else "b", len(t or "")) for k, t in texts.items()]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, sf).collect()}

    kept = {x["doc_id"] for x in quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).collect() if x["kept"]}  # by brute force above
    prints = {k: fingerprint(texts[k]) for k in sorted(kept)}
    first = sorted(set(groups(prints).values()))
    assert 150 < len(first) < len(kept) < len(texts) and set(got) == set(first)
    want = disclosed_brute([texts[k] for k in first], privacy.DisclosureRules())
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, k in enumerate(first):
        base = privacy.base_spans(texts[k])
        marks = [(s, e, f"[{privacy.KINDS[kind].upper()}]") for s, kind, e in base]
        for m in re.finditer(r"[^\W\d_]{3,}", texts[k]):
            if (put := want.get((i, m[0].lower()))) is not None and not any(a < m.end() and m.start() < b for a, _, b in base):
                marks.append((m.start(), m.end(), put.replace("?", "[NAME]" if m[0][0].isupper() else "[WORD]")))
        text = texts[k]
        for s, e, mark in sorted(marks, reverse=True):
            text = text[:s] + mark + text[e:]
        assert got[k]["ids"] == theirs.encode_ordinary(text) and got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    ids = {s: [k for k in first if (k % 3 > 0) == (s == "a")] for s in "ab"}
    at, n_balanced = slots_by_brute_force(ids, {s: float(len(x)) ** 0.7 for s, x in ids.items()}, 32)
    assert {k: (x["slot"], x["place"]) for k, x in got.items()} == at
    assert len({x["slot"] for x in got.values() if x["balanced"]}) == n_balanced


def test_pipeline_takes_the_mix_from_its_stage(spark, tmp_path):
    """Slots are those of the layout that the mixing stage has made: by other weights others, without it none."""
    import corpus_pipeline

    ids = {"a": list(range(900)), "b": list(range(900, 1200)), None: list(range(1200, 1270))}
    rows = [(k, f"text {k}", "en", s, 0) for s, own in ids.items() for k in own]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_metadata", F.lit("own")).repartition(5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for n, power in enumerate((0.7, 0.2)):
            laid = mixing.in_mix_order(docs, power)
            laid.write.parquet(f"{tmp_path}/{n}")
            read = spark.read.parquet(f"{tmp_path}/{n}")
            assert read.columns == docs.columns
            at, n_balanced = slots_by_brute_force({s or "~": x for s, x in ids.items()}, {s or "~": float(len(x)) ** power for s, x in ids.items()}, 32)
            for table in (read, laid, mixing.in_mix_order(read, power)):
                got = corpus_pipeline.token_ids(spark, table, "").collect()
                assert len(got) == len(rows) and {x["doc_id"]: (x["slot"], x["place"]) for x in got} == at
                assert len({x["slot"] for x in got if x["balanced"]}) == n_balanced
        # The stage's own order of rows counts: laid out the other way round, a source's last row is its first.
        read.orderBy(F.desc("doc_id")).write.parquet(f"{tmp_path}/turned")
        got = corpus_pipeline.token_ids(spark, spark.read.parquet(f"{tmp_path}/turned"), "").collect()
        first = {x["source"]: x["doc_id"] for x in sorted(got, key=lambda x: (-x["slot"], -x["place"]))}
        assert first == {s: own[-1] for s, own in ids.items()}
        got = corpus_pipeline.token_ids(spark, docs, "").collect()
        assert len(got) == len(rows) and {(x["slot"], x["place"], x["balanced"]) for x in got} == {(None, None, False)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixing_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {}
    for d in docs:
        ids.setdefault(d["source"], []).append(d["doc_id"])
    got = {x["doc_id"]: (x["slot"], x["place"]) for x in mixing.op3_pfair_mixing(spark, sf).collect()}
    at, _ = slots_by_brute_force(ids, {s: float(len(x)) ** 0.7 for s, x in ids.items()}, 32)
    assert got == at


def test_wide_wrappers_lose_constants(spark):
    r = random.Random(6)
    names = "p h2 h3 dd pre li blockquote figure".split()
    wide = lambda k: "<body><h1>Site</h1>" + "".join(f"<{n}>text {k} {j}</{n}>" for j, n in enumerate(r.choices(names, k=700))) + "<address>Imprint</address></body>"
    pages = [wide(k) for k in range(4)]
    whole = wrappers.skeleton(pages[0])
    for p in pages[1:]:
        whole = wrappers.aligned(whole, wrappers.skeleton(p))
    assert wrappers.constants(whole) == {wrappers.mark("Site"), wrappers.mark("Imprint")}
    assert len(whole) < 2 * min(len(wrappers.skeleton(p)) for p in pages)
    same = "<body><p>Name</p><p>Only story</p></body>"  # copies and a repeated row are one page
    rows = [(k, f"https://w.org/{k}", p) for k, p in enumerate(pages)] + [(10, "https://c.org/1", same), (11, "https://c.org/2", same), (10, "https://c.org/1", same)]
    got = {x["page_id"]: x["text"] for x in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), ["page_id"]).collect()}
    assert all(got[k] == "\n\n".join(f"text {k} {j}" for j in range(700)) for k in range(4))
    assert got[10] == got[11] == "Name\n\nOnly story"


def test_wide_wrappers_keep_optional_constants(spark):
    """A text in an optional part is template in a wrapper of any width."""
    letters = "abcdefghij"
    body = lambda k: "".join(f"<p class='{'xyz'[k % 3]}-{letters[j // 100]}{letters[j // 10 % 10]}{letters[j % 10]}'>text {k} {j}</p>" for j in range(320))
    page = lambda k: f"<body><article><h1>Head {k}</h1>{body(k)}{BOX if k % 2 else ''}</article></body>"
    BOX = "<div class='box'><p>Read our other pages</p></div>"
    whole = wrappers.skeleton(page(0))
    for k in range(1, 24):
        whole = wrappers.aligned(whole, wrappers.skeleton(page(k)))
    assert len(wrappers.apart(whole)) > 1000 and wrappers.sure_constants(whole) == {wrappers.mark("Read our other pages")}
    df = spark.createDataFrame([(k, f"https://a.org/{k}", page(k)) for k in range(24)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df, ["page_id"]).collect()}
    assert got == {k: "\n\n".join([f"Head {k}", *(f"text {k} {j}" for j in range(320))]) for k in range(24)}


def test_wrapper_matching_is_difflibs(monkeypatch):
    from difflib import SequenceMatcher

    monkeypatch.setattr(wrappers, "NARROW", 0)
    r = random.Random(1)
    for t in range(600):
        k = r.choice([1, 2, 3, 6, 20])
        a = [str(r.randrange(k)) for _ in range(r.randrange(60))]
        b = [str(r.randrange(k)) for _ in range(r.randrange(60))] if t % 3 else a[:20] + a[25:] + a[:9]
        blocks = []
        for i, j, n in wrappers.matching(a, b):
            joined = bool(blocks) and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (i, j)
            i, j, m = blocks.pop() if joined else (i, j, 0)
            blocks.append((i, j, m + n))
        assert blocks == [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]


def test_pipeline_stages(spark, documents, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path / "sf")
    documents.drop("_number").write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count() > 0


def test_bpe_keeps_to_the_pattern_given(spark):
    """A pattern other than the vocabulary's own cuts texts of any characters; groups in it don't matter."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["don't stop  now", "plain words 12", "h\u00e9 \u4e2d\u6587 it's", "", None]
    for pattern in (public_tokenizers.PATTERN, r"\S+|\s+", r"(\w)\w*|\W"):
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in bpe.encoded(df, ["doc_id"], path, pattern).collect():
            assert (r["ids"], r["decoded"]) == (own.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]] or ""), (pattern, r)
