"""Lattice scores against brute force over all segmentations, base scores, expected counts, odd texts, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftline.llm import lattice

DOCS = "doc_id long, text string, word string, score string"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def cuts(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in cuts(word[k:]):
            yield [word[:k], *rest]


def by_all_cuts(word, numbers, logs):
    """Each cut, with all ways to write its parts: by a piece, or a single character by bytes."""
    ways, total, expected = [], 0.0, Counter()
    for cut in cuts(word):
        options = [[]]
        for part in cut:
            own = [[numbers[part]]] if part in numbers else []
            if len(part) == 1:
                own.append(list(part.encode("utf-8", "surrogateescape")))
            options = [a + b for a in options for b in own]
        ways += options
    for way in ways:
        p = math.exp(sum(logs[k] for k in way))
        total += p
        for k in way:
            expected[k] += p
    return math.log(total), {k: v / total for k, v in expected.items()}


@pytest.mark.parametrize("word", ["a", "the", "stream", "été", "日本", "▁x▁", "zzzz", "\x00b", "Straße"])
def test_forward_by_all_cuts(path, word):
    pieces, logs = lattice.vocabulary(path)
    own = lattice.Lattice(pieces, logs)
    text = lattice.marked(word.encode())
    score, expected = by_all_cuts(text, {p: lattice.BYTES + k for k, p in enumerate(pieces)}, logs)
    assert own.forward(text)[-1] == pytest.approx(score, abs=1e-9) == own.all_scores([text, "▁other"])[0]
    for how in (lambda into: own.expected(text, 1000, into), lambda into: own.all_expected([text], np.array([1000]), into)):
        how(into := np.zeros(len(logs), np.int64))
        for k in range(len(logs)):
            assert into[k] / lattice.UNIT / 1000 == pytest.approx(expected.get(k, 0.0), abs=1e-5)


def test_words_together_and_alone(path):
    """Words of many lengths, in one call and one at a time, by arrays and by the plain recursion."""
    r = random.Random(2)
    pieces, logs = lattice.vocabulary(path)
    own = lattice.Lattice(pieces, logs)
    words = [lattice.marked("".join(r.choices("abcdeéß東🎉-.x", k=r.choice((1, 2, 3, 9, 40, 700)))).encode()) for _ in range(200)]
    assert own.all_scores(words) == pytest.approx([own.forward(w)[-1] for w in words], rel=1e-12)
    weights, a, b = np.arange(1, 201), np.zeros(len(logs), np.int64), np.zeros(len(logs), np.int64)
    own.all_expected(words, weights, a)
    for w, c in zip(words, weights.tolist()):
        own.expected(w, c, b)
    assert np.abs(a - b).max() <= 2 * len("".join(words))


def test_starting_probabilities(path):
    pieces, logs = lattice.vocabulary(path)
    assert np.exp(logs).sum() == pytest.approx(1) and len(logs) == len(pieces) + lattice.BYTES + 1
    assert not any("▁" in p[1:] for p in pieces)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def out_of_training(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(docs, path, rounds):
    train = [words_of(t) for d, t in docs if not out_of_training(d)]
    counts, n = Counter(w for ws in train for w in ws), sum(map(len, train)) + len(train)
    v = len(counts) + (1 if train else 0)
    pieces, logs = lattice.vocabulary(path)
    for _ in range(rounds):
        own, into = lattice.Lattice(pieces, logs), np.zeros(len(logs), np.int64)
        for w, c in counts.items():
            own.expected(lattice.marked(w.encode()), c, into)
        new = into / lattice.UNIT + 1
        new[-1] += len(train)
        logs = np.log(new / new.sum())
    own = lattice.Lattice(pieces, logs)
    rows = []
    for d, t in docs:
        ws = words_of(t)
        cs = [counts[w] for w in ws] + [len(train)]
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in cs)
        score = (sum(own.forward(lattice.marked(w.encode()))[-1] for w in ws) + logs[-1]) / math.log(10)
        rows.append((d, out_of_training(d), len(ws) + 1, sum(c > 0 for c in cs), n, base, score))
    return rows


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    words = "stone river walking Under seven lights gathered slowly around opened gates naïve École 東京 don't x=1 🎉 end".split()
    made = [(k, " ".join(r.choices(words, k=r.choice((1, 8, 60))))) for k in range(80)]
    return [*made, made[3], made[3], (None, "no id here"), (500, None), (501, ""), (502, " \t\n\v\f\r "), (503, "a\x1cb c\x85d e f ▁g"), (504, "x" * 30_000), (505, "word " * 30_000)]


@pytest.mark.parametrize("rounds,segment_bytes", [(2, lattice.SEGMENT_BYTES), (1, 3000)])
def test_scores_by_brute_force(spark, path, docs, rounds, segment_bytes):
    rows = spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS).repartition(4)
    found = sorted(map(tuple, lattice.scored(rows, path, rounds, segment_bytes).collect()), key=str)
    wanted = sorted(brute(docs, path, rounds), key=str)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_nothing_to_learn_from(spark, path):
    empty = spark.createDataFrame([], DOCS)
    assert lattice.scored(empty, path).count() == 0
    only = next(k for k in range(100) if out_of_training(k))
    row = lattice.scored(spark.createDataFrame([(only, "some words", "", "")], DOCS), path).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
    assert row["score"] < 0


def test_held_out_gain(spark, path):
    """Re-estimated pieces give held-out texts a higher probability than the vocabulary's ranks do."""
    r = random.Random(8)
    stems, ends = ["walk", "talk", "garden", "winter", "light", "stone"], ["", "s", "ed", "ing", "er", "ers"]
    docs = spark.createDataFrame([(k, " ".join(r.choice(stems) + r.choice(ends) for _ in range(40)), "", "") for k in range(200)], DOCS)
    total = {rounds: lattice.scored(docs, path, rounds).where("held_out").agg({"score": "sum"}).first()[0] for rounds in (0, 1, 2)}
    assert total[0] < total[1] < total[2]
