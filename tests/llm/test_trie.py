"""The conversation trie against brute force: rebuilt conversations, ends, subtrees, long conversations over bands, odd rows."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from siftline.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, block string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):
        leaves, saved = (0, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        below = [walk(x) for x in children.get(p, [])]
        leaves = sum(x[0] for x in below) if below else 1
        saved += sum(x[1] for x in below)
        ends = sorted(c for c in members[p] if len(made[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(4)
    texts = ["hello", "hi", "", "été", None, "how are you", "fine", "x" * 400]
    rows = []
    for c in [*range(0, 160), *range(1003, 1030), -7, -5, 10**15 + 3]:
        for t in range(r.choice((1, 2, 3, 5, 9, 12))):
            rows.append((c, t, r.choice(("user", "assistant", None)), r.choice(texts)))
    for c in range(200, 240):  # copies, some a prefix of the others
        rows += [(c, t, "user", f"same {t}") for t in range(10 + c % 3)]
    rows += [(300, t, "user", f"long {t}") for t in range(60)] + [(305, t, "user", f"long {t}") for t in range(50)] + [(309, t, "user", f"long {t}") for t in range(57)]
    rows += [(None, 1, "user", "nobody's"), (400, None, "user", "before all"), (400, 0, "user", "after"), (401, 3, "user", "once"), (402, 3, "assistant", "more\nlines")]
    return rows


@pytest.mark.parametrize("band,stripe", [(trie.BAND, trie.STRIPE_BITS), (4, 5), (7, 3)])
def test_trie_by_brute_force(spark, conversations, monkeypatch, band, stripe):
    monkeypatch.setattr(trie, "STRIPE_BITS", stripe)
    turns = spark.createDataFrame([(*x, "a", "b") for x in conversations], TURNS).repartition(5)
    found = sorted((tuple(x) for x in trie.prefix_trie(turns, band).collect()), key=str)
    assert found == brute(conversations)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, 1, "user", "a"), (5, 1, "user", "a"), (5, 2, "user", "b"), (8, 1, "user", "a"), (8, 1, "user", "a")]
    turns = spark.createDataFrame([(*x, "", "") for x in rows], TURNS)
    assert sorted((tuple(x) for x in trie.prefix_trie(turns).collect()), key=str) == brute(rows)
    assert trie.prefix_trie(turns.where("false")).count() == 0


def test_children_by_bits():
    """Postings and bits of one shard: the root's children are the first turns' bitsets, ends are the bits that are over."""
    rows, conversations = [], {1: "ab", 2: "ac", 3: "a", 4: "b", 6: ""}
    for conv, turns in conversations.items():
        rows.append((0, 0, conv, 0, 0, 0, 0, len(turns), 0, 0))
        rows += [(0, 0, conv, k + 1, ord(t) << 8 * k, 0, 1, 0, 0, 0) for k, t in enumerate(turns)]
    names = [x.split()[0] for x in trie.SHARD.split(", ")]
    shard = trie.Shard(pa.table(dict(zip(names, zip(*rows)))), trie.BAND)
    assert shard.index[0, ord("a"), 0] == 0b00111 and shard.index[0, ord("b"), 0] == 0b01000
    found = {x[2:4]: (x[6], x[7], x[10]) for x in shard.nodes()}
    assert found[0, 0] == (1, 5, b"6")
    assert found[ord("a"), 0] == (1, 3, b"3")
    assert found[ord("a") ^ ord("c") << 8, 0] == (2, 1, b"2")
