"""Repeated substrings by a distributed difference cover.

Only strings of LENGTH = 50 bytes count, so suffixes are sorted by their first 50 bytes and the recursion on names ends there. The sample is the
positions of a document that are in the difference cover COVER modulo 21: for any two positions i and j there is a shift d below 21 that takes both
into the sample. If the 50 bytes at i and j are equal, so are the TUPLE = 30 bytes at i + d and j + d. So:

1. Discarding: sampled tuples that no two documents share can't begin nor end in a repeated string. Tuples are told apart by a short hash, sorted
   across the cluster; what a hash confuses stays. The suffixes left are those that start less than 21 bytes before a shared tuple.
2. Dealing: suffixes are dealt out by the least name among the 16-byte words of their 50 bytes, so that equal strings meet, and neighbouring
   suffixes mostly travel together, as one run of bytes. Equal runs of a piece of a partition travel once, for their least doc_id, and
   settle the others at once: a passage that a third of all documents hold weighs in its bucket one run for each piece.
3. Names: in a bucket, the words of 8 bytes at all positions are sorted and named by their ranks; the triples of names 8 apart are sorted and named
   (24 bytes); the triples of those names at 0, 24 and 26 are sorted and named (50 bytes). All names are ranks of bytes, none is a hash. Of suffixes
   with one name, next to each other in order, those of a document that isn't the least one are to go.
4. The bytes that those strings cover are marked in each document.

No string is taken out but for equal bytes, whatever the hashes do. Copies of whole texts (equal SHA-256) with a larger doc_id go whole.

Null texts are empty. A null doc_id counts as larger than all others. Rows with the same id don't remove from each other; rows alike in id
and text have one result. Texts under 50 bytes lose nothing. Strings don't cross documents. Very long texts are read whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DDL, checkpointed, identity, table

LENGTH = 50
MODULUS = 21
# A perfect difference set modulo 21.
COVER = np.array([3, 6, 7, 12, 14])
TUPLE = LENGTH - MODULUS + 1
#: Tuples, and bytes of runs, that a bucket is to hold.
BUCKET = 8_000_000
RUN_BUCKET = 1_500_000
#: Bytes of a tuple's name that travel, besides those of its bucket.
NAME_BYTES = 4
PIECE = 16_000_000
WORD, BLOCK = 8, 16
LAST = (1 << 63) - 1
ALL = (1 << 64) - 1
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of two parts in order, from their names."""
    out = left * ODD[1]
    out += right
    out ^= out >> np.uint64(29)
    out *= ODD[2]
    out ^= out >> np.uint64(32)
    return out


def blocks(data: bytes, mask: int) -> np.ndarray:
    """64-bit names of the 16 bytes at every position; at least 16 bytes are needed. mask: the bits that count."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * ODD[0]
    words ^= words >> np.uint64(32)
    words *= ODD[3]
    return joined(words[:-8], words[8:]) & np.uint64(mask)


def names_at(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit names of the tuples at each position, from those of blocks of 16, which may overlap."""
    return joined(block[at], block[at + (TUPLE - BLOCK)]) * ODD[4]


def sample(n: int) -> np.ndarray:
    """Positions of the cover in a document of n bytes whose tuple lies within it."""
    every = cover_to(max(1 << 20, 1 << n.bit_length()))
    return every[: np.searchsorted(every, n - TUPLE, side="right")]


@lru_cache(2)
def cover_to(n: int) -> np.ndarray:
    return (np.arange(0, n, MODULUS)[:, None] + COVER).ravel()


def near(shared: np.ndarray, n: int) -> np.ndarray:
    """Starts of the strings of 50 bytes that hold one of the tuples at `shared`, wherever it lies in them."""
    edge = np.zeros(n + 1, np.int32)
    first = shared - (MODULUS - 1)
    early = int(np.searchsorted(first, 0, side="right"))  # these start at 0; the others differ
    edge[0] = early
    edge[first[early:]] += 1
    edge[shared + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return starts[starts + LENGTH <= n]


SHIPPED = "bucket int, home int, rows binary, counts binary, names binary, told boolean"
KEY = "V16"


def told_apart(names: np.ndarray, bits: int) -> np.ndarray:
    """Names with only the bits that travel: the leading ones, of the bucket, and the last NAME_BYTES."""
    return names & np.uint64((ALL << 64 - bits & ALL) | (1 << 8 * NAME_BYTES) - 1)


def ordered(names: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """names and documents in order of both; in one word each where there is room, which sorts far faster."""
    width = bits + 8 * NAME_BYTES
    room = 64 - width
    if len(doc) and int(doc.max()) >> room:
        order = np.lexsort((doc, names))
        return names[order], doc[order]
    low, short = np.uint64(8 * NAME_BYTES), np.uint64(room)
    own = np.uint64((1 << 8 * NAME_BYTES) - 1)
    word = (names >> np.uint64(64 - bits) << low | names & own) << short | doc.astype(np.uint64)
    word.sort()
    doc = (word & np.uint64((1 << room) - 1)).astype(np.int32)
    word >>= short
    return word >> low << np.uint64(64 - bits) | word & own, doc


class Shipper:
    """Gathers documents' tuples and gives them on by bucket: each name once, and apart from that those that two documents of the piece share."""

    def __init__(self, bits: int) -> None:
        self.bits, self.target = bits, DDL(SHIPPED)
        self.clear()

    def clear(self) -> None:
        self.rows: list[bytes] = []
        self.names: list[np.ndarray] = []
        self.held = 0

    def add(self, row: bytes, names: np.ndarray) -> None:
        self.rows.append(row)
        self.names.append(names)
        self.held += len(names)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = np.array(self.rows, KEY)
            names = told_apart(np.concatenate(self.names), self.bits)
            doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in self.names])
            names, doc = ordered(names, doc, self.bits)
            new = np.concatenate(([True], names[1:] != names[:-1]))
            fresh = new | np.concatenate(([True], doc[1:] != doc[:-1]))  # once a document
            names, doc, new = names[fresh], doc[fresh], new[fresh]
            size = np.diff(np.append(np.flatnonzero(new), len(names)))
            shared = np.repeat(size > 1, size)
            yield from self.parts(names[new], doc[new], rows, False)
            yield from self.parts(names[shared], doc[shared], rows, True)
        self.clear()

    def parts(self, names: np.ndarray, doc: np.ndarray, rows: np.ndarray, told: bool) -> Iterator[pa.RecordBatch]:
        """A row for each bucket: names by document. What is told already needs no comparison and is spread out by its first document."""
        home = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(home * len(rows) + doc)
        names, doc, home = names[order], doc[order], home[order]
        cuts = np.flatnonzero(np.diff(home)) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.append(cuts, len(names)).tolist()):
            if hi > lo:
                own, counts = np.unique(doc[lo:hi], return_counts=True)
                bucket = int.from_bytes(rows[own[0]].tobytes()[:4], "little") + int(home[lo]) & (1 << self.bits) - 1 if told else int(home[lo])
                low = np.ascontiguousarray(names[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES])
                yield self.target.batch([[bucket], [int(home[lo])], [rows[own].tobytes()], [counts.astype(np.int32).tobytes()], [low.tobytes()], [told]])


def unpacked(data: bytes, home: int, bits: int) -> np.ndarray:
    out = np.zeros((len(data) // NAME_BYTES, 8), np.uint8)
    out[:, :NAME_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, NAME_BYTES)
    return out.view("<u8").ravel() | np.uint64(home << 64 - bits)


TOLD = "row binary, names binary"


def shared_tuples(rows: DataFrame, bits: int, mask: int) -> DataFrame:
    """rows: row, text. By row, the names of its sampled tuples that two documents have."""
    target = DDL(TOLD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipper = Shipper(bits)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode()
                if len(data) >= LENGTH:
                    shipper.add(row, names_at(blocks(data, mask), sample(len(data))))
                if shipper.held * MODULUS >= PIECE * len(COVER):
                    yield from shipper.batches()
        yield from shipper.batches()

    def compare(part: pa.Table) -> pa.Table:
        rows, counts, names, homes, told = (part.column(c).to_pylist() for c in ("rows", "counts", "names", "home", "told"))
        names = [unpacked(n, h, bits) for n, h in zip(names, homes)]
        asked = [n for n, t in zip(names, told) if not t]
        hit = np.zeros(0, bool)
        if asked:
            every = np.concatenate(asked)
            order = np.argsort(every)
            same = np.concatenate(([False], every[order[1:]] == every[order[:-1]], [False]))
            hit = np.empty(len(every), bool)
            hit[order] = same[1:] | same[:-1]
        out_rows, out_names, seen = [], [], 0
        for k, n in enumerate(names):
            yes = np.ones(len(n), bool)
            if not told[k]:
                yes = hit[seen : seen + len(n)]
                seen += len(n)
            doc = np.repeat(np.arange(len(rows[k]) // 16), np.frombuffer(counts[k], np.int32))[yes]
            own = n[yes]
            cuts = [*np.flatnonzero(np.diff(doc)) + 1, len(doc)]
            for lo, hi in zip([0, *cuts[:-1]], cuts):
                if hi > lo:
                    out_rows.append(rows[k][16 * doc[lo] : 16 * doc[lo] + 16])
                    out_names.append(own[lo:hi].tobytes())
        return pa.Table.from_batches([target.batch([out_rows, out_names])])

    found = rows.select("row", "text").mapInArrow(run, SHIPPED).groupBy("bucket").applyInArrow(compare, TOLD)
    return found.groupBy("row").agg(F.collect_list("names").alias("names"))


def is_in(names: np.ndarray, parts: list[bytes]) -> np.ndarray:
    known = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in parts]))
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def least_words(block: np.ndarray) -> np.ndarray:
    """For each string of 50 bytes the least name of its blocks of 16."""
    for step in (1, 2, 4, 8, 16):  # windows of 2, 4, ... 32 blocks
        block = np.minimum(block[:-step], block[step:])
    return np.minimum(block[:-3], block[3:])  # of 35


def runs(data: bytes, shared: list[bytes], bits: int, mask: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, least word) of the runs of neighbouring suffixes that may be repeated and have one least word."""
    at, block = sample(len(data)), blocks(data, mask)
    starts = near(at[is_in(told_apart(names_at(block, at), bits), shared)], len(data))
    if not len(starts):
        return
    words = least_words(block)[starts]
    cuts = np.flatnonzero((np.diff(starts) != 1) | (words[1:] != words[:-1])) + 1
    lo, hi = np.concatenate(([0], cuts)), np.append(cuts, len(starts)) - 1
    yield from zip(starts[lo].tolist(), starts[hi].tolist(), (words[lo] * ODD[5]).tolist())


RUN = "bucket int, rows binary, ids binary, firsts binary, lasts binary, data binary"
SPAN = "row binary, firsts binary, lasts binary"


def dealt(held: list[tuple], run_bits: int) -> Iterator[pa.RecordBatch]:
    """A piece's runs (bucket, row, doc_id, first, last, data), a row for each bucket; data null: settled ones, which a larger id has as well as a smaller.

    Settled runs only tell their rows. They go anywhere, so that a frequent passage doesn't fill its bucket with them.
    """
    target = DDL(RUN)
    least: dict[bytes, int] = {}
    for _, _, doc_id, _, _, data in held:
        if doc_id < least.get(data, LAST + 1):
            least[data] = doc_id
    sent: dict[int, list[tuple]] = {}
    settled: dict[int, list[tuple]] = {}
    for x in held:
        if x[2] == least[x[5]]:
            sent.setdefault(x[0], []).append(x)
        else:
            settled.setdefault(int.from_bytes(x[1][:4], "little") & (1 << run_bits) - 1, []).append(x)
    for own, told in ((sent, False), (settled, True)):
        for bucket, xs in sorted(own.items()):
            _, rows, ids, firsts, lasts, data = zip(*xs)
            columns = [b"".join(rows), np.array(ids, np.int64).tobytes(), np.array(firsts, np.int32).tobytes(), np.array(lasts, np.int32).tobytes(), None if told else b"".join(data)]
            yield target.batch([[bucket], *([c] for c in columns)])


def repeated(rows: DataFrame, bits: int, run_bits: int, mask: int) -> DataFrame:
    """rows: row, doc_id, text, names. By row, the spans of starts (firsts, lasts: packed) of strings that a smaller doc_id has."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row, doc_id, text, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data = text.as_py().encode()
                for first, last, word in runs(data, names.as_py(), bits, mask):
                    held.append((word >> 64 - run_bits, row, doc_id, first, last, data[first : last + LENGTH]))
                    size += last + LENGTH - first
                if size >= PIECE:
                    yield from dealt(held, run_bits)
                    held, size = [], 0
        if held:
            yield from dealt(held, run_bits)

    spans = rows.select("row", "doc_id", "text", "names").mapInArrow(deal, RUN).groupBy("bucket").applyInArrow(compared, SPAN)
    return spans.groupBy("row").agg(F.collect_list(F.struct("firsts", "lasts")).alias("spans"))


def named(keys: np.ndarray) -> np.ndarray:
    """The ranks of keys in sorted order, as names."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], sorted_keys[1:] != sorted_keys[:-1])))
    return out


def triples(names: np.ndarray, at: np.ndarray, second: int, third: int) -> np.ndarray:
    """Names of the triples of names at each position, and `second` and `third` further on."""
    a, b, c = names[at], names[at + second], names[at + third]
    if names.max() < 1 << 21:
        return named(a << 42 | b << 21 | c)
    return named(named(a << 32 | b) << 32 | c)


def string_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 50 bytes at each position of `at` in data: equal names for equal bytes, in the order of the bytes."""
    words = named(np.ndarray((len(data) - WORD + 1,), ">u8", data, 0, (1,)).astype(np.uint64))
    threes = triples(words, np.arange(len(words) - 2 * WORD), WORD, 2 * WORD)
    return triples(threes, at, 3 * WORD, LENGTH - 3 * WORD)


def repeats(data: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last) of the spans of strings in different runs that a run with a smaller id has."""
    sizes = np.array([len(x) for x in data])
    count = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    names = string_names(np.frombuffer(b"".join(data), np.uint8), (np.cumsum(sizes) - sizes)[run] + place)
    order = np.argsort(names)
    heads = np.flatnonzero(np.concatenate(([True], names[order[1:]] != names[order[:-1]])))
    least = np.empty(len(run), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[run[order]], heads), np.diff(np.append(heads, len(order))))
    k = np.flatnonzero(ids[run] > least)
    cuts = np.flatnonzero((np.diff(k) != 1) | (run[k[1:]] != run[k[:-1]])) + 1
    lo, hi = (k[np.concatenate(([0], cuts))], k[np.append(cuts, len(k)) - 1]) if len(k) else (k, k)
    return run[lo], place[lo], place[hi]


def compared(part: pa.Table) -> pa.Table:
    """By row, the spans of the strings in a bucket's runs that a smaller doc_id has."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    held: list[tuple[bytes, int, int, bytes]] = []
    least: dict[bytes, int] = {}
    for x in part.to_pylist():
        rows = [x["rows"][k : k + 16] for k in range(0, len(x["rows"]), 16)]
        firsts, lasts = np.frombuffer(x["firsts"], np.int32).tolist(), np.frombuffer(x["lasts"], np.int32).tolist()
        if x["data"] is None:
            for row, first, last in zip(rows, firsts, lasts):
                found.setdefault(row, []).append((first, last))
            continue
        at = 0
        for row, doc_id, first, last in zip(rows, np.frombuffer(x["ids"], np.int64).tolist(), firsts, lasts):
            data = x["data"][at : at + last - first + LENGTH]
            at += len(data)
            held.append((row, doc_id, first, data))
            if doc_id < least.get(data, LAST + 1):
                least[data] = doc_id
    # Equal runs: those with a larger id are settled, those with the least have one result.
    holders: dict[bytes, list[tuple[bytes, int]]] = {}
    for row, doc_id, first, data in held:
        if doc_id > least[data]:
            found.setdefault(row, []).append((first, first + len(data) - LENGTH))
        else:
            holders.setdefault(data, []).append((row, first))
    if holders:
        data = list(holders)
        for k, lo, hi in zip(*(x.tolist() for x in repeats(data, np.array([least[d] for d in data], np.int64)))):
            for row, first in holders[data[k]]:
                found.setdefault(row, []).append((first + lo, first + hi))
    packed = [tuple(np.array(x, np.int32).tobytes() for x in zip(*spans)) for spans in found.values()]
    return pa.Table.from_batches([DDL(SPAN).batch([list(found), [f for f, _ in packed], [n for _, n in packed]])])


def removed(n: int, spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings starting in the spans cover, in a text of n bytes."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        np.add.at(edge, np.frombuffer(s["firsts"], np.int32), 1)
        np.add.at(edge, np.frombuffer(s["lasts"], np.int32) + LENGTH, -1)
    gone = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    return list(zip(np.flatnonzero(np.diff(gone) == 1).tolist(), np.flatnonzero(np.diff(gone) == -1).tolist()))


RESULT = "row binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a finished action's shuffle files go at once; its results are in checkpoints by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def deduplicated(documents: DataFrame, mask: int = ALL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (starts and ends in turn) of every row of documents.

    mask: the bits that count of the hashes by which suffixes are discarded and dealt out; the result doesn't depend on it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    row = F.unhex(identity(order, text))
    rows = documents.select(row.alias("row"), order.alias("doc_id"), text.alias("text"))
    light = checkpointed(documents.select("doc_id", row.alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), order.alias("_order")))
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(4, int(total * len(COVER) / MODULUS / BUCKET).bit_length())

    # Copies: all but those with the least id go whole, and needn't be compared.
    least = light.groupBy("sha").agg(F.min("_order").alias("_least"))
    known = light.join(least, "sha").withColumn("_copy", (F.col("_order") > F.col("_least")) & (F.col("n_bytes") >= LENGTH)).select("doc_id", "row", "n_bytes", "sha", "_copy")
    known = checkpointed(known)
    firsts = rows.join(known.where("not _copy").select("row").distinct(), "row", "left_semi")
    shared = checkpointed(shared_tuples(firsts, bits, mask))
    tuples = shared.agg(F.sum(F.aggregate("names", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    # A tuple stands for MODULUS / 5 suffixes, which take 3 to 4 bytes each in runs.
    run_bits = max(4, int(tuples / 8 * MODULUS / len(COVER) * 3.5 / RUN_BUCKET).bit_length())
    gone = checkpointed(repeated(rows.join(shared, "row"), bits, run_bits, mask))
    target = DDL(RESULT)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                spans = removed(len(data), own.as_py())
                kept, end = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(data[end:lo])
                    end = hi
                kept.update(data[end:])
                out.append((row, sum(hi - lo for lo, hi in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
            if out:
                yield target.batch(list(zip(*out)))

    # Rows alike in id and text have one result.
    changed = rows.join(gone, "row").select("row", "text", "spans").mapInArrow(finish, RESULT).dropDuplicates(["row"])
    whole = F.col("_copy")
    return known.join(changed, "row", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    with shuffles_dropped(spark):
        return deduplicated(table(spark, sf_dir, "documents")).drop("spans")
