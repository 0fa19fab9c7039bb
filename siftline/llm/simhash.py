"""SimHash near-duplicates by meeting in the middle.

A fingerprint has 64 bits; two link at RADIUS = 3 or fewer differing bits. Balls of half the radius, 1 bit,
meet for pairs up to 2 bits apart. For the third bit one of four 16-bit blocks is blanked: of the differing bits of
a pair at 3, some block holds at least one, and without that block at most 2 are left. So each
distinct fingerprint emits, for every block, what is left of it and all variants with one more bit flipped,
4 * 49 = 196 keys. They are shuffled; fingerprints that meet are verified on all 64 bits. No pair within
the radius is missed, and none beyond it is kept.

A key's distinct members differ in one blanked block and one flipped bit, so there are never more than
49 * 2**16 of them: a bucket fits in a task at any size of the input, and copies collapse into one fingerprint
before. Within a bucket only the edges of a spanning forest are kept, not all pairs.

Null and empty texts and texts without words have fingerprint zero and link like any other. Repeated rows
keep their rows. A null doc_id has a row; a component whose ids are all null has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, clear, identity, map_rows, table
from .components import connected

RADIUS = 3
BLOCKS = 4
SHINGLE = 3
SEED = 42


def simhash(text: str | None) -> int:
    """Fingerprint as a signed 64-bit integer: bit k is the majority of bit k over the shingles' XXH64."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (long) of every row."""
    rows = documents.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return map_rows(rows, lambda: lambda text, doc_id: (doc_id, simhash(text)), "doc_id long, fingerprint long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball_keys(prints: DataFrame) -> DataFrame:
    """(key, fingerprint): the balls' variants of each row of prints. The blanked block holds the block's number."""
    width = 64 // BLOCKS
    variants = []
    for block in range(BLOCKS):
        low = block * width
        keep = (1 << 64) - 1 ^ ((1 << width) - 1 << low)
        flips = [0, *(1 << i for i in range(64) if keep >> i & 1)]
        variants += [F.struct(F.lit(signed(keep)).alias("keep"), F.lit(signed(f | block + 1 << low)).alias("flip")) for f in flips]
    return prints.select("fingerprint", F.explode(F.array(*variants)).alias("v")).select(
        F.col("fingerprint").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fingerprint"
    )


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links members at RADIUS bits or fewer."""
    edges, rest = [], members
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            node = reached.pop()
            near = np.bitwise_count(rest ^ node) <= RADIUS
            found = rest[near]
            rest = rest[~near]
            edges += [(int(node), int(x)) for x in found]
            reached += list(found)
    return edges


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of a partition that is sorted by key; each fingerprint pair once a partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        out = []
        for k in np.flatnonzero(ends - starts > 1).tolist():
            for a, b in forest(prints[starts[k] : ends[k]]):
                x, y = find(a), find(b)
                if x != y:
                    parent[x] = y
                    out.append((a, b))
        pairs = np.array(out, np.uint64).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        prints = np.concatenate((prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
        if whole:
            yield links(keys[:whole], prints[:whole])
            keys, prints = keys[whole:], prints[whole:]
    if len(keys):
        yield links(keys, prints)


def near_links(distinct_prints: DataFrame) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints, enough to connect all that are RADIUS bits or fewer apart."""
    keys = ball_keys(distinct_prints)
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(verified, "src long, dst long")


def near_groups(prints: DataFrame) -> DataFrame:
    """(fingerprint, root) of every distinct fingerprint in prints; root is the least fingerprint of its component."""
    distinct_prints = prints.select("fingerprint").distinct()
    roots = connected(near_links(distinct_prints)).withColumnRenamed("node", "fingerprint")
    return distinct_prints.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of documents."""
    docs = checkpointed(fingerprints(documents))
    least = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    rooted = near_groups(docs).join(least, "fingerprint")
    known = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fingerprint", "component_id")
    return docs.join(known, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each(documents: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they are: the least doc_id, then the least MD5 of the text.

    Texts move once, by the digest of id and text that both the choice of the row and that of one of its full copies go by.
    """
    rows = documents.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), identity(F.col("doc_id").cast("long"), F.col("text")).alias("alike"))
    docs = checkpointed(map_rows(rows, lambda: lambda text, doc_id, own, alike: (doc_id, own, alike, simhash(text)), "doc_id long, digest string, alike string, fingerprint long"))
    # A null id comes after all others.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "alike"))
    of_print = docs.groupBy("fingerprint").agg(first.alias("first"))
    p = clear(documents)
    alike, copy = f"{p}alike", f"{p}copy"
    kept = near_groups(docs).join(of_print, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.alike").alias(alike))
    same = documents.withColumn(alike, identity(F.col("doc_id").cast("long"), F.col("text"))).join(kept, alike, "left_semi")
    return same.withColumn(copy, F.row_number().over(Window.partitionBy(alike).orderBy(F.lit(0)))).where(F.col(copy) == 1).select(*documents.columns)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
