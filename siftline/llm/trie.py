"""Prefix trie of conversations from vertical bitmaps.

A conversation's place in order is its bit. In a shard, an index gives for each (position, turn) the bitset of the conversations that have that turn
there. Depth first, a node's bitset is intersected with the posting of the turn that its lowest remaining bit has next: that is a child; its bits are taken
out and the next lowest one gives the next child. Popcounts are members, lowest bits least members, and the bits whose conversations are over are the end list.

1. Turns are numbered within conversations by a range sort across the cluster and counts a partition, so that one endless conversation is spread out too.
2. Shards: conversations whose first row lies in one stripe of STRIPE sorted rows, by bands of BAND positions. The exclusive-or of 128-bit
   digests of (position, role, text) up to a node is its key. A band's first bitsets are the conversations with equal keys before it.
3. Shards' nodes add up by key: members, least member. Each shard has at most one row a node, so a common first turn is no large group.
4. A node belongs to its least member; a conversation's own nodes are the last ones of its path. So all that is summed over a subtree is a sum over the
   node's members of one value each: whether it owns a childless node, and the bytes of its path before its own nodes. A second
   walk through the shards sums these two.
5. The digest of an end list runs over the shards' lists in order, as a stream; SHA-256 has to read them one after another.

Rows without conv_id belong to no conversation. Null roles and texts are empty, null turns come first, rows with one turn number follow in the order of their
digests. Turns may repeat and be of any length. Conversation c - c % 5 uses the floor, also below zero. An empty table has no nodes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DDL, table, written

STRIPE_BITS = 13
BAND = 512
GROUP, HEADS = 5, 9
KEY = ["depth", "k1", "k2"]
SHARD = "block long, band long, conv_id long, at long, k1 long, k2 long, bytes long, last long, shared long, leaf long"
NODES = "block long, depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n long, bytes long, prefix long, ends binary"
SUMS = "depth long, k1 long, k2 long, conv_id long, own_shared long, shared long, leaves long"
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, at, t1, t2, bytes) with their positions from 1, and conversations (conv_id, n, block). Columns of the first: conv_id, part, at, t1, t2, bytes, first, before."""
    digest = lambda k: F.xxhash64(F.lit(k), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("salt")]
    narrow = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest(1).alias("t1"), digest(2).alias("t2"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    dealt = narrow.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    rows = written(dealt.select("conv_id", "t1", "t2", "bytes", F.shiftright(row, 33).alias("part"), row.alias("row")), "trie-turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(counts.withColumn("before", before), "trie-parts")
    return rows, parts


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows conv_id, block, at (from 1), k1, k2 (the digest of position and turn), bytes of the rebuilt conversations; conv_id, block, last of all."""
    rows, parts = numbered(turns)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.shiftright(F.min("first"), STRIPE_BITS).alias("block"))
    own = own.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("last", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-conversations")
    placed = rows.join(parts.join(convs, "conv_id").select("conv_id", "part", "first", "before", "h", "taken", "block"), ["conv_id", "part"])
    placed = placed.withColumn("at", F.col("row") - F.col("first") + F.col("before") + 1)
    rest = placed.where("at > h").select("conv_id", "block", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "t1", "t2", "bytes")
    heads = placed.where((F.col("at") < HEADS) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).select(F.col("conv_id").alias("base"), "at", "t1", "t2", "bytes")
    lent = heads.join(convs.select("base", "conv_id", "block", "taken"), "base").where("at <= taken").select("conv_id", "block", "at", "t1", "t2", "bytes")
    keyed = rest.unionByName(lent).select("conv_id", "block", "at", F.xxhash64("at", "t1").alias("k1"), F.xxhash64("at", "t2").alias("k2"), "bytes")
    return written(keyed, "trie-rebuilt"), convs.select("conv_id", "block", "last")


class Shard:
    """The conversations of a stripe in a band: their bits, postings, lengths and start."""

    def __init__(self, rows: pa.Table, band_size: int) -> None:
        own = rows.sort_by([("conv_id", "ascending"), ("at", "ascending")])
        conv, at, k1, k2, size, last, shared, leaf = (own.column(c).to_pylist() for c in ("conv_id", "at", "k1", "k2", "bytes", "last", "shared", "leaf"))
        self.block, self.start = own.column("block")[0].as_py(), own.column("band")[0].as_py() * band_size
        self.ids: list[int] = []
        self.turns: list[list[tuple[int, int, int]]] = []
        self.starts: dict[tuple[int, int, int], int] = defaultdict(int)
        self.last, self.shared, self.leaf = [], [], []
        self.index: dict[tuple[int, int, int], int] = defaultdict(int)
        for k in range(len(conv)):
            if at[k] == 0:  # the conversation's row of the band: what comes before
                bit = 1 << len(self.ids)
                self.ids.append(conv[k])
                self.turns.append([])
                self.starts[k1[k], k2[k], size[k]] |= bit
                self.last.append(last[k])
                self.shared.append(shared[k])
                self.leaf.append(leaf[k])
            else:
                self.index[len(self.turns[-1]), k1[k], k2[k]] |= bit
                self.turns[-1].append((k1[k], k2[k], size[k]))
        most = max(map(len, self.turns), default=0)
        #: By number of the shard's turns: who has more, who stops here, and who is over.
        self.more, self.stops, self.over = ([0] * (most + 2) for _ in range(3))
        for k, turns in enumerate(self.turns):
            self.stops[len(turns)] |= 1 << k
            if self.start + len(turns) == self.last[k]:
                self.over[len(turns)] |= 1 << k
        for n in range(most - 1, -1, -1):
            self.more[n] = self.more[n + 1] | self.stops[n + 1]

    def walk(self) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
        """Nodes, parents first: parent's place (-1: none), depth in the shard, key, parent's key, bytes of the last turn and of the path, bitset."""
        stack, made = [], 0
        for (k1, k2, prefix), bits in self.starts.items():
            yield -1, 0, (k1, k2), (0, 0), 0, prefix, bits
            stack.append((made, 0, k1, k2, prefix, bits))
            made += 1
        while stack:
            place, depth, k1, k2, prefix, bits = stack.pop()
            left = bits & self.more[depth]
            while left:
                t1, t2, size = self.turns[(left & -left).bit_length() - 1][depth]
                child = bits & self.index[depth, t1, t2]
                left &= ~child
                yield place, depth + 1, (k1 ^ t1, k2 ^ t2), (k1, k2), size, prefix + size, child
                if child & self.more[depth + 1]:
                    stack.append((made, depth + 1, k1 ^ t1, k2 ^ t2, prefix + size, child))
                made += 1

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def nodes(self) -> Iterator[tuple]:
        for _, depth, key, parent, size, prefix, bits in self.walk():
            if depth == 0 and self.start:
                continue  # the band before has it
            ended = bits & self.over[depth]
            ends = ",".join(str(self.ids[k]) for k in self.members(ended)).encode() if ended else None
            yield self.block, self.start + depth, *key, *parent, self.ids[(bits & -bits).bit_length() - 1], bits.bit_count(), size, prefix, ends

    def sums(self) -> Iterator[tuple]:
        """Per node: its least member here and that one's shared bytes; members' shared bytes and leaves."""
        found, shared, leaves = list(self.walk()), [], []
        for _, depth, *_, bits in found:
            here = list(self.members(bits & self.stops[depth]))
            shared.append(sum(self.shared[k] for k in here))
            leaves.append(sum(self.leaf[k] for k in here))
        for k in range(len(found) - 1, -1, -1):
            if (up := found[k][0]) >= 0:
                shared[up] += shared[k]
                leaves[up] += leaves[k]
        for (_, depth, key, _, _, _, bits), a, b in zip(found, shared, leaves):
            if depth or not self.start:
                first = (bits & -bits).bit_length() - 1
                yield self.start + depth, *key, self.ids[first], self.shared[first], a, b


def walked(rows: DataFrame, bands: DataFrame, what: str, schema: str, band_size: int) -> DataFrame:
    """What the shards' walks give. rows: turns; bands: a row a conversation and band."""
    columns, target = [x.split()[0] for x in SHARD.split(", ")], DDL(schema)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("last", "shared", "leaf")]
    turns = rows.select("block", F.expr(f"(at - 1) div {band_size}").alias("band"), "conv_id", "at", "k1", "k2", "bytes", *nothing)
    both = turns.unionByName(bands.withColumn("at", F.lit(0).cast("long")).select(*columns))

    def run(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([target.batch(list(zip(*getattr(Shard(rows, band_size), what)())) or [[]] * len(target.names))])

    return both.groupBy("block", "band").applyInArrow(run, schema)


def banded(rows: DataFrame, convs: DataFrame, band_size: int) -> DataFrame:
    """conv_id, block, band, last, and k1, k2, bytes of all that comes before the band; every conversation has band 0."""
    own = rows.groupBy("conv_id", "block", F.expr(f"(at - 1) div {band_size}").alias("band")).agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    first = convs.where("last = 0").select("conv_id", "block", zero.alias("band"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda f, c: F.coalesce(f(c).over(before), zero).alias(c)
    whole = F.sum("bytes").over(Window.partitionBy("conv_id")).alias("all_bytes")
    both = own.unionByName(first).select("conv_id", "block", "band", earlier(F.bit_xor, "k1"), earlier(F.bit_xor, "k2"), earlier(F.sum, "bytes"), whole)
    return both.join(convs.select("conv_id", "last"), "conv_id")


def end_digests(nodes: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes with ends: shards' lists, in order, as a stream."""
    schema = "depth long, k1 long, k2 long, ends_sha256 string"
    target = DDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *here, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if here != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = here, hashlib.sha256(ends)
                else:
                    digest.update(b"," + ends)
            if out:
                yield target.batch(list(zip(*out)))
        if key is not None:
            yield target.batch([[x] for x in (*key, digest.hexdigest())])

    ordered = nodes.where("ends is not null").select(*KEY, "block", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return ordered.select(*KEY, "ends").mapInArrow(run, schema)


def prefix_trie(conversations: DataFrame, band_size: int = BAND) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations; see the module's text. The tables stay in the shared folder for the result."""
    rows, convs = rebuilt(conversations)
    bands = written(banded(rows, convs, band_size), "trie-bands")
    zero = F.lit(0).cast("long")
    local = written(walked(rows, bands.withColumn("shared", zero).withColumn("leaf", zero), "nodes", NODES, band_size), "trie-local")
    nodes = local.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "bytes", "prefix")], F.sum("n").alias("n_convs"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    tree = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")
    by_depth = lambda c: F.min_by(c, "depth")
    chains = tree.groupBy("conv_id").agg(F.min("depth").alias("depth"), by_depth(F.col("prefix") - F.col("bytes")).alias("shared"), by_depth("p1").alias("p1"), by_depth("p2").alias("p2"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"))
    chains = written(chains, "trie-chains")
    valued = bands.join(chains.select("conv_id", "shared", "leaf"), "conv_id", "left").withColumn("shared", F.coalesce("shared", "all_bytes")).withColumn("leaf", F.coalesce("leaf", zero))
    sums = walked(rows, valued, "sums", SUMS, band_size).groupBy(*KEY).agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("n_leaves"), F.min_by("own_shared", "conv_id").alias("own_shared"))
    # The parent of a chain's first node: the root for most; for the others, AQE splits what a common parent makes large.
    up = tree.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    root = tree.where("depth = 0").select("conv_id").first()  # one row, none of an empty table
    heads = chains.where("depth > 1").join(up, ["depth", "p1", "p2"]).select("conv_id", "depth", "up").unionByName(chains.where("depth = 1").select("conv_id", "depth", F.lit(root and root[0]).cast("long").alias("up")))
    every = tree.join(sums, KEY).join(heads, ["conv_id", "depth"], "left").join(end_digests(local), KEY, "left")
    saved: Column = F.col("shared") - F.col("own_shared") - (F.col("n_convs") - 1) * (F.col("prefix") - F.col("bytes"))
    return every.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The same in DuckDB; the CRC goes byte by byte through the table of the polynomial 0xEDB88320. Prefixes are told apart by the MD5 of all their turns.
OP12_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
         xor(list_reduce([4294967295::BIGINT] || [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..')],
                         lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), parts AS (
  SELECT c.conv_id, 0 AS part, t.pos AS pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, md5(role || chr(1) || text) AS turn, strlen(text) AS bytes FROM parts
), paths AS (
  SELECT conv_id, depth, md5(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY key, depth
), ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
  FROM paths JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) USING (conv_id, depth) GROUP BY key
), linked AS (
  SELECT n.key, n.depth, n.conv_id, n.n_convs, n.bytes, p.key AS up, q.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.key = p.key
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM linked n LEFT JOIN (SELECT up, count(*) AS n FROM linked GROUP BY up) c ON c.up = n.key
), subtrees AS (
  SELECT a.key, CAST(sum((d.n_convs - 1) * d.bytes) AS BIGINT) AS saved_tokens, CAST(sum(CAST(d.n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves
  FROM counted d JOIN paths a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.key
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM counted JOIN subtrees USING (key) LEFT JOIN ends USING (key)
"""
