"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A partition's texts are cut into words by the vocabulary's pattern; each distinct word is encoded once. A word is rows of
(position, token, next token). A recursive query joins them with the merge table (all pairs of tokens whose bytes
together are a token, by rank), finds each word's leftmost pair of least rank, contracts it, and goes on with the words that
had one, until none has. A text's ids are those of its words, one after another. Decoding joins the rows (text, position, token) with the
vocabulary and aggregates the tokens' bytes in order.

A task numbers its distinct words and encodes the new ones of each PIECE_BYTES of text, WORDS at a time; beyond KNOWN words it starts afresh.
Words of over LONG bytes (runs of one kind of character) go through a query that keeps a row a position instead of one a step, and
contracts all pairs at once that would go one after another; the result is the same. 100,000 random letters A, C, G and T take 0.7 s.

Null texts encode as empty ones: no tokens. Special tokens aren't known; their text is ordinary text. Repeated rows are rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DDL, bounded_batches, table

PIECE_BYTES = 8_000_000
DECODE_BYTES = 1_000_000
WORDS = 40_000
QUERY_BYTES = 400_000
KNOWN = 400_000
LONG = 32
MEMORY_MB = 120
NONE = np.zeros(0, np.int32)

# Letters, numbers and white space below U+0250, as the Unicode classes of the pattern have them.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: Texts with these characters only can go through the standard library's faster matcher.
PLAIN = re.compile("[\t-\r -~\x85\xa0-ɏ]*")
PLAIN_WORDS = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)

CONTRACTED = """
WITH RECURSIVE state(step, word, i, tok, j, nxt) AS (
  SELECT 0, word, i, tok, j, nxt FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT s.*, m.rank FROM state s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt
   ), best AS (
     SELECT word, min((CAST(rank AS BIGINT) << 32) + i) AS at, arg_min(j, (CAST(rank AS BIGINT) << 32) + i) AS right_i
     FROM pairs WHERE rank IS NOT NULL GROUP BY word
   )
   SELECT p.step + 1, p.word, p.i,
          CASE WHEN p.i = b.right_i THEN CAST(b.at >> 32 AS INTEGER) ELSE p.tok END,
          CASE WHEN p.j = b.at & 4294967295 THEN b.right_i ELSE p.j END,
          CASE WHEN p.j = b.at & 4294967295 THEN CAST(b.at >> 32 AS INTEGER) ELSE p.nxt END
   FROM pairs p JOIN best b USING (word)
   WHERE p.i <> b.at & 4294967295)
), ended AS (
  SELECT word, max(step) AS step FROM state GROUP BY word
)
SELECT list(tok ORDER BY i) AS ids FROM state JOIN ended USING (word, step) GROUP BY word ORDER BY word
"""

#: The same contraction for long words. A row a position is kept, the newest, instead of one a step; a dead position has token -1. Of a word's pairs of
#: least rank all that don't overlap are contracted in one step, from the left, as one after another would be: up to and including
#: the first (`odd`) that makes a new pair of lower rank with a neighbour, which has to go before the others.
CONTRACTED_LONG = """
WITH RECURSIVE state(word, i, tok, j, nxt) USING KEY (word, i) AS (
  SELECT word, i, tok, j, nxt FROM start
  UNION
  (WITH live AS MATERIALIZED (
     SELECT s.* FROM recurring.state s SEMI JOIN state USING (word) WHERE s.tok >= 0
   ), pairs AS MATERIALIZED (
     SELECT s.word, s.i, s.j, m.rank FROM live s JOIN merges m ON m.l = s.tok AND m.r = s.nxt
   ), best AS (
     SELECT word, min(rank) AS rank FROM pairs GROUP BY word
   ), least AS MATERIALIZED (
     SELECT p.* FROM pairs p JOIN best b ON b.word = p.word AND b.rank = p.rank
   ), linked AS MATERIALIZED (
     SELECT a.word, a.i FROM least a SEMI JOIN least b ON b.word = a.word AND b.j = a.i
   ), chains AS (
     SELECT l.*, max(CASE WHEN k.i IS NULL THEN l.i END) OVER (PARTITION BY l.word ORDER BY l.i) AS chain
     FROM least l SEMI JOIN linked w ON w.word = l.word LEFT JOIN linked k ON k.word = l.word AND k.i = l.i
   ), apart AS MATERIALIZED (
     SELECT l.* FROM least l ANTI JOIN linked w ON w.word = l.word
     UNION ALL SELECT word, i, j, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, chain ORDER BY i) AS n FROM chains) WHERE n % 2 = 1
   ), odd AS (
     SELECT c.word, min(c.i) AS i FROM apart c SEMI JOIN lower o ON o.tok = c.rank
     JOIN live q ON q.word = c.word AND q.i = c.j LEFT JOIN live p ON p.word = c.word AND p.j = c.i
     WHERE EXISTS (FROM lower o WHERE o.tok = c.rank AND (o.l = c.rank AND o.r IN (q.nxt, c.rank) OR o.r = c.rank AND o.l = p.tok)) GROUP BY c.word
   ), chosen AS MATERIALIZED (
     SELECT c.* FROM apart c LEFT JOIN odd o USING (word) WHERE o.i IS NULL OR c.i <= o.i
   ), merged AS MATERIALIZED (
     SELECT c.word, c.i, c.rank AS tok, s.j, coalesce(d.rank, s.nxt) AS nxt, c.j AS gone FROM chosen c JOIN live s ON s.word = c.word AND s.i = c.j LEFT JOIN chosen d ON d.word = c.word AND d.i = s.j
   )
   SELECT word, i, tok, j, nxt FROM merged
   UNION ALL SELECT word, gone, -1, -1, -1 FROM merged
   UNION ALL SELECT s.word, s.i, s.tok, s.j, m.tok FROM live s JOIN merged m ON m.word = s.word AND m.i = s.j
     ANTI JOIN merged x ON x.word = s.word AND x.gone = s.i ANTI JOIN merged y ON y.word = s.word AND y.i = s.i)
)
SELECT list(tok ORDER BY i) AS ids FROM state WHERE tok >= 0 GROUP BY word ORDER BY word
"""

DECODED = "SELECT string_agg(v.chars, '' ORDER BY t.pos) AS chars FROM tokens t JOIN vocabulary v USING (tok) GROUP BY t.row ORDER BY t.row"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, once a worker process."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(vocabulary: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """(left, right, rank) of all pairs of tokens whose bytes together are a token."""
    out = [(vocabulary[token[:k]], vocabulary[token[k:]], rank) for token, rank in vocabulary.items() for k in range(1, len(token)) if token[:k] in vocabulary and token[k:] in vocabulary]
    return tuple(map(list, zip(*out))) if out else ([], [], [])


def known_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Words to ids, and ids to texts, many at a time, in a DuckDB database in memory. A worker process keeps it, without any words.

    It may not write to disk: a query beyond its memory fails. Long words have a limit in proportion to their bytes.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = ranks(path)
        self.full = regex.compile(pattern)
        self.plain = pattern == known_pattern()  # PLAIN_WORDS cuts as this pattern only
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        left, right, rank = merge_table(self.ranks)
        self.db.register("given", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())}))
        self.db.execute("CREATE TABLE merges AS FROM given")
        self.db.execute("CREATE TABLE lower AS SELECT l AS tok, l, r FROM merges WHERE rank < l UNION ALL SELECT r, l, r FROM merges WHERE rank < r")
        # A byte travels as the character of its number.
        self.db.register("given", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS FROM given")
        self.db.unregister("given")

    def words(self, text: str) -> list[str]:
        return [m.group() for m in self.full.finditer(text)] if not self.plain or not PLAIN.fullmatch(text) else PLAIN_WORDS.findall(text)

    def coded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [NONE] * len(words)
        short, long = [], []
        for k, word in enumerate(words):
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                out[k] = np.array([rank], np.int32)
            else:
                (long if len(data) > LONG else short).append((len(data), k, data))
        for todo, sql in ((short, CONTRACTED), (long, CONTRACTED_LONG)):
            todo.sort()  # words of like lengths need like numbers of steps
            start = 0
            while start < len(todo):
                end, held = start, 0
                while end < len(todo) and end - start < WORDS and (end == start or held + todo[end][0] <= QUERY_BYTES):
                    held += todo[end][0]
                    end += 1
                for (_, k, _), ids in zip(todo[start:end], self.contracted([data for *_, data in todo[start:end]], sql, held)):
                    out[k] = ids
                start = end
        return out

    def contracted(self, words: list[bytes], sql: str, held: int) -> list[np.ndarray]:
        sizes = np.array([len(d) for d in words])
        tokens = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        i = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = i == np.repeat(sizes - 1, sizes)
        start = {"word": word, "i": i.astype(np.int64), "tok": tokens, "j": np.where(last, -1, i + 1).astype(np.int64), "nxt": np.where(last, -1, np.roll(tokens, -1)).astype(np.int32)}
        return split(self.asked("start", pa.table(start), sql, held).column("ids"))

    def decoded(self, rows: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each row that has ids, in order of rows: its tokens' bytes aggregated by position."""
        if not len(ids):
            return []
        given = pa.table({"row": rows.astype(np.int32), "pos": np.arange(len(ids), dtype=np.int32), "tok": ids})
        return [x.encode("latin-1") for x in self.asked("tokens", given, DECODED, len(ids) * 4).column("chars").to_pylist()]

    def asked(self, name: str, given: pa.Table, sql: str, held: int) -> pa.Table:
        if more := held > QUERY_BYTES:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB + held // 2000}MB'")
        self.db.register(name, given)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)
            if more:
                self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")


def split(lists: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in lists.chunks:
        values, cuts = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return out


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class Numbered(dict):
    """Words by number, in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Known:
    """The words that a task has met: their numbers, ids one after another, and ids as text."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.numbers, self.said = Numbered(), []
        self.flat, self.starts, self.sizes = NONE, NONE, NONE

    def learn(self) -> None:
        """Encodes the words that have a number and no ids."""
        new = list(islice(reversed(self.numbers), len(self.numbers) - len(self.said)))[::-1]
        if not new:
            return
        ids = self.encoder.coded(new)
        sizes = np.array([len(x) for x in ids], np.int32)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, *ids))
        self.said += [" ".join(map(str, x.tolist())) for x in ids]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The ids of words in order, given their numbers."""
        sizes = self.sizes[words]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[words] - (ends - sizes), sizes)]


def pieces(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about that many bytes of its first column."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
        held += n
        if held >= chars:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def coded(rows: DataFrame, keys: list[str], path: str, pattern: str, finish: Callable, schema: str) -> DataFrame:
    """keys and what finish(ids, said, decoded) returns for each row's text: ids as an array, as decimal text, and their bytes."""
    bounded_batches(rows.sparkSession)
    picked = rows.select("text", *keys)
    kinds = dict(picked.dtypes)
    out = ", ".join([*(f"{k} {kinds[k].replace('bigint', 'long')}" for k in keys), schema])
    target = DDL(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            encoder = encoder_of(path, pattern)
            for piece in pieces(batch, PIECE_BYTES):
                if known is None or len(known.numbers) > KNOWN:
                    known = Known(encoder)
                cut = [np.array(array("I", map(known.numbers.__getitem__, encoder.words(t.as_py() or ""))), np.uint32) for t in piece.column(0)]
                known.learn()
                at = 0
                for part in pieces(piece, DECODE_BYTES):
                    own = cut[at : at + part.num_rows]
                    at += part.num_rows
                    ids = [known.ids(words) for words in own]
                    decoded = iter(encoder.decoded(np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids)))
                    made = [finish(x, " ".join(map(known.said.__getitem__, words.tolist())), next(decoded) if len(x) else b"") for x, words in zip(ids, own)]
                    yield target.batch([*(c.to_pylist() for c in part.columns[1:]), *zip(*made)])

    return picked.mapInArrow(run, out)


def encoded(rows: DataFrame, keys: list[str], path: str, pattern: str) -> DataFrame:
    """keys, n_tokens, ids (array) and the decoded text of every row."""
    return coded(rows, keys, path, pattern, lambda ids, said, data: (len(ids), ids.tolist(), data.decode()), "n_tokens long, ids array<int>, decoded string")


def digest(ids: np.ndarray, said: str, data: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(data).hexdigest()


def digested(rows: DataFrame, keys: list[str]) -> DataFrame:
    import public_tokenizers

    return coded(rows, keys, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ids and the digests of every row."""
    import public_tokenizers

    finish = lambda ids, said, data: (*digest(ids, said, data), ids)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return coded(rows, keys, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, finish, schema)


def op4_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
