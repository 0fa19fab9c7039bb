"""Words of a row's text, counted in its row.

Columns can't count an array's items but by exploding it, which deals every word of every text out across the cluster to bring those of one row together again. These
count in Arrow batches where the row is, and deal out nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..plans.session import spread

#: functions.text.TERM in UTF-8 with ASCII capitals lowered, and runs of a to z: all other bytes are blanks.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def letter_runs(low: bytes) -> list[bytes]:
    """The runs of the letters a to z of a lower-case text."""
    return low.translate(LETTERS).split()


def term_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """term, key, tf: the index terms of each row's text. Null and empty texts have none."""
    own = spread(rows.select(key, text.cast("binary").alias("_text")))
    schema = t.StructType([t.StructField("term", t.StringType()), own.schema[key], t.StructField("tf", t.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(x.as_py() or b"")) for x in batch.column(1)]
            terms = pa.array([w for c in found for w in c], pa.binary()).cast(pa.string())
            row = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays([terms, batch.column(0).take(pa.array(row)), pa.array([n for c in found for n in c.values()], pa.int64())], names=["term", key, "tf"])

    return own.mapInArrow(run, schema)


def bags(rows: DataFrame, keys: list[str], text: Column, rule: Callable[[str], str] | None = None) -> DataFrame:
    """keys, terms, tfs: the different index terms of each row's text, with their counts, one row for each row. rule: what a term counts as; it is asked once a task for each."""
    own = spread(rows.select(*keys, text.cast("binary").alias("_text")))
    schema = t.StructType([*[own.schema[k] for k in keys], t.StructField("terms", t.ArrayType(t.StringType())), t.StructField("tfs", t.ArrayType(t.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}

        def counted(words: list[bytes]) -> Counter:
            if rule is None:
                return Counter(words)
            for w in set(words) - known.keys():
                known[w] = rule(w.decode()).encode()
            return Counter(map(known.__getitem__, words))

        for batch in batches:
            found = [counted(terms_of(x.as_py() or b"")) for x in batch.column(len(keys))]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array([w for c in found for w in c], pa.binary()).cast(pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([n for c in found for n in c.values()], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], terms, tfs], names=[*keys, "terms", "tfs"])

    return own.mapInArrow(run, schema)


def frequent_words(rows: DataFrame, keys: list[str], text: Column, stop: list[str], most: int) -> DataFrame:
    """keys, keywords: the words of three letters or more of each row's lower-cased text, by count and then first place, without stop words."""
    own = spread(rows.select(*keys, text.cast("binary").alias("_text")))
    schema = t.StructType([*[own.schema[k] for k in keys], t.StructField("keywords", t.ArrayType(t.StringType()))])
    left_out = frozenset(w.encode() for w in stop)

    def first(low: bytes | None) -> list[str]:
        found = Counter(letter_runs(low or b""))
        for w in [w for w in found if len(w) < 3 or w in left_out]:
            del found[w]
        return [w.decode() for w, _ in found.most_common(most)]  # equal counts stay in the order of first places

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([first(x.as_py()) for x in batch.column(len(keys))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], names=[*keys, "keywords"])

    return own.mapInArrow(run, schema)


def holding(chunks: DataFrame, words: list[str], most: int | None = None) -> DataFrame:
    """k, chunk_ids: the ids of the chunks (chunk_id, t in lower case) that hold the word k anywhere. most: at least the first so many of all, by id.

    A word of the letters a to z lies in a run of them. A task looks through each different run once for all words, by their lengths; other words are looked for
    in the texts. A word with `most` ids in a task is closed there: only smaller ids count after.
    """
    wanted = chunks.sparkSession.sparkContext.broadcast([w.encode() for w in words])
    schema = t.StructType([t.StructField("k", t.StringType()), t.StructField("chunk_ids", t.ArrayType(chunks.schema["chunk_id"].dataType))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {w: [] for w in wanted.value}
        other = {w for w in held if letter_runs(w) != [w]}
        letters = held.keys() - other
        sizes = sorted({len(w) for w in letters})
        left, known, last, kind = set(held), {}, None, None

        def within(text: bytes) -> set[bytes]:
            return {text[k : k + size] for size in sizes if size <= len(text) for k in range(len(text) - size + 1)} & letters

        for batch in batches:
            kind = batch.schema.field(0).type
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (low := text.as_py()) is None:
                    continue
                early = last is not None and chunk < last  # closed words may want it
                hits = {w for w in other if (early or w in left) and w in low}
                for piece in set(letter_runs(low)):
                    if early:
                        hits |= within(piece)
                        continue
                    if (own := known.get(piece)) is None:
                        if len(known) >= 500_000:
                            known.clear()
                        own = known[piece] = within(piece) & left
                    if own:
                        hits |= own
                        if not own <= left:
                            known[piece] = own & left
                for w in hits:
                    ids = held[w]
                    if w in left:
                        ids.append(chunk)
                        if len(ids) == most:
                            left.remove(w)
                            last = max(ids) if last is None else max(last, *ids)
                    elif chunk < max(ids):
                        held[w] = sorted([*ids, chunk])[:most]
        found = {w: ids for w, ids in held.items() if ids}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found]), pa.array(list(found.values()), pa.list_(kind))], names=["k", "chunk_ids"])

    few = 2 * chunks.sparkSession.sparkContext.defaultParallelism  # each task has `most` ids of a word
    own = spread(chunks.select("chunk_id", F.col("t").cast("binary").alias("t")))
    return own.coalesce(few).mapInArrow(run, schema)


def numbered_by(rule: Callable[[Iterable], list], kind: str = "int") -> Callable[[Column], Column]:
    """A column function that puts arrays through a rule that goes along an array once, keeping a state. A fold of columns would copy its growing array at each step."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(rule)

    return F.pandas_udf(run, f"array<{kind}>")
