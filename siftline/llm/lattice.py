"""Language-model scores of texts: the marginal probability over all segmentations into the pieces of an existing vocabulary.

The model writes a text as pieces, one after another, each drawn by its own probability, and an end. A piece that begins with the space mark begins a
word, so a text's probability is the product of its words' and the end's, and a word's is the sum over all ways to cut it: the lattice's forward
recursion, in logarithms. Every character can also be written as the bytes of its UTF-8, so no text has probability zero.

The vocabulary's scores give the starting probabilities: log-probabilities as they are, merge ranks (a BPE file's scores) as 1 / (RANK + rank). ROUNDS
rounds over all different words of the training documents, weighted by their counts, then gather how often each piece is expected to occur (forward and
backward recursion) and take that as the next probabilities, one added to each count. The vocabulary itself stays as it is.

1. Segments: a partition's documents go into segments of SEGMENT_BYTES of text; a segment is a dictionary of its words with their counts in training
   documents, and one row of each document's words as numbers in it (`train` is the number of training documents there). Both go to a table in the shared folder.
2. Dictionaries add up by word across the cluster: a word travels once a segment, however often it occurs.
3. Expected counts are summed as whole 2^-16ths, so results don't depend on partitions; only a number a piece reaches the driver.
4. Each different word is scored once; counts and scores go back to the segments' dictionaries, and documents are summed up in their segment, exactly rounded.

Null texts are empty: an end only. A null doc_id counts as the empty text and so trains. Repeated rows each count. Very long texts and words are read
whole, one at a time, in linear time. Without training documents all counts are 0 and all pieces equally likely. An empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DDL, bounded_batches, table, written
from .lexical import packed, unpacked

SEGMENT_BYTES = 32_000_000
ROUNDS = 2
RANK = 100
UNIT = 1 << 16
SPACE = "▁"
SEGMENTS = "segment long, word binary, at int, train long, doc_ids binary, no_id binary, held_out binary, sizes binary, gaps binary, counts binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Characters of a word that takes the recursion alone, and characters of words that take it together.
LONG, CELLS = 500, 50_000
#: Bytes, by their value, come before all other pieces.
BYTES = 256


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a sentencepiece file that can occur in words, and the starting log-probabilities of bytes, pieces and the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for k in range(model.get_piece_size()):
        piece, score = model.id_to_piece(k), model.get_score(k)
        if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or score < -1e8 or SPACE in piece[1:]):
            found.append((piece, score))
    scores = np.array([s for _, s in found])
    if len(scores) and scores.min() < -1000:  # merge ranks
        order = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        scores = -np.log(RANK + order)
    least = scores.min(initial=0.0)
    start = np.concatenate([np.full(BYTES, least), scores, [least]])
    return [p for p, _ in found], start - np.log(np.exp(start).sum())


class Lattice:
    """Words' segmentations. Words of one length go through the recursion together, a step a position; those of over LONG characters one at a time, with an array of
    their own length and no more.

    ways: a string to its piece's number, or None if it only begins pieces. The same as a trie in arrays: `keys` are (state, letter) in order, `nexts` the states they
    lead to, and `ends` a state's piece or -1.
    """

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        self.ways: dict[str, int | None] = {}
        for k, piece in enumerate(pieces):
            for end in range(1, len(piece)):
                self.ways.setdefault(piece[:end], None)
            self.ways[piece] = BYTES + k
        self.scores, self.logs = logs, logs.tolist()
        self.spelled: dict[str, float] = {}
        self.longest = max(map(len, pieces), default=1)
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        states = {"": 0} | {s: k + 1 for k, s in enumerate(self.ways)}
        keys = np.array([states[s[:-1]] * self.width + int(self.letter[ord(s[-1])]) for s in self.ways], np.int64)
        order = np.argsort(keys)
        self.keys, self.nexts = keys[order], order.astype(np.int32) + 1
        self.ends = np.array([-1, *(-1 if n is None else n for n in self.ways.values())], np.int32)

    def spelling(self, char: str) -> float:
        """Log-probability of a character by its bytes."""
        if (found := self.spelled.get(char)) is None:
            found = self.spelled[char] = sum(self.logs[b] for b in char.encode("utf-8", "surrogateescape"))
        return found

    def forward(self, word: str) -> array:
        """Log-probability of the word's first k characters, over all their segmentations, for all k."""
        ways, logs, exp, n = self.ways, self.logs, math.exp, len(word)
        alpha, coming = array("d", [0.0]), [[] for _ in range(n + 1)]
        for j in range(n):
            here = alpha[j]
            coming[j + 1].append(here + self.spelling(word[j]))
            for k in range(j + 1, n + 1):
                number = ways.get(word[j:k], -1)
                if number == -1:
                    break
                if number is not None:
                    coming[k].append(here + logs[number])
            terms, coming[j + 1] = coming[j + 1], []
            most = max(terms)
            alpha.append(most if len(terms) == 1 else most + math.log(sum([exp(x - most) for x in terms])))
        return alpha

    def expected(self, word: str, weight: int, into: np.ndarray) -> None:
        """Adds how often each piece is expected in `weight` such words, in units."""
        ways, logs, exp, n = self.ways, self.logs, math.exp, len(word)
        alpha = self.forward(word)
        whole, many = alpha[n], weight * UNIT
        beta = array("d", bytes(8 * (n + 1)))
        for j in range(n - 1, -1, -1):
            here = alpha[j] - whole
            spelled = self.spelling(word[j]) + beta[j + 1]
            share = exp(here + spelled)
            if share > 1e-9:
                for b in word[j].encode("utf-8", "surrogateescape"):
                    into[b] += int(share * many + 0.5)
            terms = [spelled]
            for k in range(j + 1, n + 1):
                number = ways.get(word[j:k], -1)
                if number == -1:
                    break
                if number is not None:
                    term = logs[number] + beta[k]
                    terms.append(term)
                    into[number] += int(exp(here + term) * many + 0.5)
            most = max(terms)
            beta[j] = most if len(terms) == 1 else most + math.log(sum([exp(x - most) for x in terms]))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]], np.ndarray]:
        """Of words of one length: their characters' code points, the edges (words, starts, pieces) by length from 1, and spellings' log-probabilities."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        own, place = np.unique(chars, return_inverse=True)
        spelled = np.array([self.spelling(chr(c)) for c in own.tolist()])[place].reshape(chars.shape)
        letters = self.letter[chars]
        word, start = (x.ravel() for x in np.indices(chars.shape, np.int32))
        state, edges = np.zeros(len(word), np.int64), []
        for k in range(min(n, self.longest)):
            inside = start + k < n
            word, start, state = word[inside], start[inside], state[inside]
            wanted = state * self.width + letters[word, start + k]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            on = self.keys[at] == wanted
            word, start, state = word[on], start[on], self.nexts[at[on]].astype(np.int64)
            piece = self.ends[state]
            hit = piece >= 0
            edges.append((word[hit], start[hit], piece[hit]))
            if not len(word):
                break
        return chars, edges, spelled

    def forwards(self, m: int, n: int, edges: list[tuple[np.ndarray, ...]], spelled: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words' first k characters; the columns before the first stand for nothing."""
        most = len(edges)
        come = np.full((m, n + 1, most + 1), -np.inf)
        come[:, 1:, 0] = spelled
        for k, (word, start, piece) in enumerate(edges, 1):
            come[word, start + k, k] = self.scores[piece]
        alpha = np.full((m, most + n + 1), -np.inf)
        alpha[:, most] = 0.0
        for i in range(1, n + 1):
            before = alpha[:, i : i + most][:, ::-1]  # lengths 1, 2, ...
            alpha[:, most + i] = together(np.concatenate([before[:, :1], before], axis=1) + come[:, i])
        return alpha[:, most:]

    def backwards(self, m: int, n: int, edges: list[tuple[np.ndarray, ...]], spelled: np.ndarray) -> np.ndarray:
        """Log-probabilities of what follows the words' first k characters."""
        most = len(edges)
        go = np.full((m, n, most + 1), -np.inf)
        go[:, :, 0] = spelled
        for k, (word, start, piece) in enumerate(edges, 1):
            go[word, start, k] = self.scores[piece]
        beta = np.full((m, n + 1 + most), -np.inf)
        beta[:, n] = 0.0
        for j in range(n - 1, -1, -1):
            after = beta[:, j + 1 : j + 1 + most]
            beta[:, j] = together(np.concatenate([after[:, :1], after], axis=1) + go[:, j])
        return beta[:, : n + 1]

    def all_scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words over all their segmentations."""
        out = np.zeros(len(words))
        for at, own in by_length(words):
            if len(own[0]) > LONG:
                out[at] = [self.forward(w)[-1] for w in own]
            else:
                _, edges, spelled = self.lattice(own)
                out[at] = self.forwards(len(own), len(own[0]), edges, spelled)[:, -1]
        return out

    def all_expected(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        """expected() of all words."""
        for at, own in by_length(words):
            m, n = len(own), len(own[0])
            if n > LONG:
                for w, c in zip(own, weights[at].tolist()):
                    self.expected(w, c, into)
                continue
            chars, edges, spelled = self.lattice(own)
            alpha, beta = self.forwards(m, n, edges, spelled), self.backwards(m, n, edges, spelled)
            many = weights[at] * float(UNIT)
            units = lambda x: np.floor(x + 0.5).astype(np.int64)
            for k, (word, start, piece) in enumerate(edges, 1):
                share = np.exp(alpha[word, start] + self.scores[piece] + beta[word, start + k] - alpha[word, n])
                np.add.at(into, piece, units(share * many[word]))
            by_bytes = units(np.exp(alpha[:, :-1] + spelled + beta[:, 1:] - alpha[:, n:]) * many[:, None])
            some = by_bytes > 0
            if some.any():
                own_chars, place = np.unique(chars[some], return_inverse=True)
                found = np.zeros(len(own_chars), np.int64)
                np.add.at(found, place, by_bytes[some])
                for c, x in zip(own_chars.tolist(), found.tolist()):
                    for byte in chr(c).encode("utf-8", "surrogateescape"):
                        into[byte] += x


def together(logs: np.ndarray) -> np.ndarray:
    """Logarithm of the sums along the rows."""
    most = logs.max(axis=1)
    return most + np.log(np.exp(logs - most[:, None]).sum(axis=1))


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, every in groups.items():
        step = max(1, CELLS // n)
        for k in range(0, len(every), step):
            yield every[k : k + step], [words[x] for x in every[k : k + step]]


def marked(word: bytes) -> str:
    return SPACE + word.decode("utf-8", "surrogateescape").replace(SPACE, "" if SPACE == "" else SPACE)


class Writer:
    """Documents to a segment: its dictionary, and each document's words as numbers in it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.words: dict[bytes, int] = {}
        self.ids, self.no_id, self.held, self.sizes = array("q"), array("b"), array("b"), array("q")
        self.number, self.count = array("q"), array("q")

    def add(self, doc_id: int | None, text: bytes) -> None:
        found, words = Counter(text.lower().split()), self.words
        self.bytes += len(text) + 16
        self.ids.append(doc_id or 0)
        self.no_id.append(doc_id is None)
        self.held.append(held_out(doc_id))
        self.sizes.append(len(found))
        self.number.extend([words.setdefault(w, len(words)) for w in found])
        self.count.extend(found.values())

    def batches(self, segment: int, target: DDL) -> Iterator[pa.RecordBatch]:
        own = lambda x: np.array(x, dtype=np.int64)
        sizes, held, number, count = own(self.sizes), own(self.held), own(self.number), own(self.count)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((number, doc))
        number, count, doc = number[order], count[order], doc[order]
        train = np.bincount(number, weights=count * (1 - held[doc]), minlength=len(self.words)).astype(np.int64)
        gaps = np.diff(number, prepend=0)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        gaps[starts] = number[starts]
        blobs = [own(self.ids).tobytes(), *(packed(own(x)) for x in (self.no_id, held, sizes, gaps, count))]
        yield target.batch([[segment], [None], [None], [int((1 - held).sum())], *([x] for x in blobs)])
        words = list(self.words)
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            yield target.batch([[segment] * len(part), part, range(k, k + len(part)), train[k : k + len(part)], *[[None] * len(part)] * len(blobs)])


def segmented(documents: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    bounded_batches(documents.sparkSession)
    target = DDL(SEGMENTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, segment = Writer(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own.add(doc_id, text.as_py() or b"")
                if own.bytes >= segment_bytes:
                    yield from own.batches(segment, target)
                    segment += 1
                    own.clear()
        if own.bytes:
            yield from own.batches(segment, target)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SEGMENTS)


def expectations(words: DataFrame, pieces: list[str], logs: np.ndarray) -> DataFrame:
    """piece (its number), n: expected occurrences in the words (word, c), in units."""
    target = DDL("piece int, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, into = Lattice(pieces, logs), np.zeros(len(logs), np.int64)
        for batch in batches:
            own.all_expected([marked(w) for w in batch.column(0).to_pylist()], batch.column(1).to_numpy(), into)
        some = np.flatnonzero(into)
        yield target.batch([some, into[some]])

    return words.select("word", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))


def learned(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Pieces, and log-probabilities of bytes, pieces and the end, from the training words (word, c) and the number of texts."""
    pieces, logs = vocabulary(path)
    for _ in range(rounds):
        counts = np.ones(len(logs))
        for piece, n in expectations(words, pieces, logs).collect():  # at most one row a piece of the vocabulary
            counts[piece] += int(n) / UNIT
        counts[-1] += ends
        logs = np.log(counts) - math.log(counts.sum())
    return pieces, logs


def scored_words(words: DataFrame, pieces: list[str], logs: np.ndarray) -> DataFrame:
    """word, c, score: log10 of the word's marginal probability."""
    target = DDL("word binary, c long, score double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(pieces, logs)
        for batch in batches:
            found = own.all_scores([marked(w) for w in batch.column(0).to_pylist()]) / math.log(10)
            yield target.batch([batch.column(0), batch.column(1), found])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, score double")


def summed(docs: pa.Table, words: pa.Table, total: int, different: int, ends: int, end_score: float) -> Iterator[list]:
    """The results of a segment's documents."""
    at = words.column("at").to_numpy()
    c, score = np.empty(len(at), np.int64), np.empty(len(at))
    c[at], score[at] = words.column("c").to_numpy(), words.column("score").to_numpy()
    log = math.log10
    base, end_base = np.array([log((x + 1) / (total + different + 1)) for x in c.tolist()]), log((ends + 1) / (total + different + 1))
    for row in docs.to_pylist():
        ids, (no_id, held, sizes, gaps, counts) = np.frombuffer(row["doc_ids"], np.int64), (unpacked(row[x]) for x in ("no_id", "held_out", "sizes", "gaps", "counts"))
        out, ahead = [], 0
        for doc_id, none, out_of, size in zip(ids.tolist(), no_id.tolist(), held.tolist(), sizes.tolist()):
            n = counts[ahead : ahead + size]
            own = np.cumsum(gaps[ahead : ahead + size])
            ahead += size
            known = int(n[c[own] > 0].sum()) + (ends > 0)
            out.append((None if none else doc_id, bool(out_of), int(n.sum()) + 1, known, total, math.fsum([*(base[own] * n).tolist(), end_base]), math.fsum([*(score[own] * n).tolist(), end_score])))
        yield list(zip(*out))


def scored(documents: DataFrame, path: str, rounds: int = ROUNDS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Every document's base score and marginal log10 probability, from what the documents that aren't held out hold."""
    every = written(segmented(documents, segment_bytes), "lattice-segments")
    docs, entries = every.where("doc_ids is not null"), every.where("word is not null").select("segment", "word", "at", "train")
    words = written(entries.groupBy("word").agg(F.sum("train").alias("c")), "lattice-words")
    ends = docs.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    tokens, different = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, different = tokens + ends, different + (ends > 0)
    pieces, logs = learned(words.where("c > 0"), ends, path, rounds)
    own = entries.join(scored_words(words, pieces, logs), "word").select(F.col("segment").alias("of"), "at", "c", "score")
    target, end_score = DDL(RESULT), float(logs[-1]) / math.log(10)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([target.batch(x) for x in summed(left, right, total, different, ends, end_score)])

    return docs.drop("word", "at", "train").groupBy("segment").cogroup(own.groupBy("of")).applyInArrow(run, RESULT)


def op13_lattice_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scored(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
