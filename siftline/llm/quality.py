"""Quality rules by distribution divergence.

Each document gets two histograms: of its characters by class, and of the common words of
every language that it knows. They are compared with the same histograms of a language as a whole, gathered
from all documents of that language that pass the base rules, by Jensen-Shannon distance (base 2, so from
0 to 1). A document stays if it is near enough to one language in both. Short documents have noisy
histograms; below `min_words` only the base rules judge. A language whose documents have fewer than `reference_words` words
together makes no reference. Of two languages equally near, the first by name is named.

Null texts count as empty: no words, so base_failed. Null or unknown languages take no part in the
references but are judged against all of them. Without any reference (an empty table, or none of the known
languages) only the base rules judge. Repeated rows are judged one by one; other columns pass by unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DDL, map_rows, table

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in is that for it as with be on by at are this from or was an not have but which",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ne pas ce se plus il",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
SLOT = {w.encode(): i for i, w in enumerate(VOCABULARY)}
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Character classes by code point: lower, upper, digit, white space, sentence marks, other ASCII, other Latin signs, beyond Latin.
#: The Latin blocks end at LATIN.
N_CLASSES = 8
LATIN = 0x250
CLASS = np.array(
    [
        3 if chr(c) in " \t\n\x0b\x0c\r" else 2 if chr(c) in "0123456789" else 4 if chr(c) in ".,;:'\"?-" else 0 if chr(c).isalpha() and chr(c).islower() else 1 if chr(c).isalpha() and chr(c).isupper() else 5 if c < 128 else 6
        for c in range(LATIN)
    ]
    + [7],
    np.uint8,
)


@dataclass(frozen=True)
class QualityRules:
    #: Fewer words: rejected by the base rules.
    base_min_words: int = 20
    #: Percentage of words in repeated windows beyond which the base rules reject.
    base_max_repeat: int = 30
    #: Fewer words: histograms are too noisy, the distances don't count.
    min_words: int = 40
    #: A language with fewer words in all documents has no reference.
    reference_words: int = 1000
    #: Largest distances, as (floor, base, slope): max(floor, base + slope / sqrt(words)). The distance of
    #: a sample from its own law falls with the root of its length.
    class_limit: tuple[float, float, float] = (0.20, 0.10, 1.1)
    word_limit: tuple[float, float, float] = (0.20, 0.10, 2.1)
    languages: tuple[str, ...] = field(default=tuple(COMMON_WORDS))


def histograms(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by character class, and by common word (the last slot: all other words)."""
    if text.isascii():
        by_point = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=LATIN + 1)
    else:
        by_point = np.bincount(np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), LATIN), minlength=LATIN + 1)
    classes = np.bincount(CLASS, weights=by_point, minlength=N_CLASSES)
    slots = [SLOT[w] for w in words if w in SLOT]
    common = np.bincount(slots, minlength=len(SLOT) + 1).astype(float) if slots else np.zeros(len(SLOT) + 1)
    common[-1] = len(words) - len(slots)
    return classes, common


def js_distances(p: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, base 2, of a histogram from each row of refs; 1 where either is empty."""
    totals = refs.sum(axis=1)
    if not p.sum():
        return np.ones(len(refs))
    p, q = p / p.sum(), refs / np.maximum(totals, 1)[:, None]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(totals > 0, np.sqrt(np.maximum(0, parts.sum(axis=1) / 2)), 1.0)


def limit(law: tuple[float, float, float], n_words: int) -> float:
    floor, base, slope = law
    return max(floor, base + slope / max(n_words, 1) ** 0.5)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in windows of 8 words which occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    repeated = bytearray(len(windows))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            repeated[i] = repeated[j] = 1
    total, end = 0, 0
    for i in np.flatnonzero(np.frombuffer(repeated, np.uint8)).tolist():
        total += i + WINDOW - max(end, i)
        end = i + WINDOW
    return total


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int, rules: QualityRules) -> bool:
    return n_words < rules.base_min_words or 100 * n_repeat_words > rules.base_max_repeat * n_words


def references(documents: DataFrame, rules: QualityRules) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The histograms of each language over all its documents; one row a language comes to the driver.

    Every task sums what it reads, so that only a row per task and language is shuffled.
    """
    known = frozenset(rules.languages)
    size = N_CLASSES + len(SLOT) + 1
    target = DDL("lang string, slot int, n double")

    def summed(batches):
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in known:
                    continue
                text = text.as_py() or ""
                words = text.encode().split()
                if len(words) < rules.min_words or base_failed(len(words), repeated_words(words), rules):
                    continue
                totals[lang] += np.concatenate(histograms(text, words))
        for lang, counts in totals.items():
            yield target.batch([[lang] * size, list(range(size)), counts.tolist()])

    rows = (
        documents.select(F.col("lang"), F.col("text"))
        .mapInArrow(summed, "lang string, slot int, n double")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .collect()  # languages x slots, both fixed by the rules
    )
    out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
    for lang, slot, n in rows:
        out[lang][slot] = n
    return {lang: (h[:N_CLASSES], h[N_CLASSES:]) for lang, h in sorted(out.items()) if h[N_CLASSES:].sum() >= rules.reference_words}


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, nearest_lang string, class_excess double, word_excess double, kept boolean"


def judge_of(documents: DataFrame, rules: QualityRules) -> Callable[[str | None], tuple]:
    """A function from a text to the values of COLUMNS, by the references of documents."""
    refs = references(documents, rules)
    langs = list(refs)
    by_class = np.array([refs[k][0] for k in langs])
    by_word = np.array([refs[k][1] for k in langs])

    def judge(text: str | None) -> tuple:
        text = text or ""
        data = text.encode()
        words = data.split()
        counts = base_counts(text, data, words)
        n, failed = counts[0], base_failed(counts[0], counts[4], rules)
        if not langs or not words:
            return (*counts, failed, None, None, None, not failed)
        classes, common = histograms(text, words)
        d_class = js_distances(classes, by_class) / limit(rules.class_limit, n)
        d_word = js_distances(common, by_word) / limit(rules.word_limit, n)
        worst = np.maximum(d_class, d_word)
        k = int(worst.argmin())
        kept = not failed and (n < rules.min_words or bool(worst[k] <= 1))
        return (*counts, failed, langs[k], float(d_class[k]), float(d_word[k]), kept)

    return judge


def judged(documents: DataFrame, keys: list[str], rules: QualityRules | None = None) -> DataFrame:
    """keys of every document with its counts, its distances as shares of their limits, and its verdict."""
    rules = rules or QualityRules()
    judge = judge_of(documents, rules)
    make = lambda: lambda text, *key: (*key, *judge(text))
    picked = documents.select("text", *keys)
    kinds = dict(picked.dtypes)
    schema = ", ".join(f"{k} {kinds[k].replace('bigint', 'long')}" for k in keys)
    return map_rows(picked, make, f"{schema}, {COLUMNS}")


def passing(documents: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    judge = judge_of(documents, rules or QualityRules())
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py())[-1] for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op1_quality_divergence(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), ["doc_id"])
