"""Personal data and the terms that give it away.

Base: e-mail addresses, IP addresses, card numbers and telephone numbers by pattern and check. These are the protected
entities. A term discloses an entity when knowing the term tells much of what there is to know about it: with
probabilities over all lines of the corpus, the pointwise mutual information of term and entity, log p(t, e) / p(t) p(e), is
compared with the entity's information content, -log p(e). Their ratio is 0 where term and entity are independent and 1
where the term occurs with the entity only. The unit of all counts is the line: lines with the term, lines with the entity, and lines where the
term is within REACH terms of the entity. A pair needs `support` different surroundings; copies of a passage are one.

In the texts that hold the entity its disclosing terms are treated wherever they stand; in texts without it they tell nothing of it. At
`remove` and above a term is taken out. From `generalise` on it is replaced by the narrowest of its generalisations whose own disclosure is below
`generalise`: the class of all terms with its first LEVELS letters (`zorb*`), or else its kind ([NAME] or [WORD]).

Terms are runs of three letters or more, lower-cased. Corpus counts cover all documents, repeated rows included.
Null texts are empty: no spans. Repeated rows get the same spans each; of several entities that a term discloses the highest score counts.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DDL, bounded_batches, checkpointed, clear, table

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from all others, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
NEWLINE = re.compile("\n")
TERM = re.compile(r"[^\W\d_]{3,}")
REACH = 12
COUNTED = 200_000
#: Letters that a generalised term keeps, the narrowest class first.
LEVELS = (6, 4)


@dataclass(frozen=True)
class DisclosureRules:
    support: int = 3
    generalise: float = 0.75
    remove: float = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@ and a domain, sign by sign instead of word by word."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start and then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0") or "0") <= 3 and int(x) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def entity_of(text: str, span: tuple[int, int, int]) -> str:
    s, k, e = span
    return f"{KINDS[k]} {text[s:e].lower() if k < 2 else ''.join(DIGITS.findall(text[s:e]))}"


class Terms:
    """The terms of a text outside its base spans, by place."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        covered: list[tuple[int, int]] = []
        for s, _, e in spans:
            if covered and s <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
            else:
                covered.append((s, e))
        cover = [s for s, _ in covered]
        self.found = []
        low = lowered(text)
        for m in TERM.finditer(low):
            k = bisect_left(cover, m.end()) - 1  # the last span that begins before the term ends
            if k < 0 or covered[k][1] <= m.start():
                self.found.append((m.start(), m.end(), m[0]))
        self.starts = [s for s, _, _ in self.found]

    def near(self, span: tuple[int, int, int], line: tuple[int, int]) -> list[str]:
        """Terms within REACH of a span, on its line."""
        lo, hi = bisect_left(self.starts, line[0]), bisect_left(self.starts, line[1])
        at = bisect_left(self.starts, span[0], lo, hi)
        return [t for _, _, t in self.found[max(lo, at - REACH) : min(hi, at + REACH)]]


def lines_of(text: str) -> list[int]:
    """Where the lines begin."""
    return [0, *(m.end() for m in NEWLINE.finditer(text))]


def classes_of(term: str) -> list[str]:
    """The classes that a term can be generalised to."""
    return [f"{term[:n]}*" for n in LEVELS if len(term) > n]


def together(text: str) -> Iterator[tuple[str, str | None, str, int]]:
    """Rows of pair_counts() for what is together on each line of a text."""
    spans = base_spans(text)
    if not spans:
        return
    terms, begins = Terms(text, spans), lines_of(text)
    key = hashlib.md5(text.encode()).hexdigest()
    with_entity: dict[str, set[int]] = {}
    pairs: dict[tuple[str, str, str], int] = {}
    first: dict[tuple[str, str], int] = {}
    for span in spans:
        k = bisect_right(begins, span[0])
        near = terms.near(span, (begins[k - 1], begins[k] if k < len(begins) else len(text)))
        context, entity = hashlib.md5(" ".join(near).encode()).hexdigest()[:16], entity_of(text, span)
        with_entity.setdefault(entity, set()).add(k)
        for t in {*near, *(c for x in near for c in classes_of(x))}:
            new = first.get((entity, t)) != k  # spans come line by line
            first[entity, t] = k
            pairs[entity, t, context] = pairs.get((entity, t, context), 0) + new
    yield from ((e, None, key, len(ks)) for e, ks in with_entity.items())
    yield from ((*p, n) for p, n in pairs.items())


def text_key() -> Column:
    """Equal texts share it; rows are told apart by their text only, as ids may be null or repeat."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


COUNTED_ROW = "entity string, term string, context string, n long"


def lowered(text: str) -> str:
    """The text in small letters, place by place: without the few that become two characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def pair_counts(documents: DataFrame) -> DataFrame:
    """entity, term, context, n: how many lines. Written once, as several statistics come from it.

    term null: lines with the entity, in the texts whose key is the context. Else: lines with both together (a class of terms ends in *),
    by their surroundings; a line counts for the first of its surroundings.
    """
    target = DDL(COUNTED_ROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0):
                rows += together(text.as_py() or "")
                if len(rows) > 20_000:
                    yield target.batch(list(zip(*rows)))
                    rows = []
            if rows:
                yield target.batch(list(zip(*rows)))

    made = documents.select("text").mapInArrow(run, COUNTED_ROW)
    return checkpointed(made.groupBy("entity", "term", "context").agg(F.sum("n").alias("n")))


def term_lines(documents: DataFrame) -> DataFrame:
    """(term, n_term): how many lines have each term and class, over all documents."""
    target = DDL("term string, n_term long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines_with: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for line in lowered(text.as_py() or "").split("\n"):
                    terms = set(TERM.findall(line))
                    lines_with.update(terms)
                    for n in LEVELS:
                        lines_with.update({f"{t[:n]}*" for t in terms if len(t) > n})
            if len(lines_with) > COUNTED:
                yield target.batch([list(lines_with), list(lines_with.values())])
                lines_with.clear()
        if lines_with:
            yield target.batch([list(lines_with), list(lines_with.values())])

    return documents.select("text").mapInArrow(run, "term string, n_term long").groupBy("term").agg(F.sum("n_term").alias("n_term"))


def disclosures(documents: DataFrame, counted: DataFrame, rules: DisclosureRules) -> DataFrame:
    """entity, term, score, put: the terms that disclose an entity, and what is to stand in their place (null: their kind). counted: pair_counts()."""
    paired = counted.where("term IS NOT NULL").groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support")).where(F.col("support") >= rules.support)
    own = counted.where("term IS NULL").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    lines = documents.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("all_lines"), F.sum(F.col("text").isNull().cast("long")).alias("nulls"))
    total = lines.select((F.coalesce("all_lines", F.lit(0)) + F.coalesce("nulls", F.lit(0))).alias("n_lines"))  # one row
    each = paired.join(own, "entity").join(term_lines(documents), "term").join(F.broadcast(total))
    # 1 - log p(e | t) / log p(e); an entity on every line has nothing to disclose
    score = F.when(F.col("n_entity") < F.col("n_lines"), 1 - F.log(F.col("n_both") / F.col("n_term")) / F.log(F.col("n_entity") / F.col("n_lines"))).otherwise(0.0)
    # Few pairs, written once: terms and their classes are joined with each other.
    scored = checkpointed(each.select("entity", "term", score.alias("score")))
    told = scored.where((F.col("score") >= rules.generalise) & ~F.col("term").endswith("*"))
    wide = scored.where(F.col("term").endswith("*") & (F.col("score") < rules.generalise))
    put = F.when(F.col("score") >= rules.remove, "")
    for n in LEVELS:
        own_class = F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit("*")))
        fit = wide.select(F.col("entity").alias(f"of{n}"), F.col("term").alias(f"class{n}"))
        told = told.withColumn(f"own{n}", own_class).join(fit, (F.col("entity") == F.col(f"of{n}")) & (F.col(f"own{n}") == F.col(f"class{n}")), "left")
        put = F.coalesce(put, F.col(f"class{n}"))
    return told.select("entity", "term", "score", put.alias("put"))


TERMS = "array<struct<term:string,score:double,put:string>>"


def terms_of_texts(documents: DataFrame, rules: DisclosureRules) -> DataFrame:
    """text_key and `terms`: the terms that disclose one of the text's entities, with score and what is to be put."""
    counted = pair_counts(documents)
    holders = counted.where("term IS NULL").select("entity", F.col("context").alias("text_key"))
    best = F.max(F.struct("score", F.coalesce("put", F.lit("?")).alias("put")))  # ties of scores: the last by what is put
    each = holders.join(disclosures(documents, counted, rules), "entity").groupBy("text_key", "term").agg(best.alias("b"))
    one = F.struct("term", F.col("b.score").alias("score"), F.nullif("b.put", F.lit("?")).alias("put"))
    return each.groupBy("text_key").agg(F.sort_array(F.collect_list(one)).alias("terms"))


def term_spans(text: str, spans: list[tuple[int, int, int]], terms: list[dict] | None) -> list[tuple[int, int, str]]:
    """(start, end, what to put) of the terms in a text that has the base spans."""
    if not terms:
        return []
    put = {t["term"]: t["put"] for t in terms}
    found = [(s, e, put[t]) for s, e, t in Terms(text, spans).found if t in put]
    return [(s, e, p if p is not None else "[NAME]" if text[s].isupper() else "[WORD]") for s, e, p in found]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(documents: DataFrame, keys: list[str], rules: DisclosureRules | None = None) -> DataFrame:
    """keys of every document with its counts and spans."""
    rules = rules or DisclosureRules()
    bounded_batches(documents.sparkSession)
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{k} {kinds[k].replace('bigint', 'long')}" for k in keys)
    p = clear(documents)
    width = len(keys)
    held = f"{schema}, {p}key string, {p}text string, {FOUND}"
    own, done = DDL(held), DDL(f"{schema}, {FOUND}")

    # A row's base spans; its text goes on only if it has some. Rows without have keys that meet nothing, and spread.
    def base(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for whole, start in ((b, k) for b in batches for k in range(0, b.num_rows, 256)):
            batch = whole.slice(start, 256)
            rows = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                had, n = Counter(k for _, k, _ in spans), n + 1
                said = joined(spans)
                rows.append((hashlib.md5(text.encode()).hexdigest() if spans else f"-{n}", text if spans else None, *(had[k] for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), said))
            yield own.batch([*batch.columns[1:], *zip(*rows)])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(width + 7).to_pylist()
            for k, (text, terms) in enumerate(zip(batch.column(width + 1), batch.column(width + 8))):
                if terms.is_valid:
                    text = text.as_py()
                    spans = base_spans(text)
                    said[k] = joined(sorted([*spans, *((s, 4, e) for s, e, _ in term_spans(text, spans, terms.as_py()))]))
            yield done.batch([*batch.columns[:width], *batch.columns[width + 2 : width + 7], said])

    rows = documents.select("text", *keys).mapInArrow(base, held)
    more = terms_of_texts(documents, rules).select(F.col("text_key").alias(f"{p}key"), F.col("terms").alias(f"{p}terms"))
    return rows.join(more, f"{p}key", "left").select(*rows.drop(f"{p}key").columns[:width], f"{p}key", *rows.columns[width + 1 :], f"{p}terms").mapInArrow(finish, f"{schema}, {FOUND}")


def replaced(text: str, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """text with entities replaced by their kind, and terms by what is to be put. Overlapping spans become one."""
    out, end = [], 0
    for s, e, mark in sorted([*((s, e, f"[{KINDS[k].upper()}]") for s, k, e in spans), *terms]):
        if s >= end:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join([*out, text[end:]])


def sanitised(documents: DataFrame, rules: DisclosureRules | None = None) -> DataFrame:
    """documents with their texts sanitised; all other columns as they are, n_chars made anew if there is one."""
    bounded_batches(documents.sparkSession)
    own = terms_of_texts(documents, rules or DisclosureRules())
    columns, p = documents.columns, clear(documents)
    # All base spans have an @ or digits; texts without stay where they are.
    some = F.coalesce(F.col("text").rlike("[@0-9]"), F.lit(False))
    keyed = documents.where(some).withColumn(f"{p}key", text_key())
    rows = keyed.join(own.select(F.col("text_key").alias(f"{p}key"), F.col("terms").alias(f"{p}terms")), f"{p}key", "left")
    at = columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, start in ((b, k) for b in batches for k in range(0, b.num_rows, 256)):
            batch = whole.slice(start, 256)
            texts = []
            for text, terms in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                spans = base_spans(text)
                texts.append(replaced(text, spans, term_spans(text, spans, terms)) if spans else text)
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = rows.select(*columns, f"{p}terms").mapInArrow(run, documents.schema).unionByName(documents.where(~some))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def op9_disclosure_sanitisation(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return found(documents, ["doc_id"])
