"""Sections of a text, and their keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.counts import numbered_by
from ..functions.text import word_count
from ..plans.session import checkpointed


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line of every line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def base_key(name: Column) -> Column:
    """Letters and digits of a name joined by _, 70 characters at most."""
    made = F.regexp_replace(F.substring(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), 1, 70), "^_+|_+$", "")
    return F.when(made == "", "section").otherwise(made)


def unique_keys(sections: DataFrame, page: str) -> DataFrame:
    """sections (page, pos, name, ...) with `key`: a repeated one gets the first suffix _2, _3, ... that its page hasn't used yet.

    Repeats are numbered. Only where a name equals a key made for another one are the page's sections gone through one by one.
    """
    based = sections.withColumn("_base", base_key(F.col("name")))
    place = F.row_number().over(Window.partitionBy(page, "_base").orderBy("pos"))
    numbered = based.withColumn("_n", place).withColumn("key", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_n").cast("string"))))
    clash = numbered.groupBy(page, "key").agg(F.count("*").alias("_c")).where("_c > 1").select(page).distinct()
    columns = [*sections.columns, "key"]
    return numbered.join(clash, page, "left_anti").select(*columns).unionByName(_folded_keys(sections.join(clash, page, "left_semi"), page).select(*columns))


def _free_keys(bases: Iterable[str]) -> list[str]:
    """Keys in order: a base that is used already gets its first free suffix from 2. What is used only grows, so the search for a base goes on where it ended."""
    used, following, out = set(), {}, []
    for base in bases:
        key = base
        if base in used:
            n = following.get(base, 2)
            while (key := f"{base}_{n}") in used:
                n += 1
            following[base] = n + 1
        used.add(key)
        out.append(key)
    return out


def _folded_keys(sections: DataFrame, page: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("pos", base_key(F.col("name")).alias("base"))))
    keys = numbered_by(_free_keys, "string")(F.transform("listed", lambda x: x["base"]))
    own = sections.groupBy(page).agg(listed.alias("listed")).withColumn("keys", keys).select(page, F.explode(F.arrays_zip(F.col("listed.pos").alias("pos"), F.col("keys").alias("key"))).alias("x"))
    return sections.join(own.select(page, "x.pos", "x.key"), [page, "pos"])


def visible_sections(rows: DataFrame, page: str, text: str, title: str, noise: Iterable[str] = ()) -> DataFrame:
    """page, pos, key, text by headings; where none is found, or all falls into one section, by paragraphs.

    Navigation lines, those of `noise` (a site's own, in any case of letters) and the title line don't count. A paragraph is text between blank lines, of over 40 characters; the first 80 count.
    """
    clean = F.trim(F.col("line"))
    every = lines(rows.withColumn("_title", F.trim(F.col(title))), page, text).join(rows.select(page, F.trim(F.col(title)).alias("_title")), page)
    kept = every.withColumn("line", clean).where(~F.lower("line").isin([*lexicon.NOISE_LINES, *(x.strip().lower() for x in noise)]) & ~F.col("line").rlike(lexicon.NOISE_PATTERN) & ((F.col("line") != F.col("_title")) | (F.col("line") == "")))
    ahead = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("line").rlike(lexicon.HEADING_PATTERN) & (F.length("line") < 120)
    marked = kept.withColumn("heading", heading).withColumn("sid", F.sum(F.col("heading").cast("int")).over(ahead))

    def joined(keys: list[str], condition: Column) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "line"))))
        return marked.groupBy(*keys).agg(F.min("pos").alias("pos"), F.max(F.when(F.col("heading"), F.col("line"))).alias("name"), F.trim(F.array_join(F.transform(listed, lambda x: x["line"]), " ")).alias("text"))

    by_heading = joined([page, "sid"], ~F.col("heading")).where("text <> ''").withColumn("name", F.coalesce("name", F.lit("introduction")))
    several = by_heading.groupBy(page).agg(F.count("*").alias("n"), F.max("sid").alias("last")).where("n > 1 and last > 0").select(page)
    blank = F.sum((F.col("line") == "").cast("int")).over(ahead)
    paragraphs = marked.withColumn("sid", blank).where("line <> ''").groupBy(page, "sid").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("listed"))
    texts = paragraphs.withColumn("text", F.array_join(F.transform("listed", lambda x: x["line"]), " ")).where("length(text) > 40")
    rank = F.row_number().over(Window.partitionBy(page).orderBy("pos"))
    first = F.substring(F.trim(F.regexp_extract("text", "^([^.!?]*)", 1)), 1, 60)
    by_paragraph = texts.withColumn("rank", rank).where("rank <= 80").withColumn("name", F.coalesce(F.nullif(first, F.lit("")), F.substring("text", 1, 40))).join(several, page, "left_anti")
    both = by_heading.join(several, page, "left_semi").select(page, "pos", "name", "text").unionByName(by_paragraph.select(page, "pos", "name", "text"))
    return unique_keys(checkpointed(both), page).select(page, "pos", "key", "text")


def line_sections(rows: DataFrame, page: str, text: str) -> DataFrame:
    """page, pos, key, text, wc: each line of ten words or more as a section of its own, named by its first 40 characters."""
    own = lines(rows, page, text).withColumn("wc", word_count(F.col("line"))).where("wc >= 10")
    return own.select(page, F.col("pos").cast("long").alias("pos"), base_key(F.substring("line", 1, 40)).alias("key"), F.col("line").alias("text"), "wc")
