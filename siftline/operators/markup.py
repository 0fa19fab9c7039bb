"""Parts of HTML pages from rows of tokens.

A page's html is cut into comments, raw elements (scripts and such), tags and texts. Running sums of a tag's openings and closings give each its level; the next event of
that tag on that level is where an element ends. Paragraphs, and cells and items where a page leaves out closing tags, end at the next one of their kind or with what
holds them, paragraphs also where a block begins. An element holds what lies between its two places, so containment is a comparison and an element's text a slice of
the page's texts; nothing builds a tree. A page is the unit: its tokens are sorted in one task, never several pages' together.

Null and empty html has no parts; its page still has a row where a row a page is promised. Unclosed elements end with the page. page_id tells pages apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import NOISE_CLASSES, NOISE_IDS, NOISE_TAGS
from ..functions.text import found, unescaped

RAW = ("script", "style", "noscript", "iframe", "template")
VOID = tuple("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = tuple("p div ul ol li table tr td th h1 h2 h3 h4 h5 h6 section article aside header footer main nav form fieldset blockquote pre dl dt dd figure figcaption address body html details summary".split())
#: Elements whose closing tags may be left out: whether they always end so (others only on pages where their openings and closings differ in number), the tags whose
#: next opening or closing ends them, and those whose closing does.
ENDED = {
    ("p",): (True, BLOCKS, ()), ("option",): (True, ("option",), ("select",)), ("li",): (False, ("li",), ("ul", "ol")), ("td", "th"): (False, ("td", "th", "tr"), ("table",)),
    ("tr",): (False, ("tr",), ("table",)), ("dt", "dd"): (False, ("dt", "dd"), ("dl",)),
}
#: No attribute value reaches over a <, so a tag that isn't closed costs no more than the text up to the next one.
TAG = r"""</?[a-z][^<>"']*(?:"[^"<]*"[^<>"']*|'[^'<]*'[^<>"']*)*>|</?[a-z][^<>]*>"""
TOKEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b[^<>]*>.*?(?:</{t}[^<>]*>|\z)" for t in RAW) + rf"|{TAG}|<[!?/][^<>]*>|[^<]+|<"
ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"

#: What main_text leaves out besides noise: fixed values.
ASIDE_TAGS, ASIDE_NAMES = ("head", "title", "button", "select", "textarea", "svg"), ("comments", "comment", "comment-list", "commentlist", "respond")


def attribute(raw: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name; null if it has none."""
    own = F.filter(found(raw, ATTRIBUTE), lambda x: F.lower(F.regexp_extract(x, r"^[^\s=]+", 0)) == name)
    return unescaped(F.regexp_replace(F.regexp_replace(F.get(own, F.lit(0)), r"^[^\s=]+\s*=\s*", ""), r"""^["']|["']$""", ""))


def text_of(raw: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(raw), r"\s+", " "))


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, raw, tag, kind (text, open, void, close, other), n: how many texts that aren't blank there are up to here."""
    each = pages.select("page_id", F.posexplode(found(F.coalesce("html", F.lit("")), TOKEN)).alias("pos", "raw"))
    named = each.withColumn("tag", F.lower(F.regexp_extract("raw", TAG_NAME, 1)))
    kind = (
        F.when(~F.col("raw").startswith("<") | (F.col("raw") == "<"), "text").when((F.col("tag") == "") | (F.col("tag").isin(*RAW) & ~F.col("raw").startswith("</")), "other")
        .when(F.col("raw").startswith("</"), "close").when(F.col("tag").isin(*VOID), "void").otherwise("open")
    )
    made = named.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "text", text_of(F.col("raw"))))
    return made.withColumn("n", F.sum((F.coalesce("text", F.lit("")) != "").cast("int")).over(upto()))


def upto(rows: int = 0) -> Window:
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, rows)


def after() -> Window:
    """All that follows, nearest last."""
    return Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def bounded(rows: DataFrame) -> DataFrame:
    """Tokens with `end` and `n_end`: where the element that an opening begins ends, and the number of texts up to there."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    by_tag = Window.partitionBy("page_id", "tag")
    run = F.sum("step").over(by_tag.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    leveled = rows.withColumn("step", step).withColumn("level", run + (F.col("step") < 0).cast("int")).withColumn("here", F.struct("pos", "n"))
    on_level = Window.partitionBy("page_id", "tag", "level", F.col("step") != 0).orderBy("pos")
    seen = leveled.withColumn("matched", F.lead("here").over(on_level)).withColumn("balance", F.sum("step").over(by_tag)).withColumn("last", F.max(F.struct((F.col("pos") + 1).alias("pos"), "n")).over(Window.partitionBy("page_id")))
    end = F.col("matched")
    for tags, (always, any_of, closed) in ENDED.items():
        stops = (F.col("step") != 0) & F.col("tag").isin(*any_of) | ((F.col("step") < 0) & F.col("tag").isin(*closed))
        name = f"stop_{tags[0]}"
        seen = seen.withColumn(name, F.last(F.when(stops, F.col("here")), ignorenulls=True).over(after()))
        end = F.when(F.col("tag").isin(*tags) & (F.lit(always) | (F.col("balance") != 0)), F.col(name)).otherwise(end)
    place = F.when(F.col("kind") == "open", F.coalesce(end, F.col("last")))
    return seen.withColumn("_end", place).withColumn("end", F.col("_end.pos")).withColumn("n_end", F.col("_end.n")).select(*rows.columns, "end", "n_end")


def is_noise(tags: tuple = NOISE_TAGS, classes: tuple = NOISE_CLASSES, ids: tuple = NOISE_IDS) -> Column:
    """Whether an opening begins an element that is told as noise by its tag, a class, its id or data-ad."""
    own = F.split(F.coalesce(attribute(F.col("raw"), "class"), F.lit("")), r"\s+")
    named = F.arrays_overlap(own, F.array(*[F.lit(c) for c in classes])) | F.coalesce(attribute(F.col("raw"), "id").isin(*ids), F.lit(False))
    return (F.col("kind") == "open") & (F.col("tag").isin(*tags) | named | F.col("raw").rlike(r"""(?i)\sdata-ad[\s=>]"""))


def within(condition: Column) -> Column:
    """Whether a token lies in an element whose opening meets the condition, the opening itself included."""
    return F.coalesce(F.max(F.when(condition, F.col("end"))).over(upto()) > F.col("pos"), F.lit(False))


def elements(pages: DataFrame, wanted: Column) -> DataFrame:
    """page_id, e: the openings that are wanted (a condition on tag, kind and raw), in order, of each page.

    e: pos, end, tag, raw, noise, text (texts with blanks between), tight (without), and both without what is noise. Every page has a row.
    """
    rows = bounded(tokens(pages)).withColumn("noise", within(is_noise()))
    listed = lambda condition, *c: F.array_sort(F.collect_list(F.when(condition, F.struct(*c))))
    some = rows.groupBy("page_id").agg(
        listed(F.col("kind").isin("open", "void") & wanted, "pos", "end", "tag", "raw", "n", "n_end", "noise").alias("own"), listed(F.coalesce("text", F.lit("")) != "", "pos", "text", "noise").alias("texts")
    )
    part = lambda e: F.slice("texts", e["n"] + 1, F.coalesce(e["n_end"], e["n"]) - e["n"])
    said = lambda x, glue: F.array_join(F.transform(x, lambda t: t["text"]), glue)
    clean = lambda e: F.filter(part(e), lambda t: ~t["noise"])
    made = F.transform("own", lambda e: F.struct(
        e["pos"].alias("pos"), e["end"].alias("end"), e["tag"].alias("tag"), e["raw"].alias("raw"), e["noise"].alias("noise"), said(part(e), " ").alias("text"), said(part(e), "").alias("tight"),
        said(clean(e), " ").alias("clean"), said(clean(e), "").alias("tight_clean"),
    ))
    return pages.select("page_id").join(some.select("page_id", made.alias("own")), "page_id", "left").select("page_id", F.explode_outer("own").alias("e"))


def per_page(pages: DataFrame, rows: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """page_id, name: the items of each page as an array in order; empty for pages without."""
    own = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(order, item.alias("item")))).alias("l")).select("page_id", F.transform("l", lambda x: x["item"]).alias(name))
    empty = F.array().cast(own.schema[name].dataType)
    return pages.select("page_id").join(own, "page_id", "left").select("page_id", F.coalesce(name, empty).alias(name))


def meta(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, content: meta names or properties in their first order, with the last content of each."""
    own = elements(pages, F.col("tag") == "meta")
    name = F.lower(F.coalesce(F.nullif(attribute(F.col("e.raw"), "name"), F.lit("")), attribute(F.col("e.raw"), "property")))
    some = own.select("page_id", F.col("e.pos").alias("pos"), name.alias("name"), attribute(F.col("e.raw"), "content").alias("content")).where("name <> '' and content <> ''")
    return some.groupBy("page_id", "name").agg(F.max_by("content", "pos").alias("content"), F.min("pos").alias("pos"))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """page_id, pos, crumb: names of the page's first schema.org list, or else the innermost texts of the first navigation that is labelled so."""
    raw = F.col("raw")
    own = elements(pages, F.col("tag").isin("nav", "ol", "ul", "a", "span", "li") | raw.rlike("(?i)itemprop|itemtype")).where("e is not null").select("page_id", "e.pos", "e.end", "e.tag", "e.raw", "e.text")
    listed = F.coalesce(F.contains(attribute(raw, "itemtype"), F.lit("BreadcrumbList")), F.lit(False))
    labelled = F.col("tag").isin("nav", "ol", "ul") & F.coalesce(F.contains(F.lower(attribute(raw, "aria-label")), F.lit("breadcrumb")), F.lit(False))
    whole = Window.partitionBy("page_id")
    first = lambda test: F.min(F.when(test, F.struct("pos", "end"))).over(whole)
    marked = own.withColumn("schema", first(listed)).withColumn("nav", first(labelled))
    inside = lambda x: (F.col("pos") > F.col(f"{x}.pos")) & (F.col("pos") < F.col(f"{x}.end")) & (F.col("text") != "")
    named = marked.where(inside("schema") & (attribute(raw, "itemprop") == "name"))
    links = marked.where(F.col("schema").isNull() & inside("nav") & F.col("tag").isin("a", "span", "li"))
    # An element has a link or span inside if the next one begins before it ends.
    following = F.last(F.when(F.col("tag").isin("a", "span"), F.col("pos")), ignorenulls=True).over(after())
    inner = marked.where(F.col("schema").isNull() & F.col("nav").isNotNull()).withColumn("following", following).where("following < end").select("page_id", "pos")
    return named.select("page_id", "pos", F.col("text").alias("crumb")).unionByName(links.join(inner, ["page_id", "pos"], "left_anti").select("page_id", "pos", F.col("text").alias("crumb")))


def faq(pages: DataFrame, most: int = 20, longest: int = 500) -> DataFrame:
    """page_id, pos, question, answer: pairs of microdata, or else of details elements; the first `most` with both. A part belongs to the last question begun before it."""
    own = elements(pages, F.col("tag").isin("details", "summary") | F.col("raw").rlike("(?i)itemprop|itemtype")).where("e is not null").select("page_id", "e.pos", "e.end", "e.tag", "e.raw", "e.text")
    own = own.withColumn("type", F.coalesce(attribute(F.col("raw"), "itemtype"), F.lit(""))).withColumn("prop", F.coalesce(attribute(F.col("raw"), "itemprop"), F.lit("")))

    def pairs(begins: Column, question: Column, answer: Column) -> DataFrame:
        held = own.withColumn("q", F.last(F.when(begins, F.struct("pos", "end", "text")), ignorenulls=True).over(upto(-1)))
        parts = held.where("pos < q.end").groupBy("page_id", F.col("q.pos").alias("pos"), F.col("q.text").alias("whole"))
        first = lambda test: F.min(F.when(test, F.struct("pos", "text")))["text"]
        return parts.agg(first(question).alias("question"), first(answer).alias("answer"))

    micro = pairs(F.col("type").endswith("/Question"), F.col("prop") == "name", (F.col("prop") == "text") | F.col("type").endswith("/Answer")).select("page_id", "pos", "question", "answer")
    micro = micro.where("question <> '' and answer <> ''")
    folded = pairs(F.col("tag") == "details", F.col("tag") == "summary", F.lit(False)).where("question <> ''")
    rest = F.trim(F.when(F.startswith("whole", "question"), F.expr("substring(whole, length(question) + 1)")).otherwise(F.col("whole")))
    folded = folded.select("page_id", "pos", "question", rest.alias("answer")).where("answer <> ''").join(micro.select("page_id").distinct(), "page_id", "left_anti")
    every = micro.unionByName(folded).withColumn("answer", F.substring("answer", 1, longest))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).where(F.col("n") < most).select("page_id", "n", "question", "answer")


def tables(pages: DataFrame, most: int = 5, most_rows: int = 30) -> DataFrame:
    """page_id, n, headers, row, cells: the first `most` tables with rows that aren't blank, and their first `most_rows` such rows. Cells belong to the last row begun, rows to the last table."""
    own = elements(pages, F.col("tag").isin("table", "tr", "td", "th")).where("e is not null").select("page_id", "e.pos", "e.end", "e.tag", "e.text", "e.tight")
    last = lambda tag: F.last(F.when(F.col("tag") == tag, F.struct("pos", "end")), ignorenulls=True).over(upto())
    cells = own.withColumn("t", last("table")).withColumn("r", last("tr")).where("tag in ('td', 'th') and pos < t.end").withColumn("t", F.col("t.pos"))
    in_order = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", c)))), lambda x: x[c])
    headers = cells.groupBy("page_id", "t").agg(in_order(F.col("tag") == "th", "tight").alias("headers"))
    rows = cells.where("pos < r.end and r.pos > t").groupBy("page_id", "t", F.col("r.pos").alias("r")).agg(in_order(F.lit(True), "text").alias("cells")).where(F.exists("cells", lambda x: x != ""))
    place = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("page_id").orderBy("t")) - 1).withColumn("row", F.row_number().over(Window.partitionBy("page_id", "t").orderBy("r")) - 1)
    return place.where((F.col("n") < most) & (F.col("row") < most_rows)).join(headers, ["page_id", "t"]).select("page_id", "n", "headers", "row", "cells")


def sections(pages: DataFrame) -> DataFrame:
    """page_id, pos, key, text: texts of paragraphs, items and cells outside noise by the h2 or h3 before them. A repeated heading keeps its first place and takes the last text."""
    own = elements(pages, F.col("tag").isin("h2", "h3", "p", "li", "td")).where("not e.noise").select("page_id", "e.pos", "e.tag", "e.clean", "e.tight_clean")
    heading = F.col("tag").isin("h2", "h3")
    counted = own.withColumn("sid", F.sum(heading.cast("int")).over(upto()))
    name = F.substring(F.regexp_replace(F.trim(F.lower("tight_clean")), r"\s+", "_"), 1, 40)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~heading & (F.col("clean") != ""), F.struct("pos", "clean")))), lambda x: x["clean"]), " ")
    each = counted.groupBy("page_id", "sid").agg(F.max(F.when(heading, name)).alias("name"), said.alias("text")).where("text <> ''")
    return each.groupBy("page_id", F.coalesce("name", F.lit("introduction")).alias("key")).agg(F.min("sid").alias("pos"), F.max_by("text", "sid").alias("text"))


def main_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, text, content of the blocks of each page: runs of text between block tags, outside noise, forms' parts and comments.

    A block is content by its words and its share of linked words, and those of its neighbours, after the rules on numbers of words of Kohlschütter,
    Fankhauser and Nejdl (2010); a heading if the next block that isn't one is content; a table's cell unless a third of it is links.
    """
    rows = bounded(tokens(pages)).withColumn("aside", within(is_noise((*NOISE_TAGS, *ASIDE_TAGS), (*NOISE_CLASSES, *ASIDE_NAMES), (*NOISE_IDS, *ASIDE_NAMES))))
    opening = lambda *tags: (F.col("kind") == "open") & F.col("tag").isin(*tags)
    block = F.sum((F.col("kind").isin("open", "close") & F.col("tag").isin(*BLOCKS)).cast("int")).over(upto())
    flagged = rows.withColumn("block", block).withColumn("linked", within(opening("a"))).withColumn("heading", within(opening("h1", "h2", "h3", "h4", "h5", "h6"))).withColumn("cell", within(opening("td", "th")))
    own = flagged.where("text <> '' and not aside").withColumn("words", F.regexp_count("text", F.lit(r"\S+")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    blocks = own.groupBy("page_id", "block").agg(said.alias("text"), F.sum("words").alias("words"), F.sum(F.when(F.col("linked"), F.col("words")).otherwise(0)).alias("links"), F.max("heading").alias("heading"), F.max("cell").alias("cell")).withColumnRenamed("block", "pos")
    order = Window.partitionBy("page_id").orderBy("pos")
    share = F.col("links") / F.col("words")
    beside = blocks.withColumn("share", share)
    for c in ("words", "share"):
        beside = beside.withColumn(f"{c}_before", F.coalesce(F.lag(c).over(order), F.lit(0))).withColumn(f"{c}_after", F.coalesce(F.lead(c).over(order), F.lit(0)))
    alone = (F.col("words") > 16) | (F.col("words_after") > 15) | (F.col("words_before") > 4)
    after_links = (F.col("words") > 40) | (F.col("words_after") > 17)
    low = F.col("share") <= 1 / 3
    body = low & F.when(F.col("share_before") <= 0.555556, alone).otherwise(after_links)
    judged = beside.withColumn("low", low).withColumn("body", F.when(F.col("cell"), low).otherwise(body))
    following = F.last(F.when(~F.col("heading"), F.col("body")), ignorenulls=True).over(after())
    content = F.when(F.col("heading"), low & F.coalesce(following, F.lit(False))).otherwise(F.col("body"))
    told = judged.withColumn("content", content)
    # Recall first: a page without any content gives all that isn't mostly links.
    return told.withColumn("content", F.when(F.max("content").over(Window.partitionBy("page_id")), F.col("content")).otherwise(F.col("low"))).select("page_id", "pos", "text", "content")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, text: the content blocks of every page, a line each; empty if there are none."""
    own = per_page(pages, main_blocks(pages).where("content"), "pos", F.col("text"), "lines")
    return own.select("page_id", F.array_join("lines", "\n").alias("text"))


def parts(pages: DataFrame) -> DataFrame:
    """page_id and the arrays meta, breadcrumbs, faq, tables and sections of every page."""
    grid = tables(pages).groupBy("page_id", "n", "headers").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))
    own = per_page(pages, meta(pages), "pos", F.struct("name", "content"), "meta").join(per_page(pages, breadcrumbs(pages), "pos", F.col("crumb"), "breadcrumbs"), "page_id")
    own = own.join(per_page(pages, faq(pages), "n", F.struct("question", "answer"), "faq"), "page_id").join(per_page(pages, grid, "n", F.struct("headers", "rows"), "tables"), "page_id")
    return own.join(per_page(pages, sections(pages), "pos", F.struct("key", "text"), "sections"), "page_id")
