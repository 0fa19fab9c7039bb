"""Every operator as a query over the given tables, with SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markupsql as M
from . import sqltext as q
from .functions import html as H
from .functions import lexicon as lx
from .functions import text as T
from .operators import answer, chunks, crawl, frontier, index, markup, query, retrieve, sections
from .plans import build as B
from .plans import corpus as C
from .plans import pages as P
from .plans.corpus import table

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query. Whole numbers become 64-bit ones, as in the SQL."""

    def add(build):
        def run(spark, sf_dir):
            df = build(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


def simple(name: str, source: str, key: str, columns: dict[str, tuple[Callable[[DataFrame], Column], str]], where: str | None = None) -> None:
    """A query of columns of one table, each made of the table when the query runs, with its SQL."""
    sql = f"SELECT {key}, " + ", ".join(f"{s} AS {c}" for c, (_, s) in columns.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "")

    @register(name, sql)
    def build(spark, d):
        rows = table(spark, d, source)
        own = rows.where(where) if where else rows
        return own.select(key, *[make(own).alias(n) for n, (make, _) in columns.items()])


joined = lambda c: F.array_join(c, "|")
sql_joined = lambda s: f"array_to_string({s}, '|')"

# Text and URLs.
simple("word_count", "documents", "doc_id", {"n_words": (lambda t: T.word_count(t.text), q.words("text"))})
simple("content_hash", "documents", "doc_id", {"content_hash": (lambda t: F.sha2(t.text, 256), "sha256(text)")})
simple("page_key", "pages", "page_id", {"page_key": (lambda t: T.page_key(t.url), q.page_key("url"))})
simple("url_slug", "pages", "page_id", {"slug": (lambda t: T.slug(t.url), q.slug("url"))})
simple("page_filename", "pages", "page_id", {"file": (lambda t: T.page_file(t.url), f"substr({q.slug('url')}, 1, 70) || '_' || {q.page_key('url')} || '.json'")})
register("page_filename_v1", f"SELECT page_id, CASE WHEN page_id = min(page_id) OVER (PARTITION BY substr({q.slug('url')}, 1, 80)) THEN substr({q.slug('url')}, 1, 80) || '.json' ELSE substr({q.slug('url')}, 1, 70) || '_' || {q.page_key('url')} || '.json' END AS file FROM pages")(
    lambda spark, d: crawl.page_files(table(spark, d, "pages").select("page_id", "url")).select("page_id", "file")
)
simple("url_canonical", "pages", "page_id", {"canonical": (lambda t: T.canonical(t.url), "CASE WHEN regexp_matches(regexp_replace(url, '#.*$', ''), '[?&]utm_|\\?ref=') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') ELSE regexp_replace(url, '#.*$', '') END")})
simple("page_type", "pages", "page_id", {"page_type": (lambda t: T.page_type(t.url), q.page_type("url")), "page_type_v1": (lambda t: T.page_type(t.url, lx.PAGE_TYPES_V1), lx.sql_case(f"lower({q.path('url')})", lx.PAGE_TYPES_V1, "general", True))})
simple("crawlable", "pages", "page_id", {"crawlable": (lambda t: T.crawlable(t.url), f"regexp_matches(url, '^https?://[^/?#]+') AND NOT regexp_matches(lower({q.path('url')}), '\\.({'|'.join(lx.SKIPPED_EXTENSIONS)})$')")})
simple("low_content", "documents", "doc_id", {"low_v1": (lambda t: F.length(F.trim(t.text)) < 50, "length(trim(text)) < 50"), "low_v2": (lambda t: (F.length(t.text) < 100) | (T.word_count(t.text) < 30), f"length(text) < 100 OR {q.words('text')} < 30")})
simple("section_type", "documents", "doc_id", {"section_type": (lambda t: T.section_type(C.section_of(t.lang)), q.section_type(q.SECTION_OF)), "by_text": (lambda t: T.section_type(t.text), q.section_type("text"))})
simple("chunk_priority", "documents", "doc_id", {"priority": (lambda t: T.priority(T.section_type(C.section_of(t.lang)), T.word_count(t.text)), q.priority(q.section_type(q.SECTION_OF), q.words("text")))})
simple("entities", "documents", "doc_id", {"entities": (lambda t: joined(T.entities(t.text)), sql_joined(q.entities("text")))})
simple("page_lengths", "pages", "page_id", {"n_chars": (lambda t: F.length(t.html).cast("long"), "length(html)"), "n_words": (lambda t: T.word_count(H.visible(t.html)), q.words(q.visible("html")))}, "html IS NOT NULL")
simple("sentence_split", "documents", "doc_id", {"n_sentences": (lambda t: F.size(chunks.sentences(t.text)).cast("long"), "len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1␞', 'g'), '␞'))")})
simple("pages_scan", "pages", "page_id", {"url": (lambda t: t.url, "url"), "n_chars": (lambda t: F.length(t.html).cast("long"), "length(html)")})

# Page parts.
simple("page_title", "pages", "page_id", {"title": (lambda t: H.title(t.html), q.title("html")), "h1": (lambda t: H.h1(t.html), q.h1("html"))})
simple("html_strip", "pages", "page_id", {"stripped_hash": (lambda t: F.sha2(H.stripped(t.html), 256), f"sha256({q.stripped('html')})")})
simple("visible_text", "pages", "page_id", {"visible": (lambda t: H.visible(t.html), q.visible("html"))})
simple("contacts", "documents", "doc_id", {"email": (lambda t: joined(H.contacts(t.text)["email"]), sql_joined(q.distinct(f"regexp_extract_all(text, '{lx.EMAIL}')") + "[1:5]")), "phone": (lambda t: joined(H.contacts(t.text)["phone"]), sql_joined(q.distinct(f"regexp_extract_all(text, '{lx.PHONE}')") + "[1:5]"))})

HEADINGS_SQL = f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS n, level, heading FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, heading ORDER BY idx) AS r FROM (SELECT page_id, lower(substr(h, 2, 2)) AS level, {q.tag_text('h')} AS heading, idx FROM (
    SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS idx FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>') AS l FROM pages)))) WHERE r = 1 AND length(heading) > 2"""


@register("headings", HEADINGS_SQL)
def headings(spark, d):
    each = table(spark, d, "pages").select("page_id", F.posexplode(H.headings(F.col("html"))).alias("n", "h"))
    return each.select("page_id", F.col("n") + 1, F.col("h.level").alias("level"), F.col("h.text").alias("heading")).withColumnRenamed("(n + 1)", "n")


LINK = "CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h WHEN starts_with(h, '?') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || " + q.path("url") + " || h WHEN h = '' THEN regexp_replace(url, '#.*$', '') ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(CASE WHEN " + q.path("url") + " = '' THEN '/' ELSE " + q.path("url") + " END, '[^/]*$', '') || h END"
LINKS = f"""links AS (SELECT page_id, url, link, min(idx) - 1 AS pos FROM (SELECT page_id, url, idx, {LINK} AS link FROM (
  SELECT page_id, url, idx, regexp_replace(trim(href), '#.*$', '') AS h, trim(href) AS href FROM (
    SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS idx FROM (SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(mailto:|tel:|#)')) AS l FROM pages))))
  WHERE {q.host('link')} = {q.host('url')} GROUP BY ALL)"""


@register("internal_links", f"WITH {LINKS} SELECT page_id, link, CAST(pos AS BIGINT) AS pos FROM links")
def internal_links(spark, d):
    return crawl.internal_links(table(spark, d, "pages")).select("page_id", "link", "pos")


@register("parsed_pages", f"""SELECT page_id, {q.page_key('url')} AS page_key, {q.slug('url')} AS slug, {q.title('html')} AS title, {q.h1('html')} AS h1, {q.page_type('url')} AS page_type,
  {q.words(q.visible('html'))} AS n_words, sha256({q.visible('html')}) AS content_hash FROM pages""")
def parsed_pages(spark, d):
    own = P.parsed(table(spark, d, "pages"))
    return own.select("page_id", "page_key", "slug", "title", "h1", "page_type", "n_words", "content_hash")


@register("page_records")
def page_records(spark, d):
    """Whole page records with the parts that need a tree."""
    own = P.records(table(spark, d, "pages"))
    return own.select("page_id", "slug", "title", "section_count", F.size("headings").alias("n_headings"), F.size("internal_links").alias("n_links"), joined("keywords").alias("keywords"))


def pages_of(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "html")


register("meta_map", M.META)(lambda spark, d: (lambda x: markup.per_page(x, markup.meta(x), "pos", F.concat_ws("=", "name", "content"), "own"))(pages_of(spark, d)).select("page_id", joined("own").alias("meta_map")))
register("breadcrumbs", M.BREADCRUMBS)(lambda spark, d: (lambda x: markup.per_page(x, markup.breadcrumbs(x), "pos", F.col("crumb"), "own"))(pages_of(spark, d)).select("page_id", joined("own").alias("breadcrumbs")))
register("faq_extract", M.FAQ)(lambda spark, d: markup.faq(pages_of(spark, d)))
register("tables", M.TABLES)(lambda spark, d: markup.tables(pages_of(spark, d)).withColumn("headers", joined("headers")).withColumn("cells", joined("cells")))
register("html_sections", M.SECTIONS)(lambda spark, d: markup.sections(pages_of(spark, d)))
register("main_text", M.MAIN_TEXT)(lambda spark, d: markup.main_text(pages_of(spark, d)).select("page_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars")))
register("faq_jsonld", """SELECT page_id, CAST(n - 1 AS BIGINT) AS n, coalesce(json_extract_string(item, '$.name'), '') AS question, substr(coalesce(json_extract_string(item, '$.acceptedAnswer.text'), ''), 1, 1000) AS answer FROM (
  SELECT page_id, item, row_number() OVER (PARTITION BY page_id ORDER BY k, i) AS n FROM (SELECT page_id, k, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (
    SELECT page_id, k, CAST(json_extract(doc, '$.mainEntity') AS JSON[]) AS items FROM (SELECT page_id, unnest(l) AS doc, generate_subscripts(l, 1) AS k FROM (
      SELECT page_id, regexp_extract_all(html, '(?is)<script\\b[^>]*type\\s*=\\s*["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1) AS l FROM pages)) WHERE json_valid(doc) AND json_extract_string(doc, '$."@type"') = 'FAQPage'))
  WHERE coalesce(json_extract_string(item, '$.name'), '') <> '') WHERE n <= 30""")(
    lambda spark, d: table(spark, d, "pages").select("page_id", F.posexplode(H.faq_jsonld(F.col("html"))).alias("n", "x")).select("page_id", "n", "x.question", "x.answer")
)
CONTACT_LINKS = "list_transform(list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"', 1), lambda x: trim(x)), lambda x: contains(lower(x), 'contact')), lambda x: regexp_replace(x, '#.*$', ''))"
register("contact_links", f"SELECT page_id, {sql_joined(q.distinct('own') + '[1:3]')} AS contact_links FROM (SELECT page_id, list_transform({CONTACT_LINKS}, lambda h: {LINK}) AS own FROM pages)")(
    lambda spark, d: table(spark, d, "pages").select("page_id", joined(H.contact_links(F.col("html"), F.col("url"))).alias("contact_links"))
)

LINES = "SELECT doc_id, line, idx - 1 AS pos FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
SECTIONS = f"line_sections AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, {q.base_key('substr(line, 1, 40)')} AS key, line AS text, {q.words('line')} AS wc FROM ({LINES}) WHERE {q.words('line')} >= 10)"


@register("sections_v1", f"""WITH marked AS (SELECT *, sum(CASE WHEN {q.words('line')} < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid, {q.words('line')} < 6 AS heading FROM ({LINES})
), grouped AS (SELECT doc_id, sid, min(pos) AS pos, max(CASE WHEN heading THEN substr(regexp_replace(lower(line), '\\s+', '_', 'g'), 1, 40) END) AS name, string_agg(CASE WHEN NOT heading THEN line END, ' ' ORDER BY pos) AS text FROM marked GROUP BY ALL)
SELECT doc_id, coalesce(name, 'introduction') AS key, CAST(min(sid) AS BIGINT) AS sid, sha256(arg_max(text, sid)) AS text_hash FROM grouped WHERE text <> '' GROUP BY ALL""")
def sections_v1(spark, d):
    """Lines under a heading (a line of under six words); a repeated heading keeps the first place and the last text."""
    return P.headed_sections(sections.lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id", F.regexp_count("line", F.lit(r"\S+")) < 6).select("doc_id", "key", "sid", F.sha2("text", 256).alias("text_hash"))


@register("sections_v2", f"WITH {q.visible_sections('(SELECT doc_id AS id, text, NULL AS title FROM documents)')} SELECT id AS doc_id, CAST(pos AS BIGINT) AS pos, key, sha256(text) AS text_hash FROM visible_sections")
def sections_v2(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("title"))
    return sections.visible_sections(rows, "doc_id", "text", "title").select("doc_id", "pos", "key", F.sha2("text", 256).alias("text_hash"))


KEYS = f"""SELECT doc_id, pos, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS r FROM (SELECT doc_id, pos, {q.base_key('line')} AS base FROM ({LINES})))"""


@register("section_key", KEYS.replace("SELECT doc_id, pos, CASE", "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE", 1))
def section_key(spark, d):
    own = sections.lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.col("line").alias("name"))
    return sections.unique_keys(own, "doc_id").select("doc_id", "pos", "key")


@register("quality_report", f"WITH {SECTIONS} SELECT doc_id, count(*) AS n_sections, sum(wc) :: BIGINT AS n_words, arg_min(substr(text, 1, 80), pos) AS preview FROM line_sections WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5) GROUP BY 1")
def quality_report(spark, d):
    first = table(spark, d, "documents").orderBy("doc_id").limit(5)  # the report is on the first five
    own = sections.line_sections(first, "doc_id", "text")
    return own.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("wc").alias("n_words"), F.min_by(F.substring("text", 1, 80), "pos").alias("preview"))


# Keywords.
for _name, _stop, _most in (("page_keywords", lx.PAGE_STOP_WORDS, 40), ("chunk_keywords", lx.CHUNK_STOP_WORDS, 15)):
    register(_name, f"SELECT doc_id, coalesce(array_to_string(keywords, '|'), '') AS keywords FROM documents LEFT JOIN ({q.keyword_rows('documents', 'doc_id', 'text', _stop, _most)}) USING (doc_id)")(
        lambda spark, d, s=_stop, m=_most: chunks.keywords(table(spark, d, "documents"), ["doc_id"], F.col("text"), s, m).select("doc_id", joined("keywords").alias("keywords"))
    )

# Chunks. Packs and sentence groups are folds; the SQL walks them with recursion.
PACKED = f"{SECTIONS}, {q.PACKED}"


def packed(spark, d) -> DataFrame:
    return chunks.packed(sections.line_sections(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


DESCRIBED = q.DESCRIBED


@register("chunk_pack", f"WITH RECURSIVE {PACKED}, {DESCRIBED} SELECT chunk_id, doc_id, section_type, word_count, array_to_string(entities, '|') AS entities, priority_score, content_hash FROM described")
def chunk_pack(spark, d):
    return chunks.described(packed(spark, d), "doc_id").select("chunk_id", "doc_id", "section_type", "word_count", joined("entities").alias("entities"), "priority_score", "content_hash")


TITLE_TEXT = f"trim({q.h1('html')} || '. ' || {q.title('html')})"


@register("title_chunk", f"SELECT page_id || '_title' AS chunk_id, page_id, {TITLE_TEXT} AS text, {q.words(TITLE_TEXT)} AS word_count, CAST(0.8 AS DOUBLE) AS priority_score, sha256({TITLE_TEXT}) AS content_hash FROM pages WHERE {q.title('html')} <> ''")
def title_chunk(spark, d):
    own = table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.h1(F.col("html")).alias("h1"), H.title(F.col("html")).alias("description"))
    return chunks.title_chunks(own, "page_id").select("chunk_id", "page_id", "text", "word_count", "priority_score", "content_hash")


PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


@register("faq_chunks", f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, 'Q: ' || question || chr(10) || 'A: ' || answer AS text FROM pairs)
SELECT conv_id || '_faq_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS chunk_id, conv_id, {q.words('text')} AS word_count, CAST(0.95 AS DOUBLE) AS priority_score, sha256(text) AS content_hash FROM n WHERE question <> '' AND answer <> ''""")
def faq_chunks(spark, d):
    pairs = C.turn_pairs(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("faq"))
    return chunks.faq_chunks(pairs, "conv_id").select("chunk_id", "conv_id", "word_count", "priority_score", "content_hash")


ALL_CHUNKS = f"""WITH RECURSIVE {PACKED}, {DESCRIBED}, titles AS (SELECT doc_id || '_title' AS chunk_id, 'intro' AS section_type, trim(string_split(text, chr(10))[1] || '. ') AS text FROM documents WHERE string_split(text, chr(10))[1] <> '')
SELECT chunk_id, section_type, sha256(text) AS content_hash FROM titles UNION ALL SELECT chunk_id, section_type, content_hash FROM described"""


def all_of(spark, d) -> DataFrame:
    first = F.split("text", "\n")[0]
    own = table(spark, d, "documents").select("doc_id", first.alias("title"), first.alias("h1"), F.lit("").alias("description"))
    return chunks.title_chunks(own, "doc_id").select("chunk_id", "section_type", "content_hash").unionByName(chunks.described(packed(spark, d), "doc_id").select("chunk_id", "section_type", "content_hash"))


register("all_chunks", ALL_CHUNKS)(all_of)
register("chunk_count", f"SELECT section_type, count(*) AS n FROM ({ALL_CHUNKS}) GROUP BY 1")(lambda spark, d: all_of(spark, d).groupBy("section_type").agg(F.count("*").alias("n")))


# Indexes.
def on_chunks(name: str, select: str, build) -> None:
    register(name, q.retrieval(select))(lambda spark, d: build(C.document_indexes(spark, d)))


on_chunks("keyword_index", "SELECT * FROM keyword_index", lambda x: x.keyword)
on_chunks("url_index", "SELECT * FROM url_index", lambda x: x.url)
on_chunks("faq_index", "SELECT * FROM faq_index", lambda x: x.faq)
on_chunks("faq_router", "SELECT question, max(chunk_id) AS chunk_id FROM (SELECT lower(trim(replace(string_split(text, chr(10))[1], 'Q:', ''))) AS question, chunk_id FROM chunks WHERE section_type = 'faq') WHERE question <> '' GROUP BY 1", lambda x: index.faq_router(x.chunks))
on_chunks("intent_index", "SELECT * FROM intent_index", lambda x: x.intent)
on_chunks("heading_index", "SELECT DISTINCT lower(section) AS heading, chunk_id FROM chunks", lambda x: index.heading_index(x.chunks))
register("postings", q.retrieval("SELECT * FROM postings"))(lambda spark, d: index.postings(C.document_chunks(table(spark, d, "documents")), C.INDEXED))
on_chunks("index_postings_size", "SELECT keyword, count(*) AS n, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM keyword_index GROUP BY 1", lambda x: x.keyword.groupBy("keyword").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk")))
on_chunks("faq_url_join", "SELECT question_hash, f.chunk_id, f.page_id, slug FROM faq_index f JOIN url_index u ON u.page_id = f.page_id", lambda x: x.faq.join(x.url, "page_id").select("question_hash", "chunk_id", "page_id", "slug"))
register("postings_stem")(lambda spark, d: index.postings(C.document_chunks(table(spark, d, "documents")), ["text"], stem=True))
register("url_index_sql", f"""SELECT DISTINCT slug, page_id FROM (SELECT page_id, lower({q.host('url')}) AS h, unnest(list_append(string_split(lower(regexp_replace(url, '^https?://', '')), '/'), {q.slug('url')})) AS slug FROM pages) WHERE slug <> '' AND slug <> h""")(lambda spark, d: index.url_index_sql(table(spark, d, "pages")))


@register("index_lookup", q.retrieval("SELECT w.keyword, coalesce(k.chunk_id, -1) AS chunk_id FROM (SELECT DISTINCT unnest(keywords) AS keyword FROM processed) w LEFT JOIN keyword_index k USING (keyword)"))
def index_lookup(spark, d):
    wanted = C.processed_questions(spark, d).select(F.explode("keywords").alias("keyword")).distinct()
    return index.lookup(C.document_indexes(spark, d).keyword, "keyword", wanted).select("keyword", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"))


@register("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    return index.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@register("kb_sections", f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, sha256(trim(line)) AS text_hash FROM ({LINES}) WHERE length(trim(line)) >= 10")
def kb_sections(spark, d):
    return sections.lines(table(spark, d, "documents"), "doc_id", "text").where(F.length(F.trim("line")) >= 10).select("doc_id", "pos", F.sha2(F.trim("line"), 256).alias("text_hash"))


@register("kb_stats", q.retrieval("SELECT (SELECT count(*) FROM doc_pages) AS n_pages, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(DISTINCT keyword) FROM keyword_index) AS n_keywords, (SELECT count(*) FROM faq_index) AS n_faq"))
def kb_stats(spark, d):
    own = C.document_indexes(spark, d)
    count = lambda df, c, name: df.agg(c.alias(name))
    pages = C.document_pages(table(spark, d, "documents"))
    return count(pages, F.count("*"), "n_pages").crossJoin(count(own.chunks, F.count("*"), "n_chunks")).crossJoin(count(own.keyword, F.countDistinct("keyword"), "n_keywords")).crossJoin(count(own.faq, F.count("*"), "n_faq"))


register("kb_health", "SELECT (SELECT count(*) FROM documents) > 0 AND (SELECT count(*) FROM pages) > 0 AS ready, (SELECT count(*) FROM pages) AS n_pages, (SELECT count(*) FROM documents) AS n_chunks")(
    lambda spark, d: table(spark, d, "pages").agg(F.count("*").alias("n_pages")).crossJoin(table(spark, d, "documents").agg(F.count("*").alias("n_chunks"))).select(((F.col("n_pages") > 0) & (F.col("n_chunks") > 0)).alias("ready"), "n_pages", "n_chunks")
)


# Queries.
def on_questions(name: str, select: str, build) -> None:
    register(name, f"WITH {q.processed(lx.SAMPLE_INTENTS)} {select}")(lambda spark, d: build(C.processed_questions(spark, d)))


on_questions("query_clean", "SELECT query_id, clean FROM processed", lambda x: x.select("query_id", "clean"))
on_questions("query_tokens", f"SELECT query_id, {sql_joined('original')} AS original, {sql_joined('tokens')} AS tokens FROM processed", lambda x: x.select("query_id", joined("original").alias("original"), joined("tokens").alias("tokens")))
on_questions("query_keywords", f"SELECT query_id, {sql_joined('keywords')} AS keywords, phrase FROM processed", lambda x: x.select("query_id", joined("keywords").alias("keywords"), "phrase"))
on_questions("query_intents", f"SELECT query_id, {sql_joined('intents')} AS intents FROM processed", lambda x: x.select("query_id", joined("intents").alias("intents")))
on_questions("routing_keywords", f"SELECT query_id, {sql_joined('routing_keywords')} AS routing_keywords FROM processed", lambda x: x.select("query_id", joined("routing_keywords").alias("routing_keywords")))
on_questions("faq_like", "SELECT query_id, faq_like FROM processed", lambda x: x.select("query_id", "faq_like"))
on_questions("processed_queries", f"SELECT query_id, clean, {sql_joined('keywords')} AS keywords, {sql_joined('intents')} AS intents, {sql_joined('match_terms')} AS match_terms, faq_like FROM processed", lambda x: x.select("query_id", "clean", joined("keywords").alias("keywords"), joined("intents").alias("intents"), joined("match_terms").alias("match_terms"), "faq_like"))
GREET = f"trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) IN {tuple(lx.GREETINGS)}"
register("greeting_split", f"WITH {q.QUESTIONS} SELECT {GREET} AS greeting, count(*) AS n FROM questions GROUP BY 1")(
    lambda spark, d: C.questions(spark, d).groupBy(query.is_greeting(F.col("text")).alias("greeting")).agg(F.count("*").alias("n"))
)
register("valid_queries", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 1 AND 2000 AND trim(text) <> ''")(lambda spark, d: query.valid(table(spark, d, "documents")).select("doc_id"))


@register("token_overlap", f"WITH w AS (SELECT conv_id, turn, {q.question_words('text')} AS ws FROM conversations) SELECT a.conv_id, a.turn, round({q.likeness('a.ws', 'b.ws')}, 6) AS likeness, len(list_intersect(a.ws, b.ws)) AS shared, len(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x))) AS own FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def token_overlap(spark, d):
    own = table(spark, d, "conversations").select("conv_id", "turn", index.question_words(F.col("text")).alias("a"))
    nxt = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return own.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("likeness"), F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("own"))


# FAQ: stored questions are users' turns; the queries are the first 80 % of their words.
PROBES = "stored AS (SELECT 'c' || conv_id || '_' || turn AS chunk_id, text AS question FROM conversations WHERE role = 'user'), probes AS (SELECT chunk_id AS query_id, array_to_string(l[1:greatest(1, CAST(floor(len(l) * 0.8) AS BIGINT))], ' ') AS text FROM (SELECT chunk_id, regexp_extract_all(question, '\\S+') AS l FROM stored))"


def probes(spark, d) -> tuple[DataFrame, DataFrame]:
    stored = table(spark, d, "conversations").where("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("chunk_id"), F.col("text").alias("question"))
    own = F.regexp_extract_all("question", F.lit(r"(\S+)"), F.lit(1))
    return stored.select(F.col("chunk_id").alias("query_id"), F.array_join(F.slice(own, 1, F.greatest(F.lit(1), F.floor(F.size(own) * 0.8).cast("int"))), " ").alias("text")), stored


register("faq_match", f"WITH {PROBES}, {q.faq_match('probes', 'stored')} SELECT * FROM faq_match")(lambda spark, d: retrieve.faq_matches(*probes(spark, d)))


@register("faq_jaccard", f"WITH {PROBES} SELECT query_id, round({q.likeness('q', 'f')}, 6) AS likeness FROM (SELECT query_id, {q.question_words('text')} AS q, {q.question_words('question')} AS f FROM probes JOIN stored ON query_id = chunk_id)")
def faq_jaccard(spark, d):
    asked, stored = probes(spark, d)
    both = asked.join(stored, asked.query_id == stored.chunk_id)
    return both.select("query_id", F.round(T.jaccard(index.question_words(F.col("text")), index.question_words(F.col("question"))), 6).alias("likeness"))


# Retrieval.
def on_retrieval(name: str, select: str, build) -> None:
    register(name, q.retrieval(select))(lambda spark, d: build(C.asked_questions(spark, d), C.document_indexes(spark, d)))


on_retrieval("route_pages", "SELECT query_id, page_id FROM routed", lambda x, i: retrieve.routed(x, i))
TOP25 = "SELECT query_id, chunk_id, score, n_match FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored WHERE {0}) WHERE r <= 25"
on_retrieval("bm25_and", TOP25.format("n_match = n_terms"), lambda x, i: retrieve.matched(x, i, True).drop("rank"))
on_retrieval("bm25_or", TOP25.format("true"), lambda x, i: retrieve.matched(x, i, False).drop("rank"))
on_retrieval("bm25_routed", "SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored JOIN routed USING (query_id, page_id)) WHERE r <= 25", lambda x, i: retrieve.routed_matches(x, i))
on_retrieval("bm25_tiered", "SELECT query_id, chunk_id, score, tier FROM tiered", lambda x, i: retrieve.tiered(retrieve.candidates(x, i)))
on_retrieval("bm25_topk", "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 25", lambda x, i: retrieve.matched(x, i, False).select("query_id", "chunk_id", "score", "rank"))
on_retrieval("keyword_supplement", "SELECT query_id, chunk_id FROM supplement", lambda x, i: retrieve.keyword_chunks(x, i))
register("like_search", q.retrieval("""SELECT query_id, chunk_id, CAST(0.3 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS r FROM (
  SELECT query_id, chunk_id FROM processed p, chunks c WHERE len(p.keywords) > 0 AND len(list_filter(p.keywords[1:3], lambda k: contains(lower(c.text), k))) > 0)) WHERE r <= 25"""))(
    lambda spark, d: retrieve.like_search(C.asked_questions(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
)
on_retrieval("rerank", "SELECT query_id, chunk_id, final_score, tier, place FROM reranked", lambda x, i: retrieve.reranked(retrieve.gathered(x, i), x, i.chunks).select("query_id", "chunk_id", "final_score", "tier", "place"))
on_retrieval("prefix_dedup", "SELECT query_id, chunk_id, place FROM deduped", lambda x, i: retrieve.deduplicated(retrieve.reranked(retrieve.gathered(x, i), x, i.chunks.drop("text"))).select("query_id", "chunk_id", "place"))
on_retrieval("retrieve_topk", "SELECT query_id, rank, chunk_id FROM top", lambda x, i: retrieve.retrieved(x, i).select("query_id", "rank", "chunk_id"))
on_retrieval("confidence", "SELECT * FROM confidence", lambda x, i: retrieve.confidence(retrieve.retrieved(x, i), x))
on_retrieval("confidence_band", "SELECT CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM confidence GROUP BY 1", lambda x, i: retrieve.confidence(retrieve.retrieved(x, i), x).groupBy(T.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n")))
on_retrieval("retrieve", "SELECT t.query_id, t.rank, t.chunk_id, t.page_id, t.section_type, t.final_score, t.tier, c.confidence FROM top t JOIN confidence c USING (query_id)", lambda x, i: (lambda r: r.join(retrieve.confidence(r, x), "query_id").select("query_id", "rank", "chunk_id", "page_id", "section_type", "final_score", "tier", "confidence"))(retrieve.retrieved(x, i)))
on_retrieval("answer_gate", "SELECT query_id, confidence < 0.25 OR n_chunks = 0 AS fallback FROM confidence", lambda x, i: retrieve.confidence(retrieve.retrieved(x, i), x).select("query_id", ((F.col("confidence") < retrieve.Limits.threshold) | (F.col("n_chunks") == 0)).alias("fallback")))
on_retrieval("admin_search", "SELECT query_id, rank, chunk_id, section, floor(final_score * 10000 + 0.5) / 10000 AS score, sha256(substr(text, 1, 200) || '...') AS preview_hash FROM top", lambda x, i: answer.preview(retrieve.retrieved(x, i)).select("query_id", "rank", "chunk_id", "section", "score", F.sha2("preview", 256).alias("preview_hash")))
on_retrieval("context_block", "SELECT query_id, sha256(context) AS context_hash, length(context) AS n_chars FROM contexts", lambda x, i: answer.context(retrieve.retrieved(x, i)).select("query_id", F.sha2("context", 256).alias("context_hash"), F.length("context").alias("n_chars")))
on_retrieval("prompt_sources", "SELECT p.query_id, coalesce(array_to_string(urls[1:5], '|'), '') AS sources FROM processed p LEFT JOIN contexts USING (query_id)", lambda x, i: answer.prompts(x, answer.context(retrieve.retrieved(x, i))).select("query_id", "sources"))
on_retrieval("answers", f"SELECT c.query_id, sha256(CASE WHEN low THEN '{answer.FALLBACK}' ELSE first_text END) AS answer_hash, confidence, CASE WHEN low THEN '' ELSE array_to_string(urls[1:3], '|') END AS sources, n_chunks, low AS fallback FROM (SELECT *, confidence < 0.25 OR n_chunks = 0 AS low FROM confidence) c LEFT JOIN contexts USING (query_id)", lambda x, i: (lambda r: answer.answers(x, r, retrieve.confidence(r, x)).select("query_id", F.sha2("answer", 256).alias("answer_hash"), "confidence", "sources", "n_chunks", "fallback"))(retrieve.retrieved(x, i)))

on_retrieval("responses", f"SELECT p.query_id, sha256(CASE WHEN {GREET} THEN '{answer.GREETING}' WHEN low THEN '{answer.FALLBACK}' ELSE first_text END) AS answer_hash, CASE WHEN {GREET} THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN {GREET} THEN 'greeting' ELSE {sql_joined('intents')} END AS intents FROM processed p JOIN (SELECT *, confidence < 0.25 OR n_chunks = 0 AS low FROM confidence) USING (query_id) LEFT JOIN contexts USING (query_id)", lambda x, i: (lambda r: answer.responses(x, r, retrieve.confidence(r, x)).select("query_id", F.sha2("answer", 256).alias("answer_hash"), "confidence", joined("intents").alias("intents")))(retrieve.retrieved(x, i)))

# The same with stems, which SQL hasn't; tested on small cases.
register("retrieve_stem")(lambda spark, d: retrieve.retrieved(C.asked_questions(spark, d), C.document_indexes(spark, d, stem=True)).select("query_id", "rank", "chunk_id", "final_score", "tier"))

# Raw pages, through their chunks and indexes.
register("page_chunks", q.on_pages("SELECT chunk_id, page_id, section, section_type, word_count, array_to_string(keywords, '|') AS keywords, array_to_string(entities, '|') AS entities, priority_score, content_hash FROM all_page_chunks"))(
    lambda spark, d: B.page_chunks(table(spark, d, "pages")).select("chunk_id", "page_id", "section", "section_type", "word_count", joined("keywords").alias("keywords"), joined("entities").alias("entities"), "priority_score", "content_hash")
)
register("page_retrieve", q.on_pages("SELECT t.query_id, t.rank, t.chunk_id, t.page_id, t.section_type, t.final_score, t.tier, c.confidence FROM top t JOIN confidence c USING (query_id)", retrieval=True))(
    lambda spark, d: (lambda x, r: r.join(retrieve.confidence(r, x), "query_id").select("query_id", "rank", "chunk_id", "page_id", "section_type", "final_score", "tier", "confidence"))(
        *(lambda x: (x, retrieve.retrieved(x, B.page_indexes(table(spark, d, "pages"), lx.SAMPLE_INTENTS))))(C.asked_questions(spark, d))
    )
)

# The link graph: the first page of each host at depth 0, its sitemap (the host's pages) at depth 1, and from there the pages' own links.
CANON = "CASE WHEN regexp_matches(regexp_replace({0}, '#.*$', ''), '[?&]utm_|\\?ref=') THEN regexp_replace(regexp_replace({0}, '#.*$', ''), '\\?.*$', '') ELSE regexp_replace({0}, '#.*$', '') END"
CRAWLABLE = f"regexp_matches({{0}}, '^https?://[^/?#]+') AND NOT regexp_matches(lower({q.PATH}), '\\.({'|'.join(lx.SKIPPED_EXTENSIONS)})$')"


@register("link_bfs", f"""WITH RECURSIVE {LINKS}, own AS (SELECT page_id, {q.host('url')} AS host, url FROM pages
), seeds AS (SELECT {CANON.format('url')} AS url, CAST(CASE WHEN page_id = min(page_id) OVER (PARTITION BY host) THEN 0 ELSE 1 END AS BIGINT) AS depth FROM own
), edges AS (SELECT DISTINCT {CANON.format('url')} AS src, {CANON.format('link')} AS dst FROM links WHERE {CRAWLABLE.format('link')}
), walk(url, depth) AS (SELECT url, depth FROM seeds UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = url WHERE depth < 8)
SELECT url, min(depth) AS depth FROM walk GROUP BY 1""")
def link_bfs(spark, d):
    pages = table(spark, d, "pages")
    first = pages.groupBy(T.host(F.col("url")).alias("host")).agg(F.min_by("url", "page_id").alias("url")).select(T.canonical(F.col("url")).alias("url"), F.lit(0).cast("long").alias("depth"))
    mapped = crawl.sitemap_urls(sitemaps(pages)).where("kind = 'page'").select(T.canonical(F.col("loc")).alias("url"), F.lit(1).cast("long").alias("depth"))
    edges = crawl.internal_links(pages).select(T.canonical(F.col("url")).alias("src"), F.col("link").alias("dst"))
    return crawl.depths(first.unionByName(mapped), edges, most=8)


@register("crawl_resume", f"WITH {LINKS} SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT url FROM pages)")
def crawl_resume(spark, d):
    pages = table(spark, d, "pages")
    return crawl.unseen(crawl.internal_links(pages).select(F.col("link").alias("url")).distinct(), pages)


def sitemaps(pages: DataFrame) -> DataFrame:
    """Sitemaps (url, xml) of each host's pages, of 50,000 entries at most, as the protocol has it."""
    entry = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = pages.groupBy(T.host(F.col("url")).alias("host"), F.floor(F.col("page_id") / 50_000).alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    return maps.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap-"), F.col("part").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))


@register("sitemap_parse", f"SELECT DISTINCT 'page' AS kind, trim(url) AS loc FROM pages WHERE {q.host('url')} <> ''")
def sitemap_parse(spark, d):
    """Sitemaps are made of each host's pages, and read back."""
    return crawl.sitemap_urls(sitemaps(table(spark, d, "pages")))


ROBOTS = "concat('# rules of ', {host}, chr(10), 'User-agent: other', chr(10), 'Disallow: /', chr(10), 'User-Agent: sift', chr(10), 'user-agent: *', chr(13), chr(10), 'Disallow: /t # all under t', chr(10), 'Disallow: /a', chr(10), 'ALLOW: /th', chr(10), 'Disallow:', chr(10), 'Sitemap: x')"
HOSTS = f"SELECT DISTINCT {q.host('url')} AS host FROM pages WHERE {q.host('url')} <> ''"
ROBOTS_SQL = f"""WITH files AS (SELECT host, {ROBOTS.format(host='host')} AS txt FROM ({HOSTS})
), lines AS (SELECT host, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT host, regexp_split_to_array(txt, '\r\n|\r|\n') AS l FROM files)
), named AS (SELECT host, pos, lower(trim(regexp_extract(p, '^([^:]*):', 1))) AS name, trim(regexp_extract(p, '^[^:]*:(.*)$', 1)) AS value FROM (SELECT host, pos, regexp_replace(line, '#.*$', '') AS p FROM lines)
), known AS (SELECT *, name = 'user-agent' AS is_agent FROM named WHERE name IN ('user-agent', 'allow', 'disallow')
), marked AS (SELECT *, is_agent AND NOT coalesce(lag(is_agent) OVER (PARTITION BY host ORDER BY pos), false) AS begins FROM known
), grouped AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY host ORDER BY pos) AS g FROM marked
), agents AS (SELECT DISTINCT host, g FROM grouped WHERE is_agent AND value = '*')"""
register("robots_rules", f"{ROBOTS_SQL} SELECT DISTINCT host, value AS path, name = 'allow' AS allow FROM grouped JOIN agents USING (host, g) WHERE NOT is_agent AND value <> ''")(lambda spark, d: crawl.robots_rules(robots(table(spark, d, "pages"))))


@register("robots_filter", f"""{ROBOTS_SQL}, rules AS (SELECT DISTINCT host, value AS path, name = 'allow' AS allow FROM grouped JOIN agents USING (host, g) WHERE NOT is_agent AND value <> ''
), hits AS (SELECT url, arg_max(allow, length(path) * 2 + CAST(allow AS INT)) AS allow FROM (SELECT url, {q.host('url')} AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS p FROM pages) JOIN rules USING (host) WHERE starts_with(p, path) GROUP BY url)
SELECT url FROM pages WHERE url NOT IN (SELECT url FROM hits WHERE NOT allow)""")
def robots_filter(spark, d):
    """Robots files of all hosts, which keep crawlers out of /t and /a, but for /th."""
    pages = table(spark, d, "pages")
    return crawl.allowed(pages.select("url"), crawl.robots_rules(robots(pages)))


def robots(pages: DataFrame) -> DataFrame:
    """A robots file (host, txt) of every host of pages."""
    own = pages.select(T.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    return own.select("host", F.expr(ROBOTS.format(host="host").replace("chr(", "char(")).alias("txt"))


# Schedules of a crawl over all pages: times follow from page ids, outcomes from a digest of URL and attempt.
DUE, ERRS = "(page_id * 7919) % 60000", "substr(md5(url || ':' || attempt), 1, 1)"
STATUS = f"CASE WHEN {ERRS} < '5' THEN NULL WHEN {ERRS} = 'f' THEN 404 ELSE 200 END"


def _round(n: int) -> str:
    """The n-th round of attempts in SQL; `last` is the end of all rounds before."""
    before = " UNION ALL ".join(f"SELECT * FROM done{k}" for k in range(1, n))
    waiting = f"SELECT url, 0 AS depth, min({DUE}) AS due FROM pages WHERE {q.host('url')} <> '' GROUP BY url" if n == 1 else f"SELECT url, depth, fetch_at + {n - 1} * {frontier.BACK_OFF} AS due FROM done{n - 1} WHERE outcome = 'failed'"
    last = f"LEFT JOIN (SELECT host, max(fetch_at) AS last FROM ({before}) GROUP BY host) USING (host)" if n > 1 else ""
    return f"""w{n} AS (SELECT *, {q.host('url')} AS host FROM ({waiting})
), k{n} AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY due, depth, url) AS k FROM w{n}
), t{n} AS (SELECT url, k{n}.host, depth, k * {frontier.PAUSE} + greatest(max(due - k * {frontier.PAUSE}) OVER (PARTITION BY k{n}.host ORDER BY k), {'last' if n > 1 else 'NULL'}) AS fetch_at, {n} AS attempt FROM k{n} {last}
), done{n} AS (SELECT url, host, depth, attempt, fetch_at, CASE WHEN s < 400 THEN 'read' WHEN s >= 400 THEN 'refused' ELSE 'failed' END AS outcome FROM (SELECT *, {STATUS} AS s FROM t{n}))"""


def frontier_of(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("url", F.lit(0).cast("long").alias("depth"), F.expr(DUE).alias("due"))


register("crawl_schedule", f"WITH {_round(1)} SELECT url, host, CAST(depth AS BIGINT) AS depth, CAST(fetch_at AS BIGINT) AS fetch_at FROM t1")(lambda spark, d: frontier.scheduled(frontier_of(spark, d)))
register("crawl_attempts", f"WITH {_round(1)}, {_round(2)}, {_round(3)} SELECT url, host, CAST(depth AS BIGINT) AS depth, CAST(attempt AS BIGINT) AS attempt, CAST(fetch_at AS BIGINT) AS fetch_at, outcome FROM (SELECT * FROM done1 UNION ALL SELECT * FROM done2 UNION ALL SELECT * FROM done3)")(
    lambda spark, d: frontier.attempts(frontier_of(spark, d), lambda x: x.select("url", F.expr(STATUS).alias("status")))
)
