"""The link graph of crawled pages, and what a crawl may fetch next."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import links
from ..functions.text import canonical, crawlable, host, joined_url, page_file, slug


class Fetcher(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame:
        """url, html of the pages that could be read."""


class TableFetcher:
    """Stands in for a browser: a table of pages (url, html)."""

    def __init__(self, pages: DataFrame) -> None:
        self.pages = pages

    def fetch(self, urls: DataFrame) -> DataFrame:
        return self.pages.join(urls.select("url"), "url", "left_semi").select("url", "html")


def internal_links(pages: DataFrame) -> DataFrame:
    """page_id, url, link, pos: distinct links of a page to its own host, by first place."""
    each = pages.select("page_id", "url", F.posexplode(links(F.col("html"))).alias("at", "href")).withColumn("link", joined_url(F.col("url"), F.col("href")))
    own = each.where(host(F.col("link")) == host(F.col("url")))
    return own.groupBy("page_id", "url", "link").agg(F.min("at").cast("long").alias("pos"))


def unseen(urls: DataFrame, known: DataFrame) -> DataFrame:
    """urls (url) that aren't in known (url)."""
    return urls.join(known.select("url"), "url", "left_anti")


def depths(seeds: DataFrame, edges: DataFrame, most: int = 10, pages: int | None = None) -> DataFrame:
    """url, depth of the least depth at which each URL is reached from seeds (url, depth) over edges (src, dst), up to depth `most`.

    A round is a join with the frontier; rounds are checkpointed, and are `most` in number at the most. `pages` caps the crawl in
    order of depth and url, as a crawler's budget does.
    """
    from ..plans.session import checkpointed

    own = edges.where(crawlable(F.col("dst"))).select(F.col("src").alias("url"), canonical(F.col("dst")).alias("next")).distinct()
    visited = checkpointed(seeds.where(F.col("depth") <= most).groupBy("url").agg(F.min("depth").alias("depth")))
    for depth in range(most):
        frontier = visited.where(F.col("depth") == depth).select("url")
        found = frontier.join(own, "url").select(F.col("next").alias("url")).distinct().withColumn("depth", F.lit(depth + 1).cast(visited.schema["depth"].dataType))
        grown = checkpointed(visited.unionByName(found).groupBy("url").agg(F.min("depth").alias("depth")))
        if grown.where(F.col("depth") > depth).isEmpty():
            return _first(grown, pages)
        visited = grown
    return _first(visited, pages)


def sitemap_pages(maps: DataFrame, fetch: Callable[[DataFrame], DataFrame], most: int = 5) -> DataFrame:
    """loc of the pages of sitemaps (url, xml) and of the maps that they name, down to `most` levels. fetch takes urls (url) and gives maps (url, xml)."""
    from ..plans.session import checkpointed

    pages, seen = None, maps.select("url")
    for _ in range(most):
        entries = checkpointed(sitemap_urls(maps))
        own = entries.where("kind = 'page'").select("loc")
        pages = own if pages is None else pages.unionByName(own)
        nested = unseen(entries.where("kind = 'map'").select(F.col("loc").alias("url")), seen)
        if nested.isEmpty():
            break
        seen, maps = seen.unionByName(nested), checkpointed(fetch(nested))
    return pages.distinct()


def crawled(seeds: DataFrame, fetcher: Fetcher, most: int = 10) -> DataFrame:
    """url, depth, html of the pages that are reached from seeds (url, depth): each round fetches the frontier and follows its links within their hosts."""
    from ..plans.session import checkpointed

    frontier = seeds.where(crawlable(F.col("url"))).select(canonical(F.col("url")).alias("url"), "depth").groupBy("url").agg(F.min("depth").alias("depth"))
    found = None
    for depth in range(most + 1):
        now = frontier.where(F.col("depth") <= depth)
        got = checkpointed(fetcher.fetch(now.select("url")).join(now, "url").select("url", "depth", "html"))
        found = got if found is None else checkpointed(found.unionByName(got))
        linked = internal_links(got.withColumn("page_id", F.col("url"))).where(crawlable(F.col("link"))).select(canonical(F.col("link")).alias("url")).distinct().withColumn("depth", F.lit(depth + 1).cast(seeds.schema["depth"].dataType))
        later = frontier.where(F.col("depth") > depth).unionByName(linked).groupBy("url").agg(F.min("depth").alias("depth"))
        frontier = checkpointed(unseen(later, found))
        if frontier.isEmpty():
            break
    return found


def _first(visited: DataFrame, pages: int | None) -> DataFrame:
    return visited if pages is None else visited.orderBy("depth", "url").limit(pages)


def page_files(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """pages (url and more) with `file`, the first generation's name: the slug's first 80 characters for the first page that has them, 70 and the page's key for all others."""
    own = pages.withColumn("_short", F.substring(slug(F.col("url")), 1, 80))
    first = own.groupBy("_short").agg(F.min(order).alias("_first"))  # summed up before it is dealt out, so that one slug of many pages is a row a task
    alone = F.concat("_short", F.lit(".json"))
    return own.join(first, "_short").withColumn("file", F.when(F.col(order) == F.col("_first"), alone).otherwise(page_file(F.col("url")))).drop("_short", "_first")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) that robots rules (host, path, allow) let through: the longest matching path decides, allow before disallow."""
    own = urls.withColumn("_host", host(F.col("url"))).withColumn("_path", F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1))
    hits = own.join(rules.withColumnRenamed("host", "_host"), "_host").where(F.col("path") != "").where(F.expr("startswith(_path, path)"))
    verdict = hits.groupBy("url").agg(F.max(F.struct(F.length("path").alias("n"), F.col("allow"))).alias("v"))
    return urls.join(verdict.where(~F.col("v.allow")).select("url"), "url", "left_anti")


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """host, path, allow: the rules for an agent in robots files (host, txt), for allowed().

    Comments and lines without a known name are passed over. Agent lines on end begin a group that all rules up to the next agent line belong to; groups of one agent add up.
    The agent's rules are those of the longest agent name that its own begins with, in any case of letters, or else those of *. A rule without a path, which
    allows all, is left out. A host whose file has no group for the agent has no rules.
    """
    each = files.select("host", F.posexplode(F.split(F.coalesce("txt", F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    plain = F.regexp_replace("line", "#.*$", "")
    known = each.select("host", "pos", F.lower(F.trim(F.regexp_extract(plain, "^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(plain, "^[^:]*:(.*)$", 1)).alias("value"))
    known = known.where("name in ('user-agent', 'allow', 'disallow')").withColumn("is_agent", F.col("name") == "user-agent")
    order = Window.partitionBy("host").orderBy("pos")
    begins = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False))
    grouped = known.withColumn("group", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("is_agent").select("host", "group", F.lower("value").alias("agent")).where((F.col("agent") == "*") | ((F.col("agent") != "") & F.startswith(F.lit(agent.lower()), F.col("agent"))))
    weight = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    own = agents.withColumn("w", weight).withColumn("best", F.max("w").over(Window.partitionBy("host"))).where("w = best").select("host", "group").distinct()
    rules = grouped.where(~F.col("is_agent") & (F.col("value") != "")).join(own, ["host", "group"])
    return rules.select("host", F.col("value").alias("path"), (F.col("name") == "allow").alias("allow")).distinct()


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """kind ('page' or 'map') and loc of the entries of sitemaps (url, xml); only those on the sitemap's own host."""
    is_index = F.contains(F.col("xml"), F.lit("<sitemapindex"))
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    each = maps.select("url", F.when(is_index, "map").otherwise("page").alias("kind"), F.explode(locs).alias("loc"))
    return each.where(host(F.col("loc")) == host(F.col("url"))).select("kind", "loc").distinct()
