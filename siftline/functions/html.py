"""Page parts from HTML that a pattern tells, as columns. Parts that need to know what lies in what are in operators.markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import EMAIL, NOISE_TAGS, PHONE
from .text import found, joined_url, tag_text, unescaped


def stripped(html: Column) -> Column:
    """html without the noise elements that tags tell."""
    for tag in NOISE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return html


def title(html: Column) -> Column:
    return tag_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def h1(html: Column) -> Column:
    """The first h1, or the title if there is none."""
    return F.coalesce(F.nullif(tag_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")), title(html))


def visible(html: Column) -> Column:
    """Text without noise elements, head and tags."""
    return tag_text(F.regexp_replace(F.regexp_replace(stripped(html), r"(?is)<head\b.*?</head>", ""), r"(?s)<!--.*?-->", ""))


#: Ends of blocks, which part paragraphs, and of lines.
PARAGRAPH_END, LINE_END = r"(?i)</?(?:p|div|h[1-6]|section|article|ul|ol|table|blockquote|main|pre)\b[^>]*>", r"(?i)<(?:br|/li|/tr|/dt|/dd)\b[^>]*>"


def visible_lines(html: Column) -> Column:
    """Text without noise elements and head, in lines as a browser shows it; blank lines part paragraphs."""
    kept = F.regexp_replace(F.regexp_replace(stripped(html), r"(?is)<head\b.*?</head>", ""), r"(?s)<!--.*?-->", "")
    broken = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", " "), PARAGRAPH_END, "\n\n"), LINE_END, "\n")
    text = F.regexp_replace(unescaped(F.regexp_replace(broken, "<[^>]*>", "")), r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def description(html: Column, part: bool = False) -> Column:
    """The content of the first meta element named description, or with that in its name (`part`, the first generation's rule); empty if there is none."""
    rest = "[^\"']*" if part else ""
    element = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*?\bname\s*=\s*["']{rest}description{rest}["'][^>]*>""", 0)
    return F.trim(unescaped(F.regexp_extract(element, r"""(?is)\bcontent\s*=\s*"([^"]*)\"""", 1)))


FAQ_PAGE = "`@type` string, mainEntity array<struct<name:string,acceptedAnswer:struct<text:string>>>"


def faq_jsonld(html: Column) -> Column:
    """(question, answer) of the FAQ pages in JSON-LD: 30 at most, answers to 1000 characters, which may be empty."""
    scripts = found(html, r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    pages = F.filter(F.transform(scripts, lambda x: F.from_json(x, FAQ_PAGE)), lambda x: x["@type"] == "FAQPage")
    items = F.filter(F.flatten(F.transform(pages, lambda x: F.coalesce(x["mainEntity"], F.array().cast("array<struct<name:string,acceptedAnswer:struct<text:string>>>")))), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    return F.slice(F.transform(items, lambda x: F.struct(x["name"].alias("question"), F.substring(F.coalesce(x["acceptedAnswer"]["text"], F.lit("")), 1, 1000).alias("answer"))), 1, 30)


def contact_links(html: Column, url: Column, most: int = 3) -> Column:
    """Distinct link targets with `contact` in them, resolved, by first place."""
    own = F.filter(F.transform(found(html, r"""(?is)<a\s[^>]*?href\s*=\s*"([^"]*)\"""", 1), lambda x: F.trim(x)), lambda x: F.contains(F.lower(x), F.lit("contact")))
    return F.slice(F.array_distinct(F.transform(own, lambda x: joined_url(url, x))), 1, most)


def headings(html: Column) -> Column:
    """(level, text) of h1 to h6 in order: texts of over 2 characters, the first of equal ones."""
    whole = F.transform(found(html, r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), lambda x: F.struct(F.lower(F.substring(x, 2, 2)).alias("level"), tag_text(x).alias("text")))
    long = F.filter(whole, lambda x: F.length(x["text"]) > 2)
    texts = F.transform(long, lambda x: x["text"])
    return F.filter(long, lambda x, i: F.array_position(texts, x["text"]) == i + 1)


def links(html: Column) -> Column:
    """Link targets in order, without mail, telephone and fragments."""
    every = F.transform(found(html, r"""(?is)<a\s[^>]*?href\s*=\s*"([^"]*)\"""", 1), lambda x: F.trim(x))
    return F.filter(every, lambda x: ~x.rlike("^(mailto:|tel:|#)"))


def contacts(text: Column, most: int = 5) -> Column:
    """E-mail addresses and telephone numbers: distinct, by first place."""
    return F.struct(
        F.slice(F.array_distinct(found(text, EMAIL)), 1, most).alias("email"),
        F.slice(F.array_distinct(found(text, PHONE)), 1, most).alias("phone"),
    )
