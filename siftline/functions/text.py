"""Columns from text and URL columns. All of them stay in the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .lexicon import words

#: Runs of ASCII letters and digits and of all other non-ASCII characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def terms(text: Column) -> Column:
    """Index terms: runs of letters and digits, ASCII capitals lowered."""
    return found(F.translate(text, UPPER, LOWER), TERM)


def cleaned(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    return found(F.lower(text), "[a-z]{2,}")


def without(values: Column, stop: list[str]) -> Column:
    return F.filter(values, lambda x: ~F.array_contains(words(stop), x))


def synonyms(values: Column, mapping: dict[str, str] = lexicon.SYNONYMS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(values, lambda x: F.coalesce(table[x], x))


def rounded(value: Column, places: int) -> Column:
    """Half up by plain arithmetic, which is alike in other engines."""
    return F.floor(value * 10.0**places + 0.5) / 10.0**places


def rounded_exactly(value: Column, places: int) -> Column:
    """The nearest decimal by the exact binary value, of two equally near the even one; for values from 0 to 2^16 and 2 places at most.

    The value is parted into a multiple of 2^-26 and the rest, so that twice its hundredfold and the odd number in the middle of its neighbours differ exactly.
    """
    scale, k = 10.0**places, F.floor(value * 10.0**places).cast("double")
    upper = F.floor(value * 2.0**26) / 2.0**26
    beyond = (upper * (2 * scale) - (k * 2 + 1)) + (value - upper) * (2 * scale)
    up = (beyond > 0) | ((beyond == 0) & (k % 2 == 1))
    return (k + up.cast("double")) / scale


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def whole_word(text: Column, term: str) -> Column:
    """Whether a term of letters, digits and spaces occurs as whole words. Other terms would need to be escaped and aren't taken."""
    if not all(c.isalnum() or c == " " for c in term):
        raise ValueError(f"not a plain term: {term!r}")
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){term}([^\p{{L}}\p{{N}}_]|$)")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)


def slug(url: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(path(url)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "home").otherwise(made)


def page_key(url: Column) -> Column:
    return F.concat(F.lit("page_"), F.substring(F.md5(url), 1, 8))


def page_file(url: Column, most: int = 70) -> Column:
    return F.concat(F.substring(slug(url), 1, most), F.lit("_"), page_key(url), F.lit(".json"))


def page_type(url: Column, rules: list | None = None) -> Column:
    """The first rule's label that fits the path. Without rules given, a path that fits none is `home` if it has one slash at most."""
    default = F.lit("general") if rules else F.when(F.regexp_count(path(url), F.lit("/")) > 1, "general").otherwise("home")
    return lexicon.case_contains(F.lower(path(url)), rules or lexicon.PAGE_TYPES, default, swapped=True)


def canonical(url: Column) -> Column:
    """Without the fragment; without the whole query if it has trackers."""
    plain = F.regexp_replace(url, "#.*$", "")
    return F.when(plain.rlike(r"[?&]utm_|\?ref="), F.regexp_replace(plain, r"\?.*$", "")).otherwise(plain)


def crawlable(url: Column, domain: Column | None = None) -> Column:
    skipped = F.lower(path(url)).rlike(r"\.(" + "|".join(lexicon.SKIPPED_EXTENSIONS) + ")$")
    good = url.rlike("^https?://[^/?#]+") & ~skipped
    return good if domain is None else good & (host(url) == domain)


def joined_url(base: Column, link: Column) -> Column:
    """An absolute URL for a link found at base, without its fragment. Dot segments stay."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    origin = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path(base), link))
        .when(link == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(origin, folder, link))
    )


def section_type(name: Column) -> Column:
    return lexicon.case_contains(F.lower(name), lexicon.SECTION_TYPES, "general")


def priority(kind: Column, n_words: Column, has_faq: bool = False) -> Column:
    boosts = F.create_map(*[F.lit(x) for pair in lexicon.TYPE_BOOSTS.items() for x in pair])
    length = F.least(n_words / 700.0, F.lit(1.0)) * 0.15
    return rounded_exactly(F.least(0.5 + F.coalesce(boosts[kind], F.lit(0.0)) + length + (0.1 if has_faq else 0.0), F.lit(1.0)), 2)


def display_name(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def entities(text: Column) -> Column:
    """Runs of capitalised words in order, then acronyms of 2 to 6 letters in order; the first 20 distinct ones."""
    runs = found(F.regexp_replace(text, "[À-ÖØ-öø-ɏ]", "_"), r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b")
    acronyms = F.filter(found(text, r"[\p{L}\p{M}\p{N}_]+"), lambda x: x.rlike("^[A-Z]{2,6}$"))
    return F.slice(F.array_distinct(F.concat(runs, acronyms)), 1, 20)


def faq_like(query: Column) -> Column:
    return cleaned(query).rlike(rf"(?i)^\s*({lexicon.FAQ_OPENERS})")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


#: A character reference, by name or by number. One without its semicolon is ordinary text.
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: What names stand for, by the whole reference: those of HTML 4 and the apostrophe. A no-break space is a blank here, as white space collapses.
NAMED = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'", "&nbsp;": " "}
#: Numbers that stand for another character: those of the old Windows page, the no-break space, and null.
RENUMBERED = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)} | {0xA0: " ", 0: "\ufffd"}


def referred(reference: Column) -> Column:
    """The character of a reference; a name that isn't known stays as it is, a number that is no character becomes U+FFFD."""
    known = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    digits = F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    by_number = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.when(F.startswith(reference, F.lit("&#")), F.coalesce(F.try_element_at(known(RENUMBERED), code), by_number)).otherwise(F.coalesce(F.try_element_at(known(NAMED), reference), reference))


def unescaped(text: Column) -> Column:
    """text with its character references decoded, each once: what stands between them, and their characters, put together again."""
    whole = lambda t: F.array_join(F.zip_with(F.split(t, REFERENCE, -1), found(t, REFERENCE), lambda a, r: F.concat(a, F.coalesce(referred(r), F.lit("")))), "")
    # As an element of an array the text is worked out once for its uses.
    return F.get(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t)), F.lit(0))


def tag_text(html: Column) -> Column:
    """Text of a piece of HTML: tags become blanks, white space collapses."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))
