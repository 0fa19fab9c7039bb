"""Main text of web pages by wrappers: union-free regular expressions inferred from a host's pages.

A page's tokens are its tags and texts. Runs of alike sequences fold into repeated groups; what is left is
the page's skeleton. The wrapper of a host starts from one skeleton and is aligned with the others in turn: tokens in both
stay; a text that differs becomes a slot; a group that repeats on one side becomes a repeated group; what only one
side has becomes optional. A host's different skeletons are dealt into parts by their digests; a part's are aligned in the order of the digests, and the
parts' wrappers with each other in the order of the parts, FAN at a time. So no task sees all pages of a large host, copies of a page count once,
and the wrapper depends on the pages only, not on how the rows lie.

A wrapper tells which texts belong to the template: those that stayed constant over a host's pages, and those in optional and repeated
parts that stayed constant wherever the part occurs. Each constant text carries witnesses, digests of different pages that hold it (at most SURE of
them, which is all that is asked). Extraction reads a page in order and leaves out the texts that its host's wrapper
has as template and SURE pages witness, in the article too; where the page has no article element, also those that two pages
witness and none lacks. Left out besides are what is outside the article, if the page has one, elements for navigation, headers, footers,
asides, forms, scripts, styles and hidden parts, and elements whose class, id or role names adverts, notices, sidebars, comments or the like: their texts
vary, so that to a wrapper they are slots as the article's are. A name counts as a whole: `sidebar` and `sidebar-left` do, `has-sidebar` doesn't.

Null and empty html give an empty text. A null url is a host of its own. A host with one page, however often, has no constants to tell;
only the other rules act. Very long pages are read whole, and wrappers keep all items, however many. Repeated rows are rows; other columns pass by. Unclosed and stray tags are taken as browsers do
for paragraphs, list items and cells: a new one ends the last.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from hashlib import md5
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DDL, clear, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile("[a-z0-9]+")

# Elements by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl article section div body select main aside nav".split())
STRUCTURE = BLOCK | RAW | {"head", "body", "title", "button", "select", "option"}
#: Elements whose end a parser supplies.
IMPLIED = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
#: Left out with all they hold.
DROPPED = frozenset("head nav header footer aside form button select input textarea script style noscript iframe template svg canvas object dialog menu title".split())
#: Words of class names, ids and roles that mark what isn't the article.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner promo promotion promoted sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social comment comments disqus replies respond related recommended "
    "recommendations newsletter subscribe subscription signup login search searchbox footer masthead topbar toolbar skip contentinfo complementary".split()
)
#: Words that such names are joined with, as in sidebar-left or site-footer.
BESIDE = frozenset("site page top bottom left right box bar area section wrapper wrap container inner block slot unit link links button buttons icon icons item items list global primary secondary post posts articles stories form panel column col region".split())
HEADERS = frozenset({"header", "banner"})
MAIN = frozenset({"article", "main"})


def marks(attributes: str) -> set[str]:
    """An element's class names, ids and roles, lower-cased."""
    if "=" not in attributes:
        return set()
    return {w for m in NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}


def names(words: set[str], kinds: frozenset[str]) -> bool:
    """Whether one of the names is of the kinds: itself, or joined of such words and words of BESIDE."""
    for name in words:
        if name in kinds:
            return True
        parts = WORD.findall(name)
        if any(x in kinds for x in parts) and all(x in kinds or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('start', name, attributes), ('end', name, ''), ('text', text, ''). Raw elements' content isn't given."""
    at, low = 0, None
    while m := TOKEN.match(html, at):
        at = m.end()
        if m[4] is not None:
            yield "text", m[4], ""
        elif m[2] is not None:
            name = m[2].lower()
            yield ("end" if m[1] else "start"), name, m[3] or ""
            if not m[1] and name in RAW:
                low = html.lower() if low is None or len(low) != len(html) else low
                end = low.find(f"</{name}", at) if len(low) == len(html) else html.find(f"</{name}", at)
                at = len(html) if end < 0 else end


class Open:
    """The open elements, each with whether it is left out and whether it is in the article."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []

    def top(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._end_last({"p"})
        if name in CLOSES:
            self._end_last(CLOSES[name])
        out, inside = self.top()
        if name in VOID:
            return
        words = marks(attributes)
        in_article = inside or name in MAIN or "main" in words and name == "div"
        if not out:
            out = name in DROPPED and not (name == "header" and inside)
            out = out or bool(words) and name not in ("html", "body", "article", "main") and names(words, CHROME if inside else CHROME | HEADERS)
            out = out or "hidden" in attributes and bool(HIDDEN.search(attributes)) or "none" in attributes and bool(HIDDEN.search(attributes))
        self.stack.append((name, out, in_article))

    def _end_last(self, names: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                del self.stack[k:]
                return
            if self.stack[k][0] in SCOPES:
                return

    def end(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return


def blocks(html: str) -> list[tuple[str, bool]]:
    """The page's blocks in order, without what is left out: (text, in the article)."""
    state, out, held, held_in = Open(), [], [], False

    def flush() -> None:
        nonlocal held_in
        if text := " ".join("".join(held).split()):
            out.append((text, held_in))
        held.clear()
        held_in = False

    for kind, name, attributes in tokens(html):
        if kind == "text":
            left_out, inside = state.top()
            if not left_out:
                held.append(unescape(name))
                held_in = held_in or inside
        elif name == "br":
            held.append(" ")
        else:
            if name in BLOCK:
                flush()
            if kind == "start":
                state.start(name, attributes)
            else:
                state.end(name)
    flush()
    return out


def main_text(html: str | None, template: frozenset[str] = frozenset(), sure: frozenset[str] = frozenset()) -> str:
    """template: constants of the host's pages, for a page without an article; sure: those that many pages witness, for any page."""
    found = blocks(html or "")
    if any(inside for _, inside in found):
        found, template = [b for b in found if b[1]], frozenset()
    if template or sure:
        found = [b for b in found if (own := mark(b[0])) not in template and own not in sure]
    return "\n\n".join(text for text, _ in found)


#: Different pages that have to witness a constant text before it is taken out of an article, or out of an optional or repeated part.
SURE = 8

# Wrappers. An item is ["tag", name and classes], ["text", mark, witnesses], ["text", null] (a slot), ["some", items] (once or more) or ["maybe", items].
# Neighbouring optional items of a wrapper are one optional item that holds them.


def mark(text: str) -> str:
    """A text's digest; spaces don't count, as inline elements may part words or not."""
    return md5("".join(text.split()).encode()).hexdigest()[:12]


def shape(item: list) -> str:
    """What has to agree for two items to be aligned: all but the texts."""
    if item[0] == "text":
        return "#"
    return f"{item[0][0]}:{item[1]}" if item[0] == "tag" else f"{item[0][0]}({' '.join(shape(x) for x in item[1])})"


def merged(a: list, b: list) -> list:
    """An item for two of the same shape."""
    if a[0] == "text":
        if a[1] is None or a[1] != b[1]:
            return ["text", None]
        return a if a[2] == b[2] else ["text", a[1], sorted({*a[2], *b[2]})[:SURE]]
    return a if a[0] == "tag" else [a[0], [merged(x, y) for x, y in zip(a[1], b[1])]]


def folded(items: list[list], longest: int = 12) -> list[list]:
    """Two or more alike sequences in a row, of up to `longest` items, as one repeated group; short ones first. None begins with a text, which belongs to the tag before."""
    for size in range(1, longest + 1):
        shapes, out, k = [shape(x) for x in items], [], 0
        while k < len(items):
            n = 1
            while shapes[k + n * size : k + (n + 1) * size] == shapes[k : k + size] and k + (n + 1) * size <= len(items):
                n += 1
            if n > 1 and items[k][0] != "text" and not (size == 1 and items[k][0] != "tag"):
                group = items[k : k + size]
                for r in range(1, n):
                    group = [merged(x, y) for x, y in zip(group, items[k + r * size : k + (r + 1) * size])]
                out.append(["some", group])
                k += n * size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def classes(attributes: str) -> list[str]:
    """An element's class names in order, without those that have digits, which often number the page."""
    found = CLASS.search(attributes) if "class" in attributes.lower() else None
    return sorted({c for c in (found[1] or found[2] or found[3] or "").split() if not any(map(str.isdigit, c))}) if found else []


def skeleton(html: str) -> list[list]:
    """The page's block elements with their classes, and texts. Inline elements are part of their text; ends that can be implied are left out."""
    items: list[list] = []
    own: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            own.append(mark(text))
            items.append(["text", own[-1], page])
        held.clear()

    page: list[int] = []  # the one witness, known when all texts are
    for kind, name, attributes in tokens(html):
        if kind == "text":
            held.append(unescape(name))
        elif name in STRUCTURE:
            flush()
            if kind == "start":
                items.append(["tag", ".".join([name, *classes(attributes)])])
            elif name not in IMPLIED:
                items.append(["tag", f"/{name}"])
        else:
            held.append(" ")
    flush()
    page.append(int(md5(" ".join(own).encode()).hexdigest()[:12], 16))
    return folded(items)


def inner(item: list) -> list[list]:
    return item[1] if item[0] in ("some", "maybe") else [item]


def core(item: list) -> str:
    return " ".join(map(shape, inner(item)))


def grouped(items: list[list], other: list[list]) -> list[list]:
    """items with each sequence that is a repeated group of the other side as such a group, if it occurs once."""
    shapes, done = list(map(shape, items)), set()
    for group in [x[1] for x in other if x[0] == "some"]:
        size, wanted, out, k = len(group), list(map(shape, group)), [], 0
        if tuple(wanted) in done or not set(wanted) <= set(shapes):
            continue
        done.add(tuple(wanted))
        while k < len(items):
            if shapes[k] == wanted[0] and shapes[k : k + size] == wanted:
                out.append(["some", items[k : k + size]])
                k += size
            else:
                out.append(items[k])
                k += 1
        if len(out) < len(items) or size == 1:
            items, shapes = out, list(map(shape, out))
    return items


#: Pairs of items up to which difflib is the faster way to the same blocks.
NARROW = 10_000


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of equal runs, in order: the longest first, by its place in a and then in b, and so on to its left and right.

    These are the blocks of difflib's SequenceMatcher without junk, which gives them for narrow wrappers. Of a window's runs of the greatest
    length those that it would find one by one come in one pass from the left here; what lies between has shorter ones only. So wide
    wrappers don't take cubic time.
    """
    if len(a) * len(b) <= NARROW:
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
    numbers: dict[str, int] = {}
    n, total = len(a), len(a) + len(b)
    ranks = [np.array([numbers.setdefault(x, len(numbers)) for x in [*a, *b]], np.int64)]  # by k: numbers of the runs of 2**k items

    def runs(size: int, low: int, high: int) -> np.ndarray:
        """Numbers of the runs of so many items that lie in a window."""
        k = size.bit_length() - 1
        while len(ranks) <= k:
            half = 1 << len(ranks) - 1
            ranks.append(np.unique(ranks[-1][:-half] * total + ranks[-1][half:], return_inverse=True)[1])
        end = high - size + 1
        shift = size - (1 << k)
        return ranks[k][low:end] * total + ranks[k][low + shift : end + shift]

    found: list[tuple[int, int, int]] = []
    windows = [(0, n, n, total, total)]
    while windows:
        i, end, j, last, most = windows.pop()
        size, most = 0, min(most, end - i, last - j)
        while size < most:
            middle = (size + most + 1) // 2
            if np.isin(runs(middle, i, end), runs(middle, j, last)).any():
                size = middle
            else:
                most = middle - 1
        if not size:
            continue
        own, theirs = runs(size, i, end), runs(size, j, last)
        places: dict[int, list[int]] = {}
        for q, x in enumerate(theirs.tolist(), j):
            places.setdefault(x, []).append(q)
        start = i
        for p in np.flatnonzero(np.isin(own, theirs)).tolist():
            at = places[int(own[p])]
            if start + p >= i and (q := bisect_left(at, j)) < len(at):
                found.append((start + p, at[q] - n, size))
                windows.append((i, start + p, j, at[q], size - 1))
                i, j = start + p + size, at[q] + size
        windows.append((i, end, j, last, size - 1))
    return sorted(found)


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers: what one of them lacks or has otherwise is constant no more; nothing is left out, however wide they are."""
    a, b = apart(a), apart(b)
    sa, sb = list(map(core, a)), list(map(core, b))
    if sa != sb:
        a, b = grouped(a, b), grouped(b, a)
        sa, sb = list(map(core, a)), list(map(core, b))
    out: list[list] = []
    i = k = 0
    for j, m, n in [(0, 0, len(a))] if sa == sb else [*matching(sa, sb), (len(a), len(b), 0)]:
        for x in a[i:j] + b[k:m]:
            out.append(x if x[0] == "maybe" else ["maybe", inner(x)])
        i, k = j + n, m + n
        for x, y in zip(a[j:i], b[m:k]):
            kinds = {x[0], y[0]}
            both = [merged(p, q) for p, q in zip(inner(x), inner(y))]
            # missing in an earlier page: still optional; once on one side and repeated on the other: repeated
            out += [["maybe", both]] if "maybe" in kinds else [["some", both]] if "some" in kinds else both
    return together(out)


def together(items: list[list]) -> list[list]:
    """Neighbouring optional items as one optional item that holds them all. What is left beside isn't optional, so it is in every page."""
    out: list[list] = []
    run: list[list] = []
    for x in [*items, None]:
        if x is not None and x[0] == "maybe":
            run.append(x)
            continue
        if run:
            out.append(run[0] if len(run) == 1 else ["maybe", run])
            run = []
        if x is not None:
            out.append(x)
    return out


def apart(items: list[list]) -> list[list]:
    """The optional items that together() has joined, one by one again."""
    return [y for x in items for y in (x[1] if x[0] == "maybe" and x[1][0][0] == "maybe" else [x])]


def constants(items: list[list]) -> set[str]:
    """Marks of the texts that stayed constant over different pages, in what is neither optional nor repeated."""
    return {x[1] for x in items if x[0] == "text" and x[1] and len(x[2]) > 1}


def sure_constants(items: list[list]) -> set[str]:
    """Marks of the texts that stayed constant wherever their part occurs, and that SURE different pages witness."""
    return {m for x in items for m in (sure_constants(x[1]) if x[0] in ("some", "maybe") else [x[1]] if x[0] == "text" and x[1] and len(x[2]) >= SURE else [])}


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


#: Wrappers' marks that a task keeps, and digests of skeletons that it remembers having given on.
HELD = 2000
SEEN = 200_000
#: Wrappers that a task aligns at once, in rounds; skeletons that a first part is to hold at the most if all pages are one host's.
FAN = 32
PART = 20_000


def parts_of(n_pages: int) -> int:
    """Parts of a host: a power of FAN, by the number of all pages."""
    parts = FAN
    while parts * PART < n_pages:
        parts *= FAN
    return parts


def skeletons(pages: DataFrame, parts: int) -> DataFrame:
    """host, part, digest, wrapper (JSON) of the different skeletons. A task gives each on once, as far as it remembers."""
    target = DDL("host string, part long, digest string, wrapper string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                wrapper = json.dumps(skeleton(html.as_py() or ""), separators=(",", ":"))
                digest = md5(wrapper.encode()).hexdigest()
                if (host, digest) not in seen:
                    seen.add((host, digest))
                    out.append((host, int(digest[:12], 16) % parts, digest, wrapper))
            if len(seen) > SEEN:
                seen.clear()
            if out:
                yield target.batch(list(zip(*out)))

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, part long, digest string, wrapper string")


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), n_pages (different ones), and the template's texts by mark: template, sure."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.drop_duplicates("digest").sort_values("digest")
        whole = None
        for w in map(json.loads, own["wrapper"]):
            whole = w if whole is None else aligned(whole, w)
        n = int(own["n"].sum())
        return pd.DataFrame({"host": [key[0]], "part": [key[1]], "digest": [f"{key[1]:020d}"], "wrapper": [json.dumps(whole, separators=(",", ":"))], "n": [n]})

    parts = parts_of(pages.count())
    wrappers = skeletons(pages, parts).withColumn("n", F.lit(1).cast("long"))
    while parts:
        wrappers = wrappers.groupBy("host", "part").applyInPandas(merge, "host string, part long, digest string, wrapper string, n long")
        wrappers, parts = wrappers.withColumn("part", F.floor(F.col("part") / FAN).cast("long")), parts // FAN

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = DDL("host string, wrapper string, n_pages long, template string, sure string")
        for batch in batches:
            items = [json.loads(w) for w in batch.column(1).to_pylist()]
            yield target.batch([batch.column(0), batch.column(1), batch.column(2), [" ".join(sorted(constants(x))) for x in items], [" ".join(sorted(sure_constants(x))) for x in items]])

    return wrappers.select("host", "wrapper", "n").mapInArrow(told, "host string, wrapper string, n_pages long, template string, sure string")


def extracted(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `text`, the main text of every page; a column `text` among the keys gives way."""
    keys = [k for k in keys if k != "text"]
    p = clear(pages)
    # The marks grow with the number of hosts: joined, not broadcast; a large host's pages are a skewed join.
    told = host_wrappers(pages).select(F.col("host").alias(f"{p}host"), F.col("template").alias(f"{p}template"), F.col("sure").alias(f"{p}sure"))
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k].replace('bigint', 'long')}" for k in keys), "text string"])
    target = DDL(schema)
    rows = pages.select("*", host_of("url").alias(f"{p}host")).join(told, f"{p}host", "left").select("html", f"{p}template", f"{p}sure", *[F.col(k).alias(f"{p}{i}") for i, k in enumerate(keys)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[frozenset[str], frozenset[str]]] = {}
        for batch in batches:
            texts = []
            for html, *own in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if tuple(own) not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[tuple(own)] = tuple(frozenset((x or "").split()) for x in own)
                texts.append(main_text(html.as_py(), *known[tuple(own)]))
            yield target.batch([*(c.to_pylist() for c in batch.columns[3:]), texts])

    return rows.mapInArrow(run, schema)


def op10_wrapper_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
