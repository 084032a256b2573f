"""HTML extraction: the main text of pages.

Pages whose markup names the article (``article`` or ``main``) give that
element's blocks, without what menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments hold. Removing by repetition
would be wrong there: an article that two pages of a host carry is no boilerplate,
and a menu that only one page has is.

An element counts when the parser opens it: one in a comment or a script names
nothing. Class and id words count as whole names, and not on html, body and what
an article or main element stands in; inside an article (and for reader comments
inside main) they count even so, since an article in an article is a comment.

Pages without such an element go by the host suffix array: the token streams of
a host's pages are concatenated, a suffix array shows token strings of at least
``REPEAT`` tokens that stand on two distinct pages, what they cover is removed
as boilerplate, and the unique runs are kept. A host with many pages is dealt
to cells of about ``CELL`` pages by a hash of the page, so that no task gathers
a whole host; 128-bit hashes of the strings, with the least and the greatest
page over all cells, tell each cell which of its strings stand on two pages of
the host.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed, empty ones go, and the others are joined by \\n.

Defined results: null and empty html give an empty text; unclosed elements end
with their parents; a null url is the host ''. Pages with equal html on one host
and without an article element cover each other and give empty texts (their
own structure doesn't tell what is main); a page alone on its host keeps its
blocks. Rows that repeat a page_id are one page, and so are those without one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of the shortest string that counts as boilerplate, and pages of a cell.
REPEAT, CELL = 8, 256

# Elements of HTML by the role they have here.
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_SKIP = ("head", "nav", "header", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "dialog", "menu", "label", "fieldset", "audio", "video")
_BLOCK = (
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
_MAIN = ("article", "main")
_SKIP_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu")
_SKIP_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "cookie", "cookies", "consent", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "share", "sharing", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
)

_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_COMMENTS = ("comment", "comments", "disqus")
_CLOSES_P = frozenset(_BLOCK) - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


def _dropped(name: str, attributes: str) -> bool:
    """By its element, its role or its being hidden."""
    if name in _SKIP:
        return True
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        if key.lower() == "role" and "".join(values).lower() in _SKIP_ROLES:
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None if attributes else False


def _named(name: str, attributes: str, within: bool) -> set[str]:
    """Its class and id names that are of boilerplate; a header inside the main element is a heading."""
    if not attributes or name in _MAIN or name in ("html", "body"):
        return set()
    names = {w for key, *values in _ATTRIBUTE.findall(attributes) if key.lower() != "role" for w in "".join(values).lower().split()}
    return names.intersection(_SKIP_WORDS) - ({"header"} if within else set())


def opens_main(html: str) -> bool:
    """Whether the parser opens an article or main element, outside comments and raw elements."""
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m.group(2)
        if name is None or m.group(1):
            continue
        name = name.lower()
        if name in _RAW:
            stop = _RAW_END[name].search(html, at)
            at = stop.end() if stop else end
        elif name in _MAIN and not m.group(3).endswith("/"):
            return True
    return False


def blocks(html: str, within_main: bool) -> list[str]:
    """The blocks of the page, or only those inside article or main elements."""
    out: list[str] = []
    held: list[str] = []
    # name, skipped here or above, main here or above, whether the skip is only by names that an article below undoes
    stack: list[tuple[str, bool, bool, bool]] = []

    def close() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            text = m.group(0)
            if text.startswith(("<!", "<?")):
                continue
            skip, main = stack[-1][1:3] if stack else (False, False)
            if not skip and (main or not within_main):
                held.append(text)
            continue
        name = name.lower()
        if m.group(1):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in _BLOCK or depth is not None and any(s[0] in _BLOCK for s in stack[depth:]):
                close()
            if depth is not None:
                del stack[depth:]
            continue
        if name in _RAW:
            stop = _RAW_END[name].search(html, at)
            at = stop.end() if stop else end
            continue
        if name in _BLOCK:
            close()
            if name in _CLOSES_P and any(s[0] == "p" for s in stack):
                depth = max(i for i, s in enumerate(stack) if s[0] == "p")
                del stack[depth:]
            if name in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == name:
                stack.pop()
        if name == "br":
            held.append(" ")
        if name in _VOID or m.group(3).endswith("/"):
            continue
        skip, above, loose = stack[-1][1:] if stack else (False, False, False)
        if name in _MAIN and loose:
            skip = False
        main = above or name in _MAIN or 'role="main"' in m.group(3)
        # a header inside the article is its heading
        dropped = _dropped(name, m.group(3)) and not (name == "header" and main)
        names = _named(name, m.group(3), main)
        if (dropped or names) and not skip:
            close()
        if dropped or names and (names.intersection(_COMMENTS) and above or any(s[0] == "article" for s in stack)):
            loose = False
        elif names:
            loose = loose or not skip
        stack.append((name, skip or dropped or bool(names), main, loose and (skip or bool(names))))
    close()
    return out


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    sink = common.Sink(schema)
    for page, url, html in common.rows(batches):
        if not opens_main(html):
            continue
        text = "\n".join(blocks(html, True))
        if sink.add((page, url, text), 64 + len(text)):
            yield sink.flush()
    yield sink.flush()


def _without_main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not opens_main(html) for html in batch.column(2).to_pylist()], pa.bool_()))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` tokens at least, by doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order, span = np.argsort(rank, kind="stable"), 1
    while span < depth:
        second = np.zeros(n, np.int64)
        second[: max(0, n - span)] = rank[span:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank[order] = np.cumsum(np.concatenate(([1], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if n else 0
        span *= 2
    return order


class Hashes:
    """128-bit hashes of the strings of ``repeat`` tokens of a page, as two columns of 64 bits."""

    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self, repeat: int = REPEAT):
        self.repeat, self.words = repeat, {}

    def _word(self, word: str) -> tuple[int, int]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= 500_000:
                self.words.clear()
            digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            found = self.words[word] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
        return found

    def of(self, words: list[str]) -> np.ndarray:
        n = len(words) - self.repeat + 1
        if n <= 0:
            return np.zeros((0, 2), np.int64)
        each = np.array([self._word(w) for w in words], np.uint64)
        out = np.zeros((n, 2), np.uint64)
        for k in range(self.repeat):
            out = out * self.FACTORS + each[k : k + n]
        return out.view(np.int64)


def unique_runs(pages: list[list[str]], repeat: int = REPEAT, ids: list | None = None, across: set[tuple[int, int]] | None = None) -> list[list[str]]:
    """The blocks of each page without the tokens that strings repeated on distinct pages cover.

    Rows with equal ``ids`` are one page; ``across`` has the hashes of strings that stand on two pages elsewhere.
    """
    first: dict = {}
    same_page = [first.setdefault(i, p) for p, i in enumerate(ids)] if ids else list(range(len(pages)))
    known = Hashes(repeat)
    number: dict[str, int] = {}
    stream, page_of, block_of, words = [], [], [], []
    spread: list[int] = []
    for p, own in enumerate(pages):
        if across:
            hashes = known.of([w for block in own for w in block.split()]).tolist()
            spread += [len(stream) + k for k, h in enumerate(hashes) if tuple(h) in across]
        for b, block in enumerate(own):
            for word in block.split():
                stream.append(number.setdefault(word, len(number)))
                page_of.append(p)
                block_of.append(b)
                words.append(word)
        stream.append(-1 - p)  # an end of its own for each page
        page_of.append(p)
        block_of.append(-1)
        words.append("")
    tokens, page = np.array(stream, np.int64), np.array(page_of, np.int64)
    n = len(tokens)
    gone = np.zeros(n, bool)
    if n > repeat:
        order = suffix_array(tokens, repeat)
        a, b = order[:-1], order[1:]
        same = np.maximum(a, b) + repeat <= n
        for k in range(repeat):
            same &= tokens[np.minimum(a + k, n - 1)] == tokens[np.minimum(b + k, n - 1)]
        # groups of equal strings, and whether they stand on two pages
        group = np.concatenate(([0], np.cumsum(~same)))
        low = np.full(group[-1] + 1, n)
        high = np.full(group[-1] + 1, -1)
        one = np.array(same_page, np.int64)[page[order]]
        np.minimum.at(low, group, one)
        np.maximum.at(high, group, one)
        starts = np.concatenate((order[(low < high)[group]], np.array(spread, np.int64)))
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + repeat, n), -1)
        gone = np.cumsum(edge)[:-1] > 0
    out: list[list[str]] = [[] for _ in pages]
    held: dict[tuple[int, int], list[str]] = {}
    for i in np.flatnonzero(~gone).tolist():
        if block_of[i] >= 0:
            held.setdefault((page_of[i], block_of[i]), []).append(words[i])
    for (p, _), run in held.items():
        out[p].append(" ".join(run))
    return out


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of each page's strings."""
    schema = pa.schema([("host", pa.string()), ("cell", pa.int64()), ("page_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    known = Hashes()
    for host, cell, page, html in common.rows(batches):
        found = np.unique(known.of([w for block in blocks(html, False) for w in block.split()]), axis=0)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            n = len(part)
            columns = [pa.array([host] * n, pa.string()), pa.array([cell] * n, pa.int64()), pa.array([page] * n, pa.int64()), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _across(dealt: DataFrame) -> DataFrame:
    """(host, cell, a, b): the strings of a cell that stand on two pages of its host, for hosts of several cells."""
    found = dealt.where("cells > 1").select("host", "cell", "page_id", "html").mapInArrow(_strings, "host string, cell long, page_id long, a long, b long")
    least = F.min("page_id") < F.max("page_id")
    nameless = F.max(F.col("page_id").isNull()) & F.max(F.col("page_id").isNotNull())
    each = found.groupBy("host", "a", "b").agg((F.coalesce(least, F.lit(False)) | nameless).alias("twice"), F.collect_set("cell").alias("at"))
    return each.where("twice").select("host", F.explode("at").alias("cell"), "a", "b")


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    sink = common.Sink(schema)

    def settle(group: list[tuple], across: set) -> None:
        for (page, url, _), kept in zip(group, unique_runs([g[2] for g in group], ids=[g[0] for g in group], across=across)):
            sink.add((page, url, "\n".join(kept)))

    group, across, last = [], set(), None
    for host, cell, is_page, page, url, html, a, b in common.rows(batches):
        if (host, cell) != last:
            if group:
                settle(group, across)
                yield sink.flush()
            group, across = [], set()
        last = (host, cell)
        if is_page:
            group.append((page, url, blocks(html, False)))
        else:
            across.add((a, b))
    if group:
        settle(group, across)
    yield sink.flush()


_OUT = "page_id long, url string, text string"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row."""
    common.session(pages)
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    # what can't have the element needn't be parsed for it
    named = F.col("html").rlike(r"(?i)<(article|main)")
    by_article = source.where(named).mapInArrow(_articles, _OUT)
    rest = source.where(~named).unionByName(source.where(named).mapInArrow(_without_main, "page_id long, url string, html string"))
    rest = rest.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    sizes = rest.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    dealt = rest.join(sizes, "host").withColumn("cell", F.pmod(F.xxhash64("page_id", "url"), F.col("cells")))
    none = F.lit(None)
    rows = dealt.select("host", "cell", F.lit(True).alias("is_page"), "page_id", "url", "html", none.cast("long").alias("a"), none.cast("long").alias("b"))
    strings = _across(dealt).select("host", "cell", F.lit(False).alias("is_page"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("html"), "a", "b")
    cells = rows.unionByName(strings).repartition("host", "cell").sortWithinPartitions("host", "cell", "is_page", "page_id", "url")
    return by_article.unionByName(cells.mapInArrow(_by_host, _OUT))
