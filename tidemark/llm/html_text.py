"""Main text of web pages by line-block distribution (Chen 2009)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pa_schema, prepare, table

WINDOW = 3  # lines of a block
SURGE = 60  # characters in a window that may start a text
GAP = 2 * WINDOW  # empty lines that stand for a removed element

#: Elements that hold no article text, elements whose content
#: isn't markup, elements inside a line, elements without an end tag.
CHROME = frozenset("nav header footer aside form menu dialog button select option fieldset noscript template iframe "
                   "object svg canvas audio video figure head datalist".split())
RAW = "script|style|textarea|title|xmp|noembed|noframes"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisement|advertising|adbox|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|"
    r"navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-bar|widget|comments?|comment-list|respond|"
    r"disqus|replies|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"social|share|sharing|related(?:[_-](?:posts?|articles?|stories|links?|content|items?|news|pages|products|reading))?|"
    r"recommended|tags?|pagination|pager|skip|toolbar|copyright|disclaimer)(?:$|[_-](?!work|sections?$|body|content$|text$))", re.I)
#: Words of a class that say what a page has, is about or allows, not what an element is.
STATES = re.compile(r"^(?:has|is|no|not|with|without|type|tag|category|cat|status|format|single|postid|page|theme|lang|js)[_-]|"
                    r"[_-](?:enabled|disabled|open|closed|on|off|yes|no|active|allowed|true|false)$", re.I)
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


def _is_chrome(name: str, attributes: str, chrome: frozenset[str] = CHROME) -> bool:
    if name in chrome:
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).strip()
        named = key in ("class", "id") and any(NAMES.search(w) and not STATES.search(w) for w in value.split())
        if (key == "hidden" or named or key == "role" and value.lower() in ROLES
                or key == "aria-hidden" and value.lower() == "true"
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


class _Ends:
    """Which start tags of a page have their end tag, by element name; each
    name's tags are matched once, in one pass."""

    def __init__(self, html: str):
        self.html, self.closed = html, {}

    def has(self, name: str, at: int) -> bool:
        """Whether the element ``name`` whose tag starts at ``at`` is closed."""
        if name not in self.closed:
            open_, closed = [], set()
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", self.html, re.I):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    closed.add(open_.pop())
            self.closed[name] = closed
        return at in self.closed[name]


class _Open:
    """Open elements, innermost last, that know which names they hold."""

    def __init__(self):
        self.names, self.count = [], Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def close(self, name: str) -> None:
        """Close the innermost ``name`` and all inside it."""
        while True:
            last = self.names.pop()
            self.count[last] -= 1
            if last == name:
                return

    def clear(self) -> None:
        self.names.clear()
        self.count.clear()

    def __contains__(self, name: str) -> bool:
        return self.count[name] > 0

    def __bool__(self) -> bool:
        return bool(self.names)


def lines_of(html: str, names: bool = True, chrome: frozenset[str] = CHROME) -> tuple[list[str], list[int], list[int]]:
    """A page without its markup: a line for each block element's text, the
    characters that count for it (none for lines of links outside articles),
    and the number of the outermost article or main element it is in, or 0.
    A removed element and the ends of an article leave GAP empty lines. A
    removed element without end tag ends with its parent, or before an
    article. names: whether elements are removed for their attributes too."""
    lines, sizes, text = [], [], []
    linked = plain = 0
    skip, parents = _Open(), _Open()  # open elements from the removed one on, and around it
    ends, removed = _Ends(html), ("", 0)  # the removed element's name and place
    anchors = main = articles = 0
    inside: list[int] = []

    def gap() -> None:
        lines.extend([""] * GAP)
        sizes.extend([0] * GAP)
        inside.extend([0] * GAP)

    def flush() -> None:
        nonlocal linked, plain
        line = SPACE.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if line:
            lines.append(line)
            sizes.append(len(line) if plain or not linked or main else 0)
            inside.append(articles if main else 0)
        linked = plain = 0

    def words(part: str) -> None:
        nonlocal linked, plain
        if part and not skip:
            text.append(part)
            if not part.isspace():
                linked, plain = linked + bool(anchors), plain + (not anchors)

    at, limit = 0, html.rfind(">") + 1  # no tag ends beyond
    for m in TAG.finditer(html, 0, limit):
        words(html[at:m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            if m["raw"] and not skip:
                text.append(" ")
            continue
        name = name.lower()
        if skip:
            if m["end"]:
                if name in skip:
                    skip.close(name)
                    continue
                if name not in parents:
                    continue
                skip.clear()  # its parent ends
            elif name in ("article", "main", "body"):
                if ends.has(*removed):
                    skip.push(name)
                    continue
                skip.clear()  # the removed element's end is missing
            else:
                if name not in VOID and not m["attributes"].endswith("/"):
                    skip.push(name)
                continue
        if not m["end"] and name not in VOID and _is_chrome(name, m["attributes"] if names else "", chrome):
            flush()
            gap()
            if not m["attributes"].endswith("/"):
                skip.push(name)
                removed = name, m.start()
            continue
        if name == "a":
            anchors = max(0, anchors - 1) if m["end"] else anchors + 1
        if name not in INLINE:
            flush()
            anchors = 0
            if m["end"]:
                if name in parents:
                    parents.close(name)
            elif name not in VOID and name != "p":
                parents.push(name)
        if name in ("article", "main"):
            before, main = main, max(0, main - 1) if m["end"] else main + 1
            if not before or not main:
                gap()
                articles += not before
    if not skip and not (at == limit and at and _unended(m)):
        words(html[at:].partition("<!--")[0])  # a comment there has no end
    flush()
    return lines, sizes, inside


def _unended(m: re.Match) -> bool:
    """Whether a comment or an element without markup has no end."""
    if m["raw"]:
        return re.search(r"</\w+\s*>\Z", m[0]) is None
    return m[0].startswith("<!--") and not m[0].endswith("-->")


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Lines between surge and dive points of the line-block distribution,
    joined by one space.

    The block at a line is the sum of the sizes of the ``window`` lines from
    it on. A text starts where blocks rise from zero, ends where they fall
    back to zero, and is kept if its largest block reaches ``surge`` or it
    is part of an article element with such a text; of a page without any,
    all parts of its articles are kept, or the text with the most
    characters. A page that is empty without the elements removed for their
    attributes is read with them, and then with its forms."""
    for chrome in (CHROME, CHROME - {"form"}):
        for names in (True, False):
            lines, sizes, inside = lines_of(html, names, chrome)
            if any(sizes):
                break
        if any(sizes) or "<form" not in html.lower():
            break
    found, start = [], None
    blocks = [sum(sizes[i:i + window]) for i in range(len(sizes))]
    for i, (size, block) in enumerate(zip(sizes + [0], blocks + [0])):
        if start is None and size:
            start = i
        if start is not None and not block:
            found.append((start, i))
            start = None
    texts = [(max(blocks[a:z]), sum(sizes[a:z]), inside[a], a, z) for a, z in found]
    large = {x[2] for x in texts if x[0] >= surge}
    articles = large - {0} if large else {x[2] for x in texts} - {0}
    kept = [x for x in texts if x[0] >= surge or x[2] in articles] or [max(texts, key=lambda x: x[1])] if texts else []
    return " ".join(line for *_, a, z in kept for line in lines[a:z] if line)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url,
    html). Null and empty html give an empty text; null and repeated ids and
    urls pass through row by row; other columns are ignored; an empty table
    gives no rows."""
    prepare(spark)
    out = "page_id long,url string,text string,n_chars long"
    schema = pa_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, out)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
