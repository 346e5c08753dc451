"""Main text of web pages by tag-path ratios.

Each text block has a path of block-level tags (with classes) from the root. Over a page, text
length and punctuation are aggregated by path: characters a node and punctuation marks a node.
The ratios, laid over the page's sequence of nodes, are smoothed with their neighbours, fused
into one value (a geometric mean of both, less what is link text) and averaged back to the
path; paths within a share of the best one are content. What elements, roles and names say about a path
is a prior that its value is multiplied with: AWAY for what calls itself a menu, header, footer, sidebar, notice,
advert, form or comment, OUTSIDE for what stands beside the article of a page that marks one. Blocks that
stand in the same container as content (headings, short paragraphs, lists) belong to it, if nothing speaks against
them. Scripts, styles and other elements without text are never read. Paths are nodes of a tree, so the cost
is linear in the page, however deep it nests.

Rows: null or empty html gives an empty text; unclosed and stray tags are tolerated; null urls
and ids and repeated rows are carried along; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import read_table

# Elements of HTML, and names that pages give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NEVER = frozenset("script style noscript template head title select textarea option iframe object svg canvas audio video map math".split())
BESIDE = frozenset("nav header footer aside form button dialog menu".split())
CONTAINERS = frozenset("div article main section body td".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div article section main body blockquote td th".split())
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|menu\w*|nav\w*|navigation|breadcrumbs?|sidebar\w*|side|widget\w*|header|masthead|footer|foot|comments?|comment-?list|disqus\w*|repl(?:y|ies)|respond|"
    r"cookies?\w*|consent\w*|gdpr|notices?|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|toolbar|pagination|pager|skip-?link\w*|legal|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = re.compile(r"[.,;:!?…。，、！？；：»«”“]")
#: Paths with this share of the best fused value are content.
SHARE = 0.3
#: Priors of paths that call themselves something else, and of those beside a marked article.
AWAY, OUTSIDE = 0.02, 0.1
#: Weights of a node's own value and its neighbours' in the smoothing.
KERNEL = (0.25, 0.5, 0.25)


class _Open(NamedTuple):
    """An open element; path: its node in the tree of paths."""

    tag: str
    path: int
    never: bool
    away: bool
    article: bool


class _Path(NamedTuple):
    """container: the path of the nearest element that holds blocks, itself included."""

    parent: int
    container: int
    away: bool
    article: bool


class Block(NamedTuple):
    path: int
    text: str
    linked: int


ROOT = _Open("", 0, False, False, False)


class _Blocks(HTMLParser):
    """The page's text blocks in order, and the tree of their paths."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = [ROOT]
        self.count: Counter[str] = Counter()
        self.paths: list[_Path] = [_Path(0, 0, False, False)]
        self.names: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.blocks.append(Block(self.stack[-1].path, text, self.linked))
        self.text, self.linked = [], 0

    def push(self, tag: str, names: list[str], never: bool, away: bool) -> None:
        top = self.stack[-1]
        never, away = never or top.never, away or top.away
        article, path = top.article or tag in ("article", "main"), top.path
        if tag not in INLINE:
            key = (top.path, ".".join([tag, *names]) + "!" * away)
            path = self.names.setdefault(key, len(self.paths))
            if path == len(self.paths):
                self.paths.append(_Path(top.path, path if tag in CONTAINERS else self.paths[top.path].container, away, article))
        self.stack.append(_Open(tag, path, never, away, article))
        self.count[tag] += 1

    def pop_to(self, depth: int) -> None:
        gone = self.stack[depth:]
        if any(e.tag not in INLINE for e in gone):
            self.flush()
        self.count.subtract(e.tag for e in gone)
        del self.stack[depth:]

    def find(self, tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> int | None:
        if any(self.count[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    return k
                if self.stack[k].tag in stop:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append("\n")
            return
        if tag in CLOSES_P and (k := self.find({"p"}, SCOPE)) is not None:
            self.pop_to(k)
        if tag in CLOSED_BY and (k := self.find(CLOSED_BY[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE - CLOSED_BY[tag])) is not None:
            self.pop_to(k)
        top = self.stack[-1]
        if tag in ("article", "main", "body") and (top.never or top.away) and (k := self.find({"head", "nav", "header", "title"})) is not None:
            self.pop_to(k)  # what was left open
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        names = given.get("class", "").split()
        called = " ".join([*names, given.get("id", "")])
        never = tag in NEVER or "hidden" in given or given.get("aria-hidden") == "true"
        named = tag not in ("html", "body", "article", "main") and bool(called.strip()) and bool(ASIDE.search(called))
        self.push(tag, names, never, tag in BESIDE or given.get("role", "").lower() in ROLES or named)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append("\n")
        elif (k := self.find({tag})) is not None:
            if tag in INLINE and any(e.tag not in INLINE for e in self.stack[k:]):
                del self.stack[k]
                self.count[tag] -= 1
            else:
                self.pop_to(k)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].never:
            self.text.append(data)
            if self.count["a"]:
                self.linked += len(data)


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by one space."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    blocks, paths = parser.blocks, parser.paths
    priors = path_priors(blocks, paths)
    value = {p: v * priors[p] for p, v in path_values(blocks).items()}
    if not any(priors[p] > AWAY for p in value):
        return ""
    most = max(value.values())
    content = {p for p, v in value.items() if v >= SHARE * most}
    held = {paths[p].container for p in content}
    inside = [False] * len(paths)
    for p, path in enumerate(paths):  # parents come first
        inside[p] = p in held or (p > 0 and inside[path.parent])
    return " ".join(b.text for b in blocks if b.path in content or (inside[b.path] and priors[b.path] == 1 and 2 * b.linked <= len(b.text)))


def path_priors(blocks: list[Block], paths: list[_Path]) -> dict[int, float]:
    """What elements, roles and names say about each path that has text."""
    used = {b.path for b in blocks}
    marked = any(paths[p].article and not paths[p].away for p in used)
    return {p: AWAY if paths[p].away else OUTSIDE if marked and not paths[p].article else 1.0 for p in used}


def path_values(blocks: list[Block]) -> dict[int, float]:
    """The smoothed and fused tag-path ratio of each path."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, linked in blocks:
        for k, x in enumerate((1, len(text), len(MARKS.findall(text)), min(linked, len(text)))):
            sums[path][k] += x
    length = [math.log1p(sums[b.path][1] / sums[b.path][0]) for b in blocks]
    marks = [math.log1p(sums[b.path][2] / sums[b.path][0]) for b in blocks]
    # Marks of neighbours alone don't make a block content.
    fused = [math.sqrt(a * (0.1 + math.sqrt(b * own))) for a, b, own in zip(_smooth(length), _smooth(marks), marks, strict=True)]
    out: dict[int, float] = defaultdict(float)
    for (path, _, _), v in zip(blocks, fused, strict=True):
        n, chars, _, linked = sums[path]
        out[path] += v * (1 - linked / chars) / n
    return out


def _smooth(x: list[float]) -> list[float]:
    if not x:
        return []
    padded = [x[0], *x, x[-1]]
    return [sum(w * padded[k + j] for j, w in enumerate(KERNEL)) for k in range(len(x))]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of each page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) as n_chars")
