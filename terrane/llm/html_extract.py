"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path: element names with their classes. Per path, text
length and punctuation are set against the number of nodes: long, punctuated paths are prose, short ones are menus. The
two ratios are smoothed along the page and fused by product; class names that speak of page furniture lower a path's
score, they do not decide. Paths above a threshold select the content nodes. The article is what holds these: the
article elements around them, or else their smallest common element. In it, headings, short paragraphs and lists stay
with the prose; what goes is furniture by element, role or hiding, and nodes whose path is lowered below the threshold.
Headings before the article belong to it. If every path is lowered below the threshold, scores count as they are.

Cases. Null or empty html gives an empty text. Unclosed, stray and misnested tags are tolerated; a quote begins a value
only after an equals sign. The time is linear in the page, whatever its depth, and nothing is cut off. Equal pages give
equal texts; repeated rows are read one by one. Null ids and urls are passed on; other columns are not read and may have
any name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import small_batches

#: Elements whose text is never page text.
RAW = frozenset("script style noscript template iframe object embed svg math canvas audio video head title select textarea".split())
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are page furniture.
FURNITURE = frozenset("nav footer aside form button dialog menu menuitem label fieldset dir".split())
#: Landmark roles that are page furniture.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id attributes that name page furniture.
FURNITURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored promo promos promotion
    banner banners nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager sidebar sidebars sidenav aside widget
    widgets footer foot header masthead topbar bottombar toolbar comment comments commentlist disqus respond reply replies discussion
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social
    related recommended recommendations teaser teasers skip copyright legal disclaimer outbrain taboola""".split()
)
#: Words that say nothing beside one of those: a class is furniture if it has no other words.
NEUTRAL_WORDS = frozenset(
    """site page post posts article articles section block box container wrapper wrap inner outer area list item items link links button buttons bar
    content slot unit top bottom left right main primary secondary global user reader form icons media tags text title panel zone row col group stories""".split()
)
#: Words of titles, which name a part of the article inside it, on headings, and beside the second ones.
TITLE_WORDS = frozenset("head header masthead banner".split())
STORY_WORDS = frozenset("section article articles post posts content title text item media block".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: An opening tag of the first closes an open one of the second, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("ul ol dl table div section article aside main nav footer header form body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？،؛؟।]")
_SPACES = re.compile(r"\s+")


#: Factor of scores of paths with furniture in their class names, and share of the deviation that makes the threshold.
LOWERED, SPREAD = 0.05, 0.3


class Element:
    """article: the innermost article (or main) element that holds it. enter, leave: its place in document order."""

    __slots__ = ("article", "boiler", "enter", "heading", "leave", "name", "parent")

    def __init__(self, name: str, parent: Element | None, boiler: bool, enter: int):
        self.name, self.parent, self.boiler, self.enter, self.leave = name, parent, boiler, enter, enter
        self.heading = name in HEADINGS or (parent is not None and parent.heading)
        self.article = self if name in ("article", "main") else parent and parent.article

    def holds(self, other: Element) -> bool:
        return self.enter <= other.enter <= self.leave


class Node:
    """One run of text between tags. path: number of its tag path; lowered: whether that names furniture."""

    __slots__ = ("block", "element", "linked", "lowered", "path", "text")

    def __init__(self, text: str, element: Element, path: int, lowered: bool, linked: bool, block: int):
        self.text, self.element, self.path, self.lowered, self.linked, self.block = text, element, path, lowered, linked, block


def furniture_words(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id attribute says furniture and nothing else."""
    for name in value.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        if parts and all(p in FURNITURE_WORDS or p in NEUTRAL_WORDS for p in parts):
            story = in_article or any(p in STORY_WORDS for p in parts)
            if any(p in FURNITURE_WORDS and not (story and p in TITLE_WORDS) for p in parts):
                return True
    return False


def _describe(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is furniture, whether its names speak of it, and its step of the tag path."""
    boiler, lowered, step = name in FURNITURE or (name == "header" and not in_article), False, name
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), entities.unescape("".join(values))
        if key == "role":
            boiler |= value.lower() in ROLES
        elif key in ("class", "id"):
            lowered |= name not in ("html", "body", "article", "main") and furniture_words(value, in_article or name in HEADINGS)
            step = f"{step}.{' '.join(sorted(value.lower().split()))}" if key == "class" else step
        else:
            boiler |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and bool(_UNSEEN.search(value)))
    return boiler, lowered, step


class Reader:
    """The open elements of a page. All steps take constant time, taken over the page."""

    def __init__(self):
        self.root = Element("#root", None, False, 0)
        self.stack = [self.root]
        self.paths = [(0, False)]  # number of the tag path, and whether it names furniture
        self.numbers: dict[tuple[int, str], int] = {}
        self.open: dict[str, list[int]] = {}  # depths of the open elements of each name
        self.scopes: list[int] = []  # depths of the open elements that end tags do not reach across
        self.count = self.block = 0
        self.nodes: list[Node] = []

    def text(self, piece: str) -> None:
        if piece:
            path, lowered = self.paths[-1]
            said = " " if piece.isspace() else entities.unescape(piece)
            self.nodes.append(Node(said, self.stack[-1], path, lowered, bool(self.open.get("a")), self.block))

    def push(self, name: str, attributes: str) -> None:
        parent, (path, was) = self.stack[-1], self.paths[-1]
        boiler, lowered, step = _describe(name, attributes, parent.article is not None)
        self.count += 1
        self.open.setdefault(name, []).append(len(self.stack))
        if name in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(Element(name, parent, parent.boiler or boiler, self.count))
        self.paths.append((self.numbers.setdefault((path, step), len(self.numbers) + 1), was or lowered))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            gone = self.stack.pop()
            gone.leave = self.count
            self.paths.pop()
            self.open[gone.name].pop()
            if gone.name in _SCOPE:
                self.scopes.pop()

    def depth_of(self, name: str) -> int:
        """Of the innermost open element of that name; 0 for none."""
        return (self.open.get(name) or [0])[-1]

    def close(self, name: str) -> None:
        depth = self.depth_of(name)
        if depth and (name in BLOCKS or not self.scopes or self.scopes[-1] <= depth):
            self.close_to(depth)

    def close_open(self, names: Iterable[str]) -> None:
        """What a new block ends without an end tag, if no scope lies between."""
        depth = max(self.depth_of(n) for n in names)
        if depth and (not self.scopes or self.scopes[-1] <= depth):
            self.close_to(depth)


def read_nodes(html: str) -> list[Node]:
    """The text nodes of a page in order; text of raw elements, comments and markup is left out."""
    page, at, size = Reader(), 0, len(html)
    ends: dict[str, int] = {}
    while at < size:
        m = _TOKEN.search(html, at)
        page.text(html[at : m.start()] if m else html[at:])
        if m is None:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        page.block += name in BLOCKS
        if m[1]:
            page.close(name)
        elif name in RAW and not m[3].rstrip().endswith("/"):
            if name != "head":
                if ends.get(name, 0) < size:  # once the end is missing, it is missing for all that follow
                    close = _closing(name).search(html, at)
                    ends[name] = close.end() if close else size
                at = ends[name]
        elif name == "br":
            page.text(" ")
        else:
            if name in CLOSES:
                page.close_open(CLOSES[name])
            elif name in BLOCKS:
                page.close_open(("p",))
            if name not in VOID and not m[3].rstrip().endswith("/"):
                page.push(name, m[3])
    page.close_to(1)
    page.root.leave = page.count
    return page.nodes


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def path_scores(nodes: list[Node], width: int = 1) -> dict[int, float]:
    """Fused ratio of each tag path: smoothed text ratio times smoothed punctuation ratio."""
    count: dict[int, int] = {}
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    for n in nodes:
        count[n.path] = count.get(n.path, 0) + 1
        if not n.linked:
            length[n.path] = length.get(n.path, 0) + len(n.text)
            marks[n.path] = marks.get(n.path, 0) + len(_PUNCTUATION.findall(n.text))
    series = [(length.get(n.path, 0) / count[n.path], marks.get(n.path, 0) / count[n.path]) for n in nodes]
    total: dict[int, float] = {}
    for i, n in enumerate(nodes):
        near = series[max(0, i - width) : i + width + 1]
        smooth = [sum(x[k] for x in near) / len(near) for k in (0, 1)]
        own = [0.5 * series[i][k] + 0.5 * smooth[k] for k in (0, 1)]
        total[n.path] = total.get(n.path, 0.0) + own[0] * (own[1] + 0.05)
    return {p: total[p] / count[p] for p in total}


def select_nodes(nodes: list[Node], spread: float = SPREAD) -> list[Node]:
    """The content nodes, those of paths above the threshold, and what stands with them in the article."""
    live = [n for n in nodes if not n.element.boiler]
    real = [n for n in live if not n.text.isspace()]
    if not real:
        return []
    scores = path_scores(real)
    values = list(scores.values())
    mean = sum(values) / len(values)
    threshold = spread * (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    fused = {n.path: scores[n.path] * (LOWERED if n.lowered else 1.0) for n in real}
    if max(fused.values()) < threshold:
        fused = scores
    low = {n.path for n in real if n.lowered and fused[n.path] < threshold}
    chosen = [n for n in real if n.path not in low and fused[n.path] >= threshold and not n.linked] or [n for n in real if n.path not in low]
    homes = _homes(chosen)
    inside = [n.path not in low and any(h.holds(n.element) for h in homes) for n in live]
    start = inside.index(True)
    return [n for i, n in enumerate(live) if inside[i] or (i < start and n.element.heading and n.path not in low)]


def _homes(chosen: list[Node]) -> list[Element]:
    """The elements that hold the article: article elements with at least half of the chosen text, or one common element."""
    articles = {id(n.element.article): n.element.article for n in chosen if n.element.article}
    within = sum(len(n.text) for n in chosen if n.element.article)
    if articles and 2 * within >= sum(len(n.text) for n in chosen):
        outer: list[Element] = []  # in document order, without those that others hold
        for a in sorted(articles.values(), key=lambda a: a.enter):
            if not outer or not outer[-1].holds(a):
                outer.append(a)
        return outer if len(outer) <= 8 else [_common(outer)]
    return [_common([n.element for n in chosen])]


def _common(elements: list[Element]) -> Element:
    """The smallest element that holds all, widened to one that can hold blocks."""
    home = elements[0]
    for e in elements:
        while not home.holds(e):
            home = home.parent
    while home.parent is not None and home.name not in _SCOPE:
        home = home.parent
    return home


def extract(html: str | None) -> str:
    """The main text: blocks in page order joined by a line end, white space inside a block as one space."""
    if not html:
        return ""
    blocks: dict[int, list[str]] = {}
    for n in select_nodes(read_nodes(html)):
        blocks.setdefault(n.block, []).append(n.text)
    texts = (_SPACES.sub(" ", "".join(b)).strip() for _, b in sorted(blocks.items()))
    return "\n".join(t for t in texts if t)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; one pass, no shuffle."""
    small_batches(pages.sparkSession)
    rows = pages.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS page_id", f"CAST(`{url_col}` AS STRING) AS url", f"CAST(`{html_col}` AS STRING) AS html")
    return rows.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
