"""Operator 2: main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path of tags from the root (a tag with its first class). Text of the
same path is added up: its length and its punctuation, for each of its blocks. These two ratios are smoothed over
neighbouring paths in page order, divided by the page's means and fused into one score; paths whose score reaches
``THRESHOLD`` of the best are content. The article is the deepest element that holds all of them, and every block in it
belongs to it, headings and short lines as well; inside an ``article`` element that one is taken whole. Headings,
paragraphs and quotes that stand directly in an element around the article belong to it, too, and so do the page's first-level
headings before it.

Parts that are no article by what they are named are left out before: menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles, by tag, role, or a word of the class or id.

Defined results: a null, empty or text-free page has the empty text; markup that is not closed is closed where HTML would
close it; very long pages are read whole in linear time; repeated rows repeat their text; equal scores keep page order; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import map_batches, table, text_slices

#: Share of the best score that a content path reaches, and weights of a path and its neighbours when smoothing.
THRESHOLD = 0.25
SMOOTHING = (0.25, 0.5, 0.25)
#: Blocks that belong to the article where they stand directly in an element around it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STANDING = HEADINGS | frozenset("p blockquote pre".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: One attribute, or a stray quoted value; read one after the other, so that nothing inside a value counts as a name.
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?|\"[^\"]*\"|'[^']*'")
WHITE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
PUNCTUATION = ".,;:!?…،。、！？"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select option textarea title head menu dialog figure-actions fieldset input audio video map xmp noembed noframes".split())
NO_ARTICLE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay toolbar form search login signup subscribe subscription newsletter share sharing social comment comments"
    " disqus reply replies respond discussion related recommended recommendations widget pagination pager skip hidden tags tagcloud copyright legal disclaimer".split()
)
LAYOUT_WORDS = frozenset("has with no without hide".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Elements that end an open one of the same or the given kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that no such closing reaches beyond.
SCOPE = frozenset("html body table ul ol dl article section main div aside nav header footer form".split())
BLOCKS_IN_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def names_no_article(name: str) -> bool:
    """Whether one class or id speaks of such a part, and not of a layout that has one (``with-sidebar``)."""
    words = WORD.findall(name)
    return not NO_ARTICLE.isdisjoint(words) and LAYOUT_WORDS.isdisjoint(words)


def left_out(tag: str, attributes: str) -> bool:
    """Whether the element is no part of an article, by its tag or how it is named."""
    if tag in LEFT_OUT:
        return True
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value in ROLES:
            return True
        if tag in ("html", "body", "main", "article"):
            continue
        if name == "hidden" or name in ("class", "id") and any(map(names_no_article, value.split())):
            return True
    return False


def first_class(attributes: str) -> str:
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        if name.lower() == "class":
            return "." + " ".join("".join(values).split()[:1])
    return ""


class Page:
    """Blocks of one page: the element each belongs to, its path, and its text."""

    def __init__(self, source: str) -> None:
        self.parents, self.labels = [-1], [""]
        self.paths, self.path_of = [0], {}  # number of each element's path, and of every (path above, label)
        self.blocks: list[tuple[int, str]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, element, left out
        self.opened: Counter[str] = Counter()  # how many of a tag are open
        self.text: list[str] = []
        self.read(source)

    def flush(self) -> None:
        text = "".join(self.text).strip() if self.text else ""
        self.text = []
        if text and (text := WHITE.sub(" ", html.unescape(text)).strip()):
            self.blocks.append((self.open[-1][1] if self.open else 0, text))

    def read(self, source: str) -> None:
        # After the last ">" no tag can end, so none is looked for, only a comment that never does.
        at, stop = 0, source.rfind(">") + 1
        while found := TOKEN.search(source, at, stop):
            self.add(source[at : found.start()])
            at = found.end()
            if at == stop and found.group().startswith("<!--") and not found.group().endswith("-->"):
                at = len(source)
            closing, tag, attributes = found.group(1), found.group(2), found.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW and not closing:
                end = re.compile(rf"(?i)</{re.escape(tag)}[\s/>]").search(source, at)
                after = source.find(">", end.start()) if end else -1
                at = after + 1 if after >= 0 else len(source)
                if tag not in INLINE:
                    self.flush()
            elif tag == "br":
                self.text.append("\n")
            elif tag in INLINE:
                self.inline(tag, bool(closing), attributes)
            elif closing:
                self.close(tag)
            else:
                self.start(tag, attributes)
        self.add(source[at:].partition("<!--")[0])
        self.flush()

    def push(self, tag: str, element: int, gone: bool) -> None:
        self.open.append((tag, element, gone))
        self.opened[tag] += 1

    def cut(self, place: int) -> None:
        """Ends the open elements from a place on."""
        for tag, _, _ in self.open[place:]:
            self.opened[tag] -= 1
        del self.open[place:]

    def add(self, text: str) -> None:
        if text and not (self.open and self.open[-1][2]):
            self.text.append(text)

    def inline(self, tag: str, closing: bool, attributes: str) -> None:
        """Inline elements do not change the path; only those left out by name are kept open until they end, and inside them
        those of the same tag, whose ends are not theirs."""
        top = self.open[-1] if self.open else ("", 0, False)
        if closing:
            if top[0] == tag:
                self.cut(len(self.open) - 1)
        elif top[0] == tag and top[2] or attributes and left_out(tag, attributes):
            self.push(tag, top[1], True)

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag in BLOCKS_IN_P:
            self.end_open({"p"})
        if tag in CLOSES:
            self.end_open(CLOSES[tag])
        if tag in VOID or attributes.endswith("/"):
            return
        above = self.open[-1] if self.open else ("", 0, False)
        label = tag + first_class(attributes)
        self.parents.append(above[1])
        self.labels.append(label)
        self.paths.append(self.path_of.setdefault((self.paths[above[1]], label), len(self.path_of) + 1))
        self.push(tag, len(self.parents) - 1, above[2] or left_out(tag, attributes))

    def end_open(self, tags: set[str]) -> None:
        if not any(self.opened[tag] for tag in tags):
            return
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] in tags:
                return self.cut(place)
            if self.open[place][0] in SCOPE:
                return

    def close(self, tag: str) -> None:
        self.flush()
        if not self.opened[tag]:
            return
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                return self.cut(place)


def path_scores(paths: list[int], texts: list[str]) -> dict[int, float]:
    """Fused ratio of every path, in the order in which the paths come first."""
    order = list(dict.fromkeys(paths))
    place = {path: i for i, path in enumerate(order)}
    length, marks, blocks = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order))
    for path, text in zip(paths, texts, strict=True):
        i = place[path]
        length[i] += len(text)
        marks[i] += sum(map(text.count, PUNCTUATION))
        blocks[i] += 1
    fused = np.ones(len(order))
    for total in (length, marks + 1):
        ratio = total / blocks
        padded = np.concatenate([ratio[:1], ratio, ratio[-1:]])
        smooth = sum(weight * padded[i : i + len(ratio)] for i, weight in enumerate(SMOOTHING))
        fused *= np.maximum(smooth, ratio) / smooth.mean()
    return dict(zip(order, np.sqrt(fused * length / length.sum()), strict=True))


def main_text(source: str | None) -> str:
    """The article's blocks, one to a line."""
    page = Page(source) if source else None
    if page is None or not page.blocks:
        return ""
    paths = [page.paths[element] for element, _ in page.blocks]
    texts = [text for _, text in page.blocks]
    scores = path_scores(paths, texts)
    limit = THRESHOLD * max(scores.values())
    # Elements are numbered as they open, so those inside one are the numbers up to its last.
    last = list(range(len(page.parents)))
    for element in range(len(last) - 1, 0, -1):
        above = page.parents[element]
        last[above] = max(last[above], last[element])
    chosen = [element for (element, _), path in zip(page.blocks, paths, strict=True) if scores[path] >= limit]
    here = min(chosen)
    while last[here] < max(chosen):
        here = page.parents[here]
    shared = []
    while here >= 0:
        shared.append(here)
        here = page.parents[here]
    shared = shared[::-1]
    tag = lambda element: page.labels[element].split(".")[0]
    while len(shared) > 1 and tag(shared[-1]) in STANDING | {"li", "td"}:
        shared = shared[:-1]
    # Where the page marks its article, a part of it that holds the content stands for the whole.
    marked = next((i for i in range(len(shared) - 1, -1, -1) if tag(shared[i]) == "article"), None)
    around = set(shared if marked is None else shared[: marked + 1])
    article = shared[-1] if marked is None else shared[marked]
    out, begun = [], False
    for element, text in page.blocks:
        inside = article <= element <= last[article]
        begun = begun or inside
        if inside or element in around and element != 0 or tag(element) in STANDING and page.parents[element] in around or tag(element) == "h1" and not begun:
            out.append(text)
    return "\n".join(out)


def extracted(frame: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key`` and ``text`` of every row."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([main_text(value) for value in part.column("text").to_pylist()], pa.string())], ["key", "text"])

    found = map_batches(frame.select(F.col(key).alias("key"), F.col(page).alias("text")), step, f"key {frame.schema[key].dataType.simpleString()}, text string")
    return found.withColumnRenamed("key", key)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = F.coalesce("text", F.lit(""))
    # The url travels with the key, so that no join is needed.
    found = extracted(pages.select(F.struct("page_id", "url").alias("page"), "html"), "page")
    return found.select("page.page_id", "page.url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
