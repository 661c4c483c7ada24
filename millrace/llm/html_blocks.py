"""HTML extraction by flat text blocks (operator 7).

A page is cut into flat blocks of text at block-level tags. Each block has its words and link density, those of its
neighbours, and what the tags around it say; class names and ids make up one feature, which text may outweigh. A
decision tree keeps or drops the block. It is trained here on the small labelled table below (`LABELLED`), whose size
is its bound: no row of the corpus is used for it.

Defined results: null or empty html gives the empty text; malformed, unclosed or crossing tags end with the element
that encloses them; character references are decoded once, also without their semicolon; white space inside a block
becomes one space; rows may repeat; other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul br".split()
)
#: Elements whose content is never text, by where it ends.
RAW = frozenset("script style noscript template svg textarea iframe object noembed noframes xmp title select canvas audio video".split())
#: Those of them that hold no tags, and so end at their own end tag or with the page.
TAGLESS = frozenset("script style textarea title xmp iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close what they find open of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an end tag doesn't reach.
SCOPES = frozenset("article main section aside nav header footer form div table body html ul ol".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|aria-hidden|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A slash at the end that belongs to a value.
_UNQUOTED = re.compile(r"=[^\s\"']*/\Z")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: Parts of names (fixed word lists): of the text itself, of what is not, and such as say nothing.
_GOOD = frozenset("article content main story post entry body text articlebody".split())
_BAD = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation header masthead footer foot sidebar side aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search comment comments replies reply discussion disqus breadcrumb breadcrumbs pagination pager tag tags toc skip copyright legal disclaimer toolbar complementary contentinfo paywall outbrain taboola".split()
)
_PLAIN = frozenset("list box container wrapper wrap section area block inner outer item items link links bar panel slot unit top bottom left right group row col column site page the global primary secondary form buttons button icons".split())
_BAD_TAGS = frozenset("nav header footer aside form button menu dialog fieldset label legend".split())
_GOOD_TAGS = frozenset(("article", "main"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "main", "side", "name", "heading", "item", "page_main")


def named(value: str) -> int:
    """What a class or id says: -2 that it is not of the text, -1 that it may not be, 1 that it is, 0 nothing."""
    got = 0
    for name in value.lower().split():
        parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
        if any(x in _BAD for x in parts):
            got = min(got, -2 if all(x in _BAD or x in _PLAIN or x in _GOOD for x in parts) else -1)
        elif got == 0 and any(x in _GOOD for x in parts):
            got = 1
    return got


class Block:
    __slots__ = ("heading", "item", "link_words", "main", "name", "side", "text", "words")

    def __init__(self, text, words, link_words, main, side, name, heading, item):
        self.text, self.words, self.link_words = text, words, link_words
        self.main, self.side, self.name, self.heading, self.item = main, side, name, heading, item


class _Page:
    """What is open at a place of a page; the blocks up to there. Each tag costs as much as it closes, however deep it lies."""

    HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
    ITEMS = frozenset(("li", "td", "th", "dd", "dt"))

    def __init__(self):
        self.out: list[Block] = []
        self.buffer: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, tuple[int, ...]]] = []  # tag, what it adds to the counts
        self.places: dict[str, list[int]] = {}  # where each tag stands in the stack
        self.scopes: list[int] = []
        #: main, side, names of each kind (-2, -1, 1), links, headings, items, elements without text
        self.counts = [0] * 9

    def flush(self):
        if self.buffer:
            text = _SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                main, side, worst, weak, good, _, heading, item, _ = self.counts
                name = -2 if worst else -1 if weak else int(good > 0)
                self.out.append(Block(text, len(text.split()), len("".join(self.linked).split()), main > 0, side > 0, name, heading > 0, item > 0))
            self.buffer.clear()
            self.linked.clear()

    def words(self, raw):
        if raw and not self.counts[8]:
            text = _html.unescape(raw) if "&" in raw else raw
            self.buffer.append(text)
            if self.counts[5]:
                self.linked.append(f"{text} ")

    def open(self, tag, attrs):
        main, side, name = int(tag in _GOOD_TAGS), int(tag in _BAD_TAGS), 0
        if tag == "header" and self.counts[0]:
            side = 0  # the heading of the article itself
        if attrs and tag not in ("html", "body"):
            for key, *values in _ATTR.findall(attrs):
                key, value = key.lower(), next((v for v in values if v), "")
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                    side = 1
                elif key in ("class", "id", "role", "itemprop", "aria-label") and not (tag in _GOOD_TAGS and key != "role"):
                    said = named(value)
                    if key == "role":
                        main, side = main or int(said > 0), side or int(said < 0)
                    elif key != "aria-label" or said < 0:
                        name = said if said < 0 or not name else name
        change = (main, side, int(name == -2), int(name == -1), int(name == 1), int(tag == "a"), int(tag in self.HEADINGS), int(tag in self.ITEMS), int(tag in RAW))
        self.counts = [x + y for x, y in zip(self.counts, change, strict=True)]
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, change))

    def close(self, depth):
        """Closes all from a place of the stack on."""
        while len(self.stack) > depth:
            tag, change = self.stack.pop()
            self.counts = [x - y for x, y in zip(self.counts, change, strict=True)]
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags, unless an element that they don't reach beyond lies within it; -1 for none."""
        depth = max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)
        return -1 if self.scopes and self.scopes[-1] > depth else depth


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    at, n, on = 0, len(page), _Page()
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            on.words(page[at:])
            break
        on.words(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                on.words(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            on.flush()
        if m[1]:
            depth = (on.places.get(tag) or [-1])[-1] if tag in SCOPES else on.last((tag,))
            if depth >= 0:
                on.close(depth)
            continue
        if tag in VOID:
            continue
        if tag in TAGLESS:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK_TAGS and on.places.get("svg"):
            on.close(on.places["svg"][0])  # no drawing holds such elements: its end tag is missing
        if tag in SELF_CLOSING and (depth := on.last(SELF_CLOSING[tag])) >= 0:
            on.close(depth)
        if not (m[3] or "").endswith("/") or _UNQUOTED.search(m[3]) or tag in BLOCK_TAGS:
            on.open(tag, m[3])
    on.flush()
    return on.out


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.array([b.link_words for b in found], float) / np.maximum(words, 1)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = words, np.minimum(density, 1)
    out[1:, 2], out[1:, 3] = words[:-1], out[:-1, 1]
    out[:-1, 4], out[:-1, 5] = words[1:], out[1:, 1]
    main = any((b.main or b.name == 1) and not b.side and b.name >= 0 for b in found)
    out[:, 6:] = [(b.main, b.side, b.name, b.heading, b.item, main) for b in found] if n else np.zeros((0, 6))
    return out


#: The labelled table: pages as they are met, block by block. "+" is text of the article, "-" is not; then its words, of which linked,
#: and what it lies in: m main element, s side element, N a name that says no, n one that may, g one that says yes; h heading, i item.
LABELLED = (
    # News, in an article element: menu, dateline, paragraphs of all lengths, a list, a quotation, related links, footer.
    "-1/1si -2/2si -1/1si -3/3si -7 +8mh +4m +38m +52/2m +1m +3m +61m +24/3m +2m +17mi +9mi +14/5mi +33m +6m +45m -5N -9/9si -7/7si -6s",
    "-14 +9mh +120m +44m +2m +1m +210/6m +5m +3/3m +31m -12N -28N -4/4s -11s -30",
    "-2s -9N +11mh +27m +1/1m +18m +64m +2/2m +9m +5m +40m -41N -60N -22N -35N -3s",
    # The same with a list of links within the article, as a menu of its parts or of what else there is to read.
    "-4/4s +6mh -3/3mi -2/2mi -4/4mi -3/3mi +55m +37m +8mh +70/2m +4m -5/5mi -6/6mi -9/9mi -7/7mi -6/6mi -14s",
    "+7mh +49m +80m +3mh -8/8mi -10/10mi -7/7mi -12/12mi -2s",
    "-1/1si +5mh -2/2mi -1/1mi -2/2mi -3/3mi -2/2mi +66m +29m -11/11mi -9/9mi -8/8mi +41m -9s",
    # Links in the text, also items with one among words, and a paragraph that is one link.
    "+6mh +30/5m +12/2mi +18/6mi +9/3mi +44m +6/6m +51m +8/8m +25m -3s",
    "+9mh +16/16m +70m +22/9m +13/11m +58m -20s",
    # Names that may say no around what is the text: results of a search, the history of a place's tags.
    "-2/2si +7mh +60mn +35mn +48mn +90/3mn -6s",
    "+5mh +33m +41mn +28mn +110mn +72mn -4mn -2mn -5mn +55m -9N",
    "+8mh +62m -3/3mn -2/2mn -6/5mn +47m +39mn +26mn -1mn -3/2mn -8s",
    "-3/3n -2n -5/5n +45n +66n +38n +51n -4/4n -2n",
    # Remarks of readers, newsletters, notices and adverts, long ones too, within the article or behind it.
    "+6mh +80m +42m -16mN -30N -2N -55mN -8mN -3/1mN -21mN -74mN -12s",
    "+4h -25N +61m +38m -9mN -47mN -130mN -66N -5mN -18mN +33m -7s",
    "-20N -33N -6/2N +70g +45g +12g +3gh +88g -24N -90N -15N -2/2",
    # A block of no element of its own, in a page whose text has a name.
    "-2/2i -3/3i +6gh +44g +90g +31/4g +2g +27g -3/3 -11 -26N -9",
    "-6 -1/1 -2/2 +9gh +130g +18g +5g +76g +8/2gi +11gi -4/4gi -5/5gi -3/3gi -13 -35",
    # A blog and a manual without any marks: what has many words and few links, and what is short between such.
    "-1/1 -1/1 -2/2 -1/1 +7h +46 +82 +3 +55/2 +31 +12 +64 -4/4 -5/5 -3/3 -6",
    "-3/3i -2/2i -2/2i +5h +29 +38/1 +4h +51 +17 +24 +6h +90 +2h +33 +40 -2/2i -3/3i -1/1i -5",
    "-5/4 -2/2 -7 +36 +70 +24/2 +48 +5 +60 +110 -2/2 -8/7 -3 -4/4",
    "-2 -1/1 -3/3 +160 +9 +75/3 +33 -12/11 -15/14 -9/9 -4",
    # Menus and further reading that stand right at the text, without marks and with them.
    "-2/2 -3/3 -1/1 +70 +33 +95 +41 -4/4 -10/10 -3/3 -4",
    "-1/1 -2/2 +28 +130 +52 -11/11 -7/7 -2/2 -1",
    "-3/3 +110 +85 +39 +64 -6/6 -2/2 -5",
    "-2/2i -1/1i +48 +75 +120 -3/3i -8/8i -2",
    "-1/1 -1/1 -3/3 +90 +36 -2/2 -5/5 -9/9 -2",
    "-2/2si -3/3si +80m +55m +6/6m +48m +5/5m +37m -4/4s -9/9s",
    # Lists of linked headlines with a time or a name below each, and single links between short paragraphs.
    "-20/20 -3 -54/54 -2 -60/60 -4 -49/49 -3 -48/48 -2 -66/66 -3 -5/5",
    "-3/3 -45/45 -5 -52/52 -4 -70/70 -3 -58/58 -6 -64/64 -2",
    "+6mh +40m -48/48mi -52/52mi -49/49mi -60/60mi +5m",
    "+4mh +4m +5/5m +3m +6m +4/4m +8m +3m +6/6m +7m -3s",
    "+6mh +12m +7/7m +9m +5m +4/4m +11m",
    # A forum and a shop without marks: items, prices and links between few real paragraphs.
    "-2/2i -1/1i -3i -2i -4/4i -1i -2i +41 +58 +26 -3i -1/1i -2/2i -5/5i -2i",
    "-4/4 -3 -2 -1 -5/5 -2 -3/3 -2 +34 +49 +22/1 -2 -1 -6/6 -3 -4/4",
    "-3/3 -18/17 -25/22 -16/16 -3 -30/27 -21/20 -2",
    "-6/6 -2 -4 -3/3 -1 -5 -2/2 -7/7 -3",
    # A recipe and a list of a company, in a main element, with short items that are text.
    "-2/2s +3mh +22m +2mi +3mi +4mi +1mi +5mi +3mh +30mi +18mi +26mi +40m -7/7s -5N -3s",
    "-1/1s -1/1s +2mh +1mi +2mi +2mi +1mi +3mi +4m +9m +2m +1m -6s -13",
    # Forms and dialogs within the main element.
    "+7mh +53m +29m -3ms -2ms -1ms -14ms +60m -1ms -9s",
    "-12s -18s +6mh +5m +47m -4ms -2ms +71m -16ms -3s",
    # Long paragraphs right beside menus and footers, and articles that end the page.
    "-2/2si -4s +150m +180m +95m -11s -17s",
    "-30s +210m +140m -25s -60s",
    "-1/1si -40s -9 +4mh +260m +120m -13s",
    "-8 -24s +175m -12s -4/4s",
    "-3/3s +2mh +40m",
    "-12 +7mh +18m",
    "-2/2si +5mh +90m +3m",
    "-2/2 -3/3 +5h +30",
    "-19 -26 +3mh +2m +1m +22m -17",
    # Articles with nothing before them, or nothing behind.
    "+20m +25m",
    "+3mh +44m +38m",
    "+60m +25m +33m",
    "+12m +90m",
    "-3/3s +50m +20m +41m",
    "+22m +64mn",
    "+22m +19m +23m",
    "+70m +30m +110m",
    "-2s +5mh +28m +2m +57m",
    "+40 +35 +52",
    "+9h +80 +61",
    "+22m -14mN +5m",
    "+31m +2m -6s",
    "+24m",
    "+19m -9ms +28m",
    "+5m +17m +21m -3N",
    "+9m +66mn -8N",
    "+27g +33g -12",
    "-3/3s +21m",
    "-2/2s +3mh +26m -7mN",
    "-6/6s -2s +18m +12m",
    # A page that is all menu, and one that is all text.
    "-1/1si -2/2si -3/3si -5s",
    "+50 +120 +44 +61 +30",
)


def _labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in LABELLED:
        found = []
        for keep, words, links, marks in re.findall(r"([+-])(\d+)(?:/(\d+))?([a-zA-Z]*)", page):
            name = -2 if "N" in marks else -1 if "n" in marks else int("g" in marks)
            found.append(Block("", int(words), int(links or 0), "m" in marks, "s" in marks, name, "h" in marks, "i" in marks))
            y.append(keep == "+")
        x.append(features(found))
    return np.concatenate(x), np.array(y)


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
        self.keep, self.at = bool(2 * y.sum() > len(y)), None
        if depth == 0 or y.all() or not y.any():
            return
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for t in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= t
                if min(left.sum(), (~left).sum()) < least:
                    continue
                score = sum(len(s) * (p := s.mean()) * (1 - p) for s in (y[left], y[~left]))
                if best is None or score < best[0] - 1e-12:
                    best = (score, j, t)
        if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
            return
        _, j, t = best
        left = x[:, j] <= t
        self.at, self.left, self.right = (j, t), Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), self.keep)
        j, t = self.at
        left = x[:, j] <= t
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.left.predict(x[left]), self.right.predict(x[~left])
        return out


@lru_cache(1)
def tree() -> Tree:
    return Tree(*_labelled())


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, k in zip(found, tree().predict(features(found)), strict=True) if k)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for each page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], ["id", "url", "text"])

    modest_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, "id long, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
