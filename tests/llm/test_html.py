import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.html_blocks import FEATURES, LABELLED, Tree, blocks, extract, features, main_text, op7_html_blocks, tree
from pyspark.sql import functions as F

from .helpers import clashing

LONG = "This is a sentence of the article that says what there is to say about it and then goes on for a while."
CASES = {
    "articles": (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>Yes.</p></article><footer>&copy; all</footer>", f"Title\n{LONG}\nYes."),
    "references": ("<article><p>Fish &amp; chips &lt;now&gt; &#233;t&eacute; &copy &nbsp; x&amp;amp;</p></article>", "Fish & chips <now> été © x&amp;"),
    "white space": ("<article><p>  a \n\t b&#32;&#9;c  </p><p>   </p><p>d<br>e</p></article>", "a b c\nd\ne"),
    "inline tags": ("<article><p>un<b>brok</b>en <i>and</i> <a href='x>y'>linked</a>.</p></article>", "unbroken and linked."),
    "scripts and styles": ("<article><script>var t='</p>';</script><style>p{x:y}</style><p>kept</p><!-- <p>no</p> --><noscript>no</noscript></article>", "kept"),
    "unclosed tags": (f"<article><h1>T</h1><p><b>bold <p>second<ul><li>one<li>two</ul><p>{LONG}</article><footer>f</footer>", f"T\nbold\nsecond\none\ntwo\n{LONG}"),
    "crossing tags": ("<div class=ad><b>buy</div><article><i>x</b> y</i></article></div>", "x y"),
    "comments of readers": (f"<article><p>{LONG}</p><section class='comments'><p>{LONG} I agree.</p></section></article>", LONG),
    "adverts inside": (f"<article><p>{LONG}</p><div class='ad'>Buy two.</div><div id=newsletter><form>Mail</form></div><p>End.</p></article>", f"{LONG}\nEnd."),
    "sidebars and notices": (f"<div class='cookie-notice'>{LONG}</div><aside>{LONG}</aside><main><p>{LONG}</p></main><div class=sidebar>{LONG}</div>", LONG),
    "forms": (f"<main><p>{LONG}</p><form><label>Name</label><input><button>Send</button></form></main>", LONG),
    "hidden": (f"<main><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p></main>", LONG),
    "no marks": (f"<div><a>Home</a> <a>Shop</a> <a>News</a></div><p>{LONG * 3}</p><p>{LONG * 2}</p><div><a>Terms</a> <a>Privacy</a></div>", f"{LONG * 3}\n{LONG * 2}"),
    "empty": ("", ""),
    "no tags": ("", ""),
    "only a menu": ("<nav><a>x</a></nav>", ""),
    "broken": ("<article><p>a<", "a<"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert main_text(page) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "&#x41;", "<", ">", "\"", "<a href='", "<article>", "</article>", "<li>"]), max_size=25))
def test_any_markup_ends(parts):
    page = "".join(parts)
    for b in blocks(page):
        assert b.text == " ".join(b.text.split()) and b.text
    main_text(page)


def test_long_pages_are_whole():
    paragraphs = [f"{LONG} Number {i}." for i in range(5000)]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert main_text(page) == "\n".join(paragraphs)
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_held_out_accuracy():
    """Pages of other words, names and lengths than those of the labelled table."""
    r = np.random.default_rng(3)
    hit = n = 0
    for _ in range(60):
        body = [(f"word{i} " * int(r.integers(1, 80))).strip() for i in range(r.integers(1, 12))]
        page = f"<header><a>A</a></header><ul class=nav><li><a>B</a></li></ul><div class=banner>{'buy ' * int(r.integers(1, 40))}</div><article>"
        page += "".join(f"<p>{b}</p>" for b in body) + f"</article><div class=comments><p>{'so true ' * int(r.integers(1, 40))}</p></div><footer>x</footer>"
        got = main_text(page).split("\n")
        hit += len(set(got) & set(body)) + (len(set(got) - set(body)) == 0)
        n += len(set(body)) + 1
    assert hit / n > 0.98


def asked(t):
    """The features that a tree asks for."""
    return set() if t.at is None else {FEATURES[t.at[0]]} | asked(t.left) | asked(t.right)


def test_words_and_links_decide():
    used = asked(tree())
    assert {"words", "link_density", "prev_words", "next_words"} <= used and used & {"prev_link_density", "next_link_density"}
    # What the tree learns does not follow the marks alone: they leave text on both sides.
    marks = [FEATURES.index(f) for f in ("main", "side", "name", "page_main")]
    both = {}
    for page in LABELLED:
        for keep, text in re.findall(r"([+-])(\d+(?:/\d+)?[a-zA-Z]*)", page):
            both.setdefault("".join(c for c in text if c in "msNng"), set()).add(keep)
    assert len(marks) == 4 and both["m"] == both[""] == both["mn"] == both["g"] == {"+", "-"}


def unmarked(r):
    """A page whose elements say nothing: menus, paragraphs with short ones among them, links to other pages."""
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    link = lambda k, n: f"<div><a href=/>{text(k, n)}</a></div>"
    head = [link(k, int(r.integers(1, 4))) for k in range(int(r.integers(2, 8)))]
    body = [text(100 + k, int(r.integers(25, 140))) for k in range(int(r.integers(3, 12)))]
    tail = [link(50 + k, int(r.integers(2, 12))) for k in range(int(r.integers(2, 8)))] + [f"<div>{text(90, int(r.integers(1, 6)))}</div>"]
    return "".join(head) + "".join(f"<div>{b}</div>" for b in body) + "".join(tail), body


def test_held_out_accuracy_without_marks():
    r, hit, n = np.random.default_rng(9), 0, 0
    for _ in range(100):
        page, body = unmarked(r)
        for b, keep in zip(found := blocks(page), tree().predict(features(found)), strict=True):
            hit += keep == (b.text in body)
            n += 1
    assert hit / n > 0.95


ITEMS = "".join(f"<li><a href=/{i}>Other story number {i}</a></li>" for i in range(6))


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><h1>Title</h1><p>{LONG}</p><ul>{ITEMS}</ul></article>", f"Title\n{LONG}"),
        (f"<p>{LONG * 3}</p><p>{LONG * 2}</p><ul>{ITEMS}</ul>", f"{LONG * 3}\n{LONG * 2}"),
        (f"<article><p>{LONG}</p><div class='search-results'><p>{LONG * 3}</p></div></article>", f"{LONG}\n{LONG * 3}"),
        (f"<article><p>{LONG}</p><div class='tags-history'><p>{LONG * 3}</p></div><p>{LONG}</p></article>", f"{LONG}\n{LONG * 3}\n{LONG}"),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><address>12 Long Street</address><p>{LONG}</p></article>", f"{LONG} x=1\n12 Long Street\n{LONG}"),
        (f"<article><p>{LONG}<svg><path d=x><text>no</text></p><p>{LONG} End.</p></article>", f"{LONG}\n{LONG} End."),
        (f"<article><p>{LONG}</p><div class=comment-list><p>{LONG * 3}</p></div></article>", LONG),
    ],
)
def test_links_and_names(page, want):
    assert main_text(page) == want


def test_nested_tags_take_linear_time():
    for piece in ("<b><i>x", "<div>x", "<p><li>x", "<svg><g>", "</b></i></p>", "<a class=nav>x"):
        start = time.process_time()
        blocks("<article>" + piece * (400_000 // len(piece)))
        assert time.process_time() - start < 15


class Flat(HTMLParser):
    """The text of article elements by another parser, cut at block-level tags."""

    BLOCKS = frozenset("address article aside blockquote div footer form h1 h2 h3 header li main nav ol p section table td th tr ul br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.parts.append("\n")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0:
            self.parts.append(re.sub(r"\s", " ", data))


def test_query_by_another_parser(spark):
    """On these pages the article is all that is text."""
    sf = "/root/testdata/sf0.001"
    want = {}
    for i, page in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        p = Flat()
        p.feed(page or "")
        p.close()
        want[i] = "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.parts).split("\n")) if x)
    assert {r["page_id"]: r["text"] for r in op7_html_blocks(spark, sf).collect()} == want


def test_tree_learns():
    x = np.array([[i % 7, i % 2] for i in range(70)], float)
    y = (x[:, 0] > 3) & (x[:, 1] == 1)
    assert (Tree(x, y).predict(x) == y).all()
    assert features([]).shape == (0, len(FEATURES)) and tree().at is not None


def test_hard_rows(spark):
    page = CASES["articles"][0]
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p>" * 50_000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "id text n_chars")
    got = sorted((str(r["page_id"]), r["url"], r["text"]) for r in extract(df).where("url is not null").collect())
    assert got == sorted([("1", "u", CASES["articles"][1])] * 2 + [("None", "u", ""), ("3", "u", "")])
    assert extract(df).columns == ["page_id", "url", "text"] and extract(df).count() == 5
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op7_html_blocks(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.where((F.length("text") != F.col("n_chars")) | (F.col("n_chars") == 0)).count() == 0
    assert got.where(F.col("text").rlike("<(p|b|br|a)>|var t=")).count() == 0


@pytest.mark.parametrize("tag", "select svg object video audio canvas template noscript".split())
def test_unclosed_elements_end_with_what_encloses_them(tag):
    page = f"<body><article><div><{tag}>gone</div><p>The text after it stays where it is.</p></article></body>"
    assert [b.text for b in blocks(page)] == ["The text after it stays where it is."]
