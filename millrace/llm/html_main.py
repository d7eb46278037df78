"""Main text of pages: flat text blocks classified by a decision tree.

A page is cut into blocks of text at its block-level tags.  A block's features are its word
count and link density, those of its neighbours, and what encloses it: tags and class names of
articles or of menus, adverts, comments and the like.  The tree is trained with Spark ML on
the blocks of a few labelled pages; tasks only walk it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import row_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th
    thead tr ul""".split())
SILENT = frozenset("""script style noscript template title textarea select button svg math iframe object canvas audio video
    datalist noframes""".split())
FRAME = frozenset("nav footer aside form menu dialog search fieldset".split())
GOOD_NAMES = frozenset("article content post entry story main maincontent articlebody body text".split())
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice notices alert warning popup modal overlay newsletter subscribe signup sidebar aside menu nav navbar navigation
    breadcrumb breadcrumbs footer comment comments commentlist disqus discussion reply replies respond feedback related recommended share
    sharing social tags widget toolbar pagination pager copyright login search form teaser outbrain taboola skip""".split())
TOP_NAMES = frozenset("header masthead topbar".split())

FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "good", "bad", "item", "heading"]


class Blocks(HTMLParser):
    """Collects ``[text, words, words in links, good, bad, item, heading, label]`` for each block of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [("", False, False, False)]  # tag, good, bad, silent; each with what encloses it
        self.open = Counter()
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[list] = []
        self.kind = ""
        self.label = 0.0

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            _, good, bad, _ = self.stack[-1]
            self.blocks.append([" ".join(words), len(words), min(self.linked, len(words)), good, bad,
                                self.kind == "li", self.kind[:1] == "h" and self.kind[1:].isdigit(), self.label])
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            self.kind = tag
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, good, bad, silent = self.stack[-1]
        names: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                names.update(re.split(r"[^a-z]+", value.lower()))
        if tag not in ("html", "body"):
            good = good or tag in ("article", "main") or bool(names & GOOD_NAMES)
            bad = bad or tag in FRAME or bool(names & BAD_NAMES) or not good and (tag == "header" or bool(names & TOP_NAMES))
        self.stack.append((tag, good, bad, silent or tag in SILENT))
        self.open[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.kind = ""
        while self.open[tag]:
            closed = self.stack.pop()[0]
            self.open[closed] -= 1
            self.links -= closed == "a"
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.stack[-1][3]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())

    def handle_pi(self, data: str) -> None:
        if data.startswith("label "):  # in the labelled pages only
            self.flush()
            self.label = float(data[6:7])


def blocks(html: str) -> list[list]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def features(found: list[list]) -> list[list[float]]:
    rows = []
    for i, block in enumerate(found):
        row: list[float] = []
        for at in (i, i - 1, i + 1):
            words, linked = (found[at][1], found[at][2]) if 0 <= at < len(found) else (0, 0)
            row += [float(words), linked / words if words else 0.0]
        rows.append(row + [float(x) for x in block[3:7]])
    return rows


_TEXT = "The council met on Monday and agreed that the new bridge will be built next year, after a long debate."
_SHORT = "It rained."
_MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li><li><a href=/c>Contact us</a></li></ul>"
_NOISE = [
    f"<nav>{_MENU}</nav>", f"<header><h1>City Post</h1><p>Daily since 1901</p>{_MENU}</header>", f"<div class=menu>{_MENU}</div>",
    f"<div class=ad>{_TEXT}</div>", "<div class=ad>Buy now.</div>", f"<div class=sidebar><h3>Most read</h3>{_MENU}<p>{_TEXT}</p></div>",
    f"<aside><p>{_TEXT}</p></aside>", f"<form><p>Name</p><p>{_TEXT}</p><input></form>", "<div id=cookie-notice>We use cookies. OK</div>",
    f"<div class=comments><p>Jane</p><p>{_TEXT}</p></div>", f"<section id=comments><h2>2 comments</h2><p>{_TEXT}</p><p>Agreed!</p></section>",
    f"<footer>&copy; site &middot; {_TEXT}</footer>", "<footer><p>All rights reserved</p></footer>", f"<div>{_MENU}</div>",
    "<p><a href=/x>Next</a> <a href=/y>Previous</a></p>", f"<div class=banner><p>{_TEXT}</p></div>",
    f"<div class=newsletter><h3>Join us</h3><p>{_TEXT}</p></div>", f"<div class=related><ul><li><a href=/q>{_TEXT}</a></li></ul></div>",
]
_STORY = [
    f"<h1>A new bridge</h1><p>{_TEXT}</p><p>{_SHORT}</p><p>{_TEXT} {_TEXT}</p>",
    f"<h1>{_TEXT}</h1><p><b>{_SHORT}<br><p>{_SHORT}</p><p>{_TEXT}</p><h2>Why</h2><p>Yes.</p>",
    f"<p>{_TEXT} <a href=/z>{_SHORT}</a></p><ul><li>One</li><li>{_TEXT}</li></ul><blockquote>{_SHORT}</blockquote>",
    f"<p>{_SHORT}</p><p>Be.</p><p>See <a href=/w>the council met on Monday</a> for more.</p><p>{_TEXT}</p>",
    f"<header><h1>Rain</h1></header><p>{_TEXT}</p><pre>x = 1</pre><table><tr><td>{_SHORT}</td><td>2</td></tr></table>",
]


def labelled_pages() -> list[str]:
    """Pages of a story (label 1) between and around other blocks (label 0), which are told by ``<?label n>``."""
    wraps = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div id=post-body>", "</div>")]
    pages = []
    for i, noise in enumerate(_NOISE):
        for j, story in enumerate(_STORY):
            start, end = wraps[(i + j) % len(wraps)]
            inner = _NOISE[(i * 3 + j * 5) % len(_NOISE)]
            inner = inner if not inner.startswith(("<header", "<div><ul")) else ""
            pages.append(f"<html><body><?label 0>{noise}{start}<?label 1>{story}<?label 0>{inner}{end}{_NOISE[(i + j + 1) % len(_NOISE)]}")
    # Nothing stands before or after the story.
    pages += [f"<body><?label 1>{a}{story}{b}" for a, b in wraps for story in _STORY]
    # Pages that mark nothing: long paragraphs are the story.
    pages += [f"<body><?label 0><div>{_MENU}</div><?label 1><div><p>{_TEXT} {_TEXT}</p><p>{_TEXT}</p></div><?label 0><p>Contact</p>"] * 3
    return pages


def train(spark: SparkSession) -> tuple:
    """The tree as nested ``(feature, threshold, left, right)`` with numbers for leaves."""
    rows = []
    for page in labelled_pages():
        found = blocks(page)
        rows += [(*row, block[7]) for row, block in zip(features(found), found, strict=True)]
    table = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in [*FEATURES, "label"])).coalesce(1)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=6, maxBins=64, minInstancesPerNode=2, seed=3).fit(assembled)

    def walk(node):
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._java_obj.rootNode())


def decide(tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if row[feature] <= threshold else right
    return tree >= 0.5


def main_text(html: str | None, tree) -> str:
    found = blocks(html) if html else []
    return "\n".join(b[0] for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, tree) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page from its whole html.

    Kept blocks are joined by a newline in page order; white space within one becomes a space.  Null or empty html
    gives an empty text; repeated rows give a row each; other columns are left out.  No shuffle.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 2_000, "html", 8_000_000):
            texts = [main_text(html, tree) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", "url", F.coalesce(pages["html"], F.lit("")).alias("html"))
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
