"""Main text of pages: written pages, the sample pages by their tags, odd rows."""

from __future__ import annotations

import html as entities
import re

import pytest

from millrace.llm import html_main

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark):
    return html_main.train(spark)


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<p>", ""),
    ("<article><h1>A  title</h1><p>One\n two&nbsp;three &lt;x&gt; &eacute;&#233;</p><p>Be.</p></article>", "A title\nOne two three <x> éé\nBe."),
    ("<nav>menu</nav><main><p>Story of <b>bold</b><br>lines</p></main><footer>end</footer>", "Story of bold lines"),
    ("<article><p>Kept text here.</p><div class='comments'><p>Nice!</p></div><aside>Side</aside></article>", "Kept text here."),
    ("<div class=ad>Buy</div><article><p>Only this<script>var t='</p>';</script></p></article><form><p>Name</p></form>", "Only this"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
    ("<article><p>a</p></div></section><p>b</p><footer>f</footer></article>", "a\nb"),
])
def test_written_pages(tree, page, text):
    assert html_main.main_text(page, tree) == text


def test_odd_rows(spark, tree):
    long = "<article>" + "<p>word word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (None, "u", "<article><p>t</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_main.extract(pages, tree).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 20_000 * 11 - 1, 20_000 * 11 - 1]
    assert html_main.extract(pages.limit(0), tree).count() == 0


def test_sample_pages(spark, tree):
    pages = spark.read.parquet(f"{SAMPLE}/pages.parquet")
    got = {r["page_id"]: r for r in html_main.extract(pages, tree).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[row["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["n_chars"] == len(got[row["page_id"]]["text"])
