"""URL verdicts against a plain reading of the rules, and the model on unseen urls."""

from __future__ import annotations

import re

import pytest

from millrace.llm import url_filter
from millrace.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1", "https://example.net/en", "https://example.net/en/?q=/de/",
    "http://example.net", "http://net/", "http://xnet/", "http://a.net/x", "http://a.example.com/de/9", "http://example.com/DE/9",
    "http://a.org/fr/x", "http://a.org?x=/fr/", "http://a.org#/fr/", "mailto:x://y.net/z", "http://ÄB.net/é", "http://a.net:80/", "x" * 5000,
]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(spark)


def test_rules(spark, model):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = url_filter.judge(pages, URL_RULES, model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, (rule, verdict) = by_hand(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
        if not host and not rule:
            assert r["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), URL_RULES, model).count() == 0


def test_unseen_urls(spark, model):
    bad = ["http://m.casino-king.example.com/en/4", "https://www.adult-clips.example.org/de/81.html", "http://super-cheap-pills.test/es/2",
           "http://ads-tracking.example.com/fr/9", "http://big-spam-farm.example.com/en/7", "http://win-free-bets.example.org/en/12"]
    good = ["http://www.orchestra.example.com/en/4", "https://thoning.example.org/de/81.html", "http://m.newspaper.test/es/2",
            "http://blog.hentian.example.com/fr/9", "http://chess-club.example.com/en/7", "http://river.example.org/en/12"]
    rows = [(i, u) for i, u in enumerate(bad + good)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), [], model).collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] < len(bad)) for r in got)
    assert right >= 11
