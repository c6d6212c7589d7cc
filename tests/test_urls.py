"""URL expressions against Python's own URL functions."""

from itertools import product
from urllib.parse import unquote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from leafpress.functions import urls as U

BASES = [
    "https://h.example.com/a/b/page.html?x=1#top", "http://h.example.com", "http://h.example.com/", "http://h.example.com/a//b/c",
    "http://u:p@h.example.com:8080/x/", "https://h.example.com/d?q=/x/../y",
]
REFS = [
    "", "next", "./", "../", "..", ".", "../../..", "../../../../z", "/", "/abs/../x", "/a/./b/", "//cdn.example.com/p", "//cdn.example.com",
    "?q=1", "?", "#f", "a#f", "a?b=c#d", "a;p=1", ";p", "a/b/../c", "a//b", "a/./", "http://o.example.com/x/../y", "https://o.example.com",
    "mailto:a@b", "http:rel", "/x?y=/../z", "a b", "é/ü", "..x/y", "x/..", " lead", "tab\there",
]


def test_join_is_that_of_the_standard_library(spark):
    pairs = list(product(BASES, REFS))
    df = spark.createDataFrame(pairs, "base string, ref string")
    got = {(r.base, r.ref): r.u for r in df.withColumn("u", U.join(F.col("base"), F.col("ref"))).collect()}
    # an empty query or fragment mark is dropped by the library; links drop it later here
    wrong = [(b, r, got[b, r], urljoin(b, r)) for b, r in pairs if got[b, r].rstrip("?") != urljoin(b, r)]
    assert wrong == []


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://a.example.com/x.PDF", False), ("https://a.example.com/x.pdf?y=1", False), ("https://a.example.com/x?y=.pdf", True),
        ("https://zip.example.zip", True), ("https://a.example.com/a.zip/", True), ("ftp://a.example.com/x", False), ("http:///x", False),
        ("/x", False), ("https://a.example.com/x.js;v=1", False), ("https://a.example.com/xml", True),
    ],
)
def test_crawlable(spark, url, ok):
    assert spark.range(1).select(U.is_crawlable(F.lit(url))).first()[0] is ok


def test_parts(spark):
    urls = [b for b in BASES] + ["file:///x/y", "x", "/p/q;z", "HTTP://Up.example.com/A;b?c#d"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    c = F.col("u")
    for r in df.select("u", U.scheme(c).alias("s"), U.netloc(c).alias("n"), U.path(c).alias("p")).collect():
        want = urlparse(r.u)
        assert (r.s, r.n) == (want.scheme, want.netloc)
        if want.scheme in ("http", "https"):
            assert r.p == want.path


def test_percent_decode(spark):
    texts = ["/a%20b", "/a+b", "100%", "%zz%41", "/%C3%A9", "plain", "%2", "a%2Fb%2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", U.percent_decode(F.col("t")).alias("d")).collect():
        assert r.d == unquote(r.t)


def test_defragment_twice_changes_nothing(spark):
    df = spark.createDataFrame([(u,) for u in BASES + ["http://x/a?#b", "http://x/a#b#c"]], "u string")
    once = U.defragment(F.col("u"))
    assert df.filter(U.defragment(once) != once).count() == 0
    assert df.filter(once.contains("#")).count() == 0
