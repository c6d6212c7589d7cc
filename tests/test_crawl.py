"""The crawl, robots rules and schedule against plain Python on small data."""

import random
from collections import deque
from urllib.parse import urlparse
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from leafpress.operators import crawl as C
from leafpress.operators import report as R
from leafpress.operators import robots as B
from leafpress.operators import skew
from leafpress.operators.politeness import polite_schedule
from leafpress.session import cut_lineage


def brute_force(graph, ok, seed, max_depth, max_pages, same_host):
    """Queue-based walk of one seed: [(url, depth, order or None)]."""
    host, queue, visited, out, n = urlparse(seed).netloc, deque([(seed, 0)]), set(), [], 0
    while queue and (max_pages is None or n < max_pages):
        url, depth = queue.popleft()
        if url in visited or depth > max_depth or (same_host and urlparse(url).netloc != host):
            continue
        visited.add(url)
        if not ok.get(url, False):
            out.append((url, depth, None))
            continue
        n += 1
        out.append((url, depth, n))
        queue.extend((link, depth + 1) for link in graph[url] if depth < max_depth)
    return sorted(out)


@pytest.mark.parametrize("max_depth, max_pages, same_host", [(0, None, True), (2, 5, True), (3, None, False), (4, 7, False), (3, 1, True)])
def test_random_graphs(spark, max_depth, max_pages, same_host):
    rnd = random.Random(max_depth * 10 + (max_pages or 0))
    urls = [f"https://h{i % 3}.example.com/{i}" for i in range(40)]
    graph = {u: list(dict.fromkeys(rnd.choice(urls + ["https://h0.example.com/missing"]) for _ in range(4))) for u in urls}
    ok = {u: rnd.random() > 0.2 for u in urls}
    seeds = urls[:6]
    index = spark.createDataFrame([(u, ok[u], graph[u]) for u in urls], "url string, ok boolean, links array<string>")
    seed_rows = spark.createDataFrame(list(enumerate(seeds)), "seed_id long, url string")
    rows = C.crawl(index, seed_rows, max_depth, max_pages, same_host).collect()
    for i, seed in enumerate(seeds):
        got = sorted((r.url, r.crawl_depth, r.crawl_order) for r in rows if r.seed_id == i)
        assert got == brute_force(graph, ok, seed, max_depth, max_pages, same_host)


def test_pages_with_content(spark):
    html = '<article><p>Page {}</p></article><nav><a href="{}">n</a><a href="/x.pdf">f</a></nav>'
    pages = spark.createDataFrame(
        [(i, f"https://a.example.com/{i}", html.format(i, f"/{i + 1}#frag")) for i in range(5)], "page_id long, url string, html string"
    )
    seeds = spark.createDataFrame([(7, "https://a.example.com/0")], "seed_id long, url string")
    out = C.crawl_pages(pages, seeds, max_depth=2).orderBy("crawl_order").collect()
    assert [(r.content, r.crawl_depth, r.crawl_order) for r in out] == [("Page 0", 0, 1), ("Page 1", 1, 2), ("Page 2", 2, 3)]


def test_the_index_is_not_moved_again(spark):
    small = spark.range(100).select(F.col("id").cast("string").alias("url"))
    index = cut_lineage(small.repartition(8, "url"), keep_partitioning=True)
    joined = small.distinct().join(index.hint("merge"), "url")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and joined.count() == 100


ROBOTS = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n", "User-agent: *\nAllow: /a/b\nDisallow: /a", "User-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow: /b c",
    "User-agent: x\nUser-agent: *\nDisallow: /a%20b\n\nUser-agent: *\nDisallow: /", "Disallow: /\nUser-agent: *\n\nDisallow: /a", "User-agent: *\nDisallow:\nDisallow: /",
    "User-agent: *\nCrawl-delay: 3\n\nDisallow: /a", "user-AGENT : *  # all\n  DISALLOW : /a?q # no\n", "", "# nothing", "User-agent: *\nDisallow: /é",
    "User-agent: *\nSitemap: http://s\nDisallow: /a\nnonsense\nDisallow: /x;y", "User-agent: x\nDisallow: /a\nUser-agent: *\nDisallow: /b", "User-agent: *\n\n\nUser-agent: *\nDisallow: /a",
]
PATHS = ["", "/", "/a", "/a/b", "/a/c", "/b", "/b c", "/b%20c", "/a%20b/x", "/a?q=1", "/é", "/%C3%A9/z", "/x;y", "/z"]


def test_robots_rules_are_those_of_the_standard_library(spark):
    robots = spark.createDataFrame([(f"https://r{i}.example.com", 200, t) for i, t in enumerate(ROBOTS)], "origin string, status int, text string")
    urls = [(i, f"https://r{i}.example.com{p}") for i in range(len(ROBOTS)) for p in PATHS]
    got = {r.url: r.allowed for r in B.with_permission(spark.createDataFrame(urls, "i int, url string"), robots).collect()}
    wrong = []
    for i, url in urls:
        parser = RobotFileParser()
        parser.parse(ROBOTS[i].splitlines())
        if got[url] != parser.can_fetch("*", url):
            wrong.append((ROBOTS[i], url, got[url]))
    assert wrong == []


def test_robots_status(spark):
    rows = [("http://a", 401), ("http://b", 403), ("http://c", 404), ("http://d", 500), ("http://e", 200)]
    robots = spark.createDataFrame([(o, s, None) for o, s in rows], "origin string, status int, text string")
    urls = spark.createDataFrame([(f"{o}/x",) for o, _ in rows] + [("http://f/x",)], "url string")
    got = {r.url: r.allowed for r in B.with_permission(urls, robots).collect()}
    assert [got[f"http://{c}/x"] for c in "abcdef"] == [False, False, True, False, True, True]


def test_schedule_is_the_stepwise_rule(spark):
    rnd = random.Random(5)
    rows = [(("hot" if rnd.random() < 0.6 else f"h{rnd.randrange(4)}"), i, rnd.randrange(3000)) for i in range(600)]
    df = spark.createDataFrame(rows, "host string, request_id long, arrival_us long")
    got = {r.request_id: r.start_us for r in polite_schedule(df, 10).collect()}
    last = {}
    for host, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        start = max(at, last[host] + 10) if host in last else at
        last[host] = start
        assert got[i] == start


def test_skew_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 50)
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, skew.skew_join(left, right, ["k"], how).collect())) == want


def test_ranks_over_slices(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("k"))
    rows = skew.ranked(df, ["k"], ["id"], "n").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r.k, r.id)):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.n == seen[r.k]
    assert sorted(r.n for r in skew.ranked(df, [], ["id"], "n").collect()) == list(range(1, 5001))


def test_reports(spark):
    rows = [(1, 1, 0, "https://a.example.com/x", "One", "T"), (1, 2, 1, "https://b.example.com/y", "Two", None), (2, 1, 0, "https://a.example.com/z", "", "U")]
    res = spark.createDataFrame(rows, "seed_id long, crawl_order long, crawl_depth int, url string, content string, title string")
    parts = R.crawl_document(res.filter("seed_id = 1"), "text").orderBy("part_no").collect()
    bar = "=" * 50
    assert "".join(p.part for p in parts) == "\n".join(
        [f"\n\nPage 1 (Depth 0): https://a.example.com/x\n{bar}\n\nOne", f"\n\nPage 2 (Depth 1): https://b.example.com/y\n{bar}\n\nTwo"]
    )
    items = {(r.item, r.key, r.value): r.n for r in R.crawl_summary(res.filter("seed_id = 1")).collect()}
    assert items[("total_pages", None, None)] == 2 and items[("depth", 1, None)] == 1 and ("title", 1, "T") in items
    assert items[("domain", None, "b.example.com")] == 1


def test_progress(spark):
    done = [("ok",)] * 2 + [("error",)] + [(None,)] * 7
    row = R.progress(spark.createDataFrame(done, "status string")).first()
    assert (row.total, row.completed, row.failed, round(row.success_rate, 2), row.percentage) == (10, 3, 1, 66.67, 30.0)
    none = R.progress(spark.createDataFrame([(None,)], "status string")).first()
    assert (none.success_rate, none.percentage) == (0.0, 0.0)


def test_pages_stored_twice_are_one_page(spark):
    from leafpress.sources.pages import one_per_url, resolve_pages

    html = "<html><body><article><p>Fetch {} of the page, long enough to be kept.</p><a href='/b'>b</a></article></body></html>"
    rows = [(1, "https://e.com/a", html.format(1)), (2, "https://e.com/a", html.format(2)), (3, "https://e.com/b", html.format(3)), (3, "https://e.com/b", html.format(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.page_id for r in one_per_url(pages).collect()) == [2, 3]
    seeds = spark.createDataFrame([(7, "https://e.com/a")], "seed_id long, url string")
    got = C.crawl_pages(pages, seeds, max_depth=1).orderBy("crawl_order").collect()
    assert [(r.page_id, r.crawl_order, r.crawl_depth) for r in got] == [(2, 1, 0), (3, 2, 1)]
    assert C.crawl_pages(pages, seeds, max_depth=0).count() == 1
    assert resolve_pages(seeds, pages).count() == 1


def test_robots_corners_as_the_standard_parser(spark):
    files = ["User-agent:\nDisallow: /x", "User-agent: *\nDisallow: /p?", "User-agent: *\nDisallow: /p?q", "User-agent: *\nAllow: /x/y\nDisallow: /x"]
    urls = [f"https://e.com{p}" for p in ("/x", "/x/y", "/p", "/p?q=1", "/", "/px")]
    robots = spark.createDataFrame([(f"https://h{i}.com", 200, t) for i, t in enumerate(files)], "origin string, status int, text string")
    asked = spark.createDataFrame([(i, u.replace("e.com", f"h{i}.com")) for i in range(len(files)) for u in urls], "i int, url string")
    allowed = {(r.i, r.url) for r in B.allowed_only(asked, robots).collect()}
    for i, text in enumerate(files):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for u in urls:
            own = u.replace("e.com", f"h{i}.com")
            assert ((i, own) in allowed) == parser.can_fetch("*", own), (text, own)


def test_a_store_is_not_moved(spark, monkeypatch):
    from leafpress.sources import store as S

    html = "<html><body><article><p>Page {} of the store, long enough to be kept.</p><a href='/{}'>next</a></article></body></html>"
    rows = [(i, f"https://e.com/{i}", html.format(i, i + 1)) for i in range(60)] + [(-1, "https://e.com/3", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    store = S.write_store(pages, buckets=16)
    assert store.pages.count() == 60
    seeds = spark.createDataFrame([(7, "https://e.com/0")], "seed_id long, url string")
    want = [(i, i, i + 1) for i in range(5)]
    for few in (1000, 0):
        monkeypatch.setattr(S, "FEW", few)
        got = C.crawl_pages(store, seeds, max_depth=4).orderBy("crawl_order").collect()
        assert [(r.page_id, r.crawl_depth, r.crawl_order) for r in got] == want
    urls = spark.createDataFrame([(f"https://e.com/{i}",) for i in range(0, 60, 2)], "url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.look_up(urls)
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert found.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the one exchange is that of the URLs, and the scan reads its buckets as they lie
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "parquet" in line and "Bucketed: true" in line)
    above = [line for line in lines[:scan] if "Exchange" in line]
    assert len([line for line in lines if "Exchange" in line]) <= 1 and not above
    monkeypatch.setattr(S, "FEW", 1000)
    plan = store.look_up(urls.limit(2))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "PushedFilters: [In(url, [" in plan and "Exchange" not in plan
    store.drop()
