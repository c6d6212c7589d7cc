"""Checks of links, robots rules, the crawl and its summaries.

The stored pages are linked into one binary tree per host (page n of a host
links to 2n, 2n + 1 and back to 1) with one more link to the next page of the
whole table, which mostly lies on another host.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import pages, spread_table, table
from checks.extract_checks import TITLE, content_sql
from leafpress.functions import urls as U
from leafpress.operators import crawl as C
from leafpress.operators import links as L
from leafpress.operators import report as R
from leafpress.operators import robots as B
from leafpress.operators.politeness import polite_schedule
from leafpress.operators.skew import ranked, skew_join
from leafpress.session import cut_lineage
from leafpress.sources.store import write_store

# href and the link it gives on a page at BASE; NULL where it is skipped
BASE = "https://h.example.com/a/b/page.html?x=1#top"
REFS = [
    ("https://other.example.com/x/../y", "https://other.example.com/x/../y"),
    ("//cdn.example.com/p?q=1", "https://cdn.example.com/p?q=1"),
    ("/root/a#frag", "https://h.example.com/root/a"),
    ("next", "https://h.example.com/a/b/next"),
    ("../up/./z", "https://h.example.com/a/up/z"),
    ("../../../over", "https://h.example.com/over"),
    ("?page=2", "https://h.example.com/a/b/page.html?page=2"),
    ("c/d/..", "https://h.example.com/a/b/c/"),
    ("#here", None),
    ("mailto:a@example.com", None),
    (" /p?a=1&amp;b=2 ", "https://h.example.com/p?a=1&b=2"),
    ("HTTPS://UP.example.com/K;v=1#z", "https://UP.example.com/K;v=1"),
    ("file.PDF", "https://h.example.com/a/b/file.PDF"),
    ("ftp://h.example.com/f", "ftp://h.example.com/f"),
    ("tail?", "https://h.example.com/a/b/tail"),
    ("./", "https://h.example.com/a/b/"),
]
CRAWLABLE = [bool(t) and t.startswith("http") and not t.endswith("PDF") for _, t in REFS]


def _case(values, key):
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v + "'"

    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def link_pages(spark, sf):
    """One page per order with two links, the second of them twice."""
    second = "CAST((o_orderkey DIV 16) % 16 AS INT)"
    refs = _case([r for r, _ in REFS], "CAST(o_orderkey % 16 AS INT)"), _case([r for r, _ in REFS], second)
    html = f"""concat('<p><!-- <a href="/no">x</a> --><a href="', {refs[0]}, '">one</a> <A class=k HREF=''', {refs[1]}, '''>two</A><a name="n">t</a><a href="', {refs[1]}, '">again</a>')"""
    return spread_table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), F.expr(html).alias("html"))


TARGETS = [t for _, t in REFS]
LINK_ROWS = f"""SELECT o_orderkey AS page_id, 0 AS slot, {_case(TARGETS, 'o_orderkey % 16')} AS t, {_case(CRAWLABLE, 'o_orderkey % 16')} AS good FROM orders
UNION ALL SELECT o_orderkey, 1, {_case(TARGETS, '(o_orderkey // 16) % 16')}, {_case(CRAWLABLE, '(o_orderkey // 16) % 16')} FROM orders
UNION ALL SELECT o_orderkey, 2, {_case(TARGETS, '(o_orderkey // 16) % 16')}, {_case(CRAWLABLE, '(o_orderkey // 16) % 16')} FROM orders"""


def page_links_abs(spark, sf):
    raw = L.raw_link_table(link_pages(spark, sf))
    return raw.select("page_id", "pos", L.clean_link(F.col("url"), F.col("href")).alias("link"))


def links_crawlable(spark, sf):
    return page_links_abs(spark, sf).withColumn("crawlable", U.is_crawlable(F.col("link")))


def links_distinct(spark, sf):
    return L.link_table(link_pages(spark, sf)).select("page_id", "pos", "dst_url")


# links lose their fragment, so the pages of the crawl get URLs without one
LINKED_URL = "concat(regexp_replace(url, '[#?].*$', ''), '?id=', page_id)"
LINKED = f"(SELECT page_id, {LINKED_URL} AS url FROM pages)"


def linked_pages(spark, sf):
    base = table(spark, sf, "pages").select("page_id", F.expr(LINKED_URL).alias("url"), U.netloc(F.col("url")).alias("host"))
    n = ranked(base, ["host"], ["page_id"], "n")
    targets = n.select("host", F.col("n").alias("to"), F.col("url").alias("dst"))
    wanted = n.select("page_id", "host", F.posexplode(F.array(F.col("n") * 2, F.col("n") * 2 + 1, F.lit(1).cast("long"))).alias("pos", "to"))
    edges = skew_join(wanted, targets, ["host", "to"]).select("page_id", "pos", "dst")
    across = n.select((F.col("page_id") - 1).alias("page_id"), F.lit(3).alias("pos"), F.col("url").alias("dst"))
    # at most four links per page
    links = edges.unionByName(across).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("l"))
    anchors = F.array_join(F.transform("l", lambda e: F.concat(F.lit('<a href="'), F.replace(e["dst"], F.lit("&"), F.lit("&amp;")), F.lit('">x</a>'))), "")
    nav = F.concat(F.lit("<nav>"), F.coalesce(anchors, F.lit("")), F.lit("</nav>"))
    # the stored page with the anchors of the tree put in; its own ones lead nowhere, and every seventh page has no content
    stored = table(spark, sf, "pages").select("page_id", F.col("html").alias("stored"))
    own = F.regexp_replace("stored", "<a href=", "<a data-href=")
    html = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("<html><body>"), nav, F.lit("</body></html>"))).otherwise(F.replace(own, F.lit("<body>"), F.concat(F.lit("<body>"), nav)))
    return cut_lineage(n.join(links, "page_id", "left").join(stored, "page_id").select("page_id", "url", "host", "n", html.alias("html")))


def seeds_of(linked):
    return linked.filter("n = 1").select(F.col("page_id").alias("seed_id"), "url")


ROBOTS_TEXT = "concat('# rules', chr(10), 'User-agent: other', chr(10), 'Disallow: /', chr(10), chr(10), 'User-Agent: *', chr(10), 'Allow: /de/1', chr(10), 'Disallow: /de/', chr(10), 'Disallow:', chr(10))"


def page_robots(spark, sf):
    """robots.txt by kind of host: rules on blog, 403 on m, 404 on www, none elsewhere."""
    host = F.regexp_extract("origin", "//([a-z]+)[.]", 1)
    origins = table(spark, sf, "pages").select(U.origin(F.col("url")).alias("origin")).distinct()
    status = F.when(host == "blog", 200).when(host == "m", 403).when(host == "www", 404)
    return origins.withColumn("status", status).filter("status IS NOT NULL").withColumn("text", F.expr(ROBOTS_TEXT))


ALLOWED = """CASE WHEN regexp_matches(url, '//m[.]') THEN false
  WHEN regexp_matches(url, '//blog[.]') THEN regexp_matches(url, '^[a-z]+://[^/]*/de/1') OR NOT regexp_matches(url, '^[a-z]+://[^/]*/de/') ELSE true END"""


def crawl_run(spark, sf, with_robots=False, **options):
    linked = linked_pages(spark, sf)
    robots = page_robots(spark, sf) if with_robots else None
    return C.crawl(C.page_index(linked), seeds_of(linked), robots=robots, **options)


def walk_sql(depth, cap=None, where="true"):
    return f"""WITH RECURSIVE p AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]*)', 1) AS host, page_id % 7 <> 3 AS ok, {ALLOWED} AS allowed FROM {LINKED}),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p),
walk AS (SELECT host, n, 0 AS d, ok, url, page_id AS seed_id FROM n WHERE n = 1 AND ({where})
  UNION ALL SELECT n.host, n.n, w.d + 1, n.ok, n.url, w.seed_id FROM walk w JOIN n ON n.host = w.host AND n.n IN (2 * w.n, 2 * w.n + 1) WHERE w.ok AND w.d < {depth} AND ({where.replace('allowed', 'n.allowed')})),
o AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM walk),
crawled AS (SELECT seed_id, url, d AS crawl_depth, CASE WHEN ok THEN CAST(before + 1 AS BIGINT) END AS crawl_order, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, n FROM o{'' if cap is None else f' WHERE before < {cap}'})
"""


PLAIN = "SELECT seed_id, url, crawl_depth, crawl_order, status FROM crawled"


def crawl_any_host(spark, sf):
    return crawl_run(spark, sf, max_depth=1, max_pages=None, same_domain_only=False)


ANY_HOST = f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]*)', 1) AS host, page_id % 7 <> 3 AS ok FROM {LINKED}),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p),
e AS (SELECT s.page_id AS seed_id, CASE t.n WHEN 2 THEN 0 ELSE 1 END AS pos, t.url FROM n s JOIN n t ON t.host = s.host AND t.n IN (2, 3) WHERE s.n = 1 AND s.ok
  UNION ALL SELECT s.page_id, 3, t.url FROM n s JOIN n t ON t.page_id = s.page_id + 1 WHERE s.n = 1 AND s.ok),
f AS (SELECT seed_id, url, min(pos) AS pos FROM e GROUP BY 1, 2),
g AS (SELECT f.seed_id, f.url, f.pos, coalesce(n.ok, false) AS ok FROM f LEFT JOIN n USING (url)),
all_rows AS (SELECT page_id AS seed_id, url, 0 AS crawl_depth, -1 AS pos, ok FROM n WHERE n = 1 UNION ALL SELECT seed_id, url, 1, pos, ok FROM g)
SELECT seed_id, url, crawl_depth, CASE WHEN ok THEN CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY seed_id ORDER BY crawl_depth, pos) AS BIGINT) END AS crawl_order,
  CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status FROM all_rows"""


def crawl_results(spark, sf):
    from leafpress.operators.crawl import crawl_pages

    linked = linked_pages(spark, sf)
    out = crawl_pages(linked.select("page_id", "url", "html"), seeds_of(linked), max_depth=3, max_pages=None)
    return out.withColumn("title", F.col("metadata.title"))


def crawl_repeated_pages(spark, sf):
    """Every third page is stored a second time, earlier and with another text, every fifth twice without an id: the latest is read, and counts once."""
    linked = linked_pages(spark, sf).select("page_id", "url", "html")
    old = linked.filter("page_id % 3 = 0").select((F.col("page_id") - 1_000_000).alias("page_id"), "url", F.lit("<html><body><p>old</p></body></html>").alias("html"))
    bare = linked.filter("page_id % 5 = 0").select(F.lit(None).cast("long").alias("page_id"), "url", F.lit("<html><body><p>none</p></body></html>").alias("html"))
    seeds = seeds_of(linked_pages(spark, sf))
    return C.crawl_pages(linked.unionByName(old).unionByName(bare).unionByName(bare), seeds, max_depth=3, max_pages=None).select(
        "seed_id", "page_id", "crawl_depth", "crawl_order", "content"
    )


def crawl_store(spark, sf):
    """The walk over a bucketed store that is written once."""
    linked = linked_pages(spark, sf)
    store = write_store(linked.select("page_id", "url", "html"))
    found = C.crawl_pages(store, seeds_of(linked), max_depth=3, max_pages=None).select("seed_id", "page_id", "crawl_depth", "crawl_order", "content")
    done = cut_lineage(found)
    store.drop()
    return done


NOSCRIPT = """concat('<noscript><a href="/ns', page_id, '">n</a></noscript><template><a href="/t">t</a></template><!-- <a href="/c">c</a> --><script>"<a href=\\"/s\\">"</script>', html)"""


def noscript_links(spark, sf):
    """Links within noscript and template elements count, those in comments and scripts do not."""
    return L.raw_link_table(pages(spark, sf).withColumn("html", F.expr(NOSCRIPT))).select("page_id", "pos", "href")


RESULTS = f"""{content_sql()},
res AS (SELECT c.*, page_id, content, {TITLE} AS title FROM crawled c JOIN {LINKED} l USING (url) JOIN content USING (page_id) JOIN (SELECT page_id, html FROM pages) h USING (page_id) WHERE status = 'ok')"""
SUMMARY = f"""{walk_sql(3)}, {RESULTS}
SELECT seed_id, 'total_pages' AS item, CAST(NULL AS BIGINT) AS key, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM res GROUP BY 1
UNION ALL SELECT seed_id, 'depth', crawl_depth, NULL, count(*) FROM res GROUP BY 1, 3
UNION ALL SELECT seed_id, 'domain', NULL, regexp_extract(url, '//([^/?#]*)', 1), count(*) FROM res GROUP BY 1, 4
UNION ALL SELECT seed_id, 'title', crawl_order, title, 1 FROM res"""


def customer_robots(spark, sf):
    """Rule files of six kinds, one per customer."""
    text = """CASE c_custkey % 6
      WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /priv', chr(10), 'Allow: /priv/open', chr(10))
      WHEN 1 THEN concat('User-agent: *', chr(13), chr(10), 'Allow: /priv/open # ok', chr(13), chr(10), 'Disallow: /priv')
      WHEN 2 THEN concat('User-agent: bot', chr(10), 'User-agent: *', chr(10), 'Crawl-delay: 2', chr(10), 'Disallow: /a%20b', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
      WHEN 3 THEN concat('Disallow: /', chr(10), 'User-agent: *', chr(10), chr(10), 'Disallow: /x')
      WHEN 4 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'Disallow: /')
      ELSE 'User-agent: *\nDisallow: /' END"""
    return table(spark, sf, "customer").select(
        F.expr("concat('http://c', c_custkey, '.example.com')").alias("origin"),
        F.expr("CASE WHEN c_custkey % 12 = 5 THEN 503 WHEN c_custkey % 12 = 11 THEN 410 ELSE 200 END").alias("status"),
        F.expr(text).alias("text"),
    )


def robots_rules(spark, sf):
    urls = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("concat('http://c', o_custkey, '.example.com', CASE o_orderkey % 5 WHEN 0 THEN '/priv/open/1' WHEN 1 THEN '/priv/x' WHEN 2 THEN '/a b' WHEN 3 THEN '' ELSE '/x?q=1' END)").alias("url")
    )
    return B.with_permission(urls, customer_robots(spark, sf)).select("o_orderkey", "allowed")


def requests(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("host"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us")
    )


def schedule(spark, sf):
    return polite_schedule(requests(spark, sf), 3_600_000_000).select("host", "request_id", "n", "start_us")


def frontier_antijoin(spark, sf):
    """Orders as links of customers: new parts per customer that were not seen before 1996."""
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    links = o.select(
        F.col("o_custkey").alias("seed_id"), F.lit("h").alias("seed_host"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("url"),
        F.col("o_orderkey").alias("parent_order"), F.col("l_linenumber").alias("pos"), (F.col("o_orderdate") < "1996-01-01").alias("old"),
    )
    visited = links.filter("old").select("seed_id", "url").distinct()
    return C.next_frontier(links.filter("NOT old"), visited).select("seed_id", "url", "parent_order", "pos")


QUERIES = {
    "page_links_raw": lambda s, sf: L.raw_link_table(pages(s, sf)),
    "page_links_abs": page_links_abs,
    "url_defrag": lambda s, sf: pages(s, sf).select("page_id", U.defragment(F.col("url")).alias("url")),
    "links_crawlable": links_crawlable,
    "links_distinct": links_distinct,
    "robots_filter": lambda s, sf: B.allowed_only(pages(s, sf).select("page_id", "url"), page_robots(s, sf)),
    "robots_rules": robots_rules,
    "frontier_antijoin": frontier_antijoin,
    "crawl_bfs": lambda s, sf: crawl_run(s, sf, max_depth=3, max_pages=None),
    "crawl_same_host": lambda s, sf: crawl_run(s, sf, max_depth=1, max_pages=None),
    "crawl_any_host": crawl_any_host,
    "crawl_max_pages": lambda s, sf: crawl_run(s, sf, max_depth=3, max_pages=4),
    "crawl_with_robots": lambda s, sf: crawl_run(s, sf, with_robots=True, max_depth=2, max_pages=10),
    "crawl_failures": lambda s, sf: crawl_run(s, sf, max_depth=2, max_pages=3).filter("status = 'failed'"),
    "crawl_document": lambda s, sf: R.crawl_document(crawl_results(s, sf)),
    "crawl_count": lambda s, sf: R.crawl_count(crawl_results(s, sf)),
    "crawl_urls": lambda s, sf: R.crawl_urls(crawl_results(s, sf)),
    "crawl_by_depth": lambda s, sf: R.by_depth(crawl_results(s, sf), 1).select("seed_id", "url"),
    "crawl_summary": lambda s, sf: R.crawl_summary(crawl_results(s, sf)),
    "crawl_repeated_pages": crawl_repeated_pages,
    "crawl_store": crawl_store,
    "noscript_links": noscript_links,
    "polite_schedule": schedule,
}
ORACLES = {
    "page_links_raw": r"""SELECT page_id, url, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
    "page_links_abs": f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY slot) - 1 AS INT) AS pos, t AS link FROM ({LINK_ROWS}) WHERE t IS NOT NULL",
    "url_defrag": "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages",
    "links_crawlable": f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY slot) - 1 AS INT) AS pos, t AS link, good AS crawlable FROM ({LINK_ROWS}) WHERE t IS NOT NULL",
    "links_distinct": f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(slot)) - 1 AS INT) AS pos, t AS dst_url FROM ({LINK_ROWS}) WHERE good GROUP BY page_id, t",
    "robots_filter": f"SELECT page_id, url FROM pages WHERE {ALLOWED}",
    "robots_rules": """SELECT o_orderkey, CASE
  WHEN o_custkey % 12 = 5 THEN false WHEN o_custkey % 12 = 11 THEN true
  WHEN o_custkey % 6 = 0 THEN o_orderkey % 5 > 1
  WHEN o_custkey % 6 = 1 THEN o_orderkey % 5 <> 1
  WHEN o_custkey % 6 = 2 THEN o_orderkey % 5 <> 2
  ELSE true END AS allowed FROM orders""",
    "frontier_antijoin": """WITH l AS (SELECT o_custkey AS seed_id, 'p' || (l_partkey % 50) AS url, o_orderkey AS parent_order, l_linenumber AS pos, o_orderdate < DATE '1996-01-01' AS old FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT seed_id, url, parent_order, pos FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, url ORDER BY parent_order, pos) AS rn FROM l a
WHERE NOT old AND NOT EXISTS (SELECT 1 FROM l b WHERE b.old AND b.seed_id = a.seed_id AND b.url = a.url)) WHERE rn = 1""",
    "crawl_bfs": walk_sql(3) + PLAIN,
    "crawl_same_host": walk_sql(1) + PLAIN,
    "crawl_any_host": ANY_HOST,
    "crawl_max_pages": walk_sql(3, 4) + PLAIN,
    "crawl_with_robots": walk_sql(2, 10, "allowed") + PLAIN,
    "crawl_failures": walk_sql(2, 3) + PLAIN + " WHERE status = 'failed'",
    "crawl_document": f"{walk_sql(3)}, {RESULTS} SELECT seed_id, crawl_order AS part_no, CASE WHEN crawl_order = 1 THEN '' ELSE chr(10) END || chr(10) || chr(10) || '# Page ' || crawl_order || ' (Depth ' || crawl_depth || '): ' || url || chr(10) || chr(10) || content AS part FROM res",
    "crawl_count": f"{walk_sql(3)} SELECT seed_id, count(*) AS n_pages FROM crawled WHERE status = 'ok' GROUP BY 1",
    "crawl_urls": f"{walk_sql(3)} SELECT seed_id, crawl_order, url FROM crawled WHERE status = 'ok'",
    "crawl_by_depth": f"{walk_sql(3)} SELECT seed_id, url FROM crawled WHERE status = 'ok' AND crawl_depth = 1",
    "crawl_summary": SUMMARY,
    "crawl_repeated_pages": f"{walk_sql(3)}, {RESULTS} SELECT seed_id, page_id, crawl_depth, crawl_order, content FROM res",
    "crawl_store": f"{walk_sql(3)}, {RESULTS} SELECT seed_id, page_id, crawl_depth, crawl_order, content FROM res",
    "noscript_links": """WITH l AS (SELECT page_id, list_concat(['/ns' || page_id, '/t'], regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS l FROM pages)
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS href FROM l""",
    "polite_schedule": """WITH r AS (SELECT user_id AS host, event_id AS request_id, epoch_us(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT host, request_id, n, max(a - 3600000000 * n) OVER (PARTITION BY host ORDER BY n) + 3600000000 * n AS start_us FROM r""",
}
