"""Checks of URL lists and URL patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import spread_table, table
from leafpress.functions import urls as U
from leafpress.operators import globs as G
from leafpress.plans.batch import run_list
from leafpress.sources import url_lists as L

# one small list file per order, with all three line ends
LIST_TEXT = """concat(CASE WHEN o_orderkey % 4 = 0 THEN '# nothing here' ELSE concat('  https://s', o_custkey, '.example.com/p  ') END, chr(13), chr(10),
  '# note', chr(13), chr(10), CASE WHEN o_orderkey % 3 = 0 THEN 'not-a-url' ELSE '' END, chr(13),
  CASE WHEN o_orderkey % 4 = 0 THEN 'ftp://x' WHEN o_orderkey % 5 = 0 THEN '/data/page.html' ELSE 'file:///tmp/a.html' END, chr(10), ' ', chr(10))"""


def list_files(spark, sf):
    return spread_table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("file"), F.expr(LIST_TEXT).alias("text"))


LINES_SQL = """lines AS (SELECT o_orderkey AS file, * FROM (
  SELECT o_orderkey, 1 AS line_no, CASE WHEN o_orderkey % 4 = 0 THEN '# nothing here' ELSE 'https://s' || o_custkey || '.example.com/p' END AS line FROM orders
  UNION ALL SELECT o_orderkey, 2, '# note' FROM orders
  UNION ALL SELECT o_orderkey, 3, CASE WHEN o_orderkey % 3 = 0 THEN 'not-a-url' ELSE '' END FROM orders
  UNION ALL SELECT o_orderkey, 4, CASE WHEN o_orderkey % 4 = 0 THEN 'ftp://x' WHEN o_orderkey % 5 = 0 THEN '/data/page.html' ELSE 'file:///tmp/a.html' END FROM orders
  UNION ALL SELECT o_orderkey, 5, '' FROM orders)),
good AS (SELECT file, line_no, line AS url FROM lines WHERE regexp_matches(line, '^(https?://|file://|/)'))"""

HOST = "concat('http://p', p_partkey, '.example.com/')"
FORMS = {
    "numeric": "CASE p_partkey % 3 WHEN 0 THEN concat('[1-', p_size, ']') WHEN 1 THEN concat('[08-', p_size, ']') ELSE concat('[1-', p_size, ':7]') END",
    "alpha": "CASE p_partkey % 3 WHEN 0 THEN '[a-e]' WHEN 1 THEN '[X-Z]' ELSE '[e-a]' END",
    "list": "CASE p_partkey % 2 WHEN 0 THEN '{x, y,x}' ELSE concat('{', p_brand, ',,b}') END",
    "cross": "'{a,b}/v[1-2]/[a-b]'",
    "mixed": "CASE p_partkey % 5 WHEN 0 THEN concat('[1-', p_size, ']') WHEN 1 THEN '[a-Z]' WHEN 2 THEN '{[1-2],x}' WHEN 3 THEN 'plain' ELSE '[1-3][1-13]' END",
}


def globs(spark, sf, form):
    return spread_table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("seed_id"), F.expr(f"concat({HOST}, {FORMS[form]})").alias("url"))


def expanded(form):
    def run(spark, sf):
        return G.expand_globs(globs(spark, sf, form)).select("seed_id", "ordinal", "url")

    return run


def glob_parse(spark, sf):
    src = globs(spark, sf, "cross").withColumn("url", F.concat("url", F.expr("concat('[00', seed_id, '-9', seed_id, ':3]')")))
    return (
        src.select("seed_id", F.posexplode(G.glob_patterns(F.col("url"))).alias("n", "p"))
        .select("seed_id", "n", "p.pattern", "p.type", "p.start", "p.end", "p.step", "p.pad", F.array_join("p.items", "|").alias("items"))
    )


def glob_dedupe(spark, sf):
    src = table(spark, sf, "part").select(F.col("p_partkey").alias("seed_id"), F.expr(f"concat({HOST}, '[1-2][1-12]')").alias("url"))
    return G.expand_globs(src).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"))


def glob_large(spark, sf):
    """Products beyond the in-row bound, cut over tasks."""
    src = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed_id"), F.expr("concat('http://s', s_suppkey, '.example.com/[1-9][1-99]')").alias("url"))
    return G.expand_globs(src, in_row=64).select("seed_id", "ordinal", "url")


VALID = "CASE o_orderkey % 5 WHEN 0 THEN concat('https://a.example.com/', o_orderkey) WHEN 1 THEN concat('file:///x/', o_orderkey) WHEN 2 THEN 'invalid-url' WHEN 3 THEN concat('ftp://h', o_custkey) ELSE '/path' END"


def url_valid(spark, sf):
    src = table(spark, sf, "orders").select("o_orderkey", F.expr(VALID).alias("url"))
    return src.filter(U.has_scheme_and_host(F.col("url")))


def source_kind(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(VALID).alias("url")).withColumn("kind", U.source_kind(F.col("url")))


BATCH = "CASE p_partkey % 4 WHEN 0 THEN concat('/data/[1-', p_size, '].html') WHEN 1 THEN concat('https://b.example.com/', p_partkey) WHEN 2 THEN concat('https://b.example.com/[1-', p_size, ']') ELSE '/data/page.html' END"
BATCH_SQL = """SELECT p_partkey AS line_no, 0 AS ordinal, CASE p_partkey % 4 WHEN 1 THEN 'https://b.example.com/' || p_partkey ELSE '/data/page.html' END AS url FROM part WHERE p_partkey % 4 IN (1, 3)
UNION ALL SELECT p_partkey, i - 1, 'https://b.example.com/' || i FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS i FROM part WHERE p_partkey % 4 = 2)"""


def batch_lines(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.expr(BATCH).alias("url"))


def batch_expand(spark, sf):
    return G.expand_list(batch_lines(spark, sf)).select("line_no", "ordinal", "url")


def batch_expand_counts(spark, sf):
    return G.expansion_counts(G.expand_list(batch_lines(spark, sf)), ["line_no"])


def glob_repeats(spark, sf):
    """Equal rows stay apart, whichever way a product is expanded."""
    src = globs(spark, sf, "cross")
    src = src.unionByName(src)
    out = None
    for in_row in (1, 4, 4096):
        part = G.expand_globs(src, in_row=in_row).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("ordinal").alias("ordinals"))
        part = part.withColumn("in_row", F.lit(in_row))
        out = part if out is None else out.unionByName(part)
    return out


REJECTS = "CASE p_partkey % 5 WHEN 0 THEN 'https://b.example.com/[1-9:0]' WHEN 1 THEN 'https://b.example.com/[1-2]' WHEN 2 THEN 'no url' WHEN 3 THEN 'https://b.example.com/[99999999999999999998-99999999999999999999]' ELSE '/data/[1-3].html' END"


def batch_rejects(spark, sf):
    lines = table(spark, sf, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_no"), F.expr(REJECTS).alias("line"))
    return run_list(lines, table(spark, sf, "pages")).select("line_no", "ordinal", "url", "status")


#: Patterns whose head is a list: some of their URLs have a host, none has, or all have.
HEADS = """CASE p_partkey % 3 WHEN 0 THEN concat('http://{,h', p_partkey, '.example.com}/[1-2]') WHEN 1 THEN concat('{http:,}/', p_partkey, '/[1-2]') ELSE concat('{http,https}://h', p_partkey, '.example.com/') END"""


def glob_list_heads(spark, sf):
    """A line is either expanded or rejected, never both."""
    lines = table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.expr(HEADS).alias("url"))
    return G.expand_list(lines, keep_rejected=True).select("line_no", "url", "status")


def glob_ignored(spark, sf):
    """One call for a table of URLs: expanded and validated, or left alone."""
    src = globs(spark, sf, "mixed")
    both = [G.expand_urls(src, ignore_glob=ignored).select("seed_id", F.lit(ignored).alias("ignored"), "ordinal", "url") for ignored in (False, True)]
    return both[0].unionByName(both[1])


QUERIES = {
    "glob_list_heads": glob_list_heads,
    "glob_ignored": glob_ignored,
    "glob_repeats": glob_repeats,
    "batch_rejects": batch_rejects,
    "url_list_clean": lambda s, sf: L.url_lines(L.lines_of(list_files(s, sf))),
    "url_list_rejects": lambda s, sf: L.rejected_lines(L.lines_of(list_files(s, sf))),
    "url_list_summary": lambda s, sf: L.list_summary(L.lines_of(list_files(s, sf))),
    "source_kind": source_kind,
    "glob_detect": lambda s, sf: globs(s, sf, "mixed").select("seed_id", G.has_glob(F.col("url")).alias("is_glob")),
    "glob_parse": glob_parse,
    "glob_numeric": expanded("numeric"),
    "glob_alpha": expanded("alpha"),
    "glob_list": expanded("list"),
    "glob_cross": expanded("cross"),
    "glob_mixed": expanded("mixed"),
    "glob_dedupe": glob_dedupe,
    "glob_large": glob_large,
    "url_valid": url_valid,
    "batch_expand": batch_expand,
    "batch_expand_counts": batch_expand_counts,
}
H = "'http://p' || p_partkey || '.example.com/'"
LARGE = """SELECT s_suppkey AS seed_id, min((a - 1) * 99 + b - 1) AS ordinal, 'http://s' || s_suppkey || '.example.com/' || a || b AS url
FROM (SELECT s_suppkey, unnest(range(1, 10)) AS a FROM supplier) CROSS JOIN (SELECT unnest(range(1, 100)) AS b) GROUP BY s_suppkey, a || b"""
ORACLES = {
    "glob_repeats": "SELECT p_partkey AS seed_id, 16 AS n_urls, 56 AS ordinals, in_row FROM part CROSS JOIN (SELECT unnest([1, 4, 4096]) AS in_row)",
    "batch_rejects": """SELECT p_partkey AS line_no, 0 AS ordinal, CASE p_partkey % 5 WHEN 0 THEN 'https://b.example.com/[1-9:0]' WHEN 2 THEN 'no url' ELSE '/data/[1-3].html' END AS url, 'rejected' AS status FROM part WHERE p_partkey % 5 IN (0, 2, 4)
UNION ALL SELECT p_partkey, i, 'https://b.example.com/' || (i + 1), 'no_page' FROM part CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, i, 'https://b.example.com/9999999999999999999' || (8 + i), 'no_page' FROM part CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 5 = 3""",
    "url_list_clean": f"WITH {LINES_SQL} SELECT * FROM good",
    "url_list_rejects": f"WITH {LINES_SQL} SELECT file, line_no, line FROM lines WHERE line <> '' AND line NOT LIKE '#%' AND NOT regexp_matches(line, '^(https?://|file://|/)')",
    "url_list_summary": f"WITH {LINES_SQL} SELECT file, count(url) > 0 AS ok, CASE WHEN count(url) > 0 THEN 'Found ' || count(url) || ' URLs in batch file' ELSE 'Batch file contains no valid URLs' END AS message FROM lines LEFT JOIN good USING (file, line_no) GROUP BY file",
    "source_kind": f"SELECT o_orderkey, {VALID} AS url, CASE WHEN o_orderkey % 5 < 2 THEN 'url' ELSE 'path' END AS kind FROM orders",
    "glob_detect": "SELECT p_partkey AS seed_id, p_partkey % 5 NOT IN (1, 3) AS is_glob FROM part",
    "glob_parse": """SELECT p_partkey AS seed_id, n, pattern, type, start, "end", step, pad, items FROM (
  SELECT p_partkey, 0 AS n, '[1-2]' AS pattern, 'numeric_range' AS type, '1' AS start, '2' AS "end", 1 AS step, 1 AS pad, NULL AS items FROM part
  UNION ALL SELECT p_partkey, 1, '[00' || p_partkey || '-9' || p_partkey || ':3]', 'numeric_range', '00' || p_partkey, '9' || p_partkey, 3, length('00' || p_partkey), NULL FROM part
  UNION ALL SELECT p_partkey, 2, '[a-b]', 'alpha_range', 'a', 'b', 1, 0, NULL FROM part
  UNION ALL SELECT p_partkey, 3, '{a,b}', 'list', NULL, NULL, 1, 0, 'a|b' FROM part)""",
    "glob_numeric": f"""SELECT p_partkey AS seed_id, CASE p_partkey % 3 WHEN 0 THEN i - 1 WHEN 1 THEN i - 8 ELSE (i - 1) // 7 END AS ordinal,
  {H} || CASE WHEN p_partkey % 3 = 1 THEN lpad(CAST(i AS VARCHAR), 2, '0') ELSE CAST(i AS VARCHAR) END AS url
FROM (SELECT p_partkey, unnest(range(CASE WHEN p_partkey % 3 = 1 THEN 8 ELSE 1 END, p_size + 1, CASE WHEN p_partkey % 3 = 2 THEN 7 ELSE 1 END)) AS i FROM part)""",
    "glob_alpha": f"""SELECT p_partkey AS seed_id, i AS ordinal, {H} || chr(CAST(CASE WHEN p_partkey % 3 = 0 THEN 97 ELSE 88 END + i AS INT)) AS url
FROM (SELECT p_partkey, unnest(range(0, CASE p_partkey % 3 WHEN 0 THEN 5 ELSE 3 END)) AS i FROM part WHERE p_partkey % 3 < 2)""",
    "glob_list": f"""SELECT p_partkey AS seed_id, i - 1 AS ordinal, {H} || v[i] AS url FROM (SELECT p_partkey, v, unnest(range(1, len(v) + 1)) AS i
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['x', 'y'] ELSE [p_brand, '', 'b'] END AS v FROM part))""",
    "glob_cross": f"""SELECT p_partkey AS seed_id, (n - 1) * 4 + (ascii(l) - 97) * 2 + ascii(s) - 97 AS ordinal, {H} || s || '/v' || n || '/' || l AS url
FROM part CROSS JOIN (SELECT unnest([1, 2]) AS n) CROSS JOIN (SELECT unnest(['a', 'b']) AS l) CROSS JOIN (SELECT unnest(['a', 'b']) AS s)""",
    "glob_mixed": f"""SELECT p_partkey AS seed_id, i - 1 AS ordinal, {H} || i AS url FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS i FROM part WHERE p_partkey % 5 = 0)
UNION ALL SELECT p_partkey, 0, {H} || '[a-Z]' FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, 2 * i, {H} || '{{' || (i + 1) || ',x}}' FROM (SELECT p_partkey, unnest([0, 1]) AS i FROM part WHERE p_partkey % 5 = 2)
UNION ALL SELECT p_partkey, 0, {H} || 'plain' FROM part WHERE p_partkey % 5 = 3
UNION ALL SELECT p_partkey, min((a - 1) * 13 + b - 1), {H} || a || b FROM (SELECT p_partkey, unnest(range(1, 4)) AS a FROM part WHERE p_partkey % 5 = 4) CROSS JOIN (SELECT unnest(range(1, 14)) AS b) GROUP BY p_partkey, a || b, a, b""",
    "glob_dedupe": "SELECT p_partkey AS seed_id, n, last FROM part CROSS JOIN (SELECT count(*) AS n, max(o) AS last FROM (SELECT a || b AS u, min((a - 1) * 12 + b - 1) AS o FROM (SELECT unnest(range(1, 3)) AS a) CROSS JOIN (SELECT unnest(range(1, 13)) AS b) GROUP BY 1))",
    "glob_large": LARGE.replace(" GROUP BY s_suppkey, a || b", " GROUP BY s_suppkey, 'http://s' || s_suppkey || '.example.com/' || a || b"),
    "url_valid": f"SELECT o_orderkey, {VALID} AS url FROM orders WHERE o_orderkey % 5 IN (0, 3)",
    "batch_expand": BATCH_SQL,
    "batch_expand_counts": f"SELECT line_no, count(*) AS n_urls FROM ({BATCH_SQL}) GROUP BY 1",
}
ORACLES["glob_mixed"] = ORACLES["glob_mixed"].replace(" GROUP BY p_partkey, a || b, a, b", f" GROUP BY p_partkey, {H} || a || b")
ORACLES["glob_list_heads"] = """SELECT p_partkey AS line_no, 'http://h' || p_partkey || '.example.com/' || i AS url, 'ok' AS status FROM part CROSS JOIN (SELECT unnest([1, 2]) AS i) WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, '{http:,}/' || p_partkey || '/[1-2]', 'rejected' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, s || '://h' || p_partkey || '.example.com/', 'ok' FROM part CROSS JOIN (SELECT unnest(['http', 'https']) AS s) WHERE p_partkey % 3 = 2"""
ORACLES["glob_ignored"] = f"""SELECT seed_id, false AS ignored, ordinal, url FROM ({ORACLES["glob_mixed"]})
UNION ALL SELECT p_partkey, true, 0, {H} || CASE p_partkey % 5 WHEN 0 THEN '[1-' || p_size || ']' WHEN 1 THEN '[a-Z]' WHEN 2 THEN '{{[1-2],x}}' WHEN 3 THEN 'plain' ELSE '[1-3][1-13]' END FROM part"""
