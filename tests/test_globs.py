import pytest
from pyspark.sql import functions as F

from leafpress.operators import globs as G

P = "http://example.com/"
CASES = {
    "[1-3].html": ["1.html", "2.html", "3.html"],
    "[01-03]": ["01", "02", "03"],
    "[0-6:2]": ["0", "2", "4", "6"],
    "[95-100]": ["95", "96", "97", "98", "99", "100"],
    "[5-5]": ["5"],
    "[5-1]": [],
    "[a-c]": ["a", "b", "c"],
    "[A-C]": ["A", "B", "C"],
    "[a-C]": ["[a-C]"],
    "{one,two,three}": ["one", "two", "three"],
    "{a,a,b}": ["a", "b"],
    "{a,,b}": ["a", "", "b"],
    "{ x , y }": ["x", "y"],
    "{single}": ["single"],
    "{}": ["{}"],
    "{a,b}/[1-2]": ["a/1", "b/1", "a/2", "b/2"],
    "{[1-2],x}": ["{1,x}", "{2,x}"],
    "[1-2]-[1-2]": ["1-1", "1-2", "2-1", "2-2"],
    "[1-2][1-11]": [f"{a}{b}" for a in (1, 2) for b in range(1, 12)],
    "plain": ["plain"],
}


@pytest.mark.parametrize("in_row", [4096, 2])
def test_expand(spark, in_row):
    df = spark.createDataFrame([(k, P + k) for k in CASES], "k string, url string")
    rows = G.expand_globs(df, in_row=in_row).collect()
    for k, want in CASES.items():
        got = [r.url for r in sorted((r for r in rows if r.k == k), key=lambda r: r.ordinal)]
        assert got == [P + w for w in want], k


def test_all_of_four_patterns(spark):
    df = spark.createDataFrame([(P + "{web,api}/v[1-2]/[a-b].{json,xml}",)], "url string")
    got = {r.url for r in G.expand_urls(df).collect()}
    assert got == {f"{P}{s}/v{n}/{c}.{e}" for s in ("web", "api") for n in "12" for c in "ab" for e in ("json", "xml")}


def test_a_url_of_many_rows_goes_to_many_tasks(spark):
    df = spark.createDataFrame([(P + "[1-300]/[001-100]",)], "url string")
    out = G.expand_globs(df, in_row=64)
    assert out.count() == 30000 and out.select("url").distinct().count() == 30000


def test_ranges_that_cannot_be_counted_are_rejected(spark):
    df = spark.createDataFrame([(P + "[1-9:0]",), (P + "[1-99999999999999999999]",), (P + "[1-2]",)], "url string")
    assert G.rejected_globs(df).count() == 2
    assert G.expand_globs(df).count() == 2


def test_validation_and_ignore(spark):
    df = spark.createDataFrame([("/data/[1-3]",), ("file:///x/[1-2]",), (P + "[1-2]",)], "url string")
    assert G.expand_urls(df).count() == 2
    assert [r.url for r in G.expand_urls(df, ignore_glob=True).collect()] == [r.url for r in df.collect()]


def test_list_keeps_plain_lines_and_repeats(spark):
    lines = [(1, "/data/x"), (2, P + "a"), (3, P + "a"), (4, P + "[1-2]"), (5, "/data/[1-2]")]
    out = G.expand_list(spark.createDataFrame(lines, "line_no long, url string"))
    counts = {r.line_no: r.n_urls for r in G.expansion_counts(out, ["line_no"]).collect()}
    assert counts == {1: 1, 2: 1, 3: 1, 4: 2}


def test_parse(spark):
    row = spark.range(1).select(G.glob_patterns(F.lit(P + "{a, b}/[001-100:5]/[x-z]")).alias("p")).first().p
    assert [(x.pattern, x.type) for x in row] == [("[001-100:5]", "numeric_range"), ("[x-z]", "alpha_range"), ("{a, b}", "list")]
    assert (row[0].pad, row[0].step, row[2]["items"]) == (3, 5, ["a", "b"])


def test_a_line_is_expanded_or_rejected(spark):
    lines = ["{,https:}//h/[1-2]", "{http:,}/x/[1-2]", "http://{,h.com}/", "http://h/[1-3:0]", "http://h/[2-1]", "plain"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, url string")
    got = {}
    for r in G.expand_list(df, keep_rejected=True).collect():
        got.setdefault(r.line_no, set()).add(r.status)
    assert got == {0: {"ok"}, 1: {"rejected"}, 2: {"ok"}, 3: {"rejected"}, 5: {"ok"}}


def test_products_of_one_split_are_made_by_several_tasks(spark):
    lines = spark.range(64).coalesce(1).selectExpr("id", "concat('http://h', id, '.example.com/[1-3]') as url")
    made = G.expand_globs(lines)
    used = made.select(F.spark_partition_id().alias("task"), "id")
    assert used.count() == 192 and used.select("task").distinct().count() > 1


def test_patterns_are_parsed_once_for_each_row(spark):
    """The parsing stands neither in the filters nor in the lambda that makes each URL."""
    lines = spark.createDataFrame([("http://h.example.com/[1-3]",)], "url string")
    plan = G.expand_globs(lines)._jdf.queryExecution().optimizedPlan().toString()
    small = plan.split("Union")[1].split("LogicalRDD")[0]
    # once for each of the three kinds of pattern
    assert small.count("regexp_extract_all") == 3
