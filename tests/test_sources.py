import pytest
from pyspark.errors import AnalysisException

from leafpress.sources import html_files, pages as P, url_lists as L


def test_line_ends_and_numbers(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_bytes("# note\r\nhttps://a.example.com/1\r\rnot-a-url\n  https://a.example.com/测试  \n\n/data/x\nfile:///y".encode())
    lines = L.read_url_lists(spark, str(f))
    good = {r.line_no: r.url for r in L.url_lines(lines).collect()}
    assert good == {2: "https://a.example.com/1", 5: "https://a.example.com/测试", 7: "/data/x", 8: "file:///y"}
    assert [(r.line_no, r.line) for r in L.rejected_lines(lines).collect()] == [(4, "not-a-url")]
    assert L.list_summary(lines).first().message == "Found 4 URLs in batch file"


def test_numbers_hold_over_many_splits(spark, tmp_path):
    for name, n in (("a.txt", 4000), ("b.txt", 10)):
        (tmp_path / name).write_text("".join(f"https://{name}/{i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = L.read_url_lists(spark, str(tmp_path))
        rows = lines.collect()
        assert lines.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4010
    assert all(r.line.rsplit("/", 1)[1] == str(r.line_no) for r in rows)


def test_empty_list(spark):
    lines = L.lines_of(spark.createDataFrame([("f", "# only\n\n# notes\n")], "file string, text string"))
    row = L.list_summary(lines).first()
    assert (row.ok, row.message) == (False, "Batch file contains no valid URLs")


def test_html_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.html").write_text(f"<html><title>T{i}</title><body><p>Text é {i}</p></body></html>", encoding="utf-8")
    out = {r.file: r for r in html_files.extract_files(spark, str(tmp_path)).collect()}
    row = out[str(tmp_path / "1.html")]
    assert (row.content, row.metadata.title, row.status) == ("Text é 1", "T1", "ok")
    with pytest.raises(AnalysisException):
        html_files.read_html_files(spark, str(tmp_path / "missing.html"))


def test_fetches_without_page_ids(spark):
    stored = [("a", None, "<p>x</p>"), ("a", None, "<p>x</p>"), ("b", None, "<p>y</p>"), ("c", None, "<p>z</p>"), ("c", 3, "<p>w</p>")]
    pages = spark.createDataFrame(stored, "url string, page_id long, html string")
    seeds = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    got = {(r.url, r.html, r.status) for r in P.resolve_pages(seeds, pages).collect()}
    assert got == {("a", "<p>x</p>", "ok"), ("b", "<p>y</p>", "ok"), ("c", "<p>w</p>", "ok"), ("d", None, "no_page")}


def test_a_row_group_is_not_one_task(spark, tmp_path):
    from pyspark.sql import functions as F

    from checks.common import spread_table

    # one row group, which Spark cuts into more splits than there are cores: all but one are empty
    spark.range(0, 60000, 1, 1).withColumn("x", F.sha2(F.col("id").cast("string"), 512)).write.option("compression", "none").parquet(str(tmp_path / "t.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "500000")
    try:
        plain = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert plain.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        assert plain.groupBy(F.spark_partition_id()).count().count() == 1
        dealt = spread_table(spark, str(tmp_path), "t", "id", 5000)
        counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(counts) == 12 and sum(counts) == 60000 and max(counts) < 6000
    assert spread_table(spark, "/root/testdata/sf0.001", "orders", "o_orderkey").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
