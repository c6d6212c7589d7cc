import json
from functools import reduce

import pytest
from pyspark.sql import functions as F

from leafpress.functions import tex as X
from leafpress.functions.names import image_filename, output_filename
from leafpress.operators import images as I
from leafpress.operators import render as R
from leafpress.operators.extract import extract_pages
from leafpress.operators.math import normalize_math
from leafpress.operators.report import observe_progress
from leafpress.plans.batch import run_batch
from leafpress.sources import sinks, url_lists
from leafpress.sources.file_sink import FileWriter, drop_files, read_files, write_files
from leafpress.streaming.pages import extract_stream, live_progress, watched


def one(spark, value):
    return spark.range(1).select(value).first()[0]


def images(spark, html, url):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return I.image_table(df).orderBy("pos").collect()


def test_images(spark):
    html = """<img src="https://e.com/i1.jpg" alt="Blue door" title="One"><p>x</p><img src="/rel/i2.png" alt="B">
      <img src="data:image/png;base64,AAA"><figure><img src="https://e.com/i1.jpg"></figure><img alt="none"><img src="">"""
    rows = images(spark, html, "https://e.com/page")
    assert [(r.url, r.alt, r.title, r.original_src) for r in rows] == [
        ("https://e.com/i1.jpg", "Blue door", "One", "https://e.com/i1.jpg"), ("https://e.com/rel/i2.png", "B", "", "/rel/i2.png"),
    ]
    for base, want in (
        ("https://e.org/docs/release-7", "https://e.org/docs/release-7/x1.png"),
        ("https://e.com/page.html", "https://e.com/x1.png"),
        ("https://e.com/path/", "https://e.com/path/x1.png"),
        ("https://e.com/d?q=1", "https://e.com/x1.png"),
    ):
        assert images(spark, '<img src="x1.png">', base)[0].url == want


def test_names(spark):
    def name(url):
        return one(spark, image_filename(F.lit(url)))

    assert name("https://e.com/a/door.jpg").startswith("door_") and len(name("https://e.com/a/door.jpg")) == len("door_12345678.jpg")
    assert name("https://e.com/door.jpg?w=80#top").endswith(".jpg")
    assert name("https://e.com/a/door").endswith(".jpg") and name("https://e.com").startswith("image_")
    assert name("https://e.com/old%2Bdoor.png").startswith("old_2Bdoor_")
    got = one(spark, output_filename(F.lit(1234), F.lit("https://www.e.com/a b/c?x=1"), F.lit("markdown")))
    assert got == "1234_e.com_a_b_c.md"
    assert len(one(spark, output_filename(F.lit(1), F.lit("https://e.com/" + "x" * 300), F.lit("docx")))) == 154


def test_fetch_and_mapping(spark):
    img = spark.createDataFrame([(1, 0, "u1", "n1", "s"), (1, 1, "u2", "n2", "s"), (1, 2, "u3", "n3", "u3")], "page_id long, pos int, url string, local_filename string, original_src string")
    tries = [("u1", 1, 500), ("u1", 3, 200), ("u2", 1, 200), ("u3", 1, None), ("u3", 4, 200)]
    outcome = I.fetch_outcome(spark.createDataFrame(tries, "url string, attempt int, status int"))
    assert {r.url: r.ok for r in outcome.collect()} == {"u1": True, "u2": True, "u3": False}
    assert I.image_mapping(img, outcome).first().image_mappings == {"u1": "img/n1", "u2": "img/n2", "s": "img/n2"}
    blobs = spark.createDataFrame([("u1", bytearray(b"x")), ("u9", bytearray(b"y"))], "url string, bytes binary")
    assert [(r.local_filename, bytes(r.bytes)) for r in I.stored_images(img, blobs).collect()] == [("n1", b"x")]


def test_rewriting(spark):
    mapping = F.create_map(F.lit("/a.png"), F.lit("img/a_1.png"))
    text = "![x](/a.png \"t\") ![y](/b.png) ![](/a.png) <img class='c' src='/a.png' data-o='/a.png'> (/a.png)"
    want = "![x](img/a_1.png \"t\") ![y](/b.png) ![](img/a_1.png) <img class='c' src='img/a_1.png' data-o='img/a_1.png'> (/a.png)"
    assert one(spark, I.localize_images(F.lit(text), mapping)) == want
    assert one(spark, I.localize_images(F.lit(text), F.lit(None).cast("map<string,string>"))) == text


MML = '<math display="block"><semantics><mrow><mi>E</mi></mrow><annotation encoding="application/x-tex">E = mc^2</annotation></semantics></math>'


def normal(spark, html, **kw):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return normalize_math(df, **kw).first()


def test_math_forms(spark):
    katex = f'<p>a <span class="katex"><span class="katex-mathml">{MML}</span><span class="katex-html"><span>x</span></span></span> b</p>'
    assert normal(spark, katex).html == '<p>a <span class="math-converted" data-math="true">$E = mc^2$</span> b</p>'
    shown = normal(spark, f'<div class="katex-display">{katex[5:-6]}</div><p>z</p>')
    assert "$$E = mc^2$$" in shown.html and shown.html.endswith("</div><p>z</p>") and shown.math.processed == 1
    assert "\n$$E = mc^2$$\n" in normal(spark, MML).html
    script = normal(spark, '<script type="math/tex; mode=display">\n \\begin{align}x<1\\end{align}\n</script><script>1</script>')
    assert "\n$$x&lt;1$$\n" in script.html and script.html.endswith("<script>1</script>")
    plain = "<math><mfrac><mn>1</mn><mrow><mn>1</mn><mo>±</mo><msup><mi>e</mi><mi>x</mi></msup></mrow></mfrac></math>"
    assert "$\\frac{1}{1 \\pm e^{x}}$" in normal(spark, plain).html
    assert normal(spark, plain, fallback=False).math.remaining_math == 1
    untouched = '<!-- <math><mi>a</mi></math> --><p class="x">$ 5 <math></math></p>'
    assert normal(spark, untouched).html == untouched
    many = "".join(f"<p><math><mi>x</mi><mn>{i}</mn></math></p>" for i in range(300))
    assert normal(spark, many).math.fallback_processed == 300
    assert normal(spark, None).math is None


def test_math_text(spark):
    for text, want in {
        "a  $$ x \n y $$ b": "$$x y$$", "\\[ z \\]": "$$z$$", "\\begin{equation*} q \\end{equation*}": "$$q$$", "\\(k\\)": "$k$",
        "$ $": None, "": None, "$a$ then $$b$$": "$$b$$",
    }.items():
        assert one(spark, X.first_math(F.lit(text))) == want
    c = one(spark, X.math_counts(F.lit("$x$ .. $$y$$")))
    assert (c.inline_math, c.display_math, c.total_expressions) == (2, 1, 3)


def test_record_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://e.com/", '<title>A, "b"</title><p>x &lt; y</p>')], "page_id long, url string, html string")
    assert json.loads(extract_pages(df, output_format="json").first().content) == {"title": 'A, "b"', "hostname": "e.com", "url": "https://e.com/", "text": "x < y"}
    assert "x &lt; y" in extract_pages(df, output_format="xml").first().content
    assert '"A, ""b"""' in extract_pages(df, output_format="csv").first().content
    good = extract_pages(df)
    for fmt in ("json", "csv", "xml"):
        sinks.write_records(good, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().title == 'A, "b"'
    assert spark.read.format("xml").option("rowTag", "doc").load(str(tmp_path / "xml")).first().content == "x < y"


def test_combined_document_in_files(spark, tmp_path):
    rows = [(i, "ok", f"Doc {i}", None) for i in range(200)] + [(500, "empty", None, None)]
    res = spark.createDataFrame(rows, "n long, status string, content string, metadata struct<title:string>")
    parts = R.combined_document(res, ["n"], with_metadata=False)
    sinks.write_parts(parts, str(tmp_path / "doc"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "doc").glob("part-*"))).replace("\x00", "")
    assert text == ("\n\n" + "=" * 60 + "\n\n").join(f"Doc {i}" for i in range(200))


def test_batch_run(spark, tmp_path):
    (tmp_path / "l.txt").write_text("https://e.com/[1-3]\n# x\nhttps://e.com/2\nbad\n")
    pages = spark.createDataFrame([(i, f"https://e.com/{i}", f"<title>T{i}</title><p>Text {i}</p>") for i in range(1, 3)], "page_id long, url string, html string")
    good = run_batch(url_lists.read_url_lists(spark, str(tmp_path / "l.txt")), pages, str(tmp_path / "out"))
    assert good.count() == 3
    docs = {r.filename: r.document for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(docs) == ["000_e.com_1.md", "001_e.com_2.md", "002_e.com_2.md"]
    assert docs["000_e.com_1.md"] == "---\ntitle: T1\n---\n\nText 1"


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://e.com/{i}", f"<p>Text {i}</p>") for i in range(4)], "page_id long, url string, html string")
    for batch in (pages.filter("page_id < 2"), pages.filter("page_id >= 2")):
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.content for r in out.collect()) == [f"Text {i}" for i in range(4)]


def test_observed_progress(spark):
    watched, seen = observe_progress(spark.createDataFrame([("ok",), ("error",)], "status string"))
    watched.collect()
    assert seen.get == {"completed": 2, "failed": 1}


def test_registry_names():
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    assert reduce(max, map(len, queries)) < 40


def test_aliases_mean_one_format(spark):
    pages = spark.createDataFrame([(1, "https://e.com/a", "<html><head><title>T</title></head><body><article><p>Words of the page.</p></article></body></html>")], "page_id long, url string, html string")
    results = extract_pages(pages, output_format="md")
    assert R.render(results, "md").first().document == R.render(results, "Markdown").first().document
    names = {f: R.named_documents(results, ["page_id"], f).first().filename for f in ("md", "markdown", "TXT", "text", "odd")}
    assert names == {"md": "000_e.com_a.md", "markdown": "000_e.com_a.md", "TXT": "000_e.com_a.txt", "text": "000_e.com_a.txt", "odd": "000_e.com_a.txt"}


def test_math_runs_where_workers_do_not_have_the_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from leafpress.operators.math import normalize_math
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(1, "<p><math><mi>x</mi><mo>+</mo><mi>y</mi></math></p>")], "page_id long, html string")
print("HTML", normalize_math(df).first().html)
""")
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=240, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "math-converted" in done.stdout, done.stderr[-2000:]


def test_many_script_tags_are_read_in_one_pass(spark):
    import time

    page = "<script>x</script>" * 28_000
    df = spark.createDataFrame([(page,)], "html string")
    df.select(X.has_math(F.col("html"))).first()
    start = time.time()
    assert df.select(X.has_math(F.col("html"))).first()[0] is False
    assert time.time() - start < 5


def test_batch_with_images(spark, tmp_path):
    html = "<p>Words before the picture.</p><p><img src='/a.png' alt='A'> and <img src='/b.png' alt='B'></p>"
    pages = spark.createDataFrame([(1, "https://e.com/1", html)], "page_id long, url string, html string")
    lines = spark.createDataFrame([("l", 1, "https://e.com/1"), ("l", 2, "no url")], "file string, line_no long, line string")
    tries = spark.createDataFrame([("https://e.com/a.png", 1, 200), ("https://e.com/b.png", 3, 404)], "url string, attempt int, status int")
    blobs = spark.createDataFrame([("https://e.com/a.png", bytearray(b"x"))], "url string, bytes binary")
    good = run_batch(lines, pages, str(tmp_path / "out"), extract_images=True, outcome=I.fetch_outcome(tries), blobs=blobs, images_out=str(tmp_path / "img"))
    name = one(spark, image_filename(F.lit("https://e.com/a.png")))
    assert set(good.first().image_mappings.values()) == {f"img/{name}"}
    document = spark.read.parquet(str(tmp_path / "out")).first().document
    assert f"](img/{name})" in document and "b.png)" in document
    assert [bytes(r.bytes) for r in spark.read.parquet(str(tmp_path / "img")).collect()] == [b"x"]


def test_files_of_their_own(spark, tmp_path):
    out = str(tmp_path / "files")
    rows = [("h.example.com", f"{i:03d}.md", bytearray(f"text {i}".encode())) for i in range(40)] + [("", "top ü+%.bin", bytearray(b"\0\1")), (None, "none", None)]
    df = spark.createDataFrame(rows, "folder string, filename string, bytes binary").repartition(4)
    write_files(df, out)
    back = {(r.folder, r.filename): bytes(r.bytes) for r in read_files(spark, out).collect()}
    # an empty file is written, but Spark's reader passes it over
    assert back == {(f or "", n): bytes(b) for f, n, b in rows if b}
    assert (tmp_path / "files" / "none").stat().st_size == 0
    assert (tmp_path / "files" / "_SUCCESS").read_text() == "42" and not list((tmp_path / "files").glob("_staged*"))
    write_files(df.limit(1), out)  # overwrites
    assert read_files(spark, out).count() == 1


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from leafpress.sources.html_files import read_html_files

    out, most = str(tmp_path / "files"), 32 * spark.sparkContext.defaultParallelism
    n = most + 44
    write_files(spark.range(n).select(F.lit("").alias("folder"), F.concat("id", F.lit(" ü+%[1].html")).alias("filename"), F.col("id").cast("string").cast("binary").alias("bytes")), out)
    for inner in ("k=v", "inner.html"):  # neither columns nor files of folders within
        (tmp_path / "files" / inner).mkdir()
        (tmp_path / "files" / inner / "x.html").write_text("within")
    (tmp_path / "files" / "other.htm").write_text("other")
    key = "spark.sql.files.openCostInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "200m")  # a task for each file
    try:
        files = read_files(spark, out)
        pages = read_html_files(spark, f"{out}/*.html")
        assert (files.rdd.getNumPartitions(), pages.rdd.getNumPartitions()) == (most, most)
    finally:
        spark.conf.set(key, old)
    assert files.count() == n + 3
    assert {(r.file, r.html) for r in pages.collect()} == {(f"{out}/{i} ü+%[1].html", str(i)) for i in range(n)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_html_files(spark, f"{out}/*.xhtml")
    drop_files(files.filter("folder = ''").select("folder", "filename"), out)
    assert not (tmp_path / "files").exists()


def test_a_job_that_fails_leaves_no_files(spark, tmp_path):
    out = str(tmp_path / "files")
    df = spark.range(100, numPartitions=4).select(F.lit("f").alias("folder"), F.concat("id", F.lit(".md")).alias("filename"), F.raise_error(F.lit("odd")).alias("e"), "id")
    bad = df.select("folder", "filename", F.when(F.col("id") == 99, F.col("e").cast("binary")).otherwise(F.lit(b"x")).alias("bytes"))
    with pytest.raises(Exception, match="odd"):
        write_files(bad, out)
    assert read_names(tmp_path / "files") == []


def read_names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def test_a_repeated_task_leaves_no_double(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"folder": ["a", "a"], "filename": ["1", "2"], "bytes": [b"x", b"y"]})
    writer = FileWriter(str(tmp_path), "run")
    messages = [writer.write(iter([batch])), writer.write(iter([batch]))]
    writer.commit(messages[-1:])
    assert read_names(tmp_path) == ["1", "2"]
    again = FileWriter(str(tmp_path), "other")
    again.abort([again.write(iter([batch])), None])
    assert read_names(tmp_path) == []


def test_image_mappings_of_pages_without_an_id(spark):
    html = "<p><img src='/a.png' alt='A'></p>"
    pages = spark.createDataFrame([(None, "https://e.com/1", html), (None, "https://f.com/2", html), (7, "https://e.com/3", html), (7, "https://f.com/4", html)], "page_id long, url string, html string")
    tries = spark.createDataFrame([("https://e.com/a.png", 1, 200)], "url string, attempt int, status int")
    got = {r.url: r.image_mappings for r in I.with_image_mappings(extract_pages(pages, extract_images=True), I.fetch_outcome(tries)).collect()}
    assert {u: bool(m) for u, m in got.items()} == {"https://e.com/1": True, "https://f.com/2": False, "https://e.com/3": True, "https://f.com/4": False}


def test_live_progress_has_rows_before_the_end(spark, tmp_path):
    spark.range(40).selectExpr("id", "case when id % 4 = 0 then 'error' when id % 4 < 3 then 'ok' end as status").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def rows(df, total=None):
        query = watched(df).writeStream.format("noop").trigger(availableNow=True).start()
        return [(r, query.isActive) for r in live_progress(query, total, every=0.01)]

    seen = rows(stream, 40)
    sums = [r for r, _ in seen]
    assert seen[0][1] and len(sums) == 4 and sums[0]["completed"] < 30
    assert [r["completed"] for r in sums] == sorted(r["completed"] for r in sums)
    assert sums[-1] == {"batch": 3, "total": 40, "completed": 30, "failed": 10, "success_rate": 20 / 30 * 100, "percentage": 75.0}
    with pytest.raises(Exception, match="boom"):
        rows(stream.withColumn("status", F.expr("if(id = 7, raise_error('boom'), status)")))


def test_image_maps_do_not_pass_the_driver(spark, tmp_path):
    """Estimates of their size come from the pages' file and fall short, so no such join may be a broadcast."""
    pages = spark.createDataFrame([(1, "https://a.example.com/", '<img src="/x.png">'), (2, "https://a.example.com/b", '<img src="/x.png">')], "page_id long, url string, html string")
    outcome = spark.createDataFrame([("https://a.example.com/x.png", True)], "url string, ok boolean")
    pages.write.parquet(f"{tmp_path}/pages")
    outcome.write.parquet(f"{tmp_path}/outcome")
    pages, outcome = spark.read.parquet(f"{tmp_path}/pages"), spark.read.parquet(f"{tmp_path}/outcome")
    maps = I.image_mapping(I.image_table(pages), outcome)
    joined = pages.join(maps, "page_id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    assert {len(r.image_mappings) for r in joined.collect()} == {2}
