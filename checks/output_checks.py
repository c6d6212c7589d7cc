"""Checks of images, rendering, file names and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.common import pages, spread_table, table
from checks.extract_checks import LANG, META_SQL, TITLE, content_sql, meta_pages
from leafpress.functions import urls as U
from leafpress.functions.names import image_filename, output_filename
from leafpress.operators import images as I
from leafpress.operators import render as R
from leafpress.operators.extract import drop_failed, extract_pages
from leafpress.operators.metadata import page_metadata
from leafpress.operators.report import progress
from leafpress.operators.skew import ranked
from leafpress.plans.batch import run_list
from leafpress.session import cut_lineage, ensure_checkpoint_dir
from leafpress.sources.file_sink import drop_files, read_files, write_files
from leafpress.sources.html_files import extract_files, read_html_files
from leafpress.sources.pages import resolve_pages
from leafpress.streaming.pages import live_progress, watched

BASE = "CASE p_partkey % 3 WHEN 0 THEN concat('https://i.example.com/d', p_size) WHEN 1 THEN concat('https://i.example.com/d', p_size, '/') ELSE concat('https://i.example.com/d', p_size, '/page.html') END"
DIR = "CASE p_partkey % 3 WHEN 0 THEN 'https://i.example.com/d' || p_size || '/' WHEN 1 THEN 'https://i.example.com/d' || p_size || '/' ELSE 'https://i.example.com/d' || p_size || '/' END"
IMG_HTML = """concat('<p><img src="https://cdn.example.com/a/', p_partkey, '.JPG?w=1" alt="', p_name, '" title="T &amp; ', p_size, '">',
  '<!-- <img src="no.png"> --><img alt=x src=''/pics/logo'' ><IMG SRC="up/x y', p_size, '.png"><img src="data:image/png;base64,AA"><img src="">',
  '<img src="/pics/logo" alt="again"><img src="../up.tar.gz" alt="../up.tar.gz"></p>')"""


def image_pages(spark, sf):
    return spread_table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(BASE).alias("url"), F.expr(IMG_HTML).alias("html"))


def name_sql(url, name, ext):
    return f"{name} || '_' || substr(md5({url}), 1, 8) || '.{ext}'"


def image_rows():
    up = "CASE WHEN p_partkey % 3 = 2 THEN 'https://i.example.com/up.tar.gz' ELSE 'https://i.example.com/up.tar.gz' END"
    rows = [
        (0, "'https://cdn.example.com/a/' || p_partkey || '.JPG?w=1'", "p_name", "'T & ' || p_size", "CAST(p_partkey AS VARCHAR)", "jpg", "'https://cdn.example.com/a/' || p_partkey || '.JPG?w=1'"),
        (1, "'https://i.example.com/pics/logo'", "'x'", "''", "'logo'", "jpg", "'/pics/logo'"),
        (2, f"{DIR} || 'up/x y' || p_size || '.png'", "''", "''", "'x_y' || p_size", "png", "'up/x y' || p_size || '.png'"),
        (3, up, "'../up.tar.gz'", "''", "'up.tar'", "gz", "'../up.tar.gz'"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT p_partkey AS page_id, {pos} AS pos, {u} AS url, {alt} AS alt, {title} AS title, {name_sql(u, n, e)} AS local_filename, {src} AS original_src FROM part"
        for pos, u, alt, title, n, e, src in rows
    )


FETCH = "SELECT url, attempt, CASE WHEN length(url) % 5 <> 0 OR attempt = length(url) % 4 THEN 200 WHEN attempt = 2 THEN NULL ELSE 500 END AS status"


def attempts(spark, images):
    urls = images.select("url").distinct()
    rows = urls.select("url", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("attempt"))
    rows.createOrReplaceTempView("image_attempts")
    return spark.sql(f"{FETCH} FROM image_attempts")


OUTCOME = f"""imgs AS ({image_rows()}),
att AS ({FETCH} FROM (SELECT DISTINCT url FROM imgs) CROSS JOIN (SELECT unnest([1, 2, 3]) AS attempt)),
outcome AS (SELECT url, bool_or(coalesce(status = 200, false)) AS ok, coalesce(min(CASE WHEN status = 200 THEN attempt END), 3) AS attempts, CASE WHEN length(url) % 5 <> 0 OR 3 = length(url) % 4 THEN 200 ELSE 500 END AS last_status FROM att GROUP BY url)"""
MAP_ROWS = f"""{OUTCOME}, good AS (SELECT * FROM imgs JOIN outcome USING (url) WHERE ok),
pairs AS (SELECT page_id, url AS key, 'img/' || local_filename AS value, pos * 2 AS o FROM good UNION ALL SELECT page_id, original_src, 'img/' || local_filename, pos * 2 + 1 FROM good),
maps AS (SELECT page_id, key, max_by(value, o) AS value FROM pairs GROUP BY 1, 2)"""


def mapped(spark, sf):
    images = cut_lineage(I.image_table(image_pages(spark, sf)))
    return I.image_mapping(images, I.fetch_outcome(attempts(spark, images)))


def image_mapping(spark, sf):
    return mapped(spark, sf).select("page_id", F.explode("image_mappings"))


CONTENT = """concat('Before ![', p_name, '](https://cdn.example.com/a/', p_partkey, '.JPG?w=1 "big one") mid ![n](/pics/logo) and ![u](/unknown.png "t") ',
  '<img src="/pics/logo" data-x="/pics/logo"> <img class=''k'' src=''../up.tar.gz''> <img src="/other.png"> end')"""


def with_content(spark, sf):
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.expr(CONTENT).alias("content"))
    return base.join(mapped(spark, sf), "page_id", "left")


def rewrite_md(spark, sf):
    return with_content(spark, sf).select("page_id", F.coalesce(I.localize_markdown(F.col("content"), F.col("image_mappings")), "content").alias("content"))


def rewrite_html(spark, sf):
    return with_content(spark, sf).select("page_id", F.coalesce(I.localize_html(F.col("content"), F.col("image_mappings")), "content").alias("content"))


def rewritten_sql(markdown):
    first = "coalesce(a.value, k.u)"
    if markdown:
        text = f"'Before ![' || p_name || '](' || {first} || ' \"big one\") mid ![n](' || coalesce(l.value, '/pics/logo') || ') and ![u](/unknown.png \"t\") <img src=\"/pics/logo\" data-x=\"/pics/logo\"> <img class=''k'' src=''../up.tar.gz''> <img src=\"/other.png\"> end'"
    else:
        logo = "coalesce(l.value, '/pics/logo')"
        text = f"'Before ![' || p_name || '](' || k.u || ' \"big one\") mid ![n](/pics/logo) and ![u](/unknown.png \"t\") <img src=\"' || {logo} || '\" data-x=\"' || {logo} || '\"> <img class=''k'' src=''' || coalesce(t.value, '../up.tar.gz') || '''> <img src=\"/other.png\"> end'"
    return f"""WITH {MAP_ROWS}, k AS (SELECT p_partkey AS page_id, p_name, 'https://cdn.example.com/a/' || p_partkey || '.JPG?w=1' AS u FROM part)
SELECT k.page_id, {text} AS content FROM k LEFT JOIN maps a ON a.page_id = k.page_id AND a.key = k.u
LEFT JOIN maps l ON l.page_id = k.page_id AND l.key = '/pics/logo' LEFT JOIN maps t ON t.page_id = k.page_id AND t.key = '../up.tar.gz'"""


def image_base_url(spark, sf):
    forms = "CASE o_orderkey % 6 WHEN 0 THEN 'https://h.example.com' WHEN 1 THEN 'https://h.example.com/d' WHEN 2 THEN 'https://h.example.com/d/' WHEN 3 THEN 'https://h.example.com/p.htm?q=1' WHEN 4 THEN 'https://h.example.com/p.php' ELSE 'https://h.example.com/d?q=x.html' END"
    return table(spark, sf, "orders").select("o_orderkey", U.image_base(F.expr(forms)).alias("base"))


def filename(spark, sf):
    url = "concat('https://h.example.com/', CASE o_orderkey % 5 WHEN 0 THEN concat('a/', repeat('long name ', 8), '.PnG') WHEN 1 THEN 'é_ü-1.jpeg?x=1' WHEN 2 THEN 'dir/' WHEN 3 THEN 'a.b.c!d' ELSE concat(o_custkey, '') END)"
    return table(spark, sf, "orders").select("o_orderkey", image_filename(F.expr(url)).alias("name"))


def meta_results(spark, sf):
    src = meta_pages(spark, sf)
    meta = page_metadata(F.col("html"), F.col("url"))
    return src.select("page_id", "url", F.lit("ok").alias("status"), F.concat(F.lit("Body "), "page_id").alias("content"), F.when(F.col("page_id") % 9 != 0, meta).alias("metadata"))


def render_markdown(spark, sf):
    return R.render(meta_results(spark, sf)).select("page_id", "document")


def render_text(spark, sf):
    return R.render(meta_results(spark, sf), "text").select("page_id", "document")


# Labels of the metadata lines, as the statements expect them.
FRONT_MATTER = (("title", "title"), ("author", "author"), ("date", "date"), ("sitename", "site"), ("description", "description"), ("language", "language"), ("tags", "tags"))
HEADER = (("title", "Title"), ("author", "Author"), ("date", "Date"), ("sitename", "Site"), ("description", "Description"), ("language", "Language"), ("tags", "Tags"))


def head_sql(rule, labels, brackets):
    cols = {"title": "title", "author": "author", "date": "date", "sitename": "sitename", "description": "description", "language": "language"}
    lines = [f"'{label}: ' || {cols[f]}" for f, label in labels if f in cols]
    tags = f"'{dict(labels)['tags']}: {'[' if brackets else ''}' || replace(tags, ';', ', ') || '{']' if brackets else ''}'"
    return f"""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Body ' || page_id ELSE concat_ws(chr(10), '{rule}', {', '.join(lines)}, {tags}, '{rule}', '', 'Body ' || page_id) END AS document FROM ({META_SQL})"""


def render_dispatch(spark, sf):
    """Whole documents of every format."""
    base = meta_results(spark, sf).filter("status = 'ok'")
    out = None
    for fmt in ("markdown", "text", "json", "XML", "csv"):
        part = R.render(base, fmt).select("page_id", F.lit(fmt).alias("fmt"), "document")
        out = part if out is None else out.unionByName(part)
    return out


def as_record(fmt):
    def run(spark, sf):
        return drop_failed(extract_pages(pages(spark, sf), output_format=fmt)).select("page_id", "content")

    return run


def file_names(spark, sf):
    n = ranked(pages(spark, sf).select("page_id", "url"), [], ["page_id"], "n")
    fmt = F.element_at(F.array(*map(F.lit, ("markdown", "text", "xml", "json", "csv", "md"))), (F.col("page_id") % 6 + 1).cast("int"))
    return n.select("page_id", output_filename(F.col("n") - 1, F.col("url"), fmt).alias("filename"))


def combined(spark, sf):
    return R.combined_document(extract_pages(pages(spark, sf)), ["page_id"], with_metadata=False)


def seeds(spark, sf):
    """Each order asks for a page; a third of them for one and the same."""
    o = table(spark, sf, "orders")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("wanted"), "url")
    asked = o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END").alias("wanted"))
    return asked.join(p, "wanted", "left").select("o_orderkey", F.coalesce("url", F.expr("concat('https://gone.example.com/', wanted)")).alias("url"))


ASKED = "asked AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS wanted FROM orders)"


def resolve(spark, sf):
    return resolve_pages(seeds(spark, sf), pages(spark, sf)).select("o_orderkey", "page_id", "status", F.length("html").alias("n"))


def list_lines(spark, sf):
    lines = seeds(spark, sf).select(F.col("o_orderkey") % 7, "o_orderkey", "url").toDF("file", "line_no", "line")
    return lines.withColumn("line", F.when(F.col("line_no") % 10 == 0, F.lit("# skip")).otherwise(F.col("line")))


def batch_run(spark, sf):
    out = run_list(list_lines(spark, sf), pages(spark, sf))
    return out.select("file", "line_no", "url", "status", F.md5("content").alias("content_md5"))


def last_status(spark, sf):
    src = "CASE WHEN page_id % 5 <> 0 OR page_id % 4 = 2 THEN 'ok' WHEN page_id % 3 = 0 THEN NULL ELSE 'error' END"
    return table(spark, sf, "pages").select("page_id", U.netloc(F.col("url")).alias("host"), F.expr(src).alias("status"))


def progress_live(spark, sf):
    """The last row of a watched stream over the statuses, which come in eight files, one for each micro-batch."""
    path = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    statuses = last_status(spark, sf)
    statuses.repartition(8, "page_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(statuses.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = watched(stream).writeStream.format("noop").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    *_, last = live_progress(query)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.createDataFrame([last], "total long, completed long, failed long, success_rate double, percentage double")


STATUS = "st AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS host, CASE WHEN page_id % 5 <> 0 OR page_id % 4 = 2 THEN 'ok' WHEN page_id % 3 = 0 THEN NULL ELSE 'error' END AS status FROM pages)"
PROGRESS = """count(*) AS total, count(status) AS completed, count(*) FILTER (WHERE status <> 'ok') AS failed,
  CASE WHEN count(status) > 0 THEN (count(status) - count(*) FILTER (WHERE status <> 'ok')) / count(status) * 100 ELSE 0.0 END AS success_rate, count(status) / count(*) * 100 AS percentage FROM st"""

#: Kinds of page: none, empty, broken twice, boilerplate alone, MathML that the Arrow step raises on (twice), too long, sound.
BROKEN = """CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('<p><b <i>', substring(html, 1, 40)) WHEN 3 THEN '<<<>>> & &#99999999; &#xD800; <p'
  WHEN 4 THEN concat('<nav>', html, '</nav>') WHEN 5 THEN concat('<p>Odd ', page_id, '</p><math><![odd[x]]><mi>y</mi></math><math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>', html)
  WHEN 6 THEN concat('<math>', repeat('<mrow>', 1200), '<mi>x</mi></math>', html) WHEN 7 THEN concat(html, repeat('<p>more</p>', 20000)) ELSE html END"""


def failure_isolation(spark, sf):
    out = extract_pages(pages(spark, sf).withColumn("html", F.expr(BROKEN)), process_math=True, max_chars=200_000)
    return out.select("page_id", "status", "error", "content")


def dropped(spark, sf):
    src = pages(spark, sf).withColumn("html", F.expr("CASE WHEN page_id % 4 = 1 THEN '<nav>x</nav>' ELSE html END"))
    return drop_failed(extract_pages(src)).select("page_id", "url", F.length("content").alias("n"))


HIDDEN = "concat('<noscript><img src=\"/ns', page_id, '.png\"></noscript><template><img src=\"/t.png\"></template><!-- <img src=\"/c.png\"> -->', html)"


def noscript_images(spark, sf):
    src = pages(spark, sf).withColumn("html", F.expr(HIDDEN))
    return I.image_table(src).select("page_id", "pos", "original_src")


def stored_images(spark, sf):
    """Bytes of the images that were landed, here of every other URL."""
    images = I.image_table(image_pages(spark, sf))
    blobs = images.select("url").distinct().filter(F.length("url") % 2 == 0).withColumn("bytes", F.md5("url").cast("binary"))
    return I.stored_images(images, blobs).select("local_filename", F.col("bytes").cast("string").alias("bytes"))


def _through_files(spark, files):
    """Written to files of their own and read back; the files go."""
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    write_files(files, path)
    back = cut_lineage(read_files(spark, path).select("folder", "filename", F.col("bytes").cast("string").alias("text")))
    drop_files(back, path)
    return back


def documents_in_files(spark, sf):
    return _through_files(spark, R.document_files(extract_pages(pages(spark, sf)), ["page_id"], with_metadata=False))


def images_in_files(spark, sf):
    images = I.image_table(image_pages(spark, sf))
    blobs = images.select("url").distinct().filter(F.length("url") % 2 == 0).withColumn("bytes", F.md5("url").cast("binary"))
    return _through_files(spark, I.image_files(images, blobs))


def _html_folder(spark, sf, read):
    """Every stored page as a file of its own, read by ``read``; the files go."""
    path = f"{ensure_checkpoint_dir(spark)}/html-{uuid.uuid4().hex}"
    name = F.concat("page_id", F.lit(" ü+%.html"))
    write_files(table(spark, sf, "pages").select(F.lit("").alias("folder"), name.alias("filename"), F.col("html").cast("binary").alias("bytes")), path)
    back = cut_lineage(read(path))
    back = back.withColumn("name", F.regexp_extract("file", "([^/]*)$", 1))
    drop_files(back.select(F.lit("").alias("folder"), F.col("name").alias("filename")), path)
    return back


def html_files(spark, sf):
    return _html_folder(spark, sf, lambda path: read_html_files(spark, f"{path}/*.html")).select("name", "url", "html")


def html_files_content(spark, sf):
    return _html_folder(spark, sf, lambda path: extract_files(spark, f"{path}/*.html")).select("name", F.col("metadata.title").alias("title"), "content")


#: Two images and a comment section in front of every page; every other page has no id.
WITH_MEDIA = "concat('<p>Pictures <img src=\"/a', page_id % 10, '.png\" alt=\"A\"> and <img src=\"/b.gif\" alt=\"B\"></p><div class=\"comments\"><p>Comment on ', page_id, '</p></div>', html)"


def media_pages(spark, sf):
    return pages(spark, sf).withColumn("html", F.expr(WITH_MEDIA))


def images_and_comments(spark, sf):
    """The switches that keep images and comment sections, both on."""
    return extract_pages(media_pages(spark, sf), include_images=True, include_comments=True).select("page_id", "content")


def batch_with_images(spark, sf):
    """A list run, in four tasks at most, over pages of which every other has no id; one of the two images was fetched."""
    src = media_pages(spark, sf).withColumn("page_id", F.when(F.col("page_id") % 2 == 0, F.col("page_id")))
    tries = src.select(F.concat(U.origin(F.col("url")), F.lit("/b.gif")).alias("url")).distinct().select("url", F.lit(1).alias("attempt"), F.lit(200).alias("status"))
    out = run_list(list_lines(spark, sf), src, workers=4, extract_images=True, outcome=I.fetch_outcome(tries))
    done = R.render(out.filter("status = 'ok'"), "markdown", with_metadata=False)
    return done.select("file", "line_no", "url", F.array_join(F.sort_array(F.map_keys("image_mappings")), " ").alias("mapped"), F.md5("document").alias("document_md5"))


QUERIES = {
    "documents_in_files": documents_in_files,
    "images_in_files": images_in_files,
    "images_and_comments": images_and_comments,
    "html_files": html_files,
    "html_files_content": html_files_content,
    "batch_with_images": batch_with_images,
    "stored_images": stored_images,
    "noscript_images": noscript_images,
    "page_images": lambda s, sf: I.image_table(image_pages(s, sf)),
    "image_base_url": image_base_url,
    "images_dedupe": lambda s, sf: I.image_table(image_pages(s, sf)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_images")),
    "image_filename": filename,
    "image_fetch_outcome": lambda s, sf: I.fetch_outcome(attempts(s, I.image_table(image_pages(s, sf)))),
    "image_mapping": image_mapping,
    "rewrite_md_images": rewrite_md,
    "rewrite_html_images": rewrite_html,
    "render_dispatch": render_dispatch,
    "render_markdown": render_markdown,
    "render_text": render_text,
    "render_json": as_record("json"),
    "render_csv": as_record("csv"),
    "render_xml": as_record("xml"),
    "output_filename": file_names,
    "combined_document": combined,
    "resolve_pages": resolve,
    "batch_run": batch_run,
    "failure_isolation": failure_isolation,
    "drop_failed": dropped,
    "progress_summary": lambda s, sf: progress(last_status(s, sf)),
    "progress_live": progress_live,
    "progress_by_host": lambda s, sf: progress(last_status(s, sf), ["host"]),
}
HOSTNAME = "regexp_extract(url, '//([^/?#]*)', 1)"


def csv(x):
    return f"(CASE WHEN regexp_matches({x}, '[,\"\\n\\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END)"


def node(name, x):
    return f"'    <{name}>' || replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{name}>' || chr(10)"


NAMES = """CASE o_orderkey % 5 WHEN 0 THEN 'a/' || repeat('long name ', 8) || '.PnG' WHEN 1 THEN 'é_ü-1.jpeg?x=1' WHEN 2 THEN 'dir/' WHEN 3 THEN 'a.b.c!d' ELSE CAST(o_custkey AS VARCHAR) END"""
ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
ORACLES = {
    "documents_in_files": f"""WITH {content_sql()}, f AS (SELECT content, page_id, row_number() OVER (ORDER BY page_id) - 1 AS n, {HOSTNAME} AS host, trim(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/') AS p FROM content JOIN pages USING (page_id))
SELECT host AS folder, substr(lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') || '_' || replace(host, 'www.', '') || CASE WHEN p = '' THEN '' ELSE '_' || replace(regexp_replace(p, '[^\\p{{L}}\\p{{N}}_./-]', '_', 'g'), '/', '_') END, 1, 150) || '.md' AS filename, content AS text FROM f""",
    "images_in_files": f"SELECT DISTINCT 'img' AS folder, local_filename AS filename, md5(url) AS text FROM ({image_rows()}) WHERE length(url) % 2 = 0",
    "html_files": "SELECT page_id || ' ü+%.html' AS name, CAST(NULL AS VARCHAR) AS url, html FROM pages",
    "html_files_content": f"WITH {content_sql()} SELECT page_id || ' ü+%.html' AS name, {TITLE} AS title, content FROM content JOIN pages USING (page_id)",
    "images_and_comments": f"WITH {content_sql()} SELECT page_id, 'Pictures ![A](/a' || page_id % 10 || '.png) and ![B](/b.gif)' || chr(10) || chr(10) || 'Comment on ' || page_id || chr(10) || chr(10) || content AS content FROM content",
    "batch_with_images": f"""WITH {content_sql()}, {ASKED}, d AS (SELECT page_id AS wanted, url, '/b.gif ' || {ORIGIN} || '/b.gif' AS mapped,
  'Pictures ![A](/a' || page_id % 10 || '.png) and ![B](img/b_' || substr(md5({ORIGIN} || '/b.gif'), 1, 8) || '.gif)' || chr(10) || chr(10) || content AS document FROM content JOIN pages USING (page_id))
SELECT o_orderkey % 7 AS file, o_orderkey AS line_no, url, mapped, md5(document) AS document_md5 FROM asked JOIN d USING (wanted) WHERE o_orderkey % 10 <> 0""",
    "stored_images": f"SELECT DISTINCT local_filename, md5(url) AS bytes FROM ({image_rows()}) WHERE length(url) % 2 = 0",
    "noscript_images": "SELECT page_id, pos, CASE pos WHEN 0 THEN '/ns' || page_id || '.png' ELSE '/t.png' END AS original_src FROM pages CROSS JOIN (SELECT unnest([0, 1]) AS pos)",
    "page_images": image_rows(),
    "image_base_url": "SELECT o_orderkey, (['https://h.example.com/', 'https://h.example.com/d/', 'https://h.example.com/d/', 'https://h.example.com/p.htm?q=1', 'https://h.example.com/p.php', 'https://h.example.com/d?q=x.html/'])[o_orderkey % 6 + 1] AS base FROM orders",
    "images_dedupe": "SELECT p_partkey AS page_id, 4 AS n_images FROM part",
    "image_filename": f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN substr(repeat('long_name_', 8), 1, 50) WHEN 1 THEN 'é_ü-1' WHEN 2 THEN 'dir' WHEN 3 THEN 'a.b' ELSE CAST(o_custkey AS VARCHAR) END
 || '_' || substr(md5('https://h.example.com/' || {NAMES}), 1, 8) || '.' || (['png', 'jpeg', 'jpg', 'cd', 'jpg'])[o_orderkey % 5 + 1] AS name FROM orders""",
    "image_fetch_outcome": f"WITH {OUTCOME} SELECT * FROM outcome",
    "image_mapping": f"WITH {MAP_ROWS} SELECT * FROM maps",
    "rewrite_md_images": rewritten_sql(True),
    "rewrite_html_images": rewritten_sql(False),
    "render_dispatch": f"""SELECT *, 'markdown' AS fmt FROM ({head_sql("---", FRONT_MATTER, True)}) UNION ALL SELECT *, 'text' AS fmt FROM ({head_sql("=" * 60, HEADER, False)})
UNION ALL SELECT c_custkey AS page_id, 'Body ' || c_custkey AS document, fmt FROM customer CROSS JOIN (SELECT unnest(['json', 'XML', 'csv']) AS fmt)""",
    "render_markdown": head_sql("---", FRONT_MATTER, True),
    "render_text": head_sql("=" * 60, HEADER, False),
    "render_json": f"WITH {content_sql(sep='chr(10)', body='marked')} SELECT page_id, CAST(json_object('title', {TITLE}, 'hostname', regexp_extract(url, '//([^/?#]*)', 1), 'language', {LANG}, 'url', url, 'text', content) AS VARCHAR) AS content FROM content JOIN pages USING (page_id)",
    "render_csv": f"WITH {content_sql(sep='chr(10)', body='marked')} SELECT page_id, {csv(TITLE)} || ',,,,,' || {csv(HOSTNAME)} || ',' || {LANG} || ',,,' || {csv('url')} || ',' || {csv('content')} AS content FROM content JOIN pages USING (page_id)",
    "render_xml": f"WITH {content_sql(sep='chr(10)', body='marked')} SELECT page_id, '<doc>' || chr(10) || {node('title', TITLE)} || {node('hostname', HOSTNAME)} || {node('language', LANG)} || {node('url', 'url')} || {node('text', 'content')} || '</doc>' AS content FROM content JOIN pages USING (page_id)",
    "output_filename": """SELECT page_id, substr(lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') || '_' || replace(host, 'www.', '') || CASE WHEN p = '' THEN '' ELSE '_' || replace(regexp_replace(p, '[^\\p{L}\\p{N}_./-]', '_', 'g'), '/', '_') END, 1, 150)
 || (['.md', '.txt', '.xml', '.json', '.csv', '.md'])[page_id % 6 + 1] AS filename
FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS n, regexp_extract(url, '//([^/?#]*)', 1) AS host, trim(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/') AS p FROM pages)""",
    "combined_document": f"WITH {content_sql()} SELECT row_number() OVER (ORDER BY page_id) AS part_no, CASE WHEN row_number() OVER (ORDER BY page_id) = 1 THEN '' ELSE chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) END || content AS part FROM content",
    "resolve_pages": f"WITH {ASKED} SELECT o_orderkey, page_id, CASE WHEN page_id IS NULL THEN 'no_page' ELSE 'ok' END AS status, length(html) AS n FROM asked LEFT JOIN pages ON page_id = wanted",
    "batch_run": f"""WITH {content_sql()}, {ASKED} SELECT o_orderkey % 7 AS file, o_orderkey AS line_no, coalesce(url, 'https://gone.example.com/' || wanted) AS url, CASE WHEN content IS NULL THEN 'no_page' ELSE 'ok' END AS status, md5(content) AS content_md5
FROM asked LEFT JOIN pages ON page_id = wanted LEFT JOIN content USING (page_id) WHERE o_orderkey % 10 <> 0""",
    "failure_isolation": f"""WITH {content_sql()}, c AS (SELECT page_id, content, url FROM pages LEFT JOIN content USING (page_id))
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'no_page' WHEN 1 THEN 'empty' WHEN 4 THEN 'empty' WHEN 7 THEN 'error' ELSE 'ok' END AS status,
  CASE page_id % 9 WHEN 5 THEN 'math: AssertionError: unknown status keyword ''odd'' in marked section' WHEN 6 THEN 'math: ValueError: more than 1000 elements within each other'
    WHEN 7 THEN 'page of more than 200000 characters' END AS error,
  CASE page_id % 9 WHEN 2 THEN '<me' WHEN 3 THEN '<<<>>> & � � <p' WHEN 5 THEN 'Odd ' || page_id || chr(10) || chr(10) || 'y$\\frac{{a}}{{b}}$' || chr(10) || chr(10) || content
    WHEN 6 THEN 'x' || chr(10) || chr(10) || content WHEN 8 THEN content END AS content
FROM c""",
    "drop_failed": f"WITH {content_sql()} SELECT page_id, url, length(content) AS n FROM content JOIN pages USING (page_id) WHERE page_id % 4 <> 1",
    "progress_summary": f"WITH {STATUS} SELECT {PROGRESS}",
    "progress_live": f"WITH {STATUS} SELECT {PROGRESS}",
    "progress_by_host": f"WITH {STATUS} SELECT host, {PROGRESS} GROUP BY host",
}
