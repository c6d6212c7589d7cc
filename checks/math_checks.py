"""Checks of math: every form is built from a row, with the TeX it must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import pages, spread_table, table
from leafpress.functions import tex as X
from leafpress.operators.extract import extract_pages
from leafpress.operators.math import math_totals, normalize_math

TEX = "concat('x_{', p_size, '} < \\\\frac{', p_partkey, '}{2}')"
ENC = "concat('x_{', p_size, '} &lt; \\\\frac{', p_partkey, '}{2}')"
MML = f"concat('<math xmlns=\"m\"@><semantics><mrow><mi>x</mi></mrow><annotation encoding=\"application/x-tex\">', {ENC}, '</annotation></semantics></math>')"


def _mml(attr=""):
    return MML.replace("@", attr)


def _katex(inner):
    return f"concat('<span class=\"katex\"><span class=\"katex-mathml\">', {inner}, '</span><span class=\"katex-html\" aria-hidden=\"true\"><span>..</span></span></span>')"


PLAIN = "concat('<math display=\"block\">\n <mrow> <mi>f</mi><mo>≤</mo><mfrac><mn>', p_size, '</mn><msup><mi>e</mi><mrow><mo>−</mo><msqrt><mi>x</mi><mi>y</mi></msqrt></mrow></msup></mfrac></mrow></math>')"
MATRIX = "concat('<math><mtable><mtr><mtd><mn>', p_size, '</mn></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><msubsup><mi>a</mi><mn>1</mn><mn>2</mn></msubsup></mtd></mtr></mtable><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover><mroot><mi>z</mi><mn>3</mn></mroot></math>')"
FORMS = [
    ("inline", _katex(_mml())),
    ("display", f"concat('<span class=\"katex-display\">', {_katex(_mml(' display=\"block\"'))}, '</span>')"),
    ("inline", f"concat('<span class=\"mwe-math-element\"><span hidden>', {_mml()}, '</span><img alt=\"\" src=\"i.svg\"></span>')"),
    ("display", f"concat('<div class=\"mwe-math-element mwe-math-element-block\"><div>', {_mml()}, '</div></div>')"),
    ("inline", _mml()),
    ("display", _mml(" display=\"block\"")),
    ("inline", f"concat('<script type=\"math/tex\">\n \\\\begin{{equation*}}', {TEX}, '\\\\end{{equation*}}\n</script>')"),
    ("display", f"concat('<script type=\"math/tex; mode=display\">', {TEX}, '</script>')"),
    ("fallback", PLAIN),
    ("fallback", MATRIX),
    ("none", "concat('<!-- <math><mi>q</mi></math> --><span class=\"katex\"><b>', p_size, '</b></span><script>var a=\"<math>\";</script><math></math>')"),
]
N = len(FORMS)


def _cases(values, op="%"):
    return f"CASE CAST(p_partkey % {N} AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def math_pages(spark, sf):
    html = f"concat('<p>Before ', {_cases([h for _, h in FORMS])}, ' after</p>')"
    return spread_table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(f"concat('https://m.example.com/', p_partkey)").alias("url"), F.expr(html).alias("html"))


def _duck(e):
    # the same construction: DuckDB takes a backslash as it stands
    return e.replace("\\\\", "\\")


def _wrapped(kind, tex):
    if kind == "display":
        return f"'<div class=\"math-converted\" data-math=\"true\">' || chr(10) || '$$' || {tex} || '$$' || chr(10) || '</div>'"
    return f"'<span class=\"math-converted\" data-math=\"true\">$' || {tex} || '$</span>'"


PLAIN_TEX = "concat('f \\leq \\frac{', p_size, '}{e^{− \\sqrt{x}}}')"
MATRIX_TEX = "concat('\\begin{matrix} ', p_size, ' &amp; b \\\\ a_{1}^{2} \\end{matrix} \\overset{n}{\\underset{i}{\\sum}} \\sqrt[3]{z}')"


def normalized_html():
    out = []
    for i, (kind, source) in enumerate(FORMS):
        if kind == "none":
            out.append(_duck(source))
        elif kind == "fallback":
            out.append(_wrapped("display", PLAIN_TEX) if i == 8 else _wrapped("inline", MATRIX_TEX))
        elif i == 1:
            out.append("'<span class=\"katex-display\">' || " + _wrapped("display", _duck(ENC)).replace("<", "<", 1) + " || '</span>'")
        else:
            # a script holds raw text: its TeX is escaped on the way into markup
            out.append(_wrapped(kind, _duck(ENC)))
    return f"SELECT p_partkey AS page_id, 'https://m.example.com/' || p_partkey AS url, '<p>Before ' || {_cases(out)} || ' after</p>' AS html FROM part"


def math_normalize(spark, sf):
    return normalize_math(math_pages(spark, sf)).select("page_id", "url", "html")


def math_stats(spark, sf):
    m = normalize_math(math_pages(spark, sf))
    return m.select("page_id", "math.*")


def math_content(spark, sf):
    return extract_pages(math_pages(spark, sf), process_math=True).select("page_id", "content")


def mathml_to_tex(spark, sf):
    src = math_pages(spark, sf).withColumn("html", F.regexp_replace("html", "(?s)<semantics>(.*?)<annotation.*?</annotation></semantics>", "$1"))
    m = normalize_math(src, fallback=True)
    return m.select("page_id", F.regexp_extract("html", r"\$+([^$]+)\$", 1).alias("tex"), "math.fallback_processed")


SNIPPETS = [
    "concat('cost $', l_quantity, '$ and $$y = ', l_linenumber, '$$ end')",
    "concat('see \\\\(', l_partkey, ' + 1\\\\) here')",
    "concat('a \\\\[z_', l_suppkey, '\\\\] and $q$')",
    "concat('\\\\begin{align*} a &= ', l_linenumber, ' \n b \\\\end{align*}')",
    "'only one $ sign'",
    "concat('no math ', l_partkey)",
    "'$$ $$ then $ $ and $k$'",
]
FIRST = [
    "'$$y = ' || l_linenumber || '$$'",
    "'$' || l_partkey || ' + 1$'",
    "'$$z_' || l_suppkey || '$$'",
    "'$$a &= ' || l_linenumber || ' b$$'",
    "NULL",
    "NULL",
    "NULL",
]


def _snippet(values):
    return f"CASE CAST((l_partkey + l_linenumber) % {len(values)} AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def snippets(spark, sf):
    return spread_table(spark, sf, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", F.expr(_snippet(SNIPPETS)).alias("text"))


def tex_delimited(spark, sf):
    t = snippets(spark, sf)
    return t.select("l_orderkey", "l_linenumber", F.posexplode(X.delimited_tex(F.col("text"))).alias("n", "m")).select("l_orderkey", "l_linenumber", "n", "m.tex", "m.display")


WRAPPED = "CASE p_partkey % 4 WHEN 0 THEN concat(' \\\\begin{equation}', p_size, '\\\\end{equation} ') WHEN 1 THEN concat('\\\\begin{align*} ', p_size, ' \\\\end{align*}') WHEN 2 THEN concat(' ', p_size, '\n') ELSE '\\\\begin{equation} \\\\end{equation}' END"
ANNOTATED = "SELECT p_partkey AS page_id, " + _duck(TEX) + f" AS tex FROM part WHERE p_partkey % {N} < 6"

QUERIES = {
    "math_detect": lambda s, sf: pages(s, sf).select("page_id", X.has_math(F.col("html")).alias("math")),
    "math_detect_text": lambda s, sf: snippets(s, sf).select("l_orderkey", "l_linenumber", X.has_math(F.col("text")).alias("math")),
    "math_extract": lambda s, sf: snippets(s, sf).select("l_orderkey", "l_linenumber", X.first_math(F.col("text")).alias("math")),
    "math_extract_documents": lambda s, sf: table(s, sf, "documents").select("doc_id", X.first_math(F.col("text")).alias("math")),
    "math_counts": lambda s, sf: table(s, sf, "documents").select("doc_id", X.math_counts(F.col("text")).alias("c")).select("doc_id", "c.*"),
    "tex_clean": lambda s, sf: table(s, sf, "part").select("p_partkey", X.clean_tex(F.expr(WRAPPED)).alias("tex")),
    "tex_annotations": lambda s, sf: math_pages(s, sf).select("page_id", F.explode(X.annotation_tex(F.col("html"))).alias("tex")),
    "tex_scripts": lambda s, sf: math_pages(s, sf).select("page_id", F.explode(X.script_tex(F.col("html"))).alias("m")).select("page_id", "m.*"),
    "tex_delimited": tex_delimited,
    "math_normalize": math_normalize,
    "math_stats": math_stats,
    "math_totals": lambda s, sf: math_totals(normalize_math(math_pages(s, sf))),
    "math_content": math_content,
    "mathml_to_tex": mathml_to_tex,
    "math_without_fallback": lambda s, sf: normalize_math(math_pages(s, sf), fallback=False).select("page_id", "math.*"),
}

SIGNS = " OR ".join("regexp_matches(html, '(?is)" + s.replace("'", "''") + "')" for s in X.MATH_SIGNS)


def _delim_rows():
    k = "(l_partkey + l_linenumber) % 7"
    rows = [
        (0, 0, "printf('%.1f', l_quantity)", "false"), (0, 1, "'y = ' || l_linenumber", "true"), (1, 0, "l_partkey || ' + 1'", "false"),
        (2, 0, "'z_' || l_suppkey", "true"), (2, 1, "'q'", "false"), (6, 0, "'k'", "false"),
    ]
    return "\nUNION ALL ".join(f"SELECT l_orderkey, l_linenumber, {n} AS n, {t} AS tex, {d} AS display FROM lineitem WHERE {k} = {form}" for form, n, t, d in rows)


KIND = [k for k, _ in FORMS]
CONTENT_TEX = {"inline": f"'$' || {_duck(TEX)} || '$'", "display": f"'$$' || {_duck(TEX)} || '$$'"}


def _content():
    out = []
    for i, kind in enumerate(KIND):
        if kind == "none":
            out.append("'Before ' || p_size || ' after'")
        elif i == 8:
            out.append(f"'Before' || chr(10) || chr(10) || '$$' || {PLAIN_TEX} || '$$' || chr(10) || chr(10) || 'after'")
        elif i == 9:
            out.append("'Before $' || " + MATRIX_TEX.replace("&amp;", "&") + " || '$ after'")
        elif kind == "display":
            out.append(f"'Before' || chr(10) || chr(10) || {CONTENT_TEX[kind]} || chr(10) || chr(10) || 'after'")
        else:
            out.append(f"'Before ' || {CONTENT_TEX[kind]} || ' after'")
    return _cases(out)


ORACLES = {
    "math_detect": f"SELECT page_id, {SIGNS} AS math FROM pages",
    "math_detect_text": "SELECT l_orderkey, l_linenumber, (l_partkey + l_linenumber) % 7 IN (0, 1, 2, 6) AS math FROM lineitem",
    "math_extract": f"SELECT l_orderkey, l_linenumber, {_snippet(FIRST)} AS math FROM lineitem",
    "math_extract_documents": r"""WITH t AS (SELECT doc_id, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g') AS x FROM documents),
m AS (SELECT doc_id, trim(regexp_extract(x, '\$\$([^$]+)\$\$', 1)) AS a, trim(regexp_extract(x, '\\\[([^\]]+)\\\]', 1)) AS b, trim(regexp_extract(x, '\$([^$\n]+)\$', 1)) AS c, trim(regexp_extract(x, '\\\(([^)]+)\\\)', 1)) AS d FROM t)
SELECT doc_id, CASE WHEN a <> '' THEN '$$' || a || '$$' WHEN b <> '' THEN '$$' || b || '$$' WHEN c <> '' THEN '$' || c || '$' WHEN d <> '' THEN '$' || d || '$' END AS math FROM m""",
    "math_counts": r"""SELECT doc_id, i AS inline_math, d AS display_math, i + d AS total_expressions FROM (SELECT doc_id, len(regexp_extract_all(text, '\$[^$\n]+\$')) AS i, len(regexp_extract_all(text, '\$\$[^$]+\$\$')) AS d FROM documents)""",
    "tex_clean": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE CAST(p_size AS VARCHAR) END AS tex FROM part",
    "tex_annotations": ANNOTATED,
    "tex_scripts": f"SELECT p_partkey AS page_id, {_duck(TEX)} AS tex, p_partkey % {N} = 7 AS display FROM part WHERE p_partkey % {N} IN (6, 7)",
    "tex_delimited": _delim_rows(),
    "math_normalize": normalized_html(),
    "math_stats": f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % {N} < 8 THEN 1 ELSE 0 END AS processed, CASE WHEN p_partkey % {N} >= 8 THEN 1 ELSE 0 END AS remaining_math,
  CASE WHEN p_partkey % {N} = 10 THEN 1 ELSE 0 END AS remaining_katex, 0 AS remaining_mathjax, CASE WHEN p_partkey % {N} IN (8, 9) THEN 1 ELSE 0 END AS fallback_processed FROM part""",
    "math_without_fallback": f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % {N} < 8 THEN 1 ELSE 0 END AS processed, CASE WHEN p_partkey % {N} >= 8 THEN 1 ELSE 0 END AS remaining_math,
  CASE WHEN p_partkey % {N} = 10 THEN 1 ELSE 0 END AS remaining_katex, 0 AS remaining_mathjax, 0 AS fallback_processed FROM part""",
    "math_totals": f"""SELECT count(*) FILTER (WHERE k < 10) AS pages_with_math, count(*) FILTER (WHERE k < 8) AS processed, count(*) FILTER (WHERE k >= 8) AS remaining_math, count(*) FILTER (WHERE k = 10) AS remaining_katex, 0 AS remaining_mathjax, count(*) FILTER (WHERE k IN (8, 9)) AS fallback_processed
FROM (SELECT p_partkey % {N} AS k FROM part)""",
    "math_content": f"SELECT p_partkey AS page_id, {_content()} AS content FROM part",
    "mathml_to_tex": f"""SELECT p_partkey AS page_id, {_cases(["'x'"] * 6 + [_duck(ENC)] * 2 + [PLAIN_TEX, MATRIX_TEX, "''"])} AS tex, CASE WHEN p_partkey % {N} < 6 OR p_partkey % {N} IN (8, 9) THEN 1 ELSE 0 END AS fallback_processed FROM part""",
}
