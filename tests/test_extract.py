import itertools
import json
import random

from pyspark.sql import functions as F

from language_sentences import SENTENCES
from leafpress.functions import html as H
from leafpress.functions import ngrams
from leafpress.functions.language_samples import COMMON, SAMPLES
from leafpress.functions.arrays import first_by, replace_each, scan
from leafpress.operators import extract as X
from leafpress.operators.language import voted_language
from leafpress.operators.metadata import json_ld_table

PAGE = """<!DOCTYPE html><html lang="en-GB"><head><title>A &amp; B</title><style>p{}</style>
<meta name="author" content="Ann"><meta property="og:site_name" content='S "q"'><meta name=keywords content="x, y"></head><body>
<header><p>Site head</p></header><nav><a href="/1">One</a></nav>
<script>var a = "<!-- </p>";</script><noscript><p>enable</p></noscript>
<main><header><h1>Title</h1></header><p>First <b>bold</b> and <i>it</i> with <a href="/l?a=1&amp;b=2">link</a>.<p>Second<br>line
<ul><li>item one</li><li><a href="/x">only link</a></ul>
<blockquote><p>quoted</p></blockquote><div class="promo box"><div>buy</div><p>more</p></div><p>after ad</p>
<table><tr><th>k</th><td>v</td></tr></table>
<p>First bold and it with link.</p><img src="i.png" alt="pic">
<section id="comments"><p>Nice post</p></section></main><aside>side</aside><footer>foot</footer>"""


def extract(spark, html, **options):
    df = spark.createDataFrame([(1, "https://e.example.com/p", html)], "page_id long, url string, html string")
    return X.extract_pages(df, **options).first()


def test_markdown(spark):
    r = extract(spark, PAGE)
    assert r.content.split("\n\n") == [
        "# Title", "First bold and it with link.", "Second line", "- item one", "> quoted", "after ad", "| k | v |",
    ]
    m = r.metadata
    assert (m.title, m.author, m.sitename, m.tags, m.language, m.hostname) == ("A & B", "Ann", 'S "q"', ["x", "y"], "en", "e.example.com")


def test_switches(spark):
    assert "k | v" not in extract(spark, PAGE, include_tables=False).content
    assert "Nice post" in extract(spark, PAGE, include_comments=True).content
    assert "[link](/l?a=1&b=2)" in extract(spark, PAGE, include_links=True).content
    assert "**bold** and *it*" in extract(spark, PAGE, include_formatting=True).content
    assert "![pic](i.png)" in extract(spark, PAGE, include_images=True).content
    assert extract(spark, PAGE, deduplicate=False).content.count("First bold") == 2
    assert "Second line" not in extract(spark, PAGE, favor_precision=True).content
    assert extract(spark, PAGE, target_lang="fr").status == "lang_mismatch"
    assert extract(spark, PAGE, output_format="txt").content.startswith("Title\nFirst")
    images = extract(spark, PAGE, extract_images=True).images
    assert [i.url for i in images] == ["https://e.example.com/p/i.png"]


def test_broken_pages(spark):
    assert extract(spark, None).status == "no_page"
    assert extract(spark, "").status == "empty"
    assert extract(spark, "<html><body></body></html>").status == "empty"
    assert extract(spark, "a < b & c &#x41;&#65;&bogus; &#0;<p").content == "a < b & c AA&bogus; �<p"
    assert extract(spark, "<p>x</p><!-- open <p>y").content == "x"
    assert extract(spark, "</nav></nav><p>kept</p><nav><p>gone</p>").content == "kept"


def test_a_long_page_is_read_to_its_end(spark):
    html = "<article>" + "".join(f"<p>para {i} <a href='/{i}'>l</a></p>" for i in range(5000)) + "</article>"
    blocks = extract(spark, html).content.split("\n\n")
    assert blocks == [f"para {i} l" for i in range(5000)]


def test_stray_quote_in_text_and_tag_in_attribute(spark):
    assert extract(spark, "<p>don't <a title='x > y' href=z>stop</a> it's</p><p>next</p>").content == "don't stop it's\n\nnext"


def test_attribute_is_not_found_inside_a_value(spark):
    tag = """<img alt="see src=wrong.png" data-src='no' src = "right.png">"""
    assert spark.range(1).select(H.attribute(F.lit(tag), "src")).first()[0] == "right.png"


def test_array_helpers(spark):
    df = spark.range(1).select(F.expr("transform(sequence(1, 1000), x -> cast(x as int))").alias("a"))
    sums = df.select(scan(F.col("a"), F.lit(0).cast("long"), lambda s, x: s + x, lambda s: s).alias("s")).first().s
    assert sums == [n * (n + 1) // 2 for n in range(1, 1001)]
    firsts = df.select(first_by(F.col("a"), lambda x: x % 7).alias("f")).first().f
    assert firsts == [1, 2, 3, 4, 5, 6, 7]
    text = spark.range(1).select(replace_each(F.lit("a1b22c"), r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))).first()[0]
    assert text == "a<1>b<22>c"
    assert df.select(scan(F.expr("cast(array() as array<int>)"), F.lit(0), lambda s, x: s + x, lambda s: s)).first()[0] == []


def test_language_vote(spark):
    texts = [("der die das und", "de"), ("the cat and the dog", "en"), ("les chats et le chien dans", "fr"), ("los gatos y una", "es"), ("zzz", None)]
    df = spark.createDataFrame(texts, "t string, want string")
    assert df.filter(~voted_language(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


OTHER_LANGUAGES = {
    "it": "Il comune ha detto che la strada non sarà aperta fino al mese di maggio, e i lavori sono fermi per una frana.",
    "pt": "A câmara disse que a estrada não abre até maio e que os trabalhos na ponte foram parados por causa de uma cheia.",
    "nl": "De gemeente heeft gezegd dat de weg niet voor mei open gaat en dat het werk aan de brug nog van een bedrijf is.",
    "ru": "Город сообщил, что дорога не откроется до мая и что работы на мосту остановлены из-за паводка, но это не всё.",
    "uk": "Місто повідомило, що дорога не відкриється до травня і що роботи на мосту зупинено, але це не все.",
    "pl": "Miasto podało, że droga nie będzie otwarta do maja i że prace na moście są wstrzymane, ale to nie wszystko.",
    "sv": "Kommunen sade att vägen inte öppnar för bilar och att arbetet på bron är stoppat, men det är en av många.",
    "fi": "Kaupunki sanoi, että tie ei ole auki ennen kesää ja että työ on kesken, mutta se jatkuu kun vesi laskee.",
    "tr": "Belediye, yolun mayıs ayına kadar açılmayacağını ve köprü için çok daha büyük bir bütçe olduğunu söyledi, ama bu son değil.",
    "ar": "قال رئيس البلدية إن الطريق لن يفتح قبل مايو على أن العمل في الجسر توقف بعد الفيضان من دون خطة",
    "hi": "नगर ने कहा है कि सड़क मई तक नहीं खुलेगी और पुल पर काम बाढ़ के बाद रुका है",
    "el": "Ο δήμος είπε ότι ο δρόμος δεν θα ανοίξει.",
    "ja": "市は道路が五月まで開通しないと発表した。",
    "zh": "市政府表示道路五月之前不会开放。",
    "ko": "시는 도로가 오월까지 열리지 않는다고 밝혔다.",
    "th": "เทศบาลแจ้งว่าถนนจะไม่เปิดจนถึงเดือนพฤษภาคม",
}


def test_undeclared_pages_of_other_languages(spark):
    rows = [(lang, f"<html><body><article><p>{text}</p></article></body></html>") for lang, text in OTHER_LANGUAGES.items()]
    df = spark.createDataFrame([(i, want, html) for i, (want, html) in enumerate(rows)], "page_id long, url string, html string")
    for lang in ("it", "pt", "nl", "ru", "ja", "es", "fr"):
        kept = {r.url for r in X.extract_pages(df, target_lang=lang).filter("status = 'ok'").select("url").collect()}
        assert kept == {lang} & OTHER_LANGUAGES.keys()
    texts = [*((t, lang) for lang, t in OTHER_LANGUAGES.items()), ("Eroski Bilbao que Donostia Gasteiz Iruña Baiona", None), ("le zzz yyy xxx", None), ("", None), ("12 — 34", None), (None, None)]
    wrong = spark.createDataFrame(texts, "t string, want string").select("want", voted_language(F.col("t")).alias("got")).filter("not (want <=> got)")
    assert wrong.collect() == []


def test_recall_of_every_language(spark):
    """Each language offered is told from three sentences that no profile was counted from, related pairs too; none is mistaken."""
    assert set(SENTENCES) == set(SAMPLES) == set(COMMON)
    together = [(" ".join(own), lang) for lang, own in SENTENCES.items()]
    df = spark.createDataFrame(together, "t string, want string").select("want", voted_language(F.col("t")).alias("got"))
    rows = df.collect()
    right = {r.want for r in rows if r.got == r.want}
    assert [(r.want, r.got) for r in rows if r.got not in (r.want, None)] == []
    assert len(right) >= len(SENTENCES) - 1
    assert {"da", "id", "ms", "hr", "sl", "cs", "sk", "sr", "bg", "mk", "gl", "pt", "es", "nl", "af", "hi", "mr", "ne"} <= right


def test_single_sentences_are_seldom_mistaken():
    own = ngrams.profiles()
    told = [(lang, own.language(t)) for lang, texts in SENTENCES.items() for t in texts]
    assert sum(a == b for a, b in told) >= 0.85 * len(told)
    assert sum(b is not None and a != b for a, b in told) <= 0.06 * len(told)
    assert own.language("kat hund hus båd") is None


def test_error_status(spark):
    odd = "<p>Text</p><math><![odd[x]]><mi>y</mi></math><math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>"
    r = extract(spark, odd, process_math=True)
    assert (r.status, r.error) == ("ok", "math: AssertionError: unknown status keyword 'odd' in marked section")
    assert r.content == "Text\n\ny$\\frac{a}{b}$"
    r = extract(spark, "<p>" + "x" * 100 + "</p>", max_chars=50)
    assert (r.status, r.error, r.content, r.metadata) == ("error", "page of more than 50 characters", None, None)
    assert extract(spark, PAGE, process_math=True, max_chars=5000).error is None


def test_columns_of_the_caller_are_kept(spark):
    """Whatever the steps call their own columns, a caller's column of that name comes back as it was."""
    names = ["_body", "_lang", "_long", "_known", "_math_error", "_r", "_h", "_left", "_tex", "_Body"]
    html = PAGE.replace('lang="en-GB"', "") + "<math><mi>a</mi></math>"
    df = spark.createDataFrame([(1, html, *names[:-1])], "page_id long, html string, " + ", ".join(f"{n} string" for n in names[:-1]))
    r = X.extract_pages(df, process_math=True, target_lang="en", max_chars=10**6).first().asDict()
    assert {n: r[n] for n in names[:-1]} == {n: n for n in names[:-1]}


LD = """<html><head><script type="application/ld+json">{"@graph":[{"@type":"Person","@id":"#a","name":"Ann"},
{"@type":["Article","Thing"],"headline":"From \\"data\\"","author":[{"@id":"#a"},"Bo"],"datePublished":"2024-05-06","keywords":["x",{"@type":"DefinedTerm","name":"y"}]},
{"@type":"https://schema.org/WebSite","name":"Site"}]}</script><script type='application/ld+json'>{broken</script></head>"""


def test_json_ld(spark):
    m = extract(spark, LD + "<body><h1>Heading</h1><p>x</p></body></html>").metadata
    assert (m.title, m.author, m.date, m.sitename, m.tags) == ('From "data"', "Ann; Bo", "2024-05-06", "Site", ["x", "y"])
    m = extract(spark, LD.replace("<head>", "<head><title>Own</title><meta name=author content=Cy>") + "<body><p>x</p></body>").metadata
    assert (m.title, m.author, m.date) == ("Own", "Cy", "2024-05-06")
    df = spark.createDataFrame([(1, LD), (2, "<!--" + LD + "--><p>x"), (3, None), (4, '<script type="application/ld+json">[]</script>')], "page_id long, html string")
    told = {r.page_id: (r.scripts, r.broken, r.title) for r in json_ld_table(df).collect()}
    assert told == {1: (2, 1, 'From "data"'), 4: (1, 0, None)}


def test_no_shuffle_in_extraction(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    plan = X.drop_failed(X.extract_pages(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def best_choice(gains, cost):
    """Every choice tried; of equal sums that which keeps the later blocks."""

    def worth(kept):
        return sum(g for g, k in zip(gains, kept) if k) - cost * sum(a != b for a, b in zip(kept, kept[1:]))

    return max(itertools.product([False, True], repeat=len(gains)), key=lambda kept: (worth(kept), kept[::-1]))


def test_context_is_the_best_choice(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for page in range(60):
        blocks = [(rng.choice(["p", "p", "p", "h2", "nav"]), "".join(rng.choices("abcdefg", k=rng.choice([1, 4, 9, 20, 25, 26, 60, 130])))) for _ in range(rng.randint(0, 10))]
        blocks = [(kind, f"{i}{text}") for i, (kind, text) in enumerate(blocks)]
        rows.append((page, "".join(f"<{k}>{t}</{k}>" for k, t in blocks)))
        gains = [-(10**6) if k == "nav" else 10 if k == "h2" else min(len(t), 100) - 25 for k, t in blocks]
        kept = best_choice(gains, 15)
        want[page] = "\n".join(t for (_, t), k in zip(blocks, kept) if k)
    df = spark.createDataFrame([*rows, (-1, None)], "page_id bigint, html string")
    got = X.extract_pages(df, output_format="txt", keep_context=True, with_metadata=False).collect()
    assert {r.page_id: r.content or "" for r in got if r.page_id >= 0} == want
    assert [r.status for r in got if r.page_id == -1] == ["no_page"]
    assert any("\n" in t for t in want.values())


def test_columns_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "<p>Some text</p>", "a", "b", 3)], "page_id bigint, HTML string, Status string, `a``b.c` string, _meta int")
    row = X.extract_pages(df, output_format="json").first()
    assert row.status == "ok" and row["a`b.c"] == "b" and row["_meta"] == 3 and json.loads(row.content)["text"] == "Some text"
    assert "HTML" not in row.asDict() and "Status" not in row.asDict()
