"""Documents in every format, with the options that change them."""

import json

import pytest

from parchmint.operators import emit
from parchmint.options import Options
from parchmint.plans import convert, fixtures
from parchmint.sources import files

PAGE = """<html><head><title>T &amp; U</title></head><body><main><h1>T &amp; U</h1><h2>Sub <i>x</i></h2><p>some <b>bold</b>, <a href="/l">link</a> and <code>c|d</code> and text that is long enough to be an article for once, really</p>
<ol><li>one<ul><li>in <a href="/m">m</a></li></ul></li><li>two</li></ol><table><thead><tr><th>a</th><th></th><th>a</th></tr></thead><tbody><tr><td>1|2</td><td>x<br>y</td><td>3</td></tr><tr><td>4</td></tr></tbody></table>
<table><tr><td>no</td><td>head</td></tr></table><pre><code class="language-py">a = "```"
</code></pre><blockquote><p>q1</p><p>q2</p></blockquote><hr><p><img src="/i.png" alt="pic"></p></main></body></html>"""


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("page one.html", PAGE.encode(), "", "http://h/x"), ("bad.ipynb", b"{", "", None), ("n.md", b"---\ntitle: N\n---\n# N\n\n[r][1]\n", "", None)]
    df = spark.createDataFrame(rows, "name string, content binary, mime string, url string")
    return files.read(files.detected(df)).cache()


def one(docs, fmt, name="page one.html", opts=Options()):
    return emit.render(docs, fmt, opts).where(f"name = '{name}'").first()


def test_markdown(docs):
    r = one(docs, "md")
    assert r.filename == "page one.md" and r.bytes == len(r.content.encode())
    body = r.content
    for piece in ("---\ntitle: \"T & U\"\nsource: http://h/x\nsource_format: html\n---\n\n# T & U\n\n## Sub _x_\n\nsome **bold**, [link](http://h/l) and `c|d` and", "\n\n1. one\n   1. in [m](http://h/m)\n2. two\n\n", "| a |  | a |\n| --- | --- | --- |\n| 1\\|2 | x<br>y | 3 |\n| 4 |  |  |\n\n<table><tbody><tr><td>no</td>", '\n\n````py\na = "```"\n````\n\n> q1\n>\n> q2\n\n---\n\n![pic](http://h/i.png)\n'):
        assert piece in body, piece
    assert one(docs, "md", "bad.ipynb").content is None
    assert one(docs, "md", "n.md").content == "---\ntitle: N\nsource_format: markdown\n---\n\n# N\n\n[r][1]\n"


def test_markdown_options(docs):
    opts = Options(frontMatter=False, headingStyle="setext", codeBlockStyle="indented", linkStyle="referenced", bulletMarker="*", mdFlavor="commonmark", wrap=40)
    body = one(docs, "md", opts=opts).content
    assert body.startswith("T & U\n=====\n\nSub _x_\n-------\n\n") and '\n\n    a = "```"\n\n' in body and "[link][1]" in body and "[1]: http://h/l" in body and "| ---" not in body
    assert max(len(x) for x in body.split("\n") if x.startswith("some") or x.startswith("text")) <= 40


def test_html_text_and_json(docs):
    h = one(docs, "html").content
    assert "<title>T &amp; U</title>" in h and "<h2>Sub <em>x</em></h2>" in h and '<a href="http://h/l">link</a> and <code>c|d</code>' in h and "<li>one<ol><li>in" in h and "<td>x<br>y</td>" in h and '<p class="about">from HTML</p>' in h
    assert h.count("<ol>") == h.count("</ol>") == 2 and h.count("<li>") == h.count("</li>") == 3
    t = one(docs, "txt").content
    assert t.startswith("T & U\n\nSub x\n\n") and "- one\n  - in m\n- two\n" in t and "1|2  x; y  3" in t and "[image: pic]" in t and "----------" in t
    j = json.loads(one(docs, "json").content)
    table = next(b for b in j["blocks"] if b["type"] == "table")
    assert table["records"] == [{"column_2": "x; y", "a": "3"}, {"column_2": "", "a": ""}] and j["stats"]["blocks"] == len(j["blocks"]) and j["metadata"]["title"] == "T & U"
    assert j["stats"]["token_estimate"] == "characters/4" and j["blocks"][0] == {"index": 0, "type": "heading", "level": 1, "text": "T & U", "markdown": "# T & U"}


def test_front_matter_with_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([({"title": "a: b", "ocrPages": "3", "tablesUnresolved": "0", "other": "x"}, [("w", 1.5, 2)]), ({}, None)], "meta map<string,string>, low array<struct<text:string,confidence:double,page:int>>")
    got = [r.f for r in df.select(emit.front_matter(F.col("meta"), F.col("low")).alias("f")).collect()]
    assert got == ['---\ntitle: "a: b"\nocr: true\nocr_pages: 3\nocr_low_confidence:\n  - text: w\n    confidence: 1.5\n    page: 2\n---\n\n', ""]


def test_review_marks_and_never_changes_values(spark):
    csv = b"Item,Amount\na,$1.00\nb,$2.00\nTotal,$9.00\n"
    html = b"<h1>$5.00</h1><ul><li>Total $7.00</li></ul>"
    df = spark.createDataFrame([("t.csv", csv, "", None), ("h.html", html, "text/html", None)], "name string, content binary, mime string, url string")
    docs, out = convert.convert(df, Options(outputs=("md", "json"), readability=False))
    got = {(r.name, r.format): r.content for r in out.collect()}
    assert "needs_review: true\nreview_flags: 1" in got["t.csv", "md"] and "$9.00" in got["t.csv", "md"] and "$3.00" not in json.loads(got["t.csv", "json"])["blocks"][0]["text"]
    assert "$5.00 ⚠ <!-- REVIEW: the headline figure $5.00 matches none of the totals stated elsewhere on the page ($7.00) -->" in got["h.html", "md"]
    review = json.loads(got["t.csv", "json"])["review"]
    assert review[0]["type"] == "total-mismatch" and review[0]["message"] == "line items sum to $3.00 but the total row says $9.00 (off by $6.00)" and review[0]["context"] == "$9.00"
    plain, _ = convert.convert(df, Options(validate=False, readability=False))
    assert "review" not in plain.columns


def test_archives_errors_and_names_through_the_whole_plan(spark):
    z = fixtures.zipped({"a/x.csv": "h\n1", "b/x.csv": "h\n2"})
    df = spark.createDataFrame([("z.zip", z, "", None), ("x.csv", b"h\n3", "", None), ("q.ipynb", b"{", "", None), ("u.bin", b"\x00", "", None)], "name string, content binary, mime string, url string")
    docs, out = convert.convert(df)
    rows = docs.collect()
    assert sorted(r.name for r in rows) == ["q.ipynb", "u.bin", "x-2.csv", "x-3.csv", "x.csv"] and sorted(r.name for r in rows if r.error) == ["q.ipynb", "u.bin"]
    assert sum(r.content is not None for r in out.collect()) == 3


def test_unique_names_pass_over_taken_ones(spark):
    names = ["a.md", "a.md", "a-2.md", "a.md", "b", "b", "a-2.md"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, filename string")
    got = [r.filename for r in emit.unique_names(df, order=["i"]).orderBy("i").collect()]
    assert len(set(got)) == len(names) and got[0] == "a.md" and got[2] == "a-2.md" and got[4] == "b" and got[5] == "b-2"


def test_formats_can_be_added(docs):
    from pyspark.sql import functions as F

    emit.EMITTERS["count"] = ("text/plain", lambda docs, opts: F.size("blocks").cast("string"))
    assert one(docs, "count").content == str(len(docs.where("name = 'page one.html'").first().blocks))
    del emit.EMITTERS["count"]
    with pytest.raises(TypeError):
        Options().but(unknown=1)
