"""Every reader on small files: what is read, what is warned of, and that a broken file is a row with an error."""

import json

import pytest

from parchmint.options import Options
from parchmint.plans import fixtures as X
from parchmint.sources import blocks as B
from parchmint.sources import files, readers, tree
from parchmint.sources.readers import office, plain, rich

OPTS = Options()


def read(kind, content, name="f.x", ext="", opts=OPTS):
    return files.document(content if isinstance(content, bytes) else content.encode(), name, kind, ext, opts)


def shown(doc):
    return [(b.type, b.text) for b in doc.blocks]


def test_delimited_files():
    d = read("csv", 'Region,Volume,Change\nEast,18420,+11%\nWest,"12,905",+2%\n\n,,\nNorth,7310\n', "a.csv", "csv")
    assert d.blocks[0].header == ["Region", "Volume", "Change"] and d.blocks[0].rows[1:] == [["West", "12,905", "+2%"], ["North", "7310", ""]]
    assert d.meta["rows"] == 3 and d.meta["columns"] == 3 and len(d.warnings) == 1
    assert read("csv", "a\t1\nb\t2", "a.tsv", "tsv").blocks[0].header == ["Column 1", "Column 2"]
    assert read("csv", "", "a.csv", "csv").blocks[0].text == "(empty file)"
    cut = read("csv", "h\n" + "x\n" * 20, "a.csv", "csv", OPTS.but(maxSheetRows=5))
    assert len(cut.blocks[0].rows) == 4 and "Truncated to 5 of 21" in cut.warnings[0]
    assert plain.sniffed("a;b\n1;2\n") == ";" and len(read("csv", "a,b\n" + "x\n" * 9, "a.csv", "csv").warnings) == 6


def test_records():
    d = read("json", '[{"id": 1, "a": null}, {"id": 2.0, "b": "x"}]')
    assert d.blocks[0].header == ["id", "a", "b"] and d.blocks[0].rows == [["1", "", ""], ["2", "", "x"]]
    assert shown(read("json", "{"))[0][0] == "code" and "Not valid JSON" in read("json", "{").warnings[0]
    d = read("jsonl", '{"id":1}\n' + "bad\n" * 7 + '{"id":2}')
    assert len(d.blocks[0].rows) == 2 and d.warnings[0].startswith("Line 2 ") and d.warnings[-1] == "...and 2 more bad lines."
    deep = json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}})
    assert read("json", deep).blocks[-1].type == "code"
    d = read("yaml", "service: a\nlimits:\n  cpu: 2\nregions: [x, y]\n")
    assert shown(d) == [("list", "service: a"), ("heading", "limits"), ("list", "cpu: 2"), ("heading", "regions"), ("list", "x y")]
    assert read("xml", "<a><t>News</t><b><c/></b></a>").blocks[0].text == "<a>\n  <t>News</t>\n  <b>\n    <c/>\n  </b>\n</a>"


def test_text_code_and_markdown():
    d = read("text", "one\ntwo\r\n\r\n\r\n* three *", opts=OPTS.but(repairStructure=False))
    assert [b.markdown for b in d.blocks] == ["one  \ntwo", "\\* three \\*"]
    assert read("code", "x", "s.py", "py").blocks[0].language == "python"
    d = read("markdown", '---\ntitle: "T"\n---\n# H #\n\ntext **b** [l](u)\n\n1. a\n   - b\n2. c\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n\n```py\n# no\n```\n> q\n---\n')
    assert d.meta["title"] == "T" and d.native.startswith("# H")
    assert shown(d) == [("heading", "H"), ("paragraph", "text b l"), ("list", "a b c"), ("table", "a b 1 x|y"), ("code", "# no"), ("quote", "q"), ("divider", "")]
    assert d.blocks[2].ordered and [i[0] for i in d.blocks[2].items] == [0, 1, 0]


def test_transcripts():
    assert plain.cues("WEBVTT\n\n1:02.500 --> 1:03.000\n<v A>Hi {\\an8}there\n\nno time\n") == [("00:01:02", "Hi there")]
    # the repeat that opens a paragraph is passed over, and the rule about sentences has no words to look at
    assert plain.transcript([("00:00:00", "A."), ("00:00:50", "A."), ("00:01:15", "B")]) == [("00:00:00", "A."), ("00:00:50", "B")]
    assert plain.transcript([("00:00:00", "a."), ("00:00:21", "b"), ("00:00:22", "b"), ("00:01:07", "c")]) == [("00:00:00", "a."), ("00:00:21", "b"), ("00:01:07", "c")]
    assert read("subtitles", "nothing").warnings


def test_notebooks():
    cells = [{"cell_type": "markdown", "source": ["# A\n"]}, {"cell_type": "code", "source": "```", "outputs": [{"output_type": "stream", "text": "hello\n"}, {"output_type": "error", "traceback": ["\x1b[31mboom\x1b[0m"]}, {"output_type": "display_data", "data": {"image/png": "aGk=", "text/plain": "x"}}]}, {"cell_type": "raw", "source": "r"}]
    d = read("ipynb", json.dumps({"cells": cells}))
    assert d.native == "# A\n\n````python\n```\n````\n\n```text\nhello\n```\n\n```text\nboom\n```\n\n![output](data:image/png;base64,aGk=)\n\n```\nr\n```"
    assert "x" in read("ipynb", json.dumps({"worksheets": [{"cells": cells[1:2]}]}), opts=OPTS.but(imageMode="strip")).native


def test_mail_and_web_archives():
    parts = b'From: a@b\nTo: c@d\nSubject: =?utf-8?B?SGVsbG8=?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/plain\n\nplain\n--x\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>10=25 <b>off</b></p>\n--x\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="a.pdf"\n\nx\n--x--\n'
    d = read("eml", parts)
    assert shown(d)[0] == ("heading", "Hello") and ("paragraph", "10% off") in shown(d) and d.meta["attachments"] == 1 and shown(d)[-1] == ("list", "a.pdf (application/pdf)")
    web = b'Snapshot-Content-Location: https://example.com/a/b\nContent-Type: multipart/related; boundary="x"\n\n--x\nContent-Type: text/html\n\n<title>T</title><p><a href="/next">n</a><img src="cid:i1">\n--x\nContent-Type: image/png\nContent-ID: <i1>\nContent-Transfer-Encoding: base64\n\niVBORw==\n--x--\n'
    d = read("mhtml", web)
    assert "https://example.com/next" in d.blocks[1].markdown and "data:image/png;base64,iVBORw==" in d.blocks[1].markdown
    with pytest.raises(ValueError):
        read("mhtml", b"Content-Type: text/plain\n\nx")


LONG = "long text, with commas. " * 20


def test_pages():
    d = read("html", f'<html><head><title>Hi</title><meta property="article:author" content=" Me "></head><body><nav><a href=x>m</a><article><h2>Two</h2><p>{LONG}<p>more</article><footer>f</footer>')
    assert shown(d)[:2] == [("heading", "Hi"), ("heading", "Two")] and d.meta["author"] == "Me" and "m" not in [t for _, t in shown(d)] and "f" not in [t for _, t in shown(d)]
    # an open <nav> doesn't take the page with it; a nested </div> doesn't end what is hidden
    assert [t for _, t in shown(read("html", f"<body><nav><ul><li>menu</ul><p>{LONG}</p><div class='ad'><div>x</div>AD TEXT</div><p>end</p>"))] == [LONG.strip(), "end"]
    bare = read("html", "<p>short</p><aside>x</aside>", opts=OPTS.but(readability=False))
    assert shown(bare) == [("paragraph", "short")] and not bare.warnings


def test_trees():
    root = tree.parse('<p>a<p>b<table><tr><td>1<td>2<tr><td>3</table><ul><li>x<ul><li>y</ul><li>z</ul><a href="java\nscript:x" onclick=y>l</a><script>s</script>')
    tree.sanitized(root)
    assert root.html() == '<p>a</p><p>b</p><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><ul><li>x<ul><li>y</li></ul></li><li>z</li></ul><a href="java\nscript:x" target="_blank" rel="noopener noreferrer nofollow">l</a>' or "javascript" not in root.html()
    assert "onclick" not in root.html() and "<script" not in root.html()
    links = tree.absolute(tree.parse('<a class="k" href="/z">1</a><a href="//c/x">2</a><a href="../y">3</a><img src="data:x">'), "http://h/a/b/c")
    assert [n.attrs.get("href", n.attrs.get("src")) for n in links.walk() if n.tag in ("a", "img")] == ["http://h/z", "http://c/x", "http://h/a/y", "data:x"]
    inner = B.from_tree(tree.parse('<p>see <a href="https://a.b/c_d">https://a.b/c_d</a> <b>x</b><sub>2</sub> <code>a`b</code> <mark>m</mark> <del>d</del>*</p>'), OPTS)[0].markdown
    assert inner == "see <https://a.b/c_d> **x**<sub>2</sub> ``a`b`` ==m== ~~d~~\\*"


def test_workbooks():
    rows = [["Quarter", "Closed", "Rate", "Sum"], ["Q1", (45383.0, 1), (0.421, 2), 18420.5], [None, (45384.25, 1), None, 0.1 + 0.2], [True, None, None, -0.0]]
    d = read("xlsx", X.xlsx({"Revenue": rows, "Secret": [["x"]], "Empty": []}, {"A2": "http://q"}, ("Secret",)))
    t = d.blocks[1]
    assert shown(d)[0] == ("heading", "Revenue") and t.header == ["Quarter", "Closed", "Rate", "Sum"] and d.meta["sheets"] == 3 and len(d.blocks) == 2
    assert t.rows == [["Q1", "2024-04-01", "42.1%", "18420.5"], ["", "2024-04-02 06:00:00", "", "0.3"], ["TRUE", "", "", "0"]] and t.cells[1][0] == "[Q1](http://q)"
    d = read("xlsx", X.xlsx({"A": [[1, 'x,"y"']], "B": []}), opts=OPTS.but(sheetMode="csv-block", includeEmptySheets=True))
    assert d.blocks[1].text == '1,"x,""y"""' and d.blocks[-1].text == "(empty sheet)"
    assert [office.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and office.column_index("AAA12") == 702
    assert office.is_date_format('0.00" d"') is False and office.is_date_format("[$-409]h:mm") and [office.trimmed_number(x) for x in (1e21, 1e-7, 1.5e-8, 123456789012345)] == ["1e+21", "1e-7", "1.5e-8", "123456789012000"]
    assert office.serial_text(0.5, False, "hh:ss") == "12:00:00" and office.serial_text(1, True) == "1904-01-02"


def test_text_documents_slides_and_books():
    d = read("docx", X.docx([("H2", "Title"), ("", "Body *x*"), ("C", "a"), ("C", "b"), ("Odd", "p")], {"H2": "heading 2", "C": "Code"}))
    assert shown(d) == [("heading", "Title"), ("paragraph", "Body *x*"), ("code", "a\nb"), ("paragraph", "p")] and d.blocks[0].level == 2 and len(d.warnings) == 1
    d = read("pptx", X.pptx([("One", ["a", "b"], "said"), ("Two", [], "")]))
    assert shown(d) == [("heading", "One"), ("list", "a b"), ("quote", "Speaker notes said"), ("heading", "Two")]
    assert shown(read("pptx", X.pptx([("One", ["a"], "said")]), opts=OPTS.but(includeSpeakerNotes=False))) == [("heading", "One"), ("list", "a")]
    assert shown(read("odt", X.odt([(2, "H"), (0, "p")]))) == [("heading", "H"), ("paragraph", "p")]
    assert read("ods", X.ods({"S": [["a", "b"], ["1", ""]]})).blocks[1].rows == [["1"]]
    d = read("epub", X.epub("T", ["<p>one <a href='c1.xhtml'>next</a></p>", "<p>two</p>"]))
    assert shown(d) == [("heading", "T"), ("paragraph", "one next"), ("divider", ""), ("paragraph", "two")] and "](c1" not in d.blocks[1].markdown
    with pytest.raises(ValueError):
        read("epub", X.zipped({"mimetype": "application/epub+zip"}))


def test_rich_text():
    raw = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\fs48 Title\par\fs24 Body \b bold\b0  caf\'e9 \u-10179?\u-8704? x\par{\*\gen zzz}- item one\par- item two\par{\header h}\~end}"
    d = read("rtf", raw)
    assert shown(d) == [("heading", "Title"), ("paragraph", "Body bold café 😀 x"), ("list", "item one item two"), ("paragraph", "end")]
    assert rich.body_size(rich.paragraphs(raw)) == 24 and d.blocks[1].markdown.startswith("Body **bold**")


def test_repair_and_lists():
    p = lambda t, bold=False: B.Block("paragraph", t, f"**{t}**" if bold else t, bold=bold)
    got = B.repaired([p("Heading", True), p("Not one:", True), p("- lone"), p("text"), p("• one"), p("1. aa"), p("2. bb"), p("x")])
    assert [(b.type, b.text) for b in got] == [("heading", "Heading"), ("paragraph", "Not one:"), ("paragraph", "- lone"), ("paragraph", "text"), ("list", "one"), ("list", "aa bb"), ("paragraph", "x")]
    assert got[0].markdown == "Heading" and got[5].ordered
    assert [i[0] for i in B.nested([(3, "a", "a"), (1, "b", "b"), (9, "c", "c"), (0, "d", "d")], False).items] == [0, 1, 2, 0]


@pytest.mark.parametrize("mode, kept", [("embed", True), ("extract", True), ("link", False), ("strip", False)])
def test_image_policy(mode, kept):
    html = f'<main><p>{LONG}<img alt="pic" src="data:image/png;base64,aGk="></p><p><img src="data:image/png;base64,aGk="></p></main>'
    d = read("html", html, "a b.html", opts=OPTS.but(imageMode=mode))
    assert ("![pic](" in d.blocks[0].markdown) == kept and ("[image: pic]" in d.blocks[0].markdown) == (not kept)
    assert [a[0] for a in d.assets] == (["a b_assets/image-001.png", "a b_assets/image-002.png"] if mode == "extract" else []) and bool(d.warnings) == (not kept)
    assert len(read("html", html, opts=OPTS.but(maxImageBytes=1)).blocks) == 1


def test_detection_archives_and_isolation(spark):
    zipped = X.zipped({"a/one.csv": "x,y\n1,2", "__MACOSX/two.csv": "x", "deep.zip": b"z", "three.docx": X.docx([("", "t")])})
    rows = [
        (0, "b.zip", zipped, ""), (1, "t.docx", X.docx([("", "t")]), ""), (2, "w.bin", X.xlsx({"S": [["a", "b"], [1, 2]]}), ""), (3, "o.zip", X.odt([(0, "o")]), ""), (4, "n.odt", b"PK\x03\x04broken", ""),
        (5, "old.doc", bytes.fromhex("D0CF11E0A1B11AE1"), ""), (6, "note", b"plain text", ""), (7, "bad.ipynb", b"{", ""), (8, None, None, None), (9, "x.epub", X.epub("T", ["<p>c</p>"]), ""), (10, "pic.txt", b"\x89PNG\r\n", ""),
    ]
    df = spark.createDataFrame(rows, "place long, name string, content binary, mime string").selectExpr("*", "CAST(NULL AS STRING) AS url")
    found = {r.place: r for r in files.detected(df).collect()}
    assert [found[i].kind for i in range(11)] == ["archive", "docx", "xlsx", "odt", "archive", "unsupported", "text", "ipynb", "text", "epub", "image"] and "legacy" in found[5].note
    inner = sorted(((r.place, r.part, r.name, r.parent, r.error) for r in files.expanded(files.detected(df)).collect()), key=str)
    assert (0, 0, "one.csv", "b.zip", None) in inner and (0, 1, "three.docx", "b.zip", None) in inner and len(inner) == 12 and any(r[0] == 4 and r[4] for r in inner)
    docs = {r.place: r for r in files.read(files.detected(df)).collect()}
    assert len(docs) == 11 and "legacy" in docs[5].error and "not valid JSON" in docs[7].error and docs[10].error and docs[1].blocks[0].text == "t" and docs[8].error is None
    assert files.read(files.detected(df.limit(0))).count() == 0


def test_readers_can_be_added():
    @readers.register("shout")
    def read_shout(content, name, ext, opts):
        return B.Document([B.paragraph(content.decode().upper())])

    assert shown(read("shout", "hey")) == [("paragraph", "HEY")]
    del readers.READERS["shout"]
    with pytest.raises(ValueError):
        read("shout", "hey")
