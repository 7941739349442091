"""Glyphs, words and boxes on small pages that are written out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from parchmint.operators import flow, grid, words
from parchmint.operators import glyphs as G
from parchmint.options import Options

GLYPH = "doc_id int, page int, run int, text string, x double, y double, width double, size double, bold boolean, italic boolean, mono boolean"


def glyphs(spark, rows):
    """rows: (page, text, x, y) and size and bold if they aren't 10 and False; six units to a letter."""
    full = [(1, r[0], i, r[1], float(r[2]), float(r[3]), len(r[1]) * 6.0, float(r[4]) if len(r) > 4 else 10.0, len(r) > 5 and r[5], False, False) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, GLYPH)


def pages(spark, n, width=600.0, height=1000.0):
    return spark.createDataFrame([(1, p, width, height) for p in range(1, n + 1)], "doc_id int, page int, width double, height double")


def run(text, x, y=0.0, size=10.0, bold=False, href=None):
    return G.Run(float(x), y, text, len(text) * 6.0, size, bold, False, False, href)


def test_lines_cells_and_overprints(spark):
    assert [r.text for r in G.without_overprints([run("a", 0), run("a", 0.3), run("a", 0.55), run("a", 9), run("b", 9)])] == ["a", "a", "b"]
    cells = G.cells([run("one", 0), run("two", 20), run("x", 33, href="h"), run("far", 60)])
    assert [(c["text"], c["x"], c["x2"]) for c in cells] == [("one twox", 0.0, 39.0), ("far", 60.0, 78.0)]
    assert [s["text"] for s in cells[0]["segments"]] == ["one", " two", "x"] or "".join(s["text"] for s in cells[0]["segments"]) == "one twox"
    assert G.styled(G.segments([run("see ", 0), run("a_b", 24, bold=True, href="u")])) == "see [**a\\_b**](u)"
    assert G.exact_segments([("a  b ", None), ("c", "h")], "a b c") == [("a b ", None), ("c", "h")] and G.exact_segments([("x", "h")], "y") == [("y", None)]
    got = {r.line: (r.text, r.text_size, r.size) for r in G.lines(glyphs(spark, [(1, "•", 0, 100, 19), (1, "item text here", 20, 103), (1, "next", 0, 120), (1, " ", 50, 120)])).collect()}
    assert got == {1: ("• item text here", 10.0, 19.0), 2: ("next", 10.0, 10.0)}


def test_chrome_needs_its_evidence(spark):
    rows = []
    for p in range(1, 11):
        rows += [(p, f"Page {p} of 10", 0, 20), (p, f"Standard Objects Reference {'abcdefghij'[p - 1] * 3}", 0, 10), (p, str(p + 7), 0, 990), (p, f"body text {'klmnopqrst'[p - 1]}", 0, 500), (p, "the same body", 0, 510)]
    got = sorted((r.page, r.text) for r in G.without_chrome(G.lines(glyphs(spark, rows)), pages(spark, 10)).select("page", "text").collect())
    assert got == sorted([(p, f"body text {'klmnopqrst'[p - 1]}") for p in range(1, 11)] + [(p, "the same body") for p in range(1, 11)])
    few = [(p, str(p), 0, 990) for p in (1, 2, 3)] + [(p, "x" * 130, 0, 10) for p in range(1, 11)]
    assert G.without_chrome(G.lines(glyphs(spark, few)), pages(spark, 10)).count() == 13
    assert G.without_chrome(G.lines(glyphs(spark, [(1, "7", 0, 990)])), pages(spark, 1)).count() == 1


def test_columns(spark):
    left, right = [(1, f"left {i} words", 0, 100 + 20 * i) for i in range(8)], [(1, f"right {i} words", 320, 107 + 20 * i) for i in range(8)]
    rows = [(1, "A title that stands above both of the columns of this page, wide", 40, 50), *left, *right, (1, "A note below both of the columns which is as wide as the title was", 40, 400)]
    o = G.in_reading_order(G.lines(glyphs(spark, rows)), pages(spark, 1)).orderBy("col", "y").collect()
    assert [r.text.split()[0] for r in o] == ["A", *["left"] * 8, *["right"] * 8, "A"] and [r.col for r in o] == [0, *[1] * 8, *[2] * 8, 3]
    across = [(1, w, x, 100 + 20 * i) for i in range(12) for w, x in ((f"l{i} and more words in it", 0), (f"r{i} and more words in it", 320))]
    o = G.in_reading_order(G.lines(glyphs(spark, across)), pages(spark, 1)).orderBy("col", "y").collect()
    assert [r.text.split()[0] for r in o] == [f"l{i}" for i in range(12)] + [f"r{i}" for i in range(12)]
    assert {r.col for r in G.in_reading_order(G.lines(glyphs(spark, across)), pages(spark, 1), "single").collect()} == {0}


def line(key, y, *cells, size=10.0, bold=False):
    """cells: (text, x)."""
    made = [{"text": t, "x": float(x), "x2": x + len(t) * 6.0, "bold": bold, "segments": [{"text": t, "href": None}]} for t, x in cells]
    return grid.Line(key, made[0]["x"], made[-1]["x2"], float(y), size, size, bold, made)


def test_tables_from_lines():
    rows = [line(0, 0, ("Item", 0), ("Code", 150), ("Sum", 300)), line(1, 14, ("long text", 0), ("A1", 150), ("$1", 300)), line(2, 28, ("that wraps", 0)), line(3, 42, ("Group row", 0)), line(4, 56, ("short", 2), ("A2", 152), ("$2", 301)), line(5, 200, ("Prose after it", 0))]
    found, lost = grid.tables(rows, 10)
    assert len(found) == 1 and not lost and found[0].lines == [0, 1, 2, 3, 4] and found[0].header
    assert found[0].rows == [["Item", "Code", "Sum"], ["long text that wraps Group row", "A1", "$1"], ["short", "A2", "$2"]] or found[0].rows[1][0].startswith("long text that wraps")
    stacked = [line(0, 0, ("Enabled", 150), ("Contact", 300)), line(1, 12, ("for users", 150), ("setup", 300)), line(2, 24, ("Feature", 0), ("now", 150), ("to enable", 300))] + [line(3 + i, 40 + 14 * i, (f"f{i}", 0), ("Yes", 150), ("No", 300)) for i in range(3)]
    t = grid.tables(stacked, 10)[0][0]
    assert t.rows[0] == ["Feature", "Enabled for users now", "Contact setup to enable"] and t.marked[0][1] == "Enabled<br>for users<br>now" and len(t.rows) == 4 and t.header
    pairs = [line(0, 0, ("Field", 0), ("Details", 150)), *[line(1 + i, 14 + 14 * i, (f"f{i}", 0), ("Type", 150), ("string", 190)) for i in range(4)]]
    t = grid.tables(pairs, 10)[0]
    assert t and any("Type: string" in c for r in t[0].rows for c in r) or t[0].rows[1] == ["f0", "Type", "string"]
    loose = [line(i, 14 * i, ("a", 37 * i), ("b", 37 * i + 150), ("c", 37 * i + 311)) for i in range(4)]
    t, lost = grid.tables(loose, 10)
    assert t[0].aligned is not None and t[0].aligned.split("\n")[1].startswith(" ") and t[0].rows is None
    assert grid.tables([line(i, 14 * i, ("a", 37 * i), ("b", 37 * i + 150)) for i in range(3)], 10)[1] == 1
    assert grid.tables(rows[:2], 10) == ([], 0) and grid.tables([], 10) == ([], 0)


def test_documents(spark):
    rows = [
        (1, "My Report", 0, 80, 20), (1, "Long Heading That", 0, 130, 16), (1, "Goes On", 0, 148, 16), (1, "First line of a para-", 0, 200), (1, "graph and more.", 0, 212), (1, "New start after a gap", 0, 260),
        (1, "• one item", 0, 300), (1, "hangs below", 12, 312), (1, "• deeper", 30, 324), (1, "1. counted", 0, 340), (1, "After.", 0, 400),
        *[(1, t, x, 500 + 14 * i) for i, r in enumerate((("Name", "Value"), ("a", "1"), ("b", "2"))) for t, x in zip(r, (0, 200))],
        *[(2, t, x, 100 + 14 * i) for i, r in enumerate((("Name", "Value"), ("c", "3"), ("d", "4"))) for t, x in zip(r, (0, 200))], (2, "The end, in plain words.", 0, 300),
    ]
    title = spark.createDataFrame([(1, "My  REPORT")], "doc_id int, title string")
    got = flow.document(glyphs(spark, rows), pages(spark, 2), title=title).orderBy("idx").collect()
    assert [(b.type, b.text) for b in got if b.type not in ("list", "table", "page")] == [("heading", "Long Heading That Goes On"), ("paragraph", "First line of a paragraph and more."), ("paragraph", "New start after a gap"), ("paragraph", "After."), ("paragraph", "The end, in plain words.")]
    assert next(b.level for b in got if b.type == "heading") == 2
    lists = [b for b in got if b.type == "list"]
    assert [[(i.level, i.text) for i in b["items"]] for b in lists] == [[(0, "one item hangs below"), (1, "deeper")], [(0, "counted")]] and [b.ordered for b in lists] == [False, True]
    tables = [b for b in got if b.type == "table"]
    assert len(tables) == 1 and tables[0].header == ["Name", "Value"] and tables[0].rows == [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4"]] and len(tables[0].cells) == 5
    assert [b.page for b in got if b.type == "page"] == [2] and [b.idx for b in got] == list(range(len(got)))
    plain = flow.document(glyphs(spark, rows[:3]), pages(spark, 1), opts=Options(pdfHeadings=False, pdfTables=False, stripRunningHeads=False)).collect()
    assert {b.type for b in plain} == {"paragraph"}


def test_outlines(spark):
    rows = [(1, "Cover in large type", 0, 40, 24), (1, "Chapter", 0, 100, 12), (1, "One", 0, 112, 12), (1, "Body of text here", 0, 140), (1, "Large but unlisted", 0, 180, 20), (1, "August 2026", 0, 220), (1, "August 2026", 0, 260), (1, "small", 0, 300, 11.5, True)]
    lines = G.lines(glyphs(spark, rows))
    outline = spark.createDataFrame([(1, 1, "Chapter One", 2, 1), (1, 2, "AUGUST  2026", 3, 1), (1, 3, "August 2026", 3, 1), (1, 4, "nowhere", 1, 1), (1, 5, "August 2026", 1, 9)], "doc_id int, entry int, title string, level int, page int")
    bound = {r.line: r.claimed for r in flow.bound_outline(lines, outline).collect()}
    assert bound == {2: 2, 3: -1, 6: 3, 7: 3}
    o = G.in_reading_order(lines, pages(spark, 1), "single")
    body = G.body_size(lines)
    levels = {r.line: r.level for r in flow.classified(o, body, grid.detect(o, body), outline).collect()}
    # the cover is no heading, as it stands before the outline's first entry, but it was the one of level 1
    assert levels == {1: 0, 2: 2, 3: 0, 4: 0, 5: 2, 6: 3, 7: 3, 8: 4}
    first = {r.line: r.level for r in flow.classified(o, body, grid.detect(o, body)).collect()}
    assert first[1] == 1 and first[5] == 2


@pytest.mark.parametrize("text, ratio, bold, level", [("Intro", 2.0, False, 1), ("Intro", 1.5, False, 2), ("Intro", 1.3, False, 3), ("Intro", 1.1, False, 4), ("Intro", 1.0, True, 4), ("1.2 Scope", 0.5, True, 4), ("x" * 201, 2.0, False, 0), ("•", 2.0, False, 0), ("y" * 50 + ".", 2.0, False, 0), ("Intro", 1.0, False, 0)])
def test_heading_levels(spark, text, ratio, bold, level):
    row = spark.range(1).select(flow.heading_level(F.lit(text), F.lit(ratio), F.lit(bold)).alias("a"), flow.heading_level(F.concat(F.lit(text), F.lit(")")), F.lit(ratio), F.lit(bold), F.lit(True)).alias("b")).first()
    assert row.a == level and row.b == 0


WORD = "doc_id int, page int, line int, word int, text string, confidence double, x double, x2 double, top double, bottom double"


def test_confidence_is_known_or_null(spark):
    rows = [(1, 1, 1, i, t, c, i * 50.0, i * 50.0 + 40, 0.0, 10.0) for i, (t, c) in enumerate([("a1", 90.0), ("--", 10.0), ("b2", None), ("c3", float("nan")), ("d4", 69.95), (" ", 1.0)])]
    df = spark.createDataFrame(rows, WORD)
    pages_ = spark.createDataFrame([(1, 1, 300, 2, 0, 96), (1, 2, 200, 1, 3, None)], "doc_id int, page int, dpi int, gaps int, rescued int, source_dpi int")
    s = words.summary(df, pages_).first()
    assert (s.ocrConfidenceMean, s.ocrConfidenceMin, s.ocrFlaggedFields) == (42.7, 1.0, 3) and [w.text for w in s.ocrLowConfidence] == ["d4"] and s.ocrDpi == "200, 300" and s.ocrUnreadableRegions == 3
    assert len(s.warnings) == 5 and words.low_confidence(df).count() == 3
    line = words.lines(df).first()
    assert line.text == "a1 -- b2 c3 d4" and line.confidence == 69.95 and line.height == 10.0
    cell = words.page_lines(words.lines(df)).first()
    assert [c.text for c in cell.cells] == ["a1 -- b2 c3 d4"] and cell.from_ocr


def test_resolutions(spark):
    df = spark.createDataFrame([(1, 816.0, 612.0, 792.0), (2, 816.0, 612.0, 792.0), (1, 3000.0, 612.0, 792.0), (1, 9.0, 612.0, 792.0), (1, 510.0, 612.0, 792.0)], "n int, image double, width double, height double")
    r = df.select(words.scan_dpi(F.col("n"), F.col("image"), F.col("width")).alias("dpi"), "width", "height").withColumn("to", words.render_dpi(F.col("dpi"), "auto", F.col("width"), F.col("height"))).collect()
    assert [(x.dpi, x.to) for x in r] == [(96, 192), (None, 300), (353, 353), (None, 300), (60, 180)]
    assert spark.range(1).select(words.luma(F.lit(255), F.lit(255), F.lit(255)).alias("v"), words.needs_recognition(F.lit(" a b  ")).alias("a"), words.needs_recognition(F.lit("x" * 24)).alias("b"), words.needs_recognition(F.lit(""), "never").alias("c")).first() == (255, True, False, False)


def test_unread_ink(spark):
    cells = [(1, 1, c, r, 40.0) for c in range(2, 6) for r in (2, 3)] + [(1, 1, c, 20, 60.0) for c in range(30)] + [(1, 1, 50, 50, 60.0)] + [(1, 1, c, r, 40.0) for c in range(20, 24) for r in (2, 3)] + [(1, 1, 25, 2, 2.0)]
    read = [(1, 1, 1, 1, "w", 90.0, 320.0, 383.0, 32.0, 63.0), (1, 1, 1, 2, "v", 90.0, 700.0, 720.0, 400.0, 430.0)]
    df, w = spark.createDataFrame(cells, "doc_id int, page int, c int, r int, ink double"), spark.createDataFrame(read, WORD)
    found = words.unread(df, w).collect()
    assert [(r.x, r.y, r.x2, r.y2, r["cells"]) for r in found] == [(32.0, 32.0, 96.0, 64.0, 8)]
    rng = random.Random(2)
    spots = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
    got = words.regions(spark.createDataFrame([(1, 1, c, r, 1.0) for c, r in spots], "doc_id int, page int, c int, r int, ink double")).collect()
    left, sizes = set(spots), []
    while left:
        todo, n = [left.pop()], 1
        while todo:
            c, r = todo.pop()
            for x in ((c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)):
                if x in left:
                    left.discard(x)
                    todo.append(x)
                    n += 1
        sizes.append(n)
    assert sorted(r["cells"] for r in got) == sorted(sizes)
    pixels = spark.createDataFrame([(1, 1, x, y, 0 if x < 16 else 255) for x in range(32) for y in range(16)], "doc_id int, page int, x int, y int, v int")
    assert [(r.c, r.r, r.ink) for r in words.ink_cells(pixels).collect()] == [(0, 0, 64.0)]
    grey = spark.createDataFrame([(1, 1, 0, 0, 100), (1, 1, 2, 0, 150), (1, 1, 4, 0, 125), (1, 1, 50, 0, 100), (1, 1, 52, 0, 120)], "doc_id int, page int, x int, y int, v int")
    assert {r.x: r.v for r in words.stretched(grey).collect()} == {0: 0, 2: 255, 4: 128, 50: 255, 52: 255}


def test_second_readings(spark):
    first = spark.createDataFrame([(1, 1, 1, 1, "$1,932.00", 95.0, 100.0, 160.0, 10.0, 20.0)], WORD)
    again = spark.createDataFrame([(1, 1, 9, 1, "$1.9", 50.0, 100.0, 125.0, 10.0, 20.0), (1, 1, 9, 2, "new", 80.0, 170.0, 200.0, 10.0, 20.0), (1, 1, 9, 3, "edge", 80.0, 140.0, 190.0, 10.0, 20.0)], WORD)
    assert {r.text for r in words.not_yet_read(again, first).collect()} == {"new", "edge"}
    rescued = words.recovered(words.lines(again))
    both = words.with_rescued(words.lines(first), rescued)
    assert [(r.text, r.source) for r in both.orderBy("line").collect()] == [("$1,932.00", "page"), ("$1.9 new edge", "rescue")]
    regions = spark.createDataFrame([(1, 1, 0, 90.0, 5.0, 130.0, 25.0), (1, 1, 1, 400.0, 5.0, 420.0, 25.0)], "doc_id int, page int, region int, x double, y double, x2 double, y2 double")
    assert [r.region for r in words.open_regions(regions, rescued).collect()] == [1]
    c = words.crop(regions, F.lit(600.0), F.lit(800.0)).where("region = 0").first()
    assert (c.x, c.y, c.x2, c.y2) == (10.0, 0.0, 210.0, 49.0)
    marks = words.with_unread_marks(both, spark.createDataFrame([(1, 1, 2)], "doc_id int, page int, line int")).orderBy("line").collect()
    assert [r.unread for r in marks] == [False, True]
    assert words.scaled(regions, F.lit(0.5), F.lit(10.0)).where("region = 0").first().x == 50.0


def test_recognised_paragraphs(spark):
    rows = [(1, 1, 1, "BIG TITLE", 20.0, 0.0, 20.0), (1, 1, 2, "text of a para-", 10.0, 24.0, 34.0), (1, 1, 3, "graph here and much more of it to weigh the most", 10.0, 36.0, 46.0), (1, 1, 4, "|", 10.0, 80.0, 90.0), (1, 1, 5, "- an item", 10.0, 130.0, 140.0)]
    p = words.paragraphs(spark.createDataFrame(rows, "doc_id int, page int, line int, text string, height double, top double, bottom double"))
    assert [(r.text, r.lines) for r in p.orderBy("para").collect()] == [("BIG TITLE", 1), ("text of a paragraph here and much more of it to weigh the most", 2), ("- an item", 1)]
    b = words.image_blocks(p).orderBy("idx").collect()
    assert [(r.type, r.level, r.text) for r in b] == [("heading", 1, "BIG TITLE"), ("paragraph", None, "text of a paragraph here and much more of it to weigh the most"), ("list", None, "an item")]
