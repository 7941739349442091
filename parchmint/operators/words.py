"""Recognised words: confidence, lines, paragraphs, unread ink, and what a second reading adds.

words: doc_id, page, line, word, text, confidence (null: unknown, never 0), x, x2, top, bottom. regions: doc_id, page, region, x, y, x2, y2.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored

PAGE = ["doc_id", "page"]
#: Words below this confidence are worth a second look; lines that were read again count from the second value on.
LOW, RECOVERED = 70, 40
#: Pixels beside a cell; side of a cell and a tile; share of dark samples that makes a cell inky; regions kept.
CELL, TILE, INKY, REGIONS = 16, 48, 0.06, 8


def known_confidence(c: Column) -> Column:
    """A confidence, or null where it is no finite number."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _upper_median(c: Column) -> Column:
    s = F.array_sort(c)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def lines(words: DataFrame) -> DataFrame:
    """Lines of words: doc_id, page, line, text, confidence (median of the known ones), height (median), x, x2, top, bottom, words. Blank words go."""
    w = words.withColumn("text", T.trimmed(F.col("text"))).where("text <> ''")
    part = F.struct("word", "text", known_confidence(F.col("confidence").cast("double")).alias("confidence"), "x", "x2", "top", "bottom")
    g = w.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(part)).alias("words"))
    heights = F.filter(F.transform("words", lambda p: p["bottom"] - p["top"]), lambda h: h > 0)
    sure = F.filter(F.transform("words", lambda p: p["confidence"]), lambda c: c.isNotNull())
    edge = lambda f, name: f(F.transform("words", lambda p: p[name]))
    return g.select(
        *PAGE, "line", T.collapsed(F.array_join(F.transform("words", lambda p: p["text"]), " ")).alias("text"), _upper_median(sure).alias("confidence"), F.coalesce(_upper_median(heights), F.lit(0.0)).alias("height"),
        edge(F.array_min, "x").alias("x"), edge(F.array_max, "x2").alias("x2"), edge(F.array_min, "top").alias("top"), edge(F.array_max, "bottom").alias("bottom"), "words",
    )


def scaled(df: DataFrame, factor: Column, dx: Column | None = None, dy: Column | None = None) -> DataFrame:
    """Boxes moved by (dx, dy) and scaled: from a crop to its page, from pixels to points."""
    dx, dy = dx if dx is not None else F.lit(0.0), dy if dy is not None else F.lit(0.0)
    across, down = {"x", "x2"}, {"y", "y2", "top", "bottom"}
    return df.select(*[((F.col(c) + (dx if c in across else dy)) * factor).alias(c) if c in across | down else F.col(c) for c in df.columns])


def page_lines(found: DataFrame) -> DataFrame:
    """Lines of words as glyphs.lines gives them, so tables and headings are found alike: cells where the gap is wider than 1.4 heights; from_ocr is true."""
    cell = "array<struct<text:string,x:double,x2:double,bold:boolean,segments:array<struct<text:string,href:string>>>>"
    size = F.when(F.col("height") > 0, F.col("height").cast("double")).otherwise(10.0)

    def step(a, w):
        last = F.try_element_at(a, F.lit(-1))
        new = lambda text, x: F.array(F.struct(text.alias("text"), x.cast("double").alias("x"), w["x2"].cast("double").alias("x2"), F.lit(False).alias("bold"), F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("href"))).alias("segments")))
        wide = (F.size(a) == 0) | (w["x"] - last["x2"] > size * 1.4)
        return F.when(wide, F.concat(a, new(w["text"], w["x"]))).otherwise(F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), new(F.concat(last["text"], F.lit(" "), w["text"]), last["x"])))

    cells = F.aggregate("words", F.array().cast(cell), step)
    no = F.lit(False)
    return found.select(
        *PAGE, "line", "text", F.regexp_replace("text", r"([\\`*_\[\]])", r"\\$1").alias("markdown"), F.col("x").cast("double").alias("x"), F.col("x2").cast("double").alias("x2"), F.col("bottom").cast("double").alias("y"),
        size.alias("size"), size.alias("text_size"), no.alias("bold"), no.alias("italic"), no.alias("mono"), cells.alias("cells"), F.lit(True).alias("from_ocr"),
    )


# ---------------------------------------------------------------- confidence


def low_confidence(words: DataFrame, below: float = LOW) -> DataFrame:
    """Words with a known confidence below the bound, rounded to a tenth."""
    c = known_confidence(F.col("confidence").cast("double"))
    return words.where(c < below).withColumn("confidence", F.floor(c * 10 + 0.5) / 10)


def summary(words: DataFrame, pages: DataFrame | None = None, most: int = 20) -> DataFrame:
    """A row for each document: ocrConfidenceMean and ocrConfidenceMin (one decimal), ocrFlaggedFields, ocrLowConfidence (the `most` lowest with a letter or digit).

    pages (doc_id, page, dpi, gaps, rescued, source_dpi) adds ocrDpi (distinct, ascending), ocrUnreadableRegions, ocrRescuedLines, low_resolution and warnings."""
    c = known_confidence(F.col("confidence").cast("double"))
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    known = words.withColumn("c", c).where("c IS NOT NULL")
    low = known.where(F.col("c") < LOW).where(F.col("text").rlike("[A-Za-z0-9]"))
    w = Window.partitionBy("doc_id").orderBy("c", "page", "line", "word")
    lowest = low.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text", tenth(F.col("c")).alias("confidence"), "page"))), lambda x: F.struct(x["text"], x["confidence"], x["page"])).alias("ocrLowConfidence"))
    s = known.groupBy("doc_id").agg(F.avg("c").alias("mean"), tenth(F.avg("c")).alias("ocrConfidenceMean"), tenth(F.min("c")).alias("ocrConfidenceMin"), F.count_if(F.col("c") < LOW).alias("ocrFlaggedFields")).join(lowest, "doc_id", "left")
    if pages is None:
        return s.drop("mean")
    dpi = F.array_join(F.transform(F.array_sort(F.collect_set("dpi")), lambda d: d.cast("string")), ", ")
    p = pages.groupBy("doc_id").agg(dpi.alias("ocrDpi"), F.nullif(F.sum("gaps"), F.lit(0)).alias("ocrUnreadableRegions"), F.nullif(F.sum("rescued"), F.lit(0)).alias("ocrRescuedLines"), F.count_if(F.col("source_dpi") < 150).alias("low_resolution"))
    j = s.join(p, "doc_id", "left")
    say = lambda n, text: F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(n.cast("string"), F.lit(text)))
    warnings = F.array(
        say(F.col("ocrRescuedLines"), " line(s) were readable only with more local contrast. Compare them with the original."),
        F.when(F.col("mean") < 85, F.concat(F.lit("Average confidence is "), F.format_string("%.1f", "mean"), F.lit("%: treat every figure as unverified."))),
        F.when(F.size("ocrLowConfidence") > 0, F.concat(F.col("ocrFlaggedFields").cast("string"), F.lit(f" word(s) scored below {LOW}% confidence."))),
        say(F.col("ocrUnreadableRegions"), " region(s) carried ink but gave no text."),
        say(F.col("low_resolution"), " page(s) are scans of under 150 dpi."),
    )
    return j.withColumn("warnings", F.filter(warnings, lambda x: x.isNotNull())).drop("mean")


def needs_recognition(text: Column, mode: str = "auto", least: int = 24) -> Column:
    """Whether a page is to be recognised: always, never, or where its text layer has fewer characters than `least`."""
    if mode != "auto":
        return F.lit(mode == "always")
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), T.SPACE, "")) < least


def scan_dpi(images: Column, image_width: Column, page_width: Column) -> Column:
    """Resolution of a page that is one image: pixels to an inch, if that is plausible."""
    dpi = F.floor(image_width / page_width * 72 + 0.5)
    return F.when((images == 1) & dpi.between(36, 1200), dpi.cast("int"))


def render_dpi(scan: Column, wanted: int | str, width: Column, height: Column, pixels: float = 20e6) -> Column:
    """Resolution to render a page at: a whole multiple of a scan's own, else what is wanted within 96 to 600; less where the page would pass `pixels`."""
    target = scan * F.when(scan * 2 > 450, 1).when(scan * 2 >= 180, 2).otherwise(3)
    target = F.coalesce(target, F.lit(min(600, max(96, int(wanted) if str(wanted).isdigit() else 300))))
    scale = F.least(target / 72, F.sqrt(F.lit(pixels) / (width * height)))
    return F.floor(scale * 72 + 0.5).cast("int")


def image_counts(drawn: DataFrame) -> DataFrame:
    """doc_id, page, images of what pages draw (doc_id, page, op: image, repeat, inline or other; name): distinct images, and each inline one."""
    named = F.count_distinct(F.when(F.col("op").isin("image", "repeat"), F.col("name")))
    return drawn.groupBy(*PAGE).agg((named + F.count_if(F.col("op") == "inline")).alias("images"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 151 + b * 28, 8)


def stretched(pixels: DataFrame) -> DataFrame:
    """pixels (doc_id, page, x, y, v) with v stretched between the extremes of its tile; tiles with little contrast become white. Extremes are taken of every second pixel."""
    tile = pixels.withColumn("tx", F.floor(F.col("x") / TILE)).withColumn("ty", F.floor(F.col("y") / TILE))
    ends = tile.where("x % 2 = 0 AND y % 2 = 0").groupBy(*PAGE, "tx", "ty").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = tile.join(ends, [*PAGE, "tx", "ty"], "left")
    v = F.floor((F.col("v") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")) + 0.5)
    return j.withColumn("v", F.when(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)) < 40, 255).otherwise(F.least(F.greatest(v, F.lit(0)), F.lit(255))).cast("int")).drop("tx", "ty", "lo", "hi")


# ---------------------------------------------------------------- unread ink


def ink_cells(pixels: DataFrame) -> DataFrame:
    """Dark samples (below 140, every second pixel) in each cell of 16 x 16."""
    dark = pixels.where("x % 2 = 0 AND y % 2 = 0 AND v < 140")
    return dark.groupBy(*PAGE, F.floor(F.col("x") / CELL).cast("int").alias("c"), F.floor(F.col("y") / CELL).cast("int").alias("r")).agg(F.count(F.lit(1)).cast("double").alias("ink"))


def uncovered(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Inky cells that no word (with four pixels around it) touches."""
    at = lambda v: F.floor(v / CELL).cast("int")
    low = lambda v: F.greatest(at(F.col(v) - 4), F.lit(0))
    spread = words.select(*PAGE, F.explode(F.sequence(low("x"), at(F.col("x2") + 4))).alias("c"), low("top").alias("r0"), at(F.col("bottom") + 4).alias("r1")).select(*PAGE, "c", F.explode(F.sequence("r0", "r1")).alias("r")).distinct()
    # cells are many more than the words that Spark guesses their size by, so they are never sent through the driver
    return cells.where(F.col("ink") / (CELL * CELL / 4) > INKY).join(spread.hint("merge"), [*PAGE, "c", "r"], "left_anti")


_REGION = "page int, region int, x double, y double, x2 double, y2 double, cells int, ink double"


def regions(inky: DataFrame) -> DataFrame:
    """Connected cells (by their sides) as boxes: doc_id, page, region, x, y, x2, y2, cells, ink. A page's cells are joined in one task; pages are independent."""
    kind = inky.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def rows():
            nonlocal key
            for b in batches:
                key = b.column(0).type
                yield from zip(*[b.column(i).to_pylist() for i in range(5)])

        for (doc, page), group in groupby(rows(), key=lambda r: r[:2]):
            left = {(r[2], r[3]): r[4] for r in group}
            out = []
            while left:
                start = min(left)
                todo, mine = [start], {start: left.pop(start)}
                while todo:
                    c, r = todo.pop()
                    for n in ((c - 1, r), (c + 1, r), (c, r - 1), (c, r + 1)):
                        if n in left:
                            mine[n] = left.pop(n)
                            todo.append(n)
                cs, rs = [c for c, _ in mine], [r for _, r in mine]
                out.append((doc, page, len(out), min(cs) * CELL, min(rs) * CELL, (max(cs) + 1) * CELL, (max(rs) + 1) * CELL, len(mine), sum(mine.values())))
            kinds = (key, pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "page", "region", "x", "y", "x2", "y2", "cells", "ink"])

    given = inky.select("doc_id", F.col("page").cast("int").alias("page"), "c", "r", "ink")
    return given.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "c", "r").mapInArrow(run, f"doc_id {kind}, {_REGION}")


def words_inside(found: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page, region, inside: words whose centre lies in the region."""
    w = words.select(*PAGE, ((F.col("x") + F.col("x2")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    j = found.join(w.hint("merge"), PAGE).where(F.col("cx").between(F.col("x"), F.col("x2")) & F.col("cy").between(F.col("y"), F.col("y2")))
    return j.groupBy(*PAGE, "region").agg(F.count(F.lit(1)).alias("inside"))


def unread(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Regions of ink that gave no words, the eight with most ink on each page: neither rules nor specks, as high as a line of the page's text, and not around words that were read."""
    found = stored(regions(uncovered(cells, words)), "regions")
    height = words.where("bottom > top").groupBy(*PAGE).agg(F.percentile(F.col("bottom") - F.col("top"), 0.5).alias("line_height"))
    w, h = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    rule = ((h <= CELL * 1.5) & (w > CELL * 4)) | ((w <= CELL * 1.5) & (h > CELL * 4))
    solid = found.where((F.col("cells") >= 3) & ~rule & (F.col("ink") / (F.col("cells") * (CELL * CELL / 4)) >= 0.08))
    j = solid.join(height.hint("merge"), PAGE, "left").where(F.col("line_height").isNull() | (h >= F.col("line_height")))
    j = j.join(words_inside(solid, words).hint("merge"), [*PAGE, "region"], "left").where("coalesce(inside, 0) < 2")
    r = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("ink").desc(), "y", "x"))
    return j.withColumn("rank", r).where(F.col("rank") <= REGIONS).drop("line_height", "inside")


def nearest_label(found: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, region, line, near: the line that a region belongs to. Near is the closest of those that stand directly above (four sizes at most) or to the left on its row (30 sizes at most); else the last line of the page, with near false.

    lines: doc_id, page, line, y, x2, size."""
    l = lines.select(*PAGE, "line", F.col("y").alias("ly"), F.col("x2").alias("lx2"), "size")
    below, right = F.col("y") - F.col("ly"), F.col("x") - F.col("lx2")
    row = F.abs(F.col("ly") - F.col("y2")) < F.col("size") * 2
    distance = F.when((below >= -F.col("size")) & (below < F.col("size") * 4), below).when(row & (right > 0) & (right < F.col("size") * 30), right)
    j = found.join(l, PAGE).withColumn("distance", distance)
    best = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "line")))
    g = j.groupBy(*PAGE, "region").agg(best.alias("best"), F.max("line").alias("last"))
    return g.select(*PAGE, "region", F.coalesce("best.line", "last").alias("line"), F.col("best").isNotNull().alias("near"))


def with_unread_marks(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """`lines` with `unread`: whether a value at the line could not be read. Emitters show it; the text stays."""
    return lines.join(labels.select(*PAGE, "line").distinct().withColumn("unread", F.lit(True)), [*PAGE, "line"], "left").withColumn("unread", F.coalesce("unread", F.lit(False)))


# ---------------------------------------------------------------- a second reading


def not_yet_read(again: DataFrame, words: DataFrame) -> DataFrame:
    """Words of a second reading of which no more than half lies on a word that was read before."""
    old = words.select(*PAGE, F.col("x").alias("ox"), F.col("x2").alias("ox2"), F.col("top").alias("otop"), F.col("bottom").alias("obottom"))
    w, h = F.least("x2", "ox2") - F.greatest("x", "ox"), F.least("bottom", "obottom") - F.greatest("top", "otop")
    area = F.greatest(F.lit(1.0), (F.col("x2") - F.col("x")) * (F.col("bottom") - F.col("top")))
    on = (w > 0) & (h > 0) & (w * h / area > 0.5)
    same = [again[c] == old[c] for c in PAGE]
    return again.join(old, [*same, on], "left_anti")


def recovered(found: DataFrame) -> DataFrame:
    """Lines that hold text: two letters or digits, and a confidence of 40 or more if it is known."""
    return found.where((F.regexp_count("text", F.lit("[A-Za-z0-9]")) >= 2) & (F.coalesce("confidence", F.lit(float(RECOVERED))) >= RECOVERED))


def with_rescued(first: DataFrame, again: DataFrame) -> DataFrame:
    """Lines of both readings in reading order; of the second those whose text the page doesn't have yet, each text once. source tells them apart."""
    new = again.join(first.select(*PAGE, "text").distinct(), [*PAGE, "text"], "left_anti")
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE, "text").orderBy("top", "x"))).where("_r = 1").drop("_r")
    both = first.withColumn("source", F.lit("page")).unionByName(new.withColumn("source", F.lit("rescue")), allowMissingColumns=True)
    return both.withColumn("line", F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "x")))


def open_regions(found: DataFrame, rescued: DataFrame) -> DataFrame:
    """Regions that no rescued line touches."""
    l = rescued.select(*PAGE, F.col("x").alias("lx"), F.col("x2").alias("lx2"), "top", "bottom")
    touch = (F.least(F.col("lx2"), F.col("x2")) > F.greatest(F.col("lx"), F.col("x"))) & (F.least(F.col("bottom"), F.col("y2")) > F.greatest(F.col("top"), F.col("y")))
    return found.join(l, [*[found[c] == l[c] for c in PAGE], touch], "left_anti")


def crop(found: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes to read again: a region with four times its height beside it and 24 pixels above and below, within the page."""
    tall = F.col("y2") - F.col("y")
    return found.select(
        *PAGE, "region", F.greatest(F.col("x") - tall * 4, F.lit(0.0)).alias("x"), F.greatest(F.col("y") - 24, F.lit(0.0)).alias("y"), F.least(F.col("x2") + tall * 4, width).alias("x2"), F.least(F.col("y2") + 24, height).alias("y2")
    )


# ---------------------------------------------------------------- paragraphs of recognised text


def paragraphs(found: DataFrame) -> DataFrame:
    """doc_id, page, para, text, height, lines of recognised lines (text, height, top, bottom in the order of `line`).

    A paragraph ends where the height differs by over 22 % from its mean so far or the gap is wider than 1.1 of it, so lines are folded in order. A single
    character is noise, unless it is I, A or a digit."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def rows():
            nonlocal key
            for b in batches:
                key = b.column(0).type
                yield from zip(*[b.column(i).to_pylist() for i in range(6)])

        for (doc, page), group in groupby(rows(), key=lambda r: r[:2]):
            open_: list[tuple[list[str], float]] = []
            mean = end = 0.0
            for _, _, text, height, top, bottom in group:
                shift = abs(height - mean) / max(mean, 1) if open_ and mean and height else 0
                if not open_ or shift > 0.22 or top - end > max(mean, 1) * 1.1:
                    open_.append(([], 0.0))
                    mean = 0.0
                texts = open_[-1][0]
                texts.append(text)
                mean = (mean * (len(texts) - 1) + height) / len(texts) if mean else height
                end = bottom
                open_[-1] = (texts, mean)
            out = [(doc, page, i, unwrapped(t), h, len(t)) for i, (t, h) in enumerate(open_)]
            out = [o for o in out if o[3] and not (len(o[3]) == 1 and o[3] not in "IA0123456789")]
            if out:
                kinds = (key, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "page", "para", "text", "height", "lines"])

    f = lambda c: F.col(c).cast("double").alias(c)
    given = found.select("doc_id", F.col("page").cast("int").alias("page"), "text", f("height"), f("top"), f("bottom"), "line")
    dealt = given.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "line").drop("line")
    return dealt.mapInArrow(fold, f"doc_id {kind}, page int, para int, text string, height double, lines int")


def unwrapped(lines: list[str]) -> str:
    """Lines as one text; a hyphen before a small letter goes with the break."""
    out = ""
    for line in map(str.strip, lines):
        if out and line:
            out = out[:-1] + line if out[-1] in "-‐‑‒–—―" and "a" <= line[0] <= "z" else f"{out} {line}"
        else:
            out = out or line
    return " ".join(out.split())


def body_height(found: DataFrame) -> DataFrame:
    """doc_id, body: the height at which half of the text is reached, a paragraph weighing a tenth of its characters, 1 to 40."""
    by = found.where("height > 0").groupBy("doc_id", "height").agg(F.sum(F.least(F.lit(40), F.greatest(F.lit(1), F.floor(F.length("text") / 10 + 0.5)))).alias("w"))
    w = Window.partitionBy("doc_id")
    run = by.withColumn("run", F.sum("w").over(w.orderBy("height").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(w))
    return run.where(F.col("run") * 2 > F.col("all")).groupBy("doc_id").agg(F.min("height").alias("body"))


def image_blocks(found: DataFrame) -> DataFrame:
    """Blocks of a recognised image: paragraphs of up to 90 characters and two lines are headings by their height against the body's (1.7, 1.35, 1.18); marked ones are list items."""
    j = found.join(body_height(found), "doc_id", "left")
    ratio = F.when(F.col("height") > 0, F.col("height") / F.coalesce("body", F.lit(1.0))).otherwise(1.0)
    short = (F.length("text") <= 90) & (F.col("lines") <= 2)
    level = F.when(short & (ratio >= 1.7), 1).when(short & (ratio >= 1.35), 2).when(short & (ratio >= 1.18), 3)
    mark = r"^\s*[•·▪‣*-]\s+"
    item = level.isNull() & F.col("text").rlike(mark)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "para")) - 1
    text = F.when(item, F.regexp_replace("text", mark, "")).otherwise(F.col("text"))
    return j.select("doc_id", idx.cast("int").alias("idx"), "page", F.when(level.isNotNull(), "heading").when(item, "list").otherwise("paragraph").alias("type"), level.alias("level"), text.alias("text"))
