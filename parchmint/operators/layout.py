"""Lines of pages: running heads, page numbers, tables that go on, carried values, islands."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The marks that open a list item.
GLYPH = r"^[ \t\u00a0]*([•·▪◦‣∙◾▸►])[ \t\u00a0]+"
DASH = r"^[ \t\u00a0]*[-–—*][ \t\u00a0]+"
ORDERED = r"^[ \t\u00a0]*\(?([0-9]{1,3}|[a-zA-Z])[.)][ \t\u00a0]+"


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """A number for each run of rows; a run starts where `starts` holds (or has no value)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def repeated_lines(lines: DataFrame, group: str, pages: Column | DataFrame, share: float = 0.6) -> DataFrame:
    """Keys of lines that occur max(2, share x pages) times or more in a group: group, key, n. Occurrences count, not pages.

    pages: one number for all groups, or a row (group, pages) for each."""
    keyed = lines.withColumn("key", T.chrome_key(F.col("text"))).where(F.length("key") >= 2)
    counts = keyed.groupBy(group, "key").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(pages, DataFrame):
        known = pages.select(F.col(group).alias("of"), "pages")
        counts, pages = counts.join(known, counts[group].eqNullSafe(known["of"])), F.col("pages")
    return counts.where(F.col("n") >= F.greatest(F.lit(2), F.ceil(pages * share))).select(group, "key", "n")


def folio_sequences(lines: DataFrame, pages: DataFrame, share: float = 0.6) -> DataFrame:
    """Lines that are page numbers in sequence: lines(doc_id, band, page, text) of the outermost lines; pages(doc_id, pages).

    A band needs as many as max(2, share x pages) numbers, and in 90 % of the steps the number moves as far as the page: under that, text is left alone."""
    w = Window.partitionBy("doc_id", "band").orderBy("page")
    found = lines.withColumn("value", T.folio(F.col("text"))).where("value IS NOT NULL")
    stepped = found.withColumn("step", F.col("value") - F.lag("value").over(w)).withColumn("move", F.col("page") - F.lag("page").over(w))
    good = stepped.groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("step") > 0) & (F.col("step") == F.col("move"))).alias("ok")).join(pages, "doc_id")
    least = F.greatest(F.lit(2), F.ceil(F.col("pages") * F.lit(str(share)).cast("decimal(4,3)")))
    good = good.where((F.col("n") >= least) & (F.col("ok") >= F.ceil((F.col("n") - 1) * F.lit("0.9").cast("decimal(2,1)"))))
    return found.join(good.select("doc_id", "band"), ["doc_id", "band"], "left_semi")


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def without_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1 OR NOT (_before <=> " + value + ")").drop("_before", "_first")


def upper_quantiles(df: DataFrame, keys: list[str], value: str, weight: str | None = None, parts: int = 64) -> DataFrame:
    """keys, value: the upper median of each group; with weights, the smallest value at which the weights so far pass half of all.

    Distinct values are dealt in ranges over all groups; sums of (group, range) tell which range holds a group's middle, and only that
    range's values of the group are ranked. So no task sorts all values of a group, however large it is."""
    one = F.sum(weight) if weight else F.count(F.lit(1))
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(one.alias("n"))
    r = n.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    sums = r.groupBy(*keys, "part").agg(F.sum("n").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = Window.partitionBy(*keys)
    ranged = sums.withColumn("upto", F.sum("s").over(w.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("s").over(w))
    half = F.col("all") / 2 if weight else F.floor(F.col("all") / 2)
    middle = ranged.withColumn("half", half).where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("s") <= F.col("half")))
    middle = middle.select(*[F.col(k).alias(f"_{k}") for k in keys], "lo", "hi", (F.col("half") - F.col("upto") + F.col("s")).alias("place"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    j = n.join(middle, [*on, F.col("value").between(F.col("lo"), F.col("hi"))])
    ranked = j.withColumn("run", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where("run > place").groupBy(*keys).agg(F.min("value").alias("value"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Smallest value at which the weights so far pass half of all."""
    return upper_quantiles(df, keys, value, weight).withColumnRenamed("value", "median")


def cue_paragraphs(cues: DataFrame) -> DataFrame:
    """Paragraphs of cues(doc_id: long, cue: long, start, text): doc_id, start, first_cue, cues, text.

    The rule depends on the paragraph's own start, so cues are folded in order: a task streams through its sorted documents and holds one paragraph at a time. A
    cue that repeats the words before it counts, but adds no text; a paragraph without text at the end of a document is none."""
    from ..sources.readers.plain import Transcript

    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        doc, fold, open_ = None, Transcript(), None  # open_: start, first cue, cues, texts

        def close(last: bool) -> None:
            if open_ is not None and (open_[3] or not last):
                out.append((doc, open_[0], open_[1], open_[2], " ".join(open_[3])))

        for b in batches:
            for key, cue, at, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if doc is None or key != doc:
                    close(True)
                    doc, fold, open_ = key, Transcript(), None
                opens, counts = fold.add(at, text)
                if opens:
                    close(False)
                    open_ = [at, cue, 0, []]
                open_[2] += 1
                if counts:
                    open_[3].append(text)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "start", "first_cue", "cues", "text"])
                out.clear()
        close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "start", "first_cue", "cues", "text"])

    given = cues.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("cue").cast("long").alias("cue"), F.col("start").cast("double").alias("start"), "text")
    return given.repartition("doc_id").sortWithinPartitions("doc_id", "cue").mapInArrow(run, "doc_id long, start double, first_cue long, cues long, text string")


def joined_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, joined, lines: the lines (line_no, text) of each group as one text. A hyphen or dash at the end of a line goes with the break if the next starts with a small letter, else a blank joins them; empty lines are left out."""
    g = lines.withColumn("text", T.collapsed(F.col("text"))).where("text <> ''").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    parts = F.transform("ls", lambda x: x["text"])
    # looking at neighbours alone, so no text is built up piece by piece
    n = F.size(parts)
    soft = lambda a, b: a.rlike("[‐-―-]$") & b.rlike("^[a-zà-ÿ]")
    shown = F.transform(parts, lambda t, i: F.when(i + 1 < n, F.when(soft(t, F.get(parts, i + 1)), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit(" ")))).otherwise(t))
    return g.select(*keys, F.array_join(shown, "").alias("joined"), n.cast("long").alias("lines"))


def list_islands(paragraphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`paragraphs` (text) with mark (glyph, ordered, dash or null), list (number of its list within the group, null outside lists), level and item (text without the mark).

    Neighbours whose marks are of one sort, counting or not, are a list; one dash or number alone is none, one glyph is."""
    mark = F.when(F.col("text").rlike(GLYPH), "glyph").when(F.col("text").rlike(ORDERED) & (F.length("text") > F.length(F.regexp_extract("text", ORDERED, 0)) + 1), "ordered").when(F.col("text").rlike(DASH) & (F.length("text") > F.length(F.regexp_extract("text", DASH, 0)) + 1), "dash")
    sort = F.when(F.col("mark").isNotNull(), F.col("mark") == "ordered")
    w = Window.partitionBy(*keys).orderBy(order)
    d = paragraphs.withColumn("mark", mark).withColumn("_sort", sort)
    d = d.withColumn("_new", F.when(F.col("_sort").eqNullSafe(F.lag("_sort").over(w)) & F.col("_sort").isNotNull(), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*keys, "_run")
    is_list = F.col("mark").isNotNull() & ((F.count(F.lit(1)).over(g) > 1) | (F.max((F.col("mark") == "glyph").cast("int")).over(g) == 1))
    level = F.least(F.lit(3), F.floor(F.length(F.regexp_extract("text", "^[ \t\u00a0]*", 0)) / 2)).cast("int")
    item = F.coalesce(*[F.when(F.col("mark") == k, F.trim(F.regexp_replace("text", p, ""))) for k, p in (("glyph", GLYPH), ("ordered", ORDERED), ("dash", DASH))])
    d = d.withColumn("_is", is_list)
    d = d.withColumn("list", F.when(F.col("_is"), F.col("_run"))).withColumn("level", F.when(F.col("_is"), level)).withColumn("item", F.when(F.col("_is"), item))
    return d.drop("_sort", "_new", "_run", "_is")
