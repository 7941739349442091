"""Operator 10: mix sources to target weights. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored, with_row

#: Sources that one task ranks; rows for each of the cells that coins are counted in.
RANKED, CELL = 100_000, 100_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _in_order(sizes: DataFrame) -> DataFrame:
    """`sizes` with rank, the place (from 1) of each source in code point order, null last. Ranges of sources are ranked by different tasks."""
    parts = 1 + sizes.count() // RANKED
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(parts, *order) if parts > 1 else sizes.coalesce(1)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(before), "part").withColumn("rank", local + F.col("before")).drop("part", "before")


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """Target size of each source. `sizes`: source, source_size (one row per source); stored, as it is read several times.

    Sources in code point order (null last) take the weights in turn. A target is weight x level, but at most
    `most` x the source's size; the level is the one at which the targets add up to share x all sizes. It is found by
    sharing the excess of capped sources among the others, by weight, until none is above its cap; each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stored(_in_order(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "ranked-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        free = F.lit(True) if level is None else F.col("cap") / F.col("weight") >= F.lit(level)
        found = ranked.agg(F.sum(F.when(free, 0).otherwise(F.col("cap"))), F.sum(F.when(free, F.col("weight"))), F.count_if(~free)).first()
        if found[2] == capped or not found[1]:
            level = level if found[1] else None
            break
        level, capped = (float(total * share) - float(found[0])) / float(found[1]), found[2]
    cap = F.col("cap").cast("double")
    return ranked.select("source", "source_size", (cap if level is None else F.least(cap, F.col("weight") * F.lit(level))).alias("target"))


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    """Sizes whose first four binary digits and length agree, so sizes of a class differ by an eighth at most."""
    digits = F.length(F.bin(size))
    return (digits * 16 + F.call_function("shiftright", size, F.greatest(digits - 4, F.lit(0)))).cast("int")


def _thresholds(sized: DataFrame, share: float, most: int, weights: Sequence[int], seed: int) -> DataFrame:
    """For each source and size class: s, none (the source), class, source_size, target, whole (copies that every row gets) and top (largest coin that gets one more).

    `sized`: src, key, size; stored. The class takes as many extra copies as the running share of its rows says, counted from the
    source's smallest class and from a start of its own; they go to its smallest coins. The coin of the last one is
    found by counting coins in cells, then by ranking the rows of the one cell that holds it.
    """
    cells = 1 + sized.count() // CELL
    rows = sized.select(F.coalesce("src", F.lit("")).alias("s"), F.col("src").isNull().alias("none"), "size", size_class(F.col("size")).alias("class"), coin(F.col("key"), seed).alias("coin"))
    rows = rows.withColumn("cell", F.floor(F.col("coin") * cells))
    counts = stored(rows.groupBy("s", "none", "class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "size-classes")
    per = counts.groupBy("s", "none").agg(F.sum("size").alias("source_size"))
    targets = source_targets(stored(per.select(F.when(~F.col("none"), F.col("s")).alias("source"), "source_size"), "sources"), share, most, weights)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    by = Window.partitionBy("s", "none").orderBy("class")
    classes = counts.groupBy("s", "none", "class").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by))
    classes = classes.join(targets, ["s", "none"]).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    start = coin(F.when(F.col("none"), F.lit(None)).otherwise(F.col("s")), seed)
    extra = F.floor(F.col("upto") * F.col("part") + start) - F.floor((F.col("upto") - F.col("n")) * F.col("part") + start)
    classes = stored(classes.withColumn("extra", extra), "extra-copies")
    keys = ["s", "none", "class"]
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell"))
    last = counts.withColumn("upto", so_far).join(classes.where("extra > 0 AND extra < n").select(*keys, "extra"), keys)
    last = last.where("upto >= extra AND upto - n < extra").select(*keys, "cell", (F.col("extra") - F.col("upto") + F.col("n")).alias("place"))
    near = rows.join(small(stored(last, "last-cells")), [*keys, "cell"])
    placed = near.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("coin"))).where("at = place")
    top = F.when(F.col("extra") <= 0, -1.0).when(F.col("extra") >= F.col("n"), 2.0).otherwise(F.col("coin"))
    return classes.join(placed.select(*keys, "coin"), keys, "left").select(*keys, "source_size", "target", "whole", top.alias("top"))


def plan_mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = (5, 2, 1), seed: int = 10, text: str = "text", source: str = "source", key: str = "doc_id", size: str | None = None) -> DataFrame:
    """How often the mix takes each row: row (struct of all columns), size, source_size, target, copies (long).

    A source's rate is target / size; each of its rows is taken floor(rate) times, and once more by a coin, a hash of
    seed and key, with the rate's fraction as the chance. The coins of a source are not independent: of each class of like sizes
    as many rows are taken once more as the fraction says, so that the words taken come within about one text of the
    target; which ones, the coins decide. `size` may name a column that holds the words of a row already.

    Null texts and texts without words have size 0; their copies
    add no words. Null sources form one source, last in order. Rows that repeat a key share its coin. An empty
    table gives no rows. Sizes are summed per source before anything is exchanged, so a source with most of the rows
    costs no more than another; the table of sources and size classes is broadcast only if it is small.
    """
    counted = docs[size].cast("long") if size else word_count(docs[text])
    sized = with_row(docs, src=docs[source].cast("string"), key=docs[key], size=counted)
    narrow = stored(sized.select("src", "key", "size"), "sizes")
    tops = stored(_thresholds(narrow, share, most, weights, seed), "thresholds")
    keyed = sized.withColumns({"s": F.coalesce("src", F.lit("")), "none": F.col("src").isNull(), "class": size_class(F.col("size"))})
    joined = keyed.join(small(tops), ["s", "none", "class"])
    copies = F.col("whole") + F.when(coin(F.col("key"), seed) <= F.col("top"), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as plan_mix says, in its own columns."""
    return plan_mix(docs, **options).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "words")
    return plan_mix(sized, size="words").select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM per
), levels AS (
  SELECT *, row_number() OVER o AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)
), chosen AS (
  SELECT level AS l FROM levels WHERE level <= CAST(cap AS DOUBLE) / weight ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * (SELECT l FROM chosen), CAST(cap AS DOUBLE))) AS target FROM levels
), rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0) AS rate,
    length(bin(d.size)) * 16 + (d.size >> CAST(greatest(length(bin(d.size)) - 4, 0) AS BIGINT)) AS class,
    CAST('0x' || substr(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS coin,
    CAST('0x' || substr(md5('10:' || coalesce(d.source, 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, rank() OVER (PARTITION BY source, class ORDER BY coin) AS nth, count(*) OVER (PARTITION BY source, class) AS n,
    count(*) OVER (PARTITION BY source ORDER BY class RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rated
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN nth <= floor(upto * (rate - floor(rate)) + start) - floor((upto - n) * (rate - floor(rate)) + start) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
