"""Corpora of converted documents: audits, expectations, scores against known answers, timing, savings, diagnostics. converted: name, md and more."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options

AMOUNT = r"\$[0-9,]+\.[0-9]{2}"


def _lines(converted: DataFrame) -> DataFrame:
    return converted.select("name", F.posexplode(F.split("md", "\n")).alias("n", "line"))


# ---------------------------------------------------------------- audit


def findings(converted: DataFrame) -> DataFrame:
    """name, n (line), type, detail: amounts without $ in a table row that has some with it, labels that end in a colon with no value in the next lines, and documents of four amounts or more without a table."""
    lines = _lines(converted)
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.col("line").startswith("|")).withColumn("cells", cells)
    bare = rows.where(F.exists("cells", lambda c: c.rlike(rf"^{AMOUNT}$"))).select("name", "n", F.explode(F.filter("cells", lambda c: c.rlike(r"^[0-9,]+\.[0-9]{2}$"))).alias("detail"))
    w = Window.partitionBy("name").orderBy("n")
    after = F.coalesce(F.nullif(T.trimmed(F.lead("line", 1).over(w)), F.lit("")), T.trimmed(F.lead("line", 2).over(w)), F.lit(""))
    label = F.regexp_extract(T.trimmed(F.col("line")), r"^#{0,6}\s*([A-Z][^:]{3,60}):\s*$", 1)
    lone = lines.withColumn("after", after).withColumn("detail", label).where("detail <> ''").where(~F.col("after").rlike(r"[0-9$]") & ~F.col("line").contains("REVIEW:"))
    n = F.regexp_count("md", F.lit(AMOUNT))
    none = converted.where(~F.col("md").rlike(r"(?m)^\|") & ~F.col("md").rlike(r"(?m)^```") & (n >= 4))
    return (
        bare.select("name", "n", F.lit("bare-currency").alias("type"), "detail")
        .unionByName(lone.select("name", "n", F.lit("label-without-value").alias("type"), "detail"))
        .unionByName(none.select("name", F.lit(None).cast("int").alias("n"), F.lit("no-table-but-many-amounts").alias("type"), F.concat(n.cast("string"), F.lit(" amounts")).alias("detail")))
    )


def audit(converted: DataFrame) -> DataFrame:
    """A row for each document: its size, whether it has a table, and its findings."""
    f = findings(converted).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "type", "detail"))).alias("findings"))
    return converted.join(f, "name", "left").select("name", F.length("md").alias("characters"), F.col("md").rlike(r"(?m)^\|.*\|$").alias("table"), F.coalesce("findings", F.array().cast(f.schema["findings"].dataType)).alias("findings"))


# ---------------------------------------------------------------- expectations


def expectations(spark: SparkSession, raw: str | dict | list) -> DataFrame:
    """Rules from JSON of any of the accepted shapes: key, rule (contain, omit, no_match), needle, label.

    A list of records (file, field, expected), an object of explicit rules for each file (mustContain, mustNotContain, mustNotMatch), or an object of
    any values, whose leaves must all be contained. What names no file goes to *."""
    raw = json.loads(raw) if isinstance(raw, str) else raw
    out: list[tuple] = []

    def leaves(value, path: str):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from leaves(v, f"{path}[{i}]")
        elif value is not None and not isinstance(value, bool):
            yield path, value

    def contain(key: str, value, label: str | None) -> None:
        text = str(value).strip()
        if text not in ("", "null", "undefined"):
            out.append((key, "contain", text, label or None))

    explicit = {"mustContain": "contain", "mustNotContain": "omit", "mustNotMatch": "no_match"}
    pairs = [] if isinstance(raw, list) else (raw or {}).items()
    for row in raw if isinstance(raw, list) else ():
        key = next((row[k] for k in ("file", "name", "document", "filename") if row.get(k)), "*")
        value = next((row[k] for k in ("expected", "value", "text") if row.get(k) is not None), None)
        for label, v in [(row.get("field") or row.get("key"), value)] if value is not None else leaves(row, ""):
            contain(key, v, label)
    for key, value in pairs:
        if isinstance(value, dict) and explicit.keys() & value.keys():
            out += [(key, rule, str(n), None) for name, rule in explicit.items() for n in value.get(name) or ()]
        else:
            for label, v in leaves(value, ""):
                contain(key, v, label)
    return spark.createDataFrame(out, "key string, rule string, needle string, label string")


def checked(converted: DataFrame, rules: DataFrame) -> DataFrame:
    """name, rule, needle, label, ok: each rule on each document that its key names: *, the name, or the name without its extension. Every text meets only its own rules, by an equality join; rules for all documents are a broadcast of one file's rules."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    d = converted.select("name", "md", stem(F.col("name")).alias("stem"))
    own = d.join(rules.where("key <> '*'").withColumn("stem", stem(F.col("key"))), "stem").drop("stem", "key")
    every = d.drop("stem").join(F.broadcast(rules.where("key = '*'").drop("key")), F.lit(True))
    ok = F.when(F.col("rule") == "contain", F.contains("md", "needle")).when(F.col("rule") == "omit", ~F.contains("md", "needle")).otherwise(~F.regexp_like("md", F.concat(F.lit("(?m)"), F.col("needle"))))
    return own.unionByName(every).select("name", "rule", "needle", "label", ok.alias("ok"))


# ---------------------------------------------------------------- scores


def score(converted: DataFrame, truth: DataFrame, headline: str = r"Total Estimated Costs:") -> DataFrame:
    """A row for each known answer (id, name, gold, expect_total, expect_items array of (code, amount), expect_error, address): what of it the converted text holds. Amounts are compared without thousands separators; an amount counts for its code if both stand on one line."""
    body = F.regexp_replace("md", r"^---[\s\S]*?\n---\n", "")
    j = truth.join(converted.select("name", body.alias("body")), "name", "left")
    flat = lambda c: F.replace(c, F.lit(","), F.lit(""))
    money = lambda n: F.format_string("$%.2f", n)
    lines = F.split("body", "\n")
    at = F.array_position(F.transform(lines, lambda l: l.rlike(headline)), True)
    near = F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), 4)
    has_label = F.col("expect_total").isNotNull() & (F.coalesce(at, F.lit(0)) > 0)
    items = F.coalesce("expect_items", F.array().cast(truth.schema["expect_items"].dataType))
    on_line = lambda i: F.exists(lines, lambda l: F.contains(l, i["code"]) & F.contains(flat(l), money(i["amount"].cast("double"))))
    table, fenced = F.col("body").rlike(r"(?m)^\|.*\|$"), F.col("body").rlike(r"(?m)^```")
    return j.select(
        "id", "name", "gold", F.col("body").isNull().alias("missing"), F.when(F.col("expect_total").isNotNull() & F.col("body").isNotNull(), F.contains(flat(F.col("body")), money(F.col("expect_total").cast("double")))).alias("total_ok"),
        F.when((F.size(items) > 0) & F.col("body").isNotNull(), F.forall(items, lambda i: F.contains(F.col("body"), i["code"]))).alias("items_ok"),
        F.when(F.col("body").isNotNull(), F.size(items)).alias("attributions"), F.when(F.col("body").isNotNull(), F.size(F.filter(items, on_line))).alias("attributed"),
        F.when(F.col("expect_error") & F.col("body").isNotNull(), F.contains("body", F.lit("#Error"))).alias("error_ok"), F.when(F.col("address").isNotNull() & F.col("body").isNotNull(), F.contains("body", "address")).alias("address_ok"),
        F.coalesce(table, F.lit(False)).alias("table"), F.coalesce(fenced & ~table, F.lit(False)).alias("aligned"), F.coalesce(F.contains("body", F.lit("REVIEW:")), F.lit(False)).alias("marked"),
        F.coalesce(F.contains("body", F.lit("REVIEW: value not recovered")), F.lit(False)).alias("not_recovered"), F.coalesce(F.contains("body", F.lit("is not a recognised word")), F.lit(False)).alias("lexicon"),
        F.when(has_label, F.exists(near, lambda l: F.contains(flat(l), money(F.col("expect_total").cast("double"))))).alias("headline_ok"),
    )


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.concat(F.floor(a * 100 / b + 0.5).cast("string"), F.lit("%"))).otherwise("n/a")


def totals(scores: DataFrame) -> DataFrame:
    """One row of counts over all scores, and whether the rule holds that marks of values not recovered equal the headlines missed."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    known = lambda c: F.count(F.col(c))
    t = scores.agg(
        F.count(F.lit(1)).alias("docs"), yes("missing").alias("missing"), yes("total_ok").alias("total_ok"), known("total_ok").alias("total_checked"), yes("items_ok").alias("items_ok"), known("items_ok").alias("items_checked"),
        F.coalesce(F.sum("attributed"), F.lit(0)).alias("attribution_ok"), F.coalesce(F.sum("attributions"), F.lit(0)).alias("attribution_checked"), yes("error_ok").alias("error_ok"), known("error_ok").alias("error_checked"),
        yes("table").alias("tables"), yes("aligned").alias("aligned"), yes("marked").alias("markers"), yes("not_recovered").alias("not_recovered"), yes("lexicon").alias("lexicon"), yes("headline_ok").alias("headline_ok"),
        (known("headline_ok") - yes("headline_ok")).alias("headline_miss"),
    )
    t = t.withColumn("markers_match", F.col("not_recovered") == F.col("headline_miss"))
    for name in ("total", "items", "attribution", "error"):
        t = t.withColumn(f"{name}_percent", percent(F.col(f"{name}_ok"), F.col(f"{name}_checked")))
    return t


# ---------------------------------------------------------------- timing, savings, progress


def duration(ms: Column) -> Column:
    whole = F.floor(ms / 60000)
    return (
        F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(ms < 60000, F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s")))
        .otherwise(F.concat(whole.cast("string"), F.lit("m "), F.floor((ms - whole * 60000) / 1000 + 0.5).cast("string"), F.lit("s")))
    )


def per_page(ms: Column, pages: Column) -> Column:
    each = ms / pages
    return F.when(each < 100, F.concat(F.format_string("%.1f", each), F.lit(" ms/page"))).otherwise(F.concat(F.format_string("%.2f", each / 1000), F.lit(" s/page")))


def timing(results: DataFrame) -> DataFrame:
    """One row: documents, total, pages, upper median, slowest and its name, the time of a page. results: name, ms, pages; rows without a time don't count.

    The median is found by counts of distinct times, so no task sorts all rows."""
    timed = results.where(F.col("ms").isNotNull() & ~F.isnan(F.col("ms").cast("double")))
    a = timed.agg(F.count(F.lit(1)).alias("documents"), F.sum("ms").alias("total_ms"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.max("ms").alias("slowest_ms"), F.max_by("name", F.struct("ms", "name")).alias("slowest"))
    median = upper_quantile(timed, "ms")
    return a.join(F.broadcast(median.withColumnRenamed("value", "median_ms")), F.lit(True), "left").withColumn("each", F.when(F.col("pages") > 0, per_page(F.col("total_ms"), F.col("pages"))))


def upper_quantile(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """One row, value: the upper median of a column. Values are dealt in ranges; counts of the ranges tell which one holds the middle, and only that one is ranked."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    r = n.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    sums = r.groupBy("part").agg(F.sum("n").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = Window.orderBy("lo")
    ranges = sums.withColumn("upto", F.sum("s").over(w)).withColumn("all", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = ranges.where((F.col("upto") > F.floor(F.col("all") / 2)) & (F.col("upto") - F.col("s") <= F.floor(F.col("all") / 2))).select("lo", "hi", (F.floor(F.col("all") / 2) - F.col("upto") + F.col("s")).alias("place"))
    j = n.join(F.broadcast(middle), F.col("value").between(F.col("lo"), F.col("hi")))
    return j.withColumn("run", F.sum("n").over(Window.orderBy("value"))).where("run > place").agg(F.min("value").alias("value"))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).when(n < 1073741824, F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", n / 1073741824), F.lit(" GB")))


def compact_count(n: Column) -> Column:
    return (
        F.when(n < 1000, n.cast("string")).when(n < 10000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).when(n < 1000000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1000000), F.lit("M")))
    )


def savings(items: DataFrame) -> DataFrame:
    """One row over finished items (status, size, bytes, tokens): documents, source and output bytes, tokens, percent saved (negative: grown)."""
    s = items.where("status = 'done' AND bytes IS NOT NULL").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("output_bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    change = F.floor((1 - F.col("output_bytes") / F.col("source_bytes")) * 100 + 0.5)
    return s.withColumn("percent", F.when((F.col("source_bytes") > 0) & (F.col("output_bytes") > 0), change.cast("long")))


def progress(items: DataFrame) -> DataFrame:
    """One row: total, finished, failed, percent of the items that are documents; an archive that was expanded is none."""
    p = items.where("status <> 'expanded'").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("done", "error")).alias("finished"), F.count_if(F.col("status") == "error").alias("failed"))
    return p.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("finished") * 100 / F.col("total") + 0.5).cast("long")))


def probe(readings: DataFrame, modes: list[str]) -> DataFrame:
    """token and one column for each mode: the upper median of its confidences. readings: mode, token, confidence."""
    s = F.array_sort(F.collect_list("confidence"))
    m = readings.where("confidence IS NOT NULL").groupBy("mode", "token").agg(F.get(s, F.floor(F.size(s) / 2).cast("int")).alias("median"))
    return m.groupBy("token").pivot("mode", modes).agg(F.first("median"))


# ---------------------------------------------------------------- diagnostics


def plain(c: Column) -> Column:
    """A short identifier or number as it is, all else a question mark: nothing of a document gets into a report."""
    return F.when(c.isNotNull(), F.when(c.rlike(r"^[A-Za-z0-9_.+-]{1,32}$"), c).otherwise("?"))


def diagnostics(docs: DataFrame, flags: DataFrame, opts: Options = Options(), key: str = "name") -> DataFrame:
    """key, report: formats, counts, kinds of flags and changed options of each document; no content. docs: key, kind, meta, error; flags: key, type."""
    per = flags.groupBy(key, plain(F.col("type")).alias("t")).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("flags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat(x["t"], F.lit("="), x["n"].cast("string"))), ", ").alias("kinds"))
    j = docs.select(key, "kind", "meta", "error").join(per, key, "left")
    m = F.col("meta")
    many = lambda label, name: F.when(m[name].try_cast("long") > 0, F.concat(F.lit(f"{label}: "), m[name]))
    value = lambda label, name: F.concat(F.lit(f"{label}: "), plain(F.nullif(m[name], F.lit(""))))
    line = lambda *parts: F.concat_ws(" · ", *parts)
    changed = {k: v for k, v in opts.changed().items() if k != "outputs"}
    shown = [f"outputs={'+'.join(opts.outputs)}", *[f"{k}={'on' if v is True else 'off' if v is False else v}" for k, v in changed.items()]]
    report = F.concat_ws(
        "\n", line(F.concat(F.lit("source_format: "), plain(F.coalesce("kind", F.lit("?")))), many("pages", "pages"), many("slides", "slides"), many("sheets", "sheets"), F.when(F.col("error").isNotNull(), "status: conversion failed")),
        line(F.when(m["ocr"].isNotNull() | m["ocrPages"].isNotNull(), "ocr: yes").otherwise("ocr: no"), many("ocr_pages", "ocrPages"), value("ocr_dpi", "ocrDpi"), value("ocr_confidence_mean", "ocrConfidenceMean"), value("ocr_confidence_min", "ocrConfidenceMin"), many("ocr_flagged_fields", "ocrFlaggedFields"), many("ocr_unreadable_regions", "ocrUnreadableRegions")),
        line(F.concat(F.lit("review_flags: "), F.coalesce("flags", F.lit(0)).cast("string")), F.concat(F.lit("by_type: "), F.col("kinds")), many("table_fallback", "tablesUnresolved")), F.lit(f"settings: {' · '.join(shown)}"),
    )
    return j.select(key, report.alias("report"))
