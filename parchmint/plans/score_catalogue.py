"""Audits, expectations, scores, timing and diagnostics over texts made of the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import emit as E
from ..operators import scoring as SC
from ..options import Options
from .registry import query, table

#: The converted text of an order: a label without a value for every third, a table whose second amount may lack its sign, for odd orders only.
_MD = """SELECT o_orderkey, 'order' || o_orderkey AS name, '# Order ' || o_orderkey || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'Total Estimated Costs:' || chr(10) || chr(10) || 'none given' ELSE 'Total Estimated Costs:' || chr(10) || price END || chr(10)
 || CASE WHEN o_orderkey % 2 = 1 THEN '| code | ' || price || ' | ' || CASE WHEN o_orderkey % 5 = 0 THEN substr(price, 2) ELSE price END || ' |' ELSE repeat(price || ' ', CAST(o_orderkey % 6 AS BIGINT)) END AS md FROM (SELECT o_orderkey, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders)"""


def _converted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"))
    k, nl = F.col("o_orderkey"), F.lit("\n")
    label = F.concat(F.lit("Total Estimated Costs:\n"), F.when(k % 3 == 0, "\nnone given").otherwise(F.col("price")))
    second = F.when(k % 5 == 0, F.substring(F.col("price"), F.lit(2), F.length("price"))).otherwise(F.col("price"))
    body = F.when(k % 2 == 1, F.concat(F.lit("| code | "), "price", F.lit(" | "), second, F.lit(" |"))).otherwise(F.repeat(F.concat("price", F.lit(" ")), (k % 6).cast("int")))
    return o.select("o_orderkey", F.concat(F.lit("order"), k.cast("string")).alias("name"), F.concat(F.lit("# Order "), k.cast("string"), nl, label, nl, body).alias("md"), "price")


@query(f"""WITH c AS ({_MD}) SELECT name, 'bare-currency' AS type, list_last(string_split(trim(md, ' |'), ' ')) AS detail FROM c WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0
UNION ALL SELECT name, 'label-without-value', 'Total Estimated Costs' FROM c WHERE o_orderkey % 3 = 0
UNION ALL SELECT name, 'no-table-but-many-amounts', len(regexp_extract_all(md, '\\$[0-9,]+\\.[0-9]{{2}}')) || ' amounts' FROM c WHERE o_orderkey % 2 = 0 AND len(regexp_extract_all(md, '\\$[0-9,]+\\.[0-9]{{2}}')) >= 4""")
def audit_findings(spark, sf_dir):
    return SC.findings(_converted(spark, sf_dir)).select("name", "type", "detail")


@query(f"""WITH c AS ({_MD}), r AS (SELECT o_orderkey, 'order' || o_orderkey || '.pdf' AS key, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS needle FROM orders WHERE o_orderkey % 4 = 0)
SELECT name, 'contain' AS rule, needle, contains(md, needle) AS ok FROM c JOIN r USING (o_orderkey) UNION ALL SELECT name, 'omit', 'none given', NOT contains(md, 'none given') FROM c UNION ALL SELECT name, 'no_match', '^\\| code', NOT regexp_matches(md, '(?m)^\\| code') FROM c""")
def expectation_rules(spark, sf_dir):
    """Rules of single documents, named by another extension, and of all."""
    own = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("key"), F.lit("contain").alias("rule"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("needle"), F.lit(None).cast("string").alias("label"))
    every = SC.expectations(spark, '{"*": {"mustNotContain": ["none given"], "mustNotMatch": ["^\\\\| code"]}}')
    return SC.checked(_converted(spark, sf_dir), own.unionByName(every)).select("name", "rule", "needle", "ok")


@query(f"""WITH c AS ({_MD}), p AS (SELECT o_orderkey, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders),
t AS (SELECT c.*, price, contains(md, price) AS total, o_orderkey % 3 <> 0 AS headline FROM c JOIN p USING (o_orderkey))
SELECT count(*) AS docs, count(*) FILTER (total) AS total_ok, count(*) AS total_checked, count(*) FILTER (o_orderkey % 2 = 1) AS attribution_ok, 2 * count(*) AS attribution_checked, count(*) FILTER (o_orderkey % 2 = 1) AS tables,
 count(*) FILTER (headline OR o_orderkey % 2 = 1 AND false) AS headline_ok, count(*) FILTER (NOT headline) AS headline_miss, count(*) FILTER (NOT headline) = 0 AS markers_match FROM t""")
def score_totals(spark, sf_dir):
    """Scores of all texts against the orders: the total, a code that stands beside it in tables, and one that is nowhere."""
    c = _converted(spark, sf_dir)
    amount = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    truth = c.join(amount, "o_orderkey").select(
        F.col("o_orderkey").alias("id"), "name", F.lit(False).alias("gold"), F.col("t").alias("expect_total"), F.array(F.struct(F.lit("code").alias("code"), F.col("t").alias("amount")), F.struct(F.lit("absent").alias("code"), F.col("t").alias("amount"))).alias("expect_items"),
        F.lit(False).alias("expect_error"), F.lit(None).cast("string").alias("address"),
    )
    # the figure in the table's row isn't the headline's, so the four lines from the label on are cut before it
    heads = c.select("name", F.regexp_replace("md", r"\n(\| code)", "\n\n\n\n$1").alias("md"))
    t = SC.totals(SC.score(heads, truth))
    return t.select("docs", "total_ok", "total_checked", "attribution_ok", "attribution_checked", "tables", "headline_ok", "headline_miss", "markers_match")


@query("SELECT count(*) AS documents, sum(o_orderkey % 5) AS pages, round(sum(o_totalprice), 2) AS total_ms, max(o_totalprice) AS slowest_ms, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median_ms FROM orders")
def timing_summary(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("ms"), (F.col("o_orderkey") % 5).alias("pages"))
    return SC.timing(r).select("documents", "pages", F.round("total_ms", 2).alias("total_ms"), "slowest_ms", "median_ms")


_ITEMS = "SELECT CASE o_orderkey % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'expanded' WHEN 2 THEN 'queued' ELSE 'done' END AS status, o_orderkey * 100 AS size, o_orderkey * 37 AS bytes, o_orderkey * 9 AS tokens FROM orders"


def _items(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 10 == 0, "error").when(k % 10 == 1, "expanded").when(k % 10 == 2, "queued").otherwise("done")
    return table(spark, sf_dir, "orders").select(status.alias("status"), (k * 100).alias("size"), (k * 37).alias("bytes"), (k * 9).alias("tokens"))


@query(f"SELECT count(*) AS documents, CAST(sum(size) AS BIGINT) AS source_bytes, CAST(sum(bytes) AS BIGINT) AS output_bytes, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(floor((1 - sum(bytes) / sum(size)) * 100 + 0.5) AS BIGINT) AS percent FROM ({_ITEMS}) WHERE status = 'done'")
def batch_savings(spark, sf_dir):
    return SC.savings(_items(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (status IN ('done', 'error')) AS finished, count(*) FILTER (status = 'error') AS failed, CAST(floor(count(*) FILTER (status IN ('done', 'error')) * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM ({_ITEMS}) WHERE status <> 'expanded'")
def batch_progress(spark, sf_dir):
    return SC.progress(_items(spark, sf_dir))


@query("""WITH m AS (SELECT l_returnflag AS mode, l_linestatus AS token, list_sort(list(l_quantity))[count(*) // 2 + 1] AS c FROM lineitem GROUP BY 1, 2)
SELECT token, max(c) FILTER (mode = 'A') AS "A", max(c) FILTER (mode = 'N') AS "N", max(c) FILTER (mode = 'R') AS "R" FROM m GROUP BY 1""")
def confidence_probe(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("token"), F.col("l_quantity").alias("confidence"))
    return SC.probe(r, ["A", "N", "R"])


@query("""SELECT c_custkey AS name, 'source_format: csv · pages: ' || (c_custkey % 50 + 1) || CASE WHEN c_custkey % 9 = 0 THEN ' · status: conversion failed' ELSE '' END || chr(10) || 'ocr: no' || chr(10) || 'review_flags: ' || c_custkey % 3
 || CASE c_custkey % 3 WHEN 1 THEN ' · by_type: a=1' WHEN 2 THEN ' · by_type: ?=1, a=1' ELSE '' END || chr(10) || 'settings: outputs=md · wrap=80' AS report FROM customer""")
def diagnostics_counts(spark, sf_dir):
    """Reports that hold counts only: a type that is no identifier shows as a question mark."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    docs = c.select(k.alias("name"), F.lit("csv").alias("kind"), F.create_map(F.lit("pages"), (k % 50 + 1).cast("string")).alias("meta"), F.when(k % 9 == 0, "broken").alias("error"))
    flags = c.select(k.alias("name"), F.explode(F.slice(F.array(F.lit("a"), F.lit("of a Person")), 1, (k % 3).cast("int"))).alias("type"))
    return SC.diagnostics(docs, flags, Options(wrap=80))


@query("""SELECT o_orderkey AS name, 'total-mismatch' AS type, '$1' AS context, CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '1' END AS flags FROM orders""")
def review_flags(spark, sf_dir):
    """Flags attached to documents: metadata counts them, values stay."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    block = F.struct(F.lit(0).alias("idx"), F.lit("paragraph").alias("type"), F.lit("$1").alias("text"), F.lit("$1").alias("markdown"))
    docs = o.select(k.alias("name"), F.create_map(F.lit("kind"), F.lit("csv")).alias("meta"), F.array(block).alias("blocks"))
    flags = o.select(k.alias("name"), F.explode(F.array_repeat(F.lit("total-mismatch"), F.when(k % 2 == 0, 2).otherwise(1))).alias("type")).select("name", F.lit(0).alias("idx"), "type", F.lit("$1").alias("text"), F.lit("off").alias("message"))
    r = E.with_review(docs, flags)
    return r.select("name", F.get("review", F.lit(0))["type"].alias("type"), F.get("blocks", F.lit(0))["text"].alias("context"), F.col("meta")["reviewFlags"].alias("flags"))
