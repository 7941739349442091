"""From files to outputs: read, check, mark, emit. One plan; every step is one of the package's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import emit, validate
from ..options import Options
from ..sources import files
from ..storage import stored

FLAGS = ["doc_id", "idx", "type", "text", "message"]


def table_cells(docs: DataFrame, key: str = "name") -> DataFrame:
    """doc_id, table_id (idx of its block), row, col, text of all tables; the header is row 0."""
    t = files.blocks(docs, key).where("type = 'table'")
    rows = F.concat(F.when(F.size("header") > 0, F.array("header")).otherwise(F.array().cast("array<array<string>>")), "rows")
    cells = t.select(F.col(key).alias("doc_id"), F.col("idx").alias("table_id"), F.posexplode(rows).alias("row", "r")).select("doc_id", "table_id", "row", F.posexplode("r").alias("col", "text"))
    return cells


def headline_blocks(docs: DataFrame, key: str = "name") -> DataFrame:
    """doc_id, idx, type, text as the headline check reads them: headings and paragraphs, items of lists, rows of tables with all their cells."""
    b = files.blocks(docs, key).withColumnRenamed(key, "doc_id")
    plain = b.where(F.col("type").isin("heading", "paragraph")).select("doc_id", "idx", "type", "text")
    items = b.where("type = 'list'").select("doc_id", "idx", F.lit("item").alias("type"), F.explode(F.transform("items", lambda i: i["text"])).alias("text"))
    rows = F.concat(F.when(F.size("header") > 0, F.array("header")).otherwise(F.array().cast("array<array<string>>")), "rows")
    lines = b.where("type = 'table'").select("doc_id", "idx", F.lit("row").alias("type"), F.explode(F.transform(rows, lambda r: F.array_join(r, " "))).alias("text"))
    return plain.unionByName(items).unionByName(lines)


def review(docs: DataFrame, key: str = "name", lexicon: DataFrame | None = None) -> DataFrame:
    """Flags of all checks: doc_id, idx, type, text, message. Amounts and totals of tables, headline figures, and, of recognised documents (ocr or ocrPages in the metadata) if a lexicon is given, words that are none. No check changes a value."""
    cells = table_cells(docs, key)
    found = validate.currency_flags(cells).unionByName(validate.total_flags(cells)).withColumnRenamed("table_id", "idx").select(*FLAGS)
    found = found.unionByName(validate.headline_flags(headline_blocks(docs, key)).select(*FLAGS))
    if lexicon is not None:
        seen = docs.where(F.col("meta")["ocr"].isNotNull() | (F.coalesce(F.col("meta")["ocrPages"].try_cast("int"), F.lit(0)) > 0))
        prose = files.blocks(seen, key).where(F.col("type").isin("heading", "paragraph", "list", "quote")).select(F.col(key).alias("doc_id"), F.col("idx").alias("line_no"), "text")
        found = found.unionByName(validate.lexicon_flags(validate.prose_tokens(prose), lexicon).select(*FLAGS))
    return found


def convert(found: DataFrame, opts: Options = Options(), lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, outputs) of files (name, content, mime, url): archives expanded, kinds detected, files read, checked and marked, and emitted in each requested format.

    Names tell documents apart, so they are made unique first. Documents are stored: they are read by the checks and by each format."""
    placed = found.withColumn("place", F.xxhash64("name", F.length("content")))
    members = files.expanded(files.detected(placed)).withColumnRenamed("error", "unopened")
    named = emit.unique_names(members, "name", ["place", "part"])
    docs = files.read(files.detected(named), opts).withColumn("error", F.coalesce("unopened", "error")).drop("unopened", "mime")
    docs = stored(docs, "documents")
    if opts.validate:
        docs = stored(emit.with_review(docs, review(docs, "name", lexicon).withColumnRenamed("doc_id", "name"), opts), "reviewed")
    return docs, emit.outputs(docs, opts)
