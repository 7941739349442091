"""Text, delimited and JSON sources as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, line_no (from 1), text of each line."""
    parts = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(parts).alias("n", "text")).select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), "text")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, trimmed, empty ones left out."""
    parts = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n{2,}")
    return docs.select("doc_id", F.posexplode(parts).alias("n", "text")).withColumn("text", T.trimmed(F.col("text"))).where("text <> ''")


def delimited(lines: DataFrame, separator: str, least: int = 3) -> DataFrame:
    """doc_id, line_no, width, cells, header of lines with `least` fields or more; header: all cells filled and none numeric."""
    cells = F.split("text", F.lit(f"\\Q{separator}\\E"))
    rows = lines.withColumn("cells", F.transform(cells, lambda c: F.trim(c))).withColumn("width", F.size("cells").cast("long")).where(F.col("width") >= least)
    header = F.forall("cells", lambda c: (c != "") & ~c.rlike(r"^-?[0-9.,]+$"))
    return rows.select("doc_id", "line_no", "width", "cells", header.alias("header"))


def json_lines(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed records beside `ok`; a line that can't be parsed keeps its row with ok = false."""
    parsed = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("rec", parsed).withColumn("ok", F.col("rec").isNotNull() & F.col("rec._corrupt").isNull())
