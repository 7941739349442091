"""Operator 3: place rows in shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: a prime more than 100 times the shards keeps their shares within about 1 %.
SHARDS, SLOTS = 48, 5003


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard. `slots` must be a prime above the number of shards.

    Every shard has its own order of all slots, offset + j x skip (mod slots), from two digests of its name. The
    shards take turns; each claims the first slot of its order that is still free. When a shard leaves, its slots are
    dealt out anew and nearly all others stay.
    """
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be there and differ")
    if slots <= len(names) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards")
    number = lambda tag, name: int(hashlib.md5(f"{tag}:{name}".encode()).hexdigest()[:15], 16)
    place = [number("offset", n) % slots for n in names]
    skip = [number("skip", n) % (slots - 1) + 1 for n in names]
    table, left = [-1] * slots, slots
    while True:
        for shard in range(len(names)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % slots
            table[place[shard]] = shard
            left -= 1
            if not left:
                return table


def shard_names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its digest modulo the table's size. Null keys share the slot of the text "null"."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """`row` (struct of all columns), slot, shard (index of its name).

    Only the table is broadcast; it has `slots` rows of two integers whatever the data. Rows with equal keys share a
    shard, null keys too. Nothing is exchanged. An empty input gives no rows.
    """
    import pandas as pd

    table = lookup_table(names or shard_names(), slots)
    lookup = df.sparkSession.createDataFrame(pd.DataFrame({"slot": range(slots), "shard": table}), "slot int, shard int")
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), slot_of(df[key], slots).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select("row", "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, parts: int = 4) -> None:
    """Write the rows as Parquet in a folder for each shard, `parts` writers to a shard (salted by the row's slot)."""
    placed = place(df, key, names, slots)
    salted = placed.repartition(F.col("shard"), F.pmod(F.xxhash64("slot"), F.lit(parts)))
    salted.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def op3_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs).select("row.doc_id", "slot", "shard")


def oracle() -> str:
    table = "".join(f"{x:02x}" for x in lookup_table(shard_names()))
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents
)
SELECT doc_id, slot, CAST('0x' || substr('{table}', slot * 2 + 1, 2) AS INTEGER) AS shard FROM placed
"""
