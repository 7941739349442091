"""Operator 7: best-fit packing, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import REMEMBERED, REMEMBERED_BYTES, lean, memory, stored, with_row

LIMIT = 4096
#: A word of its own that texts hardly hold.
SEPARATOR = "\x7f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """Ids of words as little-endian unsigned 32-bit integers; those of short words are remembered between texts, `entries` at most."""

    def __init__(self, path: str, entries: int = 2 * REMEMBERED):
        from tokenizers import Tokenizer

        self.entries, self.tokenizer, self.owner = entries, Tokenizer.from_file(path), f"ids {path}"
        alone = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else -1

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by one call for all of them with a separator between two. Where the separators don't come out as one id each, and as nothing else, every word is encoded by itself."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == self.separator) * 4
        if len(at) != len(words) - 1:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)])]

    def learn(self, known: dict, new: list[bytes]) -> None:
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            known.update(zip(part, self.encoded([w.decode("utf-8", "replace") for w in part])))

    def __call__(self, text: str | None) -> bytes:
        known = memory(self.owner, beside=self.owner.replace("ids ", "tokenizer ", 1))
        words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces and nothing else
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.entries:
                known.clear()
                new = set(words)
            self.learn(known, list(new))
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > REMEMBERED_BYTES:
                del known[w]
        if len(known) > self.entries:
            known.clear()
        return out


def _ids(path: str) -> _Ids:
    """One tokenizer for each Python worker, for all its tasks until another operator takes its memory."""
    kept = memory(f"tokenizer {path}", beside=f"ids {path}")
    if "ids" not in kept:
        kept["ids"] = _Ids(path)
    return kept["ids"]


def _pieces(path: str, limit: int, end_id: int):
    """The tokenizer works on words between ASCII white space, which it drops: so a text's ids are those of its words in turn, and most words come from memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, end = _ids(path), array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = ids(text.as_py()) + end
                for n, at in enumerate(range(0, len(found), 4 * limit)):
                    part = found[at : at + 4 * limit]
                    out.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32. Null and empty texts give one piece that holds the end id alone."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(lean(_pieces(path or default_tokenizer(), limit, end_id), True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, ranks, first sequence, items a sequence, offset).

    Items first_rank ... of a length go, `items` at a time, to sequences first_sequence ... from `offset` on. Sequences
    that look alike are kept as one run of numbers; a step splits at most one run, so the plan's size depends on the number of
    different lengths, not on the number of documents.
    """
    room: list[tuple[int, int, int]] = []  # residual, first sequence, sequences; sorted
    steps, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(room, (length,))
            if at < len(room):
                residual, first, n = room.pop(at)
            else:
                residual, first = limit, opened
                n = -(-left // (limit // length))
                opened += n
            each = residual // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, full * each, first, each, limit - residual))
                rank, left = rank + full * each, left - full * each
                if residual - each * length:
                    insort(room, (residual - each * length, first, full))
            if full < n:
                if left:  # fewer than `each` remain: they share the next sequence
                    steps.append((length, rank, left, first + full, left, limit - residual))
                    if residual - left * length:
                        insort(room, (residual - left * length, first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    insort(room, (residual, first + full, n - full))
    return steps


#: Pieces that one task ranks, about.
RANKED = 500_000


def pack(pieces: DataFrame, limit: int = LIMIT, salts: int | None = None) -> DataFrame:
    """`pieces` (doc_id, piece, length and more) with sequence_id and offset.

    The histogram (at most `limit` rows) goes to the driver and the plan comes back as a table of at most one row for each
    length. A piece's rank within its length is its rank within (length, salt) plus the counts of the salts before,
    so no task ranks all pieces of a frequent length; the salts grow with the number of pieces. Equal ids and pieces (repeated rows) are ranked in any order;
    null ids are ranked first. Other columns of `pieces` stay as they are, but for sequence_id and offset, which are replaced.
    `pieces` should be stored: it is read three times.
    """
    spark = pieces.sparkSession
    salts = salts or max(16, pieces.count() // RANKED)
    salt = F.pmod(F.xxhash64(pieces["doc_id"], pieces["piece"]), F.lit(salts)).cast("int")
    salted = with_row(pieces, doc_id=pieces["doc_id"], piece=pieces["piece"], length=pieces["length"], salt=salt)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps: dict[int, list] = {}
    for length, *rest in plan(histogram, limit):
        steps.setdefault(length, []).append(tuple(rest))
    planned = spark.createDataFrame([(k, v) for k, v in steps.items()], "length long, steps array<struct<rank:long,n:long,first:long,each:long,at:long>>")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    local = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    # the window has dealt and sorted the pieces as the merge join needs them, so only the counts are exchanged
    ranked = local.join(before.hint("merge"), ["length", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    step = F.element_at(F.filter("steps", lambda s: (s["rank"] <= F.col("r")) & (F.col("r") < s["rank"] + s["n"])), 1)
    # the plan has a fixed bound: a row for each length up to `limit`
    placed = ranked.join(F.broadcast(planned), "length").withColumn("s", step).withColumn("k", F.col("r") - F.col("s.rank"))
    return placed.select(
        *[F.col("row")[c].alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")],
        (F.col("s.first") + F.floor(F.col("k") / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + F.col("k") % F.col("s.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """Cut and pack `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece that holds the end id alone. Every row is packed, rows that repeat a doc_id too, each by its own text. An
    empty table gives no rows; other columns are not read.
    """
    return pack(stored(cut(docs, path, limit, end_id), "pieces"), limit)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
