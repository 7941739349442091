"""Operator 8: remove passages of several lines that occur elsewhere. A chunk of two lines starts at every line, so no passage is missed; content-defined chunks are what is counted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, HOT_SHARE, join_known, lean, small, stored

#: Lines under the rolling hash; one place in DIVISOR is a boundary; least and most lines of a chunk.
WINDOW, DIVISOR, LEAST, MOST = 2, 3, 2, 16
_M, _B = (1 << 61) - 1, 0x1F3D5B79A8642


def boundaries(hashes: list[int], window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where chunks of lines end (exclusive). A boundary follows a line if the rolling hash of the last `window` line hashes is 0 modulo `divisor`, so lines put in before or after a passage move only the boundaries next to them."""
    out, start, rolling, drop = [], 0, 0, pow(_B, window, _M)
    for i, h in enumerate(hashes):
        rolling = (rolling * _B + h) % _M
        if i >= window:
            rolling = (rolling - hashes[i - window] * drop) % _M
        n = i + 1 - start
        if n >= most or n >= least and (rolling ^ rolling >> 29) % divisor == 0:
            out.append(i + 1)
            start = i + 1
    if start < len(hashes):
        out.append(len(hashes))
    return out


def chunks(text: str | None) -> tuple[list[bytes], list[tuple[int, int, bool]]]:
    """Lines of a text and its chunks: first line, end, whether it has several lines with a word."""
    import xxhash

    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    ends = boundaries([xxhash.xxh3_64_intdigest(x) for x in lines])
    out, start = [], 0
    for end in ends:
        out.append((start, end, sum(1 for x in lines[start:end] if x.strip()) > 1))
        start = end
    return lines, out


def pairs(lines: list[bytes]) -> list[tuple[int, int]]:
    """First line and end of every two neighbouring lines with a word; blank lines between them belong to the pair."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(i, j + 1) for i, j in zip(full, full[1:])]


def _hash(raw: bytes, bits: int) -> int:
    import xxhash

    return (xxhash.xxh3_64_intdigest(raw) >> (64 - bits)) - (1 << 63)


def _emit_lines(bits: int):
    """Hash and bytes of what pairs consist of: lines with a word, alone and with the blank lines before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text in b.column(1):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                for start, end in pairs(lines):
                    seen.update((lines[start], b"\n".join(lines[start + 1 : end])))
            raw = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([_hash(x, bits) for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["h", "raw"])

    return run


def _emit_pairs(bits: int, whole: bool):
    """Pairs by the hashes of their first line and of the rest; with their bytes if `whole`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                for i, (start, end) in enumerate(pairs(lines)):
                    rest = b"\n".join(lines[start + 1 : end])
                    rows.append((key, i, _hash(lines[start], bits), _hash(rest, bits), *([lines[start] + b"\n" + rest] if whole else [])))
            names = ["doc_id", "pair", "a", "b", *(["raw"] if whole else [])]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, drop in zip(b.column(1), b.column(2).to_pylist()):
            text = text.as_py()
            if text is None:
                rows.append((None, 1, 0, 0, 0))
                continue
            if not drop:
                rows.append((text, text.count("\n") + 1, 0, 0, 0))
                continue
            lines, found = chunks(text)
            spans, gone, whole = pairs(lines), set(), 0
            for i in drop:
                # rows that repeat a doc_id may have fewer pairs
                gone.update(range(*spans[i]) if i < len(spans) else ())
            for start, end, several in found:
                if several and all(i in gone for i in range(start, end) if lines[i].strip()):
                    gone.update(range(start, end))
                    whole += 1
            kept = [x for i, x in enumerate(lines) if i not in gone]
            rows.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(found), whole, len(gone)))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4))]], ["row", "kept", "n_lines", "n_chunks", "chunks_removed", "lines_removed"])


def _again(places: DataFrame, keys: list[str], name: str) -> DataFrame:
    """doc_id, pair of the places whose keys also stand earlier. A key with many places is met by a broadcast, so no task gets them all."""
    firsts = stored(places.groupBy(*keys).agg(F.min(F.struct("doc_id", "pair")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    total, most = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # without a frequent key the places are read once
    met = join_known(places, firsts, keys, total if most > max(HOT, total // HOT_SHARE) else 0)
    return met.where("doc_id <> first.doc_id OR pair <> first.pair").select("doc_id", "pair")


def repeated_pairs(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, drop (numbers of the pairs to remove) of documents (doc_id, text) that hold a pair of lines that also occurs earlier: in a smaller doc_id, or earlier in the same text.

    Lines travel once with their bytes, to find hashes that stand for two contents. Pairs with such a hash are then compared by
    their bytes; of all others equal hashes are equal bytes. Equal lines and pairs are combined in each task first, so a frequent one travels once from each.
    `bits`: length of the hashes (tests shorten it).
    """
    docs = docs.where("doc_id IS NOT NULL")
    content = docs.mapInArrow(lean(_emit_lines(bits)), "h long, raw binary").distinct()
    unsure = stored(content.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h"), "unsure-lines")
    places = docs.mapInArrow(lean(_emit_pairs(bits, False)), "doc_id long, pair int, a long, b long")
    if unsure.isEmpty():
        return _again(places, ["a", "b"], "pairs").groupBy("doc_id").agg(F.collect_set("pair").alias("drop"))
    either = small(unsure.withColumnRenamed("h", "a")), small(unsure.withColumnRenamed("h", "b"))
    sure = places.join(either[0], "a", "left_anti").join(either[1], "b", "left_anti")
    whole = docs.mapInArrow(lean(_emit_pairs(bits, True)), "doc_id long, pair int, a long, b long, raw binary")
    doubtful = whole.join(either[0], "a", "left_semi").unionByName(whole.join(either[0], "a", "left_anti").join(either[1], "b", "left_semi"))
    again = _again(sure, ["a", "b"], "pairs").unionByName(_again(doubtful.drop("a", "b"), ["raw"], "doubtful-pairs"))
    return again.groupBy("doc_id").agg(F.collect_set("pair").alias("drop"))


def dedup_lines(docs: DataFrame, bits: int = 64) -> DataFrame:
    """`row` (struct of all columns), kept (the text without repeated passages), n_lines, n_chunks (0 where nothing is removed), chunks_removed (those that go whole), lines_removed.

    Two neighbouring lines that occur earlier go, so a run of two or more goes whole wherever chunks end; where all lines of a chunk go, its blank lines go too.
    Null texts stay null and have one line; rows without doc_id stay as they are; rows that repeat a doc_id are treated alike. Of a pair that repeats, the
    occurrence in the smallest doc_id, or first in its text, stays, unless its lines repeat others: every line that goes has an equal one
    earlier that stays. Blank lines don't count as lines of a pair. An empty table gives no rows.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    drop = stored(repeated_pairs(plain, bits), "drops").withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("key"))
    # texts meet their drops by the same merge join at every size, and travel once
    joined = rows.join(drop.hint("merge"), F.col("key") == F.col("id"), "left").select("row", F.col("row.text").cast("string").alias("whole"), "drop")
    kind = joined.select("row").schema["row"].dataType.simpleString()
    return joined.select("row", "whole", "drop").mapInArrow(lean(_cut), f"row {kind}, kept string, n_lines long, n_chunks long, chunks_removed long, lines_removed long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with text replaced by what is kept, and n_chars by its length."""
    done = dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "chunks_removed", "lines_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
