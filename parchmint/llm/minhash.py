"""Operator 6: near duplicates by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lean, mix, shingles, stored, word_hashes

#: Bands x rows of a band: at a similarity of 0.8 a pair shares no band with chance 0.00005.
BANDS, ROWS = 25, 5
#: Sketches of documents that agree in fewer of their places than this don't join families (0.8 twice, less five standard deviations of the sketch).
AGREE = 0.38
#: Shingles of a block; a larger family is compared block by block.
BLOCK = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text: A-Z lower-cased, k words each; a shorter text is one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.unique(shingles(word_hashes(words), k))


def sketch(x: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: every place gets a value, and two sets agree in a place with their Jaccard similarity as the chance.

    In round i of the first `size`, every element goes to a hashed place with the value (i, hash); in the next
    `size` rounds all elements go to place i - size. A place keeps its smallest value, so rounds can stop once all places have one:
    after about size x log(size) elements, however they are spread over rounds.
    """
    out = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    none, i = out[0], 0
    low, n = np.uint64((1 << 48) - 1), len(x)
    while i < size:
        rounds = np.arange(i, min(size, i + max(1, 768 // n)), dtype=np.uint64)
        h = mix((x[None, :] ^ mix(rounds, 3)[:, None]).ravel(), 2)
        place = ((h >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.intp)
        value = (np.repeat(rounds, n) << np.uint64(48)) | (h * np.uint64(0x9FB21C651E98DF25) >> np.uint64(16) & low)
        order = np.argsort(value)[::-1]  # the last write to a place is its smallest value
        found = np.full(size, none)
        found[place[order]] = value[order]
        np.minimum(out, found, out=out)
        i += len(rounds)
        if (out != none).all():
            return out
    for j in np.flatnonzero(out == none):
        h = mix(x ^ mix(np.array([size + j], dtype=np.uint64), 3), 2)
        out[j] = np.uint64(size + j) << np.uint64(48) | (h >> np.uint64(16)).min()
    return out


def bands(s: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = mix(np.arange(n, dtype=np.uint64), 5)
    for r in range(rows):
        key = mix(key ^ s[: n * rows].reshape(n, rows)[:, r], 6)
    return key.view(np.int64)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        np.seterr(over="ignore")
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = shingle_set(text.as_py(), k)
                if len(x):
                    s = sketch(x, BANDS * ROWS)
                    rows.append((key, len(x), xxhash.xxh3_128_digest(x.tobytes()), bands(s).tolist(), mix(s, 7).astype(np.uint8).tobytes()))
                else:
                    rows.append((key, 0, None, None, None))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_shingles", "content", "bands", "sketch"])

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = pa.array((x == y).mean(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def linked(sets: list[np.ndarray], left: int | None = None, percent: int = 80) -> list[int]:
    """Root (an index) of each set's component under links of a similarity of at least percent / 100.

    left: compare only the first `left` sets with the others, not within. All pairs that could join two components are
    decided on the full sets; a pivot is skipped once everything that it may link to is in its component.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    whole, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(whole, kind="stable")
    ids = np.empty(len(whole), dtype=np.int64)
    ids[order] = np.cumsum(np.r_[0, whole[order][1:] != whole[order][:-1]])
    count = np.bincount(ids)
    starts, owners = np.r_[0, np.cumsum(count)], owner[order]
    ends = np.cumsum(size)
    root = np.arange(m)
    for p in range(m if left is None else left):
        others = np.arange(p + 1, m) if left is None else np.arange(left, m)
        if not (root[others] != root[p]).any():
            if left is None and not (root != root[0]).any():
                break
            continue
        g = ids[ends[p] - size[p] : ends[p]]
        g = g[count[g] > 1]
        if not len(g):
            continue
        n = count[g]
        at = np.arange(n.sum()) + np.repeat(starts[g] - np.r_[0, np.cumsum(n)[:-1]], n)
        common = np.bincount(owners[at], minlength=m)
        hit = others[100 * common[others] >= percent * (size[p] + size[others] - common[others])]
        hit = hit[root[hit] != root[p]]
        if len(hit):
            join = np.unique(np.r_[root[hit], root[p]])
            root[np.isin(root, join)] = join.min()
    return root.tolist()


def _verify(k: int, percent: int):
    def groups(batches):
        for b in batches:
            yield from zip(*[b.column(i).to_pylist() for i in range(6)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        a, b = [], []
        for (_, first, second), rows in groupby(groups(batches), key=lambda r: r[:3]):
            part: dict[int, tuple[int, np.ndarray]] = {}
            for _, _, _, block, key, text in rows:
                part[key] = (block, shingle_set(text, k))
            keys = sorted(part, key=lambda x: (part[x][0] != first, x))
            left = None if first == second else sum(part[x][0] == first for x in keys)
            if len(keys) < 2 or left in (0, len(keys)):
                continue
            least: dict[int, int] = {}
            roots = linked([part[x][1] for x in keys], left, percent)
            for x, r in zip(keys, roots):
                least[r] = min(x, least.get(r, x))
            found = [(least[r], x) for x, r in zip(keys, roots) if least[r] != x]
            a += [x for x, _ in found]
            b += [x for _, x in found]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of `docs` (doc_id, text; more columns are ignored), a row for each row.

    1. Every text gives its set's size, a digest of the set, a sketch and its bands. Documents with equal sets form a
       class; from here on its smallest doc_id stands for it.
    2. In each band's bucket, members are tied to the smallest member (no pairs are listed). Ties whose sketches agree in
       AGREE of the places or more make families, the components of ties: a pair of 0.8 shares about eight buckets, and
       either's similarity to the smallest member of one of them is over 0.5 if the other is tied to it at 0.7.
    3. A family's full sets are compared in one task, or in pairs of blocks of about `block` shingles. Each task returns a star for each
       component that it finds; the components of all stars are the result.

    Null texts and texts without words have an empty set and link with nothing; so do rows without doc_id. Rows that repeat a doc_id are one document.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    facts = stored(docs.mapInArrow(lean(_sketches(k), True), "doc_id long, n_shingles long, content binary, bands array<long>, sketch binary"), "sketches")
    classes = stored(facts.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("bucket", "a")
    ties = rows.join(least, "bucket").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    sig = classes.select("rep", "sketch")
    both = ties.join(sig.toDF("a", "x"), "a").join(sig.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_agree, "a long, b long")
    family = components(both, "families").toDF("rep", "family")
    family = stored(family.join(classes.select("rep", "n"), "rep"), "family")
    parts = family.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("parts"))
    member = family.join(parts, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # the same join at every size: texts go to their families through one exchange
    text = docs.join(member.hint("merge"), docs["doc_id"] == member["rep"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(F.col("block"), i).alias("i"), F.greatest(F.col("block"), i).alias("j")))
    dealt = text.select("family", F.explode(pairs).alias("p"), "block", "rep", "text").select("family", "p.i", "p.j", "block", "rep", "text")
    stars = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(_verify(k, percent), True), "a long, b long")
    found = components(stars, "links").toDF("rep", "component")
    of = classes.select("content", "rep").join(found, "rep", "left").select("content", F.coalesce("component", "rep").alias("component"))
    joined = facts.select("doc_id", "n_shingles", "content").join(of, "content", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
