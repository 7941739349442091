"""Operator 5: near duplicates among embeddings by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mix, small, stored

#: Fewest hash tables; share of the pairs just at the limit that the tables are to find; vectors that one task compares with each other at once.
TABLES, RECALL, BLOCK = 10, 0.99, 500
#: Bits of the sketch that travels before a vector does, and standard deviations allowed: a pair at the limit has more bits unlike with a chance below one in a million.
BITS, DEVIATIONS = 128, 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    d, h = x.shape[1], 1
    while h < d:
        x = x.reshape(len(x), d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), d)
        h *= 2
    return x / math.sqrt(d)


@lru_cache(maxsize=64)
def tables_for(dimension: int, hashes: int, limit: float, recall: float = RECALL) -> int:
    """Hash tables after which a pair whose cosine is `limit` shares a bucket with chance `recall` at least, TABLES or more.

    A table finds the pair if all its hashes agree, or all but one in which the largest coordinate of one vector is the
    second largest of the other. Both chances are measured for one hash, on 20,000 random pairs of the padded dimension.
    """
    d = max(2, 1 << max(0, dimension - 1).bit_length())
    r = np.random.default_rng(5)
    same = near = n = 0
    while n < 20_000:
        x, z = r.normal(size=(2, 500, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (x * z).sum(1, keepdims=True) * x
        y = limit * x + math.sqrt(max(0.0, 1 - limit * limit)) * z / np.linalg.norm(z, axis=1, keepdims=True)
        found = []
        for v in (x, y):
            order = np.argsort(-np.abs(v), axis=1)[:, :2]
            found.append(2 * order + (np.take_along_axis(v, order, 1) < 0))
        a, b = found
        equal = a[:, 0] == b[:, 0]
        same, near, n = same + equal.sum(), near + (~equal & ((a[:, 0] == b[:, 1]) | (a[:, 1] == b[:, 0]))).sum(), n + len(x)
    p, q = same / n, near / n
    chance = min(p**hashes + hashes * p ** (hashes - 1) * q, 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def sketches(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Signs of `bits` rotated coordinates of each vector, as bytes."""
    n, d = x.shape
    padded = np.zeros((n, max(2, 1 << max(0, d - 1).bit_length())))
    padded[:, :d] = x
    signs, i = [], 0
    while sum(s.shape[1] for s in signs) < bits:
        r, y = np.random.default_rng([6, i, d]), padded
        for _ in range(3):
            y = hadamard(y * r.choice([-1.0, 1.0], padded.shape[1]))
        signs.append(y > 0)
        i += 1
    return np.packbits(np.concatenate(signs, axis=1)[:, :bits], axis=1)


def unlike_bits(limit: float, bits: int = BITS) -> int:
    """Most bits in which the sketches of two vectors with a cosine of `limit` or more differ, but for the chance that DEVIATIONS leaves."""
    p = math.acos(max(-1.0, min(1.0, limit))) / math.pi
    return min(bits, math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p))))


def codes(x: np.ndarray, hashes: int, tables: int = TABLES) -> np.ndarray:
    """Buckets of unit vectors: [vector, table, probe], probe 0 their own bucket.

    A table joins `hashes` cross-polytope hashes: after three rounds of random signs and a Hadamard transform, the largest
    coordinate in size and its sign. Probe i puts the second largest coordinate in place of the largest in hash i.
    """
    n, d = x.shape
    padded = np.zeros((n, max(2, 1 << max(0, d - 1).bit_length())))
    padded[:, :d] = x
    out = np.empty((n, tables, hashes + 1), dtype=np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for h in range(hashes):
            r, y = np.random.default_rng([5, t, h, d]), padded
            for _ in range(3):
                y = hadamard(y * r.choice([-1.0, 1.0], padded.shape[1]))
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            a = np.abs(np.take_along_axis(y, order, 1))
            order = np.where((a[:, 0] >= a[:, 1])[:, None], order, order[:, ::-1])
            for i, to in enumerate((best, second)):
                to.append((2 * order[:, i] + (y[rows, order[:, i]] < 0)).astype(np.uint64))
        for probe in range(hashes + 1):
            key = mix(np.full(n, t * 4096 + d, dtype=np.uint64), 8)
            for h in range(hashes):
                key = mix(key ^ (second if probe == h + 1 else best)[h], 9)
            out[:, t, probe] = key
    return out


def units(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length, as bytes of doubles, scaled to length 1. A row's result depends on that row alone, so that its buckets are the same wherever they are computed."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null for those that link with nothing."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = None if v is None or None in v else np.array(v, dtype="<f8") + 0.0
            out.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _bucketed(hashes: int, tables: int):
    """(id, h, v) -> the buckets of each vector, with its sketch and not the vector itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[int]] = {}
            raw = b.column(2).to_pylist()
            for i, v in enumerate(raw):
                by.setdefault(len(v), []).append(i)
            for every in by.values():
                for start in range(0, len(every), 1024):
                    at = every[start : start + 1024]
                    x = units([raw[i] for i in at])
                    c = codes(x, hashes, tables).reshape(len(at), -1)
                    width, own = c.shape[1], np.arange(c.shape[1]) % (hashes + 1) == 0
                    sketch = pa.array([s.tobytes() for s in sketches(x)], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), width)))
                    yield pa.RecordBatch.from_arrays([pa.array(c.ravel().view(np.int64)), pa.array(np.tile(own, len(at))), *[b.column(i).take(pa.array(np.repeat(at, width))) for i in (0, 1)], sketch], ["bucket", "own", "id", "h", "sketch"])

    return run


def _plausible(limit: float):
    """Of the rows of each bucket (or pair of its blocks) those whose sketch is like that of another; at least one of two is in its own bucket."""
    most = unlike_bits(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            bucket, first, second, side, own = (t.column(i).to_numpy() for i in range(5))
            s = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(t), -1)
            new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in (bucket, first, second)])]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(t)]
            end = np.repeat(ends, ends - starts)
            keep, one, rows = np.zeros(len(t), bool), first == second, np.arange(len(t))
            wide = (ends - starts) > FEW
            rows = rows[~np.repeat(wide, ends - starts)]
            k = 1
            while len(rows := rows[rows + k < end[rows]]):
                p = rows[(own[rows] | own[rows + k]) & (one[rows] | (side[rows] != side[rows + k]))]
                p = p[np.bitwise_count(s[p] ^ s[p + k]).sum(1) <= most]
                keep[p] = keep[p + k] = True
                k += 1
            for a, z in zip(starts[wide], ends[wide]):
                for i in range(a, z, 64):
                    j = slice(i, min(i + 64, z))
                    like = sum(np.bitwise_count(s[j, None, w] ^ s[None, a:z, w]).astype(np.uint16) for w in range(s.shape[1])) <= most
                    like &= own[j, None] | own[None, a:z]
                    like[np.arange(j.stop - i), np.arange(i - a, j.stop - a)] = False
                    if not one[a]:
                        like &= side[j, None] != side[None, a:z]
                    keep[j] |= like.any(1)
            if keep.any():
                kept = t.filter(pa.array(keep)).select([0, 1, 2, 3, 4, 5, 6])
                yield from kept.combine_chunks().to_batches()

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut so that no (bucket, i, j) lies in two tables."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = [t.column(i).to_numpy() for i in range(3)]
        starts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _near_pairs(x: np.ndarray, own: np.ndarray, limit: float, side: np.ndarray, one: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of equal (small) groups: a row and those up to `end` after it, for one distance after the other."""
    found, rows = [], np.arange(len(x))
    for k in range(1, int((end - rows).max(initial=0))):
        rows = rows[rows + k < end[rows]]
        p = rows[(own[rows] | own[rows + k]) & (one[rows] | (side[rows] != side[rows + k]))]
        for at in range(0, len(p), 8192):
            i = p[at : at + 8192]
            i = i[np.einsum("ij,ij->i", x[i], x[i + k]) >= limit]
            found.append((i, i + k))
    return tuple(np.concatenate(f) if found else np.empty(0, np.int64) for f in (zip(*found) if found else ((), ())))


def _block_pairs(x: np.ndarray, own: np.ndarray, limit: float, side: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one large group, by products of 256 rows with all."""
    found = []
    for at in range(0, len(x), 256):
        rows = slice(at, at + 256)
        close = (x[rows] @ x[at:].T >= limit) & (own[rows, None] | own[None, at:])
        if not one:
            close &= side[rows, None] != side[None, at:]
        p, q = np.nonzero(close)
        found.append((p[p < q] + at, q[p < q] + at))
    return tuple(np.concatenate(f) for f in zip(*found))


def _settled(p: np.ndarray, q: np.ndarray, x: np.ndarray, bucket: np.ndarray, sizes: np.ndarray, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """links and root (smallest row that it is tied to) of each row, from those pairs whose first shared bucket is the one at hand."""
    need = np.unique(np.r_[p, q])
    place = np.empty(len(x), dtype=np.int64)
    place[need] = np.arange(len(need))
    c, here = codes(x[need], hashes, tables), bucket.view(np.uint64)
    none, links, ties = np.iinfo(np.uint64).max, np.zeros(len(x), dtype=np.int64), []
    for at in range(0, len(p), 4096):
        a, b = p[at : at + 4096], q[at : at + 4096]
        left, right = c[place[a]], c[place[b]]
        same = left[:, :, :, None] == right[:, :, None, :]
        same[:, :, 1:, 1:] = False
        shared = np.where(same.any(3), left, none).min(2)  # smallest shared bucket of each table
        mine = shared[np.arange(len(a)), (shared != none).argmax(1)] == here[a]
        a, b = a[mine], b[mine]
        np.add.at(links, a, sizes[b])
        np.add.at(links, b, sizes[a])
        ties.append((a, b))
    a, b = (np.concatenate(t) for t in zip(*ties))
    root = np.arange(len(x))
    while len(a) and (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        for side in (a, b):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        root = root[root]
    return links, root


#: Groups of more rows are compared by products of matrices.
FEW = 48


def _links(hashes: int, limit: float, tables: int = TABLES):
    """For each bucket (or pair of its blocks): pairs of which at least one is in its own bucket and whose cosine reaches the limit, each counted in the first of the buckets that it shares."""

    def settle(t: pa.Table) -> Iterator[tuple]:
        bucket, first, second, side, own, key, n = (t.column(i).to_numpy() for i in range(7))
        fresh = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in (bucket, first, second, key, t.column(8).to_numpy())])]
        own = np.logical_or.reduceat(own, np.flatnonzero(fresh))
        bucket, first, second, side, key, n = (k[fresh] for k in (bucket, first, second, side, key, n))
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in (bucket, first, second)])])
        ends = np.r_[starts[1:], len(bucket)]
        width = np.repeat(ends - starts, ends - starts)
        x = units(t.column(7).filter(pa.array(fresh)).to_pylist())
        few = np.flatnonzero((width > 1) & (width <= FEW))
        jobs = [few] if len(few) else []
        jobs += [np.arange(s, e) for s, e in zip(starts, ends) if e - s > FEW]
        for at in jobs:
            if at is few:
                group = np.repeat(np.arange(len(starts)), ends - starts)[at]
                end = np.searchsorted(group, group, "right")
                p, q = _near_pairs(x[at], own[at], limit, side[at], (first == second)[at], end)
            else:
                p, q = _block_pairs(x[at], own[at], limit, side[at], bool(first[at[0]] == second[at[0]]))
            if len(p):
                links, root = _settled(p, q, x[at], np.ascontiguousarray(bucket[at]), n[at], hashes, tables)
                some = np.flatnonzero(links)
                yield key[at][some], links[some], key[at][root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches):
            length = pc.binary_length(whole.column(7)).to_numpy()
            for d in np.unique(length):  # vectors of different lengths don't link
                for out in settle(whole if (length == d).all() else whole.filter(pa.array(length == d))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, limit: float = 0.9, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of `vectors` (vec_id, embedding; more columns are ignored), a row for each row.

    Equal vectors form a class that its smallest vec_id stands for, so copies cost nothing; a class's links count all copies. A bucket with more than
    `block` classes is compared in pairs of blocks. Buckets meet first by sketches of BITS bits; a vector travels only to those of its buckets
    that hold a vector with a like sketch. Every pair found there is checked in doubles in the task that
    has the bucket; tasks return counts and one star for each component, never pairs. The number of tables follows from the number of
    hashes and the dimension, so that a pair just at the limit is found with chance `recall` however many vectors there are.

    Vectors that are null, empty or zero, or hold a null or non-finite component,
    link with nothing; vectors of different lengths don't link; rows without vec_id link with nothing; rows that repeat a vec_id count as copies if
    their vectors are equal, and as vectors of their own under one id if not. An empty table gives no rows.
    """
    rows = stored(vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding")).mapInArrow(_pack, "vec_id long, v binary"), "vectors")
    classes = stored(rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v")), "vector-classes")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("bytes")).first()
    dimension = max(1, (total["bytes"] or 8) // 8)
    corners = 2 * max(2, 1 << max(0, dimension - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(2, total["n"]) / 16) / math.log(corners)))  # buckets grow with the table
    tables = tables_for(dimension, hashes, limit, recall)
    dealt = classes.select("id", "h", "v").mapInArrow(_bucketed(hashes, tables), "bucket long, own boolean, id long, h long, sketch binary")
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("some"))
    large = stored(counts.where(F.col("some") & (F.col("m") > block)).select("bucket", F.ceil(F.col("m") / block).cast("int").alias("parts")), "large-buckets")
    split = dealt.join(small(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(F.col("block"), i).alias("i"), F.greatest(F.col("block"), i).alias("j")))
    spread = split.select("bucket", F.explode(pairs).alias("p"), "block", "own", "id", "h", "sketch").select("bucket", "p.i", "p.j", "block", "own", "id", "h", "sketch")
    like = stored(spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_plausible(limit), "bucket long, i int, j int, block int, own boolean, id long, h long"), "like-vectors")
    sent = like.join(classes.hint("merge"), ["id", "h"]).select("bucket", "i", "j", "block", "own", "id", "n", "v", "h")
    found = stored(sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id", "h").mapInArrow(_links(hashes, limit, tables), "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")), "vector-components").toDF("id", "component")
    known = classes.join(links, "id", "left").join(component, "id", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    joined = rows.join(known, "v", "left")
    has = F.col("vec_id").isNotNull()
    component = F.coalesce(F.when(has, F.col("component")), F.col("vec_id"))
    return joined.select("vec_id", F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
