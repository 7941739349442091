"""What the operators of this subpackage share: stored intermediates, components, hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most this many rows may be broadcast (rows of a few numbers each).
BROADCAST_ROWS = 50_000

_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset a local session, whose tasks run beside the driver, gets a temporary one; a cluster gets an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            found = have.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="parchmint-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext._conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; sweep() deletes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/parchmint/{uuid.uuid4().hex}/{name}"
    if not _stored:
        atexit.unregister(_sweep_at_exit)
        atexit.register(_sweep_at_exit)
    _stored.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again. This cuts the lineage: a lost executor costs tasks, not the whole plan."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders this process has in use; for sweep(since)."""
    return len(_stored)


def sweep(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete what this process wrote to the shared folder since there were `since` folders, but for the files that `keep` reads. Call it once no other result depends on it; at the end of the process it runs by itself."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    inputs = keep.inputFiles() if keep is not None else []
    mine = _stored[since:]
    held = [p for p in mine if any(f"{p}/" in f for f in inputs)]
    for name in [p for p in mine if p not in held]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(conf).delete(path, True)
    _stored[since:] = held


def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            sweep(spark)


def collected_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished plans now rather than at the next collection, and give memory that is free again back to the system."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Return free native memory of the driver's JVM to the system: its allocator keeps what the threads of many exchanges and the compiler needed. False where the JVM can't."""
    give_back()
    gateway = spark.sparkContext._gateway
    lang, find = gateway.jvm.java.lang, gateway.jvm.java.lang.Class.forName

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = find("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *map(find, kinds)))  # the server's own class is closed to reflection
        name = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, name, "systemTrimNativeHeap", None, None))
    except Exception:  # Linux with glibc and a recent JDK only
        return False
    return True


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is (then a shuffled join follows)."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df


def with_row(df: DataFrame, **columns) -> DataFrame:
    """The whole row as one struct `row` beside computed columns, so that no column of the input can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


#: A key with more rows than this, and more than a 2,000th of all, is joined by a broadcast: at most 4,000 keys are.
HOT, HOT_SHARE = 1000, 2000


def join_known(rows: DataFrame, known: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` joined with `known`, which has one row for each key and n, the number of `rows` with it; `total`: at least the sum of n.

    Rows of a frequent key stay where they are and meet a broadcast of the frequent keys, whose number is bounded by the
    share that makes a key frequent; the others are exchanged. So no task gets all rows of one key.
    """
    hot = max(HOT, total // HOT_SHARE)
    if total <= hot:
        return rows.join(known.drop("n"), keys)
    often = known.where(F.col("n") > hot).drop("n")
    rest = rows.join(F.broadcast(often.select(keys)), keys, "left_anti").join(known.where(F.col("n") <= hot).drop("n"), keys)
    return rows.join(F.broadcast(often), keys).unionByName(rest)


#: Steps after which components() gives up with an error; a graph needs about the square of its diameter's logarithm.
STEPS = 99


def components(edges: DataFrame, name: str = "components", steps: int = STEPS) -> DataFrame:
    """Connected components of `edges` (a, b: long, null-free). Returns node, component (smallest node), a row for each node with an edge.

    Alternates large-star and small-star steps until no edge changes. Every step only groups by a node and joins the
    minimum back, frequent nodes apart; counts of edges are all that reaches the driver. Raises RuntimeError after
    `steps` steps rather than return parts of components.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, total = None, edges.count()
    least = lambda pairs: pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    for step in range(1, steps + 1):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_known(both, least(both).withColumn("m", F.least("m", "a")), ["a"], 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # of node a, all neighbours below it point to the smallest of them
        large = large.distinct()
        small_star = join_known(large, least(large), ["a"], 2 * total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(small_star, f"{name}-{step}")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    else:
        raise RuntimeError(f"components are not settled after {steps} steps")
    found = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.union(roots)


# ---------------------------------------------------------------- numpy helpers, used inside tasks

U64 = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: Entries that a Python worker remembers at most, and the longest word (bytes) among them: below 0.1 GB.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64

_memory: dict[str, dict] = {}


def memory(owner: str, beside: str | None = None) -> dict:
    """What `owner` remembers between the calls and tasks of a Python worker. A new owner takes the place of the ones before, but for `beside`, so a worker that serves one operator after the other holds one operator's memory."""
    if owner not in _memory:
        held = _memory.get(beside) if beside else None
        forget()
        if held is not None:
            _memory[beside] = held
        _memory[owner] = {}
    return _memory[owner]


def forget() -> None:
    """Drop what a Python worker remembers for any operator."""
    _memory.clear()


def give_back() -> None:
    """Return memory that is free again to the system: a worker lives through many tasks, and its allocators keep what one of them needed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's allocator can
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], remembers: bool = False) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, so that a task starts without what other operators remembered (unless it `remembers` itself) and gives its memory back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        if not remembers:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word; those of frequent words are remembered."""
    import xxhash

    seen, f = memory("hashes"), xxhash.xxh3_64_intdigest
    out = np.empty(len(words), dtype=np.uint64)
    try:
        out[:] = list(map(seen.__getitem__, words))
    except KeyError:
        out[:] = list(map(f, words))
        if len(seen) > REMEMBERED:
            seen.clear()
        for w, h in zip(words, out.tolist()):
            if len(w) <= REMEMBERED_BYTES and len(seen) <= REMEMBERED:
                seen[w] = h
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words; of the whole sequence if it is shorter; none of an empty one."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = mix(h + hashes[i : n - k + 1 + i], 1)
    return h
