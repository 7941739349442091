"""Files and events that arrive: the same plans over a stream. Every stream has a checkpoint, so it goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..options import Options
from ..storage import folder


def available_now(spark: SparkSession, path: str, table: str, keys: list[str]) -> DataFrame:
    """Counts by key of all files under `path` that match `table`, through a stream that ends once they are read.

    Each batch is counted and appended to a table under its batch number; the counts are added up when the table is read, so neither the driver nor
    the stream's state holds a row for each key. A batch that is run again replaces its own rows."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    out = folder(spark, "counts")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{table}.parque[t]")
    stream.writeStream.foreachBatch(add).option("checkpointLocation", folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in keys)
    return spark.read.schema(f"{fields}, n long, batch int").parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"))


def convert_stream(spark: SparkSession, incoming: str, out: str, checkpoint: str, opts: Options = Options(), trigger: dict | None = None) -> StreamingQuery:
    """Files that arrive in a folder, converted into `out`: documents and, in each requested format, outputs. Archives are replaced by their members in place, a file that can't be read is a row with an error. Stop the query to cancel."""
    from ..operators import emit
    from ..sources import files

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(incoming)

    def add(batch: DataFrame, number: int) -> None:
        one = batch.select(F.xxhash64("path").alias("place"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content", F.lit("").alias("mime"), F.lit(None).cast("string").alias("url"))
        inner = files.expanded(files.detected(one))
        docs = files.read(files.detected(inner.withColumnRenamed("error", "open_error")), opts).withColumn("error", F.coalesce("open_error", "error")).drop("open_error")
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        stored = spark.read.parquet(f"{out}/documents/batch={number}")
        emit.outputs(stored, opts).write.mode("overwrite").partitionBy("format").parquet(f"{out}/outputs/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fresh_jobs(jobs: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """A stream of jobs (job_id, created_at, ...) in which a job counts once and is forgotten after `ttl`; what arrives later than that is dropped."""
    return jobs.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["job_id"])


def live_paragraphs(cues: DataFrame) -> DataFrame:
    """A stream of cues (doc_id, at: seconds, text) with the start of each cue's paragraph and whether its words count. The state of a document is the start of its paragraph and its last words."""
    from ..sources.readers.plain import Transcript

    schema = "doc_id long, at double, text string, start double, counts boolean"

    def fold(key, frames, state):
        import pandas as pd

        fold_ = Transcript(*(state.get if state.exists else (None, None)))
        for f in frames:
            rows = []
            for at, text in f.sort_values("at")[["at", "text"]].itertuples(index=False):
                _, counts = fold_.add(float(at), text)
                rows.append((key[0], float(at), text, fold_.start, counts))
            state.update((fold_.start, fold_.last))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "text", "start", "counts"])

    return cues.select("doc_id", F.col("at").cast("double").alias("at"), "text").groupBy("doc_id").applyInPandasWithState(fold, schema, "start double, last string", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Counts of a stream's batches and rows, for a caller that shows how far it is."""

    def __init__(self, report: Callable[[dict], None] | None = None):
        self.batches = self.rows = 0
        self.failed: str | None = None
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        if self.report:
            self.report({"batches": self.batches, "rows": self.rows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed = event.exception
