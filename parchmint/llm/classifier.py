"""Operator 4: a convolutional network over bytes, in numpy, for document quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, give_back


@dataclass(frozen=True)
class Shape:
    """chunk: bytes in a chunk; step: bytes from one chunk to the next (they overlap by chunk - step); width: bytes under a filter; stride: bytes between two places of a filter; filters: their number."""

    chunk: int = 512
    step: int = 448
    width: int = 6
    stride: int = 3
    filters: int = 32


#: Fitting takes the whole texts of at most this many labelled documents of each class, and of so many of them that their chunks hold at most this many bytes together.
FIT_DOCUMENTS, FIT_BYTES = 3000, 10 << 20


def chunked(raw: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text (rows, padded with zeros) and how many bytes each has. An empty text has one empty chunk."""
    n = max(1, -(-(len(raw) - (shape.chunk - shape.step)) // shape.step))
    flat = np.zeros((n - 1) * shape.step + shape.chunk, dtype=np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    x = np.lib.stride_tricks.sliding_window_view(flat, shape.chunk)[:: shape.step]
    size = np.minimum(np.maximum(len(raw) - np.arange(n) * shape.step, 0), shape.chunk)
    return x, size


class Net:
    """filters[k, b, f]: weight of byte b at place k of filter f. A chunk's features are relu(bias + slope x log of its bytes + the largest response over its places), as the largest of few responses is smaller than that of many; its logit is linear in them; a document's logit is the mean over its chunks."""

    def __init__(self, shape: Shape, seed: int = 4):
        r = np.random.default_rng(seed)
        self.shape = shape
        self.p = {
            "filters": r.normal(0, 0.3, (shape.width, 256, shape.filters)).astype(np.float32),
            "bias": np.zeros(shape.filters, np.float32),
            "slope": np.zeros(shape.filters, np.float32),
            "out": r.normal(0, 0.3, shape.filters).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def responses(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        s, w = self.shape, self.p["filters"]
        places = (s.chunk - s.width) // s.stride + 1
        end = (places - 1) * s.stride + 1
        r = w[0][x[:, 0:end : s.stride]]
        for k in range(1, s.width):
            r += w[k][x[:, k : k + end : s.stride]]
        short = size < s.chunk
        if short.any():  # places that start in the padding don't count
            at = np.arange(places) * s.stride
            r[short] += np.where(at[None, :] < np.maximum(size[short] - s.width + 1, 1)[:, None], np.float32(0), np.float32(-1e9))[:, :, None]
        return r

    def fill(self, size: np.ndarray) -> np.ndarray:
        return (np.log((size + 8) / self.shape.chunk) / 4).astype(np.float32)

    def shift(self, size: np.ndarray) -> np.ndarray:
        return self.p["bias"] + self.fill(size)[:, None] * self.p["slope"]

    def logits(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        found = [np.maximum(self.responses(x[i : i + 16], size[i : i + 16]).max(1) + self.shift(size[i : i + 16]), 0) @ self.p["out"] for i in range(0, len(x), 16)]
        return np.concatenate(found) + self.p["base"]

    def score(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.float64(self.logits(*chunked(raw, self.shape)).mean()))))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 24, rate: float = 0.006, decay: float = 3e-4, seed: int = 4) -> Net:
        """Adam on the log loss; the classes weigh the same. Gradients go through the place with the largest response of each filter."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, size = np.concatenate([docs[j][0] for j in pick]), np.concatenate([docs[j][1] for j in pick])
                count = np.array([len(docs[j][0]) for j in pick])
                owner = np.repeat(np.arange(len(pick)), count)
                best, at = [], []
                for a in range(0, len(x), 64):
                    resp = self.responses(x[a : a + 64], size[a : a + 64])
                    at.append(resp.argmax(1))
                    best.append(np.take_along_axis(resp, at[-1][:, None, :], 1)[:, 0])
                z, at = np.concatenate(best) + self.shift(size), np.concatenate(at)
                h = np.maximum(z, 0)
                logit = np.bincount(owner, h @ self.p["out"], len(pick)) / count + self.p["base"][0]
                error = (1 / (1 + np.exp(-logit)) - labels[pick]) * weight[pick] / len(pick)
                each = (error / count)[owner].astype(np.float32)
                dz = each[:, None] * self.p["out"] * (z > 0)
                g = {"out": h.T @ each, "base": np.array([error.sum()], np.float32), "bias": dz.sum(0), "slope": self.fill(size) @ dz, "filters": np.zeros_like(self.p["filters"])}
                rows, f = np.arange(len(x))[:, None], np.broadcast_to(np.arange(self.shape.filters), at.shape)
                for k in range(self.shape.width):
                    np.add.at(g["filters"][k], (x[rows, at * self.shape.stride + k], f), dz)
                t += 1
                for k, p in self.p.items():
                    grad = g[k] + decay * p
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def held_out(key) -> F.Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), documents: int = FIT_DOCUMENTS, size: int = FIT_BYTES) -> Net | float:
    """A net fitted on labelled documents that aren't held out; a constant where a class is missing.

    The sample of rows: of each class the documents with the smallest hash of the id, `documents` at most, and only the
    first of them whose whole texts fit in `size` bytes of chunks together (the first one always does). Texts are measured in the tasks before any is
    fetched, so the driver gets at most 2 x `size` bytes or one text of each class. Of rows that repeat a doc_id the one with the smallest text is taken; a document labelled both 0 and 1
    counts as 0. Null texts count as empty.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).collect()]
    if len({r["quality"] for r in chosen}) < 2:
        return float(chosen[0]["quality"]) if chosen else 0.5
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["quality"], i) for i, r in enumerate(chosen)], "doc_id long, quality int, place int")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    mine = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(ids), "doc_id")
    sizes = mine.groupBy("doc_id", "quality", "place").agg(F.min(F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"))).alias("least")).select("doc_id", "quality", "place", "least.*").collect()
    taken, full = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: r["place"]):
        bytes_ = max(1, -(-(r["bytes"] - (shape.chunk - shape.step)) // shape.step)) * shape.chunk
        if not full[r["quality"]] or full[r["quality"]] + bytes_ <= size:
            taken.append((r["doc_id"], r["bytes"], r["h"]))
            full[r["quality"]] += bytes_
        else:
            full[r["quality"]] = size  # the first that doesn't fit ends the sample of its class
    wanted = spark.createDataFrame(taken, "doc_id long, bytes int, h long")
    got = mine.select("*", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h")).join(F.broadcast(wanted), ["doc_id", "bytes", "h"]).select("doc_id", "quality", "text").toPandas()
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    if got.quality.nunique() < 2:
        return float(got.quality.iloc[0]) if len(got) else 0.5
    return Net(shape).fit([chunked(_bytes(x), shape) for x in got.text], got.quality.to_numpy())


def score_column(model: Net | float):
    """A function from a text column to scores. Each text is read whole; null counts as empty, and an empty text has one chunk of padding and so a score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        forget()
        found = pd.Series([model if isinstance(model, float) else model.score(_bytes(x)) for x in text], dtype="float64")
        give_back()
        return found

    return score


def scored(docs: DataFrame, model: Net | float) -> DataFrame:
    """doc_id, held_out, score, predicted of `docs` (doc_id, text; more columns are ignored). Null ids are not held out."""
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score_column(model)(docs["text"].cast("string")).alias("score"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of `docs` (doc_id, text): fit on the labelled documents that aren't held out, score all.

    A row for each row, by its own text; null texts count as empty and have a score, as empty ones do. A text's score is that of
    all its chunks, however long it is. An empty table gives no rows; other columns are not read.
    """
    return scored(docs, train(docs, labels))


def op4_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
