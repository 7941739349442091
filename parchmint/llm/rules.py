"""Operator 2: quality rules whose cutoffs limit the share of good documents that they reject."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SYMBOLS = b"#*$%&|<>"
#: Rule -> (numerator, denominator, largest cutoff of its grid). A document breaks a rule above its cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words", 4.0),
    "marks": ("n_marks", "n_words", 4.0),
    "capitals": ("n_capitals", "word_chars", 1.0),
    "same_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "stutter": ("n_same_words", "n_words", 1.0),
    "word_length": ("word_chars", "n_words", 40.0),
}
#: Cutoffs in each grid; share of a stratum's good documents that all rules together may reject; chance that any of the bounds fails.
GRID, RISK, DELTA = 128, 0.05, 0.05
#: Shares of good documents above a cutoff by which the joint rule sets are ordered, from loose to strict.
LEVELS = [0.0, *(0.001 * 1.25**i for i in range(19))]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_same_words"]


def measures(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII spaces and nothing else
    n = len(words)
    repeated = 0
    if n > 3:
        seen = Counter(zip(words, words[1:], words[2:]))
        if len(seen) < n - 2:
            reach = 0
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if seen[w] > 1:
                    repeated += i + 3 - max(reach, i)
                    reach = i + 3
    lines = text.split("\n")
    whole: set[str] = set()
    same = 0
    for line in lines:
        if line in whole:
            same += bool(line.encode("utf-8", "surrogatepass").split())
        else:
            whole.add(line)
    chars = sum(map(_code_points, words))
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return n, chars, less(SYMBOLS), same, repeated, len(lines), less(b"!"), less(bytes(range(65, 91))), sum(map(eq, words, words[1:]))


_TAILS = bytes(range(0x80, 0xC0))


def _code_points(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.translate(None, _TAILS))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(x.as_py()) for x in batch.column(2)]
        cols = list(zip(*rows)) or [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "stratum", *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and COUNTS of `docs` (doc_id, lang, text). A stratum is a language code of two or three letters; all else is "other", so their number has a fixed bound."""
    stratum = F.when(F.col("lang").rlike("^[a-z]{2,3}$"), F.col("lang")).otherwise("other")
    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p: the regularized incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a chance after k of n: the p at which k or fewer have probability `level`."""
    low, high = k / n if n else 0.0, 1.0
    if not n or k >= n:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > level else (low, mid)
    return high


def path(counts: dict[str, dict[int, tuple[int, int]]]) -> list[dict[str, int]]:
    """Joint rule sets in a fixed order, each as strict as the one before or stricter in every rule: rule -> step; a document breaks a rule above its step.

    `counts`: rule -> step -> (good, bad) of the designing half of a stratum. At a level, a rule's step is the lowest above which
    no larger share of the good documents lies, if at least twice that share of the bad ones does. At level 0 there
    is a gap between good and bad documents; the first set takes its upper end, the second its middle, the third its lower end.
    """
    sets: list[dict[str, int]] = [{} for _ in range(len(LEVELS) + 2)]
    for rule, by in counts.items():
        n_good, n_bad = (sum(v[i] for v in by.values()) for i in (0, 1))
        above, good, bad = [], 0, 0
        for step in range(GRID - 1, -1, -1):
            good, bad = good + by.get(step + 1, (0, 0))[0], bad + by.get(step + 1, (0, 0))[1]
            above.append((step, good, bad))
        last = GRID
        for i, level in enumerate(LEVELS):
            fits = [(step, g, b) for step, g, b in above if b and g <= level * n_good and b * n_good >= 2 * g * n_bad]
            low = min([step for step, _, _ in fits], default=GRID)
            if not i:
                upper = max([step for step, _, b in fits if b == max(x[2] for x in fits)], default=GRID)
                sets[0][rule], sets[1][rule] = upper, (upper + low + 1) // 2
            last = min(last, low)
            sets[i + 2][rule] = last
    return sets


def choose(steps: dict[str, list[tuple[int, int]]], n_good: dict[str, int], risk: float = RISK, delta: float = DELTA) -> dict[str, int | None]:
    """Stratum -> number of the rule set to use (None: no set is safe and useful).

    `steps`: stratum -> (good, bad) documents of the testing half that each set of the path rejects; `n_good`: good documents of that
    half. In a stratum the sets are tested in their order, by the exact binomial test of "it rejects good documents with a chance over `risk`",
    up to the first that isn't proven safe: a fixed order needs no correction within itself. The level `delta` is split over the strata;
    a stratum whose sets are all safe passes its part on to the others (Holm's step for a fixed order in each stratum), so
    all bounds hold together with a chance of 1 - delta. Of the safe sets the one that rejects most bad documents less good ones is used, of several the first.
    """
    part = {s: delta / len(steps) for s in steps}
    reached = dict.fromkeys(steps, 0)
    done: set[str] = set()
    while True:
        for s in part.keys() - done:
            while reached[s] < len(steps[s]) and binomial_tail(steps[s][reached[s]][0], n_good[s], risk) <= part[s]:
                reached[s] += 1
        new = {s for s in part.keys() - done if reached[s] == len(steps[s])}
        done |= new
        rest = part.keys() - done
        if not new or not rest:
            break
        freed = sum(part[s] for s in new) / len(rest)
        part |= {s: part[s] + freed for s in rest}
    found: dict[str, int | None] = {}
    for s, every in steps.items():
        gain = [bad - good for good, bad in every[: reached[s]]]
        found[s] = gain.index(max(gain)) if gain and max(gain) > 0 else None
    return found


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that has labels: stratum and a cutoff (or null) for each rule.

    One half of the labelled documents, by a hash of the id, orders the joint rule sets of its stratum; the other half tests them.
    Both halves are counted in the tasks (stratum, rule, step; then stratum, set); the driver sees only these counts, whose number is bounded by
    language codes x rules x steps. Labels that are null are left out; a document labelled both 0 and 1 counts as 0; of
    rows that repeat a doc_id one is counted, the one with the smallest counts.
    """
    spark = features.sparkSession
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    step = lambda a, b, top: F.least(F.ceil(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)) / F.lit(top) * GRID), F.lit(GRID)).cast("int")
    one = features.where("NOT base_failed").groupBy("doc_id").agg(F.min(F.struct("stratum", *COUNTS)).alias("f")).select("doc_id", "f.*")
    known = one.join(marked, "doc_id").select("stratum", (F.col("quality") == 1).alias("good"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("designs"), *[step(*x).alias(r) for r, x in RULES.items()])
    known = stored(known, "labelled")
    each = known.where("designs").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("s"))
    counts: dict[str, dict] = {r["stratum"]: {x: {} for x in RULES} for r in known.select("stratum").distinct().collect()}
    for r in each.groupBy("stratum", "s.rule", "s.step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect():
        counts[r["stratum"]][r["rule"]][r["step"]] = (r["good"], r["bad"])
    schema = "stratum string, sets array<struct<" + ", ".join(f"{r}:int" for r in RULES) + ">>"
    paths = {s: path(c) for s, c in counts.items()}
    table = spark.createDataFrame([(s, [tuple(x[r] for r in RULES) for x in p]) for s, p in paths.items()], schema)
    broken = lambda x: F.greatest(*[(F.col(r) > x[r]).cast("int") for r in RULES]) == 1
    first = known.where("NOT designs").join(F.broadcast(table), "stratum").select("stratum", "good", F.array_position(F.transform("sets", broken), True).alias("first"))
    sets = len(LEVELS) + 2
    hits = {s: [[0, 0] for _ in range(sets)] for s in paths}
    n_good = dict.fromkeys(paths, 0)
    for r in first.groupBy("stratum", "first").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect():
        n_good[r["stratum"]] += r["good"]
        for i in range(r["first"] - 1, sets) if r["first"] else ():
            hits[r["stratum"]][i][0] += r["good"]
            hits[r["stratum"]][i][1] += r["bad"]
    used = choose({s: [tuple(x) for x in h] for s, h in hits.items()}, n_good, risk, delta)
    rows = [(s, *[None if used[s] is None or paths[s][used[s]][r] >= GRID else paths[s][used[s]][r] / GRID * RULES[r][2] for r in RULES]) for s in paths]
    return spark.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed, cut_<rule>, kept.

    base_failed: fewer than 50 words, or more than half of the words lie in windows of three words that occur again. The other documents are
    kept unless they break a rule's cutoff in their stratum. Strata without labels, or with too few to prove a bound, reject nothing. Null texts count as empty and
    fail the base rules, whole texts are measured whatever their length; rows that repeat a doc_id are judged each by its own text. An empty table gives no rows, and other columns
    of `docs` are not read. The table of cutoffs has a row for each language code at most (under 20,000).
    """
    features = measured(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    features = stored(features, "features")
    cuts = cutoffs(features, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), risk, delta)
    broken = F.lit(False)
    for r, (a, b, _) in RULES.items():
        broken = broken | F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)) > F.col(f"cut_{r}"), F.lit(False))
    return features.join(F.broadcast(cuts), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~broken)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
