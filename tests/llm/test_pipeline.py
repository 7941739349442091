"""The pipeline: on the small tables every stage against a plain version of it, then odd rows through all stages."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from test_operators import plain_best_fit, plain_components

from parchmint.llm import classifier, mixing, packing

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Stage -> (input rows, result rows)."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, DIR), name)
        assert name == "best_fit_packing" or docs.columns == columns
        out[name] = (before, before := docs.collect())
    return out


def test_quality_keeps_what_the_network_scores_half_or_more(spark, stages):
    rows, kept = stages["quality_classifier"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    net = classifier.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert Counter(kept) == Counter(r for r in rows if net.score((r.text or "").encode()) >= 0.5)


def test_repeated_lines_go(stages):
    rows, kept = stages["line_dedup"]
    got, seen = {r.doc_id: r for r in kept}, set()
    assert len(kept) == len(rows)
    for r in sorted(rows, key=lambda r: r.doc_id):
        lines, gone = r.text.split("\n"), set()
        full = [i for i, x in enumerate(lines) if x.strip()]
        for i, j in zip(full, full[1:]):
            pair = "\n".join(lines[i : j + 1])
            if pair in seen:
                gone |= set(range(i, j + 1))
            seen.add(pair)
        have = got[r.doc_id]
        assert [x for x in have.text.split("\n") if x.strip()] == [x for i, x in enumerate(lines) if i not in gone and x.strip()]
        assert have.n_chars == len(have.text) and (have.lang, have.source) == (r.lang, r.source)


def test_near_copies_leave_one_of_each_group(stages):
    rows, kept = stages["minhash_near_dedup"]
    found = plain_components({r.doc_id: r.text for r in rows}, 5)
    assert Counter(kept) == Counter(r for r in rows if found[r.doc_id][1] == r.doc_id)


def test_mix_takes_whole_rates_and_the_fraction(stages):
    rows, taken = stages["source_mix"]
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight, free, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, set(sources), 1.5 * sum(total.values()), {}
    while over := [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * total[s]]:
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            free.discard(s)
    level = left / sum(weight[s] for s in free) if free else 0
    target |= {s: weight[s] * level for s in free}
    copies = Counter(r.doc_id for r in taken)
    assert {r.doc_id for r in taken} <= size.keys() and set(taken) <= set(rows)
    for s in sources:
        rate = target[s] / total[s] if total[s] else 0.0
        start = int(hashlib.md5(f"10:{'null' if s is None else s}".encode()).hexdigest()[:13], 16) / 2**52
        classes: dict[int, list] = {}
        for r in rows:
            if r.source == s:
                n = size[r.doc_id]
                digits = max(1, n.bit_length())
                coin = int(hashlib.md5(f"10:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
                classes.setdefault(digits * 16 + (n >> max(digits - 4, 0)), []).append((coin, r.doc_id))
        before = 0
        for _, mine in sorted(classes.items()):
            upto, part = before + len(mine), rate - int(rate)
            extra = int(upto * part + start) - int(before * part + start)
            before = upto
            for i, (_, key) in enumerate(sorted(mine)):
                assert copies[key] == int(rate) + (i < extra)


def test_packing_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    rows, pieces = stages["best_fit_packing"]
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in rows:
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, i, 4096 * i, min(4096, n - 4096 * i)) for i in range(-(-n // 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in pieces) == want
    places: dict[int, list] = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 4096
    assert len(places) == plain_best_fit([r.length for r in pieces], 4096)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    some = "\n".join(f"line {i} of a passage that two documents share" for i in range(8))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, some, "en", None, 1), (4, some, "en", "a", 1), (5, some, "en", "a", 1), (5, some, "en", "a", 1), (6, "long " * 50_000, None, "b", 1)]
    names = schema.names
    assert names == ["doc_id", "text", "lang", "source", "n_chars"]
    for label, table in (("odd", rows), ("none", [])):
        spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/{label}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{label}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{label}")
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() == 0) == (label == "none")


def test_targets_of_sources_that_are_all_empty(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target) for r in mixing.plan_mix(df).collect()] == [(0, 0.0)] * 3
