"""Every query with SQL beside it gives the same rows as that SQL."""

import random

import duckdb
import pytest

from parchmint.functions import text as T
from parchmint.operators import layout as L
from parchmint.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_money_and_brackets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("$1,234.50", "(a[b])"), ("12.5", "(]"), (None, ")("), ("1,000.00", "")], "m string, b string")
    rows = df.select(T.money(F.col("m")).alias("m"), T.brackets_balanced(F.col("b")).alias("b")).collect()
    assert [None if r.m is None else float(r.m) for r in rows] == [1234.5, None, None, 1000.0]
    assert [r.b for r in rows] == [True, False, False, True]


def test_folios_need_a_sequence_on_most_pages(spark):
    rows = [(1, "bottom", p, str(p + 10)) for p in range(1, 6)] + [(2, "bottom", p, "7") for p in range(1, 6)] + [(3, "bottom", p, str(p)) for p in (1, 2)] + [(4, "bottom", p, f"- {p} -") for p in (1, 2, 4)]
    lines = spark.createDataFrame(rows, "doc_id int, band string, page int, text string")
    pages = spark.createDataFrame([(1, 5), (2, 5), (3, 100), (4, 5)], "doc_id int, pages int")
    assert {r.doc_id for r in L.folio_sequences(lines, pages).collect()} == {1, 4}


def test_cue_paragraphs_of_repeats(spark):
    rows = [(1, 1, 0.0, "A."), (1, 2, 50.0, "A."), (1, 3, 75.0, "B"), (2, 1, 0.0, "x"), (2, 2, 60.0, "x")]
    got = sorted(tuple(r) for r in L.cue_paragraphs(spark.createDataFrame(rows, "doc_id long, cue long, start double, text string")).collect())
    assert got == [(1, 0.0, 1, 1, "A."), (1, 50.0, 2, 2, "B"), (2, 0.0, 1, 1, "x")]


def test_upper_quantiles_against_sorting(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, *range(50)]), rng.randint(1, 9)) for g in ("a", "b", None) for _ in range(rng.randint(1, 300))]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    for parts in (1, 7):
        got = {r.g: r.value for r in L.upper_quantiles(df, ["g"], "v", parts=parts).collect()}
        heavy = {r.g: r.value for r in L.upper_quantiles(df, ["g"], "v", "w", parts=parts).collect()}
        for g in {r[0] for r in rows}:
            values = sorted(v for k, v, _ in rows if k == g and v is not None)
            assert got[g] == values[len(values) // 2]
            run, total = 0, sum(w for k, v, w in rows if k == g and v is not None)
            for v, w in sorted((v, w) for k, v, w in rows if k == g and v is not None):
                run += w
                if 2 * run > total:
                    break
            assert heavy[g] == v


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rare_words_get_suggestions(spark, tmp_path):
    rng = random.Random(4)
    known = ["".join(rng.choice("aeiobcdl") for _ in range(rng.randint(4, 8))) + "a" for _ in range(40)]
    rare = {w[:i] + rng.choice("aeiobcdl") + w[i + rng.randint(0, 1) :] for w in known for i in (1, 2)} | {"unlikely", "zzzzzzzzza"}
    counts = {w: rng.randint(1, 19) for w in sorted(rare)} | {w: 20 + i for i, w in enumerate(known)}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: r.suggestion for r in catalogue.queries()["lexicon_suggestion"](spark, str(tmp_path)).collect()}
    lexicon = [w for w, n in counts.items() if n >= 20]
    want = {}
    for token, n in counts.items():
        near = [(d, len(w), -counts[w], w) for w in lexicon if n < 20 and (d := edits(token, w)) in (1, 2)]
        if near:
            want[token] = min(near)[3]
    assert any(counts[t] < 8 for t in want) and got == want


def test_suggestions_of_long_words_against_brute_force(spark):
    """Words around the length from which segments take the place of deletions, with up to three edits, and one of two thousand letters."""
    from parchmint.operators import validate

    rng = random.Random(8)
    lexicon = ["".join(rng.choice("abcde") for _ in range(n)) for n in (1, 2, 3, 5, 14, 15, 16, 17, 18, 19, 25, 40, 41) for _ in range(4)]
    tokens = {"x" * 2000}
    for w in lexicon:
        for _ in range(6):
            t = w
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(t) + 1)
                t = rng.choice([t[:i] + rng.choice("abcde") + t[i:], t[:i] + t[i + 1 :], t[:i] + rng.choice("abcde") + t[i + 1 :]])
            tokens.add(t)
    tokens -= {*lexicon, ""}
    words = list(dict.fromkeys(lexicon))
    got = {r.token: r.suggestion for r in validate.suggestions(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, rank int")).collect()}
    want = {}
    for t in tokens:
        near = [(d, len(w), i, w) for i, w in enumerate(words) if abs(len(t) - len(w)) <= 2 and (d := edits(t, w)) in (1, 2)]
        if near:
            want[t] = min(near)[3]
    assert got == want


def test_prose_tokens_and_flags(spark):
    from parchmint.operators import validate

    rows = [(1, 1, 'The comittee met. "Quoted words" Paris, café 3rd. New comittee: Wrds'), (1, 2, "77081 - DUAL energy scann"), (2, 1, "don't comittee-like xbrq")]
    got = sorted((r.doc_id, r.line_no, r.token) for r in validate.prose_tokens(spark.createDataFrame(rows, "doc_id int, line_no int, text string")).collect())
    # Quoted and Paris may be names, New is three letters, xbrq has no vowel, don't and comittee-like aren't letters alone
    assert got == [(1, 1, "comittee"), (1, 1, "comittee"), (1, 1, "words")]
    flags = validate.lexicon_flags(spark.createDataFrame([(1, 4, 1, "comittee"), (1, 2, 0, "comittee"), (2, 1, 0, "words")], "doc_id int, line_no int, pos int, token string"), spark.createDataFrame([("committee", 1), ("words", 2)], "word string, rank int")).collect()
    assert [(f.doc_id, f.idx, f.text, f.message) for f in flags] == [(1, 2, "comittee", '"comittee" is not a recognised word — it may be "committee"')]


def test_needles_in_groups(spark):
    from parchmint.operators import validate

    texts, needles = ["one two", "two", None, ""], ["two", "two", "one t", "wo", "", None, "é"]
    d = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "item int, needle string")
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(needles) if t is not None and x is not None and x in t}
    for most in (200_000, 3):
        assert sorted((r.key, r.item) for r in validate.contained(d, n, most).collect()) == sorted(want)


def test_chrome_is_a_share_of_each_source(spark, tmp_path):
    rows = [(i, "\n".join([f"body {'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}", *["five times"] * (i < 5), *["six times"] * (i < 6)]), "large", "en") for i in range(100)]
    rows += [(100 + i, "twice", "small", "en") for i in range(2)] + [(102, "once", "small", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = catalogue.queries()["doc_chrome_keys"](spark, str(tmp_path)).collect()
    assert sorted((r.source, r.key, r.n) for r in keys) == [("large", "six times", 6), ("small", "twice", 2)]
    left = [r.text for r in catalogue.queries()["doc_without_chrome"](spark, str(tmp_path)).collect()]
    assert sorted(set(left)) == sorted({f"body {a}{b}" for a in "abcdefghij" for b in "abcdefghij"} | {"five times", "once"}) and left.count("five times") == 5


def test_short_needles_are_contained(spark, tmp_path):
    texts = ["one two three four five six", "xone two three fourth", "", None, "two  three", "seven"]
    needles = ["one two three four", "two three", "thre", "", "nothing here", "ne two three four five s", "two three four fi"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(needles)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.documents for r in catalogue.queries()["expectation_contains"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(t is not None and x in t for t in texts) for i, x in enumerate(needles)}
