"""Audits, expectations, scores and scalar functions on small rows; streams that are run to their end."""

import datetime as dt

from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.operators import scoring
from parchmint.options import Options
from parchmint.plans import fixtures
from parchmint.streaming import ingest


def test_expectations_of_every_shape(spark):
    shape = lambda raw: sorted(tuple(r) for r in scoring.expectations(spark, raw).collect())
    assert shape('{"a.pdf": {"mustContain": ["x"], "mustNotContain": ["y"], "mustNotMatch": ["z+"]}}') == [("a.pdf", "contain", "x", None), ("a.pdf", "no_match", "z+", None), ("a.pdf", "omit", "y", None)]
    assert shape('{"a.pdf": {"total": "$6", "items": [{"code": 7}, {"code": null}], "ok": true}}') == [("a.pdf", "contain", "$6", "total"), ("a.pdf", "contain", "7", "items[0].code")]
    assert shape('[{"file": "a.pdf", "field": "address", "expected": "12 St"}, {"name": "b", "k": 1}, {"value": "all"}]') == [("*", "contain", "all", None), ("a.pdf", "contain", "12 St", "address"), ("b", "contain", "1", "k"), ("b", "contain", "b", "name")]
    rules = scoring.expectations(spark, '[{"file": "a.pdf", "value": "$1"}, {"value": "x"}, {"file": "other", "value": "x"}]')
    got = sorted((r.needle, r.ok) for r in scoring.checked(spark.createDataFrame([("a.md", "only $1.00")], "name string, md string"), rules).collect())
    assert got == [("$1", True), ("x", False)]


def test_audit(spark):
    md = ["| a | $1.00 | 2.00 |\n\nName of it:\n\nnothing\n", "Total due:\n\n$5.00", "$1.00 $2.00 $3.00 $4.00", "```\n$1.00 $2.00 $3.00 $4.00\n```", "Label here: <!-- REVIEW: x -->\n"]
    got = sorted((r.name, r.type, r.detail) for r in scoring.findings(spark.createDataFrame([(str(i), m) for i, m in enumerate(md)], "name string, md string")).collect())
    assert got == [("0", "bare-currency", "2.00"), ("0", "label-without-value", "Name of it"), ("2", "no-table-but-many-amounts", "4 amounts")]
    assert scoring.audit(spark.createDataFrame([("0", md[0]), ("1", md[1])], "name string, md string")).where("table").count() == 1


def test_scores_and_the_rule_of_marks(spark):
    texts = [("a", "---\nx: y\n---\n# A\nTotal Estimated Costs:\n\n$1,000.00\n| 77 | $10.00 |\n| 78 |\n$20.00"), ("b", "Total Estimated Costs: <!-- REVIEW: value not recovered -->\n#Error")]
    truth = [(1, "a", True, 1000.0, [("77", 10.0), ("78", 20.0)], False, "12 St"), (2, "b", False, 5.0, [], True, None), (3, "c", False, None, None, False, None)]
    t = spark.createDataFrame(truth, "id int, name string, gold boolean, expect_total double, expect_items array<struct<code:string,amount:double>>, expect_error boolean, address string")
    s = scoring.score(spark.createDataFrame(texts, "name string, md string"), t)
    r = {x.id: x for x in s.collect()}
    assert (r[1].total_ok, r[1].items_ok, r[1].attributions, r[1].attributed, r[1].headline_ok, r[1].address_ok) == (True, True, 2, 1, True, False)
    assert (r[2].total_ok, r[2].error_ok, r[2].not_recovered, r[2].headline_ok) == (False, True, True, False) and r[3].missing
    total = scoring.totals(s).first()
    assert total.markers_match and (total.docs, total.missing, total.headline_ok, total.headline_miss, total.attribution_percent, total.error_percent) == (3, 1, 1, 1, "50%", "100%")


def test_units(spark):
    df = spark.createDataFrame([(5.0, 999), (1500.0, 9949), (61000.0, 999_499), (60.4, 1_234_567)], "ms double, n long")
    r = df.select(scoring.duration(F.col("ms")).alias("d"), scoring.compact_count(F.col("n")).alias("c"), scoring.human_size(F.col("n")).alias("s"), scoring.per_page(F.col("ms"), F.lit(10)).alias("p")).collect()
    assert [x.d for x in r] == ["5 ms", "1.5 s", "1m 1s", "60 ms"] and [x.c for x in r] == ["999", "9.9k", "999k", "1.2M"] and r[0].s == "999 B" and r[3].s == "1.2 MB" and r[2].p == "6.10 s/page" and r[3].p == "6.0 ms/page"
    none = scoring.timing(spark.createDataFrame([("a", None, 1)], "name string, ms double, pages int")).first()
    assert none.documents == 0 and none.median_ms is None


def test_diagnostics_hold_no_content(spark):
    docs = spark.createDataFrame([("d", "p d f!", {"pages": "3", "title": "Secret Title", "ocrPages": "2", "ocrDpi": "300, 200"}, None)], "name string, kind string, meta map<string,string>, error string")
    flags = spark.createDataFrame([("d", "total-mismatch"), ("d", "total-mismatch"), ("d", "Secret text")], "name string, type string")
    report = scoring.diagnostics(docs, flags, Options(validate=False)).first().report
    assert "Secret" not in report and "source_format: ?" in report and "pages: 3" in report and "ocr: yes · ocr_pages: 2 · ocr_dpi: ?" in report and "by_type: ?=1, total-mismatch=2" in report and "validate=off" in report


def test_scalars(spark):
    row = spark.range(1).select(
        T.resolved_part(F.lit("ppt/slides/s1.xml"), F.lit("../media/./i.png")).alias("a"), T.resolved_part(F.lit("x/y"), F.lit("/abs/z")).alias("b"), T.safe_file_name(F.lit(' a/b:c*?"d<>| \t e. ')).alias("c"), T.safe_file_name(F.lit("...")).alias("d"),
        T.cue_clock(F.lit("1:02,500")).alias("e"), T.clock_seconds(F.lit("01:01:01")).alias("f"), T.without_tags(F.lit("<i>a</i> {\\an8}b")).alias("g"), T.without_ansi(F.lit("\x1b[31mred\x1b[0m")).alias("h"), T.is_date_format(F.lit('"day" 0.0')).alias("i"), T.is_date_format(F.lit("h:mm")).alias("j"),
        T.data_url_bytes(F.lit("data:image/png;base64,aGk=")).alias("k"), T.data_url_type(F.lit("data:,x")).alias("l"), T.data_url_bytes(F.lit("data:text/plain,a%20b")).alias("m"), T.cell_lines(F.lit("; a<br>b <b>c</b>;")).alias("n"), T.clamped(F.lit(7), 0, 5).alias("o"),
        T.serial_date(F.lit(45384.25)).alias("p"), T.serial_date(F.lit(0.5), code=F.lit("hh:ss")).alias("q"), T.serial_date(F.lit(1.0), date1904=True).alias("r"), T.trimmed_number(F.lit(0.1 + 0.2)).alias("s"), T.trimmed_number(F.lit(-0.0)).alias("t"), T.trimmed_number(F.lit(18420.5)).alias("u"),
        T.data_url(F.lit(b"hi"), F.lit("a/b")).alias("v"),
    ).first()
    assert list(row) == ["ppt/media/i.png", "abs/z", "a-b-c-d- - e", "document", "00:01:02", 3661, "a b", "red", False, True, b"hi", "application/octet-stream", b"a b", "a; b c", 5, "2024-04-02 06:00:00", "12:00:00", "1904-01-02", "0.3", "0", "18420.5", "data:a/b;base64,aGk="]


def test_files_that_arrive(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    (incoming / "a.csv").write_text("h,k\n1,2")
    (incoming / "z.zip").write_bytes(fixtures.zipped({"x.csv": "h\n3", "y.docx": fixtures.docx([("", "t")])}))
    (incoming / "bad.ipynb").write_text("{")
    seen = []
    listener = ingest.Progress(seen.append)
    spark.streams.addListener(listener)
    start = lambda: ingest.convert_stream(spark, str(incoming), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    start()
    (incoming / "later.csv").write_text("h\n9")
    start()
    spark.streams.removeListener(listener)
    docs = spark.read.parquet(str(tmp_path / "out/documents")).collect()
    assert sorted(r.name for r in docs) == ["a.csv", "bad.ipynb", "later.csv", "x.csv", "y.docx"] and [r.name for r in docs if r.error] == ["bad.ipynb"]
    out = spark.read.parquet(str(tmp_path / "out/outputs"))
    assert out.where("content IS NOT NULL").count() == 4 and {r.format for r in out.collect()} == {"md"}


def _memory(df, spark, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_jobs_count_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at), ("a", at + dt.timedelta(seconds=30)), ("b", at + dt.timedelta(minutes=1))]
    spark.createDataFrame(rows, "job_id string, created_at timestamp").write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema("job_id string, created_at timestamp").parquet(str(tmp_path / "jobs"))
    assert sorted(r.job_id for r in _memory(ingest.fresh_jobs(stream), spark, "jobs")) == ["a", "b"]


def test_live_captions_carry_their_state(spark, tmp_path):
    schema = "doc_id long, at double, text string"
    first, later = [(1, 0.0, "A."), (1, 10.0, "b."), (2, 0.0, "x")], [(1, 25.0, "c"), (1, 26.0, "c"), (2, 50.0, "y")]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "cues" / f"batch{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "cues/batch*"))
    got = sorted((r.doc_id, r.at, r.start, r.counts) for r in _memory(ingest.live_paragraphs(stream), spark, "captions"))
    assert got == [(1, 0.0, 0.0, True), (1, 10.0, 0.0, True), (1, 25.0, 25.0, True), (1, 26.0, 25.0, False), (2, 0.0, 0.0, True), (2, 50.0, 50.0, True)]
