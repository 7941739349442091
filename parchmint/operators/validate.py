"""Checks that flag values and never rewrite them. Types and messages of flags are fixed values. Input: table_cells(doc_id, table_id, row, col, text) and blocks(doc_id, idx, type, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def currency_flags(cells: DataFrame) -> DataFrame:
    """Amounts without $ in a column where two or more have it. The flag carries a hint where the first digit may be a misread $."""
    column = Window.partitionBy("doc_id", "table_id", "col")
    t = T.collapsed(F.col("text"))
    seen = cells.withColumn("t", t).withColumn("signed", F.count_if(F.col("t").rlike(T.MONEY)).over(column)).withColumn("rows", F.max("row").over(Window.partitionBy("doc_id", "table_id")))
    bare = seen.where((F.col("signed") >= 2) & F.col("t").rlike(T.BARE_MONEY) & (F.col("rows") >= 1))
    lead = F.substring("t", 1, 1)
    hint = F.when(lead.isin(*"3589SB"), F.format_string('"%s" may be "$%s" with the "$" misread as "%s"', "t", F.expr("substring(t, 2)"), lead)).otherwise(F.format_string('"%s" has no "$" while other amounts in this column do', "t"))
    return bare.select("doc_id", "table_id", "row", "col", F.lit("currency-sigil").alias("type"), F.col("t").alias("text"), hint.alias("message"))


def total_flags(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Columns whose amounts don't add up to the first row whose label (column 0) says total. One exchange by table: labels reach their rows through a window, columns are summed in the same partitions."""
    t = cells.withColumn("t", T.collapsed(F.col("text")))
    label = F.max(F.when(F.col("col") == 0, F.col("t"))).over(Window.partitionBy("doc_id", "table_id", "row"))
    valued = t.repartition("doc_id", "table_id").withColumn("label", label).withColumn("value", T.money(F.col("t")))
    is_total = F.coalesce(F.col("label").rlike(T.TOTAL_LABEL), F.lit(False)) & F.col("value").isNotNull()
    by = valued.groupBy("doc_id", "table_id", "col").agg(F.min_by(F.when(is_total, F.struct("row", "t", "value")), F.when(is_total, F.col("row"))).alias("total"), F.sum("value").alias("all"), F.count("value").alias("n"), F.max("row").alias("last"))
    items = F.col("all") - F.col("total.value")
    off = F.abs(items - F.col("total.value"))
    wrong = by.where(F.col("total").isNotNull() & (F.col("n") >= 3) & (F.col("last") >= 2) & (off > tolerance))
    message = F.concat(F.lit("line items sum to "), T.money_text(items), F.lit(" but the total row says "), T.money_text(F.col("total.value")), F.lit(" (off by "), T.money_text(off), F.lit(")"))
    return wrong.select("doc_id", "table_id", F.col("total.row").alias("row"), "col", F.lit("total-mismatch").alias("type"), F.col("total.t").alias("text"), message.alias("message"))


def headline_flags(blocks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Amounts that stand alone in a heading or paragraph and match none of the totals that the document states elsewhere.

    blocks: doc_id, idx, type (heading, paragraph, row, item), text; a row's text is that of all its cells."""
    t = blocks.withColumn("t", T.collapsed(F.col("text")))
    alone = t.where(F.col("type").isin("heading", "paragraph") & F.col("t").rlike(r"^[$0-9]")).withColumn("value", T.money(F.col("t"))).where("value IS NOT NULL")
    amounts = F.regexp_extract_all("t", F.lit(r"\$\s?-?[0-9,]+\.[0-9]{2}"), F.lit(0))
    stated = t.where(F.col("type").isin("paragraph", "row", "item") & F.col("t").rlike(r"(?i)\btotals?\b")).select("doc_id", "idx", F.posexplode(amounts).alias("n", "a")).select("doc_id", "idx", "n", T.money(F.col("a")).alias("total")).where("total IS NOT NULL")
    # each total once, in the order in which the document states it
    firsts = stated.groupBy("doc_id", "total").agg(F.min(F.struct("idx", "n")).alias("at"))
    totals = firsts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals"))
    wrong = alone.join(totals, "doc_id").where(~F.exists("totals", lambda x: F.abs(x - F.col("value")) <= tolerance))
    message = F.concat(F.lit("the headline figure "), T.money_text(F.col("value")), F.lit(" matches none of the totals stated elsewhere on the page ("), F.array_join(F.transform("totals", T.money_text), ", "), F.lit(")"))
    return wrong.select("doc_id", "idx", F.lit("headline-total-mismatch").alias("type"), F.col("t").alias("text"), message.alias("message"))


#: A token, and the character before it.
TOKEN = r"[^ \t\n\f\rA-Za-z]?[ \t\n\f\r]*[A-Za-z][A-Za-z'’-]*"


def prose_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of prose that a dictionary can judge: doc_id, line_no, pos, token. lines: doc_id, line_no, text."""
    prose = lines.where(~F.col("text").rlike(r"\b[0-9]{4,5}\s*-\s*\S"))
    # every token with the character before it, if that isn't white space
    found = prose.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "m"))
    before, raw = F.regexp_extract("m", r"^([^ \t\n\f\rA-Za-z]?)", 1), F.regexp_extract("m", r"([A-Za-z][A-Za-z'’-]*)$", 1)
    token = F.regexp_replace(raw, "^['’-]+|['’-]+$", "")
    initial = ((F.col("pos") == 0) & (before == "")) | before.isin(*".!?:;")
    return found.select("doc_id", "line_no", "pos", token.alias("token"), initial.alias("initial")).where(T.dictionary_candidate(F.col("token"), F.col("initial")))


def _keys(word: Column, length: Column, shifts: bool) -> Column:
    """What two words within two edits share: one of three segments of the longer one, at its place in the other give or take two.

    Two edits touch two segments at most, so the third is in the other word, moved by no more than two places. `length` is that of the segmented word;
    with `shifts` the word is the other one and every piece that a segment may have become is a key. A word has few keys however long it is."""
    size = F.greatest(F.floor(length / 3), F.lit(1)).cast("int")
    pieces = []
    for i in range(3):
        start = size * i
        width = (length - start) if i == 2 else size
        for shift in (-2, -1, 0, 1, 2) if shifts else (0,):
            at = start + shift
            pieces.append(F.when((at >= 0) & (width > 0) & (at + width <= F.length(word)), F.struct(length.alias("len"), F.lit(i).alias("part"), F.substring(word, at + 1, width).alias("piece"))))
    return F.filter(F.array(*pieces), lambda x: x.isNotNull())


#: Longer words meet by segments, others by deletions.
LONG = 16


def suggestions(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """For each unknown token the nearest word: token, suggestion. lexicon: word, rank.

    One edit before two; then shorter words, then rank. Words of up to LONG letters meet by forms with up to two letters left out, longer ones by a segment that two words
    within two edits must share: equality joins both, and the distance is taken of these pairs alone. A token of any length has at most some 170 keys."""
    unknown = tokens.select(F.lower("token").alias("token")).where("token <> ''").distinct().join(lexicon.select(F.col("word").alias("token")), "token", "left_anti")
    words = lexicon.where("word <> ''").select("word", "rank")
    short = unknown.where(F.length("token") <= LONG + 2).withColumn("k", F.explode(_deletions(F.col("token")))).join(words.where(F.length("word") <= LONG).withColumn("k", F.explode(_deletions(F.col("word")))), "k")
    lengths = F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2))
    long = unknown.where(F.length("token") >= LONG - 1).withColumn("len", lengths).where(F.col("len") > LONG).withColumn("k", F.explode(_keys(F.col("token"), F.col("len"), True))).drop("len")
    long = long.join(words.where(F.length("word") > LONG).withColumn("k", F.explode(_keys(F.col("word"), F.length("word"), False))), "k")
    pairs = short.select("token", "word", "rank").unionByName(long.select("token", "word", "rank"))
    near = pairs.distinct().withColumn("d", F.levenshtein("token", "word", 2)).where("d BETWEEN 1 AND 2")
    return near.groupBy("token").agg(F.min_by("word", F.struct("d", F.length("word").alias("len"), "rank", "word")).alias("suggestion"))


def _deletions(c: Column) -> Column:
    """A word of a few letters with up to two of them left out."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = less(c)
    two = F.flatten(F.transform(F.filter(one, lambda x: x != ""), less))
    return F.array_distinct(F.concat(F.array(c), one, two))


def lexicon_flags(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Flags of tokens that are no words but near one: doc_id, idx, type, text, message, one for each word of a document, where it stands first. tokens: as prose_tokens gives them."""
    near = suggestions(tokens.select("token"), lexicon)
    first = tokens.groupBy("doc_id", "token").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    hit = first.join(near.withColumnRenamed("token", "_t"), F.lower("token") == F.col("_t"))
    message = F.concat(F.lit('"'), F.col("token"), F.lit('" is not a recognised word — it may be "'), F.col("suggestion"), F.lit('"'))
    return hit.select("doc_id", F.col("at.line_no").alias("idx"), F.lit("not-a-word").alias("type"), F.col("token").alias("text"), message.alias("message"))


def contained(texts: DataFrame, needles: DataFrame, most: int = 200_000) -> DataFrame:
    """key, item of every text (key, text) and needle (item, needle) that it holds, whole and as written. Empty needles are in every text that isn't null.

    Up to `most` characters of needles one automaton goes to each task and every text is read once. Beyond, needles are dealt in groups of that size and
    each group goes over the texts: more passes, but no join of texts with words."""
    sized = needles.where("needle IS NOT NULL").select("item", "needle")
    total = sized.agg(F.sum(F.length("needle"))).first()[0] or 0
    if not total:
        return texts.where("text IS NOT NULL").join(F.broadcast(sized), F.lit(True)).select("key", "item")
    groups = 1 + total // most
    found = None
    for g in range(groups):
        mine = sized.where(F.pmod(F.xxhash64("needle"), F.lit(groups)) == g) if groups > 1 else sized
        rows = [(r["item"], r["needle"]) for r in mine.collect()]  # a bounded list: `most` characters, about
        one = _scan(texts, rows, needles.schema["item"].dataType.simpleString())
        found = one if found is None else found.unionByName(one)
    return found


def _scan(texts: DataFrame, needles: list[tuple], item_type: str) -> DataFrame:
    by: dict[str, list] = {}
    for item, needle in needles:
        by.setdefault(needle, []).append(item)
    known = texts.sparkSession.sparkContext.broadcast(by)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = known.value
        automaton = None
        if any(by):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle in by:
                if needle:
                    automaton.add_word(needle, needle)
            automaton.make_automaton()
        for b in batches:
            at, items = [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                seen = {""} if "" in by else set()
                if automaton is not None:
                    seen.update(n for _, n in automaton.iter(text))
                for needle in seen:
                    items += by[needle]
                    at += [i] * len(by[needle])
            if at:
                yield pa.RecordBatch.from_pydict({"key": b.column(0).take(pa.array(at)), "item": pa.array(items, kinds[item_type])})

    key = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(run, f"key {key}, item {item_type}")
