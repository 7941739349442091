"""Documents (sources.files.DOCUMENT) as Markdown, HTML, plain text and JSON: Column expressions over the block array, so a format is one more projection of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options

SCHEMA_ID = "parchmint.document/v1"
GLYPH = "⚠"
# Formats with their extension and type, and the keys of front matter with the metadata that they show, in order.
FORMATS = {"md": "text/markdown", "html": "text/html", "txt": "text/plain", "json": "application/json"}
FRONT_MATTER = [
    ("title", "title"), ("source", "source"), ("author", "author"), ("created", "created"), ("converted", "converted"), ("source_format", "kind"), ("pages", "pages"), ("slides", "slides"), ("sheets", "sheets"),
    ("chapters", "chapters"), ("language", "language"), ("producer", "producer"), ("creator", "creator"), ("ocr", "ocr"), ("ocr_pages", "ocrPages"), ("ocr_dpi", "ocrDpi"), ("ocr_confidence_mean", "ocrConfidenceMean"),
    ("ocr_confidence_min", "ocrConfidenceMin"), ("ocr_flagged_fields", "ocrFlaggedFields"), ("ocr_unreadable_regions", "ocrUnreadableRegions"), ("table_fallback", "tablesUnresolved"), ("needs_review", "needsReview"),
    ("review_flags", "reviewFlags"), ("generator", "generator"),
]


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# ---------------------------------------------------------------- Markdown


def _numbered(b: Column, marker: str) -> Column:
    """Lines of a list: each item indented by the width of the markers above it; ordered items count within their level."""
    width = F.when(b["ordered"], 3).otherwise(2)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<int>").alias("counts"))

    def step(a, x):
        upper = F.slice(a["counts"], 1, x["level"])
        upper = F.concat(upper, F.array_repeat(F.lit(0), F.greatest(x["level"] - F.size(upper), F.lit(0))))
        n = F.coalesce(F.get(a["counts"], x["level"]), F.lit(0)) + 1
        indent = F.repeat(F.lit(" "), x["level"] * width)
        prefix = F.when(b["ordered"], F.concat(n.cast("string"), F.lit(". "))).otherwise(F.lit(f"{marker} "))
        body = F.replace(x["markdown"], F.lit("\n"), F.concat(F.lit("\n"), indent, F.lit("  ")))
        return F.struct(F.concat(a["out"], F.array(F.concat(indent, prefix, body))).alias("out"), F.concat(upper, F.array(n)).alias("counts"))

    return F.array_join(F.aggregate(b["items"], start, step, lambda a: a["out"]), "\n")


def table_html(b: Column) -> Column:
    """A table as markup, every cell escaped; line breaks of a cell are elements."""
    cell = lambda c, tag: F.concat(F.lit(f"<{tag}>"), _inline_html(c), F.lit(f"</{tag}>"))
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: cell(c, tag)), ""), F.lit("</tr>"))
    headed = F.coalesce(F.size(b["header"]) > 0, F.lit(False))
    head = F.when(headed, F.concat(F.lit("<thead>"), row(F.get(b["cells"], F.lit(0)), "th"), F.lit("</thead>"))).otherwise("")
    body = F.when(headed, F.slice(b["cells"], 2, F.greatest(F.size(b["cells"]), F.lit(1)))).otherwise(b["cells"])
    return F.concat(F.lit("<table>"), head, F.lit("<tbody>"), F.array_join(F.transform(body, lambda r: row(r, "td")), ""), F.lit("</tbody></table>"))


def table_markdown(b: Column, flavor: str = "gfm") -> Column:
    """A table with a header as a pipe table, rows filled up to its width; one without a header as markup. Plain flavour knows no tables: a line for each row."""
    if flavor == "commonmark":
        return F.array_join(F.transform(b["cells"], lambda r: F.array_join(r, " ")), "  \n")
    width = F.array_max(F.transform(b["cells"], F.size))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(padded(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(b["cells"], 2, F.greatest(F.size(b["cells"]), F.lit(1))), line)
    pipes = F.array_join(F.concat(F.array(line(F.get(b["cells"], F.lit(0))), rule), body), "\n")
    return F.when(F.coalesce(F.size(b["header"]) > 0, F.lit(False)), pipes).otherwise(table_html(b))


def block_markdown(b: Column, opts: Options = Options()) -> Column:
    """One block as Markdown; null where nothing is shown."""
    md, level = b["markdown"], F.coalesce(b["level"], F.lit(1))
    atx = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), md)
    if opts.headingStyle == "setext":
        atx = F.when(level > 2, atx).otherwise(F.concat(md, F.lit("\n"), F.repeat(F.when(level == 1, "=").otherwise("-"), F.greatest(F.length(md), F.lit(3)))))
    fenced = T.fence(b["text"], F.coalesce(b["language"], F.lit("")))
    if opts.codeBlockStyle == "indented":
        fenced = F.array_join(F.transform(_lines(b["text"]), lambda x: F.concat(F.lit("    "), x)), "\n")
    quoted = F.array_join(F.transform(_lines(md), lambda x: F.rtrim(F.concat(F.lit("> "), x))), "\n")
    page = {"none": _none(), "rule": F.lit("---")}.get(opts.pageMarkers, F.concat(F.lit("<!-- page "), b["page"].cast("string"), F.lit(" -->")))
    image = F.when(F.coalesce(b["src"], F.lit("")) != "", F.concat(F.lit("!["), F.regexp_replace(F.coalesce(b["alt"], F.lit("")), r"[\[\]]", ""), F.lit("]("), b["src"], F.lit(")")))
    return (
        F.when(b["type"] == "heading", atx).when(b["type"] == "paragraph", md).when(b["type"] == "list", _numbered(b, opts.bulletMarker))
        .when(b["type"] == "table", table_markdown(b, opts.mdFlavor)).when(b["type"] == "code", fenced).when(b["type"] == "quote", quoted)
        .when(b["type"] == "divider", "---").when(b["type"] == "page", page).when(b["type"] == "image", image)
    )


def front_matter(meta: Column, low_confidence: Column | None = None) -> Column:
    """YAML front matter of a metadata map, empty values left out; empty if nothing is left.

    low_confidence: array of (text, confidence, page), the words that a reader should check."""
    value = lambda key: F.nullif(meta[key], F.lit(""))
    seen = {name: value(key) for name, key in FRONT_MATTER}
    seen["ocr"] = F.coalesce(seen["ocr"], F.when(F.coalesce(value("ocrPages"), F.lit("0")) != "0", "true"))
    for name in ("ocr_pages", "table_fallback"):
        seen[name] = F.nullif(seen[name], F.lit("0"))
    lines = F.filter(F.array(*[F.concat(F.lit(f"{name}: "), T.yaml_scalar(v)) for name, v in seen.items()]), lambda x: x.isNotNull())
    if low_confidence is not None:
        words = F.transform(low_confidence, lambda w: F.concat(F.lit("  - text: "), T.yaml_scalar(w["text"]), F.lit("\n    confidence: "), w["confidence"].cast("string"), F.lit("\n    page: "), w["page"].cast("string")))
        lines = F.concat(lines, F.when(F.coalesce(F.size(low_confidence), F.lit(0)) > 0, F.concat(F.array(F.lit("ocr_low_confidence:")), words)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(lines) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"))).otherwise("")


def _referenced(body: Column) -> Column:
    """Links as references: [text][n], the addresses at the end in the order of their first use."""
    pattern = F.lit(r"(?<!!)\[(?:[^\]\\]|\\.)*\]\([^)\s]+(?: \"[^\"]*\")?\)")
    found = F.array_distinct(F.regexp_extract_all(body, pattern, F.lit(0)))
    start = F.struct(body.alias("text"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("refs"))

    def step(a, x):
        n = a["n"] + 1
        shown, target = F.regexp_extract(x, r"^(\[.*\])\((.*)\)$", 1), F.regexp_extract(x, r"^(\[.*\])\((.*)\)$", 2)
        return F.struct(F.replace(a["text"], x, F.concat(shown, F.lit("["), n.cast("string"), F.lit("]"))).alias("text"), n.alias("n"), F.concat(a["refs"], F.array(F.concat(F.lit("["), n.cast("string"), F.lit("]: "), target))).alias("refs"))

    return F.aggregate(found, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["text"], F.lit("\n\n"), F.array_join(a["refs"], "\n"))).otherwise(a["text"]))


def wrapped(body: Column, width: int) -> Column:
    """Prose broken at `width`; fences, table rows and indented lines stay whole. The lines after the first of an item are indented as its text is."""
    texts = lambda *c: F.array(*c) if c else F.array().cast("array<string>")

    def line(a, x):
        fenced = a["fenced"] != x.rlike(r"^\s*(```|~~~)")
        lead = F.regexp_extract(x, r"^(\s*(?:[-*+]\s+|[0-9]+\.\s+)?)", 1)
        start = F.struct(texts().alias("out"), lead.alias("now"), F.lit(True).alias("empty"))

        def word(b, w):
            full = ~b["empty"] & (F.length(b["now"]) + F.length(w) + 1 > width)
            more = F.concat(b["now"], F.when(b["empty"], "").otherwise(" "), w)
            return F.struct(F.when(full, F.concat(b["out"], texts(b["now"]))).otherwise(b["out"]).alias("out"), F.when(full, F.concat(F.repeat(F.lit(" "), F.length(lead)), w)).otherwise(more).alias("now"), F.lit(False).alias("empty"))

        broken = F.aggregate(F.split(F.substring(x, F.length(lead) + 1, F.length(x)), r"\s+"), start, word, lambda b: F.concat(b["out"], texts(b["now"])))
        whole = fenced | (F.length(x) <= width) | x.rlike(r"^\s*\||^\s{4,}\S")
        return F.struct(F.concat(a["out"], F.when(whole, texts(x)).otherwise(broken)).alias("out"), fenced.alias("fenced"))

    return F.array_join(F.aggregate(F.split(body, "\n"), F.struct(texts().alias("out"), F.lit(False).alias("fenced")), line, lambda a: a["out"]), "\n")


def markdown(opts: Options = Options()) -> Column:
    """Markdown of a document's row: front matter and blocks. Markdown that the reader hands through stays as it is. Flags of column `review`, if `reviewMarkers`, stand as comments behind their block."""
    blocks = F.col("blocks")
    shown = F.transform(blocks, lambda b: block_markdown(b, opts))
    body = F.array_join(F.filter(shown, lambda x: x.isNotNull() & (x != "")), "\n\n")
    body = T.trimmed(F.regexp_replace(F.regexp_replace(body, "\n{3,}", "\n\n"), "(?m)(?<! )[ \t]$", ""))
    if opts.linkStyle == "referenced":
        body = _referenced(body)
    if opts.wrap > 0:
        body = wrapped(body, opts.wrap)
    body = F.when(F.col("native").isNotNull(), T.trimmed(F.col("native"))).otherwise(body)
    head = front_matter(F.col("meta")) if opts.frontMatter else F.lit("")
    return F.when(F.col("error").isNull(), F.concat(head, body, F.lit("\n")))


def with_review(docs: DataFrame, flags: DataFrame, opts: Options = Options(), key: str = "name") -> DataFrame:
    """`docs` with `review` (array of type, message, context, at most 120 characters) from `flags` (key, idx, type, text, message), needsReview and reviewFlags in the metadata, and a comment behind each flagged block. Values stay as they are."""
    short = flags.select(F.col(key), "idx", F.struct("type", "message", F.substring(T.collapsed(F.col("text")), 1, 120).alias("context")).alias("flag"))
    per = short.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "flag"))), lambda x: F.struct(x["idx"].alias("idx"), x["flag"]["type"].alias("type"), x["flag"]["message"].alias("message"), x["flag"]["context"].alias("context"))).alias("review"))
    joined = docs.join(per, key, "left").withColumn("review", F.coalesce("review", F.array().cast(per.schema["review"].dataType)))
    more = F.when(F.size("review") > 0, F.create_map(F.lit("needsReview"), F.lit("true"), F.lit("reviewFlags"), F.size("review").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    joined = joined.withColumn("meta", F.map_concat(F.map_filter("meta", lambda k, v: ~k.isin("needsReview", "reviewFlags")), more))
    if not opts.reviewMarkers:
        return joined

    def marked(b):
        mine = F.transform(F.filter("review", lambda r: r["idx"] == b["idx"]), lambda r: F.concat(F.lit(f" {GLYPH} <!-- REVIEW: "), F.replace(r["message"], F.lit("--"), F.lit("- -")), F.lit(" -->")))
        return b.withField("markdown", F.concat(b["markdown"], F.array_join(mine, "")))

    return joined.withColumn("blocks", F.transform("blocks", marked))


# ---------------------------------------------------------------- HTML


def _inline_html(md: Column) -> Column:
    """Inline Markdown, as the readers write it, as markup."""
    c = md
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    c = F.regexp_replace(c, r"&lt;(/?(?:u|sub|sup|br))&gt;", "<$1>")
    c = F.regexp_replace(c, r"&lt;!-- REVIEW: (.*?) --&gt;", r'<span data-review="$1" title="$1"></span>')
    c = F.regexp_replace(c, r"&lt;((?:https?|mailto):[^&]*(?:&amp;[^&]*)*)&gt;", r'<a href="$1">$1</a>')
    c = F.regexp_replace(c, r"(?<!\\)!\[([^\]]*)\]\(([^)\s]+)(?: &quot;.*?&quot;)?\)", r'<img src="$2" alt="$1">')
    c = F.regexp_replace(c, r"(?<!\\)\[((?:[^\]\\]|\\.)*)\]\(([^)\s]+)(?: &quot;(.*?)&quot;)?\)", r'<a href="$2">$1</a>')
    c = F.regexp_replace(c, r"(?<!\\)`+ ?(.+?) ?`+", r"<code>$1</code>")
    for mark, tag in ((r"\*\*", "strong"), ("~~", "s"), ("==", "mark"), ("_", "em")):
        edge = (r"(?<![\\\w])", r"(?!\w)") if mark == "_" else (r"(?<!\\)", "")
        c = F.regexp_replace(c, rf"{edge[0]}{mark}(?=\S)(.+?)(?<=[^\s\\]){mark}{edge[1]}", f"<{tag}>$1</{tag}>")
    c = F.replace(c, F.lit("  \n"), F.lit("<br>"))
    return F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+\-.!|>])", "$1")


def nested_list_html(b: Column) -> Column:
    """A list as markup: a sublist stands inside the item before it."""
    tag = F.when(b["ordered"], "ol").otherwise("ul")
    start = F.struct(F.lit("").alias("out"), F.lit(-1).alias("depth"))
    opened, closed = F.concat(F.lit("<"), tag, F.lit(">")), F.concat(F.lit("</li></"), tag, F.lit(">"))

    def step(a, x):
        deeper, shallower = F.greatest(x["level"] - a["depth"], F.lit(0)), F.greatest(a["depth"] - x["level"], F.lit(0))
        before = F.concat(F.repeat(closed, shallower), F.when((a["depth"] >= 0) & (deeper == 0), "</li>").otherwise(""), F.repeat(opened, deeper))
        return F.struct(F.concat(a["out"], before, F.lit("<li>"), _inline_html(x["markdown"])).alias("out"), x["level"].alias("depth"))

    return F.aggregate(b["items"], start, step, lambda a: F.concat(a["out"], F.repeat(closed, a["depth"] + 1)))


def block_html(b: Column) -> Column:
    inner, level = _inline_html(b["markdown"]), F.coalesce(b["level"], F.lit(1)).cast("string")
    fence = F.concat(F.lit("<pre><code"), F.coalesce(F.concat(F.lit(' class="language-'), T.escape_html(b["language"]), F.lit('"')), F.lit("")), F.lit(">"), T.escape_html(b["text"]), F.lit("</code></pre>"))
    role = F.coalesce(F.concat(F.lit(' data-role="'), T.escape_html(b["role"]), F.lit('"')), F.lit(""))
    return (
        F.when(b["type"] == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inner, F.lit("</h"), level, F.lit(">")))
        .when(b["type"] == "paragraph", F.concat(F.lit("<p>"), inner, F.lit("</p>")))
        .when(b["type"] == "list", nested_list_html(b)).when(b["type"] == "table", table_html(b)).when(b["type"] == "code", fence)
        .when(b["type"] == "quote", F.concat(F.lit("<blockquote"), role, F.lit("><p>"), F.replace(inner, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></blockquote>")))
        .when(b["type"] == "divider", "<hr>").when(b["type"] == "page", F.concat(F.lit('<hr data-page="'), b["page"].cast("string"), F.lit('">')))
        .when(b["type"] == "image", F.concat(F.lit('<p><img src="'), T.escape_html(F.coalesce(b["src"], F.lit(""))), F.lit('" alt="'), T.escape_html(F.coalesce(b["alt"], F.lit(""))), F.lit('"></p>')))
    )


def fragment() -> Column:
    """The blocks of a document's row as markup."""
    return F.array_join(F.filter(F.transform("blocks", block_html), lambda x: x.isNotNull()), "\n")


STYLE = "body{max-width:46rem;margin:auto;padding:2rem 1rem;font:16px/1.6 sans-serif}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:.3em .6em;text-align:left}pre{overflow-x:auto;background:#f5f5f5;padding:1em}.about{color:#666;font-size:.85em}"


def html() -> Column:
    """A document's row as a page that stands alone: title, a line about the file, the blocks."""
    m = F.col("meta")
    title = F.coalesce(F.nullif(m["title"], F.lit("")), F.nullif(m["name"], F.lit("")), F.lit("Converted document"))
    about = F.array_join(F.filter(F.array(F.concat(F.lit("by "), m["author"]), F.concat(F.lit("from "), F.upper(m["kind"])), F.concat(m["pages"], F.lit(" pages")), F.concat(F.lit("converted "), F.substring(m["converted"], 1, 10))), lambda x: x.isNotNull()), " · ")
    line = lambda start, value, end: F.coalesce(F.concat(F.lit(start), T.escape_html(value), F.lit(end)), F.lit(""))
    page = F.concat(
        F.lit('<!doctype html>\n<html lang="'), T.escape_html(F.coalesce(m["language"], F.lit("en"))), F.lit('">\n<head>\n<meta charset="utf-8">\n<title>'), T.escape_html(title), F.lit("</title>\n"),
        line('<meta name="generator" content="', m["generator"], '">\n'), line('<link rel="canonical" href="', m["source"], '">\n'), line('<meta name="author" content="', m["author"], '">\n'),
        F.lit(f"<style>{STYLE}</style>\n</head>\n<body>\n"), F.when(about != "", F.concat(F.lit('<p class="about">'), T.escape_html(about), F.lit("</p>\n"))).otherwise(""), fragment(), F.lit("\n</body>\n</html>\n"),
    )
    return F.when(F.col("error").isNull(), page)


# ---------------------------------------------------------------- plain text


def table_text(b: Column, widest: int = 40) -> Column:
    """Rows of a table with columns padded to their longest cell, up to `widest` characters."""
    rows = F.concat(F.when(F.size(b["header"]) > 0, F.array(b["header"])).otherwise(F.array().cast("array<array<string>>")), b["rows"])
    columns = F.sequence(F.lit(0), F.greatest(F.array_max(F.transform(rows, F.size)) - 1, F.lit(0)))
    widths = F.transform(columns, lambda i: F.least(F.lit(widest), F.array_max(F.transform(rows, lambda r: F.length(F.coalesce(F.get(r, i), F.lit("")))))))
    padded = lambda r: F.transform(r, lambda c, i: F.rpad(c, F.greatest(F.length(c), F.get(widths, i)), " "))
    return F.array_join(F.transform(rows, lambda r: F.rtrim(F.array_join(padded(r), "  "))), "\n")


def block_text(b: Column) -> Column:
    items = F.array_join(F.transform(b["items"], lambda x: F.concat(F.repeat(F.lit("  "), x["level"]), F.lit("- "), x["text"])), "\n")
    image = F.when(F.coalesce(b["alt"], F.lit("")) != "", F.concat(F.lit("[image: "), b["alt"], F.lit("]")))
    return (
        F.when(b["type"].isin("heading", "paragraph", "quote", "code"), b["text"]).when(b["type"] == "list", items).when(b["type"] == "table", table_text(b))
        .when(b["type"].isin("divider", "page"), "----------").when(b["type"] == "image", image)
    )


def plain_text() -> Column:
    body = F.array_join(F.filter(F.transform("blocks", block_text), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return F.when(F.col("error").isNull(), F.concat(T.trimmed(F.regexp_replace(F.regexp_replace(body, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")), F.lit("\n")))


# ---------------------------------------------------------------- JSON


def records(header: Column, rows: Column) -> Column:
    """A map for each row of a table; an unnamed column is column_<n>, of equal names the last holds."""
    named = F.transform(header, lambda h, i: F.when(h == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h))
    last = F.filter(F.sequence(F.lit(0), F.size(header) - 1), lambda i: F.array_position(F.slice(named, i + 2, F.size(header)), F.get(named, i)) == 0)
    return F.when(F.size(header) > 0, F.transform(rows, lambda r: F.map_from_arrays(F.transform(last, lambda i: F.get(named, i)), F.transform(last, lambda i: F.coalesce(F.get(r, i), F.lit(""))))))


def stats() -> Column:
    """Blocks, words and characters of a document's row, its size and the estimate of tokens."""
    shown = F.filter("blocks", lambda b: b["type"] != "page")
    total = lambda f: F.aggregate(shown, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(f(b["text"]), F.lit(0)))
    characters = F.length(T.collapsed(F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), " ")))
    return F.struct(
        F.size(shown).alias("blocks"), total(lambda t: F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")).alias("words"), total(lambda t: F.length(t).cast("long")).alias("characters"),
        F.col("source_bytes").alias("source_bytes"), T.tokens_estimate(characters).alias("estimated_tokens"), F.lit("characters/4").alias("token_estimate"),
    )


def json_document(opts: Options = Options(), review: Column | None = None) -> Column:
    """A document's row as JSON: metadata, flags, stats, and blocks with text and Markdown."""
    shown = F.filter("blocks", lambda b: b["type"] != "page")

    def block(b, i):
        return F.struct(
            i.alias("index"), b["page"].alias("page"), b["type"].alias("type"), F.when(b["type"] == "heading", b["level"]).alias("level"), F.when(b["type"] == "list", b["ordered"]).alias("ordered"), b["language"].alias("language"),
            b["role"].alias("role"), b["src"].alias("src"), b["alt"].alias("alt"), F.transform(b["items"], lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"))).alias("items"),
            b["header"].alias("header"), b["rows"].alias("rows"), records(b["header"], b["rows"]).alias("records"), b["text"].alias("text"), block_markdown(b, opts).alias("markdown"),
        )

    flags = review if review is not None else F.array().cast("array<struct<type:string,message:string,context:string>>")
    whole = F.struct(F.lit(SCHEMA_ID).alias("schema"), F.map_filter("meta", lambda k, v: v.isNotNull() & (v != "")).alias("metadata"), flags.alias("review"), stats().alias("stats"), F.transform(shown, block).alias("blocks"))
    return F.when(F.col("error").isNull(), F.concat(F.to_json(whole), F.lit("\n")))


# ---------------------------------------------------------------- all formats


def _json(docs: DataFrame, opts: Options) -> Column:
    flags = F.transform("review", lambda r: F.struct(r["type"].alias("type"), r["message"].alias("message"), r["context"].alias("context"))) if "review" in docs.columns else None
    return json_document(opts, flags)


#: Format -> (type, column of a document's row). Add an entry to add a format.
EMITTERS: dict[str, tuple[str, Callable[[DataFrame, Options], Column]]] = {
    "md": (FORMATS["md"], lambda docs, opts: markdown(opts)),
    "html": (FORMATS["html"], lambda docs, opts: html()),
    "txt": (FORMATS["txt"], lambda docs, opts: plain_text()),
    "json": (FORMATS["json"], _json),
}


def render(docs: DataFrame, fmt: str, opts: Options = Options()) -> DataFrame:
    """`docs` with filename, mime, content and bytes in one format. Any format can be had later from the same stored documents."""
    mime, content = EMITTERS[fmt]
    stem = F.regexp_replace(F.regexp_replace(F.coalesce("name", F.lit("document")), r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")
    named = docs.select("*", F.lit(fmt).alias("format"), F.concat(T.safe_file_name(stem), F.lit(f".{fmt}")).alias("filename"), F.lit(mime).alias("mime"), content(docs, opts).alias("content"))
    return named.withColumn("bytes", F.octet_length("content").cast("long"))


def outputs(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """A row for each document and requested format: name, format, filename, mime, content, bytes."""
    found = None
    for fmt in opts.outputs or ("md",):
        one = render(docs, fmt, opts).select("name", "format", "filename", "mime", "content", "bytes")
        found = one if found is None else found.unionByName(one)
    return found


def unique_names(files: DataFrame, name: str = "filename", order: list[str] | None = None, rounds: int = 20) -> DataFrame:
    """`files` with `name` made unique: the first keeps it, others get -2, -3, ... before the extension, passing over names that are taken. Raises if `rounds` passes don't settle it."""
    order = order or [name]
    first = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    df = files.withColumn("_n", first).withColumn("_base", F.col(name))
    numbered = F.concat(F.regexp_replace("_base", r"(\.[A-Za-z0-9]+)$", ""), F.lit("-"), F.col("_n").cast("string"), F.regexp_extract("_base", r"(\.[A-Za-z0-9]+)$", 1))
    df = df.withColumn("_new", F.when(F.col("_n") == 1, F.col(name)).otherwise(numbered))
    for _ in range(rounds):
        clash = F.row_number().over(Window.partitionBy("_new").orderBy("_n", *order))
        df = df.withColumn("_clash", clash)
        if df.where("_clash > 1").isEmpty():
            return df.withColumn(name, F.col("_new")).drop("_n", "_base", "_new", "_clash")
        df = df.withColumn("_n", F.when(F.col("_clash") > 1, F.col("_n") + 1).otherwise(F.col("_n"))).withColumn("_new", F.when(F.col("_n") == 1, F.col("_new")).otherwise(numbered)).drop("_clash")
    raise RuntimeError(f"file names are not unique after {rounds} rounds")


def write(rendered: DataFrame, path: str) -> None:
    """Outputs as Parquet, a folder for each format."""
    rendered.write.partitionBy("format").parquet(path)
