"""Files of every format made of the driver's rows and read back, and documents emitted: each beside SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import emit as E
from ..operators import layout as L
from ..options import Options
from ..sources import files as FS
from ..sources import tree
from ..storage import stored
from . import fixtures as X
from .catalogue import _LINES, PARAGRAPHS, _collapse, user_cues
from .registry import query, table

PLAIN = Options(repairStructure=False)


def _read(files, opts=PLAIN):
    return FS.read(FS.detected(files), opts)


def _blocks(files, key, opts=PLAIN):
    return FS.blocks(_read(files, opts), "key").withColumn("key", F.col("key").cast(key))


_TEXTS = f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS idx, text FROM (SELECT doc_id, line_no, {_collapse('text')} AS text FROM ({_LINES})) WHERE text <> ''"
_TURNS = f"SELECT conv_id, turn, role, n, text FROM (SELECT conv_id, turn, role, n, {_collapse('parts[n]')} AS text FROM (SELECT conv_id, turn, role, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations))) WHERE text <> ''"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------- office


def _workbook(rows):
    head = ["Order", "Date", "Price", "Priority"]
    return X.xlsx({"Orders": [[None] * 5, [None, *head], *[[None, key, (float(day), 1), price, priority] for key, day, price, priority in rows]], "Blank": []})


@query("""SELECT o_custkey AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row, CAST(o_orderkey AS VARCHAR) AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS day, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS price, o_orderpriority AS priority FROM orders""")
def file_workbook_cells(spark, sf_dir):
    """A workbook for each customer: shared strings, dates by their style, an empty row and column before the table."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")))
    b = _blocks(X.files(o, "o_custkey", "xlsx", _workbook, "o_orderkey", "day", "o_totalprice", "o_orderpriority", order=["o_orderkey"]), "long").where("type = 'table'")
    e = b.select("key", F.posexplode("rows").alias("n", "r"))
    return e.select("key", (F.col("n") + 1).alias("row"), *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(("order_key", "day", "price", "priority"))])


@query(_TEXTS)
def file_word_paragraphs(spark, sf_dir):
    """Every document as a text document with a paragraph for each line."""
    d = table(spark, sf_dir, "documents")
    build = lambda rows: X.docx([("", line) for line in (rows[0][0] or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")])
    return _blocks(X.files(d, "doc_id", "docx", build, "text"), "long").select(F.col("key").alias("doc_id"), "idx", "text")


@query(f"""SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS INTEGER) AS idx, type, level, text FROM (SELECT conv_id, turn, n, 'paragraph' AS type, CAST(NULL AS INTEGER) AS level, text FROM ({_TURNS}) UNION ALL SELECT conv_id, turn, 0, 'heading', 2, role || ' ' || turn FROM conversations)""")
def file_open_document(spark, sf_dir):
    """A text document for each conversation: a heading for each turn, its lines as paragraphs."""
    build = lambda rows: X.odt([p for turn, role, text in rows for p in ((2, f"{role} {turn}"), *((0, x) for x in text.split("\n")))])
    return _blocks(X.files(_turns(spark, sf_dir), "conv_id", "odt", build, "turn", "role", "text", order=["turn"]), "long").select("key", "idx", "type", "level", "text")


@query(f"""WITH b AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY n) AS text FROM ({_TURNS}) GROUP BY 1, 2)
SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS INTEGER) AS idx, type, text FROM (SELECT conv_id, turn, 0 AS k, 'heading' AS type, role AS text FROM conversations UNION ALL SELECT conv_id, turn, 1, 'list', text FROM b UNION ALL SELECT conv_id, turn, 2, 'quote', 'Speaker notes turn ' || turn FROM conversations)""")
def file_slides(spark, sf_dir):
    """A deck for each conversation: a slide for each turn, its lines as bullets, notes beside it."""
    build = lambda rows: X.pptx([(role, text.split("\n"), f"turn {turn}") for turn, role, text in rows])
    return _blocks(X.files(_turns(spark, sf_dir), "conv_id", "pptx", build, "turn", "role", "text", order=["turn"]), "long").select("key", "idx", "type", "text")


@query("""SELECT c_nationkey AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS row, c_name AS name, c_mktsegment AS segment FROM customer""")
def file_open_sheet(spark, sf_dir):
    """A sheet for each nation's customers, followed by a thousand blank rows that are one element."""
    build = lambda rows: X.ods({"Customers": [["Name", "Segment"], *map(list, rows)]})
    b = _blocks(X.files(table(spark, sf_dir, "customer"), "c_nationkey", "ods", build, "c_name", "c_mktsegment", order=["c_custkey"]), "int", PLAIN.but(maxSheetRows=10_000_000)).where("type = 'table'")
    return b.select("key", F.posexplode("rows").alias("n", "r")).select("key", (F.col("n") + 1).alias("row"), F.get("r", F.lit(0)).alias("name"), F.get("r", F.lit(1)).alias("segment"))


@query(f"""WITH p AS (SELECT conv_id, turn, n, 'paragraph' AS type, text FROM ({_TURNS}) UNION ALL SELECT conv_id, turn, -1, 'divider', '' FROM conversations WHERE turn > 0 UNION ALL SELECT DISTINCT conv_id, -1, 0, 'heading', 'Conversation ' || conv_id FROM conversations)
SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS INTEGER) AS idx, type, text FROM p""")
def file_books(spark, sf_dir):
    """A book for each conversation: a chapter for each turn, the manifest in the other order."""
    build = lambda rows: X.epub(f"Conversation {rows[0][0]}", ["".join(f"<p>{X.xml_text(x)}</p>" for x in text.split("\n")) for _, text in rows])
    return _blocks(X.files(_turns(spark, sf_dir), "conv_id", "epub", build, "conv_id", "text", order=["turn"]), "long").select("key", "idx", "type", "text")


# ---------------------------------------------------------------- mail, notebooks, records


@query(f"""SELECT conv_id, turn, role || ' é ' || turn AS title, role || '@example.org' AS author, (SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT unnest(range(1, len(p) + 1)) AS i, {_collapse("unnest(p)")} AS t) WHERE t <> '') AS text FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS p FROM conversations)""")
def file_mail(spark, sf_dir):
    """Every turn as a message: encoded subject, body in base64 or quoted-printable."""
    c = _turns(spark, sf_dir).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    build = lambda rows: X.eml(f"{rows[0][1]} é {rows[0][0]}", f"{rows[0][1]}@example.org", rows[0][2], "base64" if rows[0][0] % 2 else "quoted-printable")
    d = _read(X.files(c, "id", "eml", build, "turn", "role", "text"))
    body = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "paragraph"), lambda b: b["text"]), " ")
    part = lambda i: F.get(F.split("key", "-"), F.lit(i)).cast("long")
    return d.select(part(0).alias("conv_id"), part(1).cast(c.schema["turn"].dataType).alias("turn"), F.col("meta")["title"].alias("title"), F.col("meta")["author"].alias("author"), F.nullif(body, F.lit("")).alias("text"))


@query(f"""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS INTEGER) AS idx, text FROM ({_TURNS})""")
def file_rich_text(spark, sf_dir):
    """Every turn as rich text; letters beyond ASCII are control words."""
    c = _turns(spark, sf_dir).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    d = _blocks(X.files(c, "id", "rtf", lambda rows: X.rtf(rows[0][0].split("\n")), "text"), "string")
    part = lambda i: F.get(F.split("key", "-"), F.lit(i)).cast("long")
    return d.select(part(0).alias("conv_id"), part(1).cast(c.schema["turn"].dataType).alias("turn"), "idx", "text")


@query("""SELECT conv_id AS key, string_agg(CASE WHEN role = 'assistant' THEN '```sql' || chr(10) || rtrim(text, chr(10) || ' ') || chr(10) || '```' ELSE trim(text, chr(10) || ' ') END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""")
def file_notebooks(spark, sf_dir):
    """A notebook for each conversation: what the assistant says is code."""
    build = lambda rows: X.notebook([("code" if role == "assistant" else "markdown", text) for role, text in rows])
    d = _read(X.files(_turns(spark, sf_dir), "conv_id", "ipynb", build, "role", "text", order=["turn"]))
    return d.select(F.col("key").cast("long").alias("key"), F.col("native").alias("markdown"))


@query(f"SELECT doc_id AS key, lpad(CAST(CAST(start AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(start AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(start AS BIGINT) % 60 AS VARCHAR), 2, '0') || CASE WHEN text = '' THEN '' ELSE ' ' || text END AS text FROM ({PARAGRAPHS})")
def file_subtitles(spark, sf_dir):
    """A subtitle file for each user's cues, read as a transcript."""
    build = lambda rows: X.srt([(start, text) for start, text in rows])
    return _blocks(X.files(user_cues(spark, sf_dir), "doc_id", "srt", build, "start", "text", order=["cue"]), "long").select("key", "text")


@query("""SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS row, CAST(event_id AS VARCHAR) AS event, event_type AS type, coalesce(json_extract_string(props, '$.k'), '') AS k
FROM events WHERE event_id % 7 <> 0 AND user_id IN (SELECT user_id FROM events WHERE event_id % 7 <> 0 GROUP BY 1 HAVING count(*) >= 2)""")
def file_json_lines(spark, sf_dir):
    """A file of JSON lines for each user; every seventh line isn't JSON and is passed over."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 0, "not json").otherwise(F.to_json(F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))))
    b = _blocks(X.files(e.withColumn("line", line), "user_id", "jsonl", lambda rows: "\n".join(r[0] for r in rows).encode(), "line", order=["event_id"]), "long", PLAIN.but(maxSheetRows=10_000_000)).where("type = 'table'")
    cells = b.select("key", "header", F.posexplode("rows").alias("n", "r"))
    at = lambda name: F.coalesce(F.get("r", (F.array_position("header", name) - 1).cast("int")), F.lit(""))
    return cells.select("key", (F.col("n") + 1).alias("row"), at("event_id").alias("event"), at("event_type").alias("type"), at("k").alias("k"))


@query("""SELECT c_nationkey AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS row, c_name || ', "' || c_mktsegment || '"' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS number FROM customer""")
def file_delimited_rows(spark, sf_dir):
    """A delimited file for each nation: quoted cells, blank rows, rows without their last cell."""
    c = table(spark, sf_dir, "customer").withColumn("name", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    build = lambda rows: "\r\n".join(["name,number", *[f'"{n.replace(chr(34), chr(34) * 2)}"' + (f",{k}\r\n," if k % 3 else "") for n, k in rows]]).encode()
    b = _blocks(X.files(c, "c_nationkey", "csv", build, "name", "c_custkey", order=["c_custkey"]), "int", PLAIN.but(maxSheetRows=10_000_000)).where("type = 'table'")
    return b.select("key", F.posexplode("rows").alias("n", "r")).select("key", (F.col("n") + 1).alias("row"), F.get("r", F.lit(0)).alias("name"), F.get("r", F.lit(1)).alias("number"))


# ---------------------------------------------------------------- archives, web


@query("""SELECT n_regionkey AS place, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS part, n_name || CASE n_nationkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.docx' ELSE '.html' END AS name, CASE n_nationkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'docx' ELSE 'html' END AS kind, 'region' || n_regionkey || '.zip' AS parent, n_name AS text FROM nation""")
def file_archives(spark, sf_dir):
    """A zip of each region's nations as three sorts of files, beside members that aren't read: system files, code, another zip. Members stand where their archive stood."""

    def build(rows):
        made = {f"__MACOSX/{rows[0][1]}.csv": b"x", "a/.DS_Store": b"x", "inner.zip": X.zipped({"x.csv": b"a"}), "run.py": b"x"}
        for key, name in rows:
            made[f"a/{name}.{('csv', 'docx', 'html')[key % 3]}"] = (name.encode(), X.docx([("", name)]), f"<p>{name}</p>".encode())[key % 3]
        return X.zipped(made)

    z = X.files(table(spark, sf_dir, "nation"), "n_regionkey", "zip", build, "n_nationkey", "n_name", order=["n_nationkey"])
    z = z.select(F.col("key").cast("long").alias("place"), F.concat(F.lit("region"), "name").alias("name"), "content", "mime", "url")
    members = FS.expanded(FS.detected(z))
    order = F.row_number().over(Window.partitionBy("place").orderBy("part")) - 1
    d = FS.read(FS.detected(members.drop("error")), Options())
    text = F.element_at(F.flatten(F.transform("blocks", lambda b: F.coalesce(F.when(b["type"] == "table", F.flatten(b["rows"])), F.array(b["text"])))), -1)
    return d.select(F.col("place").cast("int").alias("place"), order.cast("int").alias("part"), "name", "kind", "parent", text.alias("text"))


@query("SELECT page_id, url AS source, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<br>')) AS INTEGER) AS breaks FROM pages")
def file_web_archives(spark, sf_dir):
    """Every page as a saved web archive: its address, and the line breaks of its article."""
    p = table(spark, sf_dir, "pages")
    d = _read(X.files(p, "page_id", "mhtml", lambda rows: X.mhtml(*rows[0]), "html", "url"))
    # a break before the end of a paragraph is no break of its text
    breaks = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.when(b["markdown"].rlike(r"^\*\*"), 1).otherwise(0))
    return d.select(F.col("key").cast("long").alias("page_id"), F.col("meta")["source"].alias("source"), breaks.cast("int").alias("breaks"))


@query("SELECT page_id, CAST(strlen(substr(html, 1, 3000)) AS BIGINT) AS bytes, length(html) > 3000 AS truncated, CASE WHEN page_id % 5 <> 0 THEN url END AS url FROM pages")
def page_captures(spark, sf_dir):
    """Pages as a browser hands them over, cut at 3,000 characters; every fifth has an address that isn't one of the web."""
    p = table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("file:///"), "url")).otherwise(F.col("url")))
    c = FS.captured(p.withColumn("name", F.lit("page.html")), 3000)
    return c.select("page_id", F.octet_length("content").cast("long").alias("bytes"), "truncated", "url")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pasted.html' ELSE 'pasted.txt' END AS name FROM documents WHERE doc_id % 3 = 0 OR length(regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) > 40")
def pasted_clips(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("<p>x</p>")).otherwise(" ").alias("html"), "text")
    return FS.pasted(d).select("doc_id", "name")


def _described(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 2 == 0, 'name="author"').otherwise('property="article:author"')
    tags = F.concat(F.lit("<meta "), name, F.lit(' content=" Author &amp; '), F.col("page_id").cast("string"), F.lit('">'), F.when(F.col("page_id") % 3 == 0, '<meta property="og:description" content="About">').otherwise('<meta name="description" content="">'))
    return p.withColumn("html", F.replace("html", F.lit("</title>"), F.concat(F.lit("</title>"), tags)))


@query("SELECT page_id, 'Author & ' || page_id AS author, CASE WHEN page_id % 3 = 0 THEN 'About' END AS description FROM pages")
def page_metadata(spark, sf_dir):
    p = _described(spark, sf_dir).select("page_id", F.lit("x.html").alias("name"), F.col("html").cast("binary").alias("content"), F.lit("").alias("mime"), "url")
    d = FS.read(FS.detected(p), Options())
    return d.select("page_id", F.col("meta")["author"].alias("author"), F.col("meta")["description"].alias("description"))


def _sanitized(html):
    return html.map(lambda h: tree.sanitized(tree.parse(h or "")).html())


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<a href="[^"]*"')) AS INTEGER) AS marked, false AS scripts, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages""")
def page_sanitized(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select("page_id", F.pandas_udf(_sanitized, "string")("html").alias("h"))
    n = lambda p: F.regexp_count("h", F.lit(p)).cast("int")
    return s.select("page_id", n("<a ").alias("links"), n('rel="noopener noreferrer nofollow"').alias("marked"), F.col("h").rlike("(?i)<script|track[(]|<style").alias("scripts"), n("<p>").alias("paragraphs"))


@query("SELECT page_id, page_id || '_assets/image-00' || n || '.png' AS path, 'image/png' AS mime, CAST(length(CAST(page_id AS VARCHAR)) + 5 AS INTEGER) AS bytes FROM pages, (VALUES (1), (2)) v(n)")
def page_image_assets(spark, sf_dir):
    """Two embedded images of each page as files of their own; a third that is linked stays where it is."""
    src = F.concat(F.lit("data:image/png;base64,"), F.base64(F.concat(F.lit("image"), F.col("page_id").cast("string")).cast("binary")))
    html = F.concat(F.lit('<main><p>text <img alt="one" src="'), src, F.lit('"></p><figure><img src="'), src, F.lit('"></figure><p><img src="http://a/b.png">'), F.repeat(F.lit("long enough "), 30), F.lit("</p></main>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), html.cast("binary").alias("content"), F.lit("").alias("mime"), F.lit(None).cast("string").alias("url"))
    d = FS.read(FS.detected(p), Options(imageMode="extract"))
    return d.select("page_id", F.explode("assets").alias("a")).select("page_id", "a.path", "a.mime", F.length("a.content").alias("bytes"))


# ---------------------------------------------------------------- emitters


def _nations(spark, sf_dir, opts=Options()):
    n = table(spark, sf_dir, "nation").withColumn("name", F.concat("n_name", F.lit(" | <x> & y")))
    build = lambda rows: "\n".join(["key,name", *[f"{k},{v}" for k, v in rows]]).encode()
    return _read(X.files(n, "n_regionkey", "csv", build, "n_nationkey", "name", order=["n_nationkey"]), opts)


_ROW = "'| ' || n_nationkey || ' | ' || n_name || ' \\| <x> & y |'"


@query(f"SELECT CAST(n_regionkey AS VARCHAR) AS key, '---' || chr(10) || 'title: ' || n_regionkey || chr(10) || 'source_format: csv' || chr(10) || '---' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({_ROW}, chr(10) ORDER BY n_nationkey) || chr(10) AS content FROM nation GROUP BY n_regionkey")
def emit_markdown_tables(spark, sf_dir):
    return E.render(_nations(spark, sf_dir), "md").select("key", "content")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, '<table><thead><tr><th>key</th><th>name</th></tr></thead><tbody>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || ' | &lt;x&gt; &amp; y</td></tr>', '' ORDER BY n_nationkey) || '</tbody></table>' AS content FROM nation GROUP BY n_regionkey")
def emit_html_tables(spark, sf_dir):
    return _nations(spark, sf_dir).select("key", E.fragment().alias("content"))


@query("""WITH c AS (SELECT n_regionkey, -1 AS k, 'key' AS a, 'name' AS b FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT n_regionkey, n_nationkey, CAST(n_nationkey AS VARCHAR), n_name || ' | <x> & y' FROM nation), w AS (SELECT n_regionkey, max(length(a)) AS wa FROM c GROUP BY 1)
SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(rpad(a, CAST(wa AS INTEGER), ' ') || '  ' || b, chr(10) ORDER BY k) || chr(10) AS content FROM c JOIN w USING (n_regionkey) GROUP BY 1""")
def emit_plain_tables(spark, sf_dir):
    return _nations(spark, sf_dir).select("key", E.plain_text().alias("content"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS key, CAST(n_nationkey AS VARCHAR) AS number, n_name || ' | <x> & y' AS name FROM nation""")
def emit_json_records(spark, sf_dir):
    """Records of the tables, read from the JSON documents."""
    j = E.render(_nations(spark, sf_dir), "json").select("key", F.explode(F.from_json("content", "blocks array<struct<records:array<map<string,string>>>>")["blocks"]).alias("b"))
    return j.select("key", F.explode("b.records").alias("r")).select("key", F.col("r")["key"].alias("number"), F.col("r")["name"].alias("name"))


@query("""SELECT r.n AS place, CASE WHEN r.i = 1 THEN 'a.md' ELSE 'a-' || r.i || '.md' END AS filename FROM (SELECT c_custkey AS n, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) r""")
def unique_file_names(spark, sf_dir):
    """Names of outputs that would all be equal."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.lit("a.md").alias("filename"))
    return E.unique_names(c, order=["place"]).select("place", "filename")


_MARKED = "SELECT doc_id, line_no, CASE line_no % 7 WHEN 1 THEN '• ' || text WHEN 2 THEN '  • ' || text WHEN 3 THEN '1. ' || text WHEN 5 THEN '- ' || text ELSE text END AS text"


@query(f"""WITH m AS (SELECT *, CASE WHEN regexp_matches(text, '^[ \\t\\x{{A0}}]*[•·▪◦‣∙◾▸►][ \\t\\x{{A0}}]+') THEN 'glyph' WHEN regexp_matches(text, '^[ \\t\\x{{A0}}]*\\(?([0-9]{{1,3}}|[a-zA-Z])[.)][ \\t\\x{{A0}}]+') AND length(text) > length(regexp_extract(text, '^[ \\t\\x{{A0}}]*\\(?([0-9]{{1,3}}|[a-zA-Z])[.)][ \\t\\x{{A0}}]+')) + 1 THEN 'ordered'
 WHEN regexp_matches(text, '^[ \\t\\x{{A0}}]*[-–—*][ \\t\\x{{A0}}]+') AND length(text) > length(regexp_extract(text, '^[ \\t\\x{{A0}}]*[-–—*][ \\t\\x{{A0}}]+')) + 1 THEN 'dash' END AS mark FROM ({_MARKED} FROM ({_LINES}))),
s AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark = 'ordered' END AS sort FROM m),
r AS (SELECT *, sum(CASE WHEN sort IS NOT NULL AND sort IS NOT DISTINCT FROM b THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(sort) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM s)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, max(CASE WHEN mark = 'glyph' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) AS glyph FROM r)
SELECT doc_id, line_no, mark, CASE WHEN mark IS NOT NULL AND (n > 1 OR glyph = 1) THEN CAST(run AS BIGINT) END AS list, CASE WHEN mark IS NOT NULL AND (n > 1 OR glyph = 1) THEN CAST(least(3, floor(length(regexp_extract(text, '^[ \\t\\x{{A0}}]*')) / 2)) AS INTEGER) END AS level FROM g""")
def list_islands(spark, sf_dir):
    """Lines of the documents with marks in turn: neighbours of one sort are a list."""
    from ..sources import text_like as S

    i, t = F.col("line_no") % 7, F.col("text")
    marked = F.when(i == 1, F.concat(F.lit("• "), t)).when(i == 2, F.concat(F.lit("  • "), t)).when(i == 3, F.concat(F.lit("1. "), t)).when(i == 5, F.concat(F.lit("- "), t)).otherwise(t)
    lines = S.lines(table(spark, sf_dir, "documents")).withColumn("text", marked)
    return L.list_islands(lines, ["doc_id"], "line_no").select("doc_id", "line_no", "mark", "list", "level")


# ---------------------------------------------------------------- whole conversions


def _bills(spark, sf_dir):
    """A delimited file for each order: a label and an amount for each line item, and the order's price as the total."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.lit(0).alias("last"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v")).alias("r"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.struct(F.lit(1).alias("last"), F.lit(0).alias("n"), F.col("o_totalprice").cast("decimal(18,2)").alias("v")).alias("r"))
    rows = li.unionByName(o).select("k", "r.*").withColumn("v", F.col("v").cast("string"))
    build = lambda rows: "\n".join(["Item,Amount", *[f"{'Total' if last else f'line {n}'},${v}" for last, n, v in rows]]).encode()
    return X.files(rows, "k", "csv", build, "last", "n", "v", order=["last", "n", "v"])


@query("""WITH i AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS key, 'total-mismatch' AS type, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS text FROM i JOIN orders ON o_orderkey = k WHERE n >= 2 AND abs(s - CAST(o_totalprice AS DECIMAL(18,2))) > 0.01""")
def convert_review(spark, sf_dir):
    """All checks over converted files."""
    from .convert import review

    return review(stored(_read(_bills(spark, sf_dir)), "bills"), "key").select(F.col("doc_id").cast("long").alias("key"), "type", "text")


@query("""SELECT n_name || '.md' AS filename, 'md' AS format, '# ' || replace(n_name, '_', '\\_') || chr(10) AS content FROM nation UNION ALL SELECT n_name || '.txt', 'txt', n_name || chr(10) FROM nation""")
def convert_outputs(spark, sf_dir):
    """Pages of a heading each, converted into two formats."""
    from .convert import convert

    n = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".html")).alias("name"), F.concat(F.lit("<html><body><script>x</script><h1>"), "n_name", F.lit("</h1></body></html>")).cast("binary").alias("content"), F.lit("").alias("mime"), F.lit(None).cast("string").alias("url"))
    _, out = convert(n, Options(outputs=("md", "txt"), frontMatter=False))
    return out.select("filename", "format", "content")
