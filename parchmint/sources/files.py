"""Files of any kind as rows: detection with a look into zip containers, archives as their members, readers that fail alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import text as T
from ..options import Options
from . import blocks as B
from . import readers

# What a member says about its container, declared types, and extensions that are read inside an archive.
MEMBERS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx", "META-INF/container.xml": "epub"}
DECLARED = {
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp", "application/epub+zip": "epub",
}
SUPPORTED = set(
    "pdf docx docm dotx xlsx xlsm xltx pptx pptm potx odt ods odp epub html htm xhtml mhtml mht csv tsv psv md markdown txt log rtf json jsonl ndjson yaml yml xml eml ipynb srt vtt "
    "png jpg jpeg gif bmp webp tif tiff".split()
)
LEGACY = "This is a legacy office file (.doc, .xls or .ppt). Save it as .docx, .xlsx or .pptx, or as PDF, and convert that."


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, content, mime, url of the files below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content", F.lit("").alias("mime"), F.lit(None).cast("string").alias("url"))


#: Characters of a captured page that are kept, and of pasted text that make it worth a document.
CAPTURED, PASTED = 8_000_000, 40


def captured(pages: DataFrame, most: int = CAPTURED) -> DataFrame:
    """Pages that a browser handed over (name, url, html) as files, with `truncated` where more than `most` characters came. Only http and https addresses are kept as such."""
    url = F.when(F.col("url").rlike("(?i)^https?://[^/]"), F.col("url"))
    keep = F.substring(F.coalesce("html", F.lit("")), 1, most)
    others = [c for c in pages.columns if c not in ("name", "url", "html")]
    return pages.select(*others, "name", keep.cast("binary").alias("content"), F.lit("text/html").alias("mime"), url.alias("url"), (F.length(F.coalesce("html", F.lit(""))) > most).alias("truncated"))


def pasted(clips: DataFrame) -> DataFrame:
    """Clips (html, text) as files: the markup if there is some, else a text of more than PASTED characters; others go."""
    html = F.nullif(T.trimmed(F.col("html")), F.lit(""))
    long = F.length(T.trimmed(F.col("text"))) > PASTED
    others = [c for c in clips.columns if c not in ("html", "text")]
    kept = clips.where(html.isNotNull() | F.coalesce(long, F.lit(False)))
    return kept.select(*others, F.when(html.isNotNull(), "pasted.html").otherwise("pasted.txt").alias("name"), F.coalesce(F.when(html.isNotNull(), F.col("html")), F.col("text")).cast("binary").alias("content"), F.lit("").alias("mime"), F.lit(None).cast("string").alias("url"))


def container_kind(content: bytes) -> str:
    """Kind of a zip file: what its mimetype declares, else what its members tell, else an archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            declared = z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else ""
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return "archive"
    return DECLARED.get(declared) or next((kind for member, kind in MEMBERS.items() if member in names), "archive")


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds = [container_kind(c.as_py()) if k == "archive" else k for k, c in zip(b.column(0).to_pylist(), b.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), b.column(2)], ["kind", "row"])


def detected(files: DataFrame) -> DataFrame:
    """`files` (name, content, mime and more) with kind, ext and note. Signatures come first, then members of zip files, extension, type, and a look at the bytes. Null contents count as empty."""
    content = F.coalesce(F.col("content"), F.lit(b""))
    kind = D.detect(content, F.coalesce("name", F.lit("")), F.coalesce("mime", F.lit("")))
    keyed = files.select(kind.alias("kind"), F.when(kind == "archive", F.col("content")).alias("probe"), F.struct(*[files[f"`{c}`"] for c in files.columns]).alias("row"))
    schema = f"kind string, row {keyed.schema['row'].dataType.simpleString()}"
    found = keyed.mapInArrow(_probed, schema)
    note = F.when((F.col("kind") == "unsupported") & F.hex(F.substring("row.content", 1, 8)).eqNullSafe(F.lit("D0CF11E0A1B11AE1")), LEGACY)
    return found.select("row.*", "kind", D.extension(F.coalesce("row.name", F.lit(""))).alias("ext"), note.alias("note"))


# ---------------------------------------------------------------- archives


def members(content: bytes) -> list[tuple[str, bytes]]:
    """(path, content) of the files in a zip that can be read; no system files, no archives in archives."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            ext = re.search(r"\.([A-Za-z0-9]+)$", info.filename)
            if not info.is_dir() and not re.match("__MACOSX/", info.filename) and not re.search(r"(^|/)\.DS_Store$", info.filename) and ext and ext[1].lower() in SUPPORTED:
                out.append((info.filename, z.read(info)))
    return out


def expanded(files: DataFrame) -> DataFrame:
    """Archives among detected `files` (place: long, name, content, mime, url, kind, ...) replaced by their members: place, part (order within the archive, 0 for other files), name, content, mime, url, parent, error.

    (place, part) keeps the order of a queue in which members stand where their archive stood. An archive that can't be
    opened stays as one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string())
        names = ["place", "part", "name", "content", "mime", "url", "parent", "error"]
        for b in batches:
            rows = []
            for place, name, content, mime, url, kind in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if kind != "archive":
                    rows.append((place, 0, name, content, mime, url, None, None))
                    continue
                try:
                    rows += [(place, i, path.rsplit("/", 1)[-1], data, "", None, name, None) for i, (path, data) in enumerate(members(content))]
                except Exception as e:  # one bad archive is one row
                    rows.append((place, 0, name, None, mime, url, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    wanted = files.select(F.col("place").cast("long"), "name", "content", "mime", "url", "kind")
    return wanted.mapInArrow(run, "place long, part int, name string, content binary, mime string, url string, parent string, error string")


# ---------------------------------------------------------------- reading

DOCUMENT = f"name string, kind string, ext string, url string, source_bytes long, meta map<string,string>, warnings array<string>, native string, blocks array<{B.BLOCK}>, assets array<struct<path:string,mime:string,content:binary>>, error string"


def document(content: bytes, name: str, kind: str, ext: str, opts: Options, url: str | None = None) -> B.Document:
    """One file read, repaired, its images placed."""
    reader = readers.load().get(kind)
    if reader is None:
        raise ValueError(f"No reader for {kind} files ({name}).")
    found = reader(content, name, ext, opts, url) if kind == "html" else reader(content, name, ext, opts)
    if opts.repairStructure and kind in B.REPAIRABLE:
        found.blocks = B.repaired(found.blocks)
    stem = re.sub(r"\.[A-Za-z0-9]+$", "", re.sub(r"^.*[/\\]", "", name or "")) or "document"
    found = B.with_image_policy(found, opts, stem)
    found.meta = {"name": name, "title": stem, "source": url, **{k: v for k, v in found.meta.items() if v not in (None, "")}}
    return found


def read(files: DataFrame, opts: Options = Options()) -> DataFrame:
    """Documents of `files` (name, content, mime, url, kind, ext, note), a row for each: DOCUMENT. A file that can't be read has an error and no blocks; it never fails the others.

    Columns beside these come back as they are. Null contents are read as empty files."""
    own = [f.split(" ")[0] for f in ("name", "content", "mime", "url", "kind", "ext", "note")]
    others = [c for c in files.columns if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for name, content, url, kind, ext, note in zip(*[part.column(i).to_pylist() for i in range(6)]):
                    row = {"name": name, "kind": kind, "ext": ext, "url": url, "source_bytes": len(content or b"")}
                    try:
                        if kind in ("unsupported", "archive"):
                            raise ValueError(note or f"{name} can't be read ({kind}).")
                        found = document(content or b"", name or "", kind, ext or "", opts, url)
                        meta = {k: ("true" if v is True else "false" if v is False else str(v)) for k, v in found.meta.items() if v is not None}
                        row |= {"meta": list(meta.items()), "warnings": found.warnings, "native": found.native, "blocks": [x.row(i) for i, x in enumerate(found.blocks)], "assets": [{"path": p, "mime": m, "content": c} for p, m, c in found.assets]}
                    except Exception as e:  # isolation: the error is this item's result
                        row["error"] = str(e) or type(e).__name__
                    rows.append(row)
                made = pa.Table.from_pylist(rows, schema=_ARROW).to_batches()
                for x in made:
                    yield pa.RecordBatch.from_arrays([*x.columns, part.column(6)], [*_ARROW.names, "beside"])

    beside = F.struct(*[files[f"`{c}`"] for c in others], F.lit(0).alias("_")).alias("beside")
    content = files["content"].cast("binary")
    given = files.select("name", content.alias("content"), "url", "kind", "ext", "note", beside)
    schema = f"{DOCUMENT}, beside {given.schema['beside'].dataType.simpleString()}"
    found = given.mapInArrow(run, schema)
    return found.select(*[F.col("beside")[c].alias(c) for c in others], *[c for c in found.columns if c != "beside"])


def _arrow_schema() -> pa.Schema:
    item = pa.struct([("level", pa.int32()), ("text", pa.string()), ("markdown", pa.string())])
    texts = pa.list_(pa.string())
    block = pa.struct(
        [("idx", pa.int32()), ("page", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("ordered", pa.bool_()), ("language", pa.string()), ("role", pa.string()), ("src", pa.string()), ("alt", pa.string()),
         ("text", pa.string()), ("markdown", pa.string()), ("items", pa.list_(item)), ("header", texts), ("rows", pa.list_(texts)), ("cells", pa.list_(texts))]
    )
    asset = pa.struct([("path", pa.string()), ("mime", pa.string()), ("content", pa.binary())])
    return pa.schema(
        [("name", pa.string()), ("kind", pa.string()), ("ext", pa.string()), ("url", pa.string()), ("source_bytes", pa.int64()), ("meta", pa.map_(pa.string(), pa.string())), ("warnings", texts), ("native", pa.string()),
         ("blocks", pa.list_(block)), ("assets", pa.list_(asset)), ("error", pa.string())]
    )


_ARROW = _arrow_schema()


def blocks(docs: DataFrame, *keys: str) -> DataFrame:
    """A row for each block of `docs`: the keys and the block's fields."""
    return docs.select(*keys, F.explode("blocks").alias("b")).select(*keys, "b.*")


def links_of(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, target of the links of pages(page_id, url, html), resolved against the page's address or its <base>."""
    from . import tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                root = tree.parse(html.as_py() or "")
                base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), None)
                base = tree.resolved(url or "", base) if base else url or ""
                hrefs = [n.attrs["href"] for n in root.walk() if n.tag == "a" and n.attrs.get("href")]
                rows += [(key, i, h, tree.resolved(base, h) if not h.startswith("data:") else h) for i, h in enumerate(hrefs)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["page_id", "pos", "href", "target"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, pos int, href string, target string")
