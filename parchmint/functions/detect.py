"""What a file is, from its first bytes, its name and its MIME type, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures in hex, in the order in which they are tried.
MAGIC = [
    ("pdf", "255044462D"),
    ("archive", "504B0304"),
    ("archive", "504B0506"),
    ("rtf", "7B5C727466"),
    ("unsupported", "D0CF11E0A1B11AE1"),
    ("image", "89504E47"),
    ("image", "FFD8FF"),
    ("image", "47494638"),
    ("image", "424D"),
    ("image", "49492A00"),
    ("image", "4D4D002A"),
]
# Extensions of each kind.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx docm dotx", "xlsx": "xlsx xlsm xltx", "pptx": "pptx pptm potx", "odt": "odt", "ods": "ods", "odp": "odp",
    "epub": "epub", "html": "html htm xhtml", "mhtml": "mhtml mht", "csv": "csv tsv psv", "markdown": "md markdown mdx", "text": "txt log text",
    "rtf": "rtf", "json": "json", "jsonl": "jsonl ndjson", "yaml": "yaml yml", "xml": "xml", "eml": "eml", "ipynb": "ipynb", "subtitles": "srt vtt",
    "image": "png jpg jpeg gif bmp webp tif tiff pbm",
    "code": "toml js mjs ts tsx jsx py rb go rs java c h cpp cs php sh sql css ini conf swift kt r",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")


def looks_textual(content: Column) -> Column:
    """No NUL and under 2 % control bytes in the first 4096."""
    sample = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    odd = F.length(F.regexp_replace(sample, r"[^\x00-\x08\x0E-\x1F]", ""))
    return ~sample.contains("\x00") & ((F.length(sample) == 0) | (odd / F.length(sample) < 0.02))


def detect(content: Column, name: Column, mime: Column) -> Column:
    """Kind of a file. Zip containers are `archive` until their members are read (sources.archive)."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.lit(None).cast("string")
    tail = F.coalesce(
        F.when(mime.startswith("image/"), "image").when(mime.contains("html"), "html").when(mime.contains("json"), "json").when(mime.contains("csv"), "csv").when(mime.startswith("text/"), "text"),
        F.when(looks_textual(content), "text").otherwise("unsupported"),
    )
    for k, names in reversed(EXTENSIONS.items()):
        tail = F.when(extension(name).isin(names.split()), k).otherwise(tail)
    kind = tail
    for k, signature in reversed(MAGIC):
        kind = F.when(head.startswith(signature), k).otherwise(kind)
    return kind
