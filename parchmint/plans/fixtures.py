"""Files made of rows, for queries and tests that read them back: small writers of each format, and frames of their bytes."""

from __future__ import annotations

import base64
import io
import json
import quopri
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:meta="urn:oasis:names:tc:opendocument:xmlns:meta:1.0"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xml_text(text: str) -> str:
    """Text that XML can hold, escaped."""
    return escape(re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", text), quote=True)


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def relations(targets: dict[str, str], external: frozenset[str] = frozenset()) -> str:
    rows = "".join(f'<Relationship Id="{k}" Type="{_REL}/x" Target="{escape(v)}"{" TargetMode=\"External\"" if k in external else ""}/>' for k, v in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def column(i: int) -> str:
    return chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)


#: Styles of the workbooks: general, date, percent.
_STYLES = f'<styleSheet {_S}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'


def xlsx(sheets: dict[str, list[list]], links: dict[str, str] | None = None, hidden: tuple[str, ...] = ()) -> bytes:
    """Cells: None (no cell), a text (shared), a number, or (number, style). links: cell of the first sheet -> address."""
    shared: dict[str, int] = {}
    parts: dict[str, str | bytes] = {"xl/styles.xml": _STYLES}
    names, rels = [], {}
    for n, (name, rows) in enumerate(sheets.items(), 1):
        out = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                ref = f"{column(c)}{r}"
                if isinstance(v, str):
                    cells.append(f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
                elif isinstance(v, bool):
                    cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif v is not None:
                    value, style = v if isinstance(v, tuple) else (v, 0)
                    cells.append(f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>')
            out.append(f'<row r="{r}">{"".join(cells)}</row>')
        linked = "".join(f'<hyperlink ref="{ref}" r:id="l{i}"/>' for i, ref in enumerate(links or ())) if n == 1 else ""
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet {_S}><sheetData>{"".join(out)}</sheetData>{f"<hyperlinks>{linked}</hyperlinks>" if linked else ""}</worksheet>'
        if linked:
            parts["xl/worksheets/_rels/sheet1.xml.rels"] = relations({f"l{i}": u for i, u in enumerate(links.values())}, frozenset(f"l{i}" for i in range(len(links))))
        names.append(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="r{n}"{" state=\"hidden\"" if name in hidden else ""}/>')
        rels[f"r{n}"] = f"worksheets/sheet{n}.xml"
    parts["xl/workbook.xml"] = f'<workbook {_S}><sheets>{"".join(names)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = relations(rels)
    parts["xl/sharedStrings.xml"] = f'<sst {_S}>{"".join(f"<si><t xml:space=\"preserve\">{xml_text(t)}</t></si>" for t in shared)}</sst>'
    return zipped(parts)


def docx(paragraphs: list[tuple[str, str]], styles: dict[str, str] | None = None, extra: str = "") -> bytes:
    """paragraphs: (style id or "", text). styles: id -> name. extra: markup behind them."""
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t xml:space="preserve">{xml_text(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    parts = {"word/document.xml": f"<w:document {_W}><w:body>{body}{extra}</w:body></w:document>"}
    if styles:
        parts["word/styles.xml"] = f'<w:styles {_W}>{"".join(f"<w:style w:styleId=\"{k}\"><w:name w:val=\"{v}\"/></w:style>" for k, v in styles.items())}</w:styles>'
    return zipped(parts)


def pptx(slides: list[tuple[str, list[str], str]]) -> bytes:
    """slides: (title, bullets, notes)."""
    parts: dict[str, str | bytes] = {}
    ids, rels = [], {}
    shape = lambda kind, paras: f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="x"/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{xml_text(t)}</a:t></a:r></a:p>" for t in paras)}</p:txBody></p:sp>'
    for n, (title, bullets, notes) in enumerate(slides, 1):
        shapes = shape('<p:ph type="title"/>', [title]) + shape("", bullets) + shape('<p:ph type="sldNum"/>', [str(n)])
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        if notes:
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f'<p:notes {_P}><p:cSld><p:spTree>{shape("", [notes])}{shape("", [str(n)])}</p:spTree></p:cSld></p:notes>'
            parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = relations({"n1": f"../notesSlides/notesSlide{n}.xml"})
        ids.append(f'<p:sldId id="{255 + n}" r:id="s{n}"/>')
        rels[f"s{n}"] = f"slides/slide{n}.xml"
    parts["ppt/presentation.xml"] = f'<p:presentation {_P}><p:sldIdLst>{"".join(ids)}</p:sldIdLst></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = relations(rels)
    return zipped(parts)


def odt(paragraphs: list[tuple[int, str]]) -> bytes:
    """paragraphs: (level of the heading or 0, text)."""
    body = "".join(f'<text:h text:outline-level="{n}">{xml_text(t)}</text:h>' if n else f"<text:p>{xml_text(t)}</text:p>" for n, t in paragraphs)
    return zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:document-content {_O}><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def ods(sheets: dict[str, list[list[str]]]) -> bytes:
    row = lambda r: f'<table:table-row>{"".join(f"<table:table-cell office:value-type=\"string\"><text:p>{xml_text(c)}</text:p></table:table-cell>" for c in r)}</table:table-row>'
    filler = '<table:table-row table:number-rows-repeated="1000"><table:table-cell table:number-columns-repeated="200"/></table:table-row>'
    body = "".join(f'<table:table table:name="{escape(n)}">{"".join(map(row, rows))}{filler}</table:table>' for n, rows in sheets.items())
    return zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f"<office:document-content {_O}><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>"})


def epub(title: str, chapters: list[str]) -> bytes:
    """chapters: XHTML bodies; the spine is in their order, the manifest in the other."""
    items = "".join(f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in reversed(range(len(chapters))))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{xml_text(title)}</dc:title></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine><itemref idref="nav"/>{refs}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/book.opf": opf, "OEBPS/nav.xhtml": "<html><body><p>contents</p></body></html>"}
    return zipped(parts | {f"OEBPS/text/c{i}.xhtml": f"<html><head><title>x</title></head><body>{b}</body></html>" for i, b in enumerate(chapters)})


def eml(subject: str, sender: str, text: str, encoding: str = "base64") -> bytes:
    body = base64.encodebytes(text.encode()) if encoding == "base64" else quopri.encodestring(text.encode())
    words = base64.b64encode(subject.encode()).decode()
    head = f"From: {sender}\r\nTo: archive@example.org\r\nSubject: =?utf-8?B?{words}?=\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: {encoding}\r\n\r\n"
    return head.encode() + body


def mhtml(html: str, url: str) -> bytes:
    head = f'Snapshot-Content-Location: {url}\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="part"\r\n\r\n--part\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n'
    return head.encode() + base64.encodebytes(html.encode()) + b"\r\n--part--\r\n"


def rtf(paragraphs: list[str]) -> bytes:
    def char(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if ord(c) < 128:
            return c
        units = c.encode("utf-16-le")
        return "".join(f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2))

    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}\\fs24 " + "".join("".join(map(char, p)) + "\\par " for p in paragraphs) + "}").encode("ascii")


def notebook(cells: list[tuple[str, str]]) -> bytes:
    """cells: (markdown or code, source)."""
    return json.dumps({"metadata": {"kernelspec": {"language": "sql"}}, "cells": [{"cell_type": k, "source": s.splitlines(True), **({"outputs": []} if k == "code" else {})} for k, s in cells]}).encode()


def srt(cues: list[tuple[float, str]]) -> bytes:
    stamp = lambda s: f"{int(s) // 3600:02d}:{int(s) // 60 % 60:02d}:{int(s) % 60:02d},000"
    return "\n\n".join(f"{i}\n{stamp(at)} --> {stamp(at + 1)}\n{text}" for i, (at, text) in enumerate(cues, 1)).encode()


def files(rows: DataFrame, key: str, extension: str, build: Callable[[list], bytes], *parts: str, order: list[str] | None = None) -> DataFrame:
    """A file for each key: name (<key>.<extension>), content, mime, url, key. `build` gets the rows of the key, as tuples of `parts` in order."""
    values = F.struct(*[F.col(p).alias(f"_{i}") for i, p in enumerate(parts)]).alias("values_")
    item = F.struct(*[F.col(o).alias(f"order_{i}") for i, o in enumerate(order or [])], values)
    g = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["values_"]).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            made = [build([tuple(r.values()) for r in p.as_py()]) for p in b.column(1)]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.{extension}" for k in keys]), pa.array(made, pa.binary()), pa.array([""] * n), pa.array([None] * n, pa.string()), pa.array(keys)], ["name", "content", "mime", "url", "key"])

    return g.mapInArrow(run, "name string, content binary, mime string, url string, key string")
