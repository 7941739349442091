"""Workbooks, text documents, slides and e-books in zipped XML."""

from __future__ import annotations

import datetime as dt
import math
import re
from xml.etree import ElementTree as ET

from ...options import Options
from .. import tree
from ..blocks import Block, Document, capped, code, from_runs, from_tree, heading, nested, paragraph, table
from . import register
from .parts import Parts, attr, deep, first, kids, local, related, resolve, text
from .plain import has_header

# ---------------------------------------------------------------- workbooks

# Number formats that are dates without a code of their own.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def is_date_format(code: str) -> bool:
    """Whether a format code holds a part of a date or time outside quotes, escapes and brackets."""
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code), re.I))


def trimmed_number(n: float) -> str:
    """Twelve significant digits, without an exponent up to 1e21; -0 is 0."""
    n = float(f"{n:.12g}")
    if n == 0:
        return "0"
    if n.is_integer() and abs(n) < 1e21:
        return str(int(n))
    s = repr(n)
    if "e" in s and 1e-6 <= abs(n) < 1e21:
        s = f"{n:.20f}".rstrip("0")
    return s.replace("e-0", "e-").replace("e+0", "e+")


def serial_text(serial: float, date1904: bool, code: str = "") -> str:
    """A serial as yyyy-mm-dd, hh:mm:ss or both, as its format says; without a format the date, with the time if there is one."""
    try:
        at = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
        at += dt.timedelta(milliseconds=math.floor(serial * 86400000 + 0.5))
    except OverflowError:
        return trimmed_number(serial)
    plain = re.sub(r'"[^"]*"', "", code)
    date = not code or bool(re.search("[ymd]", plain, re.I))
    time = bool(re.search("[hs]", plain, re.I)) or serial % 1 != 0
    return at.strftime("%Y-%m-%d %H:%M:%S" if date and time else "%H:%M:%S" if time else "%Y-%m-%d")


def column_index(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def column_name(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _shared(parts: Parts) -> list[str]:
    """Shared strings: rich ones are the text of their runs."""
    out = []
    for si in kids(parts.optional("xl/sharedStrings.xml"), "si"):
        runs = kids(si, "r")
        out.append("".join(text(first(r, "t")) for r in runs) if runs else text(first(si, "t")))
    return out


def _formats(parts: Parts) -> list[tuple[bool, str]]:
    """For each cell style: whether it shows a date, and its format code."""
    root = parts.optional("xl/styles.xml")
    codes = {int(attr(f, "numFmtId", "0")): attr(f, "formatCode", "") for f in deep(root, "numFmt")}
    ids = [int(attr(x, "numFmtId", "0")) for x in kids(first(root, "cellXfs"), "xf")]
    return [(i in DATE_FORMATS or is_date_format(codes.get(i, "")), codes.get(i, "")) for i in ids]


def cell_value(cell: ET.Element, shared: list[str], formats: list[tuple[bool, str]], date1904: bool) -> str:
    kind, raw = attr(cell, "t", "n"), text(next(iter(kids(cell, "v")), None))
    if kind == "inlineStr":
        return text(first(cell, "is")).strip()
    if raw == "" or kind in ("e", "d"):
        return raw
    if kind == "s":
        return shared[int(raw)].strip() if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind == "str":
        return raw.strip()
    try:
        n = float(raw)
    except ValueError:
        return raw
    if n != n or n in (float("inf"), float("-inf")):
        return raw
    at = int(attr(cell, "s", "0"))
    date, fmt = formats[at] if at < len(formats) else (False, "")
    return serial_text(n, date1904, fmt) if date else f"{trimmed_number(n * 100)}%" if "%" in fmt else trimmed_number(n)


def sheet_grid(sheet: ET.Element, shared, formats, date1904: bool, links: dict[str, str], most: int) -> tuple[list[int], list[dict[int, tuple[str, str | None]]], bool]:
    """(columns in use, rows as column -> (value, link), whether rows were cut off). Empty rows at both ends and empty columns go."""
    rows, cut = [], False
    for row in deep(sheet, "row"):
        if len(rows) >= most:
            cut = True
            break
        found = {}
        for cell in kids(row, "c"):
            ref = attr(cell, "r", "")
            value = cell_value(cell, shared, formats, date1904)
            if value != "":
                found[column_index(ref)] = (value, links.get(ref))
        rows.append(found)
    filled = [i for i, r in enumerate(rows) if r]
    rows = rows[filled[0] : filled[-1] + 1] if filled else []
    return sorted({c for r in rows for c in r}), rows, cut


@register("xlsx")
def read_workbook(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """Each visible sheet: its name as a heading and a table (or a block of CSV)."""
    parts = Parts(content)
    book, rels = parts.xml("xl/workbook.xml"), parts.relations("xl/workbook.xml")
    date1904 = attr(first(book, "workbookPr"), "date1904") in ("1", "true")
    shared, formats = _shared(parts), _formats(parts)
    blocks, warnings, sheets = [], [], list(deep(book, "sheet"))
    for sheet in sheets:
        title, path = attr(sheet, "name") or "Sheet", rels.get(related(sheet) or "", ("", False))[0]
        if attr(sheet, "state", "visible") != "visible" and not opts.includeEmptySheets:
            continue
        if path not in parts:
            warnings.append(f"Could not locate the data for sheet {title!r}.")
            continue
        root, targets = parts.xml(path), parts.relations(path)
        links = {attr(h, "ref"): targets.get(related(h) or "", ("", False))[0] or attr(h, "location") for h in deep(root, "hyperlink")}
        columns, rows, cut = sheet_grid(root, shared, formats, date1904, links, opts.maxSheetRows)
        if not rows:
            blocks += [heading(2, title), paragraph("(empty sheet)")] if opts.includeEmptySheets else []
            continue
        if cut:
            warnings.append(f"Sheet {title!r} was truncated to {opts.maxSheetRows} rows (raise maxSheetRows).")
        grid = [[r.get(c, ("", None)) for c in columns] for r in rows]
        values = [[v for v, _ in r] for r in grid]
        blocks.append(heading(2, title))
        if opts.sheetMode == "csv-block":
            quoted = lambda v: '"{}"'.format(v.replace('"', '""')) if re.search('[",\n]', v) else v
            blocks.append(code("\n".join(",".join(map(quoted, r)) for r in values), "csv"))
            continue
        real = has_header(values) and any(values[1])
        head = values[0] if real else [column_name(c) for c in columns]
        shown = lambda v, link: f"[{tree.collapsed(v)}]({link})".replace("|", "\\|") if link else tree.collapsed(v).replace("|", "\\|")
        cells = [[shown(*x) for x in r] for r in grid]
        blocks.append(table(head, values[1:] if real else values, cells if real else [head, *cells]))
    return Document(blocks or [paragraph("This workbook contains no visible data.")], {"kind": "xlsx", "sheets": len(sheets)}, warnings)


# ---------------------------------------------------------------- text documents

# What paragraph and run styles mean; "heading n" gives a heading of level n.
PARAGRAPH_STYLES = {"title": "h1", "subtitle": "p", "quote": "quote", "intense quote": "quote", "caption": "caption", "code": "code", "source code": "code", "footnote text": "p"}
RUN_STYLES = {"code char": "mono", "book title": "italic"}


def _style_names(parts: Parts) -> dict[str, str]:
    return {attr(s, "styleId"): attr(first(s, "name"), "val", "").lower() for s in deep(parts.optional("word/styles.xml"), "style")}


def _numbering(parts: Parts) -> dict[tuple[str, str], bool]:
    """(list, level) -> whether it counts."""
    root = parts.optional("word/numbering.xml")
    kinds = {(attr(a, "abstractNumId"), attr(v, "ilvl")): attr(first(v, "numFmt"), "val", "bullet") for a in deep(root, "abstractNum") for v in kids(a, "lvl")}
    out = {}
    for n in deep(root, "num"):
        target = attr(first(n, "abstractNumId"), "val")
        out |= {(attr(n, "numId"), level): kind not in ("bullet", "none") for (a, level), kind in kinds.items() if a == target}
    return out


def _on(props: ET.Element | None, name: str) -> bool:
    found = next(iter(kids(props, name)), None)
    return found is not None and attr(found, "val", "1") not in ("0", "false", "none")


def _runs(node: ET.Element, styles: dict[str, str], rels: dict, link: str | None = None) -> list[tuple[str, set[str], str | None]]:
    out = []
    for child in node:
        tag = local(child.tag)
        if tag == "hyperlink":
            target = rels.get(related(child) or "", ("", False))[0] or (f"#{attr(child, 'anchor')}" if attr(child, "anchor") else None)
            out += _runs(child, styles, rels, target)
        elif tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
            out += _runs(child, styles, rels, link)
        elif tag == "r":
            props = next(iter(kids(child, "rPr")), None)
            style = {s for s, n in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("strike", "strike")) if _on(props, n)}
            style |= {RUN_STYLES[x] for x in [styles.get(attr(first(props, "rStyle"), "val", ""), "")] if x in RUN_STYLES}
            for piece in child:
                kind = local(piece.tag)
                words = {"t": text(piece), "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(kind, "")
                if words:
                    out.append((words, style, link))
    return out


@register("docx")
def read_word(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """Paragraphs by the meaning of their styles; numbered ones as lists; tables; images where they stand."""
    parts = Parts(content)
    root, rels = parts.xml("word/document.xml"), parts.relations("word/document.xml")
    styles, counts = _style_names(parts), _numbering(parts)
    blocks: list[Block] = []
    items: list[tuple[int, str, str]] = []
    ordered, warnings = False, []

    def flush() -> None:
        if items:
            blocks.append(nested(list(items), ordered))
            items.clear()

    def images(node: ET.Element) -> list[Block]:
        if opts.imageMode == "strip":
            return []
        found = []
        for drawing in deep(node, "drawing", "pict"):
            blip = first(drawing, "blip", "imagedata")
            props = first(drawing, "docPr")
            found.append(parts.image(rels.get(related(blip) or "", ("", False))[0], attr(props, "descr") or "", opts.maxImageBytes))
        return [i for i in found if i]

    def visit(node: ET.Element) -> None:
        nonlocal ordered
        for child in node:
            tag = local(child.tag)
            if tag in ("sdt", "sdtContent"):
                visit(child)
            elif tag == "tbl":
                flush()
                rows = [[" ".join(x for x in (tree.collapsed("".join(t for t, _, _ in _runs(p, styles, rels))) for p in deep(c, "p")) if x) for c in kids(r, "tc")] for r in kids(child, "tr")]
                if rows:
                    head = first(kids(child, "tr")[0], "tblHeader") is not None
                    blocks.append(table(rows[0] if head else None, rows[1:] if head else rows))
            elif tag == "p":
                props = next(iter(kids(child, "pPr")), None)
                style_id = attr(first(props, "pStyle"), "val", "")
                style = styles.get(style_id, style_id.lower())
                if style_id and style_id not in styles:
                    warnings.append(f"Unrecognised paragraph style: {style_id}")
                runs, number = _runs(child, styles, rels), first(props, "numPr")
                level = re.fullmatch(r"heading ?([1-6])", style)
                meaning = PARAGRAPH_STYLES.get(style)
                plain = tree.collapsed("".join(t for t, _, _ in runs))
                if number is not None and not level and plain:
                    depth, which = attr(first(number, "ilvl"), "val", "0"), attr(first(number, "numId"), "val", "")
                    counted = counts.get((which, depth), False)
                    if items and depth == "0" and counted != ordered:
                        flush()
                    if not items:
                        ordered = counted
                    found = from_runs(runs, opts)
                    items.append((int(depth), plain, found[0].markdown or plain) if found else (int(depth), plain, plain))
                else:
                    flush()
                    if meaning == "code":
                        raw = "".join(t for t, _, _ in runs)
                        if blocks and blocks[-1].type == "code" and blocks[-1].role == "style":
                            blocks[-1].text = blocks[-1].markdown = f"{blocks[-1].text}\n{raw}"
                        else:
                            blocks.append(code(raw, None))
                            blocks[-1].role = "style"
                    elif plain:
                        made = from_runs(runs, opts, int(level[1]) if level else 1 if meaning == "h1" else None)
                        for b in made:
                            if meaning == "quote":
                                b.type = "quote"
                            elif meaning == "caption":
                                b.role, b.markdown = "caption", f"_{b.markdown}_"
                        blocks.extend(made)
                blocks.extend(images(child))

    visit(first(root, "body") if first(root, "body") is not None else root)
    flush()
    for b in blocks:
        b.role = None if b.role == "style" else b.role
    # one warning for each thing, eight at most
    return Document(blocks, {"kind": "docx"}, capped(list(dict.fromkeys(warnings)), 8, "...and {} more style warnings."))


# ---------------------------------------------------------------- slides

#: Placeholders that repeat on every slide.
FURNITURE = {"ftr", "sldNum", "dt"}


def _slide_paragraphs(body: ET.Element | None) -> list[tuple[int, bool, list[tuple[str, set[str], str | None]]]]:
    """(level, whether it has a bullet, runs) of each paragraph; a bullet is there unless switched off."""
    out = []
    for p in kids(body, "p"):
        props, runs = next(iter(kids(p, "pPr")), None), []
        for node in p:
            kind = local(node.tag)
            if kind in ("r", "fld"):
                style = next(iter(kids(node, "rPr")), None)
                runs.append((text(first(node, "t")), {s for s, a in (("bold", "b"), ("italic", "i")) if kind == "r" and attr(style, a) == "1"}, None))
            elif kind == "br":
                runs.append(("\n", set(), None))
        out.append((int(attr(props, "lvl", "0")), first(props, "buNone") is None, runs))
    return out


def _plain(runs: list[tuple[str, set[str], str | None]]) -> str:
    return "".join(t for t, _, _ in runs)


def _shapes(node: ET.Element):
    """Shapes in drawing order, those in groups in their place."""
    for child in node:
        if local(child.tag) == "grpSp":
            yield from _shapes(child)
        elif local(child.tag) in ("sp", "graphicFrame", "pic"):
            yield child


@register("pptx")
def read_slides(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """A heading for each slide (its title), then its shapes; speaker notes as a quote."""
    parts = Parts(content)
    rels = parts.relations("ppt/presentation.xml")
    paths = [rels.get(related(s) or "", ("", False))[0] for s in deep(parts.xml("ppt/presentation.xml"), "sldId")]
    paths = [p for p in paths if p in parts]
    title = text(first(parts.optional("docProps/core.xml"), "title")).strip() or None
    blocks, warnings = [heading(1, title)] if title else [], []
    for n, path in enumerate(paths, 1):
        try:
            blocks += _slide(parts, path, n, opts)
        except (ET.ParseError, ValueError, KeyError) as e:
            warnings.append(f"Slide {n} could not be read: {e}")
    if not paths:
        warnings.append("No slides were found in this presentation.")
    return Document(blocks, {"kind": "pptx", "slides": len(paths), "title": title}, warnings)


def _slide(parts: Parts, path: str, n: int, opts: Options) -> list[Block]:
    root, rels, title, out = parts.xml(path), parts.relations(path), None, []
    tree_ = first(root, "spTree")
    for shape in _shapes(tree_ if tree_ is not None else root):
        kind = local(shape.tag)
        if kind == "sp":
            place, found = attr(first(shape, "ph"), "type", ""), _slide_paragraphs(first(shape, "txBody"))
            if place in FURNITURE or not any(_plain(r).strip() for _, _, r in found):
                continue
            if title is None and place in ("title", "ctrTitle"):
                title = tree.collapsed(" ".join(_plain(r) for _, _, r in found))
                continue
            items: list[tuple[int, str, str]] = []
            for level, bullet, runs in [*found, (0, False, [])]:
                made = from_runs(runs, opts) if _plain(runs).strip() else []
                if bullet and made:
                    items.append((level, made[0].text, (made[0].markdown or "").replace("  \n", " ")))
                elif made or (level, bullet, runs) == (0, False, []):
                    out += [nested(items, False)] if items else []
                    items = []
                    out += made
        elif kind == "graphicFrame":
            rows = [[tree.collapsed(" ".join(_plain(r) for _, _, r in _slide_paragraphs(first(c, "txBody")))) for c in kids(tr, "tc")] for tr in deep(first(shape, "tbl"), "tr")]
            out += [table(rows[0], rows[1:])] if rows else []
        elif opts.imageMode != "strip":
            props = first(shape, "cNvPr")
            image = parts.image(rels.get(related(first(shape, "blip")) or "", ("", False))[0], attr(props, "descr") or attr(props, "name") or "", opts.maxImageBytes)
            out += [image] if image else []
    notes = next((t for t, _ in rels.values() if re.search(r"notesSlide\d+\.xml$", t)), None) if opts.includeSpeakerNotes else None
    if notes in parts:
        # a paragraph that is a bare number is the slide's own
        said = [t for body in deep(parts.xml(notes), "txBody") for _, _, r in _slide_paragraphs(body) if (t := tree.collapsed(_plain(r))) and not t.isdigit()]
        if said:
            out.append(Block("quote", " ".join(["Speaker notes", *said]), "\n\n".join(["**Speaker notes**", *said]), role="speaker-notes"))
    head = heading(2, title or f"Slide {n}")
    return [head, *out]


# ---------------------------------------------------------------- e-books


@register("epub")
def read_book(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """Chapters in the order of the spine, a rule between two; the navigation is left out, links between chapters become text."""
    parts = Parts(content)
    if "META-INF/container.xml" not in parts:
        raise ValueError("Not a valid EPUB: META-INF/container.xml is missing.")
    package = attr(first(parts.xml("META-INF/container.xml"), "rootfile"), "full-path")
    if package not in parts:
        raise ValueError("Not a valid EPUB: the package document is missing.")
    opf = parts.xml(package)
    of = lambda tag: text(first(opf, tag)).strip() or None
    meta = {"kind": "epub", "title": of("title"), "author": of("creator"), "language": of("language"), "publisher": of("publisher")}
    manifest = {attr(i, "id"): i for i in deep(opf, "item")}
    spine = [manifest[attr(r, "idref")] for r in deep(opf, "itemref") if attr(r, "idref") in manifest]
    spine = [i for i in spine if re.search("xhtml|html", attr(i, "media-type", "")) and not re.search(r"\bnav\b", attr(i, "properties", ""))]
    blocks, warnings = [heading(1, meta["title"])] if meta["title"] else [], []
    if meta["author"]:
        blocks.append(paragraph(meta["author"]))
        blocks[-1].markdown = f"_{blocks[-1].markdown}_"
    for n, item in enumerate(spine):
        path = resolve(package, attr(item, "href"))
        if path not in parts:
            warnings.append(f"Missing chapter file: {path}")
            continue
        root = tree.parse(parts.read(path).decode("utf-8", "replace"))
        body = tree.without(root.first("body") or root, lambda x: x.tag in ("script", "style", "link", "meta", "head"))
        for x in body.walk():
            if x.tag in ("img", "image"):
                raw = x.attrs.get("src") or x.attrs.get("xlink:href") or x.attrs.get("href") or ""
                if opts.imageMode == "strip":
                    x.tag = "#gone"
                elif raw and not raw.startswith("data:"):
                    image = parts.image(resolve(path, raw), "", opts.maxImageBytes)
                    x.attrs["src"], x.tag = (image.src, "img") if image else ("", "#gone")
            elif x.tag == "a" and not re.match(r"(?i)[a-z][a-z0-9+.-]*:|#", x.attrs.get("href", "#")):
                x.tag, x.attrs = "span", {}
        tree.without(body, lambda x: x.tag == "#gone")
        found = from_tree(tree.sanitized(body), opts)
        if found:
            blocks += [Block("divider", role="chapter")] if blocks and n else []
            blocks += found
    if len(spine) > 40:
        warnings.append(f"This book has {len(spine)} sections: the Markdown file will be large.")
    return Document(blocks, {**meta, "chapters": len(spine)}, warnings)


