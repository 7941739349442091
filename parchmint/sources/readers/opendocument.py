"""OpenDocument text, sheets and slides."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from ...options import Options
from .. import tree
from ..blocks import Block, Document, from_runs, heading, nested, paragraph, table
from . import register
from .parts import Parts, attr, deep, first, kids, local, text

#: Cells and rows that a repeat count may stand for, and blanks that a space element may.
TEXT_COLUMNS, SHEET_COLUMNS, SHEET_ROWS, BLANKS = 64, 256, 2000, 40


class _Reader:
    def __init__(self, parts: Parts, opts: Options):
        self.parts, self.opts = parts, opts
        self.root = parts.xml("content.xml")
        self.styles: dict[str, set[str]] = {}
        for doc in (parts.optional("styles.xml"), self.root):
            for style in deep(doc, "style"):
                self.styles[attr(style, "name", "")] = self._look(first(style, "text-properties"))

    @staticmethod
    def _look(props: ET.Element | None) -> set[str]:
        seen = {
            "bold": re.search("bold|[6-9]00", attr(props, "font-weight", "")),
            "italic": re.search("italic|oblique", attr(props, "font-style", "")),
            "underline": attr(props, "text-underline-style", "none") != "none",
            "strike": attr(props, "text-line-through-style", "none") != "none",
            "mono": re.search("(?i)mono|courier", attr(props, "font-name", "")),
        }
        return {k for k, v in seen.items() if v}

    def runs(self, node: ET.Element, look: frozenset = frozenset(), link: str | None = None) -> list[tuple[str, set[str], str | None]]:
        out = [(node.text, set(look), link)] if node.text else []
        for child in node:
            tag = local(child.tag)
            if tag == "span":
                out += self.runs(child, look | self.styles.get(attr(child, "style-name", ""), set()), link)
            elif tag == "a":
                out += self.runs(child, look, attr(child, "href") or "#")
            elif tag == "s":
                out.append((" " * min(int(attr(child, "c", "1")), BLANKS), set(look), link))
            elif tag == "tab":
                out.append((" ", set(look), link))
            elif tag == "line-break":
                out.append(("\n", set(look), link))
            elif tag == "note":
                body = first(child, "note-body")
                if body is not None:
                    out += [(" ", set(look), link), (f"({tree.collapsed(text(body))})", {"italic"}, None)]
            elif tag not in ("frame", "annotation"):
                out += self.runs(child, look, link)
            if child.tail:
                out.append((child.tail, set(look), link))
        return out

    def plain(self, node: ET.Element) -> str:
        return "".join(t for t, _, _ in self.runs(node))

    def image(self, frame: ET.Element) -> list[Block]:
        href = attr(first(frame, "image"), "href") if self.opts.imageMode != "strip" else None
        found = self.parts.image(re.sub(r"^\./", "", href), text(first(frame, "title")) or attr(frame, "name", ""), self.opts.maxImageBytes) if href else None
        return [found] if found else []

    def flow(self, node: ET.Element) -> list[Block]:
        out: list[Block] = []
        for child in node:
            tag = local(child.tag)
            if tag in ("h", "p"):
                level = min(6, max(1, int(attr(child, "outline-level", "1")))) if tag == "h" else None
                out += from_runs(self.runs(child), self.opts, level) if self.plain(child).strip() else []
                out += [i for f in deep(child, "frame") for i in self.image(f)]
            elif tag == "list":
                ordered = bool(re.search("(?i)number|alpha|roman", attr(child, "style-name", "")))
                items = self.items(child, 0)
                out += [nested(items, ordered)] if items else []
            elif tag == "table":
                out += self.text_table(child)
            elif tag == "section":
                out += self.flow(child)
            elif tag == "frame":
                out += self.image(child)
        return out

    def items(self, node: ET.Element, level: int) -> list[tuple[int, str, str]]:
        out = []
        for item in kids(node, "list-item"):
            own = [b for c in kids(item, "p", "h") for b in from_runs(self.runs(c), self.opts) if self.plain(c).strip()]
            out.append((level, " ".join(b.text for b in own), " ".join((b.markdown or "").replace("  \n", " ") for b in own)))
            for sub in kids(item, "list"):
                out += self.items(sub, level + 1)
        return out

    def text_table(self, node: ET.Element) -> list[Block]:
        rows = []
        for row in deep(node, "table-row"):
            cells: list[str] = []
            for cell in kids(row, "table-cell"):
                cells += [self.lines(cell)] * min(TEXT_COLUMNS, int(attr(cell, "number-columns-repeated", "1")))
            while cells and not cells[-1]:
                cells.pop()
            rows.append(cells)
        rows = [r for r in rows if any(r)]
        return [table(rows[0], rows[1:])] if rows else []

    def lines(self, cell: ET.Element) -> str:
        return "; ".join(x for x in (tree.collapsed(self.plain(p)) for p in kids(cell, "p")) if x)

    def value(self, cell: ET.Element) -> str:
        kind = attr(cell, "value-type")
        if kind in ("date", "time"):
            return attr(cell, f"{kind}-value", "")
        if kind == "boolean":
            return "TRUE" if attr(cell, "boolean-value") == "true" else "FALSE"
        if kind in ("float", "currency", "percentage"):
            return "".join(text(p) for p in kids(cell, "p")) or attr(cell, "value", "")
        return self.lines(cell)

    def sheets(self) -> list[Block]:
        out = []
        for sheet in deep(self.root, "table"):
            rows: list[list[str]] = []
            for row in deep(sheet, "table-row"):
                cells: list[str] = []
                for cell in kids(row, "table-cell", "covered-table-cell"):
                    cells += [self.value(cell)] * min(SHEET_COLUMNS, int(attr(cell, "number-columns-repeated", "1")))
                while cells and not cells[-1]:
                    cells.pop()
                times = min(SHEET_ROWS, int(attr(row, "number-rows-repeated", "1")))
                if cells or times == 1:  # repeated blank rows only fill the sheet up
                    rows += [cells] * min(times, self.opts.maxSheetRows - len(rows))
            while rows and not any(rows[-1]):
                rows.pop()
            if rows:
                out += [heading(2, attr(sheet, "name") or "Sheet"), table(rows[0], rows[1:])]
        return out

    def slides(self) -> list[Block]:
        out = []
        for n, page in enumerate(deep(self.root, "page"), 1):
            out.append(heading(2, attr(page, "name") or f"Slide {n}"))
            for frame in deep(page, "frame"):
                box = first(frame, "text-box")
                out += self.flow(box) if box is not None else self.image(frame)
        return out


@register("odt", "ods", "odp")
def read_open_document(content: bytes, name: str, ext: str, opts: Options) -> Document:
    parts = Parts(content)
    if "content.xml" not in parts:
        raise ValueError("This OpenDocument file has no content.xml.")
    reader, about = _Reader(parts, opts), parts.optional("meta.xml")
    of = lambda tag: text(first(about, tag)).strip() or None
    body = first(reader.root, "text", "spreadsheet", "presentation")
    kind = {"spreadsheet": "ods", "presentation": "odp"}.get(local(body.tag) if body is not None else "", "odt")
    blocks = reader.sheets() if kind == "ods" else reader.slides() if kind == "odp" else reader.flow(body) if body is not None else []
    return Document(blocks or [paragraph("(empty document)")], {"kind": kind, "title": of("title"), "author": of("initial-creator"), "created": of("creation-date")})
