"""Typed blocks: what every reader returns and every emitter consumes."""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass, field
from html import escape
from urllib.parse import unquote_to_bytes

from ..options import Options
from . import tree
from .tree import Node, collapsed

#: One block; fields that don't apply to its type are null.
BLOCK = (
    "struct<idx:int,page:int,type:string,level:int,ordered:boolean,language:string,role:string,src:string,alt:string,text:string,markdown:string,"
    "items:array<struct<level:int,text:string,markdown:string>>,header:array<string>,rows:array<array<string>>,cells:array<array<string>>>"
)


@dataclass
class Block:
    """type: heading, paragraph, list, table, code, quote, divider, image or page (a page starts). markdown: inline Markdown; cells: all rows of a table, header first, as inline Markdown."""

    type: str
    text: str = ""
    markdown: str | None = None
    level: int | None = None
    page: int | None = None
    ordered: bool | None = None
    language: str | None = None
    role: str | None = None
    src: str | None = None
    alt: str | None = None
    items: list[tuple[int, str, str]] | None = None
    header: list[str] | None = None
    rows: list[list[str]] | None = None
    cells: list[list[str]] | None = None
    bold: bool = False  # a paragraph that is bold as a whole

    def row(self, idx: int) -> dict:
        items = [{"level": a, "text": b, "markdown": c} for a, b, c in self.items] if self.items is not None else None
        return {
            "idx": idx, "page": self.page, "type": self.type, "level": self.level, "ordered": self.ordered, "language": self.language, "role": self.role, "src": self.src,
            "alt": self.alt, "text": self.text, "markdown": self.text if self.markdown is None else self.markdown, "items": items, "header": self.header, "rows": self.rows, "cells": self.cells,
        }


@dataclass
class Document:
    """What a reader found in one file."""

    blocks: list[Block] = field(default_factory=list)
    meta: dict[str, object] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    native: str | None = None  # Markdown that is handed through as it is
    assets: list[tuple[str, str, bytes]] = field(default_factory=list)


def capped(warnings: list[str], most: int, more: str) -> list[str]:
    """The first `most` warnings and a count of the others."""
    return warnings if len(warnings) <= most else [*warnings[:most], more.format(len(warnings) - most)]


# ---------------------------------------------------------------- builders for readers without markup


def md_escaped(text: str) -> str:
    """Text whose Markdown signs stay what they are."""
    text = re.sub(r"([\\`*_\[\]])", r"\\\1", text)
    text = re.sub(r"^(\s*)([-+>]|#{1,6})(\s|$)", r"\1\\\2\3", text)
    return re.sub(r"^(\s*\d+)\.(\s)", r"\1\\.\2", text)


def paragraph(text: str, **more) -> Block:
    return Block("paragraph", collapsed(text), "  \n".join(md_escaped(x.strip()) for x in text.split("\n")), **more)


def heading(level: int, text: str) -> Block:
    return Block("heading", collapsed(text), md_escaped(collapsed(text)), level=min(6, max(1, level)))


def code(text: str, language: str | None) -> Block:
    return Block("code", text.rstrip("\n"), text.rstrip("\n"), language=language or None)


def table(header: list[str] | None, rows: list[list[str]], cells: list[list[str]] | None = None) -> Block:
    every = ([header] if header else []) + rows
    return Block("table", " ".join(collapsed(c) for r in every for c in r if c.strip()), header=header, rows=rows, cells=cells or [[md_cell(c) for c in r] for r in every])


def md_cell(text: str) -> str:
    return collapsed(text).replace("|", "\\|")


def listing(items: list[tuple[int, str]], ordered: bool = False) -> Block:
    return nested([(level, collapsed(t), md_escaped(collapsed(t))) for level, t in items], ordered)


def nested(items: list[tuple[int, str, str]], ordered: bool) -> Block:
    """A list whose items go at most one level deeper than the one before."""
    out, depth = [], -1
    for level, text, md in items:
        depth = max(0, min(level, depth + 1))
        out.append((depth, text, md))
    return Block("list", " ".join(t for _, t, _ in out if t), ordered=ordered, items=out)


# ---------------------------------------------------------------- from a tree

_WRAPPERS = {"div", "section", "article", "header", "footer", "main", "aside", "nav", "body", "html", "#root", "address", "dl", "form", "center", "details"}
_MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~", "mark": "=="}


def inline_markdown(node: Node, opts: Options, in_cell: bool = False) -> str:
    """Inline Markdown of an element's content. Markdown has no sign for sub, sup and u, so they stay markup."""
    out = []
    for child in node.children:
        if isinstance(child, str):
            text = tree.SPACES.sub(" ", child)
            text = re.sub(r"([\\`*_\[\]])", r"\\\1", text)
            out.append(text.replace("|", "\\|") if in_cell else text)
            continue
        tag, inner = child.tag, None
        if tag == "br":
            out.append("<br>" if in_cell else "  \n")
        elif tag == "img":
            if child.attrs.get("src"):
                out.append(f"![{re.sub(r'[\[\]]', '', child.attrs.get('alt', ''))}]({child.attrs['src']}{_title(child)})")
        elif tag in ("code", "kbd", "samp", "var"):
            inner = tree.SPACES.sub(" ", child.text())
            ticks = "`" * (max((len(x) for x in re.findall("`+", inner)), default=0) + 1)
            out.append(f"{ticks} {inner} {ticks}" if inner.startswith("`") or inner.endswith("`") else f"{ticks}{inner}{ticks}" if inner.strip() else "")
        elif tag == "a":
            out.append(_link(child, inline_markdown(child, opts, in_cell)))
        elif tag in _MARKS and not (tag in ("del", "s") and opts.mdFlavor == "commonmark"):
            inner = inline_markdown(child, opts, in_cell)
            bare = inner.strip()
            mark = _MARKS[tag]
            out.append(inner[: len(inner) - len(inner.lstrip())] + f"{mark}{bare}{mark}" + inner[len(inner.rstrip()) :] if bare else inner)
        elif tag in ("sub", "sup", "u"):
            inner = inline_markdown(child, opts, in_cell)
            out.append(f"<{tag}>{inner}</{tag}>" if inner.strip() else inner)
        elif "data-review" in child.attrs:
            out.append(f" <!-- REVIEW: {child.attrs['data-review']} -->")
        else:
            inner = inline_markdown(child, opts, in_cell)
            out.append(f" {inner} " if tag in tree.BLOCK_TAGS else inner)
    return "".join(out)


def _title(node: Node) -> str:
    return ' "{}"'.format(node.attrs["title"].replace('"', "")) if node.attrs.get("title") else ""


def _link(node: Node, content: str) -> str:
    href = node.attrs.get("href")
    if not href:
        return content
    plain = re.sub(r"\\([\\`*_{}\[\]()#+\-.!])", r"\1", content)
    text = (plain if re.match(r"(?i)(https?://|www\.|[\w-]+\.[a-z]{2,}(/|$))", plain) else content).strip()
    if not text:
        return ""
    if not node.attrs.get("title") and (text == href or f"{text}/" == href or href in (f"https://{text}", f"http://{text}")):
        return f"<{href}>"
    return f"[{text}]({href}{_title(node)})"


def cell_text(node: Node) -> str:
    """Text of a table cell; its line breaks become "; "."""
    parts = [" ; " if isinstance(c, Node) and c.tag == "br" else c if isinstance(c, str) else c.text() for c in node.children]
    text = re.sub(r"\s*;\s*", "; ", collapsed("".join(parts)))
    return re.sub(r"^;\s*|;\s*$", "", text).strip()


def _list_items(node: Node, level: int, opts: Options) -> list[tuple[int, str, str]]:
    out = []
    for li in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
        own = Node("li", children=[c for c in li.children if not (isinstance(c, Node) and c.tag in ("ul", "ol"))])
        out.append((level, collapsed(own.text()), tidy(inline_markdown(own, opts))))
        for sub in (c for c in li.children if isinstance(c, Node) and c.tag in ("ul", "ol")):
            out += _list_items(sub, level + 1, opts)
    return out


def tidy(md: str) -> str:
    return re.sub(r"[ \t]+$", "", re.sub(r"(?<!^)(?<! ) {2,}(?!\n)", " ", md.strip()), flags=re.M)


def _own_rows(node: Node) -> list[tuple[Node, bool]]:
    """Rows of a table and whether they stand in its head; rows of tables inside cells are not its own."""
    out = []
    for child in (c for c in node.children if isinstance(c, Node)):
        if child.tag == "tr":
            out.append((child, False))
        elif child.tag in ("thead", "tbody", "tfoot"):
            out += [(c, child.tag == "thead") for c in child.children if isinstance(c, Node) and c.tag == "tr"]
    return out


def table_block(node: Node, opts: Options) -> Block | None:
    rows = [([c for c in tr.children if isinstance(c, Node)], head) for tr, head in _own_rows(node)]
    if not rows:
        return None
    head = next((i for i, (_, h) in enumerate(rows) if h), None)
    texts = [[cell_text(c) for c in cells] for cells, _ in rows]
    mds = [[tidy(inline_markdown(c, opts, True)).replace("\n", " ") for c in cells] for cells, _ in rows]
    order = ([head] if head is not None else []) + [i for i in range(len(rows)) if i != head]
    header = texts[head] if head is not None else None
    return Block("table", collapsed(node.text()), header=header, rows=[texts[i] for i in order if i != head], cells=[mds[i] for i in order])


def from_tree(root: Node, opts: Options) -> list[Block]:
    """Blocks in reading order. Text that stands between blocks is a paragraph of its own."""
    out: list[Block] = []
    loose: list = []

    def flush() -> None:
        if loose:
            holder = Node("p", children=list(loose))
            loose.clear()
            emit_paragraph(holder)

    def emit_paragraph(node: Node) -> None:
        text, images = collapsed(node.text()), node.all("img") if node.tag != "img" else [node]
        if images and not text:
            out.extend(Block("image", i.attrs.get("alt", ""), src=i.attrs.get("src", ""), alt=i.attrs.get("alt", "")) for i in images)
        elif text:
            bold = [c for c in node.children if isinstance(c, Node) and c.tag in ("strong", "b")]
            out.append(Block("paragraph", text, tidy(inline_markdown(node, opts)), bold=bool(bold) and collapsed(bold[0].text()) == text))

    def visit(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or child.tag not in tree.BLOCK_TAGS | _WRAPPERS | {"caption"}:
                if isinstance(child, str) and not loose and not child.strip():
                    continue
                loose.append(child)
                continue
            flush()
            tag = child.tag
            if re.fullmatch("h[1-6]", tag):
                if text := collapsed(child.text()):
                    out.append(Block("heading", text, tidy(inline_markdown(child, opts)).replace("  \n", " "), level=int(tag[1])))
            elif tag in ("ul", "ol"):
                if items := _list_items(child, 0, opts):
                    out.append(nested(items, tag == "ol"))
            elif tag == "table":
                for caption in (c for c in child.children if isinstance(c, Node) and c.tag == "caption"):
                    if text := collapsed(caption.text()):
                        out.append(Block("paragraph", text, f"_{text}_", role="caption"))
                if block := table_block(child, opts):
                    out.append(block)
            elif tag == "pre":
                inner = child.first("code")
                language = re.search(r"language-([\w+-]+)", inner.attrs.get("class", "")) if inner else None
                out.append(code(child.text(), language and language[1]))
            elif tag == "blockquote":
                parts = from_tree(child, opts)
                if parts:
                    out.append(Block("quote", " ".join(b.text for b in parts if b.text), "\n\n".join(b.markdown if b.markdown is not None else b.text for b in parts), role=child.attrs.get("data-role")))
            elif tag == "hr":
                out.append(Block("page", page=int(child.attrs["data-page"])) if child.attrs.get("data-page", "").isdigit() else Block("divider"))
            elif tag == "figcaption":
                if text := collapsed(child.text()):
                    out.append(Block("paragraph", text, f"_{tidy(inline_markdown(child, opts))}_", role="caption"))
            elif tag == "p":
                emit_paragraph(child)
            else:
                visit(child)
        flush()

    visit(root)
    return out


# ---------------------------------------------------------------- structure repair

_GLYPH = re.compile(r"^[ \t\u00a0]*([•·▪◦‣∙◾▸►])[ \t\u00a0]+")
_DASH = re.compile(r"^[ \t\u00a0]*[-–—*][ \t\u00a0]+")
_ORDERED = re.compile(r"^[ \t\u00a0]*\(?(\d{1,3}|[a-zA-Z])[.)][ \t\u00a0]+")
#: Kinds whose files often look structured and aren't.
REPAIRABLE = {"docx", "rtf", "odt", "odp", "text", "eml", "mhtml"}


def marker(text: str) -> tuple[bool, int, bool] | None:
    """(ordered, length, glyph) of a list marker at the start of a paragraph; a dash or number that stands alone is none."""
    if m := _GLYPH.match(text):
        return False, m.end(), True
    for ordered, pattern in ((True, _ORDERED), (False, _DASH)):
        if (m := pattern.match(text)) and len(text) > m.end() + 1:
            return ordered, m.end(), False
    return None


def without_marker(md: str, length: int, text: str) -> str:
    """Inline Markdown without a marker of `length` characters of text, whatever emphasis or escapes stand around it."""
    left, i = text[:length].strip(), 0
    for char in left:
        while i < len(md) and md[i] != char:
            i += 1
        i += 1
    return re.sub(r"^\\?\s*", "", md[:i].replace(left, "").replace("\\", "").strip() + md[i:])


def repaired(blocks: list[Block]) -> list[Block]:
    """Short paragraphs that are bold as a whole become headings of level 2, runs of paragraphs with a list marker become lists."""
    out: list[Block] = []
    run: list[tuple[Block, tuple[bool, int, bool]]] = []

    def flush() -> None:
        if len(run) > 1 or run and run[0][1][2]:
            items = [(0, b.text[m[1] :].strip(), without_marker(b.markdown or b.text, m[1], b.text)) for b, m in run]
            out.append(nested(items, run[0][1][0]))
        else:
            out.extend(b for b, _ in run)
        run.clear()

    for b in blocks:
        found = marker(b.text) if b.type == "paragraph" else None
        if found and run and run[0][1][0] != found[0]:
            flush()
        if found:
            run.append((b, found))
            continue
        flush()
        if b.type == "paragraph" and b.bold and 0 < len(b.text) <= 90 and not re.search(r"[.,;:]$", b.text):
            out.append(Block("heading", b.text, re.sub(r"^\*\*(.*)\*\*$", r"\1", b.markdown or b.text), level=2))
        else:
            out.append(b)
    flush()
    return out


# ---------------------------------------------------------------- images

# Extensions of image types.
IMAGE_EXTENSIONS = {
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp", "image/tiff": "tiff", "image/x-emf": "emf", "image/emf": "emf",
}
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/emf"}


def data_url(content: bytes, mime: str) -> str:
    return f"data:{mime};base64,{base64.b64encode(content).decode()}"


def parsed_data_url(src: str) -> tuple[str, bytes] | None:
    m = re.match(r"data:([^;,]+)?(;base64)?,(.*)$", src, re.S)
    if not m:
        return None
    try:
        return m[1] or "application/octet-stream", base64.b64decode(m[3], validate=True) if m[2] else unquote_to_bytes(m[3])
    except (binascii.Error, ValueError):
        return None


def safe_name(name: str) -> str:
    """A file name without what file systems refuse."""
    return re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\x00-\x1f]+', "-", name)).strip(" .") or "document"


def with_image_policy(doc: Document, opts: Options, base: str) -> Document:
    """Images as the options want them: strip removes all; link removes embedded ones, extract moves them to files, embed keeps them up to a size. What goes leaves its description."""
    removed = 0

    def place(src: str, alt: str) -> str | None:
        """The new source, or None if the image goes."""
        if opts.imageMode == "strip":
            return None
        if not src.startswith("data:"):
            return src
        found = parsed_data_url(src)
        if not found or len(found[1]) > (opts.maxImageBytes or float("inf")) or opts.imageMode == "link":
            return None
        if opts.imageMode != "extract":
            return src
        path = f"{safe_name(base)}_assets/image-{len(doc.assets) + 1:03d}.{IMAGE_EXTENSIONS.get(found[0], 'bin')}"
        doc.assets.append((path, *found))
        return path

    def inline(md: str) -> str:
        def swap(m: re.Match) -> str:
            nonlocal removed
            src = place(m[2], m[1])
            if src is None:
                removed += 1
                return f"[image: {m[1].strip()}]" if m[1].strip() else ""
            return f"![{m[1]}]({src}{m[3] or ''})"

        return re.sub(r'!\[([^\]]*)\]\(([^)\s]+)( "[^"]*")?\)', swap, md) if "![" in md else md

    kept = []
    for b in doc.blocks:
        if b.type == "image":
            src = place(b.src or "", b.alt or "")
            if src is None:
                removed += 1
                if not (b.alt or "").strip():
                    continue
                b = Block("paragraph", f"[image: {b.alt.strip()}]", f"\\[image: {b.alt.strip()}\\]", page=b.page)
            else:
                b.src = src
        if b.markdown:
            b.markdown = inline(b.markdown)
        if b.items:
            b.items = [(level, t, inline(md)) for level, t, md in b.items]
        if b.cells:
            b.cells = [[inline(c) for c in r] for r in b.cells]
        kept.append(b)
    doc.blocks = kept
    if doc.native:
        doc.native = inline(doc.native)
    if removed:
        doc.warnings.append(f"{removed} image(s) were removed (image mode: strip)." if opts.imageMode == "strip" else f"{removed} embedded image(s) were dropped: they exceeded the size limit or the image mode leaves them out.")
    return doc


def inline_html(runs: list[tuple[str, set[str], str | None]]) -> str:
    """Runs of (text, styles, link) as markup, nested code, bold, italic, strike, underline, link from the inside out."""
    out = []
    for text, styles, href in runs:
        piece = escape(text, quote=False).replace("\n", "<br>")
        if piece.strip():
            for style, tag in (("mono", "code"), ("bold", "strong"), ("italic", "em"), ("strike", "s"), ("underline", "u")):
                if style in styles:
                    piece = f"<{tag}>{piece}</{tag}>"
            if href:
                piece = f'<a href="{escape(href)}">{piece}</a>'
        out.append(piece)
    return "".join(out)


def from_runs(runs: list[tuple[str, set[str], str | None]], opts: Options, level: int | None = None) -> list[Block]:
    """A paragraph (or heading) of styled runs; neighbours of one style are one run."""
    merged: list[tuple[str, set[str], str | None]] = []
    for text, styles, href in runs:
        if merged and merged[-1][1:] == (styles, href):
            merged[-1] = (merged[-1][0] + text, styles, href)
        elif text:
            merged.append((text, styles, href))
    tag = f"h{level}" if level else "p"
    return from_tree(tree.parse(f"<{tag}>{inline_html(merged)}</{tag}>"), opts)
