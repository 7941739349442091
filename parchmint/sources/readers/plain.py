"""Text, Markdown, source code and delimited files."""

from __future__ import annotations

import csv
import io
import re

from ...options import Options
from .. import tree
from ..blocks import Block, Document, capped, code, listing, paragraph, table
from . import register

# The language of a fence by file extension, and separators by file extension.
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cs": "csharp", "php": "php", "sh": "bash", "sql": "sql", "css": "css", "ini": "ini", "conf": "ini", "toml": "toml", "swift": "swift", "kt": "kotlin", "r": "r",
}
SEPARATORS = {"csv": ",", "tsv": "\t", "psv": "|"}
NUMERIC = re.compile(r"^-?[0-9.,]+$")


def decoded(content: bytes, charset: str | None = None) -> str:
    """Text of bytes: UTF-8 unless a byte order mark or `charset` says otherwise; what doesn't decode is replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    try:
        return content.decode(charset or "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def text_blocks(text: str) -> list[Block]:
    """A paragraph between blank lines, its line breaks kept."""
    parts = re.split(r"\n{2,}", re.sub(r"\r\n?", "\n", text))
    return [paragraph(p.strip()) for p in parts if p.strip()]


@register("text")
def read_text(content: bytes, name: str, ext: str, opts: Options) -> Document:
    return Document(text_blocks(decoded(content)), {"kind": "text"})


@register("code")
def read_code(content: bytes, name: str, ext: str, opts: Options) -> Document:
    language = LANGUAGES.get(ext, ext)
    return Document([code(decoded(content), language)], {"kind": "code", "language": language})


def front_matter(source: str) -> tuple[dict[str, str], str]:
    """key: value lines between two --- at the start, edge quotes off, and the rest."""
    m = re.match(r"---\r?\n(.*?)\r?\n---(?:\r?\n|$)", source, re.S)
    if not m:
        return {}, source
    found = re.findall(r"^([A-Za-z0-9_-]+)[ \t]*:[ \t]*(.*?)\r?$", m[1], re.M)
    return {k: re.sub(r"^['\"]|['\"]$", "", v) for k, v in found}, source[m.end() :]


@register("markdown")
def read_markdown(content: bytes, name: str, ext: str, opts: Options) -> Document:
    meta, body = front_matter(decoded(content))
    return Document(markdown_blocks(body), {"kind": "markdown", **meta}, native=body)


def markdown_blocks(body: str) -> list[Block]:
    """Blocks of Markdown: headings, fences, lists, pipe tables, quotes, rules and paragraphs. Inline signs stay in `markdown` and go from `text`."""
    lines = re.sub(r"\r\n?", "\n", body).split("\n")
    out: list[Block] = []
    held: list[str] = []
    kind = ""

    def flush() -> None:
        nonlocal kind
        if kind == "paragraph":
            joined = "\n".join(x.strip() for x in held)
            out.append(Block("paragraph", plain_inline(joined), joined))
        elif kind == "list":
            items = [re.match(r"^(\s*)(?:[-*+]|(\d+)[.)])\s+(.*)$", x, re.S) for x in held]
            out.append(listing([(len(m[1].expandtabs(4)) // 2, plain_inline(m[3])) for m in items], bool(items[0][2])))
            out[-1].items = [(i[0], i[1], m[3]) for i, m in zip(out[-1].items, items)]
        elif kind == "quote":
            inner = markdown_blocks("\n".join(re.sub(r"^\s*> ?", "", x) for x in held))
            out.append(Block("quote", " ".join(b.text for b in inner if b.text), "\n\n".join(b.markdown or b.text for b in inner)))
        elif kind == "table":
            rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||\|\s*$", "", x))] for x in held]
            out.append(table([plain_inline(c) for c in rows[0]], [[plain_inline(c) for c in r] for r in rows[2:]]))
        held.clear()
        kind = ""

    i = 0
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"^\s{0,3}(`{3,}|~{3,})\s*([\w+-]*)", line)
        if fence:
            flush()
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^\s{{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[j])), len(lines))
            out.append(code("\n".join(lines[i + 1 : end]), fence[2]))
            i = end + 1
            continue
        m = re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        under = re.match(r"^\s{0,3}(=+|-+)\s*$", line) if kind == "paragraph" else None
        if under:  # a line of = or - makes the paragraph above it a heading
            title = " ".join(x.strip() for x in held)
            held.clear()
            kind = ""
            out.append(Block("heading", plain_inline(title), title, level=1 if under[1][0] == "=" else 2))
            i += 1
            continue
        new = (
            "" if not line.strip() else "heading" if m else "rule" if re.match(r"^\s{0,3}([-*_])(\s*\1){2,}\s*$", line) else "quote" if re.match(r"^\s{0,3}>", line)
            else "list" if re.match(r"^\s*(?:[-*+]|\d+[.)])\s+\S", line) else "table" if kind == "table" or "|" in line and i + 1 < len(lines) and re.match(r"^[\s|:-]*-[\s|:-]*$", lines[i + 1]) and "|" in lines[i + 1]
            else "paragraph"
        )
        if kind == "table" and "|" not in line:
            new = new if new != "table" else "paragraph"
        if kind == "list" and new == "paragraph" and held:
            held[-1] += " " + line.strip()
        elif new in ("heading", "rule"):
            flush()
            out.append(Block("heading", plain_inline(m[2]), m[2], level=len(m[1])) if m else Block("divider"))
        else:
            if new != kind:
                flush()
            if new:
                kind = new
                held.append(line)
        i += 1
    flush()
    return out


def plain_inline(md: str) -> str:
    """Text of inline Markdown."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", md)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"<((?:https?|mailto):[^>]+)>", r"\1", text)
    text = re.sub(r"(\*\*|__|~~|==)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text)
    return tree.collapsed(re.sub(r"\\([\\`*_{}\[\]()#+\-.!|>])", r"\1", re.sub(r"`+([^`]*)`+", r"\1", text)))


# ---------------------------------------------------------------- delimited files


def sniffed(text: str) -> str:
    """The separator that splits the first ten filled lines most evenly, into two fields at least; else a comma."""
    best, found = (0.0, 0.0), ","
    sample = [x for x in text.split("\n")[:40] if x.strip()][:10]
    for sep in (",", "\t", "|", ";"):
        widths = [len(r) for r in csv.reader(sample, delimiter=sep) if r]
        if widths and min(widths) > 1:
            spread = sum(abs(a - b) for a, b in zip(widths, widths[1:]))
            if (score := (-spread, sum(widths) / len(widths))) > best or best == (0.0, 0.0):
                best, found = score, sep
    return found


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first of several rows is a header: every cell filled, none a number."""
    return len(rows) > 1 and all(c != "" and not NUMERIC.match(c) for c in rows[0])


@register("csv")
def read_csv(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """Rows of a delimited file as a table; blank rows go, short ones are filled up, a file with no header gets Column 1 ..."""
    text = re.sub(r"\r\n?", "\n", decoded(content)).strip()
    sep = SEPARATORS.get(ext) or (sniffed(text) if text else ",")
    warnings = []
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    warnings += [f"Row {i}: {len(r)} fields, expected {len(rows[0])}" for i, r in enumerate(rows) if len(r) != len(rows[0])]
    warnings = capped(warnings, 5, "...and {} more parse warnings.")
    if len(rows) > opts.maxSheetRows:
        warnings.append(f"Truncated to {opts.maxSheetRows} of {len(rows)} rows (raise maxSheetRows).")
        rows = rows[: opts.maxSheetRows]
    if not rows:
        return Document([paragraph("(empty file)")], {"kind": "csv"}, warnings)
    rows = [[c.strip() for c in r] + [""] * (width - len(r)) for r in rows]
    real = has_header(rows)
    head, body = (rows[0], rows[1:]) if real else ([f"Column {i + 1}" for i in range(width)], rows)
    return Document([table(head, body)], {"kind": "csv", "rows": len(body), "columns": width, "delimiter": sep}, warnings)


# ---------------------------------------------------------------- subtitles

_TIME = r"((?:\d{1,2}:)?\d{1,2}:\d{2})[.,]\d{1,3}"
CUE_TIMES = re.compile(rf"{_TIME}\s*-->\s*{_TIME}")


def clock(time: str) -> str:
    """hh:mm:ss of a cue's time."""
    parts = time.split(":")
    return ":".join(p.zfill(2) for p in ["0", *parts][-3:])


def seconds(time: str) -> int:
    h, m, s = map(int, time.split(":"))
    return 3600 * h + 60 * m + s


def cues(text: str) -> list[tuple[str, str]]:
    """(start, text) of each cue of an SRT or VTT file; tags and style overrides go."""
    out = []
    for part in re.split(r"\n{2,}", re.sub(r"\r\n?", "\n", text)):
        lines = [x for x in part.split("\n") if x.strip() and not re.match(r"(?i)WEBVTT", x)]
        at = next((i for i, x in enumerate(lines) if CUE_TIMES.search(x)), None)
        if at is not None:
            body = tree.collapsed(re.sub(r"\{\\[^}]*\}", "", re.sub(r"<[^>]+>", "", " ".join(lines[at + 1 :]))))
            if body:
                out.append((clock(CUE_TIMES.search(lines[at])[1]), body))
    return out


class Transcript:
    """Cues in order -> paragraphs. A paragraph ends when a cue starts over 20 s after it and its last words end a sentence, or over 45 s after it; a cue that repeats the words before it adds none.

    The words before a cue that opens a paragraph are still those of the paragraph it closed. State is (start, last words), so a stream can carry it."""

    def __init__(self, start: float | None = None, last: str | None = None):
        self.start, self.last = start, last

    def add(self, at: float, text: str) -> tuple[bool, bool]:
        """(opens a paragraph, its words count)."""
        late, before = (at - self.start if self.start is not None else 0), self.last
        opens = self.start is None or late > 45 or late > 20 and bool(before) and bool(re.search(r"[.!?][\"')\]]?$", before))
        if opens:
            self.start, self.last = at, None
        counts = text != before
        if counts:
            self.last = text
        return opens, counts


def transcript(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    fold = Transcript()
    for at, text in found:
        opens, counts = fold.add(seconds(at), text)
        if opens:
            out.append((at, []))
        if counts:
            out[-1][1].append(text)
    return [(at, " ".join(p)) for i, (at, p) in enumerate(out) if p or i < len(out) - 1]


@register("subtitles")
def read_subtitles(content: bytes, name: str, ext: str, opts: Options) -> Document:
    found = cues(decoded(content))
    if not found:
        return Document([paragraph("(no subtitle cues found)")], {"kind": "subtitles"}, ["No cues could be parsed from this subtitle file."])
    blocks = []
    for at, text in transcript(found):
        block = paragraph(f"{at} {text}")
        block.markdown = re.sub(r"^\S+", lambda m: f"**{m[0]}**", block.markdown)
        blocks.append(block)
    return Document(blocks, {"kind": "subtitles", "cues": len(found), "duration": found[-1][0]})


