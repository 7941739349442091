"""Rich text: control words to styled paragraphs; larger short paragraphs are headings."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from ...options import Options
from ..blocks import Block, Document, from_runs, paragraph
from . import register

# Destinations without text of the document, and characters that control words stand for.
SKIPPED = set(
    "fonttbl colortbl stylesheet info pict object themedata colorschememapping latentstyles datastore generator listtable listoverridetable rsidtbl xmlnstbl filetbl "
    "header footer headerl headerr footerl footerr footnote ftnsep nonshppict".split()
)
CHARACTERS = {
    "line": "\n", "tab": " ", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•",
}
_TOKEN = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z'])|([{}])|([^\\{}\r\n]+)|[\r\n]+|\\")


@dataclass(frozen=True)
class _Look:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    size: int = 0
    skip: bool = False

    def styles(self) -> set[str]:
        return {n for n in ("bold", "italic", "underline") if getattr(self, n)}


def paragraphs(content: bytes) -> list[list[tuple[str, _Look]]]:
    """Runs of each paragraph."""
    out: list[list[tuple[str, _Look]]] = [[]]
    look, groups, page, fallback, pending = _Look(), [], "cp1252", 1, 0
    held = bytearray()  # bytes in the code page that wait to be decoded together

    def put(text: str) -> None:
        if text and not look.skip:
            out[-1].append((text, look))

    def settle() -> None:
        if held:
            put(bytes(held).decode(page, "replace"))
            held.clear()

    for m in _TOKEN.finditer(content):
        byte, word, number, sign, brace, text = m.groups()
        if byte:
            if pending:
                pending -= 1
            else:
                held.append(int(byte, 16))
            continue
        if text and pending:
            cut = min(pending, len(text))
            text, pending = text[cut:], pending - cut
        settle()
        n = int(number) if number else None
        if text:
            put(text.decode(page if page != "utf-8" else "cp1252", "replace"))
        elif brace == b"{":
            groups.append(look)
        elif brace:
            look = groups.pop() if groups else _Look()
        elif sign:
            if sign in b"\\{}":
                put(sign.decode())
            elif sign == b"*":
                look = replace(look, skip=True)
            elif sign in b"\r\n" and not look.skip:
                out.append([])
            elif sign == b"~":
                put(" ")
            elif sign == b"_":
                put("-")
        elif word:
            name = word.decode()
            if pending and name != "u":
                pending -= 1
            elif name in SKIPPED:
                look = replace(look, skip=True)
            elif name == "ansicpg":
                page = "utf-8" if n == 65001 else f"cp{n or 1252}"
                try:
                    b"".decode(page)
                except LookupError:
                    page = "cp1252"
            elif name == "uc":
                fallback = 1 if n is None else n
            elif name == "u":
                if n is not None:
                    put(chr(n % 65536))
                pending = fallback
            elif name in ("b", "i", "ul"):
                look = replace(look, **{{"b": "bold", "i": "italic", "ul": "underline"}[name]: n != 0})
            elif name == "ulnone":
                look = replace(look, underline=False)
            elif name == "plain":
                look = replace(look, bold=False, italic=False, underline=False)
            elif name == "fs":
                look = replace(look, size=n or 0)
            elif name in ("par", "page"):
                if not look.skip:
                    out.append([])
            elif name in CHARACTERS:
                put(CHARACTERS[name])
    settle()
    # two halves of a character beyond the first plane become one
    joined = [[(t.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), k) for t, k in _merged(p)] for p in out]
    return [p for p in joined if any(t.strip() for t, _ in p)]


def _merged(runs: list[tuple[str, _Look]]) -> list[tuple[str, _Look]]:
    out: list[tuple[str, _Look]] = []
    for text, look in runs:
        if out and out[-1][1] == look:
            out[-1] = (out[-1][0] + text, look)
        else:
            out.append((text, look))
    return out


def body_size(found: list[list[tuple[str, _Look]]]) -> int:
    """The upper median of the sizes, a run weighing a quarter of its characters."""
    weights: dict[int, int] = {}
    for text, look in (r for p in found for r in p):
        if look.size:
            weights[look.size] = weights.get(look.size, 0) + max(1, math.ceil(len(text) / 4))
    left = sum(weights.values()) // 2
    for size in sorted(weights):
        left -= weights[size]
        if left < 0:
            return size
    return 0


def heading_level(runs: list[tuple[str, _Look]], body: int) -> int | None:
    """Level of a paragraph of up to 120 characters by its largest size against the body's."""
    text, size = "".join(t for t, _ in runs).strip(), max((k.size for _, k in runs), default=0)
    if not text or len(text) > 120 or not size or not body:
        return None
    ratio = size / body
    return 1 if ratio >= 1.8 else 2 if ratio >= 1.45 else 3 if ratio >= 1.2 else 4 if ratio >= 1.08 and all(k.bold for _, k in runs) else None


@register("rtf")
def read_rich_text(content: bytes, name: str, ext: str, opts: Options) -> Document:
    found = paragraphs(content)
    body = body_size(found)
    blocks: list[Block] = []
    for runs in found:
        blocks += from_runs([(t, k.styles(), None) for t, k in runs], opts, heading_level(runs, body))
    return Document(blocks or [paragraph("(no readable text)")], {"kind": "rtf"})
