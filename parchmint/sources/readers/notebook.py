"""Notebooks: Markdown cells as they are, code in fences, outputs as text, images or markup."""

from __future__ import annotations

import json
import re

from ...options import Options
from ..blocks import Document
from . import register
from .plain import decoded, markdown_blocks


def joined(value) -> str:
    return "".join(map(str, value)) if isinstance(value, list) else "" if value is None else str(value)


def fence(text: str, language: str) -> str:
    """Code in a fence longer than any run of backticks in it."""
    ticks = "`" * max(3, max((len(x) for x in re.findall("`+", text)), default=0) + 1)
    return f"{ticks}{language}\n{text}\n{ticks}"


def without_ansi(text: str) -> str:
    return re.sub(r"\x1b?\[[0-9;]*m", "", text)


def output(found: dict, opts: Options, warnings: list[str]) -> str:
    kind = found.get("output_type")
    if kind == "stream":
        text = joined(found.get("text")).rstrip()
        return fence(text, "text") if text else ""
    if kind == "error":
        trace = without_ansi("\n".join(found.get("traceback") or []))
        return fence(trace or f"{found.get('ename')}: {found.get('evalue')}", "text")
    data = found.get("data") or {} if kind in ("execute_result", "display_data") else {}
    for mime in ("image/png", "image/jpeg"):
        if data.get(mime) and opts.imageMode != "strip":
            return f"![output](data:{mime};base64,{re.sub(r'\s', '', joined(data[mime]))})"
    if data.get("text/markdown"):
        return joined(data["text/markdown"]).strip()
    if data.get("text/html"):
        warnings.append("An HTML output (often a table) was kept as markup.")
        return joined(data["text/html"]).strip()
    return fence(joined(data["text/plain"]).rstrip(), "text") if data.get("text/plain") else ""


@register("ipynb")
def read_notebook(content: bytes, name: str, ext: str, opts: Options) -> Document:
    try:
        book = json.loads(decoded(content))
    except ValueError as e:
        raise ValueError(f"This notebook is not valid JSON ({e}).") from e
    meta, warnings, parts = book.get("metadata") or {}, [], []
    language = (meta.get("language_info") or {}).get("name") or (meta.get("kernelspec") or {}).get("language") or "python"
    cells = book.get("cells") or ((book.get("worksheets") or [{}])[0]).get("cells") or []
    for cell in cells:
        source, kind = joined(cell.get("source", cell.get("input"))), cell.get("cell_type")
        if source.strip():
            parts += [source.strip()] if kind == "markdown" else [fence(source.rstrip(), language)] if kind == "code" else [fence(source.rstrip(), "")] if kind == "raw" else []
        if kind == "code":
            parts += [x for x in (output(o, opts, warnings) for o in cell.get("outputs") or []) if x]
    native = "\n\n".join(parts)
    return Document(markdown_blocks(native), {"kind": "ipynb", "language": language, "cells": len(cells), "title": meta.get("title")}, warnings, native)
