"""JSON, JSON lines, YAML and XML: flat records become a table, all else lists and headings."""

from __future__ import annotations

import json
import re

from ...options import Options
from ..blocks import Block, Document, capped, code, heading, listing, paragraph, table
from . import register
from .plain import decoded

#: Values nested deeper are kept as JSON; tables with more columns aren't tables.
DEEPEST, WIDEST = 6, 24


def shown(value) -> str:
    """A scalar as JSON writes it, texts without quotes."""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    try:
        return json.dumps(value, ensure_ascii=False)
    except TypeError:
        return str(value)


def as_table(items: list, opts: Options) -> Block | None:
    """Two or more flat records as a table: columns in the order in which they are first seen, null and missing as empty."""
    if len(items) < 2 or not all(isinstance(v, dict) for v in items) or any(isinstance(x, (dict, list)) for v in items for x in v.values()):
        return None
    columns = list(dict.fromkeys(str(k) for v in items for k in v))
    if not 0 < len(columns) <= WIDEST:
        return None
    keyed = [{str(k): x for k, x in v.items()} for v in items[: opts.maxSheetRows]]
    return table(columns, [["" if v.get(c) is None else shown(v[c]) for c in columns] for v in keyed])


def value_blocks(value, opts: Options, depth: int = 0) -> list[Block]:
    level = min(6, depth + 2)
    if not isinstance(value, (dict, list)):
        return [paragraph(shown(value))]
    if not value:
        return [paragraph("(empty list)" if isinstance(value, list) else "(empty object)")]
    if isinstance(value, list):
        if found := as_table(value, opts):
            return [found]
        if not any(isinstance(v, (dict, list)) for v in value):
            return [listing([(0, shown(v)) for v in value])]
    if depth >= DEEPEST:
        return [code(json.dumps(value, indent=2, ensure_ascii=False, default=str), "json")]
    out, pairs = [], [(f"Item {i + 1}", v) for i, v in enumerate(value)] if isinstance(value, list) else [(str(k), v) for k, v in value.items()]
    if isinstance(value, dict):
        plain = [(k, shown(v)) for k, v in pairs if not isinstance(v, (dict, list))]
        if plain:
            out.append(listing([(0, f"{k}: {v}") for k, v in plain]))
            out[-1].items = [(0, t, md.replace(md_key, f"**{md_key}**", 1)) for (_, t, md), md_key in zip(out[-1].items, (listing([(0, f"{k}:")]).items[0][2] for k, _ in plain))]
        pairs = [(k, v) for k, v in pairs if isinstance(v, (dict, list))]
    for key, inner in pairs:
        out += [heading(level, key), *value_blocks(inner, opts, depth + 1)]
    return out


@register("json")
def read_json(content: bytes, name: str, ext: str, opts: Options) -> Document:
    text = decoded(content)
    try:
        return Document(value_blocks(json.loads(text), opts), {"kind": "json"})
    except ValueError as e:
        return Document([code(text, "json")], {"kind": "json"}, [f"Not valid JSON ({e}): kept verbatim."])


@register("jsonl")
def read_jsonl(content: bytes, name: str, ext: str, opts: Options) -> Document:
    records, bad = [], []
    for i, line in enumerate(re.split(r"\r?\n", decoded(content)), 1):
        if line.strip():
            try:
                records.append(json.loads(line))
            except ValueError:
                bad.append(f"Line {i} is not valid JSON: skipped.")
    # many bad lines are counted after the first five
    return Document(value_blocks(records, opts), {"kind": "jsonl"}, capped(bad, 5, "...and {} more bad lines."))


@register("yaml")
def read_yaml(content: bytes, name: str, ext: str, opts: Options) -> Document:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the module yaml") from e

    text = decoded(content)
    try:
        docs = list(yaml.safe_load_all(text))
    except yaml.YAMLError as e:
        return Document([code(text, "yaml")], {"kind": "yaml"}, [f"Not valid YAML ({str(e).splitlines()[0]}): kept verbatim."])
    return Document(value_blocks(docs[0] if len(docs) == 1 else docs, opts), {"kind": "yaml"})


def pretty_xml(text: str) -> str:
    """XML with an indent for each level; an element that holds text alone stays on one line."""
    tokens = [t.strip() for t in re.findall(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^>]+>|[^<]+", re.sub(r">\s+<", "><", text).strip(), re.S)]
    tokens = [t for t in tokens if t]
    out, depth, i = [], 0, 0
    while i < len(tokens):
        t = tokens[i]
        opens = t.startswith("<") and t[1] not in "/?!" and not t.endswith("/>")
        if t.startswith("</"):
            depth -= 1
        if opens and i + 2 < len(tokens) and not tokens[i + 1].startswith("<") and tokens[i + 2].startswith("</"):
            t, i = t + tokens[i + 1] + tokens[i + 2], i + 2
            opens = False
        out.append("  " * max(0, depth) + t)
        depth += opens
        i += 1
    return "\n".join(out) if out else text


@register("xml")
def read_xml(content: bytes, name: str, ext: str, opts: Options) -> Document:
    return Document([code(pretty_xml(decoded(content)), "xml")], {"kind": "xml"})
