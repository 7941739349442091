"""HTML pages: metadata, the article or the page without its chrome, absolute links."""

from __future__ import annotations

import re

from ...options import Options
from .. import tree
from ..blocks import Block, Document, from_tree, md_escaped
from . import register
from .plain import decoded

#: Markup of an article that is too short to be one.
SHORTEST = 200


def page_document(html: str, opts: Options, url: str | None = None) -> Document:
    """A page as blocks: the article if there is one (readability), else what remains without chrome; a title as the first heading unless there is one."""
    root = tree.parse(html)
    base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), None)
    base = tree.resolved(url, base) if url and base else url or base
    title = root.first("title")
    of = lambda *names: next((v for n in names if (v := tree.meta_content(root, n))), None)
    meta = {
        "kind": "html", "title": title.text().strip() or None if title else None, "author": of("author", "article:author"), "description": of("description", "og:description"),
        "published": of("article:published_time", "date"), "source": url,
    }
    body, warnings = None, []
    if opts.readability:
        # the article is looked for before chrome goes, as an open <nav> may hold it
        body = tree.main_content(tree.without(tree.parse(html), lambda n: n.tag in ("script", "style", "noscript", "template", "head")))
        if body is not None and len(body.html()) <= SHORTEST:
            body = None
        if body is None:
            warnings.append("Article extraction found no main content: the full page was converted.")
        else:
            meta["siteName"] = of("og:site_name")
            body = tree.without(body, tree.is_chrome)
    if body is None:
        cleaned = tree.without(root, lambda n: tree.is_chrome(n) or n.tag in ("head", "title"))
        body = next((n for n in cleaned.walk() if n.tag in ("main", "article") or n.attrs.get("role") == "main"), cleaned)
    blocks = from_tree(tree.sanitized(tree.absolute(body, base)), opts)
    if meta["title"] and not any(b.type == "heading" and b.level == 1 for b in blocks):
        text = re.sub("[<>&]", "", meta["title"])
        blocks.insert(0, Block("heading", tree.collapsed(text), md_escaped(tree.collapsed(text)), level=1))
    return Document(blocks, meta, warnings)


@register("html")
def read_html(content: bytes, name: str, ext: str, opts: Options, url: str | None = None) -> Document:
    return page_document(decoded(content), opts, url)
