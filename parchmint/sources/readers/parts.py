"""Zipped XML parts: lookups that don't depend on prefixes, relationships, paths, images."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..blocks import IMAGE_TYPES, Block, data_url


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def deep(node: ET.Element | None, *names: str) -> Iterator[ET.Element]:
    """All elements of these local names below `node`, in document order."""
    if node is not None:
        for n in node.iter():
            if n is not node and local(n.tag) in names:
                yield n


def first(node: ET.Element | None, *names: str) -> ET.Element | None:
    return next(deep(node, *names), None)


def kids(node: ET.Element | None, *names: str) -> list[ET.Element]:
    """Direct children of these local names."""
    return [n for n in node if local(n.tag) in names] if node is not None else []


def attr(node: ET.Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name; one without a namespace comes first."""
    if node is None:
        return default
    if name in node.attrib:
        return node.attrib[name]
    return next((v for k, v in node.attrib.items() if local(k) == name), default)


def related(node: ET.Element | None) -> str | None:
    """The relationship id of an element (r:id, r:embed or r:link), not its own id."""
    return next((v for k, v in (node.attrib.items() if node is not None else ()) if k.startswith("{") and "relationships" in k), None)


def text(node: ET.Element | None) -> str:
    return "".join(node.itertext()) if node is not None else ""


def resolve(base: str, target: str | None) -> str | None:
    """Path of a part that a part at `base` names; a leading / starts at the root."""
    if not target:
        return None
    return target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(base), target)).lstrip("./")


class Parts:
    """The members of one zip file."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def __contains__(self, path: str | None) -> bool:
        return path in self.names

    def read(self, path: str) -> bytes:
        return self.zip.read(path)

    def xml(self, path: str) -> ET.Element:
        if path not in self.names:
            raise ValueError(f"Missing part: {path}")
        return ET.fromstring(self.read(path))

    def optional(self, path: str) -> ET.Element | None:
        try:
            return self.xml(path)
        except (ValueError, ET.ParseError):
            return None

    def relations(self, path: str) -> dict[str, tuple[str, bool]]:
        """Relationship id -> (target: a part's path or an address, whether it is external)."""
        folder, name = posixpath.split(path)
        root = self.optional(posixpath.join(folder, "_rels", f"{name}.rels"))
        out = {}
        for r in deep(root, "Relationship"):
            external = attr(r, "TargetMode") == "External"
            out[attr(r, "Id")] = (attr(r, "Target", "") if external else resolve(path, attr(r, "Target")) or "", external)
        return out

    def image(self, path: str | None, alt: str, most: int) -> Block | None:
        """An embedded image; None if it is missing or larger than `most` bytes."""
        if path not in self.names:
            return None
        content = self.read(path)
        if most and len(content) > most:
            return None
        mime = IMAGE_TYPES.get(path.rsplit(".", 1)[-1].lower(), "application/octet-stream")
        return Block("image", alt, src=data_url(content, mime), alt=alt)
