"""Readers of one file each: (content, name, ext, options) -> Document. READERS maps a kind to its reader; `register` adds one."""

from __future__ import annotations

from collections.abc import Callable

from ...options import Options
from ..blocks import Document

Reader = Callable[[bytes, str, str, Options], Document]
READERS: dict[str, Reader] = {}


def register(*kinds: str):
    """Make a function the reader of these kinds."""

    def add(f: Reader) -> Reader:
        for kind in kinds:
            READERS[kind] = f
        return f

    return add


def load() -> dict[str, Reader]:
    """All readers of this package."""
    from . import mail, notebook, office, opendocument, plain, records, rich, web  # noqa: F401

    return READERS
