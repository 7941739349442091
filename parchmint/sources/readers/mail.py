"""Mail and saved web archives: MIME trees by the standard parser."""

from __future__ import annotations

import re
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from urllib.parse import unquote

from ...options import Options
from ..blocks import Document, data_url, heading, listing, table
from . import register
from .plain import decoded, text_blocks
from .web import page_document


def header(message: Message, name: str) -> str | None:
    """A header unfolded, with its encoded words decoded; None if missing."""
    raw = message.get(name)
    if raw is None:
        return None
    parts = []
    for text, charset in decode_header(re.sub(r"\r?\n[ \t]+", " ", str(raw))):
        parts.append(decoded(text, charset) if isinstance(text, bytes) else text)
    return "".join(parts).strip()


def part_text(part: Message) -> str:
    """Text of a part; UTF-8 where its charset is unknown."""
    return decoded(part.get_payload(decode=True) or b"", part.get_content_charset())


def leaves(message: Message) -> list[Message]:
    return [p for p in message.walk() if not p.is_multipart()]


def attached(part: Message) -> bool:
    return "attachment" in (part.get("Content-Disposition") or "").lower()


def body_of(message: Message) -> Message | None:
    """The richest text: HTML before plain text, parts in the body before attachments."""
    inline = [p for p in leaves(message) if not attached(p)]
    for kind in ("text/html", "text/plain"):
        for p in inline:
            if p.get_content_type() == kind:
                return p
    return next((p for p in leaves(message) if p.get_content_maintype() == "text"), None)


@register("eml")
def read_mail(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """Subject as a heading, a table of the headers, the body, a list of attachments."""
    message = message_from_bytes(content)
    body, warnings, subject = body_of(message), [], header(message, "Subject")
    rows = [[k, v] for k in ("From", "To", "Cc", "Date", "Subject") if (v := header(message, k))]
    blocks = [heading(1, subject or "(no subject)")]
    if rows:
        blocks.append(table(None, rows))
    if body is None:
        warnings.append("No readable body part was found in this message.")
    elif body.get_content_type() == "text/html":
        found = page_document(part_text(body), opts.but(readability=False))
        blocks, warnings = blocks + found.blocks, warnings + found.warnings
    else:
        blocks += text_blocks(part_text(body))
    files = [(p.get_filename() or "attachment", p.get_content_type()) for p in message.walk() if attached(p)]
    if files:
        blocks += [heading(2, "Attachments"), listing([(0, f"{n} ({t})") for n, t in files])]
    return Document(blocks, {"kind": "eml", "title": subject, "author": header(message, "From"), "created": header(message, "Date"), "attachments": len(files)}, warnings)


@register("mhtml")
def read_web_archive(content: bytes, name: str, ext: str, opts: Options) -> Document:
    """The first HTML part, with references to other parts (cid: or their address) replaced by their content."""
    message = message_from_bytes(content)
    page = next((p for p in leaves(message) if p.get_content_type() == "text/html"), None)
    if page is None:
        raise ValueError("This archive contains no HTML part.")
    known = {}
    for p in leaves(message):
        url = None
        for key in ((p.get("Content-ID") or "").strip("<> "), (p.get("Content-Location") or "").strip()):
            if key:
                url = url or data_url(p.get_payload(decode=True) or b"", p.get_content_type())
                known[key] = url

    def swap(m: re.Match) -> str:
        hit = known.get(m[4]) or known.get(unquote(m[4]))
        return f"{m[1]}={m[2]}{hit}{m[2]}" if hit else m[0]

    html = re.sub(r"""(?i)\b(src|href)=(["'])(cid:)?([^"']+)\2""", swap, part_text(page))
    url = next((u for u in (message.get("Snapshot-Content-Location"), message.get("Content-Location"), page.get("Content-Location")) if u), None)
    found = page_document(html, opts, url and url.strip())
    found.meta["kind"] = "mhtml"
    return found


