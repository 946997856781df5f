"""Text out of file bytes: plain, markdown, docx, odt, mail, html; no text out of images and what is unsupported."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from html import unescape
from xml.etree import ElementTree

# Tags that break a line, and tags whose bodies are no text.
BLOCK = {"p", "div", "br", "li", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
HIDDEN = ("script", "style")


def decoded(raw: bytes) -> str:
    """By byte order mark UTF-16, else UTF-8, else Latin-1."""
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def normalized(text: str) -> str:
    """Line ends without blanks, runs of blank lines as one, no newlines at the end."""
    lines = [x.rstrip() for x in re.split(r"\r?\n", text)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).rstrip("\n")


def html_text(html: str) -> str:
    """The text of HTML; block tags break lines, scripts and styles are left out, entities decoded."""
    for t in HIDDEN:
        html = re.sub(rf"(?is)<{t}\b[^>]*>.*?(</{t}\s*>|$)", "", html)

    def tag(m: re.Match) -> str:
        return "\n" if m.group(1).lower() in BLOCK else ""

    text = re.sub(r"(?s)<!--.*?-->", "", html)
    text = re.sub(r"(?s)</?\s*([A-Za-z][A-Za-z0-9]*)[^>]*>", tag, text)
    return re.sub(r"\n+", "\n", unescape(re.sub(r"<[^>]*>", "", text)))


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def zip_entry(raw: bytes, *names: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for n in names:
            if n in z.namelist():
                return z.read(n)
    raise ValueError(f"no {names[0]} in the archive")


def docx_text(raw: bytes) -> str:
    """Runs of each paragraph joined, a line a paragraph."""
    out = []
    for p in ElementTree.fromstring(zip_entry(raw, "word/document.xml")).iter():
        if local_name(p.tag) == "p":
            out.append("".join(t.text or "" for t in p.iter() if local_name(t.tag) == "t"))
    return "\n".join(out)


def odt_text(raw: bytes) -> str:
    return "\n".join("".join(p.itertext()).strip() for p in ElementTree.fromstring(zip_entry(raw, "content.xml")).iter() if local_name(p.tag) == "p")


def mail_text(raw: bytes) -> str:
    """Subject, From, To and Date, a blank line, the body: plain parts before HTML ones, attachments left out."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain, html = [], []
    for part in m.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            (plain if kind == "text/plain" else html).append(decoded(part.get_payload(decode=True) or b""))
    head = [f"{k}: {m[k]}" for k in ("Subject", "From", "To", "Date") if m[k]]
    body = "\n".join(plain) if plain else "\n".join(map(html_text, html))
    return "\n".join([*head, "", body])


def extract(kind: str, raw: bytes) -> tuple[str, str, str | None]:
    """(text, source, error) of a file of a format class."""
    try:
        if kind == "image":
            return "", "none", None
        if kind == "unsupported":
            return "", "none", "unsupported format"
        if kind == "pdf":
            try:
                from pypdf import PdfReader
            except ImportError:
                return "", "none", None
            return normalized("\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)), "pdf", None
        if kind in ("docx", "odt", "email"):
            return normalized({"docx": docx_text, "odt": odt_text, "email": mail_text}[kind](raw)), kind, None
        return normalized(decoded(raw)), "markdown" if kind == "markdown" else "plain", None
    except Exception as e:
        return "", "none", f"{type(e).__name__}: {e}"[:300]
