"""The text of a raw mail as its reader sees it: parts found, transfer encodings undone, markup removed."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

HEADER = re.compile(r"^[!-9;-~]+:[^\n]*(?:\n[ \t][^\n]*)*", re.M)
FIRST = re.compile(r"[!-9;-~]+:[ \t]?[^\n]*\n")
FIELD = re.compile(r"^(content-type|content-transfer-encoding)[ \t]*:[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)", re.I | re.M)
BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))', re.I)
CHARSET = re.compile(r'charset\s*=\s*"?([^\s;"]+)', re.I)
LOOSE = re.compile(r"^--([^\n]+?)[ \t]*\n(?=content-[a-z-]+[ \t]*:)", re.I | re.M)
B64 = re.compile(r"[^A-Za-z0-9+/]")
B64_LINES = re.compile(r"\s*(?:[A-Za-z0-9+/]{40,}\n)+[A-Za-z0-9+/]*={0,2}\s*\Z")
QP_SIGNS = re.compile(r"=\n|=[0-9A-F]{2}")
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", re.I | re.S)
INLINE = re.compile(r"</?(?:a|abbr|b|big|em|font|i|ins|mark|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
UNSEEN = re.compile("[­​-‍⁠﻿]")


def decoded(data: bytes, charset: str) -> str:
    """By the charset named, unless it is unknown or doesn't fit; then UTF-8, then Latin-1."""
    for c in (charset, "utf-8"):
        try:
            return data.decode(c or "utf-8")
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return data.decode("latin-1")


def unquoted(body: str, charset: str) -> str:
    return decoded(quopri.decodestring(body.encode("utf-8", "surrogatepass")), charset)


def unbase64(body: str, charset: str) -> str:
    s = B64.sub("", body.split("=", 1)[0] if "=" in body else body)
    try:
        return decoded(base64.b64decode(s[: len(s) - (len(s) % 4 == 1)] + "=" * (-len(s) % 4 % 3)), charset)
    except (binascii.Error, ValueError):
        return ""


def plain(page: str) -> str:
    """Text of HTML: inline tags join, other tags part."""
    return html.unescape(TAG.sub(" ", INLINE.sub("", HIDDEN.sub(" ", page))))


def text_parts(raw: str | None) -> list[str]:
    """Every text part, attachments included. A mail without headers is one plain part; without a closing boundary the last part ends with the mail."""
    if not raw:
        return []
    out: list[str] = []
    blocks = [raw.replace("\r\n", "\n").replace("\r", "\n")]
    while blocks:  # each block is longer than those in it, so it ends
        blocks += reversed(_parts(blocks.pop(), out))
    return [UNSEEN.sub("", x) if not x.isascii() else x for x in out if x]


def _parts(block: str, out: list[str]) -> list[str]:
    """The blocks nested in this one; the text of one that has none goes to out."""
    head, body = "", block
    if FIRST.match(block):
        cut = block.find("\n\n")
        head, body = (block, "") if cut < 0 else (block[: cut + 1], block[cut + 2 :])
        if HEADER.sub("", head).strip() and not re.search(r"^(content-type|mime-version|from|received)[ \t]*:", head, re.I | re.M):
            head, body = "", block  # prose that begins like a header
    elif block.startswith("\n"):
        body = block[1:]
    f = {k.lower(): v for k, v in FIELD.findall(head)}
    kind, how = f.get("content-type", "").strip(), f.get("content-transfer-encoding", "").strip().lower()
    low = kind.lower()
    m = BOUNDARY.search(kind) if low.startswith("multipart/") else None
    mark = (m[1] or m[2] or "").strip() if m else ""
    if not mark or f"--{mark}" not in body:
        m = LOOSE.search(body) if low.startswith("multipart/") or not low else None
        mark = m[1] if m else ""
    if mark:
        return [p for p in re.split(rf"^--{re.escape(mark)}(--)?[ \t]*(?:\n|\Z)", body, flags=re.M)[2::2] if p.strip()]
    if low.startswith("message/rfc822"):
        return [body]
    if low and not low.startswith(("text/", "multipart/")):
        return []
    m = CHARSET.search(kind)
    charset = m[1] if m else "utf-8"
    if how.startswith("quoted"):
        body = unquoted(body, charset)
    elif how.startswith("base64"):
        body = unbase64(body, charset)
    elif not how:
        # The header is missing: a body that can only be an encoded one is read as such.
        if B64_LINES.match(body):
            body = unbase64(body, charset)
        elif len(QP_SIGNS.findall(body)) > 2:
            out.append(unquoted(body, charset))
    if low.startswith("text/html") or not low and re.match(r"\s*<(?:!doctype|html)", body, re.I):
        body = plain(body)
    out.append(body)
    return []
