"""Names as written in triple files, brought to one spelling."""

from __future__ import annotations

import html
import posixpath
import re
import unicodedata
from urllib.parse import unquote

_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})")
_ESCAPED = re.compile(r"\\(.)")
_LITERAL_END = re.compile(r"(\")(?:@[A-Za-z-]+|\^\^\S+)$")
_URI = re.compile(r"^[a-z][a-z0-9+.-]*://.*?([^/#]*)$", re.I | re.S)
_PREFIX = re.compile(r"^[A-Za-z_][\w-]*:(?=\w)")


def plain_name(text: str | None) -> str:
    """A name in small letters and digits only: without namespace or prefix, escapes, case, accents, word
    separators, blanks, invisible characters and punctuation."""
    if not text:
        return ""
    s = text
    if "\\" in s:
        s = _ESCAPED.sub(r"\1", _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)), s))
    if "&" in s:
        s = html.unescape(s)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf") if not s.isascii() else s
    s = s.strip().rstrip(".;, \t").strip()
    s = _LITERAL_END.sub(r"\1", s).strip("<>\"'`“”‘’ \t\xa0")
    if "%" in s:
        s = unquote(s)
    if "://" in s:
        s = _URI.sub(r"\1", s.rstrip("/#"))
    elif ":" in s:
        s = _PREFIX.sub("", s)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return "".join(c for c in s.casefold() if c.isalnum())


def plain_path(path: str | None) -> str | None:
    """A path in plain form: no scheme, forward slashes, ``.``, ``..`` and double slashes resolved; null if empty."""
    if not path or not path.strip():
        return None
    s = re.sub(r"^file:(?://(?=/)|//localhost)?", "", path.strip().replace("\\", "/"))
    s = posixpath.normpath(s)
    return "/" + s.lstrip("/") if s.startswith("/") else s
