"""Reading forum posts: their words, and the part of a post that is its author's own prose."""

from __future__ import annotations

import html
import re
import unicodedata

_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF])
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|wbr|font|tt|sup|sub)(?:\s[^<>]*)?/?>|\[/?(?:b|i|u|s|color|size)(?:=[^\]\n]*)?\]", re.I)
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>|\[/?(?:quote|sig|code|url|img|list|spoiler|center|\*)(?:=[^\]\n]*)?\]", re.I)
_LINE_MARK = re.compile(r"^[ \t]*(?:[>|][ \t]*)+", re.M)
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")

_FENCE = re.compile(r"^```.*?(?:^```[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"\[code\].*?(?:\[/code\]|\Z)|<(code|pre)\b[^>]*>.*?(?:</\1>|\Z)", re.I | re.S)
_TRIPLE_LINE = re.compile(r"^[ \t]*<\S+>[ \t]+<\S+>[ \t]+\S.*\.[ \t]*$", re.M)
_QUOTED_LINE = re.compile(r"^[ \t]*[>|].*$\n?", re.M)
_ATTRIBUTION = re.compile(r"^[ \t]*\S+(?: \S+){0,3} (?:wrote|writes|said|schrieb|escribió|a écrit) ?:[ \t]*$\n?", re.M)
_QUOTE_BLOCKS = [
    (re.compile(r"\[quote\b[^\]]*\](?:(?!\[/?quote\b).)*?\[/quote\]", re.I | re.S), re.compile(r"\[/?quote\b[^\]]*\]", re.I), "[quote", "[/quote"),
    (re.compile(r"<blockquote\b[^>]*>(?:(?!</?blockquote\b).)*?</blockquote>", re.I | re.S), re.compile(r"</?blockquote\b[^>]*>", re.I), "<blockquote", "</blockquote"),
]
_SIGNATURE_BLOCK = re.compile(r"\[sig\].*?(?:\[/sig\]|\Z)|<hr ?/?>\s*<small>.*?(?:</small>|\Z)", re.I | re.S)
_SIGNATURE_TAIL = re.compile(r"^(?:--[ \t]*|_{6,}[ \t]*)$\n(?:[ \t]*\S.*(?:\n|\Z))*", re.M)
_DEVICE = re.compile(r"^(?:Sent from my|Von meinem|Enviado desde|Envoyé de) .*$", re.M)
_NOTICE = re.compile(r"^[ \t]*(?:\(reposted\b[^\n)]*\)|\[edit\b[^\]\n]*\]|-- cont\. --|\[deleted\]|\*{3} post deleted \*{3}|<i>removed by moderator</i>)[ \t]*$", re.M | re.I)
_LINK = re.compile(r"\[url\b[^\]]*\].*?\[/url\]|https?://\S+", re.I | re.S)
_CITED = re.compile(r"[\"“„«]([^\"“”„«»]{20,})[\"”“»](?:\s*-\s*where is this from\?)?")


def _visible(text: str) -> str:
    """Entities replaced, invisible characters gone, one kind of line end."""
    if "&" in text:
        text = html.unescape(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else unicodedata.normalize("NFKC", text.translate(_INVISIBLE))


def plain_words(text: str | None) -> list[str]:
    """Lower-case words of a text without markup, entities, quote marks, line breaks and invisible characters."""
    if not text:
        return []
    text = _visible(text)
    if ">" in text or "|" in text:
        text = _LINE_MARK.sub("", text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return _WORD.findall(text.lower())


def _without_blocks(text: str) -> str:
    """Without quote blocks, the inmost first; an opening mark without end takes what follows it."""
    for block, mark, opening, closing in _QUOTE_BLOCKS:
        if opening not in (low := text.lower()) and closing not in low:
            continue
        n = 1
        while n:
            text, n = block.subn("\n", text)
        if m := mark.search(text):
            if not m.group(0).lower().startswith(closing):
                text = text[: m.start()]
            text = mark.sub("\n", text)
    return text


def own_prose(text: str | None) -> str:
    """What the author of a post wrote: without quoted text, signatures, code, markup and notices."""
    if not text:
        return ""
    text = _visible(text)
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text or "[" in text:
        text = _SIGNATURE_BLOCK.sub("\n", _CODE.sub("\n", text))
    if ">" in text or "|" in text:
        text = _QUOTED_LINE.sub("", _TRIPLE_LINE.sub("", text))
    if ":" in text:
        text = _ATTRIBUTION.sub("", text)
    text = _without_blocks(text)
    text = _DEVICE.sub("", _NOTICE.sub("", _SIGNATURE_TAIL.sub("", text)))
    if '"' in text or "“" in text or "«" in text:
        text = _CITED.sub(" ", text)
    if "[url" in text or "://" in text:
        text = _LINK.sub(" ", text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return text


def prose_words(text: str | None) -> list[str]:
    """Lower-case words, digits left out, of the author's own prose."""
    return _LETTERS.findall(own_prose(text).lower())
