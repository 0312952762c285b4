"""Words of page texts."""

from __future__ import annotations

import re

_ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u180e"
_DROP_ZERO_WIDTH = {ord(c): None for c in _ZERO_WIDTH}
_ANY_ZERO_WIDTH = re.compile(f"[{_ZERO_WIDTH}]")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^<>]*>", re.S)
_REFERENCE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")
_LINE_HYPHEN = re.compile("(?<=[^\\W_])[-\u00ad\u2010\u2011][ \\t\u00a0]*(?:\r\n|[\n\r\u2028\u0085])[ \\t\u00a0]*(?=[^\\W_])")
_HYPHEN_LINE = re.compile("[-\u00ad\u2010\u2011][ \\t\u00a0]*[\r\n\u2028\u0085]")
_WORD = re.compile(r"[^\W_]+")


def cleaned(text: str) -> str:
    """The text without zero-width characters, soft hyphens, tags, character references and line-end hyphens."""
    if not text.isascii():
        if _ANY_ZERO_WIDTH.search(text):
            text = text.translate(_DROP_ZERO_WIDTH)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _REFERENCE.sub(" ", text)
    if _HYPHEN_LINE.search(text):
        text = _LINE_HYPHEN.sub("", text)
    return text.replace("\u00ad", "")


def words_of(text: str | None) -> list[str]:
    """The words of a text."""
    return _WORD.findall(cleaned(text).lower()) if text else []
