"""Words of a text as all operators here understand them."""

from __future__ import annotations

import re
import unicodedata

_BREAK = re.compile("[-‐]\r?\n")
_WORD = re.compile(r"[^\W_]+")
_BRACKETS = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]")


def resolved(text: str) -> str:
    """Composed (NFC), without soft hyphens and without hyphens that stand directly before a line end (nor that end)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("­", "")
    return _BREAK.sub("", text) if "\n" in text else text


def words_in(text: str) -> list[str]:
    """The words of a text that is :func:`resolved` already."""
    return _WORD.findall(text.lower())


def words(text: str | None, brackets: bool = True) -> list[str]:
    """The maximal runs of letters or digits, in lower case; none for null. Without ``brackets``, what stands inside
    closed, unnested round or square brackets is left out before words are formed."""
    if not text:
        return []
    text = resolved(text)
    if not brackets and ("(" in text or "[" in text):
        text = _BRACKETS.sub(" ", text)
    return words_in(text)
