"""Unicode text kernels: graphemes, tokens, display width and sentence boundaries (segmentation is in ``segmenting``).

They run as Arrow batches in Python, as the JVM's grapheme rules differ for Indic scripts; offsets are code points.
"""

from __future__ import annotations

import unicodedata
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_G = regex.compile(r"\X")
#: Marks that end a sentence, softer ones that may end a line, and tails behind which nothing is joined.
HARD, SOFT = "。！？!?…؟۔।॥", "，、,;；:：،؛"
TAILS = HARD + "."
_FLAG = range(0x1F1E6, 0x1F200)
_SKIN = range(0x1F3FB, 0x1F400)


def is_han(ch: str) -> bool:
    """An ideograph."""
    return bool(ch) and (0x3400 <= ord(ch) <= 0x9FFF or 0x20000 <= ord(ch) <= 0x323AF)


def is_unspaced(ch: str) -> bool:
    """A letter of a script written without blanks between words (Han, kana, Thai, Lao, Khmer, Burmese)."""
    return is_han(ch) or any(a <= ord(ch) <= b for a, b in ((0x3040, 0x30FF), (0x0E00, 0x0EFF), (0x1780, 0x17FF), (0x1000, 0x109F)))


def chinese_rules(text: str, language: str | None) -> bool:
    """P1, of one text: language ``zh`` and neither kana nor Hangul."""
    return language == "zh" and not any(0x3040 <= ord(c) <= 0x30FF or 0xAC00 <= ord(c) <= 0xD7AF for c in text)


def graphemes(text: str) -> list[tuple[int, int]]:
    """spans of extended grapheme clusters."""
    return [m.span() for m in _G.finditer(text)]


#: What tokens are in plain text: words, and symbols (no punctuation) one by one.
_ASCII_TOKEN = regex.compile(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*|[$+<=>^`|~]")


def tokens(text: str) -> list[tuple[int, int]]:
    """words of spaced scripts (with inner apostrophes and hyphens), one cluster each in unspaced ones; no marks or blanks."""
    if text.isascii():
        return [m.span() for m in _ASCII_TOKEN.finditer(text)]
    return _clustered(text)


def _clustered(text: str) -> list[tuple[int, int]]:
    """``tokens`` of any text, cluster by cluster."""
    out: list[list] = []
    glue = False  # whether the last token may still grow, and what stands between
    between = ""
    for a, b in graphemes(text):
        ch = text[a:b]
        kind = unicodedata.category(ch[0])[0]
        if ch.isspace() or kind in "PC":
            between += ch
            continue
        unspaced = is_unspaced(ch[0])
        if kind in "LNM" and not unspaced and glue and between in ("", "'", "’", "-"):
            out[-1][1] = b
        else:
            out.append([a, b])
        glue = kind in "LNM" and not unspaced
        between = ""
    return [(a, b) for a, b in out]


def _cluster_halves(cluster: str) -> int:
    """Half-width units of one cluster: marks and joined characters count nothing, a flag or an emoji form two."""
    if len(cluster) == 1:
        ch = cluster
        if unicodedata.category(ch) in ("Cc", "Cf", "Mn", "Me", "Mc", "Zl", "Zp"):
            return 0
        return 2 if unicodedata.east_asian_width(ch) in "WF" else 1
    if any(unicodedata.category(ch) == "Cc" for ch in cluster):
        return 0
    if ord(cluster[0]) in _FLAG:
        return 2
    n, joined = 0, False
    for ch in cluster:
        if joined:
            joined = False
        elif ch == "\u200d":
            joined = True
        elif ch == "\ufe0f":
            n = max(n, 2)
        elif not (n and ord(ch) in _SKIN):
            n += _cluster_halves(ch)
    return n


def _halves(text: str) -> list[int]:
    """Display width of ``text[:i]`` in half-width units, for every ``i``."""
    if text.isascii() and text.isprintable():
        return list(range(len(text) + 1))
    out = [0] * (len(text) + 1)
    at = 0
    for a, b in graphemes(text):
        at += _cluster_halves(text[a:b])
        out[a + 1 : b + 1] = [at] * (b - a)
    return out


def _span_width(text: str, halves: list[int], a: int, b: int) -> float:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (halves[b] - halves[a]) / 2


def width(text: str) -> float:
    """display width in full-width units of the stripped text: Han 1, Latin 0.5, combining 0, emoji sequences 1."""
    return _span_width(text, _halves(text), 0, len(text))


def boundary(text: str, i: int, soft: bool = False) -> bool:
    """Whether a sentence may end behind offset ``i``; a full stop only at the end or before a blank."""
    ch = text[i]
    if ch == ".":
        return i + 1 == len(text) or text[i + 1].isspace()
    return ch in HARD or (soft and ch in SOFT)


def _each(fn, kind: str):
    def run(s: pd.Series) -> pd.Series:
        known: dict = {None: None}  # texts repeat
        for t in s.unique():
            known[t] = fn(t) if isinstance(t, str) else None
        return pd.Series([known.get(t) for t in s], dtype=object)

    return F.pandas_udf(run, kind)


def display_width(c) -> Column:
    return _each(width, "double")(c)


def token_count(c) -> Column:
    return _each(lambda t: len(tokens(t)), "int")(c)


def grapheme_count(c) -> Column:
    return _each(lambda t: len(graphemes(t)), "int")(c)


def boundary_count(c, soft: bool = False) -> Column:
    """P3 by text: how many offsets may end a sentence."""
    return _each(lambda t: sum(boundary(t, i, soft) for i, ch in enumerate(t) if ch in HARD or ch == "." or (soft and ch in SOFT)), "int")(c)
