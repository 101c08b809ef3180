"""Reading the raw text of a cue: stamps, sound annotations, speaker labels and the lines they open.

All offsets count code points of the original text from 0.  ``mask`` replaces what is not speech by blanks of the same
length, so that every later step can work on a string whose offsets are still those of the original.
"""

from __future__ import annotations

import re

#: Spellings of time stamps, sound annotations and label words.
STAMP = r"\d{1,2}:\d\d:\d\d[,.]\d{1,3}[ ]*-->(?:[ ]*\d{1,2}:\d\d:\d\d[,.]\d{1,3})?|[\[(<]\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?[\])>]|(?<![^\W_])\d{1,3}h\d\d?m\d\d?s(?![^\W_])"
NOTE = (
    r"\[(?!\s*(?:at|dot)\s*\])[^\[\]\n\d:：]{1,24}\](?!\s*[:：])|\((?!\s*(?:at|dot)\s*\))[^()\n\d@]{2,24}\)|（[^（）\n\d@]{1,16}）|【[^【】\n\d]{1,16}】"
    r"|\{[^{}\n\d]{1,24}\}|(?<![\w*])\*[^\W\d_][^*\n\d]{1,20}\*(?![\w*])|<(?!v[ .])/?[^\W\d_][^<>\n\d]{0,20}>|[♪♫♬♩](?:[ ]*[♪♫♬♩])*"
)
LABEL_WORD = r"(?:spk|speaker|说话人|話者|화자|спикер|locuteur|sprecher)"

_TRIM = re.compile(f"(?:{STAMP})|(?:{NOTE})", re.I)
#: A text without any of these characters has neither trimmings nor labels.
_HINT = re.compile(r"[\[\](){}<>（）【】*♪♫♬♩:：\-0-9]")
#: Any stamp or annotation begins with one of these.
_BEGINS = re.compile(r"[\d\[(<（【{*♪♫♬♩]")
#: Anything that is blank or invisible may come before a label.
_LEAD = r"[\s​‎‏﻿⁠]*"
_LABEL = re.compile(
    _LEAD
    + r"(?:<v[ .]+(?P<v>[^<>\n]{1,30})>"
    + r"|\[(?P<b>[^\[\]\n:：]{1,30})\][ ]*[:：]"
    + rf"|\[(?P<bs>{LABEL_WORD}[ _]?0*\d+)\]"
    + rf"|(?:>>[ ]*|-[ ]+)?(?P<s>{LABEL_WORD}[ _]?0*\d+)(?:[ ]*[:：]|[ ]+-(?=[ ]|$))"
    + r"|(?:>>[ ]*|-[ ]+)?(?P<f>file\d+(?:·[LR])?)[ ]*[:：]"
    + r"|(?:>>[ ]*|-[ ]+)(?P<d>[^\W\d_][\w'’.-]{0,24})[ ]*[:：]"
    + r"|(?P<n>[A-ZÀ-ÞА-ЯЁ][^\W\d_]{1,24})(?:：|:(?=\s|$|\d|[\[(<{*♪♫【（“\"«¿¡]|[^\x00-\xff])))"
    + r"[ ]?",
    re.I | re.M,
)
_UPPER = re.compile(r"[A-ZÀ-ÞА-ЯЁ]")
_COLONISH = re.compile(r"[:：\]>]|\d -")


def trimmings(text: str) -> list[tuple[int, int]]:
    """Spans of stamps and sound annotations."""
    return [] if plain(text) else _spans(text)


def _spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := _BEGINS.search(text, at):
        at = m.start()
        if found := _TRIM.match(text, at):
            at = found.end()
            out.append(found.span())
        else:
            at += 1
    return out


def plain(text: str) -> bool:
    """Whether the text surely has neither trimmings nor labels."""
    return _HINT.search(text) is None


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def label_key(raw: str) -> str:
    """Spellings of one label fall together: ``SPK1``, ``speaker_1``, ``spk01`` and ``说话人1`` are all ``spk1``."""
    s = raw.strip().lower()
    m = re.fullmatch(LABEL_WORD + r"[ _]*0*(\d+)", s)
    return f"spk{m[1]}" if m else s


def read_lines(text: str, label: re.Pattern = _LABEL) -> tuple[str, list[tuple[str | None, int, int]], list[tuple[int, int]]]:
    """``(masked, lines, spans)``: the text with stamps, annotations and labels blanked, and the lines of the cue.

    A line is ``(label key or None, first offset, end offset)``.  A labelled physical line opens a line, any other line
    break does not.  What stands before the first label is a line of its own only if something is said there.
    """
    if plain(text):
        return text, [(None, 0, len(text))], []
    spans = _spans(text)
    masked = mask(text, spans) if spans else text
    if not _COLONISH.search(text):
        return masked, [(None, 0, len(text))], spans
    heads: list[tuple[str, int, int]] = []
    at = 0
    for part in masked.split("\n"):
        if part and (m := label.match(part)):
            raw = m["v"] or m["b"] or m["bs"] or m["s"] or m["f"] or m["d"] or m["n"]
            if m["n"] is None or _UPPER.match(raw):
                heads.append((label_key(raw), at + m.start(), at + m.end()))
        at += len(part) + 1
    if not heads:
        return masked, [(None, 0, len(text))], spans
    lines: list[tuple[str | None, int, int]] = []
    for i, (key, a, b) in enumerate(heads):
        if i == 0 and any(ch.isalnum() for ch in masked[:a]):
            lines.append((None, 0, a))
        lines.append((key, b, heads[i + 1][1] if i + 1 < len(heads) else len(text)))
    masked = mask(masked, [(a, b) for _, a, b in heads])
    return masked, lines, spans + [(a, b) for _, a, b in heads]
