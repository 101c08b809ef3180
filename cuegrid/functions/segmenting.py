"""Width-bounded segmentation: protected spans, even cuts at tokens, pauses, and the times of characters.

All offsets are code points of the text.  A ``Line`` measures a text once (widths, token starts, cuts that would part a
protected span); every rule then works on offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence
from functools import lru_cache

from cuegrid.functions.text import HARD, SOFT, TAILS, _halves, _span_width, boundary, chinese_rules, graphemes, tokens

#: How far an even cut may move, how much wider a line may get for a term, pauses that part cues.
WINDOW, OVERFLOW, PAUSE_MS = 0.25, 1.35, 600.0
#: A number with its unit, and a count with its measure word and what is counted (Chinese).
NUMBER_UNIT = re.compile(r"\d+(?:\.\d+)?\s*[个条张页家次步项秒分年月日岁倍万亿千百%％]")
COUNT_MEASURE = re.compile(r"[一二两三四五六七八九十百千万几多半\d]+\s*[句个条张片段行本次道份只种块位名台部件套组步页篇章]\s*[一-鿿]")


def canonical_terms(lines: Iterable[str]) -> list[str]:
    """The right side of ``wrong → right`` (or the whole line), of two characters or more, longest first, ties by text."""
    found = {(line.rsplit("→", 1)[-1]).strip() for line in lines}
    return sorted((t for t in found if len(t) > 1), key=lambda t: (-len(t), t))


def _word_edge(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


class Terms:
    """Where a text may not be cut: terms of a glossary and, in Chinese, numbers with their units and counts with their nouns."""

    def __init__(self, lines: Iterable[str] = ()):
        self.lines = tuple(lines)
        forms = []
        for t in canonical_terms(self.lines):
            body = r"\s+".join(map(re.escape, t.split()))
            forms.append(("(?<![A-Za-z0-9])" if _word_edge(t[0]) else "") + body + ("(?![A-Za-z0-9])" if _word_edge(t[-1]) else ""))
        self.pattern = re.compile("|".join(forms), re.IGNORECASE) if forms else None

    def __getstate__(self):
        return self.lines

    def __setstate__(self, lines):
        self.__init__(lines)

    def glossary(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)] if self.pattern else []

    def protected(self, text: str, language: str | None) -> list[tuple[int, int]]:
        extra = [m.span() for p in (NUMBER_UNIT, COUNT_MEASURE) for m in p.finditer(text)] if chinese_rules(text, language) else []
        return self.glossary(text) + extra


NO_TERMS = Terms()


def inside(cut: int, spans: Iterable[tuple[int, int]]) -> bool:
    """Strictly within one of the spans."""
    return any(a < cut < b for a, b in spans)


class Line:
    """One text, measured: widths between offsets, token starts, and the offsets at which a cut would part a protected span."""

    def __init__(self, text: str, spans: Sequence[tuple[int, int]] = (), gaps: Sequence[float] | None = None):
        self.text, self.halves, self.gaps = text, _halves(text), gaps
        self.starts = [a for a, _ in tokens(text)]
        self.closed = {i for a, b in spans for i in range(a + 1, b)}

    def width(self, a: int, b: int) -> float:
        return _span_width(self.text, self.halves, a, b)

    def free(self, lo: int, hi: int) -> list[int]:
        """Token starts in ``[lo, hi)`` at which nothing protected is parted."""
        return [s for s in self.starts[bisect_left(self.starts, lo) : bisect_left(self.starts, hi)] if s not in self.closed]

    def mend(self, at: int, cut: int, end: int, goal: float, most: float) -> int:
        """A cut inside a protected span goes to the free token start before or behind, whichever leaves nearer ``goal``; if neither will do it stays."""
        if cut not in self.closed:
            return cut
        options = self.free(at + 1, cut)[-1:]
        options += [s for s in self.free(cut + 1, end)[:1] if self.width(at, s) <= most * OVERFLOW]
        return min(options, key=lambda s: abs(self.width(at, s) - goal), default=cut)

    def settle(self, at: int, cut: int, end: int, goal: float, most: float) -> int:
        """Of the token starts around ``goal`` the one behind the longest pause, then the nearest; without one the cut is mended."""
        near = []
        for s in self.starts[bisect_right(self.starts, at) : bisect_left(self.starts, end)]:
            w = self.width(at, s)
            if w > min(most, goal * (1 + WINDOW)):
                break
            if w >= goal * (1 - WINDOW) and s not in self.closed:
                near.append((-(self.gaps[s] if self.gaps and s < len(self.gaps) else 0.0), abs(w - goal), s))
        return min(near)[2] if near else self.mend(at, cut, end, goal, most)

    def pieces(self, a: int, b: int, most: float, count: int | None = None) -> list[tuple[int, int]]:
        """``[a, b)`` cut at tokens, as full as they get, or in ``count`` even pieces; what follows a token up to the next is part of it."""
        own = self.starts[bisect_left(self.starts, a) : bisect_left(self.starts, b)]
        goal = self.width(a, b) / count if count else most
        out, at = [], a
        for s, e in zip(own, [*own[1:], b]):
            if s <= at or (count and len(out) >= count - 1):
                continue
            if (self.width(at, s) >= goal) if count else (self.width(at, e) > most):
                cut = self.mend(at, self.settle(at, s, b, goal, most) if count else s, b, goal, most)
                if cut > at:
                    out.append((at, cut))
                    at = cut
        return [(x, y) for x, y in [*out, (at, b)] if self.text[x:y].strip()]

    def wrap(self, a: int, b: int, most: float) -> list[tuple[int, int]]:
        """The fewest pieces, evened out where that makes none wider."""
        if bisect_left(self.starts, a) == bisect_left(self.starts, b):
            return [(a, b)]
        full = self.pieces(a, b, most)
        if len(full) < 2:
            return full
        even = self.pieces(a, b, most, len(full))
        widest = lambda spans: max((self.width(x, y) for x, y in spans), default=0.0)
        return even if even and widest(even) <= max(most, widest(full)) else full

    def split(self, most: float, pauses: Iterable[int] = ()) -> list[tuple[int, int]]:
        """G1: pieces at marks and pauses, joined again while they fit, but never over a pause or behind a hard end; then wrapped."""
        text = self.text
        safe = range(len(text) + 1) if text.isascii() and "\r" not in text else {b for _, b in graphemes(text)}
        held = {i for i in pauses if i in safe and 0 < i < len(text)}
        marks = {i + 1 for i, ch in enumerate(text) if (ch in HARD or ch in SOFT or ch == ".") and i + 1 in safe and boundary(text, i, soft=True)}
        edges = sorted({0, len(text)} | marks | held)
        out: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:]):
            if not text[a:b].strip():
                continue
            if out and a not in held and text[out[-1][0] : out[-1][1]].rstrip()[-1:] not in TAILS and self.width(out[-1][0], b) <= most:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return [s for a, b in out for s in ([(a, b)] if self.width(a, b) <= most else self.wrap(a, b, most))]


@lru_cache(4096)
def _segments(text: str, most: float, terms: Terms, language: str | None) -> tuple[tuple[int, int], ...]:
    return tuple(Line(text, terms.protected(text, language)).split(most))


def segments(text: str, most: float, terms: Terms = NO_TERMS, language: str | None = None) -> list[tuple[int, int]]:
    """G1 without times; what the pieces leave out is blank."""
    return list(_segments(text, most, terms, language))


def wrap(text: str, most: float, terms: Terms = NO_TERMS, language: str | None = None) -> list[tuple[int, int]]:
    """G2 on a whole text."""
    return Line(text, terms.protected(text, language)).wrap(0, len(text), most)


def _spread(n: int, a: float, b: float) -> list[tuple[float, float]]:
    return [(a + (b - a) * i / n, a + (b - a) * (i + 1) / n) for i in range(n)]


def char_times(text: str, start: float, end: float, words: Sequence[dict] | None = None, stamps: Sequence[dict] | None = None) -> list[tuple[float, float]]:
    """Begin and end of every code point, those of one cluster alike.

    Words are looked for one behind the other; without words, stamps count if there is one per token.  A word's time is
    shared evenly by its clusters.  What stands between known times shares what is left, nothing leaves the sentence or
    runs backwards; without any known time all is even.
    """
    cl = graphemes(text)
    first = {a: i for i, (a, _) in enumerate(cl)}
    clip = lambda t: min(end, max(start, float(t)))
    known: list[tuple[float, float] | None] = [None] * len(cl)

    def put(a: int, b: int, s: float, e: float) -> None:
        own = [i for i in range(len(cl)) if a <= cl[i][0] and cl[i][1] <= b] if a not in first else list(range(first[a], bisect_right([y for _, y in cl], b)))
        for i, t in zip(own, _spread(max(1, len(own)), clip(s), clip(e))):
            known[i] = t

    at = 0
    if words:
        for w in words:
            token = str(w.get("word") or "").strip()
            i = text.find(token, at) if token else -1
            if i >= 0:
                at = i + len(token)
                if w["start"] is not None and w["end"] is not None:
                    put(i, at, w["start"], w["end"])
    elif stamps and len(stamps) == len(toks := tokens(text)):
        for (a, b), s in zip(toks, stamps):
            put(a, b, s["s"], s["e"])
    if not any(known):
        known = list(_spread(max(1, len(cl)), start, end))[: len(cl)]
    last, i = start, 0
    while i < len(cl):
        if known[i] is not None:
            s, e = known[i]
            known[i] = (max(last, s), min(end, max(last, s, e)))
            last = known[i][1]
            i += 1
            continue
        j = next((k for k in range(i, len(cl)) if known[k] is not None), len(cl))
        until = max(last, known[j][0]) if j < len(cl) else end
        known[i:j] = _spread(j - i, last, until)
        last, i = until, j
    return [t for (a, b), t in zip(cl, known) for _ in range(b - a)]


def char_gaps(times: Sequence[tuple[float, float]]) -> list[float]:
    """The pause before every character; none before the first."""
    return [0.0] * bool(times) + [max(0.0, b[0] - a[1]) for a, b in zip(times, times[1:])]


def pause_breaks(gaps: Sequence[float], least_ms: float) -> list[int]:
    """Offsets behind pauses of ``least_ms``; 0 or less turns that off."""
    return [i for i, g in enumerate(gaps) if i and g >= least_ms] if least_ms > 0 else []


def sentence_cues(text: str | None, start: float | None, end: float | None, most: float, words: Sequence[dict] | None = None, stamps: Sequence[dict] | None = None, pause_ms: float = PAUSE_MS, terms: Terms = NO_TERMS, language: str | None = "auto") -> list[dict]:
    """The cues of one sentence, cut at marks, pauses and width, with the times of their characters."""
    text = re.sub(r"\s+", " ", text or "").strip()
    if not text:
        return []
    start = float(start or 0)
    end = start if end is None else float(end)
    times = char_times(text, start, end, words, stamps)
    gaps = char_gaps(times)
    line = Line(text, terms.protected(text, language), gaps)
    out = []
    for a, b in line.split(most, pause_breaks(gaps, pause_ms)):
        s = times[a][0]
        out.append({"start_ms": s, "end_ms": min(end, max(times[b - 1][1], s + 1)), "text": text[a:b].strip()})
    return out


def flat_sentences(text: str | None, stamps: Sequence[dict] | None) -> list[dict]:
    """a flat text with token stamps as sentences; stamps of another number are taken in proportion, without stamps it is one row at 0."""
    text = re.sub(r"\s+", " ", text or "").strip()
    toks = tokens(text)
    if not text:
        return []
    if not toks or not stamps:
        return [{"text": text, "start_ms": 0.0, "end_ms": 0.0}]
    k = len(stamps)
    of = stamps if k == len(toks) else [stamps[min(i * k // len(toks), k - 1)] for i in range(len(toks))]
    edges = sorted({0, len(text), *(i + 1 for i, ch in enumerate(text) if (ch in HARD or ch == ".") and boundary(text, i))})
    out = []
    for a, b in zip(edges, edges[1:]):
        own = [s for (x, y), s in zip(toks, of) if x >= a and y <= b]
        if own and text[a:b].strip():
            out.append({"text": text[a:b].strip(), "start_ms": float(own[0]["s"]), "end_ms": float(own[-1]["e"])})
    return out
