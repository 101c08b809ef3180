"""Problem 3: sentence boundaries across languages and scripts.

Candidate boundaries are all terminators, with the quotation marks that close behind them, and, beside Thai letters,
blanks.  A maximum-entropy (logistic) model classifies every one from what stands around it: the mark, the tokens before
and behind, case, length, digits, script, the state of quotations, how often the token before ends a cue where it carries
a period, and how often the token behind opens one.  It is trained on reliable boundaries of the data: the end of one cue
before the start of another, against marks followed by lower case, digits, commas or closing brackets, marks inside an open
quotation, and tokens that occur often and never open a cue.  How often tokens end, open and occur is counted over all
cues; the examples the weights are fitted to are bounded (``SAMPLE`` cues in expectation, chosen by hash).  The model is
applied to all cues.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions.lines import plain, read_lines
from cuegrid.llm.fillers import LEAD_INS, WORDS, is_speech
from cuegrid.llm.lang import _MAIL

SAMPLE = 10_000
#: Tokens are counted under so many hashes, so that the statistics have one size whatever the corpus (80 MB at most).
BUCKETS = 1 << 22

_CLOSE = "(?:[ \u00a0\u202f]?»|[”\"’“›]|[)\\]』」])*"
#: Terminators with the quotation marks that close behind them; a blank after a Thai letter is a candidate too.
_CAND = re.compile(rf"(?P<t>[.!?…。！？।؟｡．]+(?:\s(?=[!?]))?[!?]*)(?P<q>{_CLOSE})|(?<=[฀-๿])(?P<th>[ \t\n]+)(?=\S)|(?<=[\w!?.)”])(?P<tt>[ \t\n]+)(?=[฀-๿])")
#: The same for texts without Thai letters.
_CAND_SPACED = re.compile(rf"(?P<t>[.!?…。！？।؟｡．]+(?:\s(?=[!?]))?[!?]*)(?P<q>{_CLOSE})")
_CAND_ASCII = re.compile(r"(?P<t>[.!?]+(?:\s(?=[!?]))?[!?]*)(?P<q>[)\]]*)")
_PREV = re.compile(r"[^\W_](?:[\w'’ऀ-ॿً-ٟ.-]*[\wऀ-ॿً-ٟ])?$|[^\W_]$")
_NEXT = re.compile(r"[\s\"“”„«»‘’'¿¡(\[—–‹「『-]*([^\W_][\w'’ऀ-ॿً-ٟ-]*)")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_OPEN = "“«„‹「『"
_QUOTES = re.compile(r"[“”«»„‹›「」『』\"]")
_DIGIT = re.compile(r"\d+")
_THAI = re.compile("[฀-๿]")


def _candidates(text: str) -> re.Pattern:
    return _CAND_ASCII if text.isascii() else _CAND if _THAI.search(text) else _CAND_SPACED


def _prev_token(text: str) -> str:
    return _last_token(text[-24:])


@lru_cache(100_000)
def _last_token(text: str) -> str:
    m = _PREV.search(text)
    if not m:
        return ""
    w = _DIGIT.sub("0", m[0].lower())
    return w[-2:] if _UNSPACED.search(w[-1]) else w


def _next_token(text: str) -> tuple[str, str]:
    """The token that follows, and its first letter as written."""
    return _first_token(text[:40])


@lru_cache(100_000)
def _first_token(text: str) -> tuple[str, str]:
    m = _NEXT.match(text)
    if not m:
        return "", ""
    raw = m[1]
    w = _DIGIT.sub("0", raw.lower())
    return (w[:2] if _UNSPACED.search(w[0]) else w), raw[0]


#: Kinds of marks: a period, dots, ! or ?, full stops of unspaced scripts, danda and Arabic question mark, blanks by Thai.
PERIOD, DOTS, STRONG, WIDE, OTHER, BLANK = range(6)
#: States of quotations at a candidate: none, inside an open one, one closes that opened at or after the sentence's start, all closed.
NONE, INSIDE, CLOSES_FIRST, CLOSES_LATER, CLOSED = range(5)
#: What follows: nothing special, a comma or closing mark, a dash behind a quotation, an opening quotation.
PLAIN, COMMA, DASH, OPENS = range(4)
_N = 69


class Counts:
    """Counts of tokens by their hash: sorted hashes with a count each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        keep = counts > 0
        self.hashes, self.counts = hashes[keep].astype(np.int32), counts[keep]

    def get(self, term: str, default: int = 0) -> int:
        h = bucket(term)
        i = int(np.searchsorted(self.hashes, h))
        return int(self.counts[i]) if i < len(self.hashes) and self.hashes[i] == h else default


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class BoundaryModel:
    """Weights and token statistics; ``decide`` is memoised by what the features see."""

    def __init__(self, finals, dotted, starts, total, weights: np.ndarray | None = None):
        self.finals, self.dotted, self.starts, self.total = finals, dotted, starts, total
        self.weights = weights if weights is not None else np.zeros(_N)
        self.memo: dict = {}

    def __getstate__(self):
        return self.finals, self.dotted, self.starts, self.total, self.weights

    def __setstate__(self, s):
        self.__init__(*s)

    def features(self, prev: str, kind: int, gap: bool, nxt: str, case: str, nocase: bool, quotes: int, follow: int, initials: bool, seen: int = 0) -> np.ndarray:
        """``seen``: how often the example itself is among the statistics of its tokens."""
        x = np.zeros(_N)
        c = "0Aa".find(case) if case else 3  # digit, capital, lower case, letter without case
        c = 3 if c < 0 else c
        if quotes == CLOSES_FIRST:  # only case tells whether more follows than the speaker's name; letters without case do as small ones
            x[53], x[54], x[55], x[56], x[57] = 1, c == 1, follow == OPENS, follow == COMMA, follow == DASH
            return x
        if quotes == INSIDE or follow in (COMMA, DASH):  # the sentence visibly goes on; nothing else tells more
            x[50], x[51], x[52] = follow == COMMA, follow == DASH, quotes == INSIDE
            return x
        weak = kind in (PERIOD, DOTS, BLANK)
        x[7 + c] = 1
        x[11], x[12] = not gap, nocase
        x[13] = nocase and c == 2
        x[0] = 1
        x[1 + kind] = 1
        n, f = max(0, self.dotted.get(prev, 0) - seen), max(0, self.finals.get(prev, 0) - seen)
        share = f / n if n else 0
        b = 0 if n < 2 else 1 if share < 0.04 else 2 if share < 0.25 else 3 if share < 0.7 else 4
        n, s = max(0, self.total.get(nxt, 0) - seen), max(0, self.starts.get(nxt, 0) - seen)
        share = s / n if n else 0
        b2 = 0 if n < 2 else 1 if s == 0 else 2 if share < 0.02 else 3 if share < 0.2 else 4
        opener = b2 >= 3
        if weak:
            x[14 + b] = 1
            x[19 + b2] = 1
            x[24], x[25], x[26] = len(prev) <= 1, 2 <= len(prev) <= 3, "." in prev
            x[27] = "0" in prev
            x[28] = b == 1 and c == 1
            x[29] = b == 1 or (len(prev) <= 2 and b in (0, 2) and not _UNSPACED.search(prev or " "))
            x[30] = c == 3 and opener
            x[31] = c == 2 and opener
            x[32] = c == 1 and opener
            x[33] = "0" in prev and b2 < 2
            x[34] = kind == DOTS and c == 2
            x[35] = kind == BLANK and b in (3, 4)
            x[36] = kind == BLANK and opener
            if not gap:  # such dots stand inside numbers, addresses and initials
                x[37], x[38], x[39], x[40] = c == 0, c == 2, len(prev) < 2 or "." in prev, initials
        else:
            x[41 + b2] = 1
            x[46] = c == 2 and kind == STRONG and gap
            x[47] = x[46] and (s >= 3 or nocase)
            x[48] = x[46] and nxt in WORDS
        x[49] = nxt in WORDS
        if quotes == CLOSES_LATER:
            x[59] = 1
            x[60 + c] = 1
            x[64] = follow == OPENS
        x[65] = quotes == CLOSED
        x[66] = quotes == CLOSES_LATER and b2 == 1 and c == 3
        x[67] = quotes == CLOSES_LATER and opener and c == 3
        x[68] = follow == OPENS
        return x

    def decide(self, *key) -> bool:
        hit = self.memo.get(key)
        if hit is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            hit = self.memo[key] = bool(self.features(*key) @ self.weights > 0)
        return hit


_MARKS = ".!?…。！？।؟｡"
#: Blanks and quotation marks behind a sentence.
_BEHIND = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\"”»’」』“"
#: Letters that are common come first in the class, where a bitmap finds them.
_TOKEN = re.compile(r"[^\W_][a-z0-9ß-öø-ÿа-яё一-鿿\w'’ऀ-ॿً-ٟ-]*")
_TERMS = pa.schema([("term", pa.int32()), ("finals", pa.int64()), ("dotted", pa.int64()), ("starts", pa.int64()), ("total", pa.int64())])


def _bodies(text: str) -> list[str]:
    if plain(text) and "@" not in text and "＠" not in text:
        low = text.lower()
        if "www." not in low and " arroba " not in low:
            return [text.strip()] if is_speech(text, low) else []
    masked, lines, _ = read_lines(text)
    low = masked.lower()
    if "@" in masked or "＠" in masked or "[" in masked or "(" in masked or "://" in masked or "www." in low or " arroba " in low:
        masked = _MAIL.sub(lambda m: "x" * len(m[0]), masked)
    return [masked[a:b].strip() for _, a, b in lines if is_speech(masked[a:b])]


def _tail(body: str) -> tuple[str, str, bool, bool]:
    """The body without what closes behind its mark, the same without the mark, whether it is Thai, whether it ends as a sentence."""
    last = body.rstrip(_BEHIND)
    bare = last.rstrip(_MARKS)
    thai = not body.isascii() and _THAI.search(body) is not None
    return last, bare, thai, thai or bare != last


_UNSPACED_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]{2,}")
_OPENER = re.compile(rf"^{_NEXT.pattern}", re.M)


def _tally(bodies: list[str], finals: Counter, dotted: Counter, starts: Counter, total: Counter) -> None:
    """Count the tokens of many cues: at their ends, before a period, at their starts, anywhere.

    What needs no look at a single cue is done on all of them as one string.
    """
    lines = [b.replace("\n", " ") for b in bodies]
    low = "\n".join(lines).lower()
    low = _DIGIT.sub("0", low)
    dense = _UNSPACED_RUN.findall(low)
    every = Counter(_TOKEN.findall(low))
    for t in [t for t in every if not t.isascii() and _UNSPACED.match(t)]:
        del every[t]
    total.update(every)
    for run in dense:
        total.update(map("".join, zip(run, run[1:])))
    for t, n in Counter(_OPENER.findall(low)).items():
        starts[t[:2] if not t.isascii() and _UNSPACED.match(t) else t] += n
    tails = []
    for body in lines:
        last, bare, _, ended = _tail(body)
        if ended:
            tails.append(_prev_token(bare))
        if "." in bare or "…" in bare:
            for m in _candidates(body).finditer(body):
                at, mark = m.start(), m["t"]
                if mark and ("." in mark or "…" in mark) and m.end() < len(last):
                    dotted[_last_token(body[max(0, at - 24) : at])] += 1
    finals.update(tails)
    dotted.update(tails)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter() for _ in range(4)]

    def flush() -> pa.RecordBatch:
        terms = list(set().union(*counts))
        cols = [[bucket(t) for t in terms], *([c.get(t, 0) for t in terms] for c in counts)]
        for c in counts:
            c.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _TERMS)], schema=_TERMS)

    for b in batches:
        _tally([body for text in b.column("text").to_pylist() for body in _bodies(text)], *counts)
        if len(counts[3]) > 300_000:
            yield flush()
    yield flush()


def corpus_counts(cues: DataFrame) -> list[Counts]:
    """How often each token ends a cue, carries a period, opens a cue and occurs, over all cues, by hash.

    A redelivered cue counts as often as it comes.  Left out are hashes too rare to be told from unseen ones: ``features``
    asks for two, or for three starts.
    """
    per = cues.where("text IS NOT NULL").select("text").mapInArrow(_count, "term int, finals bigint, dotted bigint, starts bigint, total bigint")
    per = per.groupBy("term").agg(*(F.sum(c).alias(c) for c in _TERMS.names[1:])).where("dotted > 1 OR total > 1 OR starts > 2")
    t = per.select("term", *(F.least(F.col(c), F.lit(2**31 - 1)).cast("int").alias(c) for c in _TERMS.names[1:])).toArrow()  # at most BUCKETS rows
    hashes = t["term"].to_numpy()
    order = hashes.argsort()
    return [Counts(hashes[order], t[c].to_numpy()[order]) for c in _TERMS.names[1:]]


#: Examples that hold in every corpus: quotations that go on or end, commas and open quotations.
PRIOR = (
    (("", STRONG, True, "", "a", False, CLOSES_FIRST, PLAIN, False), 0),
    (("", STRONG, True, "", "A", False, CLOSES_FIRST, PLAIN, False), 1),
    (("", WIDE, False, "", "字", True, CLOSES_FIRST, PLAIN, False), 0),
    (("", WIDE, False, "", "字", True, CLOSES_FIRST, OPENS, False), 1),
    (("", WIDE, False, "", "字", True, CLOSES_LATER, PLAIN, False), 1),
    (("", STRONG, True, "", "A", False, CLOSES_LATER, PLAIN, False), 1),
    (("", WIDE, False, "", "字", True, NONE, PLAIN, False), 1),
    (("", OTHER, True, "", "字", True, NONE, PLAIN, False), 1),
    (("", STRONG, True, "", "A", False, NONE, PLAIN, False), 1),
    (("", PERIOD, True, "", "A", False, NONE, PLAIN, False), 1),
    (("", PERIOD, True, "", "a", False, NONE, PLAIN, False), 0),
    (("", PERIOD, True, "", "0", False, NONE, PLAIN, False), 0),
    (("", STRONG, True, "", "a", False, NONE, PLAIN, False), 0),
    *((("", kind, True, "", case, False, quotes, follow, False), 0) for kind, case in ((STRONG, "A"), (WIDE, "字"), (PERIOD, "A")) for quotes, follow in ((INSIDE, PLAIN), (NONE, COMMA), (CLOSES_LATER, DASH))),
)
#: A token seen so often that never opens a cue opens no sentence.
NEVER_OPENS = 8


def train(texts: list[str], rounds: int = 600, counts: list[Counts] | None = None) -> BoundaryModel:
    """Fit on raw cue texts; without usable texts ``PRIOR`` decides.

    ``counts``: those of the corpus that the texts were drawn from, else the texts' own.
    """
    bodies = [body for t in texts for body in _bodies(t)]
    own = [Counter() for _ in range(4)]
    _tally(bodies, *own)
    model = BoundaryModel(*counts) if counts is not None else BoundaryModel(*map(dict, own))
    x, y = [], []
    opens = [b for b in bodies if _next_token(b)[0]]
    tails: list[tuple[str, str, bool, re.Match]] = []  # cues of one sentence: their end is a boundary whatever comes
    for body in bodies:
        last, bare, thai, ended = _tail(body)
        inner = [m for m in _CAND.finditer(body) if m.end() < len(last)]
        if ended and not inner:
            tails.append((body, last, thai, next((m for m in _CAND.finditer(body, max(0, len(bare) - 1)) if m["t"]), None)))
        for m in inner:
            end = _end(body, 0, m)
            at = _first(body, end, len(body))
            key = _key(body, 0, m, end, at, len(body), None) if at < len(body) else None
            if key is None:
                continue
            prev, kind, gap, w, case, nocase, quotes, follow, initials = key
            goes_on = case == "a" and w not in WORDS and not nocase
            number = kind in (PERIOD, DOTS) and case == "0" and model.dotted.get(prev, 1) > model.finals.get(prev, 0)
            stuck = kind in (PERIOD, DOTS) and not gap and (case in "0a" or not _UNSPACED.match(w))
            quoted = quotes in (CLOSES_FIRST, CLOSES_LATER)
            never = case == "字" and (quoted or kind == BLANK) and not model.starts.get(w) and model.total.get(w, 0) >= NEVER_OPENS
            if follow in (COMMA, DASH) or quotes == INSIDE or never or kind != BLANK and (number or stuck or goes_on and (quoted or kind in (PERIOD, DOTS) or model.starts.get(w, 0) < 3)):
                x.append(model.features(*key))
                y.append(0)
            elif quotes == CLOSES_FIRST and case == "A" and 5 * model.starts.get(w, 0) >= model.total.get(w, 1):
                x.append(model.features(*key))
                y.append(1)
            if kind == PERIOD and prev and model.finals.get(prev, 0) < 0.04 * model.dotted.get(prev, 1) and opens:  # such a token ends nothing, whatever follows
                w, raw = _next_token(opens[(len(x) * 104729 + 5) % len(opens)])
                x.append(model.features(prev, kind, gap, w, _case(raw), nocase, NONE, PLAIN, False, 1))
                y.append(0)
    for i, (body, last, thai, m) in enumerate(tails):
        after = opens[(i * 7919 + 13) % len(opens)] if opens else ""
        if not after:
            continue
        if m is None and thai:  # a Thai sentence ends before a blank
            w, raw = _next_token(after)
            x.append(model.features(_prev_token(last), BLANK, True, w, _case(raw), True, NONE, PLAIN, False, 1))
            y.append(1)
        elif m is not None:
            both = body.rstrip() + ("" if m["t"][-1] in "。！？｡．" or i % 9 == 0 else " ") + after
            c = _CAND.match(both, m.start())
            key = _key(both, 0, c, c.end(), _first(both, c.end(), len(both)), len(both), None) if c is not None and c.end() < len(both) else None
            if key is not None and key[6] != CLOSES_FIRST:  # behind a quotation alone its speaker may be named
                nocase = key[4] == "a" and (key[5] or i % 3 == 0)
                x.append(model.features(*key[:5], nocase, *key[6:], 1))
                y.append(1)
    thai_ends = [_prev_token(last) for _, last, thai, m in tails if thai]
    seen = sorted(t for t in own[3] if _THAI.match(t) and not model.starts.get(t) and model.total.get(t, 0) >= NEVER_OPENS)
    for j in range(len(thai_ends) if seen else 0):  # within a sentence: any letters before such as start nothing
        w = seen[(j * 31) % len(seen)]
        x.append(model.features(seen[(j * 17 + 7) % len(seen)], BLANK, True, w, "字", True, NONE, PLAIN, False))
        y.append(0)
    for key, label in PRIOR:  # what small corpora may not show
        x += [model.features(*key)] * 3
        y += [label] * 3
    xs, ys = np.array(x), np.array(y, float)
    share = ys.mean()
    sw = np.where(ys == 1, 0.5 / share, 0.5 / (1 - share))
    w = np.zeros(_N)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        w -= 2.0 * (xs.T @ (sw * (p - ys)) / sw.sum() + 2e-4 * w)
    model.weights = w
    return model


def fit(cues: DataFrame, sample: int = SAMPLE) -> BoundaryModel:
    c = cues.where("text IS NOT NULL").select("cue_id", "text")
    n = max(1, c.count())
    share = min(1.0, sample / n)
    picked = c.where(F.pmod(F.xxhash64("cue_id", F.lit(3)), F.lit(1_000_003)) < share * 1_000_003)
    return train(sorted(r.text for r in picked.select("text").collect()), counts=corpus_counts(c))


def _filler_only(chunk: str) -> bool:
    s = chunk.strip().strip(".…,，、!?-— ").lower()
    return s in LEAD_INS or not is_speech(chunk)


def _first(masked: str, a: int, b: int) -> int:
    while a < b and (masked[a].isspace() or masked[a] in "​⁠﻿‎‏"):
        a += 1
    return a


_SAYS = re.compile(r"[^\W_]")


def cuts(text: str, model: BoundaryModel, read: tuple[str, list[tuple[str | None, int, int]]] | None = None) -> list[tuple[int, int]]:
    """``(first, end)`` of each sentence of a cue, in code points of the original text.

    ``read``: the text masked and its lines, where they are at hand.
    """
    masked, lines = read or read_lines(text)[:2]
    if "@" in masked or "＠" in masked or "[" in masked or "(" in masked:
        masked = _MAIL.sub(lambda m: "x" * len(m[0]), masked)
    out: list[tuple[int, int]] = []
    marks = _candidates(masked)
    for _, a, b in lines:
        if _SAYS.search(masked, a, b) is None:
            continue
        start = _first(masked, a, b)
        stop = a + len(masked[a:b].rstrip())
        for m in marks.finditer(masked, a, b):
            if m.end() >= stop:
                break
            end = _end(masked, start, m)
            at = _first(masked, end, b)
            if at >= stop or _filler_only(masked[start : m.start()]):
                continue
            key = _key(masked, start, m, end, at, stop, None)
            if key is None or not model.decide(*key):
                continue
            if _SAYS.search(masked, at, stop) is None:
                break
            out.append((start, end if m["t"] else m.start()))
            start = at
        if out and out[-1][0] >= a and _filler_only(masked[start:stop]):
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


_ANY_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ]")


def _case(raw: str) -> str:
    """The class of a token's first letter: digit, capital, lower case, or a letter without case."""
    return "0" if raw.isdigit() else "A" if raw.isupper() else "a" if raw.islower() else "字"


def _end(masked: str, start: int, m: re.Match) -> int:
    """Where a candidate's mark ends; a raised “ closes only what „ opened, else it belongs to what follows."""
    if m["q"] and "“" in m["q"] and masked.rfind("„", start, m.start()) <= masked.rfind("“", start, m.start()):
        return m.start("q") + m["q"].index("“")
    return m.end()


def _quote_state(masked: str, start: int, end: int, closing: bool) -> int:
    depth: list[str] = []
    opened = start
    some = False
    for q in _QUOTES.finditer(masked, start, end):
        some = True
        c = q[0]
        if c == '"' and depth and depth[-1] == '"':
            depth.pop()
        elif c == '"' or c in _OPEN and not (c == "“" and depth and depth[-1] == "„"):
            depth.append(c)
            opened = q.start()
        elif depth:
            depth.pop()
    if depth:
        return INSIDE
    if not some:
        return NONE
    if not closing:
        return CLOSED
    return CLOSES_LATER if masked[start:opened].strip("\u200b ") else CLOSES_FIRST


def _key(masked: str, start: int, m: re.Match, end: int, at: int, stop: int, nocase: bool | None) -> tuple | None:
    """What the features of a candidate are made of, or None where no word follows."""
    term, nxt = m["t"], masked[at]
    quote = masked[m.end("t") : end] if term else ""
    closing = bool(quote) and quote.strip(")] ") != ""
    quotes = _quote_state(masked, start, end, closing)
    follow = COMMA if nxt in ",，、;；:：)）]」』”»" else DASH if quote and nxt in "—–" else OPENS if nxt in _OPEN else PLAIN
    w, raw = _next_token(masked[at : at + 40])
    if not raw:
        return None if follow == PLAIN else ("", PERIOD, True, "", "字", False, quotes, follow, False)
    gap = at > end or not term
    if not term:
        kind = BLANK
    elif set(term) & set(".…．"):
        kind = PERIOD if term in ".．" else DOTS
    else:
        kind = STRONG if term[-1] in "!?" else WIDE if term[-1] in "。！？｡" else OTHER
    weak = kind in (PERIOD, DOTS, BLANK)
    initials = not gap and at + 1 < stop and masked[at + 1].isupper() and raw.isupper()
    if nocase is None:
        nocase = _ANY_UPPER.search(masked, start, stop) is None
    return _prev_token(masked[start : m.start()]) if weak else "", kind, gap, w, _case(raw), nocase, quotes, follow, initials


_OUT = pa.schema([("cue_id", pa.int64()), ("sent_no", pa.int32()), ("begin_at", pa.int32()), ("end_at", pa.int32())])
OUT_DDL = "cue_id bigint, sent_no int, begin_at int, end_at int"


def _splitter(model: BoundaryModel, later_only: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, at, end = [], [], [], []
            for cue, text in zip(b.column("cue_id").to_pylist(), b.column("text").to_pylist()):
                found = cuts(text, model)
                for j in range(1 if later_only else 0, len(found)):
                    ids.append(cue)
                    no.append(j)
                    at.append(found[j][0])
                    end.append(found[j][1])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(at, pa.int32()), pa.array(end, pa.int32())], schema=_OUT)

    return split


def sentences(cues: DataFrame, model: BoundaryModel | None = None, later_only: bool = False) -> DataFrame:
    """``cue_id, sent_no, begin_at, end_at`` of every sentence; null, blank and wordless texts have none, redelivered cues count once."""
    model = model or fit(cues)
    every = cues.where("text IS NOT NULL AND cue_id IS NOT NULL").select("cue_id", "text").mapInArrow(_splitter(model, later_only), OUT_DDL)
    return every if later_only else every.distinct()


def p3_found(cues: DataFrame, model: BoundaryModel | None = None) -> DataFrame:
    return sentences(cues, model, later_only=True).select("cue_id", F.col("begin_at").alias("cut_at")).distinct()
