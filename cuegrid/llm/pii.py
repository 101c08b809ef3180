"""Problem 4: personal information in free text, found and replaced by typed placeholders.

Two kinds of evidence decide.

* *Form.*  Email addresses, phone, identity and street numbers are recognised by their form, also where it is disguised
  (spelled-out digits and words, full-width characters, bracketed at and dot).  A bare run of digits says little by its
  form; there the terms before it decide: corpus co-occurrence tells which terms stand before the numbers of persons and
  which before those of things (orders, tickets, samples), and behind the latter it stays.
* *Corpus co-occurrence.*  Which terms reveal a person is estimated over all cues: starting from an incomplete list of
  name parts, a term is a family name to the degree that it follows given names, and a given name to the degree that it
  precedes family names.  ``disclosure`` holds each term's probability of revealing an entity and its pointwise mutual
  information with it; terms beyond both thresholds are protected, the others stay.  A full name is a protected given name
  with a protected family name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions.lines import plain, read_lines

#: Disclosure thresholds: probability of an entity given the term, and mutual information in bits.
MIN_SHARE = 0.15
MIN_BITS = 4.0
MIN_SEEN = 2
#: More protected terms than this travel as sorted 64-bit hashes (8 bytes a term) instead of strings.
LEXICON_BOUND = 500_000
#: A term marks numbers of things if it stands before so many and this share of its numbers are no person's.
THING_SEEN, THING_SHARE = 5, 0.8
#: Terms before a number that tell whose it is.
BEFORE = 4

#: Full-width characters and their usual forms (one to one, so offsets stay).
_WIDE = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF20: 0x40, 0xFF0E: 0x2E, 0xFF0B: 0x2B, 0xFF0D: 0x2D, 0xFF08: 0x28, 0xFF09: 0x29, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0xA0: 0x20, 0x2007: 0x20, 0x202F: 0x20, 0x2009: 0x20}
_WIDE |= {0xFF21 + i: 0x41 + i for i in range(26)} | {0xFF41 + i: 0x61 + i for i in range(26)}

_A = r"[A-Za-z0-9]"
_DOTS = ("dot", "punto", "ponto", "point", "punkt")
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s+(?:dot|plus|dash|minus|underscore|punto)\s+[A-Za-z0-9]+)*(?:\s?@\s?|\s?[\[({{]\s?(?:at|arroba|@)\s?[\])}}]\s?|\s+(?:at|arroba)\s+(?=[\w-]+(?:\s+(?:dot|punto|ponto|point|punkt)\s+\w+)))"
    rf"{_A}[A-Za-z0-9-]*(?:(?:\.|\s?[\[({{]\s?(?:dot|punto|\.)\s?[\])}}]\s?|\s+(?:dot|punto|ponto|point|punkt)\s+){_A}[A-Za-z0-9-]*)+",
    re.I,
)

_E = r"(?![A-Za-z0-9]|[.:/-]\d)"
_S = r"(?<![A-Za-z0-9.:/№-])"
ID = re.compile(
    "|".join(
        [
            rf"{_S}\d{{17}}[\dXx]{_E}",
            rf"{_S}\d{{3}}([ -])\d\d\1\d{{4}}{_E}",
            rf"{_S}[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-D]{_E}",
            rf"{_S}[A-Z]\d{{8}}{_E}",
            rf"{_S}[A-Z]\d{{7}}[A-Z]{_E}|{_S}[A-Z]\d \d{{6}} [A-Z] \d{_E}",
            rf"{_S}\d \d\d \d\d \d\d \d{{3}} \d{{3}} \d\d{_E}|{_S}[012]\d{{14}}{_E}",
            rf"{_S}\d{{8}}-?[A-Z]{_E}|{_S}\d\d\.\d{{3}}\.\d{{3}}-[A-Z]{_E}|{_S}[XYZ]-?\d{{7}}-?[A-Z]{_E}",
            rf"{_S}\d{{8}} \d [A-Z]{{2}}\d{_E}",
            rf"{_S}\d\d \d\d \d{{6}}{_E}|{_S}\d{{4}} ?№ ?\d{{6}}{_E}",
            rf"{_S}\d{{6}}-[1-4]\d{{6}}{_E}",
        ]
    ),
    re.I,
)
PHONE = re.compile(
    "|".join(
        [
            rf"(?<![A-Za-z0-9+])(?:\+|00)\d{{1,3}}[ -]?(?:\(\d{{1,4}}\)[ -]?)?\d{{1,5}}(?:[ -]\d{{2,8}}){{1,4}}{_E}|(?<![A-Za-z0-9+])\+\d{{9,14}}{_E}",
            rf"(?<![\w(])\(\d{{2,5}}\)[ -]?\d{{3,4}}[ -]?\d{{2,4}}(?:-\d\d)?{_E}",
            rf"{_S}\d{{3}}([. -])\d{{3}}\1\d{{4}}{_E}",
            rf"{_S}0\d{{1,4}}[ /-]\d{{3,8}}(?:[ -]\d{{3,6}})?{_E}",
            rf"{_S}0\d(?:[ .]\d\d){{4}}{_E}|{_S}0\d{{9,10}}{_E}",
            rf"{_S}[67]\d\d \d\d \d{{3}} \d\d{_E}|{_S}[679]\d\d([ -])\d{{3}}\2\d{{3}}{_E}|{_S}6\d{{8}}{_E}",
            rf"{_S}2\d \d{{3}} \d{{4}}{_E}",
            rf"{_S}8([ -])\d{{3}}\3\d{{3}}(?:\3\d\d\3\d\d|\3\d{{4}}){_E}",
            rf"{_S}1[3-9]\d([ -]?)\d{{4}}\4\d{{4}}{_E}|{_S}01\d-\d{{3,4}}-\d{{4}}{_E}",
            rf"{_S}[2-9]\d{{9}}{_E}",
            rf"{_S}\d{{3}}-\d{{4}}{_E}",
        ]
    )
)
#: Number words in which digits are spelled, and letters that are digits.
_DIGIT_WORDS = (
    "oh|zero|one|two|three|four|five|six|seven|eight|nine",
    "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
    "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
)
_DIGIT_LETTERS = "[零〇一二三四五六七八九幺两]{7,}|[공영일이삼사오육칠팔구]{9,}"
SPELLED = re.compile("|".join([*(rf"{a}(?:(?:{w})[ ,-]+){{6,}}(?:{w}){e}" for w, a, e in zip(_DIGIT_WORDS, (r"(?<![A-Za-z])", *[r"(?<!\w)"] * 3), (r"(?![A-Za-z])", *[r"(?!\w)"] * 3))), _DIGIT_LETTERS]), re.I)

_NUM_WORDS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
_NUM_WORD = rf"(?:{_NUM_WORDS}|(?:one )?hundred)"
_STREETS = "street|road|drive|avenue|lane|hill|court|close|square|terrace|crescent|gardens|row|way|rd|ave|blvd|boulevard"
_STOP = r"(?!(?:of|the|and|in|on|at|to|for|with|is|was|a|an|minutes?|seconds?|cues?|pm|am|feeds?)\b)"
ADDRESS = re.compile(
    "|".join(
        [
            rf"(?<![\w.,:/-])(?:\d{{1,5}} ?[a-z]?|{_NUM_WORD}(?:[ -]{_NUM_WORD}){{0,3}}),? (?:{_STOP}[A-Za-z][\w'’.-]* ){{1,3}}(?:{_STREETS})(?![\w-])",
            r"(?<!\w)(?:[^\W\d_]{3,}(?:weg|straße|strasse|str\.|gasse|platz|allee|ufer|damm|steig)|(?:platz|straße|weg|allee|gasse|ufer|am|an|zum|zur|im)(?: (?:der|des|den|dem))? [^\W\d_]{3,}) \d{1,4} ?[a-z]?(?![\w.,]\d|\w)",
            r"(?<![\w.,:/-])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|quai|boulevard|place|chemin|allée|impasse|cours|route|square)\b",
            r"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|callejón|carretera|rua|praça|travessa|largo|alameda) (?:[^\W\d_]+ ){1,5}?(?:n\.?º? ?)?\d{1,4}(?!\w)",
            r"(?<!\w)(?:ул(?:ица|ице|\.)|просп(?:ект|екте|\.)|пер(?:еулок|еулке|\.)|набережная|набережной|площад[ьи]|шоссе) (?:[^\W\d_-]+[ -]?){1,3},? (?:д(?:ом|\.) ?)?\d{1,4}",
            r"(?:(?<=[到在住于往去址是寄给])|(?<![一-鿿]))(?:(?![到在住于往去址是寄给])[一-鿿]){1,8}?(?:路|街|巷|大道|弄|胡同)\d{1,5}号",
            r"[一-鿿ヶ]{1,6}\d{1,4}(?:丁目\d{0,4}(?:番地?)?\d{0,4}|番地|-\d{1,4}-\d{1,4}(?![\d-]))",
            r"[가-힣]+(?:로|길) ?\d{1,4}번(?:길|지)(?: ?\d{1,4})?",
        ]
    ),
    re.I,
)
#: Gates: what a text must hold for a pattern to match, taken from the alternatives of that pattern.
_WIDE_CHARS = frozenset(map(chr, _WIDE))
_DIGIT = re.compile(r"\d")
_AT_SIGNS = ("@", "[", "(", "{")
_SPELL_WORDS = frozenset("|".join(_DIGIT_WORDS).split("|"))
_SPELL_LETTERS = re.compile(_DIGIT_LETTERS)
_STREET_GATE = tuple(f" {w}" for w in _STREETS.split("|"))
_NUM_GATE = (*_NUM_WORDS.split("|"), "hundred")
#: Letters that patterns equate with ASCII letters and ``lower`` does not.
_ODD_CASE = frozenset("ſıİ")


def _may_email(s: str, low: str) -> bool:
    return any(c in s for c in _AT_SIGNS) or any(w in low for w in _DOTS) and ("at" in low or "arroba" in low)


def _may_spell(s: str, low: str) -> bool:
    """Between the first and the last of seven digit words five stand between separators."""
    words = low.replace(",", " ").replace("-", " ").split()
    if not _SPELL_WORDS.isdisjoint(words) and sum(w in _SPELL_WORDS for w in words) >= 5:
        return True
    return not s.isascii() and (_SPELL_LETTERS.search(s) is not None or not _ODD_CASE.isdisjoint(s))


def _may_address(s: str, low: str) -> bool:
    """For texts without digits: only the English form takes a number in words."""
    if any(w in low for w in _STREET_GATE) and any(w in low for w in _NUM_GATE):
        return True
    return not s.isascii() and not _ODD_CASE.isdisjoint(s)


_TOKEN = re.compile(r"[^\W\d_]{2,}(?:['’][^\W\d_]+)?")
_HAN = re.compile(r"[一-鿿ヶ々]{2,}")
_KANA = re.compile(r"[぀-ゟ]")
_HAN1 = re.compile(r"[一-鿿]")
#: What may stand between a given and a family name: a blank, and an initial or a second given name.
_JOIN = re.compile(r"[  \n]+(?:[^\W\d_]\.?[  ]+)?")


_BLANKS = re.compile(r"[\s(\[“”\"«»„¿¡'’-]+")


def _lower(s: str) -> str:
    """Lower case of the same length."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in s)


class HashSet:
    """Membership of terms by sorted 64-bit hashes, for lexicons too large to travel as strings."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)

    def __contains__(self, term: str) -> bool:
        h = np.uint64(xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)).astype(np.int64)  # as Spark's xxhash64
        i = int(np.searchsorted(self.hashes, h))
        return i < len(self.hashes) and self.hashes[i] == h

    def isdisjoint(self, terms: Iterable[str]) -> bool:
        return not any(t in self for t in terms)


class Names:
    """Protected given and family terms, lower case, the Han patterns made of them, and the terms of things' numbers."""

    def __init__(self, given: Iterable[str] | HashSet, family: Iterable[str] | HashSet, things: Iterable[str] = ()):
        self.things = frozenset(things)
        self.large = isinstance(given, HashSet)
        if self.large:
            self.given = self.spaced_given = given
            self.family = self.spaced_family = family
            self.han = None
            return
        self.given, self.family = frozenset(given), frozenset(family)
        self.spaced_given = frozenset(x for x in self.given if not _HAN1.search(x))
        self.spaced_family = frozenset(x for x in self.family if not _HAN1.search(x))
        g = sorted((x for x in self.given if _HAN1.search(x)), key=len, reverse=True)
        f = sorted((x for x in self.family if _HAN1.search(x)), key=len, reverse=True)
        self.han = re.compile(f"(?:{'|'.join(f)})(?:{'|'.join(g)})") if g and f else None

    def _han(self, masked: str) -> Iterator[tuple[int, int]]:
        """Han names, where the lexicon is too large for a pattern: family and given parts of up to four letters."""
        for run in _HAN.finditer(masked):
            i = run.start()
            while i < run.end():
                end = next((k for j in range(min(i + 4, run.end()), i, -1) if masked[i:j] in self.family for k in range(min(j + 4, run.end()), j, -1) if masked[j:k] in self.given), None)
                if end:
                    yield i, end
                i = end or i + 1

    def find(self, masked: str, low: str) -> Iterator[tuple[int, int]]:
        if not masked.isascii():
            if self.han is not None:
                for m in self.han.finditer(masked):
                    yield m.span()
            elif self.large:
                yield from self._han(masked)
        if self.spaced_given.isdisjoint(_BLANKS.split(low)):
            return
        toks = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(low)]
        if toks and not self.spaced_family.isdisjoint(t for t, _, _ in toks):
            i = 0
            while i < len(toks):
                if toks[i][0] not in self.spaced_given:
                    i += 1
                    continue
                j = i
                while j + 1 < len(toks) and toks[j + 1][0] in self.spaced_given and low[toks[j][2] : toks[j + 1][1]] in ("-", " ", "‐") and toks[j + 1][0] not in self.spaced_family:
                    j += 1
                if j + 1 < len(toks):
                    w = toks[j + 1][0]
                    if (w in self.spaced_family or re.split("['’]", w)[0] in self.spaced_family) and _JOIN.fullmatch(low, toks[j][2], toks[j + 1][1]):
                        yield toks[i][1], toks[j + 1][2]
                        j += 1
                i = j + 1

    def of_thing(self, low: str, at: int) -> bool:
        """Whether the terms before a number say that it is no person's."""
        return bool(self.things) and not self.things.isdisjoint(_before(low, at))


#: Anything that may be the number of a person or a thing.
_NUMBER = re.compile(r"(?<![\w.:,/-])(?:\+|\(|№ ?)?[A-Za-z]{0,2}\d[\d() ./№-]{4,}[\dA-Za-z]?")
_BARE = re.compile(r"\d+")
_NEAR = re.compile(r"[^\W\d_]+|[.!?。！？]\s")


def _before(low: str, at: int) -> list[str]:
    """The last terms before ``at`` in its sentence; letter pairs where words are not spaced."""
    out: list[str] = []
    for w in reversed(_NEAR.findall(low[max(0, at - 48) : at])):
        if w[0] in ".!?。！？" or len(out) >= BEFORE:
            break
        out += [w[i : i + 2] for i in range(max(0, len(w) - 5), len(w) - 1)] if _HAN1.search(w) else [w]
    return out


def _mask(s: str, spans: Iterable[tuple[int, int]]) -> str:
    for a, b in spans:
        s = s[:a] + "\x00" * (b - a) + s[b:]
    return s


def spot(text: str, names: Names) -> list[tuple[str, int, int]]:
    """``(kind, first, end)`` of each piece of personal information, in order."""
    masked = text if plain(text) else read_lines(text)[0]
    s = masked if masked.isascii() or _WIDE_CHARS.isdisjoint(masked) else masked.translate(_WIDE)
    low = _lower(s)
    out: list[tuple[str, int, int]] = []

    def take(kind: str, spans: Iterable[tuple[int, int]]) -> None:
        nonlocal s
        spans = list(spans)
        out.extend((kind, a, b) for a, b in spans)
        if spans:
            s = _mask(s, spans)

    if _may_email(s, low):
        take("email", (m.span() for m in EMAIL.finditer(s)))
    digits = _DIGIT.search(s) is not None
    if _may_spell(s, low):
        for m in list(SPELLED.finditer(s)):
            n = len(re.findall(r"\w+", m[0])) if " " in m[0] or "-" in m[0] else len(m[0])
            kind = "id_number" if n in (9, 15, 17, 18) else "phone"
            out.append((kind, *m.span()))
            s = _mask(s, [m.span()])
    if digits or _may_address(s, low):
        take("address", (m.span() for m in ADDRESS.finditer(s)))
    if digits:
        for kind, pattern in (("id_number", ID), ("phone", PHONE)):
            take(kind, (m.span() for m in pattern.finditer(s) if not (_BARE.fullmatch(m[0]) and names.of_thing(low, m.start()))))
    take("name", names.find(s, low if not out else _lower(s)))
    return sorted(out, key=lambda x: x[1]) if len(out) > 1 else out


def redact(text: str | None, names: Names) -> str | None:
    """The text with each piece replaced by ``<EMAIL>``, ``<PHONE>``, ``<ID_NUMBER>``, ``<ADDRESS>`` or ``<NAME>``."""
    if not text:
        return text
    at, parts = 0, []
    for kind, a, b in spot(text, names):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join([*parts, text[at:]]) if parts else text


_COUNTS = pa.schema([("term", pa.string()), ("n", pa.int64()), ("given", pa.int64()), ("family", pa.int64()), ("persons", pa.int64()), ("things", pa.int64())])
_COUNTS_DDL = "term string, n bigint, given bigint, family bigint, persons bigint, things bigint"


def _numbers(s: str, of_persons: Counter, of_things: Counter) -> None:
    """Count the terms before each longer number of a text, apart for those that have a person's form and for all else."""
    if not (s.isascii() or _WIDE_CHARS.isdisjoint(s)):
        s = s.translate(_WIDE)
    taken = [m.span() for p in (ID, PHONE) for m in p.finditer(s)]
    for m in _NUMBER.finditer(s):
        if sum(ch.isdigit() for ch in m[0]) >= 6:
            mine = any(a < m.end() and m.start() < b for a, b in taken)
            (of_persons if mine else of_things).update(_before(s, m.start()))


def _counter(given: frozenset[str], family: frozenset[str]):
    """Per term: how often it occurs, precedes a known family name, follows a known given name, stands before numbers."""
    seeds = Names(given, family)
    han_given = re.compile("|".join(sorted((x for x in given if _HAN1.search(x)), key=len, reverse=True)) or r"(?!)")
    han_family = re.compile("|".join(sorted((x for x in family if _HAN1.search(x)), key=len, reverse=True)) or r"(?!)")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, as_given, as_family, of_persons, of_things = (Counter() for _ in range(5))

        def flush() -> pa.RecordBatch:
            terms = [t for t, k in n.items() if k] + [t for t in (of_persons | of_things) if not n.get(t)]
            rows = [(t, n.get(t, 0), as_given.get(t, 0), as_family.get(t, 0), of_persons.get(t, 0), of_things.get(t, 0)) for t in terms]
            for c in (n, as_given, as_family, of_persons, of_things):
                c.clear()
            cols = list(zip(*rows)) or [[]] * len(_COUNTS)
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _COUNTS)], schema=_COUNTS)

        for b in batches:
            for text in b.column("text").to_pylist():
                masked = text if plain(text) else read_lines(text)[0]
                s = masked.lower()
                if "@" in s or "＠" in s or "at" in s and ("[" in s or "(" in s):
                    s = _mask(s, [m.span() for m in EMAIL.finditer(s.translate(_WIDE))])
                if _NUMBER.search(s):
                    _numbers(s, of_persons, of_things)
                if _HAN1.search(s):
                    ja = bool(_KANA.search(s))
                    for run in _HAN.findall(s):
                        if ja:
                            m = han_family.match(run)
                            rest = run[m.end() :] if m else ""
                            g = han_given.search(run)
                            if m and 1 <= len(rest) <= 4:
                                as_given[rest] += 1
                                n[rest] += 0 if g and g[0] == rest else 1
                            if g and g.end() == len(run) and 1 <= g.start() <= 4:
                                as_family[run[: g.start()]] += 1
                                n[run[: g.start()]] += 0 if m and m[0] == run[: g.start()] else 1
                            n[run] += 1
                        else:
                            n.update(run)
                            n.update(map("".join, zip(run, run[1:])))
                            for m in han_family.finditer(run):
                                if len(run) >= m.end() + 2:
                                    as_given[run[m.end() : m.end() + 2]] += 1
                            for m in han_given.finditer(run):
                                if m.start() >= 1:
                                    as_family[run[m.start() - 1]] += 1
                toks = _TOKEN.findall(s)
                if not toks:
                    continue
                n.update(toks)
                if seeds.spaced_given.isdisjoint(toks) and seeds.spaced_family.isdisjoint(toks):
                    continue
                spans = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(s)]
                for (x, _, e), (y, a, _) in zip(spans, spans[1:]):
                    if _JOIN.fullmatch(s, e, a):
                        if x in seeds.spaced_given:
                            as_family[y] += 1
                        if y in seeds.spaced_family:
                            as_given[x] += 1
            if len(n) > 300_000:
                yield flush()
        yield flush()

    return count


def _seeds(name_parts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The given list of name parts, lower case; a short list by its nature."""
    rows = name_parts.where("name_text IS NOT NULL").select(F.lower(F.trim("name_text")).alias("t"), "name_kind").distinct().collect()
    return frozenset(r.t for r in rows if r.name_kind == "given"), frozenset(r.t for r in rows if r.name_kind == "family")


def _term_counts(cues: DataFrame, name_parts: DataFrame) -> DataFrame:
    per = cues.where("text IS NOT NULL").select("text").mapInArrow(_counter(*_seeds(name_parts)), _COUNTS_DDL)
    return per.groupBy("term").agg(*(F.sum(c).alias(c) for c in _COUNTS.names[1:])).persist(StorageLevel.MEMORY_AND_DISK)


def disclosure(cues: DataFrame, name_parts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``term, n, given_share, family_share, given_bits, family_bits, thing_share, number_n`` of terms next to name parts or numbers.

    Counts cover all cues; a redelivered cue counts as often as it comes, which moves shares of rare terms only.
    """
    per = counts if counts is not None else _term_counts(cues, name_parts)
    t = per.agg(F.sum("n").alias("n"), F.sum("given").alias("g"), F.sum("family").alias("f")).first()
    base = {"all_n": t.n or 1, "all_given": t.g or 1, "all_family": t.f or 1}
    s = per.where("given > 0 OR family > 0 OR things > 0").withColumns({k: F.lit(float(v)) for k, v in base.items()})
    return s.select(
        "term", "n",
        F.expr("CASE WHEN n > 0 THEN least(1.0, given / n) ELSE 0.0 END").alias("given_share"), F.expr("CASE WHEN n > 0 THEN least(1.0, family / n) ELSE 0.0 END").alias("family_share"),
        F.expr("CASE WHEN given > 0 AND n > 0 THEN log2((given / n) / (all_given / all_n)) END").alias("given_bits"), F.expr("CASE WHEN family > 0 AND n > 0 THEN log2((family / n) / (all_family / all_n)) END").alias("family_bits"),
        F.expr("given").alias("given_n"), F.expr("family").alias("family_n"),
        F.expr("CASE WHEN persons + things > 0 THEN things / (persons + things) END").alias("thing_share"), F.expr("persons + things").alias("number_n"),
    )


def protected_names(cues: DataFrame, name_parts: DataFrame, bound: int = LEXICON_BOUND) -> Names:
    """The terms beyond the disclosure thresholds, with the given list; as strings, or as hashes beyond ``bound``."""
    counts = _term_counts(cues, name_parts)
    d = disclosure(cues, name_parts, counts)
    keep = d.select(
        "term",
        F.expr(f"given_n >= {MIN_SEEN} AND given_share >= {MIN_SHARE} AND given_bits >= {MIN_BITS} AND (given_share >= family_share OR family_n < {MIN_SEEN})").alias("g"),
        F.expr(f"family_n >= {MIN_SEEN} AND family_share >= {MIN_SHARE} AND family_bits >= {MIN_BITS} AND (family_share >= given_share OR given_n < {MIN_SEEN})").alias("f"),
    ).where("g OR f")
    given, family = _seeds(name_parts)
    things = [r.term for r in d.where(f"number_n >= {THING_SEEN} AND thing_share >= {THING_SHARE}").select("term").orderBy(F.desc("number_n"), "term").limit(bound).collect()]
    rows = keep.limit(bound + 1).collect()
    if len(rows) <= bound:
        counts.unpersist()
        return Names({r.term for r in rows if r.g} | given, {r.term for r in rows if r.f} | family, things)
    seed = cues.sparkSession.createDataFrame([(t, True, False) for t in given] + [(t, False, True) for t in family], "term string, g boolean, f boolean")
    t = keep.union(seed).select(F.xxhash64("term").alias("h"), "g", "f").toArrow()
    h = t["h"].to_numpy()
    counts.unpersist()
    return Names(HashSet(h[t["g"].to_numpy()]), HashSet(h[t["f"].to_numpy()]), things)


_OUT = pa.schema([("cue_id", pa.int64()), ("kind", pa.string()), ("begin_at", pa.int32()), ("end_at", pa.int32())])


def _spotter(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(cue, *x) for cue, text in zip(b.column("cue_id").to_pylist(), b.column("text").to_pylist()) for x in spot(text, names)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return run


def personal_information(cues: DataFrame, name_parts: DataFrame, names: Names | None = None) -> DataFrame:
    """``cue_id, kind, begin_at, end_at`` of every piece; null and empty texts have none."""
    names = names or protected_names(cues, name_parts)
    return cues.where("text IS NOT NULL AND cue_id IS NOT NULL").select("cue_id", "text").mapInArrow(_spotter(names), "cue_id bigint, kind string, begin_at int, end_at int")


def p4_found(cues: DataFrame, name_parts: DataFrame) -> DataFrame:
    return personal_information(cues, name_parts).select("cue_id", "kind", "begin_at").distinct()


def redacted(cues: DataFrame, name_parts: DataFrame) -> DataFrame:
    """``cue_id, text``: all cues, personal information replaced by typed placeholders, redelivered rows once."""
    names = protected_names(cues, name_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("cue_id"), pa.array([redact(t, names) for t in b.column("text").to_pylist()], pa.string())], names=["cue_id", "text"])

    return cues.select("cue_id", "text").mapInArrow(run, "cue_id bigint, text string").distinct()
