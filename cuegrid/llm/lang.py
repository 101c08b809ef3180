"""Problem 1: languages of cues and of their passages by rank-order profiles.

A profile is a language's most frequent character n-grams in order.  A passage is given the language whose profile is
nearest by out-of-place distance: the sum over the passage's n-grams of the difference between their rank there and in
the profile, a missing n-gram counting as the profile's length.  Profiles are trained on labelled cues of the data
themselves (a bounded sample: ``PER_LANGUAGE`` cues a language in expectation), then once more after the sample's own
sentences were sorted by the first profiles, as labels may be wrong and cues mixed.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions.lines import plain, read_lines
from cuegrid.llm.fillers import WORDS as FILLERS

PER_LANGUAGE = 600
PROFILE = 1500
MIN_WORDS = 3
MIN_LETTERS = 6

LANGUAGES = ("en", "fr", "de", "es", "pt", "ru", "zh", "ja", "ko", "ar", "hi", "th")
#: Three-letter codes and English names of the languages, as found in labels.
CODES = {
    "en": "eng english", "fr": "fra fre french", "de": "deu ger german", "es": "spa spanish castilian", "pt": "por portuguese", "ru": "rus russian",
    "zh": "zho chi cmn chinese mandarin", "ja": "jpn japanese", "ko": "kor korean", "ar": "ara arb arabic", "hi": "hin hindi", "th": "tha thai",
}
NAMES = {c: k for k, v in CODES.items() for c in [k, *v.split()]}


def named_language(label: str | None) -> str | None:
    """The language a label names in any usual spelling, or None."""
    if not label:
        return None
    s = label.strip().lower()
    return NAMES.get(s) or NAMES.get(re.split(r"[-_ (]", s, maxsplit=1)[0])


#: Scripts and the languages that write them; the first match of a letter decides its script.
GROUPS = {
    "latin": ("en", "fr", "de", "es", "pt"), "cyrillic": ("ru",), "cjk": ("zh", "ja"), "hangul": ("ko",), "arabic": ("ar",), "devanagari": ("hi",), "thai": ("th",),
}
_GROUP_OF = {k: g for g, ks in GROUPS.items() for k in ks}
UNSPACED = {"zh", "ja", "th"}

_SCRIPTS = {
    "latin": r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "cyrillic": r"\u0400-\u04ff", "cjk": r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3005", "hangul": r"\uac00-\ud7a3\u1100-\u11ff",
    "arabic": r"\u0621-\u065f\u066e-\u06d3", "devanagari": r"\u0900-\u0963\u0971-\u097f", "thai": r"\u0e01-\u0e3a\u0e40-\u0e4e",
}
#: A stretch begins with a letter of its script and goes on to the next letter of another.
_STRETCH = re.compile("|".join(f"(?P<{n}>[{c}][^{''.join(x for m, x in _SCRIPTS.items() if m != n)}]*)" for n, c in _SCRIPTS.items()))
_MAIL = re.compile(r"[\w.+-]+(?:\s?[@＠]\s?|\s?[\[(]\s?at\s?[\])]\s?| arroba )[\w.-]+(?:\s?[\[(]\s?dot\s?[\])]\s?[\w-]+)*|(?:https?://|www\.)\S+", re.I | re.A)


def ngrams(word: str) -> list[str]:
    w = f"_{word}_"
    twos = [*map(add, w, w[1:])]
    return [*word.replace("_", ""), *twos, *map(add, twos, w[2:])]


#: Passages measured at once; their n-grams fit a core's cache.
_BLOCK = 512
#: Bits of an n-gram's number and of its count, where passage, count and n-gram are sorted as one number.
_GRAM, _COUNT = 22, 20


class _Grams(dict):
    """The numbers of a word's n-grams, as the bytes of an array."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        found = self[word] = array("i", map(self.ids.get, ngrams(word), repeat(len(self.ids)))).tobytes()
        return found


class Profiles:
    """Trained profiles; ``classify`` gives language, confidence and the distances of a passage, ``measure`` those of many."""

    def __init__(self, ranked: dict[str, list[str]]):
        self.ranked = {k: v[:PROFILE] for k, v in ranked.items()}
        self.cache: dict = {}
        self.sentences: dict = {}
        self._build()

    def _build(self) -> None:
        self.ids: dict[str, dict[str, int]] = {}
        self.ranks: dict[str, np.ndarray] = {}
        for g, langs in GROUPS.items():
            ids: dict[str, int] = {}
            for k in langs:
                for t in self.ranked.get(k, []):
                    ids.setdefault(t, len(ids))
            r = np.full((len(langs), len(ids) + 1), 4 * PROFILE, np.int16)  # beyond any distance that counts
            for j, k in enumerate(langs):
                for i, t in enumerate(self.ranked.get(k, [])):
                    r[j, ids[t]] = i
            self.ids[g], self.ranks[g] = ids, r
        self.words = {g: _Grams(ids) for g, ids in self.ids.items()}

    def __getstate__(self):
        return self.ranked

    def __setstate__(self, state):
        self.ranked, self.cache, self.sentences = state, {}, {}
        self._build()

    def distances(self, passages: list[list[str]], group: str) -> np.ndarray:
        """Out-of-place distance per n-gram of each passage (a list of words) to each of the group's languages.

        All passages are ranked at once: n-grams are sorted by passage and id, counted, and sorted again by count.
        """
        known = self.words[group]
        if len(known) > 100_000:
            known.clear()
        parts = [b"".join(map(known.__getitem__, ws)) for ws in passages]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        if not sizes.sum():
            return np.full((len(passages), len(GROUPS[group])), PROFILE, np.float64)
        every = np.repeat(np.arange(len(parts)) << _GRAM, sizes) | np.frombuffer(b"".join(parts), np.intc)
        every.sort()
        new = np.empty(len(every), bool)
        new[0] = True
        np.not_equal(every[1:], every[:-1], out=new[1:])
        at = new.nonzero()[0]
        count = np.diff(at, append=len(every))
        every = every[at]
        owner, gram = every >> _GRAM, every & ((1 << _GRAM) - 1)
        most = (1 << _COUNT) - 1
        order = (((owner << _COUNT) | (most - np.minimum(count, most))) << _GRAM) | gram  # most frequent first, then by id
        order.sort()
        gram = order & ((1 << _GRAM) - 1)
        starts = np.searchsorted(owner, np.arange(len(parts)))
        n = np.diff(starts, append=len(owner))
        own = np.minimum(np.arange(len(owner)) - np.repeat(starts, n), 3 * PROFILE).astype(np.int16)  # as far from every rank as counts
        out = np.empty((len(parts), len(GROUPS[group])))
        some = n > 0
        first, size = starts[some], n[some]
        for j, ranks in enumerate(self.ranks[group]):
            d = ranks[gram]
            d -= own
            np.abs(d, out=d)
            np.minimum(d, PROFILE, out=d)  # a missing n-gram counts as the profile's length
            out[:, j] = PROFILE
            out[some, j] = np.add.reduceat(d, first, dtype=np.int64) / size
        return out

    def measure(self, wanted: Iterable[tuple[str, str]]) -> None:
        """Classify ``(group, passage)`` keys in blocks and keep the results."""
        by: dict[str, list[str]] = {}
        for g, p in dict.fromkeys(wanted):
            if (g, p) not in self.cache:
                by.setdefault(g, []).append(p)
        if len(self.cache) > 200_000:
            self.cache.clear()
        for g, ps in by.items():
            langs = GROUPS[g]
            for i in range(0, len(ps), _BLOCK):
                block = ps[i : i + _BLOCK]
                d = self.distances([_as_words(p, g) for p in block], g)
                best = d.argmin(1)
                near = d.min(1)
                rest = np.partition(d, 1, 1)[:, 1] if len(langs) > 1 else np.full(len(d), 2.0 * PROFILE)
                conf = np.clip((rest - near) / np.maximum(rest, 1e-6), 0, 1)
                self.cache.update(zip(((g, p) for p in block), zip((langs[j] for j in best), conf.tolist(), d.tolist())))

    def classify(self, passage: str, group: str) -> tuple[str, float, list[float]]:
        """Language, confidence, and the distances in the order of the script's languages."""
        hit = self.cache.get((group, passage))
        if hit is None:
            self.measure([(group, passage)])
            hit = self.cache[group, passage]
        return hit


def _as_words(passage: str, group: str) -> list[str]:
    if group in ("cjk", "thai"):
        letters = "".join(passage.split())
        return [letters[i : i + 12] for i in range(0, len(letters), 12)]
    return passage.split()


_WORD = re.compile(r"[^\W\d_][\w'’\u0900-\u0963\u0e31-\u0e4e\u064b-\u065f]*")
#: Sentence ends (followed by a capital or an unspaced script) and clause commas.
_UNIT = re.compile(r"(?P<s>[.!?…]+[\"”»’')\]]*\s*(?=[¿¡“«„\"'(\[-]*[A-ZÀ-ÖØ-ÞА-ЯЁ])|[.!?…]*[。！？।؟!?]+|(?<=[\u0e00-\u0e7f])\s+)|[,，、،;；]")
MARGIN = 0.12
CLAUSE_WORDS = 4


def runs(masked: str) -> Iterator[tuple[str, int, int, str, int]]:
    """``(script group, first, end, words joined by blanks, size)``: the sentences and longer clauses of each script.

    Fillers are left out; clauses of fewer than ``CLAUSE_WORDS`` words stay with the clause before or after them.
    """
    for m in _STRETCH.finditer(masked):
        group, text, off = m.lastgroup, m[0], m.start()
        spaced = group not in ("cjk", "thai")
        units: list[list] = []
        at = 0
        carry = ""  # a short piece that waits for the next
        carry_at = 0
        for u in [*_UNIT.finditer(text), None]:
            end = u.start() if u else len(text)
            words = [w for w in _WORD.findall(text[at:end].lower()) if w not in FILLERS]
            piece = " ".join(words)
            n = len(words) if spaced else len(piece) - len(words) + 1
            if carry:
                piece, at, carry = (carry + " " + piece).strip(), carry_at, ""
                n = len(piece.split()) if spaced else len(piece.replace(" ", ""))
            sentence = u is None or u["s"] is not None
            if piece and (n >= CLAUSE_WORDS or (sentence and n >= MIN_WORDS)):
                units.append([group, off + at, off + end, piece, n])
            elif piece and (units and not (u and not sentence)):
                units[-1][2], units[-1][3], units[-1][4] = off + end, units[-1][3] + " " + piece, units[-1][4] + n
            elif piece:
                carry, carry_at = piece, at
            at = u.end() if u else end
        if carry:
            if units:
                units[-1][2], units[-1][3], units[-1][4] = off + len(text), units[-1][3] + " " + carry, units[-1][4] + len(carry.split())
            else:
                units.append([group, off + carry_at, off + len(text), carry, len(carry.split()) if spaced else len(carry.replace(" ", ""))])
        yield from map(tuple, units)


_SENTENCE = re.compile(r"[.!?…]+[\"”»’')\]]*\s*(?=[¿¡“«„\"'(]?[A-ZÀ-ÖØ-ÞА-ЯЁ\u0600-\u1fff\u3040-\ud7a3])|[。！？।؟]+|(?<=[\u0e00-\u0e7f]) +")
_SENTENCE_ASCII = re.compile(r"[.!?]+[\"')\]]*\s*(?=[\"'(]?[A-Z])")
_CLAUSE_MARKS = frozenset(",;.!?0123456789_-")
_WORD_ASCII = re.compile(r"[a-z][a-z']*")


def _ascii_unit(piece: str) -> list[tuple]:
    """The unit of a plain sentence without clause marks: what ``runs`` makes of it, without the work."""
    words = [w for w in _WORD_ASCII.findall(piece) if w not in FILLERS]
    return [("latin", 0, len(piece), " ".join(words), len(words))] if words else []


def _units(piece: str, model: Profiles) -> list[tuple]:
    """Units of one sentence, with offsets from its first character; recognisers repeat themselves, so they are kept."""
    piece = piece.lower().rstrip(" .!?…\n")
    hit = model.sentences.get(piece)
    if hit is None:
        if len(model.sentences) > 250_000:
            model.sentences.clear()
        hit = model.sentences[piece] = _ascii_unit(piece) if piece.isascii() and _CLAUSE_MARKS.isdisjoint(piece) else [*runs(piece)]
    return hit


def _join_short(found: list[tuple], model: Profiles) -> list[tuple]:
    """Neighbouring short units of one script are classified as one; one still short goes with a neighbour of its script."""
    out: list[tuple] = []
    for x in found:
        y = out[-1] if out else None
        if y and x[9] and y[9] and x[1] == y[1]:
            words = y[9] + " " + x[9]
            out[-1] = (0, y[1], y[0] + y[2], x[0] + x[3], y[4] + x[4], *y[5:8], len(words), words)
        else:
            out.append(x)
    out = [(*x[:5], *model.classify(x[9], x[1]), *x[8:]) if x[9] else x for x in out]
    for i, x in enumerate(out):
        if x[4] < MIN_WORDS:
            near = next((out[j] for j in (i - 1, i + 1) if 0 <= j < len(out) and out[j][1] == x[1]), x)
            out[i] = (*x[:5], near[5], 0.0 if near is not x else x[6], *x[7:])
    return out


def units(text: str, model: Profiles, masked: str | None = None) -> list[tuple]:
    """``(offset, group, first, end, words, size)`` of the sentences and clauses of a cue, not yet classified."""
    if masked is None:
        masked = text if plain(text) else read_lines(text)[0]
    if "@" in masked or "＠" in masked or "(" in masked or "[" in masked or "arroba" in masked or "/" in masked:
        masked = _MAIL.sub(lambda m: " " * len(m[0]), masked)
    found: list[tuple] = []
    at = 0
    for m in (_SENTENCE_ASCII if masked.isascii() else _SENTENCE).finditer(masked):
        if m.start() > at:
            found += [(at, *u) for u in _units(masked[at : m.start()], model)]
            at = m.end()
    return found + [(at, *u) for u in _units(masked[at:], model)]


def passages(text: str, model: Profiles, masked: str | None = None, found: list[tuple] | None = None) -> list[tuple[str, float, int, int, int]]:
    """``(language, confidence, first, end, size)`` of each passage; size is in words, in letters where unspaced.

    Sentences and clauses are classified one by one; one that disagrees with the longest of its script does so only by a
    clear margin, and neighbours of one language are one passage.  Passages too short to tell are left out after that.
    ``found``: the text's ``units``, where they are at hand.
    """
    found = units(text, model, masked) if found is None else found
    found = [(off, g, a, b, n, *model.classify(w, g), len(w), w if n < MIN_WORDS else "") for off, g, a, b, w, n in found]
    if len(found) > 1 and min(x[4] for x in found) < MIN_WORDS:
        found = _join_short(found, model)
    if not found:
        return []
    out: list[list] = []
    one = found[0][5]
    if all(x[5] == one for x in found):
        return [(one, max(x[6] for x in found), found[0][0] + found[0][2], found[-1][0] + found[-1][3], sum(x[4] for x in found))]
    mixed = {g for g in ("latin", "cjk") if len({x[5] for x in found if x[1] == g}) > 1}
    main = {g: max((x for x in found if x[1] == g), key=lambda x: (x[8] * (x[6] + 0.05)))[5] for g in mixed}
    at = {g: GROUPS[g].index(k) for g, k in main.items()}
    for off, group, a, b, n, lang, conf, d, *_ in found:
        if group in mixed and lang != main[group] and d[at[group]] - min(d) < (MARGIN if n > CLAUSE_WORDS else 2 * MARGIN) * d[at[group]]:
            lang, conf = main[group], 0.0
        out.append([lang, conf, off + a, off + b, n])
    joined = _neighbours(out)
    if min(x[4] for x in joined) < MIN_WORDS:  # a borrowed term is no passage where anything else is said
        joined = _neighbours([x for x in joined if x[4] >= MIN_WORDS] or joined[:1])
    return [tuple(x) for x in joined]


def _neighbours(units: list[list]) -> list[list]:
    out: list[list] = []
    for x in units:
        if out and out[-1][0] == x[0]:
            out[-1] = [x[0], max(out[-1][1], x[1]), out[-1][2], x[3], out[-1][4] + x[4]]
        else:
            out.append(x)
    return out


def train(labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles of ``(language, text)`` pairs; pairs whose script cannot be the language's are left out."""

    def build(pieces: Iterable[tuple[str, str, str]]) -> Profiles:
        counts: dict[str, Counter] = defaultdict(Counter)
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, group, passage in pieces:
            if _GROUP_OF[lang] != group:
                continue
            if group in ("cjk", "thai"):
                letters = "".join(passage.split())
                words[lang].update(letters[i : i + 12] for i in range(0, len(letters), 12))
            else:
                words[lang].update(passage.split())
        for lang, ws in words.items():
            for w, n in ws.items():
                for t in ngrams(w):
                    counts[lang][t] += n
        return Profiles({k: [t for t, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for k, v in counts.items()})

    pieces = [(lang, g, w) for lang, text in labelled for g, _, _, w, _ in runs(_MAIL.sub(" ", read_lines(text)[0]))]
    first = build(pieces)
    first.measure((g, w) for _, g, w in pieces if len(w) >= 12)
    again = []
    for lang, g, w in pieces:
        if len(w) >= 12:
            again.append((first.classify(w, g)[0], g, w))
    return build(again)


def fit_profiles(cues: DataFrame, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from at most about ``per_language`` labelled cues a language, chosen by a hash of the cue.

    Languages without a labelled cue get an empty profile, at full distance from everything.
    """
    head = F.substring_index(F.translate(F.lower(F.trim("lang")), "_ (", "---"), "-", 1)
    usable = "lang IS NOT NULL AND text IS NOT NULL AND length(text) > 12"

    def spelled_out(some: DataFrame) -> DataFrame:
        return some.withColumn("_l", head).where(F.col("_l").isin(*NAMES))

    share: dict[str, int] = {}
    labels = cues.where(usable).groupBy("lang").agg(F.count("*").alias("n"))
    for r in spelled_out(labels).groupBy("_l").agg(F.sum("n").alias("n")).collect():  # known spellings only: at most one row each
        share[NAMES[r["_l"]]] = share.get(NAMES[r["_l"]], 0) + r["n"]
    if not share:
        return Profiles({})
    spelled = {c: k for k in share for c in NAMES if NAMES[c] == k}
    frac = F.create_map(*[x for c, k in spelled.items() for x in (F.lit(c), F.lit(min(1.0, per_language / share[k])))])
    by = F.pmod(F.xxhash64("cue_id", F.lit(17)), F.lit(1_000_003))
    some = cues.where(by < min(1.0, per_language / min(share.values())) * 1_000_003)  # none of the others is picked for any language
    picked = spelled_out(some.where(usable)).withColumn("_f", F.coalesce(frac[F.col("_l")], F.lit(0.0))).where(by < F.col("_f") * 1_000_003)
    rows = picked.select("_l", "text").collect()
    return train(sorted((NAMES[r["_l"]], r.text) for r in rows))


_OUT = pa.schema([("cue_id", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("begin_at", pa.int32()), ("end_at", pa.int32()), ("size", pa.int32()), ("named", pa.bool_())])
OUT_DDL = "cue_id bigint, lang string, confidence double, begin_at int, end_at int, size int, named boolean"


def _tagger(model: Profiles, unnamed_only: bool = False):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict = {}
        for b in batches:
            rows: list[tuple] = []
            texts = b.column("text").to_pylist()
            found = [units(t, model) for t in texts]
            model.measure((u[1], u[4]) for us in found for u in us)
            for cue, text, label, us in zip(b.column("cue_id").to_pylist(), texts, b.column("lang").to_pylist(), found):
                if label not in labels:
                    labels[label] = named_language(label)
                own = labels[label]
                rows.extend((cue, lang, conf, a, z, n, lang == own) for lang, conf, a, z, n in passages(text, model, found=us) if not (unnamed_only and lang == own))
            cols = list(zip(*rows)) or [[]] * len(_OUT)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return tag


def languages(cues: DataFrame, model: Profiles | None = None, unnamed_only: bool = False) -> DataFrame:
    """One row per passage with its language, confidence, offsets and whether ``cues.lang`` names the language.

    Null, blank and wordless texts have no rows; redelivered cues count once.
    """
    model = model or fit_profiles(cues)
    every = cues.where("text IS NOT NULL AND cue_id IS NOT NULL").select("cue_id", "text", "lang").mapInArrow(_tagger(model, unnamed_only), OUT_DDL)
    return every if unnamed_only else every.distinct()


def p1_found(cues: DataFrame, model: Profiles | None = None) -> DataFrame:
    """Languages of passages long enough that the cue's label does not name."""
    unspaced = F.col("lang").isin(*sorted(UNSPACED))
    enough = F.when(unspaced, F.col("size") >= MIN_LETTERS).otherwise(F.col("size") >= MIN_WORDS)
    return languages(cues, model, unnamed_only=True).where(~F.col("named") & enough).select("cue_id", "lang").distinct()
