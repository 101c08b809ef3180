"""Problem 7: broken prompt and response pairs (answers of translation tasks).

Every answer is paired with its cue's text.  *Refusals* are found by recurrence: the different openings of answers are
clustered by MinHash (band collisions, verified by Jaccard similarity, connected components), and a cluster whose prompts
have little in common is a refusal template: answers that begin alike without their prompts being alike translate nothing.
*Copy*, *language* (the rank-order profiles of ``lang``, in every script) and *termination* (sentence counts and marks of
``sentences``) checks label the rest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.lines import plain, read_lines
from cuegrid.llm.fillers import WORDS as FILLERS
from cuegrid.llm.lang import _GROUP_OF, _SCRIPTS as _SCRIPT_CLASSES, GROUPS, MARGIN, Profiles, fit_profiles, named_language, passages, units
from cuegrid.llm.sentences import BoundaryModel, cuts
from cuegrid.llm.sentences import fit as fit_boundaries
from cuegrid.session import staged

#: An opening is this many words (letters in scripts without spaces: in Han and kana, in Thai).
OPENING_WORDS, OPENING_LETTERS, OPENING_THAI = 10, 18, 40
SIMILAR = 0.8
#: Of the way from the overlap of any two prompts of a language to that of equal ones, k unrelated prompts go less than
#: ``RELATED * (1 - 2 / k)``: of two, none may have more in common than usual, as among many clusters some do by chance.
RELATED = 0.18
#: Beyond this prompts are clearly alike.
CLEARLY = 0.25
#: Prompts of fewer content words tell nothing.
LEAST_WORDS = 3
BANDS, ROWS = 8, 4

#: Contents of ``uncertain`` that give no reason.
NO_REASON = ("", "no", "none", "-", "n/a", "na", "null", "nil", "false", "0", "ok", "无", "否", "没有", "--", ".")
#: What may introduce a copied text.
_LEAD_IN = re.compile(r"^\s*(?:[^\W\d_]+[ ]?){1,5}[:：]\s*")

_NOT_WORD = re.compile(r"[^\w]+|_+")
_TERMINAL = re.compile(r"[.!?。！？।؟｡][\"”»’」』“)\]\s]*$")
_DOTS = re.compile(r"(?:\.\.\.|…)[\"”»’」』“)\]\s]*$|[\s][–—-]\s*$")
#: Letters that are common come first in a class, where a bitmap finds them.
_WORDS = re.compile(r"[^\W\d_][a-z0-9ß-öø-ÿа-яё一-鿿\w'’ऀ-ॿ฀-๿ً-ٟ]*")
#: The same for small ASCII letters.
_WORDS_ASCII = re.compile(r"[a-z][a-z0-9_']*")
_BY_SCRIPT = {g: re.compile(f"[{c}]") for g, c in _SCRIPT_CLASSES.items()}
_THAI = re.compile("[\u0e00-\u0e7f]")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")

_SEEDS = np.random.RandomState(11).randint(1, 2**31 - 1, size=(2, BANDS * ROWS)).astype(np.uint64)
_PRIME = np.uint64((1 << 31) - 1)


def squash(text: str) -> str:
    """Letters and digits only, lower case: what copies are compared by."""
    return _NOT_WORD.sub("", text.lower())


def _last_word_character(low: str) -> str:
    """The last letter or digit that ``squash`` leaves of a text in lower case, or nothing where that takes a closer look."""
    last = low.rstrip(" .!?…。！？\n")[-1:]
    return last if last.isalnum() else ""


def _read(text: str) -> tuple[str, list[tuple[str | None, int, int]]]:
    """The text masked, and its lines."""
    return (text, [(None, 0, len(text))]) if plain(text) else read_lines(text)[:2]


def opening(masked: str, words: list[str] | None = None) -> str:
    words = _WORDS.findall(masked.lower()) if words is None else words
    joined = " ".join(words[:40])
    if not joined.isascii() and _DENSE.search(joined):
        return "".join(words[:40])[: OPENING_THAI if _THAI.search(joined) else OPENING_LETTERS]
    return " ".join(words[:OPENING_WORDS])


def tokens_of(opening_: str) -> set[str]:
    return {opening_[i : i + 2] for i in range(max(1, len(opening_) - 1))} if _DENSE.search(opening_) else set(opening_.split())


_hashed: dict[str, np.ndarray] = {}


def _token_hashes(t: str) -> np.ndarray:
    h = _hashed.get(t)
    if h is None:
        if len(_hashed) > 200_000:
            _hashed.clear()
        h = _hashed[t] = (np.uint64(zlib.crc32(t.encode()) % int(_PRIME)) * _SEEDS[0] + _SEEDS[1]) % _PRIME
    return h


def bands(opening_: str) -> list[int]:
    """One number per MinHash band of the opening's tokens."""
    sig = np.minimum.reduce([_token_hashes(t) for t in tokens_of(opening_)]).tobytes()
    return [zlib.crc32(sig[i * 8 * ROWS : (i + 1) * 8 * ROWS]) * 8 + i for i in range(BANDS)]


@lru_cache(200_000)
def _word_hash(w: str) -> int:
    return zlib.crc32(w.encode()) - (1 << 31)


@lru_cache(200_000)
def _script_of_letter(ch: str) -> str:
    return next((g for g, p in _BY_SCRIPT.items() if p.match(ch)), "latin")


def script_of(words: list[str]) -> str:
    """The script in which most of the words' letters are written; empty where there are none."""
    joined = "".join(words)
    if joined.isascii():
        return "latin" if joined else ""
    sizes: dict[str, int] = {}
    for w in words:
        g = _script_of_letter(w[0])
        sizes[g] = sizes.get(g, 0) + len(w)
    return max(sizes, key=sizes.get)


def said(text: str) -> list[str]:
    """The words of a text without fillers."""
    low = text.lower()
    return [w for w in (_WORDS_ASCII if low.isascii() else _WORDS).findall(low) if w not in FILLERS]


def content_words(words: list[str], group: str) -> list[int]:
    """Hashes of different words of some length (letter pairs where words are not spaced)."""
    if group in ("cjk", "thai"):
        return [_word_hash(w) for w in {w[i : i + 2] for w in words for i in range(len(w) - 1)}]
    return [_word_hash(w) for w in {w for w in words if len(w) > 2}]


def _copied(own: str, src: str) -> bool:
    """Whether a masked answer repeats its masked cue, perhaps behind a few words that introduce it."""
    a, c = _last_word_character(own.lower()), _last_word_character(src.lower())
    if a and c and a != c:
        return False
    a, c = squash(own), squash(src)
    if not c:
        return False
    return a == c or len(a) > len(c) and a.endswith(c) and (squash(_LEAD_IN.sub("", own)) == c or len(own[: len(own) - len(src.strip())].split()) <= 5)


def _reason(uncertain: str | None) -> bool:
    return uncertain is not None and uncertain.strip().lower() not in NO_REASON


class Pair:
    """A cue and its answer as they are read: masked, in lines, in words, with the script of either's words."""

    __slots__ = ("answer_lines", "copied", "cue_lines", "group", "its", "lang", "mine", "own", "reason", "script", "src", "units")

    def __init__(self, cue: str | None, answer: str | None, target: str | None, uncertain: str | None):
        self.own, self.answer_lines = _read(answer) if answer else ("", [])
        self.src, self.cue_lines = _read(cue) if cue else ("", [])
        self.lang = named_language(target)
        self.mine, self.its = said(self.own), said(self.src)
        self.script, self.group = script_of(self.mine), script_of(self.its)
        self.copied = _copied(self.own, self.src)
        self.reason = self.copied and _reason(uncertain)
        self.units: list[tuple] | None = None

    def to_measure(self, profiles: Profiles) -> list[tuple[str, str]]:
        """What ``check`` asks the profiles: the language of a copied cue, or of an answer in a script of more languages than one."""
        if self.copied:
            if self.reason or not self.lang:
                return []
            self.units = units(self.src, profiles, self.src)
            return [(u[1], u[4]) for u in self.units]
        asked = self.lang and self.script and self.script == _GROUP_OF[self.lang] and len(GROUPS[self.script]) > 1
        return [(self.script, " ".join(self.mine))] if asked else []


def check(cue: str | None, answer: str | None, target: str | None, uncertain: str | None, profiles: Profiles, boundaries: BoundaryModel, pair: Pair | None = None) -> str | None:
    """Defect of one pair by the copy, language and termination checks, or None (refusals are found elsewhere)."""
    pair = pair or Pair(cue, answer, target, uncertain)
    own, src, lang = pair.own, pair.src, pair.lang
    if not (pair.mine or any(ch.isalnum() for ch in own)):
        return "empty"
    if pair.copied:
        if pair.reason or (lang and {x[0] for x in passages(src, profiles, src, pair.units)} <= {lang}):
            return None
        return "copy"
    if lang and _wrong_language(pair.mine, lang, profiles, pair.script):
        return "wrong_language"
    text, source = own.strip(), src.strip()
    if not source:
        return None
    dots_in_source = bool(_DOTS.search(source))
    if _DOTS.search(text) and not dots_in_source:
        return "truncated"
    thai = _THAI.search(source) is not None
    if not _TERMINAL.search(text) and not _DOTS.search(text) and (thai or _TERMINAL.search(source) or dots_in_source):
        return "truncated"
    # One sentence cannot be cut short of another; only cues with a mark (in Thai, a blank) before their end are counted.
    inner = source.rstrip(" .!?…。！？।؟”»\"'」")
    if (thai and " " in inner) or _MARK.search(inner):
        n = len(cuts(cue, boundaries, (src, pair.cue_lines)))
        if n > 1 and len(cuts(answer, boundaries, (own, pair.answer_lines))) < n:
            return "truncated"
    return None


_MARK = re.compile(r"[.!?…。！？।؟]|\n *[\[<>\w-]")


def _wrong_language(words: list[str], lang: str, profiles: Profiles, group: str) -> bool:
    """Whether the answer as a whole is nearest to another language's profile, by a clear margin where they share a script.

    A script that one language writes needs no distances: its language is the nearest, whatever the words.
    """
    if not group:
        return False
    if group != _GROUP_OF[lang]:
        return True
    if len(GROUPS[group]) == 1:
        return False
    joined = " ".join(words)
    best, _, d = profiles.classify(joined, group)
    if best == lang:
        return False
    at = GROUPS[group].index
    return d[at(lang)] - d[at(best)] > MARGIN * d[at(lang)] and len(joined) > 8


#: Pairs read, or openings hashed, at once.
_BLOCK = 4096

_OUT = pa.schema([("task_key", pa.string()), ("id", pa.int64()), ("defect", pa.string()), ("opening", pa.string()), ("plang", pa.string()), ("words", pa.list_(pa.int32())), ("oh", pa.int64())])
_DDL = "task_key string, id bigint, defect string, opening string, plang string, words array<int>, oh bigint"


def _checker(profiles: Profiles, boundaries: BoundaryModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, _BLOCK) for b in batches for i in range(0, b.num_rows, _BLOCK)):
            rows = [*zip(*(b.column(n).to_pylist() for n in ("cue", "answer", "target_lang", "uncertain")))]
            found = [Pair(*row) for row in rows]
            profiles.measure(x for p in found for x in p.to_measure(profiles))
            defects = [check(*row, profiles, boundaries, p) for row, p in zip(rows, found)]
            openings = [(opening(p.own, p.mine) or None) if d not in ("empty", "copy") and p.mine else None for d, p in zip(defects, found)]
            asked = [(p, " ".join(p.its)) if op and p.group else None for op, p in zip(openings, found)]
            profiles.measure((x[0].group, x[1]) for x in asked if x and len(GROUPS[x[0].group]) > 1)
            langs = [(GROUPS[x[0].group][0] if len(GROUPS[x[0].group]) == 1 else profiles.classify(x[1], x[0].group)[0]) if x else None for x in asked]
            words = [content_words(x[0].its, x[0].group) if x else None for x in asked]
            hashes = [xxhash.xxh64_intdigest(op) - (1 << 63) if op else None for op in openings]
            out = [b.column("task_key"), b.column("id"), defects, openings, langs, words, hashes]
            yield pa.record_batch([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(out, _OUT)], schema=_OUT)

    return run


def pairs(translations: DataFrame, cues: DataFrame) -> DataFrame:
    """Distinct answers with their cue's text (null where there is none)."""
    t = translations.where("task_key IS NOT NULL AND id IS NOT NULL").select("task_key", "id", "target_lang", F.col("text").alias("answer"), "uncertain", "answered_at")
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.drop("answered_at").repartition(n, "id").dropDuplicates(["task_key", "id"])  # one exchange serves the distinct and the join
    c = cues.where("cue_id IS NOT NULL AND text IS NOT NULL").select(F.col("cue_id").alias("_id"), F.col("text").alias("cue")).repartition(n, "_id").dropDuplicates(["_id"])
    return t.join(c.hint("merge"), t.id == c._id, "left").drop("_id")


def checked(translations: DataFrame, cues: DataFrame) -> DataFrame:
    profiles, boundaries = fit_profiles(cues), fit_boundaries(cues)
    return staged(pairs(translations, cues).mapInArrow(_checker(profiles, boundaries), _DDL), "pairs")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signatures(parts: list[list[str]]) -> np.ndarray:
    """MinHash signatures of many token lists, one row each; every different token is hashed once."""
    ids: dict[str, int] = {}
    at = [ids.setdefault(t, len(ids)) for p in parts for t in p]
    own = (np.array([zlib.crc32(t.encode()) % int(_PRIME) for t in ids], np.uint64)[:, None] * _SEEDS[0] + _SEEDS[1]) % _PRIME
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return np.minimum.reduceat(own[at], starts, axis=0)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _BLOCK // 8):
            block = b.slice(i, _BLOCK // 8)
            # Long tokens, which are rare, first.
            parts = [sorted(sorted(tokens_of(op)), key=len, reverse=True) for op in block.column("opening").to_pylist()]
            rows = _signatures(parts)
            band = [zlib.crc32(row[k * 8 * ROWS : (k + 1) * 8 * ROWS]) * 8 + k for k in range(BANDS) for row in map(np.ndarray.tobytes, rows)]
            flat, ends = np.fromiter((_word_hash(t) for p in parts for t in p), np.int32), np.cumsum([0, *map(len, parts)])
            every = np.concatenate([[0], *(ends[1:] + k * len(flat) for k in range(BANDS))])
            toks = pa.ListArray.from_arrays(pa.array(every, pa.int32()), pa.array(np.tile(flat, BANDS)))
            yield pa.record_batch([pa.array(band, pa.int64()), pa.array(np.tile(block.column("oh").to_numpy(), BANDS)), toks], names=["band", "oh", "toks"])


@lru_cache(10_000)
def _least_common(n: int, m: int) -> int:
    """How many tokens sets of ``n`` and ``m`` must share to be as near as ``SIMILAR``; more than they have where none suffice."""
    return next((both for both in range(min(n, m) + 1) if both >= SIMILAR * (n + m - both)), min(n, m) + 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band; each opening of a band joins the first of the band's leaders it is near to, or leads.

    Two sets of tokens as near as ``SIMILAR`` have one of the first tokens of either in common, so leaders are found by those.
    """
    band, leaders = None, {}
    for b in batches:
        out: list[tuple[int, int]] = []
        of = b.column("band").to_numpy()
        again = of[1:] == of[:-1]
        # An opening alone in its band has nothing to join; what stands at the border of a batch may go on in the next.
        alone = np.concatenate([[False], ~(again[:-1] | again[1:]), [False]]) if len(of) > 1 else np.zeros(len(of), bool)
        at = (~alone).nonzero()[0]
        toks = b.column("toks")
        flat, ends = toks.flatten().to_numpy().tolist(), toks.offsets.to_numpy() - toks.offsets[0].as_py()
        for k, h, first, end in zip(of[at].tolist(), b.column("oh").to_numpy()[at].tolist(), ends[at].tolist(), ends[at + 1].tolist()):
            if k != band:
                band, leaders = k, {}
            n = end - first
            own, head = set(flat[first:end]), flat[first : end - math.ceil(SIMILAR * n - 1e-9) + 1]
            seen: set[int] = set()
            lead = None
            for i, t in enumerate(head):
                for x, ts, size, behind in leaders.get(t, ()):
                    if x not in seen:  # the first token they share: all others stand behind it in both
                        seen.add(x)
                        least = _least_common(n, size)
                        if n - i >= least <= behind and len(own & ts) >= least:
                            lead = x
                            break
                if lead is not None:
                    break
            if lead is None:
                for i, t in enumerate(head):
                    leaders.setdefault(t, []).append((h, own, len(own), n - i))
            else:
                out.append((h, lead))
        cols = list(zip(*out)) or [[]] * 2
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], schema=_EDGES)


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: connected components of the links ``a, b``.

    Every round roots hook onto the least root they are linked to and all labels jump to their label's label, so the rounds
    grow with the logarithm of the longest chain; each round is a table in the shared folder.
    """
    links = staged(edges.where("a <> b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    alone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("comp"))
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = links.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        hooks = near.where("ca <> cb").groupBy(F.greatest("ca", "cb").alias("root")).agg(F.min(F.least("ca", "cb")).alias("onto"))
        hooks = staged(hooks, "hooks")
        if hooks.limit(1).count() == 0:
            return labels.union(alone).groupBy("id").agg(F.min("comp").alias("comp"))
        hooked = labels.join(hooks, labels.comp == hooks.root, "left").select("id", F.least("comp", F.coalesce("onto", "comp")).alias("comp"))
        hooked = staged(hooked, "labels")
        jump = hooked.select(F.col("id").alias("_id"), F.col("comp").alias("_comp"))
        labels = staged(hooked.join(jump, hooked.comp == jump._id, "left").select("id", F.least("comp", F.coalesce("_comp", "comp")).alias("comp")), "labels")


def opening_links(features: DataFrame) -> DataFrame:
    """``a, b``: verified links of different openings to the leaders of their bands."""
    different = features.where("oh IS NOT NULL").groupBy("oh").agg(F.first("opening").alias("opening"))
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = different.mapInArrow(_banded, "band bigint, oh bigint, toks array<int>").repartition(n, "band").sortWithinPartitions("band", "oh")
    return staged(banded.mapInArrow(_verified, "a bigint, b bigint").distinct(), "edges")


def _overlap(prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: prompts ``k``, their ``words``, and ``shared``, the words that stand in another prompt too, averaged over all pairs."""
    per = prompts.withColumn("w", F.explode("words")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    words = per.groupBy(*keys).agg(F.sum("c").alias("words"), F.sum(F.expr("c * (c - 1.0D)")).alias("pairs"))
    n = prompts.groupBy(*keys).agg(F.count("*").alias("k"))
    return words.join(n, keys).withColumn("shared", F.expr("pairs / greatest(k - 1, 1)"))


def _relation(prompts: DataFrame, usual: DataFrame) -> DataFrame:
    """``comp, k, rel``: how far the overlap of a cluster's prompts goes from the usual one of their languages (0) to equality (1).

    A cluster's prompts of one language meet in one task, so that the words of lone prompts, which nothing comes of, are
    never counted and those of the others are not shuffled one by one.
    """
    many = prompts.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("comp", "plang"))).where("k > 1")
    per = many.withColumn("w", F.explode("words")).groupBy("comp", "plang", "k", "w").agg(F.count("*").alias("c"))
    own = per.groupBy("comp", "plang", "k").agg(F.sum("c").alias("words"), F.sum(F.expr("c * (c - 1.0D)")).alias("pairs")).withColumn("shared", F.expr("pairs / (k - 1)"))
    per = own.join(F.broadcast(usual), "plang").groupBy("comp").agg(F.sum("shared").alias("s"), F.sum("words").alias("w"), F.sum("k").alias("k"), F.sum(F.expr("usual * words")).alias("u"))  # usual: one row per language
    return per.select("comp", "k", F.expr("(s - u) / greatest(w - u, 1e-9)").alias("rel"))


def refusal_openings(features: DataFrame) -> DataFrame:
    """``oh`` of the openings in clusters whose prompts are no more alike than any.

    Of a cluster's prompts of one language, so many words stand in another of them too, on average of all pairs; the same
    figure over all prompts of the language is what any two have in common.  Both come from counts of words, so no pairs
    are formed, and a cluster of two prompts is judged by the same rule as one of a million.  First every opening is judged
    with the openings that have the same leader; those whose prompts are clearly alike are translations and link nothing.
    What is left is linked to components, which are judged again.
    """
    prompts = staged(features.where(f"oh IS NOT NULL AND plang IS NOT NULL AND size(words) >= {LEAST_WORDS}").select("oh", "plang", "words"), "prompts")
    usual = staged(_overlap(prompts, ["plang"]).select("plang", F.expr("shared / words").alias("usual")), "usual")
    links = opening_links(features)
    stars = staged(links.groupBy(F.col("a").alias("oh")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "stars")
    first = _relation(prompts.join(stars, "oh", "left").select(F.coalesce("comp", "oh").alias("comp"), "plang", "words"), usual)
    alike = staged(first.where(f"rel > {CLEARLY}").select("comp"), "alike")
    translated = stars.join(alike, "comp").select("oh").union(alike.select(F.col("comp").alias("oh"))).distinct()
    open_links = links.join(translated.withColumnRenamed("oh", "a"), "a", "left_anti").join(translated.withColumnRenamed("oh", "b"), "b", "left_anti")
    clusters = staged(components(open_links.select("a", "b")), "clusters")
    rest = prompts.join(translated, "oh", "left_anti").join(clusters.withColumnRenamed("id", "oh"), "oh", "left").select(F.coalesce("comp", "oh").alias("comp"), "plang", "words")
    refused = _relation(rest, usual).where(f"rel < {RELATED} * (1 - 2 / k)").select("comp")
    near = clusters.join(refused, "comp", "left_semi").select(F.col("id").alias("oh"))
    return near.union(refused.select(F.col("comp").alias("oh"))).distinct()  # an opening near no other is its own cluster


def p7_found(translations: DataFrame, cues: DataFrame, salts: int = 8) -> DataFrame:
    """``task_key, id, defect``: a refusal goes before what its language or end would make of it."""
    f = checked(translations, cues)
    r = refusal_openings(f).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("oh", "_oh")
    opened = f.where("oh IS NOT NULL").select("task_key", "id", "defect", "oh", F.pmod(F.xxhash64("task_key", "id"), F.lit(salts)).cast("int").alias("_s"))
    g = opened.join(r, (opened.oh == r._oh) & (opened._s == r._salt), "left").select("task_key", "id", F.expr("CASE WHEN _oh IS NOT NULL THEN 'refusal' ELSE defect END").alias("defect"))
    return g.union(f.where("oh IS NULL").select("task_key", "id", "defect")).where("defect IS NOT NULL")
