"""Problem 9: evaluation texts leaking into training text, by greedy string tiling.

Items and documents are token sequences of folded text (words; single letters where words are not spaced).  Documents are
joined to items on shared *seed* tokens that few items have.  For each joined pair, running Karp-Rabin marks the longest
non-overlapping matches, tile after tile; neighbouring tiles are chained over differing tokens, and a pair is a leak if a
chain covers enough of the item with few enough differences.  ``coverage`` reports, besides, which share of an item the
tiles of a document cover in any order, so that passages cut up and put in another order are seen too.

The held-out items travel with the tasks in blocks of at most ``BLOCK_ITEMS`` (any number of blocks, usually one); documents
are read once for each block, whole, and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_LETTERS = 15, 30
#: At most one token in so many differs.
ONE_IN = 8
#: Wording of this many tokens that two items have is shared and does not count.
SHARED_WORDS, SHARED_LETTERS = 8, 16
#: Letters of a seed in scripts without spaces; tiles are at least this long (words, letters).
SEED_LETTERS = 6
MIN_TILE_WORDS, MIN_TILE_LETTERS = 2, 3
BLOCK_ITEMS = 20_000
#: Tiles of so many words (letters) count for the coverage of an item in any order.
PIECE_WORDS, PIECE_LETTERS = 5, 10

#: Letters of other scripts that look like Latin ones.
_LOOK = str.maketrans("аеорсухіјѕԁкмтвнАВЕКМНОРСТХУІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονιρυκ‐‑‒–", "aeopcyxijsdkmtbhABEKMHOPCTXYIJSABEZHIKMNOPTYXaovipuk----")
_CUE = re.compile(r"^[ \t]*\d+[ \t]*\r?\n(?=[^\n]*--?>)", re.M)
_STAMP = re.compile(r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?(?:[ \t]*--?>[ \t]*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?[^\n]*)?|\d{1,2}h\d\dm\d\ds")
_LABEL = re.compile(r"^[ \t>*#-]*(?:<v [^>\n]{1,30}>|\[[^\]\n]{1,20}\][ \t]*:?|(?:spk|speaker|说话人)[ _]?\d+[ \t]*(?::|-(?=\s))|[^\W\d_][\w'.]{0,15}[ \t]*:(?=\s|[^\x00-\x7f]))", re.M | re.I)
_HAN = re.compile(r"[㐀-鿿]")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿̀-ͯ]")


def fold(text: str) -> str:
    """Folded text without labels, cue numbers and time codes."""
    if not text.isascii():
        s = unicodedata.normalize("NFKC", text)
        s = _INVISIBLE.sub(lambda m: m[0] if "̀" <= m[0] <= "ͯ" else "", s).translate(_LOOK)
    else:
        s = text
    if "\r" in s:
        s = s.replace("\r\n", "\n").replace("\r", "\n")
    if ">" in s:
        s = _CUE.sub("", s)
    if ":" in s or "h" in s:
        s = _STAMP.sub(" ", s)
        s = _LABEL.sub(" ", s)
    return s.casefold()


def tokens(folded: str) -> list[str]:
    return _TOKEN.findall(folded)


def dense_runs(toks: list[str]) -> str:
    """Han letters and digits in order, for letter seeds."""
    return "".join(t for t in toks if _HAN.match(t) or t.isdigit())


class Item:
    __slots__ = ("dense", "id", "parts")

    def __init__(self, id_: int, dense: bool, parts: list[list[str]]):
        self.id, self.dense, self.parts = id_, dense, parts


def _as_letters(toks: list[str]) -> list[str]:
    """Letters one by one (numbers fall apart into digits)."""
    return [ch for t in toks for ch in t]


def _shingles(toks: list[str], dense: bool) -> Iterator[tuple[int, tuple]]:
    k = SHARED_LETTERS if dense else SHARED_WORDS
    return ((i, tuple(toks[i : i + k])) for i in range(len(toks) - k + 1))


def _item_tokens(text: str | None) -> tuple[bool, list[str]]:
    toks = tokens(fold(text or ""))
    dense = sum(bool(_HAN.match(t)) for t in toks) * 2 > len(toks)
    return dense, _as_letters(toks) if dense else toks


class Held:
    """A block of held-out items, without the wording items share, and their seeds.

    ``shared``: hashes of wording that different items of all blocks have; None counts within this block.
    """

    def __init__(self, rows: list[tuple[int, str]], shared: frozenset[int] | None = None):
        raw = [(id_, *_item_tokens(text)) for id_, text in rows]
        texts = {tuple(toks): dense for _, dense, toks in raw}  # equal items share everything and are none the less items
        if shared is None:
            owners = Counter(h for toks, dense in texts.items() for h in {hash(g) for _, g in _shingles(list(toks), dense)})
            common = {h for h, n in owners.items() if n > 1}.__contains__
            key = hash
        else:
            common, key = shared.__contains__, shingle_hash
        self.items: list[Item] = []
        for id_, dense, toks in raw:
            k = SHARED_LETTERS if dense else SHARED_WORDS
            dull = [False] * len(toks)
            for i, g in _shingles(toks, dense):
                if common(key(g)):
                    dull[i : i + k] = [True] * k
            parts, cur = [], []
            for t, s in zip(toks, dull):
                if s:
                    parts.append(cur)
                    cur = []
                else:
                    cur.append(t)
            least = MIN_LETTERS if dense else MIN_WORDS
            self.items.append(Item(id_, dense, [p for p in [*parts, cur] if len(p) >= least]))
        self._seed()

    def _seed(self) -> None:
        """Rare tokens (letter n-grams) by item; rarer ones suffice as long as every stretch keeps enough of them."""
        words: Counter = Counter()
        for it in self.items:
            if not it.dense:
                words.update({t for p in it.parts for t in p})
        need = MIN_WORDS // ONE_IN + 1
        limit = 1
        while limit < len(self.items) and not all(
            sum(words[t] <= limit for t in p[i : i + MIN_WORDS]) >= need for it in self.items if not it.dense for p in it.parts for i in range(len(p) - MIN_WORDS + 1)
        ):
            limit *= 2
        self.word_seeds: dict[str, list[int]] = defaultdict(list)
        self.letter_seeds: dict[str, list[int]] = defaultdict(list)
        for n, it in enumerate(self.items):
            if it.dense:
                for g in {"".join(p[i : i + SEED_LETTERS]) for p in it.parts for i in range(len(p) - SEED_LETTERS + 1)}:
                    self.letter_seeds[g].append(n)
            else:
                for t in {t for p in it.parts for t in p if words[t] <= limit}:
                    self.word_seeds[t].append(n)
        self.words = frozenset(self.word_seeds)
        self.letters = frozenset(self.letter_seeds)

    def candidates(self, toks: list[str]) -> set[int]:
        out: set[int] = set()
        for t in self.words.intersection(toks):
            out.update(self.word_seeds[t])
        if self.letters and any(map(_HAN.match, toks)):
            run = "".join(t for t in toks if t.isdigit() or _HAN.match(t))
            for g in self.letters.intersection(map("".join, zip(*(run[i:] for i in range(SEED_LETTERS))))):
                out.update(self.letter_seeds[g])
        return out

    def matches(self, text: str) -> Iterator[tuple[Item, list[tuple[list[str], list[str], list[tuple[int, int, int]]]]]]:
        """Candidate items with the tiles of each of their parts."""
        toks = tokens(fold(text))
        letters: list[str] | None = None
        for n in sorted(self.candidates(toks)):
            it = self.items[n]
            if it.dense and letters is None:
                letters = _as_letters([t for t in toks if t.isdigit() or _HAN.match(t)])
            doc = letters if it.dense else toks
            yield it, [(p, doc, tiles(p, doc, MIN_TILE_LETTERS if it.dense else MIN_TILE_WORDS)) for p in it.parts]

    def leaked(self, text: str) -> list[int]:
        """Ids of the items of which the text holds a passage."""
        return [it.id for it, found in self.matches(text) if any(covers(t, MIN_LETTERS if it.dense else MIN_WORDS, p, doc) for p, doc, t in found)]

    def covered(self, text: str) -> list[tuple[int, float, bool]]:
        """``(item, covered share, whether pieces come in another order)`` of items at least half covered by longer tiles."""
        out = []
        for it, found in self.matches(text):
            piece = PIECE_LETTERS if it.dense else PIECE_WORDS
            long = [[x for x in t if x[2] >= piece] for _, _, t in found]
            share = sum(n for t in long for *_, n in t) / max(1, sum(len(p) for p, _, _ in found))
            if share >= 0.5:
                out.append((it.id, round(share, 6), any(a[1] > b[1] for t in long for a, b in zip(t, t[1:]))))
        return out


def shingle_hash(g: tuple) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(g)) - (1 << 63)


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _windows(codes: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """``(start, rolling hash)`` of the unmarked windows of ``size`` tokens."""
    top = pow(_BASE, size - 1, _MOD)
    h, run = 0, 0
    for i, c in enumerate(codes):
        if not free[i]:
            h = run = 0
            continue
        if run == size:
            h = (h - codes[i - size] * top) % _MOD
            run -= 1
        h = (h * _BASE + c) % _MOD
        run += 1
        if run == size:
            yield i - size + 1, h


def tiles(pattern: list[str], text: list[str], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: ``(pattern start, text start, length)`` of non-overlapping matches.

    Only the text around tokens of the pattern is looked at, so a long document costs what its candidates cost.
    """
    known: dict[str, int] = {}
    for t in pattern:
        known.setdefault(t, len(known) + 1)
    pc = [known[t] for t in pattern]
    tc = [known.get(t, 0) for t in text]
    pf, tf = [True] * len(pc), [c > 0 for c in tc]
    out: list[tuple[int, int, int]] = []
    size = max(shortest, min(len(pc), 16))
    while True:
        while True:
            table: dict[int, list[int]] = defaultdict(list)
            for i, h in _windows(pc, pf, size):
                table[h].append(i)
            found: list[tuple[int, int, int]] = []
            if table:
                for j, h in _windows(tc, tf, size):
                    for i in table.get(h, ()):
                        if i and j and pf[i - 1] and tf[j - 1] and pc[i - 1] == tc[j - 1]:
                            continue  # not the start of a maximal match
                        n = 0
                        while i + n < len(pc) and j + n < len(tc) and pf[i + n] and tf[j + n] and pc[i + n] == tc[j + n]:
                            n += 1
                        if n >= size:
                            found.append((n, i, j))
            if not found:
                break
            for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                if all(pf[i : i + n]) and all(tf[j : j + n]):
                    out.append((i, j, n))
                    pf[i : i + n] = [False] * n
                    tf[j : j + n] = [False] * n
                elif n > size:  # what an earlier tile left of it comes again
                    continue
            if not any(all(pf[i : i + size]) and all(tf[j : j + size]) for _, i, j in found):
                break
        if size == shortest:
            return sorted(out)
        size = max(shortest, size // 2)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def covers(found: list[tuple[int, int, int]], least: int, pattern: list[str] | None = None, text: list[str] | None = None) -> bool:
    """Whether tiles chain to a stretch of the pattern of ``least`` tokens with at most one in ``ONE_IN`` differing.

    A gap may be as wide as the stretch, were it a whole one, allows; within it the sequences are aligned exactly.
    """
    n = len(found)
    for a in range(n):
        i, j, size = found[a]
        start, end_i, end_j, diff = i, i + size, j + size, 0
        if end_i - start >= least:
            return True
        b = a
        while True:
            # The next tile of the chain: the nearest that lies a little behind in both sequences.
            far = max(2, least // ONE_IN + 1, (end_i - start) // ONE_IN + 1) + 1
            best = None
            for c in range(b + 1, n):
                gi, gj = found[c][0] - end_i, found[c][1] - end_j
                if gi > far:
                    break
                if 0 <= gi and 0 <= gj <= far and (best is None or max(gi, gj) < best[0]):
                    best = (max(gi, gj), c, gi, gj)
            if best is None:
                break
            same = _common(pattern[end_i : end_i + best[2]], text[end_j : end_j + best[3]]) if pattern is not None and best[2] and best[3] else 0
            diff += best[0] - same
            b = best[1]
            end_i, end_j = found[b][0] + found[b][2], found[b][1] + found[b][2]
            size = end_i - start
            if size >= least and diff * ONE_IN <= size:
                return True
            if diff * ONE_IN > max(size, least) + 4 * least:
                break
    return False


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def _finder(held: Held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i in held.leaked(t)]
            cols = list(zip(*rows)) or [[]] * 2
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return run


_COVER = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("reordered", pa.bool_())])


def _coverer(held: Held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for x in held.covered(t)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _COVER)], schema=_COVER)

    return run


def _shared(items: DataFrame) -> DataFrame:
    """Hashes of wording that different items share, found by counting (for more than one block of items)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ts = [], []
            for text in b.column("text").to_pylist():
                dense, toks = _item_tokens(text)
                own = {shingle_hash(g) for _, g in _shingles(toks, dense)}
                hs += own
                ts += [shingle_hash(tuple(toks))] * len(own)
            yield pa.record_batch([pa.array(hs, pa.int64()), pa.array(ts, pa.int64())], names=["h", "t"])

    return items.select("text").mapInArrow(cut, "h bigint, t bigint").distinct().groupBy("h").count().where("count > 1").select("h")


def _blocks(eval_items: DataFrame, most: int) -> Iterator[Held]:
    """The items in blocks of about ``most`` at most, each with the shared wording of all."""
    items = eval_items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    n = items.count()
    if n <= most:
        yield Held(sorted((r.item_id, r.text) for r in items.collect()))
        return
    # Of the wording shared over all items a block needs what its own items hold; the rest never meets it.
    shared = _shared(items).persist()
    k = -(-2 * n // most)
    for i in range(k):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(k)) == i)
        rows = block.collect()
        own = {shingle_hash(g) for r in rows for dense, toks in [_item_tokens(r.text)] for _, g in _shingles(toks, dense)}
        mine = items.sparkSession.createDataFrame([(h,) for h in own], "h bigint")
        yield Held(sorted((r.item_id, r.text) for r in rows), frozenset(r.h for r in shared.join(mine, "h").collect()))
    shared.unpersist()


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")


def p9_found(documents: DataFrame, eval_items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id``: documents holding a passage of a test item; null and empty texts hold none."""
    found = [_texts(documents).mapInArrow(_finder(h), "doc_id bigint, item_id bigint") for h in _blocks(eval_items, block_items)]
    return reduce(DataFrame.union, found).distinct()


def coverage(documents: DataFrame, eval_items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, share, reordered``: items at least half of whose own wording a document holds in pieces, in any order."""
    found = [_texts(documents).mapInArrow(_coverer(h), "doc_id bigint, item_id bigint, share double, reordered boolean") for h in _blocks(eval_items, block_items)]
    return reduce(DataFrame.union, found).distinct()


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``item_id, docs``: how many documents each leaked item is found in."""
    return p9_found(documents, eval_items).groupBy("item_id").count().withColumnRenamed("count", "docs")
