"""Problem 8: encoding the corpus with a public byte-level BPE tokenizer.

A piece (pre-token) is encoded by merging its byte pairs in order of rank, leftmost first.  A segment tree over the byte
positions holds, at every node, the position of the leftmost pair of minimum rank below it; a merge updates the two
neighbouring pairs that are still live by point updates, so a piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files (a parameter; they are not part of the repository).
VOCABULARIES = os.environ.get("CUEGRID_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed value: the split of byte-level BPE vocabularies of this kind into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces kept per worker.
CACHE = 400_000

_INF = 1 << 40


class SegmentTree:
    """Leftmost minimum of pair ranks with point updates."""

    __slots__ = ("size", "best", "rank")

    def __init__(self, ranks: list[int]):
        n = len(ranks)
        size = 1
        while size < n:
            size *= 2
        self.size = size
        self.rank = ranks + [_INF] * (size - n)
        best = [0] * size + list(range(size))
        rank = self.rank
        for i in range(size - 1, 0, -1):
            a, b = best[2 * i], best[2 * i + 1]
            best[i] = a if rank[a] <= rank[b] else b
        self.best = best

    def update(self, at: int, value: int) -> None:
        rank, best = self.rank, self.best
        rank[at] = value
        i = (self.size + at) // 2
        while i:
            a, b = best[2 * i], best[2 * i + 1]
            best[i] = a if rank[a] <= rank[b] else b
            i //= 2

    def minimum(self) -> tuple[int, int]:
        p = self.best[1]
        return self.rank[p], p


class Bpe:
    """Ranks of a vocabulary file; ``encode`` a text, ``piece`` a pre-token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES, cache: int = CACHE):
        self.ranks, self.cut, self.cache, self.limit = ranks, regex.compile(pattern), {}, cache

    @classmethod
    def load(cls, path: str, pattern: str = PIECES) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        get = self.ranks.get
        if n == 2:
            return [self.ranks[data[:1]], self.ranks[data[1:]]]
        tree = SegmentTree([get(data[i : i + 2], _INF) for i in range(n - 1)])
        after = list(range(1, n + 1))  # start of the part behind the one that starts here
        before = list(range(-1, n))  # start of the part before it
        while True:
            r, i = tree.minimum()
            if r >= _INF:
                break
            j = after[i]
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                m = after[k]
                tree.update(i, get(data[i:m], _INF))
            else:
                tree.update(i, _INF)
            if j < n - 1 or j < len(tree.rank):
                tree.update(j, _INF)
            if before[i] >= 0:
                h = before[i]
                tree.update(h, get(data[h:k], _INF))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        cache, out = self.cache, []
        for p in self.cut.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= 64:
                    if len(cache) >= self.limit:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe.load(path)
    return _loaded[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [bpe.encode(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(documents: DataFrame, folder: str | None = None, name: str = NAME) -> DataFrame:
    """``doc_id, ids``: the token ids of each document; empty and null texts have an empty list.

    Strings of special tokens in a text are ordinary text.  Repeated rows are encoded as often as they come.
    """
    path = os.path.join(folder or VOCABULARIES, f"{name}.tiktoken")
    return documents.select("doc_id", "text").mapInArrow(_encoder(path), "doc_id bigint, ids array<int>")


def lengths(documents: DataFrame, folder: str | None = None, name: str = NAME) -> DataFrame:
    """``source, docs, tokens``: token counts per source."""
    d = documents.select("doc_id", "source").dropDuplicates(["doc_id"])
    n = encode(documents, folder, name).select("doc_id", F.size("ids").alias("n")).dropDuplicates(["doc_id"])
    return n.join(d, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
