"""Encoding of texts with a public byte-level vocabulary.

Words are cut by the vocabulary's pattern; each word's bytes are merged in a contiguous rank array: part
boundaries and the rank of each adjacent pair stand in two short lists, the least rank is found by a scan,
its boundary deleted and the two neighbouring ranks refreshed. Words of over ``LONG`` bytes, where scanning
would be quadratic, keep the pairs in a heap with the same order of merges. Words seen before come from a
cache of bounded size. Special tokens are never produced: their strings are ordinary text.

Defined results: a null and an empty text each give an empty list; unpaired surrogates cannot occur in the
tables' strings; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY_DIR = "/opt/tokenizers"
LONG = 192
CACHE = 1 << 17
#: The word pattern that goes with the vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 60


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.word = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG:
            return self._merge_long(piece)
        cut = list(range(len(piece) + 1))
        pair = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pair:
            least = min(pair)
            if least == _NONE:
                break
            i = pair.index(least)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(piece[cut[i] : cut[i + 2]], _NONE)
            if i:
                pair[i - 1] = ranks.get(piece[cut[i - 1] : cut[i + 1]], _NONE)
        return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges in the same order: least rank first, then leftmost."""
        n, ranks = len(piece), self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or after[i] >= n:
                continue
            j = after[i]
            if after[j] - i != size:
                continue
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : after[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, after[after[i]] - i))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p : after[i]])) is not None:
                heapq.heappush(heap, (r, p, after[i] - p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for w in self.word.findall(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.merge(w.encode())
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f)})


def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``<id_col> bigint, ids array<int>``; one narrow pass over the two columns."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows = [enc.encode(t) if t else [] for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} bigint, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``n_tokens bigint`` of each row; null and empty texts have 0."""
    path = path or vocabulary()
    kept = df.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField("n_tokens", LongType())]))
