"""Does a text stop where texts end, or where they go on? A backward character n-gram model.

For every position of every text the characters before it, read backwards, form contexts of several
lengths; each is counted as followed by an end (a full stop or other closing mark, then space or nothing)
or by a continuation. Every context has its own count, in a table shuffled by the context's 64-bit key, and
the final contexts of the values are joined to it. For the final context of a text the chance of an end is
interpolated from short to long contexts.

``Endings`` is the same model in memory, for a few thousand texts: its hashed tables have one size, each
context is counted in two places and the emptier one is read.

``log_odds`` compares continuation with end: log P(context | cut) - log P(context | whole), positive where
the text stops where texts go on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize

LENGTHS = (3, 5, 8, 12, 17)
BITS = 18
#: Characters at a text's end that are looked at: more than the longest context and any closing marks.
REACH = 160
SIZE = 1 << BITS
TABLES = 2 * len(LENGTHS)
#: Keys that a task holds before it adds them up or passes them on; a bound of memory, not of what is counted.
HELD = 1 << 22
#: Weight of the shorter context's estimate.
PULL = 1.5
_P = np.uint64(1099511628211)
_BACK = np.uint64(pow(1099511628211, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)

_CLOSE = "\"'”’»)]}"
_TAIL = re.compile(r"[\s​‍️️\U0001F000-\U0001FAFF☀-➿]+$")
_ASIDE = re.compile(r"([.!?])\s*[(\[][^()\[\]]{1,20}[)\]]$")
#: Whole texts may trail off in these. Fixed values.
_SO_ON = re.compile(r"(?:\band so on|\band so forth|\betc|\busw|\bund so weiter|\becc|\be così via|\benz|\benzovoort|\by así|\by demás|\be assim por diante|\bet ainsi de suite|и так далее|и т\. ?д)$", re.I)
_DOTS = re.compile(r"(?:\.\.\.+|…)$")


def clean(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


def final_context(text: str) -> tuple[str, str]:
    """(last words without their closing marks, 'end' | 'dots' | 'open' | 'broken') of a cleaned text."""
    text = text[-REACH:]
    if text.endswith("�"):
        return text.rstrip("�"), "broken"
    t = _TAIL.sub("", text)
    t = _ASIDE.sub(r"\1", t)
    t = t.rstrip(_CLOSE) if t.rstrip(_CLOSE).endswith((".", "!", "?", "…")) else t
    if _DOTS.search(t):
        body = _DOTS.sub("", t).rstrip()
        return body, "end" if _SO_ON.search(body) else "dots"
    if t.endswith((".", "!", "?", "。")):
        return t.rstrip(".!?"), "end"
    stripped = t.rstrip(_CLOSE)
    return (stripped if t != text or stripped != t else t), "open"


class _Rolling:
    """Hashes of the k characters before any position: differences of one weighted prefix sum, mod 2**64."""

    def __init__(self, codes: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            codes = (codes + np.uint64(1)) * _MIX
            codes = (codes ^ (codes >> np.uint64(32))) * _MIX
            power = np.cumprod(np.full(len(codes), _P, np.uint64))
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power)])
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(codes), _BACK, np.uint64))])

    def keys(self, ends: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit key of the context of k characters before each of ``ends``, and whether so many stand there."""
        ok = ends - starts >= k
        e = np.where(ok, ends, k)
        with np.errstate(over="ignore"):
            h = (self.prefix.take(e) - self.prefix.take(e - k)) * self.back.take(e) + np.uint64(k)
            h = (h ^ (h >> np.uint64(31))) * _MIX
            h = (h ^ (h >> np.uint64(29))) * _MIX
        return h, ok

    def buckets(self, ends: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The two buckets (2 x n) of the context before each of ``ends``, and whether so many characters stand there."""
        h, ok = self.keys(ends, starts, k)
        return np.stack([h >> np.uint64(64 - BITS), (h >> np.uint64(64 - 2 * BITS)) & np.uint64(SIZE - 1)]).astype(np.int64), ok


def _places(texts: list[str]) -> tuple[_Rolling, np.ndarray, np.ndarray, np.ndarray] | None:
    """Hashes of cleaned texts, the positions that count, where their texts start, and whether an end stands there."""
    texts = [t.lower() for t in texts if len(t) >= 8]
    if not texts:
        return None
    joined = "\x00".join(texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    sep = np.nonzero(codes == 0)[0]
    starts = np.zeros(n, np.int64)
    starts[1:] = np.repeat(np.concatenate([[0], sep + 1]), np.diff(np.concatenate([[0], sep + 1, [n]])))[1:]
    stop = np.isin(codes, np.array([ord(c) for c in ".!?…"], np.uint64))
    nxt = np.concatenate([codes[1:], [0]])
    dots = (stop & (nxt == ord("."))) | (codes == ord("…"))  # an ellipsis may stand for either
    closing = np.isin(nxt, np.array([0, 32, *map(ord, "\"'”’»)]")], np.uint64))
    digit = np.concatenate([[False], (codes[:-1] >= 48) & (codes[:-1] <= 57)])
    is_end = stop & closing & ~digit
    use = np.flatnonzero((codes != 0) & ~dots & ~np.concatenate([[False], stop[:-1]]))
    return _Rolling(codes), use, starts[use], is_end[use]


def count(texts: list[str], ends_n: np.ndarray, goes_n: np.ndarray) -> None:
    """Add the contexts of cleaned texts to the tables (TABLES x SIZE)."""
    if (got := _places(texts)) is None:
        return
    rolling, use, first, end = got
    for li, k in enumerate(LENGTHS):
        b, ok = rolling.buckets(use, first, k)
        e = end[ok]
        for j in (0, 1):
            at = b[j][ok]
            ends_n[2 * li + j] += np.bincount(at[e], minlength=SIZE)
            goes_n[2 * li + j] += np.bincount(at[~e], minlength=SIZE)


class _Tally:
    """Occurrences of keys, added up now and then."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.keys, self.n, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.size += len(keys)
        if self.size >= HELD:
            self.sum()

    def sum(self) -> None:
        keys, n = np.unique(np.concatenate([*self.raw, np.zeros(0, np.uint64)]), return_counts=True)
        self.raw, self.size = [], 0
        keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
        order = keys.argsort(kind="stable")  # two sorted runs
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.sum()
        got = self.keys.astype(np.int64), self.n
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return got


class Endings:
    def __init__(self, ends: np.ndarray, goes: np.ndarray, pull: float = PULL) -> None:
        self.ends, self.goes, self.pull = ends, goes, pull
        total = ends[0].sum() + goes[0].sum()
        self.base = float(max(ends[0].sum(), 1) / max(total, 1))

    def log_odds(self, contexts: list[str]) -> np.ndarray:
        tails = [("\x00" * LENGTHS[-1] + c.lower())[-LENGTHS[-1] :] for c in contexts]
        if not tails:
            return np.zeros(0)
        codes = np.frombuffer("".join(tails).encode("utf-32-le"), np.uint32).astype(np.uint64)
        end = (np.arange(len(tails)) + 1) * LENGTHS[-1]
        size = np.minimum([len(c) for c in contexts], LENGTHS[-1])
        p = np.full(len(tails), self.base)
        rolling = _Rolling(codes)
        for li, k in enumerate(LENGTHS):
            b, ok = rolling.buckets(end, end - size, k)
            e1, g1, e2, g2 = (t[2 * li + j].take(b[j]) for j in (0, 1) for t in (self.ends, self.goes))
            one = e1 + g1 <= e2 + g2
            e, g = np.where(one, e1, e2), np.where(one, g1, g2)
            p = np.where(ok, (e + self.pull * p) / (e + g + self.pull), p)
        return np.log(self.base) - np.log(np.maximum(p, 1e-9))


def count_contexts(texts: DataFrame) -> DataFrame:
    """``key, n, ends``: how often each context stands in the texts of a one-column frame ``text``, and before an end.

    Under key 0: all positions with a context of the shortest length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, ends = _Tally(), _Tally()
        total = np.zeros(2, np.int64)

        def taken() -> Iterator[pd.DataFrame]:
            for i, tally in enumerate((every, ends)):
                keys, n = tally.take()
                yield pd.DataFrame({"key": keys, "n": n * (i == 0), "ends": n * (i == 1)})

        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                if (got := _places([clean(t) for t in pdf["text"].iloc[lo : lo + 1000] if t])) is None:
                    continue
                rolling, use, first, end = got
                for k in LENGTHS:
                    h, ok = rolling.keys(use, first, k)
                    every.add(h[ok])
                    ends.add(h[ok & end])
                    if k == LENGTHS[0]:
                        total += (ok.sum(), (ok & end).sum())
                if len(every.keys) >= HELD:
                    yield from taken()
        yield from taken()
        yield pd.DataFrame({"key": [0], "n": [total[0]], "ends": [total[1]]})

    return texts.mapInPandas(run, "key bigint, n bigint, ends bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def tail_of(context: str) -> str:
    """What the model reads of a final context."""
    return context.lower()[-LENGTHS[-1] :]


def _tail_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per tail and length that it has; the shortest length stands for a tail that has none."""
    for pdf in batches:
        tails = pdf["tail"].to_numpy(object)
        if not len(tails):
            continue
        codes = np.frombuffer("".join(t.rjust(LENGTHS[-1], "\x00") for t in tails).encode("utf-32-le"), np.uint32).astype(np.uint64)
        end = (np.arange(len(tails)) + 1) * LENGTHS[-1]
        rolling = _Rolling(codes)
        for k in LENGTHS:
            h, ok = rolling.keys(end, end - np.array([len(t) for t in tails]), k)
            yield pd.DataFrame({"tail": tails, "k": k, "key": pd.arrays.IntegerArray(h.astype(np.int64), ~ok)})[ok | (k == LENGTHS[0])]


def log_odds(tails: DataFrame, texts: DataFrame) -> tuple[DataFrame, float]:
    """``tail, log_odds`` of every tail of a frame ``tail``, by exact counts over all of ``texts``; and the share of ends."""
    asked = tails.select("tail").where("tail is not null").distinct().mapInPandas(_tail_keys, "tail string, k int, key bigint")
    total = tails.sparkSession.range(1).select(F.lit(None).cast("string").alias("tail"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("key"))
    of_k = [F.sum(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in (0, *LENGTHS) for c in ("n", "ends")]
    found = materialize(asked.unionByName(total).join(count_contexts(texts), "key", "left").groupBy("tail").agg(*of_k), "endings")
    whole = found.where("tail is null").first()
    base = max(whole["ends_0"] or 0, 1) / max(whole["n_0"] or 0, 1)
    p = F.lit(base)
    for k in LENGTHS:
        n, ends = (F.coalesce(F.col(f"{c}_{k}"), F.lit(0)) for c in ("n", "ends"))
        p = (ends + F.lit(PULL) * p) / (n + F.lit(PULL))
    return found.where("tail is not null").select("tail", (F.lit(float(np.log(base))) - F.log(F.greatest(p, F.lit(1e-9)))).alias("log_odds")), base
