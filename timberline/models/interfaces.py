"""Model operators behind interfaces, with deterministic offline stubs.

A backend is made once per Python worker by its factory and used for whole Arrow batches. Backends must run
locally: no text leaves the machine. Generated text is not deterministic in general, so its UDF is marked
so; materialize its output before more than one use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from timberline.schema import NLI_LABELS

SCORES = StructType([StructField(n, DoubleType()) for n in NLI_LABELS])


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str], max_tokens: int, temperature: float) -> list[str]: ...


class PairScorer(Protocol):
    def score(self, premises: list[str], hypotheses: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors from hashed words; equal texts get equal vectors."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class EchoGenerator:
    """Gives back the first words of the prompt's last line but one; only to exercise the plumbing."""

    def generate(self, prompts: list[str], max_tokens: int, temperature: float) -> list[str]:
        return [" ".join((p.strip().splitlines() or [""])[-2:][0].split()[:max_tokens]).strip() for p in prompts]


class OverlapScorer:
    """Word overlap as entailment; the rest is halved between contradiction and neutral."""

    def score(self, premises: list[str], hypotheses: list[str]) -> np.ndarray:
        out = np.zeros((len(premises), 3))
        for i, (p, h) in enumerate(zip(premises, hypotheses)):
            hw, pw = set((h or "").lower().split(" ")), set((p or "").lower().split(" "))
            o = len(hw & pw) / max(len(hw), 1)
            out[i] = o, (1 - o) / 2, (1 - o) / 2
        return out


class LogitScorer:
    """A pair scorer over a classifier's raw outputs.

    ``logits`` gives one row of numbers per (premise, hypothesis); ``names`` says what each column stands for,
    in any case and with any addition. Pairs go to the classifier in batches.
    """

    def __init__(self, logits: Callable[[list[str], list[str]], np.ndarray], names: dict[int, str], batch: int = 16) -> None:
        self.logits, self.batch = logits, batch
        folded = {name.casefold(): column for column, name in sorted(names.items(), reverse=True)}
        self.columns = []
        for want in NLI_LABELS:
            fits = [column for name, column in folded.items() if want in name]
            if not fits:
                raise ValueError(f"no output of the classifier stands for {want}")
            self.columns.append(min(fits))

    def score(self, premises: list[str], hypotheses: list[str]) -> np.ndarray:
        parts = [np.asarray(self.logits(premises[i : i + self.batch], hypotheses[i : i + self.batch]), np.float64) for i in range(0, len(premises), self.batch)]
        if not parts:
            return np.zeros((0, 3))
        raw = np.concatenate(parts)
        odds = np.exp(raw - raw.max(1)[:, None])
        return (odds / odds.sum(1)[:, None])[:, self.columns]


_made: dict[str, object] = {}


def _named(key: str, make: Callable[[], object]) -> str:
    """A key that two factories never share."""
    return f"{key}-{hashlib.sha256(cloudpickle.dumps(make)).hexdigest()}"


def once(key: str, make: Callable[[], object]) -> object:
    """One backend per Python worker and key."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def embed_udf(make: Callable[[], Embedder], key: str = "embedder"):
    key = _named(key, make)

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = once(key, make)
        for b in batches:
            yield pd.Series(list(m.embed(b.fillna("").tolist()).astype(np.float32)))

    return embed


def generate_udf(make: Callable[[], Generator], max_tokens: int, temperature: float, key: str = "generator"):
    key = _named(key, make)

    @F.pandas_udf(StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = once(key, make)
        for b in batches:
            asked = b.notna()
            got = m.generate(b[asked].tolist(), max_tokens, temperature)
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            out[asked] = [g.strip() for g in got]
            yield out

    return generate.asNondeterministic()


def score_udf(make: Callable[[], PairScorer], key: str = "scorer"):
    key = _named(key, make)

    @F.pandas_udf(SCORES)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = once(key, make)
        for p, h in batches:
            yield pd.DataFrame(m.score(p.fillna("").tolist(), h.fillna("").tolist()), columns=list(NLI_LABELS))

    return score
