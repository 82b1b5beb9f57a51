"""Exact retrieval of the most similar candidates, in blocks.

Queries and pool are cut into blocks; each pair of a query block and a pool block is one task that
multiplies two matrices and keeps the k best candidates of each query, so no pair of rows is ever emitted.
The blocks' finds are merged per query. Queries are a stated set; the pool is every usable row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.schema import RETRIEVAL_MODES


def check_mode(mode: str) -> str:
    got = mode.strip().lower()
    if got not in RETRIEVAL_MODES:
        raise ValueError(f"retrieval mode must be one of {', '.join(RETRIEVAL_MODES)}")
    return got


def check_alpha(alpha: float) -> float:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    return alpha


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64, copy=False)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _units(mode: str, rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The unit vectors that the mode compares, one matrix per column."""
    return {v: _unit(rows[v]) for v, other in (("v1", "semantic"), ("v2", "structural")) if mode != other}


def _scores(mode: str, alpha: float, q: dict[str, np.ndarray], c: dict[str, np.ndarray]) -> np.ndarray:
    if mode in ("structural", "semantic"):
        (v,) = q
        return q[v] @ c[v].T
    s, m = q["v1"] @ c["v1"].T, q["v2"] @ c["v2"].T
    if mode == "hybrid":
        return alpha * s + (1 - alpha) * m
    a, b = alpha**2, (1 - alpha) ** 2
    return (a * s + b * m) / (a + b)


def _first_best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the ``k`` greatest of each row, greatest first and the first among equals. ``s`` is used up."""
    if k > 8:
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(s, at, 1)
    at, rows = np.empty((len(s), min(k, s.shape[1])), np.int64), np.arange(len(s))
    got = np.empty(at.shape)
    for i in range(at.shape[1]):
        at[:, i] = s.argmax(1)
        got[:, i] = s[rows, at[:, i]]
        s[rows, at[:, i]] = -np.inf
    return at, got


class Pool:
    """Candidates in order of their ids: unit vectors, ids and groups as numbers."""

    def __init__(self, mode: str, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("id", kind="stable")
        self.mode, self.ids = mode, rows["id"].to_numpy()
        self.units = _units(mode, rows) if len(rows) else {}
        (self.id_no, self.id_of), (self.group_no, self.group_of) = ((no, pd.Index(of)) for no, of in map(pd.factorize, (rows["id"], rows["g"])))

    def best(self, q: pd.DataFrame, alpha: float, k: int, exclude_group: bool, strip: int) -> pd.DataFrame:
        """The ``k`` best candidates of each query. Scores are held for 512 queries and ``strip`` candidates at a time, however large the pool."""
        if not len(q) or not len(self.ids):
            return pd.DataFrame({"query_id": [], "candidate_id": [], "similarity": []})
        out = []
        for lo in range(0, len(q), 512):
            part = q.iloc[lo : lo + 512]
            own, id_no, group_no = _units(self.mode, part), self.id_of.get_indexer(part["id"]), self.group_of.get_indexer(part["g"])
            at, got = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0))
            for c in range(0, len(self.ids), strip):
                s = _scores(self.mode, alpha, own, {v: x[c : c + strip] for v, x in self.units.items()})
                np.round(s, 9, out=s)
                np.copyto(s, -np.inf, where=id_no[:, None] == self.id_no[None, c : c + strip])
                if exclude_group:
                    np.copyto(s, -np.inf, where=group_no[:, None] == self.group_no[None, c : c + strip])
                near, value = _first_best(s, k)
                at, got = np.concatenate([at, near + c], 1), np.concatenate([got, value], 1)  # lower ids stay first among equals
                order = np.argsort(-got, axis=1, kind="stable")[:, :k]
                at, got = np.take_along_axis(at, order, 1), np.take_along_axis(got, order, 1)
            r, j = np.nonzero(np.isfinite(got))
            out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[r], "candidate_id": self.ids[at[r, j]], "similarity": got[r, j]}))
        return pd.concat(out)


def _all_usable(*vectors: tuple[str, int] | None) -> Column:
    from timberline.functions.vectors import usable

    out = F.lit(True)
    for name, x in zip(("v1", "v2"), vectors):
        out = out & usable(F.col(name), x[1]) if x else out
    return out


def retrieve(rows: DataFrame, id_col: str, group_col: str, is_query: Column, is_candidate: Column, structural: tuple[str, int] | None, semantic: tuple[str, int] | None, mode: str = "hybrid", alpha: float = 0.5, k: int = 1, exclude_group: bool = True, block_rows: int = 8192, broadcast_bytes: int = 32 << 20, need_vectors: bool = False) -> DataFrame:
    """``query_id, candidate_id, similarity, rank``.

    Candidates of the query's own group are left out (``exclude_group``), else only the query itself. Rows
    whose vectors are null, of another length, with null or NaN elements or of length 0 are neither. Ties
    go to the lower id; similarities are compared to 9 digits, so that the order does not hang on rounding.
    Null groups are a group of their own. With ``need_vectors`` a query without usable vectors is an error.
    Ids are whole numbers or strings. A pool of up to ``broadcast_bytes`` is sent to the queries, which then are not moved.
    """
    from timberline.functions.vectors import usable

    mode, alpha = check_mode(mode), check_alpha(alpha)
    need = [x for x, on in ((structural, mode != "semantic"), (semantic, mode != "structural")) if on]
    if any(x is None for x in need):
        raise ValueError(f"mode {mode} needs its vector columns")
    kind = "string" if dict(rows.dtypes)[id_col] == "string" else "bigint"
    base = rows.select(F.col(id_col).cast(kind).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("g"), is_query.alias("q"), is_candidate.alias("c"), (F.col(structural[0]) if structural else F.lit(None).cast("array<double>")).alias("v1"), (F.col(semantic[0]) if semantic else F.lit(None).cast("array<double>")).alias("v2")).where("id is not null")
    if need_vectors and (bare := base.where(F.col("q") & ~F.coalesce(_all_usable(structural if structural in need else None, semantic if semantic in need else None), F.lit(False))).count()):
        raise ValueError(f"{bare} queries have no usable vector for mode {mode}")
    for name, x in (("v1", structural), ("v2", semantic)):
        if x and x in need:
            base = base.where(usable(F.col(name), x[1]))
        else:
            base = base.withColumn(name, F.lit(None).cast("array<double>"))

    n = base.where("c").count()
    found_ddl = f"query_id {kind}, candidate_id {kind}, similarity double"
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id")
    if n * 8 * sum(x[1] for x in need) <= broadcast_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(Pool(mode, base.where("c").select("id", "g", "v1", "v2").toPandas()))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield shared.value.best(pdf, alpha, k, exclude_group, block_rows)

        found = base.where("q").select("id", "g", "v1", "v2").mapInPandas(near, found_ddl)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    n_q = base.where("q").count()
    blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_q // block_rows))
    pool = base.where("c").withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    ask = base.where("q").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cols = ["qb", "pb", "id", "g", "v1", "v2"]
    other = pool.select(*[F.col(c).alias(f"c_{c}") for c in cols])

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return Pool(mode, c.rename(columns=lambda x: x.removeprefix("c_"))).best(q, alpha, k, exclude_group, block_rows)

    found = ask.select(*cols).groupBy("qb", "pb").cogroup(other.groupBy("c_qb", "c_pb")).applyInPandas(best, found_ddl)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairwise_stats(rows: DataFrame, id_col: str, vec: str, dim: int, block_rows: int = 4096) -> DataFrame:
    """One row over all pairs of usable vectors: ``n, mean, std, min, max`` of the cosine.

    Mean and deviation follow from the sum of the unit vectors and of their outer products, in one pass summed
    on the executors. Least and greatest need every pair, so their work grows with the square of the rows: it
    is cut into products of blocks by row id, of which each task gives two numbers.
    """
    from timberline.functions.vectors import usable

    x = rows.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).where(usable(F.col("v"), dim))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + dim + dim * dim)
        for pdf in batches:
            if len(pdf):
                u = _unit(pdf["v"])
                total += np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])
        yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    parts = x.select("v").mapInPandas(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()
    n, s, g = (int(parts[0]), parts[1 : dim + 1], parts[dim + 1 :]) if len(parts) else (0, np.zeros(dim), np.zeros(dim * dim))
    pairs = n * (n - 1) / 2
    blocks = max(1, -(-n // block_rows))
    numbered = x.select("v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    left = numbered.withColumn("o", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))))
    right = numbered.select(F.col("v").alias("w"), F.col("b").alias("o2"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b2"))

    def ends(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"lo": [], "hi": []})
        same = a["b"].iloc[0] == a["o"].iloc[0]
        u, w = _unit(a["v"]), _unit(c["w"])
        p = (u @ u.T)[np.triu_indices(len(u), 1)] if same else (u @ w.T).ravel()
        return pd.DataFrame({"lo": [p.min()], "hi": [p.max()]}) if len(p) else pd.DataFrame({"lo": [], "hi": []})

    lim = left.groupBy("b", "o").cogroup(right.groupBy("b2", "o2")).applyInPandas(ends, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mean = float((s @ s - n) / 2 / pairs) if n > 1 else None
    var = max(float((g @ g - n) / 2 / pairs) - mean * mean, 0.0) if n > 1 else None
    return lim.select(F.lit(n).cast("bigint").alias("n"), F.round(F.lit(mean).cast("double"), 6).alias("mean"), F.round(F.sqrt(F.lit(var).cast("double")), 6).alias("std"), F.round("lo", 6).alias("min"), F.round("hi", 6).alias("max"))
