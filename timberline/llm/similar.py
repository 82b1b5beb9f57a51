"""Most similar vectors for every vector: cells of a coarse partition, a graph in each, beam search.

1. *Copies.* Rows with one vector form a class, named by its lowest id; only classes are placed and searched.
   The ``k + 1`` lowest ids of a class stand for its rows, so no group of copies is gathered in one task.
2. *Cells.* Spherical k-means on a bounded sample gives one centroid per ``cell_rows`` classes, however many
   there are: on the driver up to ``fan`` of them, beyond that ``fan`` groups at most, each cut further on the
   executors by a sample of its own. Each class is searched in its nearest cell and, when nearly as close
   (within ``margin`` of the lead of the best over the average one), in further ones, up to ``max_cells``; it is indexed in the first ``index_cells`` of them. Every row is indexed.
3. *Graph.* Each cell holds a robust-pruned directed graph (``vamana.Graph``) that beam search queries. Where
   a sample shows that a cell is far over its size, its index is cut into blocks and its queries into
   batches, each pair of them a task of its own, so that no task grows with the data.
4. *Merge.* Finds of all cells count in both directions; the k best per class are written out as rows, ties to
   the lower id.

Defined results: rows with a null id or vector, a wrong number of elements, a null, NaN or infinite
element or no length have no neighbours and are nobody's neighbour. Repeated rows of an id count once; an
id that comes with several vectors has the best neighbours of all of them. An empty table gives no rows.
With fewer than k + 1 rows a row has fewer neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.vamana import Graph
from timberline.session import materialize, parallelism

#: Bound of the centroids that are sent to every executor; beyond it cells grow and are cut into blocks.
CENTROID_BYTES = 64 << 20
#: Classes routed to foresee a cell's size, per cell.
PROBES = 64
EDGES = "id bigint, other bigint, cosine double"


def _unit(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit float64 vectors of a list column of fixed length, and which of them are usable."""
    flat = col.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return x / np.where(ok, norm, 1.0)[:, None], ok


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    cent = [x[0]]
    gap = np.full(len(x), 2.0)
    for _ in range(k - 1):
        gap = np.minimum(gap, np.maximum(1.0 - x @ cent[-1], 0.0))
        p = gap**2
        cent.append(x[rng.choice(len(x), p=p / p.sum())] if p.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(cent)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


class Cells:
    """Centroids in groups: a vector is compared with the groups' centres, then with the cells of the best groups."""

    def __init__(self, top: np.ndarray, group: np.ndarray, cent: np.ndarray, max_cells: int, index_cells: int, margin: float, groups: int = 6) -> None:
        order = np.argsort(group, kind="stable")
        self.top, self.cent, self.start = top, cent[order].astype(np.float32), np.searchsorted(group[order], np.arange(len(top) + 1))
        self.max_cells, self.index_cells, self.margin, self.groups = max_cells, index_cells, margin, groups

    def __len__(self) -> int:
        return len(self.cent)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each vector, best first, and their cosines (-inf where there are fewer)."""
        w = min(self.max_cells, len(self.cent))
        if len(self.top) <= self.groups:
            s = x @ self.cent.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :w]
            return best, np.take_along_axis(s, best, 1)
        near = np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, : self.groups]
        cell = np.full((len(x), self.groups * w), 0, np.int64)
        cos = np.full((len(x), self.groups * w), -np.inf)
        for g in np.unique(near):
            lo, hi = self.start[g], self.start[g + 1]
            if lo == hi:
                continue
            row, slot = np.nonzero(near == g)
            s = x[row] @ self.cent[lo:hi].T
            best = np.argsort(-s, axis=1, kind="stable")[:, :w]
            for j in range(best.shape[1]):
                cell[row, slot * w + j] = lo + best[:, j]
                cos[row, slot * w + j] = s[np.arange(len(row)), best[:, j]]
        best = np.argsort(-cos, axis=1, kind="stable")[:, :w]
        return np.take_along_axis(cell, best, 1), np.take_along_axis(cos, best, 1)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is indexed there) of every visit of a vector to a cell."""
        cell, cos = self.nearest(x)
        lead = cos[:, :1] - (x @ self.top.T).mean(1, keepdims=True)  # how far the best cell stands out
        row, j = np.nonzero(cos >= cos[:, :1] - self.margin * np.maximum(lead, 0))
        return row, cell[row, j], j < self.index_cells


def _fit_cells(kept: DataFrame, dim: int, n: int, cell_rows: int, fan: int, fit_rows: int, per_cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group centres, and group and centre of every cell."""
    want = min(max(1, math.ceil(n / cell_rows)), max(fan, CENTROID_BYTES // (4 * dim)))
    one = np.zeros((1, dim)), np.zeros(1, np.int64), np.zeros((1, dim))
    if want == 1:
        return one
    sample = kept.select("vec").orderBy(F.xxhash64("id")).limit(fit_rows).toArrow()
    x, ok = _unit(sample.column("vec").combine_chunks(), dim)
    x = x[ok]
    if not len(x):
        return one
    top = kmeans(x, min(want, max(1, len(x) // 8), fan if want <= fan else max(2, min(fan, math.isqrt(want)))))
    if want <= fan:
        return top, np.arange(len(top)), top
    share = np.bincount((x @ top.T).argmax(1), minlength=len(top)) / len(x)
    cells = np.maximum(1, np.round(share * want)).astype(np.int64)
    rate = min(1.0, per_cell * want / n)
    shared = kept.sparkSession.sparkContext.broadcast(top)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, good = _unit(b.column("vec"), dim)
            v = v[good]
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array((v @ shared.value.T).argmax(1)), pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary())], names=["g", "unit"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        v = np.frombuffer(b"".join(pdf["unit"].sort_values()), np.float32).reshape(-1, dim).astype(np.float64)
        c = kmeans(v, int(min(cells[g], max(1, len(v) // 8))), rounds=6)
        return pd.DataFrame({"g": g, "cent": [r.tobytes() for r in c.astype(np.float32)]})

    some = kept.where(F.pmod(F.xxhash64("id", F.lit(77)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    got = some.select("vec").mapInArrow(group, "g bigint, unit binary").groupBy("g").applyInPandas(cut, "g bigint, cent binary").collect()
    cent = np.frombuffer(b"".join(r["cent"] for r in got), np.float32).reshape(-1, dim)
    found = np.array([r["g"] for r in got], np.int64)
    bare = np.setdiff1d(np.arange(len(top)), found)  # a group without a sample of its own is one cell
    return top, np.concatenate([found, bare]), np.concatenate([cent, top[bare]])


def _foresee(kept: DataFrame, dim: int, n: int, cells: Cells, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and batches of each cell, from the visits of a sample. To the driver: one row per cell."""
    rate = min(1.0, PROBES * len(cells) / max(n, 1))
    shared = kept.sparkSession.sparkContext.broadcast(cells)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, all_ = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value), np.int64)
        for b in batches:
            x, ok = _unit(b.column("vec"), dim)
            _, cell, own = shared.value.places(x[ok])
            np.add.at(all_, cell, 1)
            np.add.at(home, cell[own], 1)
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(home[at]), pa.array(all_[at])], names=["cell", "home", "every"])

    some = kept.where(F.pmod(F.xxhash64("id", F.lit(78)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    got = some.select("vec").mapInArrow(visit, "cell bigint, home bigint, every bigint").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("every").alias("every")).collect()
    home, every = np.zeros(len(cells)), np.zeros(len(cells))
    for r in got:
        home[r["cell"]], every[r["cell"]] = r["home"] / rate, r["every"] / rate
    part = lambda m, size: np.maximum(1, np.ceil(m / size)).astype(np.int64)
    return part(home, 12 * cell_rows), part(every, 16 * cell_rows)


def most_similar(
    df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, min_cosine: float | None = None, fit_rows: int = 8192, per_cell: int = 16, fan: int = 256,
    cell_rows: int = 2500, max_cells: int = 4, index_cells: int = 2, margin: float = 0.38, degree: int = 20, beam: int = 30,
) -> DataFrame:
    """``id, other, cosine, rank``: the k most similar other rows of each row, best first.

    ``min_cosine`` leaves out neighbours below it, before they are moved; the search and the ranks stay the
    same. The sample for the cells has ``fit_rows`` rows, and ``per_cell`` more for each cell beyond ``fan``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    key = ["h1", "h2"]
    ids = materialize(rows.select(*key, "id").distinct(), "ids")
    lowest = Window.partitionBy(*key).orderBy("id")
    heads = ids.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k + 1).groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads = materialize(heads, "classes")
    n = heads.count()
    many = heads.where(F.size("ids") > 1)
    copies = many.select(*key, F.col("ids")[0].alias("rep"), "ids")
    kept = rows.join(copies.select(*key, "rep"), key, "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).select("id", "vec", F.col("rep").isNotNull().alias("many"))

    cells = Cells(*_fit_cells(kept, dim, n, cell_rows, fan, fit_rows, per_cell), max_cells, index_cells, margin)
    blocks, batches_ = _foresee(kept, dim, n, cells, cell_rows) if len(cells) > 1 or n > 6 * cell_rows else (np.ones(1, np.int64), np.ones(1, np.int64))
    shared = spark.sparkContext.broadcast((cells, blocks, batches_))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, nb, nq = shared.value
        for b in batches:
            x, ok = _unit(b.column("vec"), dim)
            x, own = x[ok], b.column("id").to_numpy()[ok]
            twin = b.column("many").to_numpy(zero_copy_only=False)[ok]
            if not len(x):
                continue
            row, cell, home = where.places(x)
            mix = (own[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block, batch = mix % nb[cell].astype(np.uint64), (mix >> np.uint64(8)) % nq[cell].astype(np.uint64)
            out = []  # group, row, indexed, asking
            for i in range(int(nb[cell].max(initial=0))):
                for j in range(int(nq[cell].max(initial=0))):
                    put, ask = home & (block == i), batch == j
                    go = (i < nb[cell]) & (j < nq[cell]) & (put | ask)
                    out.append(((cell[go] * 65536 + i) * 65536 + j, row[go], put[go], ask[go]))
            group, r, put, ask = (np.concatenate(z) for z in zip(*out))
            data = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(own[r]), pa.array(twin[r]), pa.array(put), pa.array(ask), pa.array([data[i].tobytes() for i in r], pa.binary())], names=["cell", "id", "many", "put", "ask", "unit"])

    floor = -2.0 if min_cosine is None else min_cosine - 1e-6

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own, first = np.unique(pdf["id"].to_numpy(), return_index=True)
        pdf = pdf.iloc[first]
        x = np.frombuffer(b"".join(pdf["unit"]), np.float32).reshape(-1, dim)
        put, ask = pdf["put"].to_numpy(bool), pdf["ask"].to_numpy(bool)
        back = np.flatnonzero(put)
        node = np.full(len(own), -1, np.int64)
        node[back] = np.arange(len(back))
        near, _ = Graph(x[back], degree=degree, beam=beam).neighbours(x[ask], node[ask], k, max(beam, k + 1))
        r, c = np.nonzero(near >= 0)
        src, dst = np.flatnonzero(ask)[r], back[near[r, c]] if len(back) else r
        cos = np.einsum("nd,nd->n", x[src].astype(np.float64), x[dst].astype(np.float64))
        twin = np.flatnonzero(pdf["many"].to_numpy(bool) & ask)
        out = pd.DataFrame({"id": np.concatenate([own[src], own[twin]]), "other": np.concatenate([own[dst], own[twin]]), "cosine": np.concatenate([cos, np.ones(len(twin))])})
        return out[out["cosine"] >= floor]

    placed = kept.mapInArrow(route, "cell bigint, id bigint, many boolean, put boolean, ask boolean, unit binary")
    edges = placed.groupBy("cell").applyInPandas(search, EDGES)
    both = F.explode(F.array(F.struct("id", "other", "cosine"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "cosine")))
    edges = edges.select(both.alias("e")).select("e.*").repartition(parallelism(spark), "id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    # a class that holds copies is its own first neighbour: k + 1 of it are kept
    best = Window.partitionBy("id").orderBy((F.col("id") != F.col("other")).cast("int"), F.desc("cosine"), "other")
    near = edges.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    shown = F.explode(F.coalesce("ids", F.array("other"))).alias("other")
    wide = near.join(copies.select(F.col("rep").alias("other"), "ids"), "other", "left").select("id", "cosine", shown).groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    ranked = lambda x: x.where("id <> other").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    wide = wide.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    # the other rows of a class have its neighbours; a hot class is split by adaptive execution
    twins = ids.join(copies.select(*key, "rep"), key).where("id <> rep").select(F.col("id").alias("row_id"), F.col("rep").alias("id"))
    theirs = twins.join(wide, "id").select(F.col("row_id").alias("id"), "cosine", "other")
    out = ranked(wide).unionByName(ranked(theirs)).select("id", "other", "cosine", "rank")
    return out if min_cosine is None else out.where(F.col("cosine") >= min_cosine)
