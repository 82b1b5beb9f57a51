"""Splits that keep related records together.

1. *Components.* Records are related when their group ids mean the same, however they are written; the
   spellings of one id form a component, named by the id's normal form. Records may be held together by
   several keys (author, source, entity): what shares any key, directly or through others, is one component.
2. *Balance.* Component weights (rows) are combined by largest differencing: the two partial partitions
   with the greatest spread are joined, heavy bins against light ones, until one partition into equal bins
   is left. This runs per block of components on the executors, whose bins are the items of the next
   level; only the last level, at most ``LAST`` bins, is balanced on the driver.
3. *Allocation.* Whole bins go, heaviest first, to the split furthest below its target.

Defined results: rows with a null or blank id form one component (they may belong together); ids without
any digit are their own normal form; with an empty table there are no rows; a split with share 0 gets none.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize, parallelism

BLOCK, BLOCK_BINS, BINS, LAST = 20_000, 256, 200, 20_000
UNKNOWN = "?"


def group_key(col: F.Column) -> F.Column:
    """Normal form of a group id: number and part number, without prefix, padding, marks and file ending."""
    s = F.lower(F.translate(col, "０１２３４５６７８９ＴＬＯ", "0123456789TLO"))
    s = F.regexp_replace(s, r"[\p{Cf}\p{Cc}\p{Z}\s\"'`“”„‘’«»]+", "")
    s = F.regexp_replace(s, r"\.(json|csv|txt)$", "")
    s = F.regexp_replace(s, r"[\p{Pd}_−/.:]+", "-")
    s = F.regexp_replace(s, r"^[#\[({<]+|[\])}>,;-]+$", "")
    s = F.regexp_replace(s, r"^-?(?:timeline|tl)-?", "")
    digits = F.translate(s, "oоl|", "0011")
    parts = r"^-?0*(\d+)(?:-0*(\d+))?$"
    number, part = F.regexp_extract(digits, parts, 1), F.regexp_extract(digits, parts, 2)
    return F.when(s.isNull() | (s == ""), UNKNOWN).when(number == "", F.concat(F.lit("="), s)).otherwise(F.concat(number, F.when(part != "", F.concat(F.lit("-"), part)).otherwise("")))


def spellings(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """``spelling, key, n_rows`` of every group id of the given (table, column), nulls included."""
    out = None
    for df, c in tables:
        one = df.select(F.col(c).cast("string").alias("spelling"))
        out = one if out is None else out.unionByName(one)
    per = out.groupBy("spelling").agg(F.count("*").alias("n_rows"))
    return per.withColumn("key", F.coalesce(group_key(F.col("spelling")), F.lit(UNKNOWN)))


def spelling_pairs(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """``spelling_a, spelling_b`` (a < b by code points) of every two spellings of one component."""
    s = spellings(tables).where(f"spelling is not null and key <> '{UNKNOWN}'")
    a, b = s.select("key", F.col("spelling").alias("spelling_a")), s.select("key", F.col("spelling").alias("spelling_b"))
    return a.join(b, "key").where(F.col("spelling_a") < F.col("spelling_b")).select("spelling_a", "spelling_b")


def largest_differencing(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each item: partitions into ``bins`` of nearly equal weight."""
    n = len(weights)
    if n == 0:
        return np.zeros(0, np.int64)
    left, right = [], []  # children of joined handles n, n + 1, ...
    heap = []
    tick = itertools.count()
    for i in np.argsort(weights, kind="stable")[::-1]:
        sums = np.zeros(bins)
        sums[0] = weights[i]
        hold = np.full(bins, -1, np.int64)
        hold[0] = i
        heap.append((-weights[i], next(tick), sums, hold))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s1, h1 = heapq.heappop(heap)
        _, _, s2, h2 = heapq.heappop(heap)
        sums, h2 = s1 + s2[::-1], h2[::-1]
        hold = np.where(h1 < 0, h2, h1)
        for k in np.nonzero((h1 >= 0) & (h2 >= 0))[0]:
            left.append(h1[k])
            right.append(h2[k])
            hold[k] = n + len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, hold = sums[order], hold[order]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), next(tick), sums, hold))
    out = np.zeros(n, np.int64)
    for k, root in enumerate(heap[0][3]):
        stack = [root] if root >= 0 else []
        while stack:
            h = stack.pop()
            if h < n:
                out[h] = k
            else:
                stack += [left[h - n], right[h - n]]
    return out


def allocate(weights: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The split of each bin: heaviest first, each to the split furthest below its target."""
    target = shares / max(shares.sum(), 1e-12) * weights.sum()
    have = np.zeros(len(shares))
    out = np.zeros(len(weights), np.int64)
    for i in np.argsort(-weights, kind="stable"):
        room = np.where(shares > 0, (target - have), -np.inf)
        k = int(np.argmax(room))
        out[i] = k
        have[k] += weights[i]
    return out


def _nodes(df: DataFrame, cols: tuple[str, ...]) -> F.Column:
    """The keys of a record in normal form, each with its column's name; without blank ones."""
    keys = F.array(*[F.when(group_key(F.col(c).cast("string")) != UNKNOWN, F.concat(F.lit(f"{c}:"), group_key(F.col(c).cast("string")))) for c in cols])
    return F.filter(keys, lambda k: k.isNotNull())


def connect(tables: list[tuple[DataFrame, tuple[str, ...]]], most_rounds: int = 100) -> DataFrame:
    """``node, component``: the component of every key (``column:normal form``) of the tables, named by its least key.

    Least labels travel along the links of records, and labels are replaced by their labels' labels, so that
    rounds grow with the logarithm of the longest chain. Each round is written to the shared folder. Columns of
    one name mean the same in every table.
    """
    links = None
    for df, cols in tables:
        one = df.select(_nodes(df, cols).alias("k")).where(F.size("k") > 0).select(F.col("k")[0].alias("a"), F.explode("k").alias("b")).distinct()
        links = one if links is None else links.unionByName(one)
    links = links.distinct()
    links = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        near = links.join(label, links["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        step = materialize(step, "step")
        jump = step.select(F.col("node").alias("n2"), F.col("new").alias("far"))
        moved = materialize(step.join(jump, F.col("new") == F.col("n2"), "left").select("node", "old", F.least("new", "far").alias("component")), "labels")
        label = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return label
    raise ValueError(f"keys were not connected after {most_rounds} rounds")


def assign_splits(tables: list[tuple[DataFrame, str]], targets: DataFrame) -> DataFrame:
    """``key, n_rows, split_name`` of every component; join records to it by ``group_key``."""
    return _balance(spellings(tables).groupBy("key").agg(F.sum("n_rows").alias("n_rows")), targets)


def assign_connected(tables: list[tuple[DataFrame, tuple[str, ...]]], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of records with several keys: ``key, n_rows, split_name``, and ``node, component`` of every key.

    Records without any key form one component.
    """
    nodes = connect(tables)
    first = None
    for df, cols in tables:
        one = df.select(F.coalesce(F.try_element_at(_nodes(df, cols), F.lit(1)), F.lit(UNKNOWN)).alias("node"))
        first = one if first is None else first.unionByName(one)
    per = first.groupBy("node").agg(F.count("*").alias("n_rows"))
    comp = per.join(nodes, "node", "left").groupBy(F.coalesce("component", F.lit(UNKNOWN)).alias("key")).agg(F.sum("n_rows").alias("n_rows"))
    return _balance(comp, targets), nodes


def _balance(comp: DataFrame, targets: DataFrame) -> DataFrame:
    spark = targets.sparkSession
    goal = [(r["split_name"], float(r["target_share"])) for r in targets.where("split_name is not null and target_share is not null").orderBy("split_name").collect()]
    level = materialize(comp, "components")
    item, links = level.select(F.col("key").alias("item"), F.col("n_rows").cast("double").alias("w")), []
    n = item.count()
    while n > LAST:
        blocks = math.ceil(n / BLOCK)
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item", kind="stable")
            pdf["bin"] = pdf["block"].astype(str) + "." + pd.Series(largest_differencing(pdf["w"].to_numpy(), BLOCK_BINS), index=pdf.index).astype(str)
            return pdf[["item", "w", "bin"]]

        packed = materialize(item.select("item", "w", block).groupBy("block").applyInPandas(pack, "item string, w double, bin string"), "bins")
        links.append(packed.select("item", "bin"))
        item = packed.groupBy("bin").agg(F.sum("w").alias("w")).withColumnRenamed("bin", "item")
        n = item.count()
    top = item.toPandas().sort_values("item", kind="stable")
    bins = largest_differencing(top["w"].to_numpy(), BINS)
    sums = np.bincount(bins, top["w"], BINS) if len(top) else np.zeros(BINS)
    part = allocate(sums, np.array([s for _, s in goal])) if goal else np.zeros(BINS, np.int64)
    rows = pd.DataFrame({"item": top["item"].astype(str), "split_name": [goal[part[b]][0] if goal else None for b in bins]})
    names = spark.createDataFrame(rows, "item string, split_name string")
    for step in reversed(links):
        names = step.join(names.withColumnRenamed("item", "bin"), "bin").select("item", "split_name")
    return level.join(names.withColumnRenamed("item", "key"), "key").select("key", "n_rows", "split_name")


def _salted(rec: DataFrame, assigned: DataFrame) -> DataFrame:
    """``record_id, group_id, split_name`` of records with a ``key``. A component may hold a third of all rows:

    the rows of those above a quarter of a task's share (at most 4 per task) are spread over all tasks.
    """
    tasks = parallelism(assigned.sparkSession)
    total = assigned.agg(F.sum("n_rows")).collect()[0][0] or 0
    hot = [r["key"] for r in assigned.where(F.col("n_rows") > total / (4 * tasks)).select("key").collect()] if total > 4 * tasks else []
    salt = lambda own: F.when(F.col("key").isin(hot), own).otherwise(0) if hot else F.lit(0)
    to = assigned.select("key", "split_name", F.explode(F.when(F.col("key").isin(hot), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))).alias("salt"))
    rec = rec.withColumn("salt", salt(F.pmod(F.xxhash64("record_id"), F.lit(tasks)).cast("int")))
    return rec.join(to, ["key", "salt"], "left").select("record_id", "group_id", "split_name")


def split_records(df: DataFrame, id_col: str, group_col: str, assigned: DataFrame) -> DataFrame:
    """``record_id, group_id, split_name`` of every row."""
    rec = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(group_col).alias("group_id"), F.coalesce(group_key(F.col(group_col)), F.lit(UNKNOWN)).alias("key"))
    return _salted(rec, assigned)


def split_connected(df: DataFrame, id_col: str, cols: tuple[str, ...], assigned: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``record_id, group_id, split_name`` of every row of a table with several keys; ``group_id`` is its first key.

    Keys are given their splits first, and the records then joined to them as in ``split_records``.
    """
    comps, nodes = assigned
    by_node = nodes.join(comps.withColumnRenamed("key", "component"), "component").select(F.col("node").alias("key"), "n_rows", "split_name")
    by_node = by_node.unionByName(comps.where(F.col("key") == UNKNOWN).select("key", "n_rows", "split_name"))
    own = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.coalesce(F.try_element_at(_nodes(df, cols), F.lit(1)), F.lit(UNKNOWN)).alias("key"))
    size = own.groupBy("key").agg(F.count("*").alias("here"))  # hot keys, not the keys of hot components
    by_node = materialize(by_node.join(size, "key").select("key", F.col("here").alias("n_rows"), "split_name"), "keys")
    return _salted(own.withColumn("group_id", F.col("key")), by_node)


def split_report(tables: list[tuple[DataFrame, str]], targets: DataFrame) -> DataFrame:
    """Per split: target and reached share, rows and components."""
    got = assign_splits(tables, targets).groupBy("split_name").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_groups"))
    total = got.agg(F.sum("n_rows").alias("total"))
    return targets.join(got, "split_name", "left").crossJoin(F.broadcast(total)).select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce("n_rows", F.lit(0)) / F.col("total"), 6).alias("reached_share"))
