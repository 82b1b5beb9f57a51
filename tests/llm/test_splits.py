import numpy as np
from pyspark.sql import functions as F

from timberline.llm import splits


def keys(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(splits.group_key(F.col("s"))).collect()]


def test_spellings_of_one_id(spark):
    same = ["TL-0000510", "tl-0000510", " TL-0000510", "TL-0000510 ", "TL0000510", "tl0000510", "TL_0000510", "TL--0000510", "TL‑0000510", "TL-​0000510", "T L-0000510", "TL-O000510", "TL-510", "#0000510", "0000510", "timeline 0000510", '"TL-0000510"', "TL-0000510.json", "tl-0000510.json"]
    assert set(keys(spark, same)) == {"510"}
    part = ["TL-0000510-2", "tl0000510-2", "TL_0000510_2", "TL-510-2", "timeline 0000510-2", "tl-0000510-2.json"]
    assert set(keys(spark, part)) == {"510-2"}
    assert len(set(keys(spark, ["TL-0000510", "TL-0000510-2", "TL-0000051", "TL-0005100", "group a", "group b"]))) == 6
    assert keys(spark, [None, "", "  "]) == ["?"] * 3


def test_largest_differencing_balances():
    rng = np.random.default_rng(1)
    w = rng.pareto(1.5, 5000) + 1
    w[0] = w.sum() / 50
    bins = splits.largest_differencing(w, 40)
    sums = np.bincount(bins, w, 40)
    assert np.isclose(sums.sum(), w.sum())
    small = np.sort(sums)[: -int((w > sums.mean()).sum()) or None]  # a bin of one heavy item is as heavy as that
    assert small.max() - small.min() <= 0.005 * sums.mean()
    assert len(splits.largest_differencing(np.zeros(0), 4)) == 0 and list(splits.largest_differencing(np.array([3.0]), 4)) == [0]
    got = np.bincount(splits.allocate(np.ones(200), np.array([0.8, 0.1, 0.1])), minlength=3)
    assert list(got) == [160, 20, 20]


def test_records_of_one_group_stay_together(spark, monkeypatch):
    monkeypatch.setattr(splits, "LAST", 300)
    monkeypatch.setattr(splits, "BLOCK", 200)
    monkeypatch.setattr(splits, "BLOCK_BINS", 32)
    rng = np.random.default_rng(2)
    ids = [f"TL-{int(i):07d}" if rng.random() < 0.7 else f"tl{int(i):07d}" for i in rng.zipf(1.6, 6000) % 900]
    a = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ids)] + [(6000, None, "x"), (6001, "", "x")], "rid bigint, timeline_id string, split_name string")
    b = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(ids[:2000])], "sid bigint, timeline_id string")
    goal = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0)], "split_name string, target_share double")
    tables = [(a, "timeline_id"), (b, "timeline_id")]
    to = splits.assign_splits(tables, goal)
    rows = splits.split_records(a, "rid", "timeline_id", to).unionByName(splits.split_records(b, "sid", "timeline_id", to)).withColumn("k", F.coalesce(splits.group_key(F.col("group_id")), F.lit("?")))
    assert rows.count() == 8002 and rows.where("split_name is null").count() == 0
    assert rows.groupBy("k").agg(F.count_distinct("split_name").alias("n")).where("n > 1").count() == 0
    big = rows.groupBy("k").count().agg(F.max("count")).collect()[0][0] / 8002
    for r in splits.split_report(tables, goal).collect():
        assert abs(r["reached_share"] - r["target_share"]) < max(0.01, big)
    assert splits.assign_splits([(a.where("false"), "timeline_id")], goal).count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([(t,) for t in ("TL-01", "tl1", "TL-01", "TL-2", None, "")], "timeline_id string")
    assert [tuple(r) for r in splits.spelling_pairs([(df, "timeline_id")]).collect()] == [("TL-01", "tl1")]


def test_records_with_several_keys(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for g in range(120):  # planted groups: chains through authors, sources and entities
        size = 2000 if g == 0 else int(rng.integers(1, 12))
        for i in range(size):
            j = i % 40
            author = f"author-{g}-{j // 2}" if i % 3 else (f"AUTHOR_{g}_{j // 2}" if i % 2 else None)
            rows.append((len(rows), author, f"s{g}x{(j + 1) // 2}", f"e{g}y" if i == 0 else None, "x"))
            want.append(g)
    rows += [(len(rows) + i, None, " ", None, "x") for i in range(7)]
    want += [-1] * 7
    df = spark.createDataFrame(rows, "id bigint, author string, source string, entity string, key string").repartition(4)
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split_name string, target_share double")
    cols = ("author", "source", "entity")
    # brute force over shared keys
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    spelled = sorted({v for r in rows for v in r[1:4] if v})
    norm = dict(zip(spelled, keys(spark, spelled)))
    assert norm["AUTHOR_0_0"] == norm["author-0-0"] != norm["author-0-1"]
    seen = {}
    for r in rows:
        for c, v in zip(cols, r[1:4]):
            if v and v.strip():
                parent[root(r[0])] = root(seen.setdefault((c, norm[v]), r[0]))
    assigned = splits.assign_connected([(df, cols)], targets)
    got = {r["record_id"]: r["split_name"] for r in splits.split_connected(df, "id", cols, assigned).collect()}
    assert len(got) == len(rows) and set(got.values()) == {"train", "test"}
    by = {}
    for i in range(len(rows)):
        by.setdefault(root(i) if want[i] >= 0 else "none", set()).add(got[i])
    assert all(len(v) == 1 for v in by.values()) and assigned[0].count() == len(by)
    assert sum(r["n_rows"] for r in assigned[0].collect()) == len(rows)
    empty = splits.assign_connected([(df.where("false"), cols)], targets)
    assert empty[0].count() == 0 and splits.split_connected(df.where("false"), "id", cols, empty).count() == 0


def test_long_chain_of_keys(spark):
    rows = [(i, f"a{i}", f"b{i + 1}" if i % 2 else f"b{i}") for i in range(60)] + [(100 + i, f"a{i}", f"b{i - 1}" if i % 2 else f"b{i + 1}") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    got = splits.connect([(df, ("a", "b"))]).collect()
    nodes, edges = {r["node"]: r["component"] for r in got}, [(f"a:={r[1]}", f"b:={r[2]}") for r in rows]
    assert all(nodes[x] == nodes[y] for x, y in edges if x in nodes and y in nodes)
