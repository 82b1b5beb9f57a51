"""Classification and sentence-pair metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import text as T
from timberline.models import interfaces as M
from timberline.schema import ABCD_KEYS, UNKNOWN
from timberline.session import materialize

# -- classification


def confusion(rows: DataFrame, gold: str, predicted: str, group: str | None = None) -> DataFrame:
    """``gold, predicted[, grp], n``: the small table all classification metrics come from."""
    cols = [F.col(gold).alias("gold"), F.col(predicted).alias("predicted"), *([F.col(group).alias("grp")] if group else [])]
    return rows.select(*cols).groupBy(*(["gold", "predicted"] + (["grp"] if group else []))).agg(F.count("*").alias("n"))


def accuracy_by_group(conf: DataFrame) -> DataFrame:
    """Overall ('all') and per group: ``grp, n, n_correct, n_unknown, accuracy``. Null predictions are wrong."""
    hit = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    unknown = F.sum(F.when(F.col("predicted") == UNKNOWN, F.col("n")).otherwise(0))
    aggs = [F.sum("n").alias("n"), hit.alias("n_correct"), unknown.alias("n_unknown"), F.grouping("grp").alias("level")]
    out = conf.withColumn("grp", F.coalesce("grp", F.lit(""))).rollup("grp").agg(*aggs)
    return out.select(F.when(F.col("level") == 1, "all").otherwise(F.col("grp")).alias("grp"), "n", "n_correct", "n_unknown", _six(F.col("n_correct") / F.col("n")).alias("accuracy"))


def _six(c: Column) -> Column:
    """Six digits; exact ties go up whichever way the sum was rounded."""
    return F.round(c + 1e-10, 6)


def per_label(conf: DataFrame, labels: tuple[str, ...] = ABCD_KEYS) -> DataFrame:
    """``label, tp, fp, fn, precision, recall, f1, support`` of each fixed label, absent ones with zeros."""
    dim = F.explode(F.array(*map(F.lit, labels)))
    x = conf.select("gold", "predicted", "n", dim.alias("label"))
    gold, pred = F.col("gold").eqNullSafe(F.col("label")), F.col("predicted").eqNullSafe(F.col("label"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    got = x.groupBy("label").agg(count(gold & pred).alias("tp"), count(~gold & pred).alias("fp"), count(gold & ~pred).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.select("label", "tp", "fp", "fn", _six(ratio(tp, tp + fp)).alias("precision"), _six(ratio(tp, tp + fn)).alias("recall"), _six(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), (tp + fn).alias("support"))


def macro_f1(conf: DataFrame, labels: tuple[str, ...] = ABCD_KEYS) -> DataFrame:
    """One row ``macro_f1``: mean over all fixed labels; an absent label counts as 0."""
    p = per_label(conf, labels)
    exact = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return p.agg(_six(F.avg(exact)).alias("macro_f1"))


def classification_report(conf: DataFrame, labels: tuple[str, ...] = ABCD_KEYS) -> DataFrame:
    """Long form: a row per label, 'macro avg', 'weighted avg', and what stands for the whole.

    That is 'accuracy' where the labels are all values that occur, else 'micro avg' over the labels' own counts.
    """
    p = per_label(conf, labels)
    rows = p.select("label", "precision", "recall", "f1", "support")
    macro = p.agg(_six(F.avg("precision")).alias("precision"), _six(F.avg("recall")).alias("recall"), _six(F.avg("f1")).alias("f1"), F.sum("support").alias("support"))
    mean = lambda c: _six(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))).alias(c)
    weighted = p.agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support"))
    right = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")
    strange = ~(F.coalesce(F.col("gold").isin(*labels), F.lit(False)) & F.coalesce(F.col("predicted").isin(*labels), F.lit(False)))
    whole = conf.agg(_six(right).alias("a"), F.sum("n").alias("n"), F.coalesce(F.max(strange), F.lit(False)).alias("micro"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    share = lambda a, b: _six(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    micro = p.agg(share(tp, tp + fp).alias("p"), share(tp, tp + fn).alias("r"), share(2 * tp, 2 * tp + fp + fn).alias("f"), F.sum("support").alias("s")).crossJoin(F.broadcast(whole))
    on = F.col("micro")
    third = micro.select(F.when(on, "micro avg").otherwise("accuracy").alias("label"), F.when(on, F.col("p")).alias("precision"), F.when(on, F.col("r")).alias("recall"), F.when(on, F.col("f")).otherwise(F.col("a")).alias("f1"), F.when(on, F.col("s")).otherwise(F.col("n")).alias("support"))
    out = rows
    for name, df in (("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(df.select(F.lit(name).alias("label"), "precision", "recall", "f1", "support"))
    return out.unionByName(third)


def running(rows: DataFrame, order: str, every: int, **values: Column) -> DataFrame:
    """Means of the given ``values`` over all rows so far, at every ``every``-th row: ``position`` and a column per value.

    Rows are cut into ranges of ``order`` of about equal size, in which windows run; a second level adds what
    stands before each range. Values are worked out once. Ties of ``order`` are not told apart.
    """
    names = list(values)
    x = rows.select(F.col(order).alias("o"), *[v.cast("double").alias(k) for k, v in values.items()])
    x = materialize(x.repartitionByRange("o").withColumn("c", F.spark_partition_id()), "ranges")
    per = x.groupBy("c").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names])
    w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = per.select("c", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), *[F.coalesce(F.sum(k).over(w), F.lit(0.0)).alias(f"{k}0") for k in names])
    inner = Window.partitionBy("c").orderBy("o")
    y = x.join(before, "c")
    y = y.select((F.col("n0") + F.row_number().over(inner)).alias("position"), *[(F.col(f"{k}0") + F.coalesce(F.sum(k).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).alias(k) for k in names])
    return y.where(F.col("position") % every == 0).select("position", *[_six(F.col(k) / F.col("position")).alias(k) for k in names])


# -- sentence pairs


def stub_overlap(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' distinct lower-case words that the premise has. Plumbing only, no quality."""
    h, p = F.array_distinct(F.split(F.lower(hypothesis), " ")), F.array_distinct(F.split(F.lower(premise), " "))
    return F.size(F.array_intersect(h, p)) / F.size(h)


def stub_entailment(premise: Column, hypothesis: Column) -> Column:
    return stub_overlap(premise, hypothesis)


def stub_contradiction(premise: Column, hypothesis: Column) -> Column:
    return (1 - stub_overlap(premise, hypothesis)) * 0.5


def pair_metrics(rows: DataFrame, key: str, predicted: str, gold: str, evidence: str | None = None, contradiction=stub_contradiction, entailment=stub_entailment) -> DataFrame:
    """Per row ``cs`` (consistency), ``ct`` (contradiction), ``ea`` (evidence alignment; null without evidence).

    Sentences of a row are paired inside the row, with higher-order functions: no join, no shuffle.
    Without sentences on one side: 0, 1 and 0.
    """
    s, g = T.sentences(F.col(predicted)), T.sentences(F.col(gold))
    h = F.filter(F.coalesce(F.col(evidence), F.array().cast("array<string>")), lambda x: x.isNotNull()) if evidence else F.array().cast("array<string>")
    x = rows.select(F.col(key), s.alias("s"), g.alias("g"), h.alias("h"))
    per_s = F.transform("s", lambda a: F.transform("g", lambda b: contradiction(b, a)))
    per_h = F.transform("h", lambda b: F.array_max(F.transform("s", lambda a: entailment(b, a))))
    x = x.select(key, "s", "g", "h", per_s.alias("m"), per_h.alias("e"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v, lambda t: F.try_divide(t, F.size(c)))
    none = (F.size("s") == 0) | (F.size("g") == 0)
    flat = F.flatten("m")
    return x.select(
        key,
        F.when(none, 0.0).otherwise(1 - mean(flat)).alias("cs"),
        F.when(none, 1.0).otherwise(mean(F.transform("m", lambda r: F.array_max(r)))).alias("ct"),
        F.when(none, 0.0).when(F.size("h") > 0, mean(F.col("e"))).alias("ea"),
    )


def scored_pair_metrics(rows: DataFrame, key: str, predicted: str, gold: str, evidence: str | None, scorer: Callable[[], M.PairScorer]) -> DataFrame:
    """``pair_metrics`` by a backend's scores: each distinct pair of sentences is scored once."""
    h = F.filter(F.coalesce(F.col(evidence), F.array().cast("array<string>")), lambda x: x.isNotNull()) if evidence else F.array().cast("array<string>")
    x = materialize(rows.select(F.col(key), T.sentences(F.col(predicted)).alias("s"), T.sentences(F.col(gold)).alias("g"), h.alias("h"), F.monotonically_increasing_id().alias("_row")), "sentences")

    def pairs(kind: str, outer: str, premise: str, hypothesis: str) -> DataFrame:
        inner = "g" if outer == "s" else "s"
        each = x.select("_row", F.posexplode(outer).alias("i", outer), F.col(inner).alias("rest"))
        return each.select("_row", F.lit(kind).alias("kind"), "i", outer, F.explode("rest").alias(inner)).select("_row", "kind", "i", F.col(premise).alias("premise"), F.col(hypothesis).alias("hypothesis"))

    every = pairs("contradiction", "s", "g", "s").unionByName(pairs("entailment", "h", "h", "s"))
    scores = every.select("premise", "hypothesis").distinct().select("premise", "hypothesis", M.score_udf(scorer)("premise", "hypothesis").alias("score"))
    value = F.when(F.col("kind") == "entailment", F.col("score.entailment")).otherwise(F.col("score.contradiction"))
    per = every.join(scores, ["premise", "hypothesis"]).groupBy("_row", "kind", "i").agg(F.max(value).alias("most"), F.sum(value).alias("total"), F.count("*").alias("n"))
    is_c = F.col("kind") == "contradiction"
    both = per.groupBy("_row").agg(F.try_divide(F.sum(F.when(is_c, F.col("total"))), F.sum(F.when(is_c, F.col("n")))).alias("c"), F.avg(F.when(is_c, F.col("most"))).alias("m"), F.avg(F.when(~is_c, F.col("most"))).alias("e"))
    none = (F.size("s") == 0) | (F.size("g") == 0)
    return x.join(both, "_row", "left").select(
        key,
        F.when(none, 0.0).otherwise(1 - F.col("c")).alias("cs"),
        F.when(none, 1.0).otherwise(F.col("m")).alias("ct"),
        F.when(none, 0.0).when(F.size("h") > 0, F.col("e")).alias("ea"),
    )


def corpus_means(per_row: DataFrame) -> DataFrame:
    """One row: means of cs and ct, mean of ea over rows that have one."""
    return per_row.agg(F.count("*").alias("n_evaluated"), _six(F.avg("cs")).alias("consistency"), _six(F.avg("ct")).alias("contradiction"), _six(F.avg(F.nanvl("ea", F.lit(None)))).alias("evidence_alignment"))


def mode_delta(zero: DataFrame, one: DataFrame) -> DataFrame:
    """``metric, zero_shot, one_shot, delta, better`` of the corpus means of two modes."""
    names = ["consistency", "contradiction", "evidence_alignment"]
    long = lambda df, c: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(c)) for n in names])).alias("x")).select("x.*")
    j = long(zero, "zero_shot").join(long(one, "one_shot"), "metric", "full_outer")
    d = F.col("one_shot") - F.col("zero_shot")
    better = F.when(F.col("metric") == "contradiction", d < 0).otherwise(d > 0)
    return j.select("metric", "zero_shot", "one_shot", _six(d).alias("delta"), F.when(d.isNull(), None).when(better, "+").otherwise("-").alias("better"))
