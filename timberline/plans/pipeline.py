"""The end-to-end flows: classification, summaries with retrieved examples, baselines, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import text as T
from timberline.functions import vectors as V
from timberline.models import interfaces as M
from timberline.operators import context, metrics, profile, prompts, retrieval
from timberline.session import materialize


@dataclass(frozen=True)
class Config:
    """Settings of a run; values are checked when it is made."""

    mode: str = "hybrid"
    alpha: float = 0.5
    context_window: int = 2
    use_context: bool = True
    cross_validate: bool = False
    dim: int = 64
    label_tokens: int = 20
    label_temperature: float = 0.01
    summary_tokens: int = 400
    summary_temperature: float = 0.1
    baseline_tokens: int = 300

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", retrieval.check_mode(self.mode))
        retrieval.check_alpha(self.alpha)


def embed_posts(posts: DataFrame, make: Callable[[], M.Embedder] = M.HashEmbedder) -> DataFrame:
    return posts.withColumn("semantic_vector", M.embed_udf(make)("post"))


def classify_spans(spans: DataFrame, posts: DataFrame, config: Config = Config(), make: Callable[[], M.Generator] = M.EchoGenerator) -> DataFrame:
    """The spans with ``predicted_abcd_key``; written once, so no prediction is made twice."""
    keys = ["timeline_id", "post_index"]
    x = spans.join(posts.select(*keys, "post"), keys)
    prompt = prompts.classification(F.col("post"), F.col("text"), F.col("polarity"), config.use_context)
    raw = M.generate_udf(make, config.label_tokens, config.label_temperature, "labels")(prompt)
    return materialize(x.withColumn("predicted_abcd_key", T.parse_label(raw)).drop("post"), "labels")


def profiles(posts: DataFrame, spans: DataFrame, config: Config = Config(), predicted: bool = False) -> DataFrame:
    key = "predicted_abcd_key" if predicted else "gold_abcd_key"
    keys = ["timeline_id", "post_index"]
    p = profile.structural(posts, profile.presence(spans, keys, key, "polarity"), keys)
    return p.withColumn("structural_vector", F.col("unit_vector")).withColumn("hybrid_vector", V.weighted_concat(F.col("unit_vector"), F.col("semantic_vector"), config.alpha))


def summarize(rows: DataFrame, spans: DataFrame, config: Config = Config(), make: Callable[[], M.Generator] = M.EchoGenerator, predicted: bool = False) -> DataFrame:
    """Zero- and one-shot summaries of every post with a reference summary, with the example retrieved.

    ``rows`` has post_key (unique), timeline_id, post_index, post, post_summary, wellbeing, before,
    after and the vectors. With ``cross_validate`` posts without any candidate of another timeline are left
    out, else their one-shot side is null.
    """
    shown = "predicted_abcd_key" if predicted else "gold_abcd_key"
    has = F.length("post_summary") > 0
    found = retrieval.retrieve(rows, "post_key", "timeline_id", has, has, ("structural_vector", 14), ("semantic_vector", config.dim), config.mode, config.alpha, 1)
    entry = lambda k: F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "polarity", F.col(k).alias("abcd_key"), "text"))), lambda s: F.struct(s["polarity"].alias("polarity"), s["abcd_key"].alias("abcd_key"), s["text"].alias("text")))
    per = spans.groupBy("timeline_id", "post_index").agg(entry(shown).alias("spans"), entry("gold_abcd_key").alias("gold_spans"))
    none = F.array().cast("array<struct<polarity:string,abcd_key:string,text:string>>")
    x = rows.where(has).join(per, ["timeline_id", "post_index"], "left").withColumns({"spans": F.coalesce("spans", none), "gold_spans": F.coalesce("gold_spans", none)})
    e = x.select(F.col("post_key").alias("candidate_id"), F.col("timeline_id").alias("retrieved_timeline"), F.col("post_index").alias("retrieved_post_index"), F.col("post").alias("e_post"), F.col("gold_spans").alias("e_spans"), F.col("wellbeing").alias("e_wb"), F.col("post_summary").alias("e_summary"))
    near = found.select(F.col("query_id").alias("post_key"), "candidate_id", F.col("similarity").alias("retrieval_similarity")).join(e, "candidate_id")
    t = x.join(near, "post_key", "inner" if config.cross_validate else "left")
    ctx = prompts.context_block(F.col("before"), F.col("after")) if config.use_context else None
    block = prompts.evidence_block(F.col("spans"))
    zero = prompts.zero_shot(F.col("post"), block, F.col("wellbeing"), ctx)
    one = prompts.one_shot(F.col("post"), block, F.col("wellbeing"), F.col("e_post"), prompts.evidence_block(F.col("e_spans")), F.col("e_wb"), F.col("e_summary"), ctx)
    gen = M.generate_udf(make, config.summary_tokens, config.summary_temperature, "summaries")
    out = t.select("timeline_id", "post_index", "wellbeing", F.col("post_summary").alias("gold_summary"), F.size("spans").alias("n_evidence_spans"), F.transform("spans", lambda s: s["text"]).alias("evidence_texts"), gen(zero).alias("zero_shot_summary"), gen(one).alias("one_shot_summary"), "retrieved_timeline", "retrieved_post_index", "retrieval_similarity")
    return materialize(out, "summaries")


def baseline_posts(posts: DataFrame, make: Callable[[], M.Generator] = M.EchoGenerator, tokens: int = 300, json_mode: bool = False, whole_timeline: bool = False) -> DataFrame:
    """The posts with ``baseline_summary``: the text after the marker, or the summary field of a JSON answer."""
    answer = M.generate_udf(make, tokens, 0.1, "baseline")(prompts.baseline(F.coalesce("post", F.lit("")), whole_timeline, json_mode))
    out = posts.withColumn("__a", answer)
    marker = prompts.TIMELINE_MARKER if whole_timeline else prompts.POST_MARKER
    tail = T.json_field(F.col("__a"), "summary") if json_mode else F.coalesce(T.marker_tail(F.col("__a"), marker), F.col("__a"))
    return out.withColumn("baseline_summary", tail).drop("__a")


def timeline_texts(posts: DataFrame, order: str = "row_id") -> DataFrame:
    """``timeline_id, n_posts, first_row, text``: the posts of each timeline joined by a blank line, in row order.

    ``first_row`` orders the timelines as they first appear.
    """
    item = F.struct(F.col(order).alias("o"), F.coalesce("post", F.lit("")).alias("t"))
    return posts.groupBy("timeline_id").agg(F.count("*").alias("n_posts"), F.min(order).alias("first_row"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("text"))


def evaluate_labels(spans: DataFrame) -> dict[str, DataFrame]:
    conf = metrics.confusion(spans, "gold", "predicted", "polarity")
    flat = conf.groupBy("gold", "predicted").agg(F.sum("n").alias("n"))
    return {"accuracy": metrics.accuracy_by_group(conf), "macro_f1": metrics.macro_f1(flat), "report": metrics.classification_report(flat)}


def evaluate_summaries(results: DataFrame, key: str, mode: str, scorer: Callable[[], M.PairScorer] | None = None) -> DataFrame:
    """Corpus means of one mode over results whose reference and summary are not empty; without a scorer by the stub."""
    col = f"{mode}_summary"
    usable = results.where((F.length("gold_summary") > 0) & (F.length(col) > 0))
    evidence = "evidence_texts" if "evidence_texts" in results.columns else None
    per_row = metrics.scored_pair_metrics(usable, key, col, "gold_summary", evidence, scorer) if scorer else metrics.pair_metrics(usable, key, col, "gold_summary", evidence)
    return metrics.corpus_means(per_row)


def compare_modes(results: DataFrame, key: str, scorer: Callable[[], M.PairScorer] | None = None) -> DataFrame:
    return metrics.mode_delta(evaluate_summaries(results, key, "zero_shot", scorer), evaluate_summaries(results, key, "one_shot", scorer))


def evaluate_timelines(pairs: DataFrame) -> DataFrame:
    """Consistency and contradiction of timeline summaries (``timeline_id, predicted_summary, gold_summary``)."""
    return metrics.corpus_means(metrics.pair_metrics(pairs, "timeline_id", "predicted_summary", "gold_summary")).select("n_evaluated", "consistency", "contradiction")


def prepare(posts: DataFrame, config: Config = Config()) -> DataFrame:
    return context.attach_context(posts, config.context_window)
