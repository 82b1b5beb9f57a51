"""The engine's own operators as queries over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import schema as S
from timberline.functions import text as T
from timberline.functions import vectors as V
from timberline.operators import context, extract, metrics, profile, prompts, retrieval, submission
from timberline.plans import pipeline
from timberline.session import table

KEYS = ["timeline_id", "post_index"]
_SEM, _STR = ("semantic_vector", 64), ("structural_vector", 14)


def r6(c: Column | str) -> Column:
    """Six digits; the small addend settles exact ties whichever way the sum was rounded."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6)


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts without repeats: of rows with one timeline and index the last one sent."""
    p = table(spark, d, "post_data").where("timeline_id is not null and post_index is not null")
    return extract.latest(p.select(*KEYS, "row_id", "post_id", "post", "post_summary", "well_being_score"), KEYS, "row_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_span")


# -- retrieval


def _every_100th(c: str) -> Column:
    """The stated query set of searches: rows whose id is divisible by 100, against all rows."""
    return F.col(c) % 100 == 0


def _knn(spark: SparkSession, d: str, mode: str, k: int, **more) -> DataFrame:
    p = table(spark, d, "post_profile")
    got = retrieval.retrieve(p, "profile_id", "timeline_id", _every_100th("profile_id"), F.coalesce("is_annotated", F.lit(False)), _STR, _SEM, mode, k=k, **more)
    return got.select("query_id", "candidate_id", "rank", r6("similarity").alias("similarity"))


def knn_semantic_top1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = retrieval.retrieve(e, "vec_id", "label", _every_100th("vec_id"), F.lit(True), None, ("embedding", 64), "semantic")
    return got.select("query_id", "candidate_id", r6("similarity").alias("similarity"))


def knn_semantic_top5(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "semantic", 5)


def knn_same_group_allowed(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "semantic", 3, exclude_group=False)


def knn_structural(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "structural", 1)


def knn_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "hybrid", 3, alpha=0.25)


def knn_hybrid_concat(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "hybrid_concat", 3, alpha=0.25)


def fold_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Leave one timeline out: per fold its queries and their mean similarity to the best example outside.

    As in the SQL, the queries are the query set of the searches (``profile_id % 100 == 0``), about 1 % of the
    targets: ``n_target`` counts queries, and a fold without one has no row.
    """
    p = table(spark, d, "post_profile").select("profile_id", F.coalesce("timeline_id", F.lit("")).alias("fold"))
    top = _knn(spark, d, "hybrid", 1)
    return top.join(p, F.col("query_id") == F.col("profile_id")).groupBy("fold").agg(F.count("*").alias("n_target"), r6(F.avg("similarity")).alias("mean_similarity"))


def pairwise_similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.pairwise_stats(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


def weighted_concat(spark: SparkSession, d: str) -> DataFrame:
    """Stored hybrid vectors against the weighted concatenation of their parts."""
    p = table(spark, d, "post_profile").where(V.usable(F.col("semantic_vector"), 64) & V.usable(F.col("structural_vector"), 14) & V.usable(F.col("hybrid_vector"), 78))
    want = V.weighted_concat(F.col("structural_vector"), F.col("semantic_vector"), 0.5)
    gap = F.array_max(F.zip_with("hybrid_vector", want, lambda a, b: F.abs(a - b)))
    return p.select("profile_id", F.round(gap, 5).alias("gap"), r6(V.norm(F.col("hybrid_vector"))).alias("norm"), r6(V.cosine(F.col("hybrid_vector"), want)).alias("cosine"))


# -- context and grouping


def _context(spark: SparkSession, d: str, w: int) -> DataFrame:
    p = context.attach_context(table(spark, d, "post_data").select("row_id", *KEYS, "post"), w)
    return p.select("row_id", F.size("before").alias("n_before"), F.size("after").alias("n_after"), F.array_join(F.col("before.post_text"), "|").alias("before_text"), F.array_join(F.col("after.post_text"), "|").alias("after_text"))


def context_w0(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, 0)


def context_w1(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, 1)


def context_w2(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, 2)


def context_format(spark: SparkSession, d: str) -> DataFrame:
    p = context.attach_context(table(spark, d, "post_data").select("row_id", *KEYS, "post"), 1)
    return p.select("row_id", prompts.context_block(F.col("before"), F.col("after")).alias("block"))


def context_positions(spark: SparkSession, d: str) -> DataFrame:
    """The posts around each annotated post, with index and position."""
    raw = table(spark, d, "post_data").select("row_id", *KEYS, "post", "post_summary", "well_being_score")
    marked = extract.annotated(F.nullif("well_being_score", F.lit(S.NONE)), F.nullif("post_summary", F.lit(S.NONE)))
    p = context.attach_context(raw, 2).where(marked)
    return p.select("row_id", F.posexplode(context.positioned(F.col("before"), F.col("after"))).alias("pos", "c")).select("row_id", "pos", "c.post_index", "c.position", F.length("c.post_text").alias("n_chars"))


def timeline_texts(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.timeline_texts(table(spark, d, "post_data"))


def timeline_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Both baseline prompts of each timeline."""
    t = pipeline.timeline_texts(table(spark, d, "post_data"))
    return t.select("timeline_id", prompts.baseline(F.col("text"), True).alias("official"), prompts.baseline(F.col("text"), True, True).alias("blue"))


def timeline_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids over three tables, with the tables each occurs in."""
    parts = [table(spark, d, t).select("timeline_id", F.lit(i).alias("t")) for i, t in enumerate(("timeline_data", "post_data", "task_c_baseline"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("timeline_id is not null").groupBy("timeline_id").agg(F.count_distinct("t").alias("n_tables"), F.count("*").alias("n_rows"))


def load_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "post_data")
    wb = F.when(F.col("well_being_score") != S.NONE, F.col("well_being_score"))
    summary = F.when(F.col("post_summary") != S.NONE, F.col("post_summary"))
    return p.agg(F.count("*").alias("n_posts"), F.count_distinct("timeline_id").alias("n_timelines"), F.count_if(extract.annotated(wb, summary)).alias("n_annotated"), F.count_if(F.length(F.coalesce("post", F.lit(""))) == 0).alias("n_empty"))


# -- profiles


def _presence(spark: SparkSession, d: str) -> DataFrame:
    return profile.presence(_spans(spark, d).where("timeline_id is not null and post_index is not null"), KEYS, "gold_abcd_key", "polarity")


def presence_profile(spark: SparkSession, d: str) -> DataFrame:
    return _presence(spark, d).select(*KEYS, F.array_join(F.transform("presence", lambda x: x.cast("int").cast("string")), "").alias("dims"), "n_spans", r6("adaptive_ratio").alias("adaptive_ratio"))


def _structural(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "post_profile").select("profile_id", *KEYS, "wellbeing")
    return profile.structural(p, _presence(spark, d), KEYS)


def structural_vectors(spark: SparkSession, d: str) -> DataFrame:
    x = _structural(spark, d)
    return x.select("profile_id", F.array_join(F.transform(F.slice("raw_vector", 1, 12), lambda v: v.cast("int").cast("string")), "").alias("dims"), r6(F.element_at("raw_vector", 13)).alias("wellbeing_dim"), r6(F.element_at("raw_vector", 14)).alias("ratio_dim"), r6(F.try_element_at("unit_vector", F.lit(13))).alias("wellbeing_unit"), r6(F.try_element_at("unit_vector", F.lit(14))).alias("ratio_unit"))


def profile_analysis(spark: SparkSession, d: str) -> DataFrame:
    return profile.analyse(_structural(spark, d))


# -- classification metrics


def _confusion(spark: SparkSession, d: str, group: bool = False) -> DataFrame:
    s = _spans(spark, d).withColumn("p", T.parse_label(F.col("predicted_abcd_key"), strict=True))
    return metrics.confusion(s, "gold_abcd_key", "p", "polarity" if group else None)


def accuracy_by_polarity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy_by_group(_confusion(spark, d, True))


def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(_confusion(spark, d))


def macro_f1_orders(spark: SparkSession, d: str) -> DataFrame:
    """Fixed labels with an absent one, over another table."""
    p = F.col("o_totalprice")
    o = table(spark, d, "orders").withColumn("p", F.when(p < 100000, "1-URGENT").when(p < 200000, "2-HIGH").when(p < 300000, "3-MEDIUM").when(p < 400000, "5-LOW").otherwise(S.UNKNOWN))
    return metrics.macro_f1(metrics.confusion(o, "o_orderpriority", "p"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-ABSENT"))


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.classification_report(_confusion(spark, d))


def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    hit = F.coalesce((F.col("gold_abcd_key") == F.col("predicted_abcd_key")).cast("int"), F.lit(0))
    return metrics.running(_spans(spark, d), "span_id", 25, running=hit)


# -- sentence pairs


def _pair(spark: SparkSession, d: str, mode: str) -> DataFrame:
    col = f"{mode}_summary"
    r = table(spark, d, "task_b_results").where((F.length("gold_summary") > 0) & (F.length(col) > 0))
    return metrics.pair_metrics(r, "result_id", col, "gold_summary", "evidence_texts")


def pair_metrics_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    return _pair(spark, d, "zero_shot").select("result_id", *[r6(c).alias(c) for c in ("cs", "ct", "ea")])


def pair_metrics_one_shot(spark: SparkSession, d: str) -> DataFrame:
    return _pair(spark, d, "one_shot").select("result_id", *[r6(c).alias(c) for c in ("cs", "ct", "ea")])


def corpus_means(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for mode in ("zero_shot", "one_shot"):
        one = metrics.corpus_means(_pair(spark, d, mode)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def mode_delta(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.compare_modes(table(spark, d, "task_b_results"), "result_id")


def running_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Consistency and contradiction so far, at every tenth result."""
    return metrics.running(_pair(spark, d, "zero_shot"), "result_id", 10, consistency=F.col("cs"), contradiction=F.col("ct"))


def timeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Delivered timeline summaries against the timelines' own."""
    gold = extract.latest(table(spark, d, "timeline_data").where("timeline_summary is not null and timeline_summary <> 'NONE'").select("timeline_id", "row_id", "timeline_summary"), ["timeline_id"], "row_id")
    c = table(spark, d, "task_c_baseline").where(F.length("task_c_baseline_official_summaries") > 0).select(F.col("row_id").alias("delivery_id"), "timeline_id", F.col("task_c_baseline_official_summaries").alias("predicted"))
    m = metrics.pair_metrics(c.join(gold, "timeline_id"), "delivery_id", "predicted", "timeline_summary")
    return m.select("delivery_id", r6("cs").alias("cs"), r6("ct").alias("ct"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return x


# -- text and label functions


def whitespace_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


def span_highlight(spark: SparkSession, d: str) -> DataFrame:
    j = _spans(spark, d).select("span_id", *KEYS, F.col("text").alias("span")).join(_posts(spark, d).select(*KEYS, "post"), KEYS)
    text, found = T.highlight(F.col("post"), F.col("span"))
    return j.select("span_id", text.alias("marked"), found.alias("found"))


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("predicted_abcd_key")
    return _spans(spark, d).select("span_id", T.parse_label(p).alias("label"), T.parse_label(p, strict=True).alias("strict_label"))


def span_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("span_id", T.truncate(F.col("text")).alias("text"))


def lenient_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_data").select("row_id", T.number(F.col("well_being_score")).alias("value"))


def wellbeing_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_profile").select("profile_id", T.wellbeing_text(F.col("wellbeing")).alias("label"))


def none_filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_data").select("row_id", *[extract.none_text(c).alias(c) for c in ("post_summary", "well_being_score", "maladaptive_evidence", "adaptive_evidence")])


def category_names(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).join(F.broadcast(S.category_names(spark)), F.col("predicted_abcd_key") == F.col("abcd_key"), "left")
    return s.groupBy(F.coalesce("category_name", "predicted_abcd_key", F.lit("none")).alias("name"), "polarity").agg(F.count("*").alias("n"))


# -- prompts


def _span_lists(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).where("timeline_id is not null and post_index is not null and length(text) > 0")
    item = F.struct("span_id", F.coalesce("polarity", F.lit("")).alias("polarity"), F.coalesce("gold_abcd_key", F.lit("")).alias("abcd_key"), "text")
    return s.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("spans"))


def evidence_format(spark: SparkSession, d: str) -> DataFrame:
    return _span_lists(spark, d).select(*KEYS, prompts.evidence_block(F.col("spans")).alias("block"))


def zero_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = _posts(spark, d).join(_span_lists(spark, d), KEYS)
    wb = T.number(F.col("well_being_score"))
    return p.select(*KEYS, prompts.zero_shot(F.coalesce("post", F.lit("")), prompts.evidence_block(F.col("spans")), wb).alias("prompt"))


def classification_prompts(spark: SparkSession, d: str) -> DataFrame:
    j = _spans(spark, d).where("length(text) > 0 and polarity is not null").select("span_id", *KEYS, F.col("text").alias("span"), "polarity").join(_posts(spark, d).where("post is not null").select(*KEYS, "post"), KEYS)
    return j.select("span_id", prompts.classification(F.col("post"), F.col("span"), F.col("polarity")).alias("prompt"))


def one_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with the example that was retrieved for each result: its post, gold evidence, well-being and summary."""
    p = _posts(spark, d).join(_span_lists(spark, d), KEYS, "left")
    one = lambda c: F.struct(F.coalesce("post", F.lit("")).alias("post"), prompts.evidence_block(F.coalesce("spans", F.array().cast("array<struct<span_id:bigint,polarity:string,abcd_key:string,text:string>>"))).alias("evidence"), T.number(F.col("well_being_score")).alias("wb"), F.col("post_summary").alias("summary")).alias(c)
    target = p.select(*KEYS, one("t"))
    example = p.where(F.length("post_summary") > 0).select(F.col("timeline_id").alias("retrieved_timeline"), F.col("post_index").alias("retrieved_post_index"), one("e"))
    r = table(spark, d, "task_b_results").select("result_id", *KEYS, "retrieved_timeline", "retrieved_post_index")
    j = r.join(target, KEYS).join(example, ["retrieved_timeline", "retrieved_post_index"])
    return j.select("result_id", prompts.one_shot(F.col("t.post"), F.col("t.evidence"), F.col("t.wb"), F.col("e.post"), F.col("e.evidence"), F.col("e.wb"), F.col("e.summary")).alias("prompt"))


def baseline_prompts(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("post", F.lit(""))
    return table(spark, d, "post_data").select("row_id", prompts.baseline(text).alias("prompt"), prompts.baseline(text, as_json=True).alias("blue_prompt"))


# -- lookups and documents


def _results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "task_b_results").where("timeline_id is not null and post_index is not null").select(*KEYS, "result_id", "zero_shot_summary")
    return extract.latest(r, KEYS, "result_id")


def lookup_default_fill(spark: SparkSession, d: str) -> DataFrame:
    return submission.fill_results(_posts(spark, d).select(*KEYS, "post_id"), _results(spark, d), KEYS, "zero_shot_summary").select(*KEYS, "post_id", F.col("zero_shot_summary").alias("summary"))


def lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "task_b_baseline").select("row_id", "post_id", "source")
    p = _posts(spark, d).select("post_id", F.col("timeline_id").alias("tl"), F.col("post_index").alias("ix"))
    return b.join(p, "post_id").select("row_id", "post_id", "tl", "ix", "source")


def orphan_results(spark: SparkSession, d: str) -> DataFrame:
    return submission.orphans(table(spark, d, "post_profile").select("profile_id", *KEYS), _posts(spark, d), KEYS).select("profile_id")


def retrieved_examples(spark: SparkSession, d: str) -> DataFrame:
    """Results with the text of the post that was shown as an example; without one if none was."""
    p = _posts(spark, d).select(F.col("timeline_id").alias("retrieved_timeline"), F.col("post_index").alias("retrieved_post_index"), F.col("post_id").alias("example_id"))
    r = table(spark, d, "task_b_results").select("result_id", "retrieved_timeline", "retrieved_post_index")
    return r.join(p, ["retrieved_timeline", "retrieved_post_index"], "left").select("result_id", "example_id")


def submission_documents(spark: SparkSession, d: str) -> DataFrame:
    """The nested document of every timeline as JSON."""
    s = _spans(spark, d).where("timeline_id is not null and length(text) > 0")
    texts = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("span_id", "text")))), lambda x: x["text"])
    ev = s.groupBy(*KEYS).agg(texts("adaptive").alias("adaptive_evidence"), texts("maladaptive").alias("maladaptive_evidence"))
    p = submission.fill_results(_posts(spark, d), _results(spark, d).drop("result_id"), KEYS, "zero_shot_summary").join(ev, KEYS, "left")
    p = extract.latest(p.select("timeline_id", "post_id", "row_id", "adaptive_evidence", "maladaptive_evidence", F.col("zero_shot_summary").alias("summary"), T.number(F.col("well_being_score")).alias("wellbeing_score")), ["timeline_id", "post_id"], "row_id")
    return submission.submission(p)


def eligible_posts(spark: SparkSession, d: str) -> DataFrame:
    p = _posts(spark, d).withColumn("post_summary", F.when(F.col("post_summary") != S.NONE, F.col("post_summary")))
    return extract.eligible(p, _spans(spark, d)).select(*KEYS, "post_id")


def evaluable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results that each mode can be scored on, and baseline rows that have both sides."""
    r = table(spark, d, "task_b_results")
    b = table(spark, d, "task_b_baseline").join(_posts(spark, d).select("post_id", "post_summary"), "post_id")
    zero, one = ((F.length("gold_summary") > 0) & (F.length(f"{m}_summary") > 0) for m in ("zero_shot", "one_shot"))
    a = r.agg(F.count_if(zero).alias("n_zero_shot"), F.count_if(one).alias("n_one_shot"))
    return a.crossJoin(b.agg(F.count_if((F.col("post_summary") != S.NONE) & F.col("task_b_baseline_official_summaries").isNotNull()).alias("n_baseline")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        knn_semantic_top1, knn_semantic_top5, knn_same_group_allowed, knn_structural, knn_hybrid, knn_hybrid_concat, fold_similarity, pairwise_similarity_stats, weighted_concat,
        context_w0, context_w1, context_w2, context_format, context_positions, timeline_texts, timeline_prompts, timeline_ids, load_counts, presence_profile, structural_vectors, profile_analysis,
        accuracy_by_polarity, macro_f1, macro_f1_orders, classification_report, running_accuracy, pair_metrics_zero_shot, pair_metrics_one_shot, corpus_means, mode_delta, running_consistency, timeline_metrics, sentence_split,
        whitespace_normalize, span_highlight, label_parse, span_truncate, lenient_number, wellbeing_text, none_filled, category_names, evidence_format, zero_shot_prompts, one_shot_prompts, classification_prompts, baseline_prompts,
        lookup_default_fill, lookup_inner, orphan_results, retrieved_examples, submission_documents, eligible_posts, evaluable_rows,
    )
    return {f.__name__: f for f in fs}
