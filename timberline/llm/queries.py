"""The training-data queries by problem, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import language, mixing, pairs, pii, similar, splits, tokens, truncation
from timberline.session import fan_out, table

VECTORS = {"semantic_vector": 64, "structural_vector": 14, "hybrid_vector": 78}


# 1 -- broken pairs


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flag_pairs(fan_out(table(spark, d, "task_b_results")), table(spark, d, "post_data"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("defect is not null").select("result_id", "shot", "defect")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    per = _pairs(spark, d).groupBy("shot", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))
    return per


# 2 -- most similar vectors


def _knn(spark: SparkSession, d: str, name: str, **more: float) -> DataFrame:
    return similar.most_similar(table(spark, d, "post_profile"), "profile_id", name, VECTORS[name], **more)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("semantic_vector", "hybrid_vector"):
        near = _knn(spark, d, name, min_cosine=0.96)
        one = near.select(F.lit(name).alias("vector_name"), F.least("id", "other").alias("profile_id_a"), F.greatest("id", "other").alias("profile_id_b")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in VECTORS:
        one = _knn(spark, d, name).select(F.lit(name).alias("vector_name"), F.col("id").alias("profile_id"), F.col("other").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))
        out = one if out is None else out.unionByName(one)
    return out


# 3 -- splits


def _grouped(spark: SparkSession, d: str) -> list[tuple[DataFrame, str]]:
    return [(table(spark, d, "post_profile"), "timeline_id"), (table(spark, d, "evidence_span"), "timeline_id")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.spelling_pairs(_grouped(spark, d))


def p3_assigned(spark: SparkSession, d: str) -> DataFrame:
    to = splits.assign_splits(_grouped(spark, d), table(spark, d, "split_targets"))
    a = splits.split_records(table(spark, d, "post_profile"), "profile_id", "timeline_id", to).withColumn("table_name", F.lit("post_profile"))
    b = splits.split_records(table(spark, d, "evidence_span"), "span_id", "timeline_id", to).withColumn("table_name", F.lit("evidence_span"))
    return a.unionByName(b).select("table_name", "record_id", "split_name")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_grouped(spark, d), table(spark, d, "split_targets"))


# 5 -- cut texts

_CUT = (("task_b_baseline", "task_b_baseline_official_summaries"), ("task_c_baseline", "task_c_baseline_official_summaries"))


def _cut_parts(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str, str]]:
    return [(fan_out(table(spark, d, t)), "row_id", "source", c) for t, c in _CUT]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cuts(_cut_parts(spark, d)).where("is_cut").select("field", "row_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(_cut_parts(spark, d))


# 7 -- personal information


def _pii_texts(spark: SparkSession, d: str) -> DataFrame:
    return pii.long_texts([(fan_out(table(spark, d, "post_data")), "row_id", ("post", "post_summary")), (fan_out(table(spark, d, "timeline_data")), "row_id", ("timeline_summary",))])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(_pii_texts(spark, d)).select("field", "row_id", "kind", "start_at")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_pii_texts(spark, d)).select("field", "row_id", "redacted", "n_mentions")


# 8 -- tokens


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(fan_out(table(spark, d, "documents")))


# 9 -- mixing


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(fan_out(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return mixed.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(fan_out(table(spark, d, "documents")), targets), targets)


# 10 -- languages


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_cases(language.identify(fan_out(table(spark, d, "documents"))))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    got = language.identify(fan_out(table(spark, d, "documents"))).where("lang is not null")
    return got.select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "ambiguous")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_neighbours, p3_found, p3_assigned, p3_shares, p5_found, p5_rates, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_segments)}


_SPELLED = """
with s as (select distinct timeline_id as t from (select timeline_id from post_profile union all select timeline_id from evidence_span) where timeline_id is not null),
n as (select t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[\\s"''\\x{200b}\\x{a0}\\x{feff}“”‘’«»]', '', 'g'), '\\.json$', ''), '[-_\\x{2010}\\x{2011}\\x{2012}\\x{2013}\\x{2014}\\x{2212}]+', '-', 'g'), '^#?-?(timeline|tl)?-?', '') as x from s),
m as (select t, replace(x, 'o', '0') as x from n),
k as (select t, cast(cast(regexp_extract(x, '^(\\d+)', 1) as bigint) as varchar) || case when regexp_extract(x, '^\\d+-0*(\\d+)$', 1) <> '' then '-' || regexp_extract(x, '^\\d+-0*(\\d+)$', 1) else '' end as k from m where regexp_matches(x, '^\\d+(-\\d+)?$'))
select a.t as spelling_a, b.t as spelling_b from k a join k b on a.k = b.k and a.t < b.t
"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables where it is possible and fast; the others are tested by brute force or round trip."""
    return {"p3_found": _SPELLED}
