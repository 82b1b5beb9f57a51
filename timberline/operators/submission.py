"""Lookups between posts and results, and the nested submission document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_results(posts: DataFrame, results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every post with its result's text, '' without one."""
    return posts.join(results.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit("")))


def orphans(results: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose post does not exist."""
    return results.join(posts.select(*keys), keys, "left_anti")


def submission(posts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``timeline_id, document``: the document of each timeline as JSON, nulls kept.

    ``posts`` has timeline_id, post_id (unique in a timeline), summary, adaptive_evidence and
    maladaptive_evidence (arrays), wellbeing_score; ``summaries`` has timeline_id and summary.
    """
    entry = F.struct(F.coalesce("adaptive_evidence", F.array().cast("array<string>")).alias("adaptive_evidence"), F.coalesce("maladaptive_evidence", F.array().cast("array<string>")).alias("maladaptive_evidence"), F.coalesce("summary", F.lit("")).alias("summary"), "wellbeing_score")
    per = posts.where("post_id is not null").groupBy("timeline_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("post_id", entry.alias("e"))))).alias("post_level"))
    if summaries is not None:
        per = summaries.select("timeline_id", F.col("summary").alias("__s")).join(per, "timeline_id", "left")
    else:
        per = per.withColumn("__s", F.lit(""))
    per = per.where("timeline_id is not null")
    empty = F.create_map().cast("map<string,struct<adaptive_evidence:array<string>,maladaptive_evidence:array<string>,summary:string,wellbeing_score:double>>")
    doc = F.struct(F.struct(F.coalesce("__s", F.lit("")).alias("summary")).alias("timeline_level"), F.coalesce("post_level", empty).alias("post_level"))
    return per.select("timeline_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))
