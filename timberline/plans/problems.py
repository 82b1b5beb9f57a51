"""Queries of the general data-preparation operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import nested, packed
from timberline.session import fan_out, table

FIELDS = ("maladaptive_evidence", "adaptive_evidence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(fan_out(table(spark, d, "post_data").select("row_id", *FIELDS)), "row_id", FIELDS)


def p4_delimiters(spark: SparkSession, d: str) -> DataFrame:
    values = packed.long_form(fan_out(table(spark, d, "post_data").select("row_id", *FIELDS)), "row_id", FIELDS)
    got = packed.score_delimiters(values, packed.fit_starts(values))
    return got.select("field", "delimiter", "n_values", F.round("regularity", 6).alias("regularity"), F.round("consistency", 6).alias("consistency"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_index(nested.label_nodes(fan_out(table(spark, d, "timeline_json").select("raw_id", "payload"))))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """Span table with its own label and its parent's, as text."""
    spans = nested.node_tables(nested.label_nodes(fan_out(table(spark, d, "timeline_json").select("raw_id", "payload"))))["spans"]
    return spans.select(F.col("row_id").alias("raw_id"), F.array_join("dewey", ".").alias("label"), F.array_join("parent", ".").alias("parent"), "state_type", "abcd_key", "text", "category")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_delimiters, p6_found, p6_spans)}
