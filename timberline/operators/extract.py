"""Timelines to posts and spans: flattening, defaults, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import text as T
from timberline.schema import ABCD_KEYS, NONE, POLARITIES, STATE_TYPES


def annotated(wellbeing: Column, summary: Column) -> Column:
    """A post counts as annotated with any raw well-being value, be it a number or not, or a summary, even an empty one."""
    return wellbeing.isNotNull() | summary.isNotNull()


def flatten_posts(timelines: DataFrame) -> DataFrame:
    """One row per post with defaults: id 'unknown', index -1, texts ''. ``load_ord`` keeps the order read."""
    order = F.struct(*[c for c in ("file_path", "file_pos") if c in timelines.columns], "pos") if "file_path" in timelines.columns else F.col("pos")
    p = timelines.select("*", F.posexplode("posts").alias("pos", "p"))
    wb = T.number(F.col("p.`Well-being`"))
    return p.select(
        F.coalesce("timeline_id", F.lit("unknown")).alias("timeline_id"),
        F.coalesce("p.post_index", F.lit(-1)).alias("post_index"),
        F.col("p.post_id").alias("post_id"),
        F.coalesce("p.post", F.lit("")).alias("post"),
        F.col("p.date").alias("post_date"),
        F.coalesce("p.`Post Summary`", F.lit("")).alias("post_summary"),
        wb.alias("wellbeing"),
        annotated(F.col("p.`Well-being`"), F.col("p.`Post Summary`")).alias("is_annotated"),
        F.col("p.evidence").alias("evidence"),
        order.alias("load_ord"),
    )


def unpivot_spans(posts: DataFrame) -> DataFrame:
    """Spans of annotated posts in the fixed order of states and keys; spans without text are dropped."""
    dims = F.array(*[F.struct(F.lit(i).alias("span_ord"), F.lit(s).alias("state"), F.lit(p).alias("polarity"), F.lit(k).alias("abcd_key")) for i, (s, p, k) in enumerate((s, p, k) for s, p in zip(STATE_TYPES, POLARITIES) for k in ABCD_KEYS)])
    x = posts.where("is_annotated").select("timeline_id", "post_index", "load_ord", "evidence", F.explode(dims).alias("d"))
    span = F.col("evidence").getItem(F.col("d.state")).getItem(F.col("d.abcd_key"))
    return x.select("timeline_id", "post_index", "load_ord", "d.span_ord", "d.polarity", F.col("d.abcd_key").alias("gold_abcd_key"), span["highlighted_evidence"].alias("text"), F.coalesce(span["Category"], F.lit("")).alias("gold_category")).where(F.length("text") > 0)


def none_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NONE))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest ``order``; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def eligible(posts: DataFrame, spans: DataFrame) -> DataFrame:
    """Posts with a summary and at least one span."""
    return posts.where(F.length("post_summary") > 0).join(spans.select("timeline_id", "post_index").distinct(), ["timeline_id", "post_index"], "left_semi")
