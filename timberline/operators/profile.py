"""Presence profiles, ratios and structural vectors of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import vectors as V
from timberline.schema import ABCD_KEYS, POLARITIES


def presence(spans: DataFrame, entity: list[str], key: str, polarity: str, keys: tuple[str, ...] = ABCD_KEYS, polarities: tuple[str, ...] = POLARITIES) -> DataFrame:
    """Per entity ``presence`` (0 or 1 per polarity and key, polarity-major), ``n_spans`` and ``adaptive_ratio``.

    Unknown keys set no element but count as spans. One hash aggregation with partial sums.
    """
    hits = [F.max(F.when((F.col(polarity) == p) & (F.col(key) == k), 1.0).otherwise(0.0)) for p in polarities for k in keys]
    ratio = F.avg(F.when(F.col(polarity) == polarities[0], 1.0).otherwise(0.0))
    return spans.groupBy(*entity).agg(F.array(*hits).alias("presence"), F.count("*").alias("n_spans"), ratio.alias("adaptive_ratio"))


def wellbeing_norm(c: Column) -> Column:
    """1..10 to 0..1, not clamped; 0.5 for null."""
    return F.coalesce((c - 1) / 9.0, F.lit(0.5))


def structural(posts: DataFrame, profile: DataFrame, entity: list[str], wellbeing: str = "wellbeing", dims: int = len(ABCD_KEYS) * len(POLARITIES)) -> DataFrame:
    """``raw_vector`` (presence, well-being, ratio) and ``unit_vector`` of each post; posts without spans get neutral values."""
    got = posts.join(profile, entity, "left")
    raw = F.concat(F.coalesce("presence", F.array(*[F.lit(0.0)] * dims)), F.array(wellbeing_norm(F.col(wellbeing)), F.coalesce("adaptive_ratio", F.lit(0.5))))
    return got.withColumn("raw_vector", raw).withColumn("unit_vector", V.normalize(F.col("raw_vector")))


def analyse(profiles: DataFrame, raw: str = "raw_vector", wellbeing: str = "wellbeing", dims: int = 12) -> DataFrame:
    """One row: profiles, distinct presence profiles, mean active dimensions, well-being and ratio statistics."""
    part = F.slice(raw, 1, dims)
    active = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return profiles.select(F.transform(part, lambda x: x.cast("int")).alias("p"), active.alias("a"), F.col(wellbeing).alias("w"), F.element_at(raw, -1).alias("r")).agg(
        F.count("*").alias("n_profiles"),
        F.countDistinct("p").alias("n_distinct"),
        F.round(F.avg("a"), 6).alias("avg_active"),
        F.round(F.avg("w"), 6).alias("wellbeing_mean"),
        F.round(F.stddev_pop("w"), 6).alias("wellbeing_std"),
        F.min("w").alias("wellbeing_min"),
        F.max("w").alias("wellbeing_max"),
        F.round(F.avg("r"), 6).alias("ratio_mean"),
        F.round(F.stddev_pop("r"), 6).alias("ratio_std"),
    )
