"""Neighbouring posts by position within a timeline.

A timeline may hold a large part of all rows, so it is not one window partition: rows are cut into chunks
of neighbouring post indexes, frames are built inside each chunk, and the ends of a chunk are completed
from the ends of the chunks around it, of which at most ``w`` rows each are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ITEMS = "array<struct<post_index:int,post_text:string>>"


def attach_context(posts: DataFrame, w: int, group: str = "timeline_id", index: str = "post_index", order: str = "row_id", text: str = "post", chunk: int = 256) -> DataFrame:
    """The posts with ``before`` and ``after``: up to ``w`` posts on each side (``post_index, post_text``), in order.

    ``w`` = 0 gives empty arrays. Null groups form one group, null indexes count as -1 and sort first, null
    texts count as ''. Ties of the index go by ``order``.
    """
    none = F.array().cast(ITEMS)
    if w == 0:
        return posts.withColumns({"before": none, "after": none})
    base = posts.withColumns({"__i": F.coalesce(F.col(index), F.lit(-1)), "__t": F.struct(F.coalesce(F.col(index), F.lit(-1)).cast("int").alias("post_index"), F.coalesce(F.col(text), F.lit("")).alias("post_text"))}).withColumn("__c", F.floor(F.col("__i") / chunk))
    inner = Window.partitionBy(group, "__c").orderBy("__i", order)
    item = F.struct("__i", F.col(order).alias("__o"), "__t")
    heads = base.withColumns({"__n": F.row_number().over(inner), "__m": F.row_number().over(Window.partitionBy(group, "__c").orderBy(F.desc("__i"), F.desc(order)))}).where((F.col("__n") <= w) | (F.col("__m") <= w))
    ends = heads.groupBy(group, "__c").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= w, item))), lambda x: x["__t"]).alias("__head"), F.transform(F.array_sort(F.collect_list(F.when(F.col("__m") <= w, item))), lambda x: x["__t"]).alias("__tail"))
    outer = Window.partitionBy(group).orderBy("__c")
    ends = ends.select(group, "__c", F.flatten(F.collect_list("__tail").over(outer.rowsBetween(-w, -1))).alias("__left"), F.flatten(F.collect_list("__head").over(outer.rowsBetween(1, w))).alias("__right"))
    framed = base.withColumns({"__b": F.collect_list("__t").over(inner.rowsBetween(-w, -1)), "__a": F.collect_list("__t").over(inner.rowsBetween(1, w))})
    ends = ends.withColumnsRenamed({group: "__g", "__c": "__k"})
    both = framed.join(ends, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__c") == F.col("__k")), "left")
    before = F.concat(F.coalesce("__left", none), "__b")
    after = F.concat("__a", F.coalesce("__right", none))
    return both.withColumns({"before": F.slice(before, F.greatest(F.size(before) - w + 1, F.lit(1)), F.lit(w)), "after": F.slice(after, F.lit(1), F.lit(w))}).select(*posts.columns, "before", "after")


def positioned(before: Column, after: Column) -> Column:
    """One list of the posts around, each with its ``position``: before or after."""
    side = lambda posts, where: F.transform(posts, lambda p: F.struct(p["post_index"].alias("post_index"), p["post_text"].alias("post_text"), F.lit(where).alias("position")))
    return F.concat(side(before, "before"), side(after, "after"))
