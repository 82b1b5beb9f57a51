"""Per-post operators on a stream: all of them are row-wise, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from timberline import schema as S
from timberline.operators import extract


def read_timelines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New timeline files of a folder, as they arrive."""
    return spark.readStream.schema(S.TIMELINE_DDL).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def post_stream(timelines: DataFrame) -> DataFrame:
    return extract.flatten_posts(timelines).drop("evidence", "load_ord")


def write(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, exactly once by the sink's log; ends when all files so far are read."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
