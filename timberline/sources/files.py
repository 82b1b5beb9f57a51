"""Readers and writers of the pipeline's files, and the names of its runs."""

from __future__ import annotations

import datetime
import json
import os
import re
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import schema as S

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_timelines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Timeline JSON: one file or a folder of ``*.json``; each file holds an object or a list of objects.

    With ``ordered`` the place of each timeline (``file_path``, ``file_pos``) is kept.
    """
    if not ordered:
        return spark.read.schema(S.TIMELINE_DDL).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    # an object is read as a list of one
    rows = whole.select("file_path", F.posexplode(F.from_json("value", f"array<struct<{_struct(S.TIMELINE_DDL)}>>")).alias("file_pos", "t"))
    return rows.select("file_path", "file_pos", "t.*")


def _struct(ddl: str) -> str:
    return re.sub(r"(^|, )(\w+) (string|array)", r"\1\2:\3", ddl)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(ddl).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(**CSV_OPTIONS, escapeQuotes="true").mode(mode).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a predictions file, one per row; a file without spans is an error."""
    spans = spark.read.schema(S.PREDICTIONS).option("multiLine", True).json(path).select(F.inline("spans"))
    if spans.isEmpty():
        raise ValueError("no spans in the predictions")
    return spans


def read_results(spark: SparkSession, path: str, ddl: str = S.RESULTS) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def read_task_c(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TASK_C).option("multiLine", True).json(path)


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    """JSON lines, in parallel; ``by`` gives a folder per value."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def write_document(rows: DataFrame, path: str, wrap: str | None = None, indent: int = 2) -> str:
    """One JSON document on the driver's disk, streamed row by row: a list, or an object with the list under ``wrap``."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{"{wrap}": [' if wrap else "[")
        for i, r in enumerate(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            f.write(("," if i else "") + "\n" + " " * indent + r["j"])
        f.write("\n]}" if wrap else "\n]")
    return path


def write_object(rows: DataFrame, key: str, document: str, path: str) -> str:
    """One JSON object on the driver's disk, streamed row by row: ``key`` to the JSON text of ``document``."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for i, r in enumerate(rows.select(key, document).orderBy(key).toLocalIterator()):
            f.write(("," if i else "") + "\n" + json.dumps(r[key], ensure_ascii=False) + ": " + r[document])
        f.write("\n}")
    return path


def prediction_rows(spans: DataFrame) -> DataFrame:
    """Span predictions as they may leave the engine: texts cut to their first characters."""
    return spans.select(F.substring("text", 1, S.SPAN_CHARS).alias("text"), F.col("gold_abcd_key").alias("gold"), F.col("predicted_abcd_key").alias("predicted"), "polarity", "timeline_id", "post_index")


def write_evaluation(values: dict, path: str, source: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"source": PurePath(source).name, **values}, f, indent=2, ensure_ascii=False)
    return path


#: How a result file's name ends: day and second of the run, or seconds since the epoch. Fixed values.
RUN_TIMES = (r"\d{8}-\d{6}", r"\d+(?:\.\d+)?")
EVALUATION_NAME = "task_{task}_evaluation_{time}.json"


def run_id(path: str) -> str:
    """The time in a result file's name: what follows the last underscore."""
    stem = PurePath(path).stem
    time = stem.rpartition("_")[2]
    if "_" not in stem or not any(re.fullmatch(t, time) for t in RUN_TIMES):
        raise ValueError(f"no run time in the name of {path}")
    return time


def timestamp(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime("%Y%m%d-%H%M%S")


def evaluation_path(path: str, task: str) -> str:
    return str(PurePath(path).with_name(EVALUATION_NAME.format(task=task, time=run_id(path))))


def baseline_evaluation_path(path: str) -> str:
    return path[: -len(".csv")] + "_evaluation.json"
