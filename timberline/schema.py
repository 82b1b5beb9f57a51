"""Constants, schemas and small dimension tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values; their order is part of the data model.
ABCD_KEYS = ("A", "B-O", "B-S", "C-O", "C-S", "D")
STATE_TYPES = ("adaptive-state", "maladaptive-state")
POLARITIES = ("adaptive", "maladaptive")
RETRIEVAL_MODES = ("structural", "semantic", "hybrid", "hybrid_concat")
NLI_LABELS = ("entailment", "neutral", "contradiction")
PROFILE_DIMS = tuple(f"{k}_{p}" for p in POLARITIES for k in ABCD_KEYS)
UNKNOWN = "UNKNOWN"
NONE = "NONE"
SPAN_CHARS = 100

TIMELINE_DDL = (
    "timeline_id string, timeline_summary string, posts array<struct<post_index:int, post_id:string, post:string, date:string,"
    " `Post Summary`:string, `Well-being`:string,"
    " evidence:map<string,map<string,struct<highlighted_evidence:string,Category:string>>>>>"
)
TIMELINE_CSV = "timeline_id string, timeline_summary string"
POST_CSV = "timeline_id string, post_index int, post_id string, post_date string, post string, post_summary string, well_being_score string, maladaptive_evidence string, adaptive_evidence string"
PREDICTIONS = "spans array<struct<text:string, gold:string, predicted:string, polarity:string, timeline_id:string, post_index:int>>"
RESULTS = "timeline_id string, post_index int, wellbeing double, gold_summary string, n_evidence_spans int, evidence_texts array<string>, zero_shot_summary string, one_shot_summary string, retrieved_timeline string, retrieved_post_index int, retrieval_similarity double"
TASK_C = "timeline_id string, predicted_summary string"

#: Names of the keys. Fixed values.
KEY_NAMES = {
    "A": "Affect",
    "B-O": "Behavior toward the Other",
    "B-S": "Behavior toward the Self",
    "C-O": "Cognition of the Other",
    "C-S": "Cognition of the Self",
    "D": "Desire",
}


def category_names(spark: SparkSession) -> DataFrame:
    """Six rows: ``abcd_key, category_name``."""
    return spark.createDataFrame(list(KEY_NAMES.items()), "abcd_key string, category_name string")
