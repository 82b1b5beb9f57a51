"""Nested JSON documents to related flat tables, by Dewey labels.

Every node of interest (timeline, post, evidence span) gets the ordinals on its path from the
root as its label; the label of a node's parent is the label cut after the parent's level, so no
join is ever needed to find or to check a link. Nodes are grouped by schema path into tables.

Levels and labels::

    timeline  [t]                      t: place in the payload
    post      [t, p]                   p: place in the timeline
    span      [t, p, state, key, s]    state: 0 adaptive, 1 maladaptive; key: place in ABCD_KEYS;
                                       s: place among the spans of that key

Defined results: null, blank and invalid payloads give no node; a byte-order mark, white space or
text before, between or after JSON values is passed over, and timelines count through all values;
containers that are null, missing or of another shape hold nothing; JSON inside a string field is opened; a span without text is no node and takes
no place; a span under an unknown key has the key ''. Repeated rows give repeated nodes under their
own row id. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABCD_KEYS = ("A", "B-O", "B-S", "C-O", "C-S", "D")
STATE_TYPES = ("adaptive-state", "maladaptive-state")

NODE_DDL = "row_id bigint, schema_path string, dewey array<int>, attrs map<string,string>"
TIMELINE_PATH, POST_PATH, SPAN_PATH = "timeline", "timeline.posts", "timeline.posts.evidence"

_JSON_START = re.compile(r'\{\s*["}]|\[\s*[\[{\]]')
_decoder = json.JSONDecoder()


def _plain(name: object) -> str:
    return re.sub(r"[\s_-]+", "-", str(name).strip().lower())


def _opened(value: object) -> object:
    """A container that was written as a JSON string, opened; other values as they are."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _field(obj: dict, name: str) -> object:
    if name in obj:
        return obj[name]
    want = _plain(name)
    return next((v for k, v in obj.items() if _plain(k) == want), None)


def _is_timeline(x: object) -> bool:
    return isinstance(x, dict) and any(_plain(k) in ("timeline-id", "posts") for k in x)


def _timelines(x: object) -> list[dict]:
    """Timelines in reading order, under any wrapper objects, lists and strings."""
    found, open_ = [], [x]
    while open_:
        x = _opened(open_.pop())
        if _is_timeline(x):
            found.append(x)
        elif isinstance(x, (list, dict)):
            open_ += reversed(x if isinstance(x, list) else list(x.values()))
    return found


def parse_payload(text: str | None) -> list[dict]:
    """Timelines of all JSON values of a raw payload. What comes from JSON that does not parse on is void."""
    at, found = 0, []
    while text and (m := _JSON_START.search(text, at)):
        try:
            value, at = _decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            break
        found += _timelines(value)
    return found


def _elements(value: object) -> list:
    value = _opened(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def _span_text(x: object) -> str:
    if isinstance(x, dict):
        x = _field(x, "highlighted_evidence")
    return x if isinstance(x, str) and x.strip() else ""


def _key(name: object) -> str:
    k = _plain(name).upper()
    return k if k in ABCD_KEYS else ""


def _spans(state: object) -> Iterator[tuple[str, str, str]]:
    """(key, text, category) of one state, in reading order."""
    state = _opened(state)
    if isinstance(state, dict) and not any(_plain(k) == "highlighted-evidence" for k in state):
        items = [(k, e) for k, v in state.items() for e in (v if isinstance(v, list) else [v])]
    else:
        items = [(_field(e, "key") or "" if isinstance(e, dict) else "", e) for e in _elements(state)]
    for k, e in items:
        if text := _span_text(e):
            category = _field(e, "Category") if isinstance(e, dict) else None
            yield _key(k), text, category if isinstance(category, str) else ""


def _scalars(obj: dict) -> dict[str, str]:
    out = {}
    for k, v in obj.items():
        if isinstance(v, (str, int, float, bool)):
            out.setdefault(_plain(k).replace("-", "_"), v if isinstance(v, str) else json.dumps(v))
    return out


def dewey_nodes(text: str | None) -> Iterator[tuple[str, list[int], dict[str, str]]]:
    """(schema path, label, attributes) of every node of a payload."""
    for t, timeline in enumerate(parse_payload(text)):
        yield TIMELINE_PATH, [t], _scalars(timeline)
        for p, post in enumerate(_elements(_field(timeline, "posts"))):
            if not isinstance(post, dict):
                continue
            yield POST_PATH, [t, p], _scalars(post)
            evidence = _opened(_field(post, "evidence"))
            if not isinstance(evidence, dict):
                continue
            seen: dict[tuple[int, int], int] = {}
            for s, state in enumerate(STATE_TYPES):
                for name, content in evidence.items():
                    if _plain(name).removesuffix("-state") != state.removesuffix("-state"):
                        continue
                    for key, span, category in _spans(content):
                        k = ABCD_KEYS.index(key) if key else len(ABCD_KEYS)
                        n = seen.get((s, k), 0)
                        seen[s, k] = n + 1
                        yield SPAN_PATH, [t, p, s, k, n], {"text": span, "category": category}


def label_nodes(df: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """All nodes of all payloads: ``row_id, schema_path, dewey, attrs``. One narrow pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for i, text in zip(pdf["row_id"], pdf["payload"]):
                rows.extend((i, *node) for node in dewey_nodes(text if isinstance(text, str) else None))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["row_id", "schema_path", "dewey", "attrs"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "schema_path", "dewey", "attrs"])

    src = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(payload_col).alias("payload"))
    return src.mapInPandas(run, NODE_DDL)


def parent_label(path: str = "schema_path", dewey: str = "dewey") -> F.Column:
    """The label of a node's parent, by truncation; null for a timeline."""
    return F.when(F.col(path) == SPAN_PATH, F.slice(dewey, 1, 2)).when(F.col(path) == POST_PATH, F.slice(dewey, 1, 1))


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The nodes of each schema path as one flat table with its own label and its parent's."""
    base = nodes.withColumn("parent", parent_label())

    def attr(name: str) -> F.Column:
        return F.col("attrs").getItem(name).alias(name)

    timelines = base.where(F.col("schema_path") == TIMELINE_PATH).select("row_id", "dewey", attr("timeline_id"), attr("timeline_summary"))
    posts = base.where(F.col("schema_path") == POST_PATH).select("row_id", "dewey", "parent", *(attr(a) for a in ("post_index", "post_id", "post", "date", "post_summary", "well_being")))
    spans = base.where(F.col("schema_path") == SPAN_PATH).select("row_id", "dewey", "parent", state_type().alias("state_type"), abcd_key().alias("abcd_key"), attr("text"), attr("category"))
    return {"timelines": timelines, "posts": posts, "spans": spans}


def _at(i: int) -> F.Column:
    return F.try_element_at("dewey", F.lit(i))


def state_type() -> F.Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, STATE_TYPES)), _at(3) + 1), F.lit(""))


def abcd_key() -> F.Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, ABCD_KEYS)), _at(4) + 1), F.lit(""))


def node_index(nodes: DataFrame, id_name: str = "raw_id") -> DataFrame:
    """One row per node with its places spelled out; what a node lacks is -1 or ''."""
    kind = F.when(F.col("schema_path") == SPAN_PATH, "span").when(F.col("schema_path") == POST_PATH, "post").otherwise("timeline")
    return nodes.select(
        kind.alias("node"),
        F.col("row_id").alias(id_name),
        _at(1).alias("timeline_pos"),
        F.coalesce(_at(2), F.lit(-1)).alias("post_pos"),
        state_type().alias("state_type"),
        abcd_key().alias("abcd_key"),
        F.coalesce(_at(5), F.lit(-1)).alias("span_pos"),
    )
