import json

from timberline.operators import nested

DOC = {
    "timeline_id": "t1",
    "posts": [
        {"post_index": 3, "post": "a", "evidence": {"adaptive-state": {"B-O": [{"highlighted_evidence": "x"}, "", "y"], "A": "z"}, "Maladaptive_State": None}},
        {"post_index": 9, "post": "b", "evidence": json.dumps({"maladaptive": [{"key": "c_s ", "highlighted_evidence": "q", "Category": "Shame"}, {"key": "D", "highlighted_evidence": None}]})},
        {"post_index": 10, "evidence": None},
    ],
}


def labels(text):
    return [(p, d) for p, d, _ in nested.dewey_nodes(text)]


def test_labels_and_parents_follow_the_document():
    got = labels(json.dumps(DOC))
    assert got == [
        (nested.TIMELINE_PATH, [0]),
        (nested.POST_PATH, [0, 0]),
        (nested.SPAN_PATH, [0, 0, 0, 1, 0]),
        (nested.SPAN_PATH, [0, 0, 0, 1, 1]),
        (nested.SPAN_PATH, [0, 0, 0, 0, 0]),
        (nested.POST_PATH, [0, 1]),
        (nested.SPAN_PATH, [0, 1, 1, 4, 0]),
        (nested.POST_PATH, [0, 2]),
    ]
    known = {tuple(d) for _, d in got}
    for path, d in got:
        if path == nested.SPAN_PATH:
            assert tuple(d[:2]) in known
        elif path == nested.POST_PATH:
            assert tuple(d[:1]) in known


def test_wrappers_marks_and_broken_payloads():
    one = json.dumps(DOC)
    assert labels("﻿\n " + one + "\n") == labels(one)
    assert labels("log [12]: " + one + " done") == labels(one)
    assert [d for p, d in labels(json.dumps({"export": {"version": 2, "timelines": [DOC, {"timeline_id": "t2"}]}})) if p == nested.TIMELINE_PATH] == [[0], [1]]
    assert labels(json.dumps({"timeline_id": "t", "posts": {"post": "only"}})) == [(nested.TIMELINE_PATH, [0]), (nested.POST_PATH, [0, 0])]
    for bad in (None, "", "   ", "no json", one[:-7], "[" + one + ", {\"timeline_id\": \"cut", "[]", "{}", "[" * 100_000):
        assert labels(bad) == []


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, json.dumps(DOC), "x"), (2, None, "x"), (3, "{", "x"), (1, json.dumps(DOC), "y")]
    df = spark.createDataFrame(rows, "raw_id bigint, payload string, node string")
    out = nested.node_index(nested.label_nodes(df))
    assert out.columns == ["node", "raw_id", "timeline_pos", "post_pos", "state_type", "abcd_key", "span_pos"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 16 and all(r[1] == 1 for r in got)
    assert ("timeline", 1, 0, -1, "", "", -1) in got and ("span", 1, 0, 1, "maladaptive-state", "C-S", 0) in got
    assert nested.label_nodes(df.where("false")).count() == 0
    tables = nested.node_tables(nested.label_nodes(df))
    posts = tables["posts"].collect()
    assert {tuple(r["parent"]) for r in posts} == {(0,)} and {r["post_index"] for r in posts} == {"3", "9", "10"}
    assert {(tuple(r["parent"]), r["text"]) for r in tables["spans"].collect()} >= {((0, 0), "x"), ((0, 1), "q")}


def test_deep_wrappers_strings_and_several_values():
    deep = DOC
    for i in range(40):
        deep = [deep] if i % 2 else {"export": deep}
    assert labels(json.dumps(deep)) == labels(json.dumps(DOC))
    assert labels(json.dumps({"body": json.dumps({"inner": json.dumps([DOC])}), "note": "{no json"})) == labels(json.dumps(DOC))
    lines = "\n".join(json.dumps(x) for x in (DOC, {"version": 2}, {"timeline_id": "t2"}, {"data": [{"timeline_id": "t3"}]}))
    assert [d for p, d in labels(lines) if p == nested.TIMELINE_PATH] == [[0], [1], [2]]
    assert labels(json.dumps(DOC) + ' {"timeline_id": "cut') == labels(json.dumps(DOC))
