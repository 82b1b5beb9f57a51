import json

import numpy as np
import pytest

from timberline.operators import packed

TEXTS = ["I felt calm for most of Sunday", "my sister called, and it went fine", "I need quiet; everyone seemed loud", "Ich war ruhig, obwohl es laut war", "I lived on coffee and/or biscuits"]


@pytest.fixture(scope="module")
def model():
    b, f = packed._count(iter([json.dumps([t]) for t in TEXTS for _ in range(3)]))
    begins, follows = np.zeros(packed.BUCKETS), np.zeros(packed.BUCKETS)
    for k, v in b.items():
        begins[k] = v
    for k, v in f.items():
        follows[k] = v
    return packed.StartModel(begins, follows)


FIRM = frozenset(["\n", "\t", "||", "//", ";;", "|", " / "])
FORMS = [
    lambda t: json.dumps(t),
    lambda t: repr(t),
    lambda t: " | ".join(t),
    lambda t: "|" + "|".join(t) + "|",
    lambda t: "\t".join(t),
    lambda t: "\n".join("- " + x for x in t),
    lambda t: "\n".join(f"{i}. {x}" for i, x in enumerate(t, 1)) + "\n",
    lambda t: "  ".join(f"({i}) {x}" for i, x in enumerate(t, 1)),
    lambda t: " ".join(f"[{i}] {x}" for i, x in enumerate(t, 1)),
    lambda t: " // ".join(t),
    lambda t: ";;".join(t),
    lambda t: "; ".join(t) + ";",
    lambda t: ", ".join(t),
    lambda t: ",".join(f'"{x}"' for x in t),
    lambda t: " ".join("'" + x.replace("'", "''") + "'" for x in t),
    lambda t: "; ".join(f"«{x}»" for x in t),
    lambda t: ", ".join(f"„{x}“" for x in t),
    lambda t: "; ".join(f"B-O: {x}" for x in t),
    lambda t: "\n".join(f"A => {x}" for x in t),
    lambda t: json.dumps({"B-O": [{"highlighted_evidence": x, "Category": "c"} for x in t]}),
    lambda t: str({"A": {"highlighted_evidence": t[0], "Category": "c"}, "D": {"highlighted_evidence": t[-1]}}) if len(t) == 2 else json.dumps(t),
]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_round_trip_of_every_form(model, form, n):
    assert packed.split_value(form(TEXTS[:n]), model, FIRM) == TEXTS[:n]


def test_nothing_and_escapes(model):
    for v in (None, "", "  ", "NONE", "none", "{}", "[]", "''", "| |", ";;;;", "[null]", '{"A": {}}'):
        assert packed.split_value(v, model, FIRM) == []
    assert packed.split_value("I felt calm ; ; I need quiet", model, FIRM) == ["I felt calm", "I need quiet"]
    assert packed.split_value('"I heard ""you"" here"', model, FIRM) == ['I heard "you" here']
    assert packed.split_value(r'"I heard \"you\" here"', model, FIRM) == ['I heard "you" here']
    assert packed.split_value('I heard "you are" in it', model, FIRM) == ['I heard "you are" in it']
    long = " | ".join(["I felt calm " + "x" * 1000] * 300)
    assert len(packed.split_value(long, model, FIRM)) == 300


def test_frame(spark):
    rows = [(1, " | ".join(TEXTS[:2]), None, 0), (1, " | ".join(TEXTS[:2]), None, 0), (2, "NONE", json.dumps(TEXTS), 1), (3, None, "", 2)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, pos int")
    got = packed.split_packed(df, "row_id", ("a", "b"))
    assert got.columns == ["row_id", "field", "pos", "value_text"]
    assert sorted(map(tuple, got.collect())) == sorted([(1, "a", 0, TEXTS[0]), (1, "a", 1, TEXTS[1])] * 2 + [(2, "b", i, t) for i, t in enumerate(TEXTS)])
    assert packed.split_packed(df.where("false"), "row_id", ("a", "b")).count() == 0
