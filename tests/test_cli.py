import glob
import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from timberline import cli


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Sure:
    """A scorer that finds everything entailed."""

    def __init__(self, batch_size):
        assert batch_size == 4

    def score(self, premises, hypotheses):
        return np.array([[1.0, 0.0, 0.0]] * len(premises))


class Answer:
    def generate(self, prompts, max_tokens, temperature):
        return ['{"summary": "short"}' if p.endswith('"..."}') else p + "short" for p in prompts]


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for t in range(3):
        posts = [{"post_index": i, "post_id": f"t{t}p{i}", "post": f"Walked outside on day {i}. Felt calm, then \"tired\".\nSlept.", "date": "2024-01-01", "Post Summary": f"Calm on day {i}." if i else None, "Well-being": str(3 + i) if i else None, "evidence": {"adaptive-state": {"A": {"highlighted_evidence": "Felt calm", "Category": "Calm"}}, "maladaptive-state": {"D": {"highlighted_evidence": "tired"}} if i == 2 else {}}} for i in range(4)]
        (d / f"{t}.json").write_text(json.dumps({"timeline_id": f"t{t}", "timeline_summary": "s", "posts": posts}))
    return d


def test_whole_command_line(spark, folder, tmp_path, capsys):
    tl, po = str(tmp_path / "timeline_data.csv"), str(tmp_path / "post_data.csv")
    cli.main(["prepare", "--data_files_location", str(folder), "--timeline_output", tl, "--post_output", po], spark)
    from timberline import schema as S
    from timberline.sources import files

    rows = files.read_csv(spark, po, S.POST_CSV).collect()
    assert len(rows) == 12 and {r["post_summary"] for r in rows if r["post_index"] == 0} == {"NONE"} and all("\nSlept." in r["post"] for r in rows)
    out = str(tmp_path / "out")
    made = cli.main(["pipeline", "--data_dir", str(folder), "--output_dir", out], spark)
    spans = json.load(open(made["a3"]))["spans"]
    assert len(spans) == 12 and set(spans[0]) == {"text", "gold", "predicted", "polarity", "timeline_id", "post_index"}
    results = json.load(open(made["b"]))
    assert len(results) == 9 and all(r["retrieved_timeline"] != r["timeline_id"] for r in results)
    a3 = json.load(open(cli.main(["evaluate", "--task", "a3", "--results", made["a3"]], spark)))
    assert a3["n_spans"] == 12 and a3["source"].startswith("task_a3_predictions_")
    b = json.load(open(cli.main(["evaluate", "--task", "b", "--results", made["b"]], spark)))
    assert set(b) == {"source", "mode", "zero_shot", "one_shot"} and b["zero_shot"]["n_evaluated"] == 9
    with pytest.raises(ValueError):
        cli.main(["evaluate", "--task", "a3", "--results", str(tmp_path / "nameless.json")], spark)
    scored = json.load(open(cli.main(["evaluate", "--task", "b", "--results", made["b"], "--mode", "zero_shot", "--scorer", "test_cli:Sure", "--batch_size", "4"], spark)))
    assert scored["zero_shot"]["consistency"] == 1.0 and scored["zero_shot"]["contradiction"] == 0.0 and scored["zero_shot"]["evidence_alignment"] == 1.0 != b["zero_shot"]["consistency"]
    twice = tmp_path / "twice.json"  # a repeated result: the last one counts
    twice.write_text(json.dumps([*results, {**results[0], "one_shot_summary": "the last"}]))
    docs = json.load(open(cli.main(["submission", "--task", "B", "--results", str(twice), "--posts", po, "--output", str(tmp_path / "sub.json")], spark)))
    assert set(docs) == {"t0", "t1", "t2"} and set(docs["t0"]["post_level"]) == {f"t0p{i}" for i in range(4)}
    assert docs["t0"]["post_level"]["t0p0"] == {"adaptive_evidence": [], "maladaptive_evidence": [], "summary": "", "wellbeing_score": None} and docs["t0"]["timeline_level"] == {"summary": ""}
    first = results[0]
    assert docs[first["timeline_id"]]["post_level"][f"{first['timeline_id']}p{first['post_index']}"]["summary"] == "the last"
    by_id = tmp_path / "by_id.csv"
    by_id.write_text('post_id,mine\nt0p1,"one, two"\nt0p1,three\nt9p9,lost\n')
    docs = json.load(open(cli.main(["submission", "--task", "B", "--csv_format", "yes", "--model_name", "mine", "--results", str(by_id), "--posts", po, "--output", str(tmp_path / "sub2.json")], spark)))
    assert {k: {p: v["summary"] for p, v in d["post_level"].items()} for k, d in docs.items()} == {"t0": {"t0p1": "three"}, "t1": {}, "t2": {}}
    pred = tmp_path / "c.json"
    pred.write_text(json.dumps([{"timeline_id": "t0", "predicted_summary": "whole"}, {"timeline_id": "t7", "predicted_summary": "alone"}]))
    docs = json.load(open(cli.main(["submission", "--task", "C", "--results", str(pred), "--posts", po, "--output", str(tmp_path / "sub3.json")], spark)))
    assert docs["t0"]["timeline_level"]["summary"] == "whole" and len(docs["t0"]["post_level"]) == 4 and docs["t7"]["post_level"] == {}
    for level in ("post", "timeline"):
        for variant in ("official", "blue"):
            name = cli.main(["baselines", "--post_csv_location", po, "--level", level, "--variant", variant, "--generator", "test_cli:Answer"], spark)
            got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(name)
            assert got.count() == (12 if level == "post" else 3) and name.endswith(f"_{variant}_baseline.csv")
            assert {r[got.columns[-1]] for r in got.collect()} == {"short"}
            if level == "timeline":
                parts = [open(p).read().splitlines()[1:] for p in sorted(glob.glob(f"{name}/part-*"))]
                read = [r["timeline_id"] for r in cli._in_order(files.read_csv(spark, po, S.POST_CSV)).orderBy("load_ord").collect()]
                assert [line.split(",")[0] for p in parts for line in p] == list(dict.fromkeys(read))
    cli.main(["pipeline", "--data_dir", str(folder), "--output_dir", out, "--skip_a3", "--cross_validate", "--retrieval_mode", "semantic"], spark)
    assert any(n.startswith("task_b_cv_results_") for n in os.listdir(out)) and any(n.startswith("task_b_cv_folds_") for n in os.listdir(out))
    with pytest.raises(ValueError):
        cli.main(["pipeline", "--data_dir", str(folder), "--alpha", "2"], spark)
