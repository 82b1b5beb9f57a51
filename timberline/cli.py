"""Command line: ``python -m timberline.cli COMMAND ...``.

    prepare      timeline JSON to the two flat CSVs
    pipeline     classification, profiles, retrieval and summaries of a folder of timelines
    evaluate     metrics of predictions (a3) or summaries (b)
    submission   the nested document of results (B) or timeline summaries (C)
    baselines    one summary per post or per timeline of a post CSV

Models are the offline stubs unless a backend factory is named as ``module:callable``; it is called once per
worker, with the model options that were given (``--model_path``, ``--n_ctx``, ``--embedding_model``, ...).
"""

from __future__ import annotations

import argparse
import functools
import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import schema as S
from timberline.functions import text as T
from timberline.models import interfaces as M
from timberline.operators import context, extract, metrics, profile, submission
from timberline.plans import pipeline
from timberline.session import importable, materialize
from timberline.sources import files


def _factory(name: str | None, default, **options):
    """The backend's factory; the stubs take no options."""
    if not name:
        return default
    module, _, attr = name.partition(":")
    make = getattr(importlib.import_module(module), attr)
    given = {k: v for k, v in options.items() if v is not None}
    return functools.partial(make, **given) if given else make


def _in_order(df: DataFrame) -> DataFrame:
    """``load_ord``: the place of each row. A multi-line file is read by one task, so numbers rise within it."""
    return df.withColumn("load_ord", F.struct(F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("row")))


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    p = extract.flatten_posts(files.read_timelines(spark, folder, ordered=True))
    return p.withColumn("post_key", F.concat_ws("/", "load_ord.file_path", F.lpad(F.col("load_ord.file_pos").cast("string"), 10, "0"), F.lpad(F.col("load_ord.pos").cast("string"), 10, "0")))


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    t = files.read_timelines(spark, args.data_files_location)
    files.write_csv(t.select("timeline_id", "timeline_summary"), args.timeline_output, "overwrite")
    p = t.select("timeline_id", F.explode("posts").alias("p"))
    state = lambda s: F.coalesce(F.to_json(F.col("p.evidence")[s]), F.lit(S.NONE))
    rows = p.select("timeline_id", "p.post_index", "p.post_id", F.col("p.date").alias("post_date"), "p.post", F.coalesce("p.`Post Summary`", F.lit(S.NONE)).alias("post_summary"), F.coalesce("p.`Well-being`", F.lit(S.NONE)).alias("well_being_score"), state("maladaptive-state").alias("maladaptive_evidence"), state("adaptive-state").alias("adaptive_evidence"))
    files.write_csv(rows, args.post_output, "overwrite")


def run_pipeline(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    cfg = pipeline.Config(args.retrieval_mode, args.alpha, args.context_window, not args.a3_no_context, args.cross_validate)
    stamp, out = files.timestamp(), {}
    posts = _posts(spark, args.data_dir)
    spans = extract.unpivot_spans(posts)
    ready = context.attach_context(posts, cfg.context_window, order="load_ord")
    ready = extract.eligible(pipeline.embed_posts(ready, _factory(args.embedder, M.HashEmbedder, model_name=args.embedding_model)), spans).drop("evidence")
    ready = materialize(ready, "posts")
    generator = _factory(args.generator, M.EchoGenerator, model_path=args.model_path, n_ctx=args.n_ctx, n_gpu_layers=args.n_gpu_layers)
    predicted = not args.skip_a3
    if predicted:
        spans = pipeline.classify_spans(spans, ready, cfg, generator)
        out["a3"] = files.write_document(files.prediction_rows(spans), os.path.join(args.output_dir, f"task_a3_predictions_{stamp}.json"), wrap="spans")
    profiled = pipeline.profiles(ready, spans, cfg, predicted)
    if args.verbose:
        profile.analyse(profiled).show(truncate=False)
    done = pipeline.summarize(profiled, spans, cfg, generator, predicted)
    if args.cross_validate:
        out["folds"] = os.path.join(args.output_dir, f"task_b_cv_folds_{stamp}")
        files.write_rows(done, out["folds"], by="timeline_id")
    name = "task_b_cv_results" if args.cross_validate else "task_b_results"
    out["b"] = files.write_document(done.orderBy("timeline_id", "post_index"), os.path.join(args.output_dir, f"{name}_{stamp}.json"))
    return out


def evaluate(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.task == "a3":
        path = files.evaluation_path(args.results, "a3")
        spans = files.read_predictions(spark, args.results)
        got = pipeline.evaluate_labels(spans)
        acc = {r["grp"]: r for r in got["accuracy"].collect()}
        got["report"].show(truncate=False)
        values = {"accuracy": acc["all"]["accuracy"], "macro_f1": got["macro_f1"].collect()[0]["macro_f1"], **{f"accuracy_{p}": acc[p]["accuracy"] if p in acc else None for p in S.POLARITIES}, "n_spans": acc["all"]["n"], "n_unknown": acc["all"]["n_unknown"]}
        return files.write_evaluation(values, path, args.results)
    scorer = _factory(args.scorer, None, device=args.device, batch_size=args.batch_size)
    if args.mode.startswith("baseline"):
        col = "task_b_baseline_official_summaries" if args.mode == "baseline_official" else "task_b_baseline_blue_team_summaries"
        rows = files.read_csv(spark, args.results, f"{S.POST_CSV}, {col} string").where(f"post_summary <> 'NONE' and {col} is not null")
        per_row = metrics.scored_pair_metrics(rows, "post_id", col, "post_summary", None, scorer) if scorer else metrics.pair_metrics(rows, "post_id", col, "post_summary")
        means = metrics.corpus_means(per_row).collect()[0].asDict()
        return files.write_evaluation({"mode": args.mode, "task_b": means}, files.baseline_evaluation_path(args.results), args.results)
    path = files.evaluation_path(args.results, "b")
    rows = files.read_results(spark, args.results).withColumn("key", F.concat_ws("/", "timeline_id", "post_index"))
    modes = ("zero_shot", "one_shot") if args.mode == "both" else (args.mode,)
    values = {m: pipeline.evaluate_summaries(rows, "key", m, scorer).collect()[0].asDict() for m in modes}
    if args.mode == "both":
        pipeline.compare_modes(rows, "key", scorer).show(truncate=False)
    return files.write_evaluation({"mode": args.mode, **values}, path, args.results)


def write_submission(spark: SparkSession, args: argparse.Namespace) -> str:
    """One nested document of all timelines. Of repeated posts and results the last one read counts.

    With ``--csv_format yes`` results are a CSV with post ids, and posts without a result are left out.
    """
    keys = ["timeline_id", "post_index"]
    posts = _in_order(files.read_csv(spark, args.posts, S.POST_CSV)).select(*keys, "post_id", "load_ord")
    posts = extract.latest(posts, keys, "load_ord")
    posts = extract.latest(posts.where("post_id is not null"), ["timeline_id", "post_id"], "load_ord")
    blank = {"adaptive_evidence": F.array().cast("array<string>"), "maladaptive_evidence": F.array().cast("array<string>"), "wellbeing_score": F.lit(None).cast("double")}
    column = args.model_name or f"{args.mode}_summary"
    bare = posts.select("timeline_id").distinct().withColumn("summary", F.lit(""))
    if args.task == "C" and args.csv_format == "yes":
        raise NotImplementedError("timeline summaries have no CSV form")
    if args.task == "B" and args.csv_format == "yes":
        rows = _in_order(spark.read.options(**files.CSV_OPTIONS).csv(args.results))
        res = extract.latest(rows.select("post_id", F.col(column).alias("summary"), "load_ord"), ["post_id"], "load_ord").drop("load_ord")
        n = res.join(posts, "post_id", "left_anti").count()
        doc = submission.submission(posts.join(res, "post_id").withColumns(blank), bare)
    elif args.task == "B":
        rows = _in_order(files.read_results(spark, args.results, f"{S.RESULTS}, {column} string" if f"{column} " not in S.RESULTS else S.RESULTS))
        res = extract.latest(rows.select(*keys, F.col(column).alias("summary"), "load_ord"), keys, "load_ord").drop("load_ord")
        n = submission.orphans(res, posts, keys).count()
        doc = submission.submission(submission.fill_results(posts, res, keys, "summary").withColumns(blank), bare)
    else:
        rows = _in_order(files.read_task_c(spark, args.results))
        res = extract.latest(rows.select("timeline_id", F.col("predicted_summary").alias("summary"), "load_ord"), ["timeline_id"], "load_ord").drop("load_ord")
        n = posts.select("timeline_id").distinct().join(res, "timeline_id", "left_anti").count()
        doc = submission.submission(posts.withColumns({"summary": F.lit(""), **blank}), res)
    if n:
        print(f"{n} {'timelines have no prediction' if args.task == 'C' else 'results belong to no post'}")
    return files.write_object(doc, "timeline_id", "document", args.output)


def baselines(spark: SparkSession, args: argparse.Namespace) -> str:
    """A column (per post) or a table (per timeline, in order of first appearance) of baseline summaries."""
    posts = _in_order(files.read_csv(spark, args.post_csv_location, S.POST_CSV))
    make = _factory(args.generator, M.EchoGenerator, model_path=args.model_path)
    stem = args.post_csv_location.rstrip("/").removesuffix(".csv")
    blue = args.variant == "blue"
    team = "blue_team" if blue else "official"
    if args.level == "post":
        out = pipeline.baseline_posts(posts, make, json_mode=blue).orderBy("load_ord").drop("load_ord").withColumnRenamed("baseline_summary", f"task_b_baseline_{team}_summaries")
    else:
        whole = pipeline.timeline_texts(posts, "load_ord").select("timeline_id", "first_row", F.col("text").alias("post"))
        out = pipeline.baseline_posts(whole, make, json_mode=blue, whole_timeline=True).orderBy("first_row").select("timeline_id", F.col("baseline_summary").alias(f"task_c_baseline_{team}_summaries"))
    name = f"{stem}_task_{'b' if args.level == 'post' else 'c'}_{args.variant}_baseline.csv"
    files.write_csv(out, name, "overwrite")
    return name


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="timberline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("--data_files_location", required=True)
    a.add_argument("--timeline_output", default="timeline_data.csv")
    a.add_argument("--post_output", default="post_data.csv")
    a.set_defaults(run=prepare)
    a = sub.add_parser("pipeline")
    a.add_argument("--data_dir", required=True)
    a.add_argument("--output_dir", default="./outputs")
    a.add_argument("--retrieval_mode", default="hybrid")
    a.add_argument("--alpha", type=float, default=0.5)
    a.add_argument("--context_window", type=int, default=2)
    a.add_argument("--a3_no_context", action="store_true")
    a.add_argument("--skip_a3", action="store_true")
    a.add_argument("--cross_validate", action="store_true")
    a.add_argument("--generator")
    a.add_argument("--embedder")
    a.add_argument("--model_path")
    a.add_argument("--n_ctx", type=int, default=16384)
    a.add_argument("--n_gpu_layers", type=int, default=-1)
    a.add_argument("--embedding_model")
    a.add_argument("--verbose", action="store_true", default=True)
    a.set_defaults(run=run_pipeline)
    a = sub.add_parser("evaluate")
    a.add_argument("--task", choices=("a3", "b"), required=True)
    a.add_argument("--results", required=True)
    a.add_argument("--mode", choices=("zero_shot", "one_shot", "both", "baseline_official", "baseline_blue"), default="both")
    a.add_argument("--scorer")
    a.add_argument("--device")
    a.add_argument("--batch_size", type=int)
    a.set_defaults(run=evaluate)
    a = sub.add_parser("submission")
    a.add_argument("--task", choices=("B", "C"), required=True)
    a.add_argument("--results", required=True)
    a.add_argument("--posts", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--mode", choices=("zero_shot", "one_shot"), default="one_shot")
    a.add_argument("--model_name")
    a.add_argument("--csv_format", choices=("yes", "no"), default="no")
    a.set_defaults(run=write_submission)
    a = sub.add_parser("baselines")
    a.add_argument("--post_csv_location", required=True)
    a.add_argument("--level", choices=("post", "timeline"), default="post")
    a.add_argument("--variant", choices=("official", "blue"), default="official")
    a.add_argument("--generator")
    a.add_argument("--model_path")
    a.set_defaults(run=baselines)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("timberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    importable(spark)
    return args.run(spark, args)


if __name__ == "__main__":
    main()
