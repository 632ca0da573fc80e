"""Command line: each command reads CSV or Parquet tables, runs one operator on Spark and writes its result beside a small JSON summary."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyframe import settings
from steadyframe.operators import audit, detection, ratings, registry, rerank, temporal, trajectory
from steadyframe.sources import files, mp4

CANDIDATES = (
    "split string, image_id long, segment_id string, frame_idx long, candidate_rank int, class_id int, score double, "
    "x1 double, y1 double, x2 double, y2 double, gt_x1 double, gt_y1 double, gt_x2 double, gt_y2 double"
)
MANIFEST = (
    "case_id string, segment_id string, frame_idx long, time_s double, image_id long, image_path string, source_label_path string, class_id int, "
    "class_name string, object_id int, cx double, cy double, box_width double, box_height double, split string"
)


def table(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV files, or one Parquet table."""
    return spark.read.parquet(paths[0]) if len(paths) == 1 and paths[0].rstrip("/").endswith(".parquet") else files.read_csv(spark, paths, schema)


def put(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path) if path.endswith(".parquet") else files.write_csv(df, path)
    return path


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="steadyframe", description="Camera-quality analytics on Spark")
    out.add_argument("--config")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for p in paths:
            one.add_argument(p, required=True)
        return one

    command("audit", "--output")
    command("sample-anomalies", "--manifest", "--output").add_argument("--samples-per-reason", type=int, default=4)
    split = command("split", "--manifest", "--output")
    split.add_argument("--smoke", action="store_true")
    split.add_argument("--segment-holdout", action="store_true")
    metrics = command("metrics", "--output")
    metrics.add_argument("--tracks", nargs="+", required=True)
    metrics.add_argument("--confidence-threshold", type=float)
    command("ratings", "--ratings", "--metrics", "--output")
    command("rating-template", "--output")
    command("temporal-evaluate", "--validation-candidates", "--test-candidates", "--output")
    learned = command("learned-rerank", "--validation-candidates", "--test-candidates", "--output")
    learned.add_argument("--trees", type=int, default=120)
    command("analyze-errors", "--validation-candidates", "--test-candidates", "--output")
    register = command("register-experiment", "--name", "--architecture", "--checkpoint", "--registry")
    register.add_argument("--metrics", help="glob of JSON files of numbers, one a split")
    register.add_argument("--notes", default="")
    report = command("report", "--metrics", "--output")
    report.add_argument("--evaluation", help="JSON file of the test split's detection metrics")
    whole = command("run-all", "--output")
    whole.add_argument("--tracks", nargs="+", required=True)
    for name in ("--ratings", "--validation-candidates", "--test-candidates", "--evaluation"):
        whole.add_argument(name)
    for one in (report, whole):
        one.add_argument("--smoke", action="store_true")
        one.add_argument("--independent", action="store_true", help="test cases are not among those trained on")
    return out


def run(spark: SparkSession, argv: list[str] | None = None) -> dict | str:
    """Run one command; what it gives is printed by ``main``."""
    a = parser().parse_args(argv)
    c = settings.load(a.config)
    pair = lambda: [table(spark, [p], CANDIDATES) for p in (a.validation_candidates, a.test_candidates)]
    ties = ["candidate_rank"]
    if a.command == "audit":
        lines = files.read_label_lines(spark, f"{c['label_dir']}/*/*.txt")
        case, segment = audit.identity(F.col("set_name"), "label", {k: tuple(v) for k, v in c["identity_overrides"]["labels"].items()})
        parsed = audit.parse_labels(lines.withColumns({"case_id": case, "segment_id": segment}), c["class_names"])
        sets = audit.label_sets(parsed.withColumn("path", F.col("set_name")))
        found = mp4.probe_containers(files.discover(spark, c["video_dir"])) if os.path.isdir(c["video_dir"]) else spark.createDataFrame([], mp4.PROBE)
        names = audit.identity(F.regexp_extract("path", r"([^/]+)$", 1), "video", {k: tuple(v) for k, v in c["identity_overrides"]["videos"].items()})
        videos = found.withColumns({"case_id": names[0], "segment_id": names[1]})
        errors = parsed.where("error is not null")
        put(videos, os.path.join(a.output, "videos.parquet"))
        put(errors, os.path.join(a.output, "errors.parquet"))
        checked = put(audit.audit(sets, videos).withColumn("object_ids", F.to_json("object_ids")), os.path.join(a.output, "label_sets.parquet"))
        summary = audit.audit_summary(spark.read.parquet(checked), videos, errors).first().asDict()
        files.write_document(summary, os.path.join(a.output, "summary.json"))
        return summary
    if a.command == "sample-anomalies":
        rows = table(spark, [a.manifest], MANIFEST).withColumns({"width": F.col("box_width"), "height": F.col("box_height")})
        return put(audit.anomalies(audit.scored(rows), a.samples_per_reason), a.output)
    if a.command == "split":
        manifest = table(spark, [a.manifest], MANIFEST).drop("split")
        done = audit.assign_splits(manifest, c["split"] | {"seed": c["seed"]}, a.smoke, a.segment_holdout)
        put(done, a.output)
        return {r["split"]: r["images"] for r in audit.images_per_split(done).collect()}
    if a.command == "metrics":
        chosen = c["metrics"] if a.confidence_threshold is None else c["metrics"] | {"confidence_threshold": a.confidence_threshold}
        return put(trajectory.segment_metrics(table(spark, a.tracks, files.TRACKS), trajectory.Settings(**chosen)).orderBy(*trajectory.KEYS), a.output)
    if a.command == "ratings":
        scores = table(spark, [a.ratings], files.RATINGS)
        found = spark.read.parquet(a.metrics) if a.metrics.endswith(".parquet") else files.without_nan(spark.read.option("header", True).option("inferSchema", True).csv(a.metrics))
        rows = ratings.feature_score_rows(found, scores)
        put(ratings.spearman(rows), a.output)
        return {s: files.records(ratings.icc_2_1(scores, s)) for s in ratings.SCORES}
    if a.command == "rating-template":
        files.write_template(spark, ratings.rating_template(spark).columns, a.output)
        return a.output
    if a.command == "temporal-evaluate":
        validation, test = pair()
        weights, threshold, trials = temporal.tune(validation, temporal.grid(), ties)
        put(trials, os.path.join(a.output, "trials.parquet"))
        for split, rows in (("val", validation), ("test", test)):
            put(temporal.select_paths(rows, [weights], ties), os.path.join(a.output, f"selected_{split}.parquet"))
        summary = {"parameters": asdict(weights), "threshold": threshold, "splits": files.records(temporal.summarize(validation, test, weights, threshold, ties))}
        files.write_document(summary, os.path.join(a.output, "summary.json"))
        return summary
    if a.command == "learned-rerank":
        validation, test, threshold, summary = rerank.learn(*pair(), ties, trees=a.trees)
        put(validation.select(*[x for x in validation.columns if x not in rerank.FEATURES]), os.path.join(a.output, "selected_val_oof.parquet"))
        put(test.select(*[x for x in test.columns if x not in rerank.FEATURES]), os.path.join(a.output, "selected_test.parquet"))
        files.write_document(found := files.records(summary), os.path.join(a.output, "summary.json"))
        return {"threshold": threshold, "splits": found}
    if a.command == "analyze-errors":
        images, sweep, summary = detection.analyze_errors(*pair(), ["segment_id", "frame_idx"], ties)
        put(images, os.path.join(a.output, "per_image.parquet"))
        put(sweep, os.path.join(a.output, "validation_threshold_sweep.parquet"))
        files.write_document(summary, os.path.join(a.output, "summary.json"))
        return summary
    if a.command == "run-all":
        at = lambda name: os.path.join(a.output, name)
        config = ["--config", a.config] if a.config else []
        steps = [["audit", "--output", at("audit")]] if os.path.isdir(c["label_dir"]) else []
        steps += [["metrics", "--tracks", *a.tracks, "--output", at("metrics.parquet")]]
        steps += [["ratings", "--ratings", a.ratings, "--metrics", at("metrics.parquet"), "--output", at("correlations.parquet")]] if a.ratings else []
        if a.validation_candidates and a.test_candidates:
            both = ["--validation-candidates", a.validation_candidates, "--test-candidates", a.test_candidates]
            steps += [[x, *both, "--output", at(x)] for x in ("analyze-errors", "temporal-evaluate", "learned-rerank")]
        more = [*(["--evaluation", a.evaluation] if a.evaluation else []), *(["--smoke"] if a.smoke else []), *(["--independent"] if a.independent else [])]
        steps += [["report", "--metrics", at("metrics.parquet"), "--output", at("report"), *more]]
        return {step[0]: run(spark, [*config, *step]) for step in steps}
    if a.command == "register-experiment":
        found = files.records(files.read_json_by_name(spark, a.metrics, "map double, map_50 double, map_75 double")) if a.metrics else []
        metrics = {r["name"].removesuffix("_metrics"): {k: v for k, v in r.items() if k != "name" and v is not None} for r in found}
        new = registry.record(spark, a.name, a.architecture, a.checkpoint, metrics, a.config, a.notes)
        return {"version": registry.register(spark, a.registry, new)}
    rows = files.records(spark.read.parquet(a.metrics)) if a.metrics.endswith(".parquet") else files.records(spark.read.option("header", True).csv(a.metrics))
    gate = registry.quality_gate(files.read_json_by_name(spark, a.evaluation, "map double, map_50 double")).first() if a.evaluation else None
    title = registry.report_title(a.smoke, bool(gate and gate["passes"]), a.independent)
    os.makedirs(a.output, exist_ok=True)
    for name, made in (("report.md", registry.report_markdown), ("report.html", registry.report_html)):
        with open(os.path.join(a.output, name), "w", encoding="utf-8") as f:
            f.write(made(title, {"Segments": rows}))
    return a.output


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("steadyframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    said = run(spark, argv)
    print(said if isinstance(said, str) else json.dumps(said, ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
