"""Searches, protocols, sources and commands, each against loops or planted files."""

import itertools
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyframe import cli, settings
from steadyframe.operators import audit, detection, ratings, registry, rerank, temporal, trajectory
from steadyframe.sources import files

CAND = "segment_id string, frame_idx long, candidate_rank int, score double, x1 double, y1 double, x2 double, y2 double, gt_x1 double, gt_y1 double, gt_x2 double, gt_y2 double"


def candidates(spark, seed, segments=2, frames=5, most=4):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(segments):
        for f in sorted(rng.choice(20, frames, replace=False).tolist()):
            g = [float(v) for v in (20 + f, 30, 60 + f, 70)]
            scores = sorted(rng.random(rng.integers(1, most + 1)).tolist(), reverse=True)
            for k, score in enumerate(scores, 1):
                b = [float(v + d) for v, d in zip(g, rng.normal(0, 9, 4))]
                rows.append((f"s{s}", f, k, score, *b, *g))
    return spark.createDataFrame(rows, CAND)


def gain(a, b, gap, w):
    """What a step from one box to the next adds, by its definition."""
    side = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    size = lambda r: max(max(1e-6, r[2] - r[0]) * max(1e-6, r[3] - r[1]), 1e-6)
    move = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    overlap = both / max(side(a) + side(b) - both, 1e-12) / math.sqrt(gap)
    return w.overlap * overlap - w.motion * move / max(math.sqrt(size(a)) * gap, 1e-6) - w.scale * abs(math.log(size(b) / size(a))) / gap


def best_by_all_paths(rows, w):
    frames = [list(g) for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.frame_idx, r.candidate_rank)), key=lambda r: r.frame_idx)]
    box = lambda r: (r.x1, r.y1, r.x2, r.y2)

    def total(path):
        own = sum(w.confidence * math.log(min(max(r.score, 1e-8), 1.0)) for r in path)
        return own + sum(gain(box(a), box(b), max(1, b.frame_idx - a.frame_idx), w) for a, b in zip(path, path[1:]))

    return max(itertools.product(*[f[: w.top_k] for f in frames]), key=total)


def test_paths_are_the_best_of_all(spark):
    df = candidates(spark, 1)
    weights = [temporal.Weights(), temporal.FRAMEWISE, temporal.Weights(3, 0.5, 4.0, 0.3, 0.1), temporal.Weights(2, 1.0, 0.5, 0.15, 0.0)]
    got = temporal.select_paths(df, weights, ["candidate_rank"]).collect()
    rows = df.collect()
    for k, w in enumerate(weights):
        for s in ("s0", "s1"):
            want = best_by_all_paths([r for r in rows if r.segment_id == s], w)
            own = sorted((r.frame_idx, r.candidate_rank) for r in got if r.param_id == k and r.segment_id == s)
            assert own == [(r.frame_idx, r.candidate_rank) for r in want]


def test_long_segments_go_by_stretches(spark):
    """Stretches of one and of seven frames choose what one task would, also among equal candidates and after gaps."""
    rng, rows = random.Random(1), []
    for seg in ("A", "B"):
        for f in (f for f in range(60) if rng.random() > 0.2 and not 20 < f < 40):
            for k in range(rng.randint(1, 6)):
                x, y = rng.choice([0.0, 10.0, 40.0]), rng.choice([0.0, 20.0, 60.0])
                rows.append((seg, f, rng.choice([0.3, 0.5, 0.5, 0.9]), x, y, x + rng.choice([20.0, 30.0]), y + 25.0, k))
    df = spark.createDataFrame(rows, "segment_id string, frame_idx long, score double, x1 double, y1 double, x2 double, y2 double, k1 int")
    weights = [temporal.Weights(), temporal.Weights(3, 0.5, 1.0, 0.3, 0.1), temporal.FRAMEWISE]
    whole, by_one, by_seven = (sorted(map(tuple, temporal.select_paths(df, weights, ["k1"], stretch).collect())) for stretch in (10_000, 1, 7))
    assert whole == by_one == by_seven
    assert temporal.select_paths(df.where("false"), weights, ["k1"]).collect() == []


def test_many_weights_in_parts():
    rng = np.random.default_rng(5)
    frame, score, box = np.repeat(np.arange(40), 3), rng.random(120), rng.random((120, 4)) * 50
    trellis = temporal.Trellis(frame, score, box)
    weights = temporal.grid()
    assert (trellis.paths(weights)[::29] == np.concatenate([trellis.paths([w]) for w in weights[::29]])).all()


def operating_points(selected):
    out = []
    for t in detection.thresholds(0.01, 0.99, 99):
        tp = sum(s >= t and i >= 0.5 for s, i in selected)
        fp = sum(s >= t and i < 0.5 for s, i in selected)
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / len(selected)
        out.append((2 * p * r / (p + r) if p + r else 0.0, p, -t))
    return max(out)


def test_grid_search_and_winner(spark):
    df = candidates(spark, 2, segments=3, frames=6)
    rows = detection.with_iou(df).collect()
    weights = temporal.grid()[::13]
    want = {}
    for k, w in enumerate(weights):
        chosen = [r for s in ("s0", "s1", "s2") for r in best_by_all_paths([x for x in rows if x.segment_id == s], w)]
        f1, precision, t = operating_points([(r.score, r.iou) for r in chosen])
        want[k] = (f1, np.mean([r.iou for r in chosen]), precision, -t)
    got = {r.param_id: (r.f1, r.mean_iou, r.precision, r.threshold) for r in temporal.grid_search(df, weights, ["candidate_rank"]).collect()}
    assert all(np.allclose(got[k], want[k]) for k in want) and len(got) == len(want)
    best, threshold, trials = temporal.tune(df, weights, ["candidate_rank"])
    first = max(range(len(weights)), key=lambda k: (round(want[k][0], 9), round(want[k][1], 9), round(want[k][2], 9), -k))
    assert best == weights[first] and threshold == want[first][3]
    order = [(r.f1, r.mean_iou) for r in trials.collect()]
    assert order == sorted(order, reverse=True)
    summary = temporal.summarize(df, df, best, threshold, ["candidate_rank"]).collect()
    assert {(r.split, r.method) for r in summary} == set(itertools.product(("val", "test"), ("framewise", "path"))) and all(r.frames == 18 for r in summary)


def test_learning_protocol(spark):
    val, test = candidates(spark, 3, 3, 12), candidates(spark, 4, 2, 9)
    chosen, applied, threshold, summary = rerank.learn(val, test, ["candidate_rank"], folds=3, trees=3)
    assert chosen.count() == 36 and applied.count() == 18 and applied.select("segment_id", "frame_idx").distinct().count() == 18
    rows = {r.split: r for r in summary.collect()}
    assert rows["val"].frames == 36 and rows["test"].frames == 18 and rows["test"].threshold == threshold
    own = detection.with_iou(applied).collect()
    assert abs(rows["test"].mean_iou - np.mean([r.iou for r in own])) < 1e-9
    assert operating_points([(r.score, r.iou) for r in detection.with_iou(chosen).collect()])[2] == -threshold


def test_places_and_running_sums_by_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(g, int(v), k) for g in "ab" for k, v in enumerate(rng.integers(0, 40, 300))]
    df = detection.value_ranges(spark.createDataFrame(rows, "g string, v int, k int"), ["g"], "v", 8)
    assert df.select("__b").distinct().count() > 4
    for r in detection.places(df, ["g"], "v", ["k"]).collect():
        assert (r["__r"], r["__n"]) == (1 + sum((v, k) < (r.v, r.k) for g, v, k in rows if g == r.g), 300)
    for r in detection.running_sums(df, ["g"], "v", {"s": "k"}).collect():
        assert r.s == sum(k for g, v, k in rows if g == r.g and v >= r.v)
    for r in detection.falling_max(df.withColumn("x", F.col("k").cast("double")), ["g"], "v", "x").collect():
        assert r.x == max(k for g, v, k in rows if g == r.g and v <= r.v)


# --- splits and metadata

MANIFEST = [("A", "A_1", k, k, "train") for k in range(60)] + [("B", "B_1", 100 + k, k, "val") for k in range(10)]


def manifest(spark):
    return spark.createDataFrame(MANIFEST, "case_id string, segment_id string, image_id long, frame_idx long, split string")


def test_smoke_split(spark):
    got = audit.smoke_split(manifest(spark).drop("split"), most=24).collect()
    n = {s: sum(r.split == s for r in got) for s in ("smoke_val", "smoke_train", "unused")}
    assert n == {"smoke_val": 6, "smoke_train": 28, "unused": 36}
    assert {r.frame_idx for r in got if r.segment_id == "A_1" and r.split != "unused"} == set(np.linspace(0, 59, 24, dtype=int).tolist())
    again = audit.smoke_split(manifest(spark).drop("split").repartition(5), most=24).collect()
    assert {(r.image_id, r.split) for r in got} == {(r.image_id, r.split) for r in again}


def test_assign_splits_rules(spark):
    rules = {"seed": 42, "test": 0.15, "val": 0.15, "minimum_cases": 2, "segment_holdout": {"train": ["A_1"], "val": [], "test": ["B_1"]}}
    df = manifest(spark).drop("split")
    with pytest.raises(ValueError):
        audit.assign_splits(df, rules, smoke=True, segment_holdout=True)
    with pytest.raises(ValueError):
        audit.assign_splits(df, rules | {"minimum_cases": 3})
    held = {(r.segment_id, r.split) for r in audit.assign_splits(df, rules, segment_holdout=True).collect()}
    assert held == {("A_1", "train"), ("B_1", "test")}
    assert {r.split for r in audit.assign_splits(df, rules, smoke=True).collect()} == {"smoke_val", "smoke_train", "unused"}
    assert {r.split: r.images for r in audit.images_per_split(manifest(spark)).collect()} == {"train": 60, "val": 10}


def test_complete_join(spark):
    labelled = spark.createDataFrame([("s", 1), ("s", 2)], "segment_id string, frame_idx long")
    decoded = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")], "segment_id string, frame_idx long, image string")
    assert audit.complete_join(labelled, decoded, ["segment_id", "frame_idx"]).count() == 2
    with pytest.raises(ValueError, match="not decoded"):
        audit.complete_join(labelled, decoded.where("frame_idx < 2"), ["segment_id", "frame_idx"])


def test_run_metadata_throughput_and_first_video(spark):
    r = audit.run_metadata(manifest(spark), "train", "val").first()
    assert (r.train_cases, r.val_cases, r.independent, r.experiment_type, r.formal_result) == (["A"], ["B"], True, "case_holdout", True)
    mixed = manifest(spark).withColumn("case_id", F.lit("A"))
    assert audit.run_metadata(mixed, "train", "val").first().experiment_type == "single_case_segment_holdout"
    assert audit.run_metadata(mixed, "train", "val", smoke=True).first().experiment_type == "smoke"
    rates = spark.createDataFrame([(10, 2.0), (10, 0.0)], "n long, s double").select(audit.throughput(F.col("n"), F.col("s")).alias("r")).collect()
    assert [x.r for x in rates] == [5.0, 0.0]
    videos = spark.createDataFrame([("c", "x", "x", True), ("b", "x", "x_1", True), ("a", "x", "x_2", False)], "path string, case_id string, segment_id string, readable boolean")
    assert audit.first_ready_video(videos).first().path == "b"


# --- sources and sinks


def test_label_folders(spark, tmp_path):
    for name in ("VID001_Bseg", "CH2001", "notes"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.txt").write_text("0,1,.5,.5,.1,.1\n")
    (tmp_path / "VID001_Bseg" / "2.txt").write_text("\n")
    got = [(r.set_name, r.files) for r in files.label_folders(spark, str(tmp_path), ["CH2001", "absent"]).collect()]
    assert got == [("CH2001", 1), ("VID001_Bseg", 2)]


def test_logs_and_named_documents(spark, tmp_path):
    stats = [[0.1] * 12, [0.3] + [0.1] * 11]
    (tmp_path / "log.txt").write_text("\n\n".join(json.dumps({"epoch": k, "test_coco_eval_bbox": s}) for k, s in enumerate(stats)) + "\n")
    log = files.read_training_log(spark, str(tmp_path / "log.txt"))
    assert registry.best_epoch(log).first().epoch == 1 and log.count() == 2
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        files.read_training_log(spark, str(tmp_path / "none.txt"))
    for name in ("val", "test"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_metrics.json").write_text('{"map": NaN}' if name == "val" else '{"map": 0.5}')
    by = lambda k: {r.name: r.map for r in files.read_json_by_name(spark, f"{tmp_path}/*/*_metrics.json", "map double", k).collect()}
    assert by("file") == {"val_metrics": None, "test_metrics": 0.5} and by("folder") == {"val": None, "test": 0.5}


def test_probe(spark):
    def probe(path):
        if path == "bad":
            raise OSError("no such video")
        stream = {"width": 4, "height": 3, "avg_frame_rate": "30000/1001", "nb_frames": "90"}
        return json.dumps({"streams": [stream], "format": {"duration": "3.0"} if path == "good" else {}})

    videos = spark.createDataFrame([("good",), ("bad",), ("short",)], "path string")
    got = {r.path: r for r in files.probe_videos(videos, probe).collect()}
    assert got["good"].readable and got["good"].frame_count == 90 and abs(got["good"].fps - 29.97) < 0.01
    assert not got["bad"].readable and got["bad"].error == "no such video" and not got["short"].readable and got["short"].width is None


def test_sinks(spark, tmp_path):
    files.write_template(spark, ["b", "a"], str(tmp_path / "t"))
    files.write_template(spark, ["z"], str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a,b"
    images = spark.createDataFrame([("train", 1, "f", 2, 2, "S", 1), ("unused", 2, "f", 2, 2, "S", 2), ("train", 3, "f", 2, 2, "T", 1)], "split string, image_id long, file_name string, width int, height int, segment_id string, frame_idx long")
    notes = spark.createDataFrame([("train", 1, 1, [0.0] * 4, 1.0), ("train", 2, 3, [0.0] * 4, 1.0)], "split string, annotation_id long, image_id long, bbox array<double>, area double")
    parts = {r.segment_id: (len(r.images), len(r.annotations)) for r in audit.coco_documents(images, notes, per_segment=True).collect()}
    assert parts == {"S": (1, 1), "T": (1, 1)}
    files.write_coco(audit.coco_documents(images, notes), str(tmp_path / "coco"))
    back = spark.read.json(str(tmp_path / "coco")).first()
    assert back.split == "train" and len(back.images) == 2
    files.write_document(files.records(images.orderBy("image_id").limit(1)), str(tmp_path / "new" / "r.json"))
    assert json.loads((tmp_path / "new" / "r.json").read_text())[0]["image_id"] == 1
    with pytest.raises(ValueError):
        files.records(images, most=2)
    files.write_csv(images.repartition(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    text = registry.report_markdown("T", {"A": [{"x": "a|b", "y": 1}], "B": []})
    assert "| a\\|b | 1 |" in text and text.startswith("# T")


# --- settings and commands


def test_settings(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"project_root": "..", "label_dir": "/abs", "class_names": {"3": "Hook"}, "metrics": {"center_radius": 0.3}}))
    s = settings.load(str(tmp_path / "p.json"))
    assert s["class_names"] == {3: "Hook"} and s["metrics"]["center_radius"] == 0.3 and s["metrics"]["confidence_threshold"] == 0.53
    assert s["label_dir"] == "/abs" and s["data_dir"] == str(tmp_path.parent / "data") and settings.DEFAULTS["class_names"] == {0: "Harmonic0"}


def test_commands(spark, tmp_path):
    tracks = "case_id,segment_id,video_id,frame_idx,time_s,track_id,class_id,class_name,confidence,x1,y1,x2,y2,frame_width,frame_height\n"
    tracks += "".join(f"C,S,V,{k},{k / 5},1,0,Harmonic0,0.9,{k},10,{k + 20},40,100,100\n" for k in range(12))
    (tmp_path / "tracks.csv").write_text(tracks)
    out = str(tmp_path / "m.parquet")
    assert cli.run(spark, ["metrics", "--tracks", str(tmp_path / "tracks.csv"), "--output", out]) == out
    assert spark.read.parquet(out).first().frame_count == 12
    assert cli.run(spark, ["report", "--metrics", out, "--output", str(tmp_path / "r")]) and (tmp_path / "r" / "report.md").exists()
    for name, seed in (("val", 7), ("test", 8)):
        candidates(spark, seed, 1, 4, 3).write.parquet(str(tmp_path / f"{name}.parquet"))
    pair = ["--validation-candidates", str(tmp_path / "val.parquet"), "--test-candidates", str(tmp_path / "test.parquet")]
    summary = cli.run(spark, ["temporal-evaluate", *pair, "--output", str(tmp_path / "t")])
    assert len(summary["splits"]) == 4 and spark.read.parquet(str(tmp_path / "t" / "trials.parquet")).count() == 144
    where = str(tmp_path / "registry")
    for n, name in enumerate(("one", "two", "one"), 1):
        assert cli.run(spark, ["register-experiment", "--name", name, "--architecture", "a", "--checkpoint", "c", "--registry", where]) == {"version": n}
    version, known = registry.latest(spark, where)
    assert version == 3 and sorted(r.name for r in known.collect()) == ["one", "two"]
    with pytest.raises(SystemExit):
        cli.run(spark, ["nothing"])


def test_all_commands_in_a_row(spark, tmp_path):
    """The audit joins labels with the containers' own figures, errors are analysed, and the report is named after what the results allow."""
    (tmp_path / "data" / "label" / "VID001_Bseg").mkdir(parents=True)
    (tmp_path / "data" / "video").mkdir()
    for k in range(3):
        (tmp_path / "data" / "label" / "VID001_Bseg" / f"{k:06d}.txt").write_text("0,7,0.5,0.5,0.2,0.1\n" if k else "0,0,1.5,0.5,0.2,0.1\n")
    (tmp_path / "data" / "video" / "VID001_B_5fps.mp4").write_bytes(b"\0\0\0\x08free")
    (tmp_path / "p.json").write_text("{}")
    (tmp_path / "e.json").write_text('{"map": 0.3, "map_50": 0.6}')
    tracks = "case_id,segment_id,video_id,frame_idx,time_s,track_id,class_id,class_name,confidence,x1,y1,x2,y2,frame_width,frame_height\n"
    (tmp_path / "tracks.csv").write_text(tracks + "".join(f"C,S,V,{k},{k / 5},1,0,Harmonic0,0.9,{k},10,{k + 20},40,100,100\n" for k in range(12)))
    for name, seed in (("val", 7), ("test", 8)):
        candidates(spark, seed, 1, 4, 3).write.parquet(str(tmp_path / f"{name}.parquet"))
    pair = ["--validation-candidates", str(tmp_path / "val.parquet"), "--test-candidates", str(tmp_path / "test.parquet")]
    said = cli.run(spark, ["--config", str(tmp_path / "p.json"), "run-all", "--tracks", str(tmp_path / "tracks.csv"), *pair, "--evaluation", str(tmp_path / "e.json"), "--independent", "--output", str(tmp_path / "out")])
    assert list(said) == ["audit", "metrics", "analyze-errors", "temporal-evaluate", "learned-rerank", "report"]
    assert said["audit"] == {"video_count": 1, "readable_video_count": 0, "label_file_count": 3, "ready_label_file_count": 0, "error_count": 1}
    assert spark.read.parquet(str(tmp_path / "out" / "audit" / "label_sets.parquet")).first().status == "excluded_missing_or_corrupt_video"
    errors = said["analyze-errors"]
    assert sum(errors["test_error_counts"].values()) == 4 and sum(g["n"] for g in errors["test_group_diagnostics"]) == 12
    images = spark.read.parquet(str(tmp_path / "out" / "analyze-errors" / "per_image.parquet")).collect()
    tops = [(r.top_score, r.top_iou) for r in images if r.split == "validation"]
    t = errors["threshold_selected_on_validation"]
    assert len(tops) == 4 and errors["validation_top1_iou50"]["tp"] == sum(s >= t and i >= 0.5 for s, i in tops)
    assert (tmp_path / "out" / "report" / "report.md").read_text().startswith("# Formal evaluation")


def test_registry_loses_none_of_two_writers(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "registry")
    new = lambda name: registry.record(spark, name, "a", "c", {"val": {"map": 0.5}})
    assert registry.latest(spark, where) == (0, None)
    registry.register(spark, where, new("first"))
    read, late = registry.latest, []

    def slow(session, folder):  # another writer commits between this one's read and its commit
        found = read(session, folder)
        if not late:
            late.append(True)
            registry.register(spark, where, new("other"))
        return found

    monkeypatch.setattr(registry, "latest", slow)
    assert registry.register(spark, where, new("mine")) == 3
    assert sorted(r.name for r in read(spark, where)[1].collect()) == ["first", "mine", "other"]
    assert len([x for x in os.listdir(where) if x.startswith("table-")]) == 3


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a", 1)], "segment_id string, frame_idx long")
    for call in (
        lambda: temporal.select_paths(df, [temporal.Weights()], ["k"]),
        lambda: trajectory.legacy_metrics(df),
        lambda: ratings.icc_2_1(df, "salas_total"),
        lambda: ratings.mean_ratings(df),
    ):
        with pytest.raises(ValueError, match="Missing .*columns"):
            call()
