"""Small hand-made inputs for every group of operators."""

import io
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadyframe.operators import audit, detection, ratings, registry, rerank, temporal, tracker, trajectory
from steadyframe.sources import files

SETTINGS = trajectory.Settings(confidence_threshold=0.25)
TRACKS = "case_id string, segment_id string, frame_idx long, time_s double, track_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, frame_width int, frame_height int"


def row(frame, box=(40.0, 40.0, 60.0, 60.0), conf=0.9, track=1, segment="VID001_B", fps=5.0):
    return ("VID001", segment, frame, frame / fps, track, "Harmonic0", conf, *(box or (None,) * 4), 100, 100)


def metrics(spark, rows, settings=SETTINGS):
    return trajectory.segment_metrics(spark.createDataFrame(rows, TRACKS), settings).first()


# --- trajectory


def test_still_and_centred(spark):
    m = metrics(spark, [row(k) for k in range(10)])
    assert (m.detection_rate, m.centered_rate_detected, m.trajectory_metrics_reliable) == (1, 1, True) and m.mean_center_distance < 1e-12 and m.mean_speed < 1e-12
    assert m.frame_count == 10 and abs(m.duration_s - 1.8) < 1e-12 and m.detection_gap_count == 0 and m.longest_detection_gap_s == 0


def test_a_missing_frame(spark):
    m = metrics(spark, [row(0), row(1, None, 0.0), row(2)])
    assert abs(m.detection_rate - 2 / 3) < 1e-12 and m.detection_gap_count == 1 and abs(m.longest_detection_gap_s - 0.2) < 1e-12


def test_a_brighter_stranger_is_ignored(spark):
    m = metrics(spark, [row(k) for k in range(5)] + [row(2, (0.0, 0.0, 10.0, 10.0), 0.99, 99)])
    assert m.centered_rate_detected == 1 and m.mean_center_distance < 1e-12


def test_no_track_ids_and_no_detections(spark):
    assert metrics(spark, [row(k, track=None) for k in range(3)]).dominant_track_coverage_rate == 1
    m = metrics(spark, [row(k, None, None) for k in range(3)])
    assert m.detection_rate == 0 and m.mean_speed is None and m.centered_rate_detected == 0 and m.out_of_view_rate == 0


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="track_id"):
        trajectory.kinematics(spark.createDataFrame([row(0)], TRACKS).drop("track_id"), SETTINGS)


def frames(spark, values, times=None):
    rows = [("c", "s", k, float(times[k] if times is not None else k / 5), v) for k, v in enumerate(values)]
    return trajectory.add_step(spark.createDataFrame(rows, "case_id string, segment_id string, frame_idx long, time_s double, x double"), SETTINGS)


def test_interpolation_is_that_of_pandas(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.55 else float(rng.random()) for _ in range(120)]
    got = [r.x_i for r in trajectory.interpolate(frames(spark, values), "x").orderBy("frame_idx").collect()]
    want = pd.Series(values, dtype=float).interpolate(limit=3, limit_area="inside")
    assert all((g is None and w != w) or abs(g - w) < 1e-12 for g, w in zip(got, want))


def test_gradient_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.integers(1, 4, 90)) / 5.0
    values = [None if rng.random() < 0.2 else float(rng.random()) for _ in range(90)]
    got = [r.d for r in trajectory.differentiate(frames(spark, values, times), {"d": "x"}).orderBy("frame_idx").collect()]
    want, k = [None] * 90, 0
    while k < 90:
        e = k
        while e < 90 and values[e] is not None:
            e += 1
        if e - k >= 2:
            want[k:e] = np.gradient(np.array(values[k:e]), times[k:e])
        k = max(e, k + 1)
    assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-9) for g, w in zip(got, want))


@pytest.mark.parametrize("fps", [5, 15])
def test_smoothing_fits_parabolas(spark, fps):
    xs = [0.1 + 0.01 * k + 0.002 * k * k for k in range(25)]
    got = trajectory.smooth(frames(spark, xs, [k / fps for k in range(25)]), "x").orderBy("frame_idx").collect()
    assert all(abs(r.x_s - x) < 1e-9 for r, x in zip(got, xs))
    noisy = [x + (-1) ** k * 0.1 for k, x in enumerate(xs)]
    width = 5 if fps == 5 else 9
    powers = np.vander(np.arange(width) - width // 2, 3).astype(float)
    h = powers @ np.linalg.pinv(powers)
    m = width // 2
    want = [h[k] @ noisy[:width] if k < m else h[width - 25 + k] @ noisy[-width:] if k >= 25 - m else h[m] @ noisy[k - m : k + m + 1] for k in range(25)]
    got = trajectory.smooth(frames(spark, noisy, [k / fps for k in range(25)]), "x").orderBy("frame_idx").collect()
    assert all(abs(r.x_s - w) < 1e-9 for r, w in zip(got, want))


def test_few_values_stay(spark):
    got = trajectory.smooth(frames(spark, [1.0, 5.0, 2.0, None, 4.0]), "x").orderBy("frame_idx").collect()
    assert [r.x_s for r in got] == [1.0, 5.0, 2.0, None, 4.0]


# --- selection and tracking

CAND = "segment_id string, frame_idx long, candidate_rank int, score double, x1 double, y1 double, x2 double, y2 double, k1 long"


def test_a_steady_path_beats_jumping_scores(spark):
    target, others = (10.0, 10.0, 30.0, 30.0), [(60.0, 60.0, 80.0, 80.0), (5.0, 60.0, 25.0, 80.0), (60.0, 5.0, 80.0, 25.0)]
    rows = [x for k in range(3) for x in (("S", k, 2, 0.8, *target, 1), ("S", k, 1, 0.9, *others[k], 2))]
    got = temporal.select_paths(spark.createDataFrame(rows, CAND), [temporal.Weights(5, 1.0, 2.0, 0.3, 0.1)], ["k1"]).collect()
    assert sorted((r.frame_idx, r.x1, r.temporal_rank) for r in got) == [(k, 10.0, 1) for k in range(3)]


def test_gaps_and_segments(spark):
    rows = [(s, f, 1, 0.8, 10.0, 10.0, 20.0, 20.0, 1) for s in "AB" for f in (0, 3)]
    got = temporal.select_paths(spark.createDataFrame(rows, CAND), [temporal.Weights()], ["k1"]).collect()
    assert sorted((r.segment_id, r.frame_idx) for r in got) == [("A", 0), ("A", 3), ("B", 0), ("B", 3)]


def test_neighbor_support(spark):
    rows = [("S", 0, 1, 0.8, 10.0, 10.0, 30.0, 30.0, 1), ("S", 1, 1, 0.8, 10.0, 10.0, 30.0, 30.0, 2), ("S", 0, 2, 0.7, 70.0, 70.0, 90.0, 90.0, 3), ("S", 1, 2, 0.7, 20.0, 70.0, 40.0, 90.0, 4)]
    got = {r.k1: r for r in rerank.neighbor_support(spark.createDataFrame(rows, CAND), ["k1"]).collect()}
    assert got[1].next_overlap == 1 and got[3].next_overlap == 0 and abs(got[2].previous_support - 0.8) < 1e-9 and got[1].previous_overlap == 0


def detections(spark, frames_):
    rows = [("S", f, d, *b) for f, boxes in enumerate(frames_) for d, b in enumerate(boxes or [(None,) * 4])]
    return spark.createDataFrame(rows, "segment_id string, frame_idx long, det_id long, x1 double, y1 double, x2 double, y2 double")


STEPS = [[(10.0, 10.0, 20.0, 20.0)], [(11.0, 10.0, 21.0, 20.0)], [], [], [(10.0, 10.0, 20.0, 20.0)]]


def test_tracks_end_by_age(spark):
    got = {r.frame_idx: r.track_id for r in tracker.track(detections(spark, STEPS), 0.2, 1).collect()}
    assert got == {0: 1, 1: 1, 4: 2}


def test_the_stream_tracks_like_the_batch(spark, tmp_path):
    from steadyframe.streaming.tracking import track_stream

    rng = np.random.default_rng(5)
    boxes = [[(x, 0.0, x + 10, 10.0) for x in sorted(map(float, rng.integers(0, 60, rng.integers(0, 4))))] for _ in range(12)]
    whole = detections(spark, boxes)
    for part, (a, b) in enumerate(((0, 5), (5, 6), (6, 12))):
        whole.where(f"frame_idx >= {a} and frame_idx < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = track_stream(stream, 0.25, 2).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = sorted(map(tuple, tracker.track(whole, 0.25, 2).collect()))
    assert sorted(map(tuple, spark.table("tracked").collect())) == want


# --- detection


def test_confusion_counts_wrong_boxes_twice(spark):
    rows = [(0.9, 0.8), (0.9, 0.1), (0.2, 0.9)]
    got = {round(r.threshold, 2): r for r in detection.threshold_sweep(spark.createDataFrame(rows, "score double, iou double"), [0.1, 0.5, 0.95]).collect()}
    assert (got[0.1].tp, got[0.1].fp, got[0.1].fn) == (2, 1, 1) and (got[0.5].tp, got[0.5].fp, got[0.5].fn) == (1, 1, 2) and (got[0.95].tp, got[0.95].f1) == (0, 0.0)


def test_rates_of_known_counts(spark):
    r = detection.with_rates(spark.createDataFrame([(358, 177, 157)], "tp long, fp long, fn long")).first()
    assert (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) == (0.6692, 0.6951, 0.6819)


@pytest.mark.parametrize("n,want", [(515, [129, 129, 128, 129]), (4, [1, 1, 1, 1])])
def test_quartile_sizes(spark, n, want):
    df = spark.range(n).selectExpr("'test' as split", "id as frame_idx", "'S' as segment_id")
    got = {r.time_quartile: r["count"] for r in detection.time_quartile(df, ["split"]).groupBy("time_quartile").count().collect()}
    assert [got[f"Q{k}"] for k in (1, 2, 3, 4)] == want


def test_perfect_and_missing_boxes(spark):
    rows = [("S", k, 0.9 - k / 100, 0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0, 1) for k in range(5)]
    df = spark.createDataFrame(rows, "segment_id string, frame_idx long, score double, x1 double, y1 double, x2 double, y2 double, gt_x1 double, gt_y1 double, gt_x2 double, gt_y2 double, k1 long")
    m = detection.mean_average_precision(df, ["segment_id", "frame_idx"], ["k1"]).first()
    assert abs(m.map - 1) < 1e-12 and m.mar_1 == 1
    assert detection.mean_average_precision(df.where("false"), ["segment_id", "frame_idx"], ["k1"]).first().map == -1


def brute_coco(rows):
    """The twelve statistics by loops: rows (image, score, box, gt), one gt an image."""

    def size(b):
        return max(0, b[2] - b[0]) * max(0, b[3] - b[1])

    def over(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / max(size(a) + size(b) - both, 1e-12)

    images = {}
    for i, score, b, g in rows:
        images.setdefault(i, (g, []))[1].append((score, b))
    out = {}
    for name, (low, high) in detection.AREAS.items():
        aps, recalls = [], {k: [] for k in (1, 10, 100)}
        n = sum(low <= size(g) <= high for g, _ in images.values())
        for t in np.arange(10) * 0.05 + 0.5:
            said, found = [], {k: 0 for k in recalls}
            for g, boxes in images.values():
                open_ = True
                for rank, (score, b) in enumerate(sorted(boxes, key=lambda x: -x[0])[:100], 1):
                    if open_ and over(b, g) >= round(t, 2):
                        open_ = False
                        if low <= size(g) <= high:
                            said.append((score, True))
                            for k in found:
                                found[k] += rank <= k
                    elif low <= size(b) <= high:
                        said.append((score, False))
            said.sort(key=lambda x: -x[0])
            points, tp = [], 0
            for k, (_, ok) in enumerate(said, 1):
                tp += ok
                points.append((tp / max(n, 1), tp / k))
            aps.append(np.mean([max((p for r, p in points if r >= q / 100 - 1e-11), default=0.0) for q in range(101)]))
            for k in recalls:
                recalls[k].append(found[k] / max(n, 1))
        suffix = "" if name == "all" else f"_{name}"
        out[f"map{suffix}"] = np.mean(aps) if n else -1
        for k in recalls:
            out[f"mar_{k}" if name == "all" else f"mar{suffix}"] = np.mean(recalls[k]) if n else -1
        if name == "all":
            out["map_50"], out["map_75"] = (aps[0], aps[5]) if n else (-1, -1)
    return out


@pytest.mark.parametrize("sides", [(10, 40, 120), (40, 50)])
def test_coco_statistics_match_loops(spark, sides):
    rng = np.random.default_rng(len(sides))
    rows = []
    for i in range(30):
        side = sides[i % len(sides)]
        g = (50.0, 50.0, 50.0 + side, 50.0 + side)
        for _ in range(rng.integers(1, 13)):
            move, grow = rng.normal(0, side / 8, 2), rng.normal(1, 0.3)
            x, y = 50 + move
            rows.append((i, float(rng.random()), (float(x), float(y), float(x + side * grow), float(y + side * grow)), g))
    df = spark.createDataFrame([("S", i, s, *b, *g, k) for k, (i, s, b, g) in enumerate(rows)], "segment_id string, frame_idx long, score double, x1 double, y1 double, x2 double, y2 double, gt_x1 double, gt_y1 double, gt_x2 double, gt_y2 double, k1 long")
    got = detection.mean_average_precision(df, ["segment_id", "frame_idx"], ["k1"]).first().asDict()
    want = brute_coco(rows)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), (got, want)
    assert (got["map_large"] == -1) == (len(sides) == 2)


# --- ratings


def test_icc_of_equal_raters(spark):
    rows = [("c", f"s{k}", r, float(v), 1.0) for k, v in enumerate((1, 2, 4, 5)) for r in "ab"]
    df = spark.createDataFrame(rows, "case_id string, segment_id string, rater_id string, salas_total double, osa_cns_total double")
    assert abs(ratings.icc_2_1(df, "salas_total").first().icc - 1) < 1e-12 and ratings.icc_2_1(df, "osa_cns_total").first().icc is None


def test_spearman_and_p(spark):
    rows = [("c" + str(k % 4), "s" + str(k), "f", "y", float(x), float(y)) for k, (x, y) in enumerate([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5), (5, 7)])]
    got = ratings.spearman(spark.createDataFrame(rows, "case_id string, segment_id string, feature string, score string, x double, y double")).first()
    want = pd.Series([1, 2, 3, 4, 5, 5]).corr(pd.Series([2, 1, 4, 3, 5, 7]), method=lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1])
    assert abs(got.spearman_rho - want) < 1e-12 and got.independent_cases == 4
    assert abs(ratings.incomplete_beta(2.0, 3.0, 0.4) - 0.5248) < 1e-9 and abs(ratings.student_p(0.5, 12) - 0.0978) < 5e-4


def test_ridge_matches_a_direct_fit(spark):
    rng = np.random.default_rng(1)
    x, c = rng.random((24, 3)), np.repeat(np.arange(4), 6)
    y = x @ [1.0, -2.0, 0.5] + rng.random(24)
    df = spark.createDataFrame([(f"c{a}", f"s{k}", *map(float, v), float(t)) for k, (a, v, t) in enumerate(zip(c, x, y))], "case_id string, segment_id string, f1 double, f2 double, f3 double, t double")
    got = {r.segment_id: r.predicted for r in ratings.leave_one_case_out(df, ["f1", "f2", "f3"], "t").collect()}
    for case in range(4):
        tx, ty = x[c != case], y[c != case]
        m, s = tx.mean(0), tx.std(0)
        z = (tx - m) / s
        b = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (ty - ty.mean()))
        for k in np.flatnonzero(c == case):
            assert abs(got[f"s{k}"] - (ty.mean() + (x[k] - m) / s @ b)) < 1e-8


# --- audit


def test_label_lines(spark):
    lines = ["0,7,0.5,0.5,0.2,0.1", "0,0,1.5,0.5,0.2,0.1", "0,0,0.642448,0.0462963,0.0661458,0.17963", "﻿0, 1 ,0.5,0.5,0.1,0.1", "0,1,nan,0.5,0.1,0.1", "0,1,0.5", "   "]
    got = [tuple(r) for r in audit.parse_labels(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, raw_line string"), {0: "Harmonic0"}).select("k", "object_id", "error").orderBy("k").collect()]
    assert got == [(0, 7, None), (1, 0, "invalid normalized box"), (2, 0, None), (3, 1, None), (4, 1, "invalid normalized box"), (5, 1, "expected 6 columns")]


def test_identities(spark):
    def ids(name, kind, over=None):
        case, part = audit.identity(F.lit(name), kind, over)
        return tuple(spark.range(1).select(case, part).first())

    assert ids("VID001_B_5fps.mp4", "video") == ids("VID001_Bseg", "label") == ("VID001", "VID001_B")
    assert ids("VID001_5fps.mp4", "video") == ("VID001", "VID001_5fps") and ids("clip.mp4", "video") == ("clip", "clip") and ids("odd", "label") == (None, None)
    assert ids("CH2001CH001", "label", {"CH2001CH001": ("CH2001", "CH2001_CH001")}) == ("CH2001", "CH2001_CH001")
    with pytest.raises(ValueError):
        audit.identity(F.lit("x"), "label", {"x": ("a", "")})


def test_splits(spark):
    df = spark.createDataFrame([("a", "s1"), ("b", "s2")], "case_id string, segment_id string")
    assert {r.segment_id: r.split for r in audit.split_by_segment(df, {"train": ["s1"], "test": ["s2"]}).collect()} == {"s1": "train", "s2": "test"}
    for scheme in ({"train": ["s1"]}, {"train": ["s1", "s2"], "test": ["s2"]}, {"train": ["s1", "s2", "s9"]}):
        with pytest.raises(ValueError):
            audit.split_by_segment(df, scheme)
    with pytest.raises(ValueError):
        audit.case_splits(["a"], 0.2, 0.2, 3, 1)
    assert sorted(audit.case_splits(list("abcdefgh"), 0.15, 0.15, 3, 42).values()) == ["test"] + ["train"] * 6 + ["val"]


def test_even_sample(spark):
    for n in (1, 3, 24, 25, 100):
        got = sorted(r.id for r in audit.even_sample(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"]).collect())
        m = min(24, n)
        assert got == sorted({k * (n - 1) // max(m - 1, 1) for k in range(m)})


def test_image_statistics(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 255, (8, 8)).astype(float)
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    r = audit.image_statistics(spark.createDataFrame([(g.ravel().tolist(),)], "pixels array<double>")).first()
    assert abs(r.brightness - g.mean()) < 1e-9 and abs(r.contrast - g.std()) < 1e-9 and abs(r.blur_variance - lap.var()) < 1e-6


# --- registry and files


def test_registry(spark):
    schema = "name string, registered_at string, metrics map<string,map<string,double>>"
    old = spark.createDataFrame([("a", "1", {"val": {"map": 0.5, "map_75": 0.1}}), ("b", "2", {"test": {"map": 0.9}})], schema)
    new = registry.upsert(old, spark.createDataFrame([("b", "3", {"val": {"map": 0.5, "map_75": 0.2}})], schema))
    assert new.count() == 2 and registry.best_experiment(new).first().name == "b" and registry.best_experiment(old).first().name == "a"


def test_stats_by_name(spark):
    df = spark.createDataFrame([([k / 10 for k in range(12)],)], "stats array<double>")
    m = df.select(registry.stats_to_map().alias("m")).first().m
    assert (m["map"], m["map_75"], m["mar_100"], m["mar_large"]) == (0.0, 0.2, 0.8, 1.1)
    with pytest.raises(Exception, match="12 statistics"):
        df.select(F.slice("stats", 1, 3).alias("stats")).select(registry.stats_to_map()).collect()
    with pytest.raises(ValueError):
        registry.best_epoch(spark.createDataFrame([], "epoch int, stats array<double>"))


def test_truncated_atoms(spark, tmp_path):
    atom = lambda raw, n: files.truncated_atom(io.BytesIO(raw), n)
    assert atom(struct.pack(">I", 100) + b"mdat" + b"short", 13) == ("mdat", 100)
    assert atom(struct.pack(">I4s", 8, b"free") + struct.pack(">I4s", 0, b"mdat") + b"xx", 18) is None
    assert atom(struct.pack(">I4sQ", 1, b"mdat", 99), 16) == ("mdat", 99) and atom(struct.pack(">I4s", 3, b"bad "), 8) == ("bad ", 3)
    (tmp_path / "a.mp4").write_bytes(struct.pack(">I", 100) + b"mdat" + b"short")
    r = files.inspect_videos(spark, str(tmp_path)).first()
    assert (r.atom, r.declared_end, r.length) == ("mdat", 100, 13)
    assert files.discover(spark, str(tmp_path)).count() == 1


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("case_id,segment_id,x1,extra\nc,s,nan,1\nc,t,2.5,1\n")
    (tmp_path / "b.csv").write_text("segment_id,case_id\nu,c\n")
    got = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "case_id string, segment_id string, x1 double")
    assert sorted((r.segment_id, r.x1) for r in got.collect()) == [("s", None), ("t", 2.5), ("u", None)]
    with pytest.raises(ValueError):
        files.read_csv(spark, [], "a int")
    assert files.read_json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "x", "width": 2, "height": 3}], "annotations": [{"id": 5, "image_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0]}]}')
    images, notes = files.read_coco(spark, str(tmp_path / "c.json"))
    assert images.first().id == 1 and notes.first().bbox[3] == 4.0
    (tmp_path / "VID001_Bseg").mkdir()
    (tmp_path / "VID001_Bseg" / "12.txt").write_text("0,1,.5,.5,.1,.1\n")
    r = files.read_label_lines(spark, str(tmp_path / "VID001_Bseg")).first()
    assert (r.set_name, r.frame_idx) == ("VID001_Bseg", 12)
    assert [x[0] for x in spark.createDataFrame([("30000/1001",), ("5/0",), ("25",)], "r string").select(files.rational("r")).collect()] == [30000 / 1001, 0.0, 25.0]


def test_grid_has_all_weights():
    assert len(temporal.grid()) == 144 and temporal.grid()[0] == temporal.Weights(3, 0.5, 0.5, 0.0, 0.0) and math.isclose(detection.thresholds(0.01, 0.99, 99)[52], 0.53)
