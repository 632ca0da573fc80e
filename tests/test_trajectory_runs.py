"""Derivatives, filled gaps, smoothing, gap lengths and latencies against plain loops, on segments with missing values, missing times and times that repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyframe.operators import trajectory


def slopes(t, v):
    """Derivative of each place, run by run."""
    out, k = [None] * len(t), 0
    while k < len(t):
        if t[k] is None or v[k] is None:
            k += 1
            continue
        e = k
        while e < len(t) and t[e] is not None and v[e] is not None:
            e += 1
        ts, vs = np.array(t[k:e]), np.array(v[k:e])
        if e - k > 1 and (np.diff(ts) > 0).all():
            out[k:e] = np.gradient(vs, ts, edge_order=1).tolist()
        k = e
    return out


def filled(v, most):
    known = [k for k, x in enumerate(v) if x is not None]
    out = list(v)
    for p, n in zip(known, known[1:]):
        for k in range(p + 1, n):
            if k - p <= most:
                out[k] = v[p] + (v[n] - v[p]) * (k - p) / (n - p)
    return out


def smoothed(v, window):
    at = [k for k, x in enumerate(v) if x is not None]
    w = min(window + 1 - window % 2, len(at) // 2 * 2 - 1)
    out = list(v)
    if len(at) >= 5 and w >= 5:
        own, m = [v[k] for k in at], w // 2
        for j, k in enumerate(at):
            middle = min(max(j, m), len(at) - 1 - m)
            out[k] = float(np.polyval(np.polyfit(np.arange(-m, m + 1), own[middle - m : middle + m + 1], 2), j - middle))
    return out


@pytest.fixture(scope="module")
def segments():
    rng = random.Random(8)
    out = {}
    for s in range(30):
        n, t, rows = rng.choice([1, 2, 4, 9, 40]), 0.0, []
        for k in range(n):
            t += rng.choice([0.2, 0.2, 0.3, 0.0 if s % 3 == 0 else 0.2])
            x, y = (None if rng.random() < 0.25 else rng.random() for _ in range(2))
            rows.append((f"c{s % 4}", f"s{s}", k, None if rng.random() < 0.05 else t, x, y, k, rng.choice([1, 2, 4]) if k == 0 else rows[0][7], 5 if s % 2 else 8))
        out[f"s{s}"] = rows
    return out


@pytest.fixture(scope="module")
def frames(spark, segments):
    rows = [r for rs in segments.values() for r in rs]
    return spark.createDataFrame(rows, "case_id string, segment_id string, frame_idx long, time_s double, x double, y double, rn int, max_gap int, window int")


def compare(df, segments, want):
    got = {}
    for r in df.orderBy("segment_id", "frame_idx").collect():
        got.setdefault(r.segment_id, []).append(r)
    assert got.keys() == segments.keys()
    for s, rows in segments.items():
        for name, values in want(rows).items():
            for r, v in zip(got[s], values):
                assert (r[name] is None) == (v is None) and (v is None or abs(r[name] - v) < 1e-9), (s, name, r, v)


def test_derivatives_by_runs(frames, segments):
    compare(trajectory.differentiate(frames, {"vx": "x", "vy": "y"}), segments, lambda rs: {n: slopes([r[3] for r in rs], [r[c] for r in rs]) for n, c in (("vx", 4), ("vy", 5))})


def test_gaps_are_filled(frames, segments):
    compare(trajectory.interpolate(frames, "x", "y"), segments, lambda rs: {n: filled([r[c] for r in rs], rs[0][7]) for n, c in (("x_i", 4), ("y_i", 5))})


def test_parabolas_over_known_values(frames, segments):
    compare(trajectory.smooth(frames, "x", "y"), segments, lambda rs: {n: smoothed([r[c] for r in rs], rs[0][8]) for n, c in (("x_s", 4), ("y_s", 5))})


def test_gap_lengths_and_latencies(spark):
    """The metrics that running values give, against loops over the frames."""
    rng = random.Random(3)
    rows, seen = [], {}
    for s in range(12):
        n = rng.choice([1, 3, 25])
        for k in range(n):
            on, out = rng.random() < 0.6, rng.random() < 0.5
            c = 80 if out else 50
            seen.setdefault(f"s{s}", []).append(on)
            rows.append(("c", f"s{s}", k, k / 5, "Harmonic0", 0.9 if on else 0.1, *(float(x) for x in (c - 5, c - 5, c + 5, c + 5)), 100, 100, 1))
    df = spark.createDataFrame(rows, "case_id string, segment_id string, frame_idx long, time_s double, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, frame_width int, frame_height int, track_id long")
    s = trajectory.Settings()
    got = {r.segment_id: r for r in trajectory.segment_metrics(df, s).collect()}
    late = {r.segment_id: r for r in trajectory.recenter_latencies(trajectory.kinematics(df, s), s.center_radius).groupBy("segment_id").agg(F.count("*").alias("n"), F.avg("latency_s").alias("v")).collect()}
    for k, flags in seen.items():
        runs = "".join("x" if f else "." for f in flags).replace("x", " ").split()
        dt = 0.2 if len(flags) > 1 else 1.0
        assert got[k].detection_gap_count == len(runs) and got[k].longest_detection_gap_s == pytest.approx(max(map(len, runs), default=0) * dt)
        assert got[k].recenter_event_count == (late[k].n if k in late else 0)
        assert got[k].mean_recenter_latency_s == (pytest.approx(late[k].v) if k in late else None)
    assert late
