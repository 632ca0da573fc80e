"""Support of neighbouring frames: boxes by tiles against all pairs, frames by stretches against a plain loop."""

import math

import numpy as np
import pytest

from steadyframe.operators import rerank
from steadyframe.plans import catalog

SCHEMA = "segment_id string, frame_idx long, k int, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(rng, n, kind):
    """Five arrays: corners and score."""
    low = rng.integers(0, 60, (2, n)) * 1.0 if kind == "repeated" else rng.random((2, n)) * 500
    size = np.full((2, n), 40.0) if kind == "repeated" else rng.normal(30, 20, (2, n))  # some extents are negative
    return np.vstack([low, low + size, rng.random(n)])


@pytest.mark.parametrize("kind", ["repeated", "scattered"])
def test_tiles_equal_all_pairs_and_leave_most_out(monkeypatch, kind):
    rng = np.random.default_rng(5)
    own, other = boxes(rng, 1900, kind), boxes(rng, 2100, kind)
    pairs = rerank.overlaps(own[:4, :, None], other[:4, None, :])
    (a, place), (b, _) = rerank.distinct_boxes(own), rerank.distinct_boxes(other)
    assert (a.reshape(5, -1)[:4, place] == own[:4]).all() and a.shape[2] <= rerank.TILE
    met = []
    all_pairs = rerank.overlaps
    monkeypatch.setattr(rerank, "overlaps", lambda x, y: met.append((f := all_pairs(x, y)).size) or f)
    for few in (10**9, 0):
        monkeypatch.setattr(rerank, "FEW_PAIRS", few)
        met.clear()
        overlap, support = (v.ravel()[place] for v in rerank.best_overlaps(a, b))
        assert (overlap == pairs.max(1)).all() and (support == (pairs * other[4]).max(1)).all()
    assert sum(met) < pairs.size / 10


def test_frames_by_stretches_equal_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = []
    for segment, frames in (("A", [-9, -8, -3, 2, 7, 8, 14, 15, 16, 21, 27]), ("B", [0]), (None, [3, 4]), ("C", [None, 1])):
        for f in frames:
            rows += [(segment, f, k, float(s), *map(float, (x, y, x + w, y + h))) for k, (s, x, y, w, h) in enumerate(zip(rng.random(7), *rng.integers(1, 30, (4, 7))))]
    rows += [("A", 7, 90, 0.9, None, 1.0, 2.0, 3.0), ("A", 7, 91, 0.9, 0.0, math.nan, 2.0, 3.0), ("A", 15, 92, 0.5, math.inf, 0.0, 9.0, 9.0)]
    whole = lambda r: all(v is not None and math.isfinite(v) for v in r[4:])

    def side(r, step):
        near = sorted(o[1] for o in rows if o[0] == r[0] and None not in (o[1], r[1]) and 0 < (o[1] - r[1]) * step <= 5)
        if not near or not whole(r):
            return 0.0, 0.0
        to = near[0] if step > 0 else near[-1]
        met = [o for o in rows if o[0] == r[0] and o[1] == to and whole(o)]
        v = rerank.overlaps(np.array(r[4:])[:, None], np.array([o[4:] for o in met]).T)
        root = math.sqrt(abs(to - r[1]))
        return v.max() / root, (v * np.clip([o[3] for o in met], 1e-6, 1 - 1e-6)).max() / root

    for n in (1, 3):
        found = rerank.neighbor_support(spark.createDataFrame(rows, SCHEMA).repartition(n), ["k"]).collect()
        got = {(r.segment_id, r.frame_idx, r.k): (r.previous_overlap, r.previous_support, r.next_overlap, r.next_support) for r in found}
        assert len(found) == len(rows) == len(got)
        for r in rows:
            assert got[r[:3]] == pytest.approx((*side(r, -1), *side(r, 1)), abs=1e-12)


def test_repeated_keys_keep_the_lowest_rank(spark, tmp_path):
    """Ten rows of one key and one of another, in files of their own."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
    spark.createDataFrame([(1, 5, 3, 1)] * 10 + [(2, 5, 3, 1)], line).repartition(11).write.parquet(str(tmp_path / "lineitem.parquet"))
    ranks = sorted(r.candidate_rank for r in catalog.distinct_candidates(spark, str(tmp_path)).collect())
    scores = {k: (k * 7919 + 104729 + 155) % 9973 for k in (1, 2)}
    assert ranks == ([1, 11] if scores[1] > scores[2] else [1, 2])


def test_what_is_kept_for_all_folds_is_a_row_a_frame(spark):
    rng = np.random.default_rng(9)
    rows = [("S", f, k, *map(float, rng.random(5))) for f in range(20) for k in range(f + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    frames, schema = rerank.supported_frames(df)
    assert frames.columns == ["segment_id", "frame_idx", "rows"] and frames.count() == 20
    folds = frames.join(rerank.contiguous_folds(frames, 4), ["segment_id", "frame_idx"])
    got = rerank.unpacked(folds, schema, ("fold",)).collect()
    want = {(r.frame_idx, r.k): r for r in rerank.neighbor_support(df, ["k"]).collect()}
    assert len(got) == len(rows) and all(r.fold == r.frame_idx // 5 and tuple(r)[:-1] == tuple(want[r.frame_idx, r.k]) for r in got)
