"""The registered queries see all rows and use the reference's values, where earlier versions cut both."""

import os

import pytest

from steadyframe.operators import rerank
from steadyframe.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_features_of_every_candidate(spark):
    assert catalog.candidate_features(spark, FOLDER).count() == catalog.candidates(spark, FOLDER).select("segment_id", "frame_idx", *catalog.TIES).distinct().count()


def test_rerank_takes_every_candidate_and_all_trees(spark, monkeypatch):
    seen = {}

    def fit(candidates, key, folds=5, trees=120):
        seen.update(rows=candidates.count(), folds=folds, trees=trees)
        return catalog.detection.with_iou(candidates).selectExpr("*", "iou as calibrated_iou")

    monkeypatch.setattr(rerank, "out_of_fold", fit)
    frames = catalog.gbt_rerank(spark, FOLDER).count()
    whole = catalog.candidates(spark, FOLDER)
    assert seen == {"rows": whole.select("segment_id", "frame_idx", *catalog.TIES).distinct().count(), "folds": 5, "trees": 120}
    assert whole.where("candidate_rank > 5").count() and frames == whole.select("segment_id", "frame_idx").distinct().count()


def test_bootstrap_of_2000_repetitions(spark):
    assert "range(2000)" in oracles.bootstrap() and catalog.bootstrap_ci(spark, FOLDER).agg({"repetitions": "max"}).first()[0] == 2000


def test_twenty_detections_a_frame_are_tracked(spark):
    want = catalog.candidates(spark, FOLDER).where("candidate_rank <= 20").selectExpr("segment_id", "frame_idx", "cast(candidate_rank as long) as det_id")
    assert want.where("det_id > 3").count()
    got = catalog.iou_tracker(spark, FOLDER)
    assert sorted(map(tuple, got.select("segment_id", "frame_idx", "det_id").collect())) == sorted(map(tuple, want.collect()))
