"""Registered queries: each applies an operator to the stand-in tables, with its numbers rounded alike in its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.functions.geometry import BOX, box, center, clip, iou, radial
from steadyframe.operators import audit, detection, ratings, registry, rerank, temporal, tracker, trajectory
from steadyframe.plans.fixtures import fixture
from steadyframe.plans.oracles import oracle_sql  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
TIES = ["k1", "k2", "k3"]
THRESHOLD = 0.53
SETTINGS = trajectory.Settings()
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(FOUND)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, negative zero to zero. The nudge keeps exact halves off the edge, where the last bit would decide."""
    return df.select(*[(F.round(F.col(f.name) + 3e-8, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def tracks(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "tracks")


def candidates(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "candidates")


def distinct_candidates(s: SparkSession, d: str) -> DataFrame:
    """One row for each key of a frame, the one of lowest rank. Rows of equal keys have equal scores, so they are neighbours in the window that ranks them, which serves both."""
    key = F.struct(*TIES)
    before = F.lag(key).over(Window.partitionBy("segment_id", "frame_idx").orderBy(F.desc("score"), *TIES))
    return candidates(s, d).withColumn("__before", before).where(~F.col("__before").eqNullSafe(key)).drop("__before")


def centres(s: SparkSession, d: str) -> DataFrame:
    x, y = center(box(), F.col("frame_width"), F.col("frame_height"))
    return trajectory.add_step(trajectory.best_per_frame(tracks(s, d), SETTINGS).withColumns({"x": x, "y": y}), SETTINGS)


def errors(s: SparkSession, d: str) -> DataFrame:
    e = detection.per_image_errors(candidates(s, d), ["segment_id", "frame_idx"], TIES)
    return e.withColumn("split", F.when(F.col("segment_id") < "S5", "val").otherwise("test"))


def bucketed(s: SparkSession, d: str) -> DataFrame:
    e = errors(s, d)
    return detection.with_buckets(e, detection.area_edges(e.where("split = 'val'")))


def top_one(s: SparkSession, d: str) -> DataFrame:
    return detection.with_iou(detection.top_k(candidates(s, d), 1, ["segment_id", "frame_idx"], TIES))


def labels(s: SparkSession, d: str) -> DataFrame:
    lines = fixture(s, d, "label_lines")
    bad = s.createDataFrame([("VID001_B", -1, "0,1,0.5"), ("VID001_B", -2, "0,1,1.5,0.5,0.1,0.1"), ("VID001_C", -3, "7,1,0.5,0.5,0.1,0.1"), ("VID001_C", -4, "a,1,0.5,0.5,0.1,0.1"), ("VID001_C", -5, "  ")], "segment_id string, frame_idx long, raw_line string")
    return audit.parse_labels(lines.unionByName(bad), {0: "Harmonic0"})


def good_labels(s: SparkSession, d: str) -> DataFrame:
    return labels(s, d).where("error is null").withColumn("time_s", F.col("frame_idx") / 5.0).drop("error", "raw_line")


# --- trajectory


@query
def segment_metrics(s, d):
    return rounded(trajectory.segment_metrics(tracks(s, d), SETTINGS))


@query
def best_per_frame(s, d):
    return trajectory.best_per_frame(tracks(s, d), SETTINGS).select("case_id", "segment_id", "frame_idx", "time_s", "any_detected", "detected", "confidence", "x1", "y1", "x2", "y2")


@query
def dominant_track(s, d):
    return rounded(trajectory.dominant_tracks(tracks(s, d), SETTINGS))


@query
def frame_spine_join(s, d):
    """The spine by an explicit left join of all frames and selected boxes."""
    t = tracks(s, d)
    spine = t.select("segment_id", "frame_idx", "time_s").distinct()
    chosen = trajectory.best_per_frame(t, SETTINGS).where("detected").select("segment_id", "frame_idx", "x1", "x2")
    return spine.join(chosen, ["segment_id", "frame_idx"], "left")


@query
def detection_gaps(s, d):
    f = centres(s, d)
    gaps = trajectory.missing_runs(f, "any_detected")
    return rounded(gaps.join(f.groupBy("case_id", "segment_id").agg(F.min("dt").alias("dt")), trajectory.KEYS).select("case_id", "segment_id", "gap_count", "longest", (F.col("longest") * F.col("dt")).alias("longest_s")))


@query
def interpolate_short(s, d):
    return rounded(trajectory.interpolate(centres(s, d), "x", "y").select("segment_id", "frame_idx", "x_i", "y_i"))


@query
def savgol_smooth(s, d):
    f = trajectory.smooth(trajectory.interpolate(centres(s, d), "x", "y"), "x_i", "y_i")
    return rounded(f.select("segment_id", "frame_idx", F.col("x_i_s").alias("x_s"), F.col("y_i_s").alias("y_s")))


@query
def gradient_runs(s, d):
    k = trajectory.kinematics(tracks(s, d), SETTINGS)
    return rounded(k.select("segment_id", "frame_idx", "speed", "acceleration", "jerk", "jitter"))


@query
def recenter_latency(s, d):
    k = trajectory.kinematics(tracks(s, d), SETTINGS)
    return rounded(trajectory.recenter_latencies(k, SETTINGS.center_radius).select("segment_id", "frame_idx", "latency_s"))


@query
def legacy_metrics(s, d):
    return rounded(trajectory.legacy_metrics(tracks(s, d)))


@query
def center_distance(s, d):
    x, y = center(box(), F.col("frame_width"), F.col("frame_height"))
    t = tracks(s, d).where(trajectory.qualified(SETTINGS)).withColumns({"x": x, "y": y})
    return rounded(t.select("event_id", "x", "y", radial(F.col("x"), F.col("y")).alias("radial")))


@query
def gated_track(s, d):
    """Every frame from the first to the last, with the best candidate's columns nulled under the threshold."""
    best = top_one(s, d).select("segment_id", "frame_idx", "score", "x1", "y1", "x2", "y2")
    ends = best.groupBy("segment_id").agg(F.max("frame_idx").alias("hi"))
    spine = ends.select("segment_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi"))).alias("frame_idx"))
    return rounded(temporal.gate(spine.join(best, ["segment_id", "frame_idx"], "left"), THRESHOLD).drop("score"))


@query
def detection_rate(s, d):
    g = gated_track(s, d)
    return rounded(g.groupBy("segment_id").agg(F.avg(F.col("track_id").isNotNull().cast("double")).alias("detection_rate"), F.count("*").alias("frames")))


# --- detection


@query
def box_iou(s, d):
    return rounded(candidates(s, d).select(*TIES, "segment_id", iou(box(), box("gt_")).alias("iou")).distinct())


@query
def top_k_candidates(s, d):
    return rounded(detection.top_k(candidates(s, d), 3, ["segment_id", "frame_idx"], TIES).select("segment_id", "frame_idx", "rank", "score", *TIES))


@query
def threshold_sweep(s, d):
    return rounded(detection.threshold_sweep(top_one(s, d), detection.thresholds(0.01, 0.99, 99)))


@query
def best_operating_point(s, d):
    e = errors(s, d).where("split = 'val'").select(F.col("top_score").alias("score"), F.col("top_iou").alias("iou"))
    return rounded(detection.best_row(detection.threshold_sweep(e, detection.thresholds(0.05, 0.95, 91)), ["f1", "precision"], "threshold"))


@query
def selection_summary(s, d):
    return rounded(detection.selection_summary(top_one(s, d), THRESHOLD, ["segment_id"]))


@query
def per_image_errors(s, d):
    return rounded(errors(s, d))


@query
def error_taxonomy(s, d):
    e = errors(s, d).withColumn("error_type", detection.error_type(F.col("top_score"), F.col("top_iou"), THRESHOLD))
    return e.groupBy("split", "error_type").agg(F.count("*").alias("n"))


@query
def area_buckets(s, d):
    return bucketed(s, d).groupBy("split", "area_bucket", "position_bucket").agg(F.count("*").alias("n"))


@query
def time_quartile(s, d):
    return bucketed(s, d).select("segment_id", "frame_idx", "split", "time_quartile")


@query
def group_diagnostics(s, d):
    return rounded(detection.group_diagnostics(bucketed(s, d).where("split = 'test'"), THRESHOLD))


@query
def top_errors(s, d):
    return rounded(detection.worst_errors(errors(s, d).where("split = 'test'"), THRESHOLD, 12, ["segment_id", "frame_idx"]).select("segment_id", "frame_idx", "top_score", "top_iou", "error_priority"))


@query
def ranking_failures(s, d):
    return errors(s, d).where("split = 'test'").agg(F.count_if((F.col("top_iou") < 0.5) & (F.col("best_iou_any") >= 0.5)).alias("failures"), F.count("*").alias("images"))


@query
def coco_map(s, d):
    return rounded(detection.mean_average_precision(candidates(s, d), ["segment_id", "frame_idx"], TIES))


@query
def coco_map_crowd(s, d):
    """Several truths a frame, some of them crowds."""
    truths = fixture(s, d, "truths")
    return rounded(detection.mean_average_precision(candidates(s, d), ["segment_id", "frame_idx"], TIES, truths))


@query
def clip_boxes(s, d):
    c = candidates(s, d).select(*TIES, "segment_id", clip(F.col("x1"), 350.0, F.lit(1000.0)).alias("x1"), clip(F.col("y1"), 250.0, F.lit(600.0)).alias("y1"))
    return c.distinct()


# --- temporal selection and reranking


@query
def viterbi_path(s, d):
    return rounded(temporal.select_paths(candidates(s, d), [temporal.Weights()], TIES).select("segment_id", "frame_idx", "score", *TIES, "temporal_rank"))


@query
def framewise_baseline(s, d):
    return rounded(temporal.select_paths(candidates(s, d), [temporal.FRAMEWISE], TIES).select("segment_id", "frame_idx", "score", *TIES))


@query
def grid_search(s, d):
    return rounded(temporal.grid_search(candidates(s, d), temporal.grid(), TIES))


@query
def temporal_evaluation(s, d):
    """Path against single best per frame, at each one's own summary."""
    c = candidates(s, d)
    both = detection.with_iou(temporal.select_paths(c, [temporal.FRAMEWISE, temporal.Weights()], TIES))
    return rounded(detection.selection_summary(both, THRESHOLD, ["param_id"]))


@query
def neighbor_support(s, d):
    c = distinct_candidates(s, d).select("segment_id", "frame_idx", *TIES, "score", *BOX)
    return rounded(rerank.neighbor_support(c, TIES).select("segment_id", "frame_idx", *TIES, "previous_overlap", "previous_support", "next_overlap", "next_support"))


@query
def candidate_features(s, d):
    c = distinct_candidates(s, d).select("segment_id", "frame_idx", *TIES, "score", *BOX, "candidate_rank")
    return rounded(rerank.candidate_features(c, TIES).select("segment_id", "frame_idx", *TIES, "score_logit", "rank_reciprocal", "center_x", "center_y", "box_width", "box_height", "log_area", "log_aspect"))


@query
def kfold_frames(s, d):
    return rerank.contiguous_folds(candidates(s, d))


@query
def gbt_rerank(s, d):
    c = distinct_candidates(s, d)
    return rerank.rerank(c, TIES).select("segment_id", "frame_idx", *TIES, "iou", "calibrated_iou")


@query
def oracle_selection(s, d):
    """Selection by the true overlap: what a perfect reranker reaches."""
    c = detection.with_iou(candidates(s, d)).withColumn("calibrated_iou", F.round("iou", 9))
    return rounded(rerank.select_by_prediction(c, TIES).select("segment_id", "frame_idx", *TIES, "iou"))


# --- ratings


@query
def mean_ratings(s, d):
    return rounded(ratings.mean_ratings(fixture(s, d, "ratings")))


@query
def icc_2_1(s, d):
    r = fixture(s, d, "ratings")
    parts = [ratings.icc_2_1(r, c).withColumn("score", F.lit(c)) for c in ratings.SCORES]
    return rounded(parts[0].unionByName(parts[1]))


def correlation_rows(s: SparkSession, d: str) -> DataFrame:
    return ratings.feature_score_rows(fixture(s, d, "segment_features"), fixture(s, d, "ratings"))


@query
def spearman(s, d):
    return rounded(ratings.spearman(correlation_rows(s, d)).drop("p_value"))


@query
def spearman_p(s, d):
    return rounded(ratings.spearman(correlation_rows(s, d)).select("feature", "score", "p_value"))


@query
def bootstrap_ci(s, d):
    return rounded(ratings.bootstrap_interval(correlation_rows(s, d), 2000, 42))


@query
def loco_ridge(s, d):
    data = fixture(s, d, "segment_features").join(ratings.mean_ratings(fixture(s, d, "ratings")), ratings.KEYS)
    out = ratings.leave_one_case_out(data, ["n_orders", "key_mass", "key_top"], "salas_total")
    return rounded(out.select("case_id", "segment_id", "salas_total", "predicted"))


@query
def loco_ridge_scores(s, d):
    data = fixture(s, d, "segment_features").join(ratings.mean_ratings(fixture(s, d, "ratings")), ratings.KEYS)
    return rounded(ratings.prediction_scores(ratings.leave_one_case_out(data, ["n_orders", "key_mass", "key_top"], "salas_total"), "salas_total"))


# --- audit, splits and anomalies


@query
def parse_labels(s, d):
    number = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return labels(s, d).select("segment_id", "frame_idx", number("class_id"), number("object_id"), "cx", "cy", "width", "height", "error")


@query
def parse_identity(s, d):
    names = s.read.parquet(f"{d}/supplier.parquet").select(
        F.concat(F.lit("VID"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0"), F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, "_B_5fps").otherwise("_5fps"), F.lit(".mp4")).alias("name")
    ).unionByName(s.createDataFrame([("clip.mp4",), ("CH2001.mp4",)], "name string"))
    case, part = audit.identity(F.col("name"), "video", {"CH2001.mp4": ("CH2001", "CH2001_CH001")})
    return names.select("name", case.alias("case_id"), part.alias("segment_id"))


@query
def audit_label_sets(s, d):
    lines = labels(s, d).withColumns({"path": F.col("segment_id"), "case_id": F.substring("segment_id", 1, 6)})
    videos = s.createDataFrame([("a.mp4", "VID001_B", True, 10), ("b.mp4", "VID001_B", True, 10**9), ("c.mp4", "VID001_C", True, 10)], "path string, segment_id string, readable boolean, frame_count long")
    sets = audit.audit(audit.label_sets(lines), videos)
    objects = F.array_join(F.transform(F.array_sort(F.map_entries("object_ids")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return sets.withColumn("object_ids", objects)


@query
def pixel_boxes(s, d):
    return rounded(audit.pixel_boxes(good_labels(s, d), F.lit(1920.0), F.lit(1080.0)).select("segment_id", "frame_idx", "x", "y", "w", "h", "area"))


@query
def assign_ids(s, d):
    out = audit.numbered(good_labels(s, d), "annotation_id", ["segment_id", "frame_idx"], "segment_id")
    return out.select("segment_id", "frame_idx", "annotation_id")


@query
def coco_nest(s, d):
    rows = audit.pixel_boxes(good_labels(s, d), F.lit(1920.0), F.lit(1080.0)).withColumn("split", F.when(F.col("frame_idx") % 5 == 0, "unused").when(F.col("segment_id") == "VID001_B", "train").otherwise("val"))
    images = rows.select("split", F.col("frame_idx").alias("image_id"), F.concat(F.col("frame_idx").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), "segment_id", "frame_idx")
    notes = rows.select("split", F.col("frame_idx").alias("annotation_id"), F.col("frame_idx").alias("image_id"), F.array("x", "y", "w", "h").alias("bbox"), "area")
    docs = audit.coco_documents(images, notes)
    return docs.select("split", F.size("images").alias("n_images"), F.size("annotations").alias("n_annotations"), F.get("images", 0)["image_id"].alias("first_image"))


@query
def split_holdout(s, d):
    return audit.split_by_segment(good_labels(s, d), {"train": ["VID001_B"], "val": ["VID001_C"], "test": []}).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("frame_idx").alias("images"))


@query
def split_by_case(s, d):
    t = tracks(s, d)
    splits = audit.case_splits([f"C{k}" for k in range(10)], 0.15, 0.15, 5, 42)
    return audit.split_by_case(t, splits).groupBy("split").agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("rows"))


@query
def split_disjoint(s, d):
    t = tracks(s, d).withColumn("split", F.when(F.col("case_id") == "C9", F.when(F.col("frame_idx") % 2 == 0, "test").otherwise("val")).when(F.col("case_id") == "C8", "val").otherwise("train"))
    return audit.split_purity(t)


@query
def even_sample(s, d):
    return audit.even_sample(tracks(s, d).select("segment_id", "frame_idx"), ["segment_id"], ["frame_idx"], 4)


def scored(s: SparkSession, d: str) -> DataFrame:
    """Labels with the statistics of an image each, of the images by number modulo their count."""
    stats = audit.image_statistics(fixture(s, d, "images")).withColumn("n", F.col("image_id") % 100).groupBy("n").agg(F.min("brightness").alias("brightness"), F.min("blur_variance").alias("blur_variance"))
    rows = good_labels(s, d).withColumn("n", F.col("frame_idx") % 100)
    return audit.scored(rows.join(stats, "n", "left").drop("n"))


@query
def box_shape(s, d):
    return rounded(audit.box_shape(good_labels(s, d)).select("segment_id", "frame_idx", "box_area_norm", "aspect_ratio", "boundary_margin"))


@query
def position_speed(s, d):
    return rounded(audit.position_speed(good_labels(s, d)).select("segment_id", "frame_idx", "position_speed"))


@query
def robust_z(s, d):
    return rounded(scored(s, d).select("segment_id", "frame_idx", "area_z", "aspect_z", "speed_z"))


@query
def anomaly_topk(s, d):
    return rounded(audit.anomalies(scored(s, d)))


@query
def image_stats(s, d):
    i = fixture(s, d, "images")
    return rounded(audit.image_statistics(i).select("image_id", "brightness", "contrast", "blur_variance"))


# --- registry and reports


@query
def registry_upsert(s, d):
    c = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("double").alias("map"))
    new = c.where("map % 3 = 0").select("name", (F.col("map") + 1000).alias("map")).unionByName(s.createDataFrame([("fresh", 1.0)], "name string, map double"))
    return registry.upsert(c, new)


@query
def best_experiment(s, d):
    c = s.read.parquet(f"{d}/supplier.parquet")
    m = F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("map"), (F.col("s_suppkey") % 7).cast("double"), F.lit("map_75"), (F.col("s_suppkey") % 5).cast("double")))
    r = c.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("registered_at"), F.map_filter(F.create_map(F.lit("val"), m), lambda k, v: v.isNotNull()).alias("metrics"))
    return registry.best_experiment(r).select("name", F.col("metrics")["val"]["map"].alias("map"), F.col("metrics")["val"]["map_75"].alias("map_75"))


@query
def best_epoch(s, d):
    e = fixture(s, d, "epochs")
    k = F.from_json("payload", "k int")["k"]
    log = e.select("run_id", F.col("event_id").alias("epoch"), F.array(F.round("map_score", 1), F.lit(0.0), k.cast("double")).alias("stats"))
    out = registry.best_epoch(log, ["run_id"])
    return out.select("run_id", "epoch", F.get("stats", 0).alias("map"), F.get("stats", 2).alias("map_75"))


@query
def early_stop(s, d):
    e = fixture(s, d, "epochs").select("run_id", F.col("event_id").alias("epoch"), F.round("map_score", 2).alias("map_score"))
    return registry.stale_epochs(e, 5).select("run_id", "epoch", "stale", "stops")


@query
def quality_gate(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") / 50.0).alias("map_50"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 10) / 10.0).alias("map"))
    return registry.quality_gate(p).select("p_partkey", "passes")


# --- tracking


@query
def iou_tracker(s, d):
    c = detection.top_k(candidates(s, d), 20, ["segment_id", "frame_idx"], TIES).withColumn("det_id", F.col("rank").cast("long"))
    return tracker.track(c)
