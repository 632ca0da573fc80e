"""From detections to camera metrics per segment: frame spine, dominant track, interpolation, smoothing, kinematics.

Every window is over (case_id, segment_id), so one exchange by these columns serves the whole chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyframe.functions.checks import require
from steadyframe.functions.geometry import box, center, radial

KEYS = ["case_id", "segment_id"]
REQUIRED = {"case_id", "segment_id", "frame_idx", "time_s", "class_name", "confidence", "x1", "y1", "x2", "y2", "frame_width", "frame_height", "track_id"}


@dataclass(frozen=True)
class Settings:
    target_class: str = "Harmonic0"
    confidence_threshold: float = 0.53
    center_radius: float = 0.2
    maximum_interpolation_gap_seconds: float = 0.6
    smoothing_window_seconds: float = 0.6


def qualified(s: Settings) -> Column:
    """Class and confidence filter; missing values do not qualify."""
    return F.coalesce((F.col("class_name") == s.target_class) & (F.col("confidence") >= s.confidence_threshold), F.lit(False))


def dominant_tracks(tracks: DataFrame, s: Settings) -> DataFrame:
    """Per segment the track with most qualified frames, then higher mean confidence, then smaller id."""
    stats = (
        tracks.where(qualified(s) & F.col("track_id").isNotNull())
        .groupBy(*KEYS, "track_id")
        .agg(F.countDistinct("frame_idx").alias("detected_frames"), F.avg("confidence").alias("mean_confidence"))
    )
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("detected_frames"), F.desc(F.round("mean_confidence", 9)), "track_id"))
    return stats.withColumn("rank", rank).where("rank = 1").drop("rank")


def best_per_frame(tracks: DataFrame, s: Settings) -> DataFrame:
    """One row per frame: its time and size, whether any detection qualifies, and the dominant track's best box (null if none).

    Of several boxes of a frame the most confident stays, the larger box coordinates on ties.
    """
    chosen = dominant_tracks(tracks, s).select(*KEYS, F.col("track_id").alias("dominant"))
    rows = tracks.withColumn("q", qualified(s)).join(chosen, KEYS, "left")
    own = F.col("q") & (F.col("dominant").isNull() | F.coalesce(F.col("track_id") == F.col("dominant"), F.lit(False)))
    best = F.struct("confidence", *box(), "track_id")
    return (
        rows.groupBy(*KEYS, "frame_idx")
        .agg(F.min("time_s").alias("time_s"), F.min("frame_width").alias("frame_width"), F.min("frame_height").alias("frame_height"), F.max("q").alias("any_detected"), F.max(F.when(own, best)).alias("b"))
        .select(*KEYS, "frame_idx", "time_s", "frame_width", "frame_height", "any_detected", F.col("b").isNotNull().alias("detected"), "b.confidence", "b.track_id", "b.x1", "b.y1", "b.x2", "b.y2")
    )


def segment() -> Window:
    return Window.partitionBy(*KEYS)


def in_order() -> Window:
    return segment().orderBy("frame_idx")


def add_step(frames: DataFrame, s: Settings) -> DataFrame:
    """Add rn (from 0), dt (median positive time step, 1 without one), max_gap and window (frames)."""
    gap = F.col("time_s") - F.lag("time_s").over(in_order())
    out = frames.withColumn("rn", F.row_number().over(in_order()) - 1).withColumn("gap", gap)
    dt = F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(segment()), F.lit(1.0))
    return (
        out.withColumn("dt", dt)
        .drop("gap")
        .withColumn("max_gap", F.greatest(F.lit(1), F.bround(F.lit(s.maximum_interpolation_gap_seconds) / F.col("dt")).cast("int")))
        .withColumn("window", F.greatest(F.lit(5), F.bround(F.lit(s.smoothing_window_seconds) / F.col("dt")).cast("int")))
    )


def interpolate(frames: DataFrame, *columns: str) -> DataFrame:
    """Fill inner gaps linearly in the row number, at most ``max_gap`` rows of each; adds ``<c>_i``. Two windows serve all columns."""
    before = in_order().rowsBetween(Window.unboundedPreceding, 0)
    after = segment().orderBy(F.desc("frame_idx")).rowsBetween(Window.unboundedPreceding, 0)  # backwards, as frames that only grow cost linear time
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("rn").alias("i"), F.col(c).alias("v"))) for c in columns}
    out = frames.withColumns({f"next_{c}": F.last(v, ignorenulls=True).over(after) for c, v in known.items()})
    out = out.withColumns({f"last_{c}": F.last(v, ignorenulls=True).over(before) for c, v in known.items()})
    filled = {}
    for c in columns:
        p, n = F.col(f"last_{c}"), F.col(f"next_{c}")
        inside = p.isNotNull() & n.isNotNull() & (F.col("rn") - p["i"] <= F.col("max_gap"))
        line = p["v"] + (n["v"] - p["v"]) * (F.col("rn") - p["i"]) / (n["i"] - p["i"])
        filled[f"{c}_i"] = F.when(F.col(c).isNotNull(), F.col(c)).when(inside, line)
    return out.withColumns(filled).drop(*[f"{side}_{c}" for c in columns for side in ("last", "next")])


def parabola_weight(m: Column, j: Column, t: Column) -> Column:
    """Weight of the value at place ``j`` of -m..m in the value at place ``t`` of the parabola of least squares: a sum over orthogonal polynomials."""
    n = 2 * m + 1
    mean = m * (m + 1) / 3.0
    second = n * mean
    spread = second * (3 * m * m + 3 * m - 1) / 5.0 - n * mean * mean
    return F.lit(1.0) / n + t * j / second + (t * t - mean) * (j * j - mean) / spread


def smooth(frames: DataFrame, *columns: str) -> DataFrame:
    """Second-order Savitzky-Golay over the non-missing values in order; adds ``<c>_s``.

    Under five values, or if fewer than five fit the width, values stay as they are. The first and last half
    widths take the end windows' parabola. A row's neighbours come from a range window over its place divided by the half width, which
    makes one bound fit every segment's width; no job runs before the query does.
    """
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    odd = F.when(F.col("window") % 2 == 1, F.col("window")).otherwise(F.col("window") + 1)
    out = frames.withColumns({f"k_{c}": F.count(c).over(so_far) - 1 for c in columns}).withColumns({f"nv_{c}": F.count(c).over(segment()) for c in columns})
    for c in columns:
        k, nv = F.col(f"k_{c}"), F.col(f"nv_{c}")
        width = F.least(odd.cast("int"), (F.floor(nv / 2) * 2 - 1).cast("int"))
        out = out.withColumn("w", width).withColumn("m", F.greatest(F.floor(F.col("w") / 2), F.lit(2)).cast("int"))
        near = segment().orderBy("at").rangeBetween(-2_000_002, 2_000_002)  # two half widths, and what rounding takes
        m = F.col("m")
        # rows without a value have the place of the last one, and lists leave them out
        out = out.withColumn("at", F.floor(k * 1_000_000 / m)).withColumn("near", F.collect_list(c).over(near))
        middle = F.least(F.greatest(k, m), nv - 1 - m)  # of the window that the row's parabola is fitted to
        own = F.slice("near", F.greatest(middle - m - F.greatest(k - 2 * m, F.lit(0)) + 1, F.lit(1)).cast("int"), 2 * m + 1)
        parts = F.transform(own, lambda v, i: v * parabola_weight(m, i - m, k - middle))
        value = F.aggregate(parts, F.lit(0.0), lambda total, v: total + v)
        on = F.col(c).isNotNull() & (nv >= 5) & (F.col("w") >= 5)
        out = out.withColumn(f"{c}_s", F.when(on, value).otherwise(F.col(c))).drop(f"k_{c}", f"nv_{c}", "w", "m", "at", "near")
    return out


def differentiate(frames: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add derivatives over time (new name: column) within runs of rows that have the value; no run is bridged.

    Second-order differences for uneven steps inside, one-sided at the ends; runs of one row or with a step that is not
    positive have none. One window in order serves all columns, as a neighbour without value is none.
    """
    w, before = in_order(), in_order().rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("time_s")
    place = {c: F.when(F.col(c).isNotNull() & t.isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v"))) for c in pairs.values()}
    out = frames.withColumns({f"{side}_{c}": f(v).over(w) for c, v in place.items() for side, f in (("last", F.lag), ("next", F.lead))} | {f"run_{c}": F.count_if(v.isNull()).over(before) for c, v in place.items()})
    slopes = {}
    for name, c in pairs.items():
        has, v = F.col(c).isNotNull() & t.isNotNull(), F.col(c)
        a, b, f0, f1 = t - F.col(f"last_{c}.t"), F.col(f"next_{c}.t") - t, v - F.col(f"last_{c}.v"), F.col(f"next_{c}.v") - v
        # of rows of a run, the one without value that begins it has no step of its own
        out = out.withColumn(f"ok_{c}", F.min(F.coalesce(~has | (a > 0), F.lit(True))).over(Window.partitionBy(*KEYS, f"run_{c}")))
        inner = (a * a * f1 + b * b * f0) / (a * b * (a + b))
        slopes[name] = F.when(~has | ~F.col(f"ok_{c}"), None).when(a.isNotNull() & b.isNotNull(), inner).when(b.isNotNull(), f1 / b).when(a.isNotNull(), f0 / a)
    return out.withColumns(slopes).drop(*[f"{x}_{c}" for c in pairs.values() for x in ("last", "next", "run", "ok")])


def kinematics(tracks: DataFrame, s: Settings) -> DataFrame:
    """Per frame: interpolated and smoothed centre, radial distance, speed, acceleration, jerk and jitter."""
    require(tracks, REQUIRED)
    x, y = center(box(), F.col("frame_width"), F.col("frame_height"))
    out = add_step(best_per_frame(tracks, s).withColumns({"x": x, "y": y}), s)
    out = smooth(interpolate(out, "x", "y"), "x_i", "y_i").withColumnsRenamed({"x_i_s": "x_s", "y_i_s": "y_s"})
    out = out.withColumn("radial", radial(F.col("x_s"), F.col("y_s")))
    out = differentiate(out, {"vx": "x_s", "vy": "y_s"}).withColumn("speed", F.hypot("vx", "vy"))
    out = differentiate(out, {"ax": "vx", "ay": "vy"}).withColumn("acceleration", F.hypot("ax", "ay"))
    out = differentiate(out, {"jerk": "acceleration"})
    return out.withColumn("jitter", F.hypot(F.col("x_i") - F.col("x_s"), F.col("y_i") - F.col("y_s")))


def missing_runs(frames: DataFrame, flag: str) -> DataFrame:
    """Per segment: how many runs of rows without the flag, and the rows of the longest."""
    out = frames.withColumn("run", F.row_number().over(in_order()) - F.row_number().over(Window.partitionBy(*KEYS, flag).orderBy("frame_idx")))
    runs = out.where(~F.col(flag)).groupBy(*KEYS, "run").agg(F.count("*").alias("n"))
    return runs.groupBy(*KEYS).agg(F.count("*").alias("gap_count"), F.max("n").alias("longest"))


def recenter_latencies(frames: DataFrame, radius: float) -> DataFrame:
    """Per return to the middle: seconds from the first frame outside to the first one inside again; an open end gives none."""
    out = frames.where("radial is not null").withColumn("outside", F.col("radial") > radius)
    out = out.withColumn("change", F.coalesce(F.lag("outside").over(in_order()) != F.col("outside"), F.lit(True)))
    starts = out.where("change").withColumn("until", F.lead("time_s").over(in_order()))
    return starts.where("outside and until is not null").select(*KEYS, "frame_idx", (F.col("until") - F.col("time_s")).alias("latency_s"))


def segment_metrics(tracks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The camera metrics of each segment, one row each; missing values are NULL."""
    frames = kinematics(tracks, s)
    # what aggregates need of their neighbours is marked by windows in order first, so that no join of aggregates and no other sort follows
    before, earlier = in_order().rowsBetween(Window.unboundedPreceding, 0), in_order().rowsBetween(Window.unboundedPreceding, -1)
    has, outside = F.col("radial").isNotNull(), F.col("radial") > s.center_radius
    marks = {"was_outside": F.last(outside, ignorenulls=True).over(earlier)}
    for f in ("any_detected", "detected"):
        marks[f"first_{f}"] = ~F.col(f) & F.coalesce(F.lag(f).over(in_order()), F.lit(True))
        marks[f"len_{f}"] = F.when(~F.col(f), F.col("rn") - F.coalesce(F.max(F.when(F.col(f), F.col("rn"))).over(before), F.lit(-1)))
    marks = frames.withColumns(marks).withColumn("change", has & F.coalesce(F.col("was_outside") != outside, F.lit(True)))
    # sides alternate, so the change before a return is the row on which the view went outside
    changed = F.last(F.when(F.col("change"), F.struct("time_s")), ignorenulls=True).over(earlier)
    marks = marks.withColumn("latency", F.when(F.col("change") & ~outside, F.col("time_s") - changed["time_s"]))
    share = lambda c: F.avg(c.cast("double"))
    out_of_view = (F.col("x_s") < 0) | (F.col("x_s") > 1) | (F.col("y_s") < 0) | (F.col("y_s") > 1)
    return (
        marks.groupBy(*KEYS)
        .agg(
            F.count("*").alias("frame_count"),
            (F.max_by("time_s", "frame_idx") - F.min_by("time_s", "frame_idx")).alias("duration_s"),
            share(F.col("any_detected")).alias("detection_rate"),
            share(F.col("detected")).alias("dominant_track_coverage_rate"),
            F.coalesce(share(F.when(F.col("detected") & has, F.col("radial") <= s.center_radius)), F.lit(0.0)).alias("centered_rate_detected"),
            F.avg("radial").alias("mean_center_distance"),
            F.percentile("radial", 0.95).alias("p95_center_distance"),
            F.coalesce(share(F.when(F.col("x_s").isNotNull() & F.col("y_s").isNotNull(), out_of_view)), F.lit(0.0)).alias("out_of_view_rate"),
            F.avg("speed").alias("mean_speed"),
            F.percentile("speed", 0.95).alias("p95_speed"),
            F.avg("acceleration").alias("mean_acceleration"),
            F.avg(F.abs("jerk")).alias("mean_abs_jerk"),
            F.sqrt(F.avg(F.col("jitter") * F.col("jitter"))).alias("jitter_rms"),
            F.count("latency").alias("recenter_event_count"),
            F.avg("latency").alias("mean_recenter_latency_s"),
            F.count_if("first_any_detected").alias("detection_gap_count"),
            (F.coalesce(F.max("len_any_detected"), F.lit(0)) * F.min("dt")).alias("longest_detection_gap_s"),
            F.count_if("first_detected").alias("dominant_track_gap_count"),
            (F.coalesce(F.max("len_detected"), F.lit(0)) * F.min("dt")).alias("longest_dominant_track_gap_s"),
        )
        .withColumn("trajectory_metrics_reliable", F.col("dominant_track_coverage_rate") >= 0.8)
    )


def legacy_metrics(tracks: DataFrame, s: Settings = Settings(confidence_threshold=0.25), keys: tuple[str, ...] = ("case_id", "segment_id")) -> DataFrame:
    """The older metrics: best box per (frame, time), differences only between directly neighbouring detected rows."""
    require(tracks, {*keys, "frame_idx", "time_s", "class_name", "confidence", "x1", "y1", "x2", "y2", "frame_width", "frame_height"}, "detection")
    best = F.struct("confidence", *box(), "frame_width", "frame_height")
    frames = tracks.groupBy(*keys, "frame_idx", "time_s").agg(F.max(F.when(qualified(s), best)).alias("b"))
    w = Window.partitionBy(*keys).orderBy("time_s", "frame_idx")
    x, y = center([F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")], F.col("b.frame_width"), F.col("b.frame_height"))
    out = frames.withColumns({"x": x, "y": y}).withColumn("radial", radial(F.col("x"), F.col("y")))
    dt = F.col("time_s") - F.lag("time_s").over(w)
    move = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = out.withColumn("dt", F.when(dt > 0, dt)).withColumn("speed", move / F.col("dt"))
    out = out.withColumn("acceleration", (F.col("speed") - F.lag("speed").over(w)) / F.col("dt"))
    out = out.withColumn("jerk", (F.col("acceleration") - F.lag("acceleration").over(w)) / F.col("dt"))
    has = F.col("b").isNotNull()
    return out.groupBy(*keys).agg(
        F.count("*").alias("frame_count"),
        (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        F.avg(has.cast("double")).alias("detection_rate"),
        F.coalesce(F.avg(F.when(has, (F.col("radial") <= s.center_radius).cast("double"))), F.lit(0.0)).alias("centered_rate"),
        F.avg("radial").alias("mean_center_distance"),
        F.percentile("radial", 0.95).alias("p95_center_distance"),
        F.avg("speed").alias("mean_speed"),
        F.percentile("speed", 0.95).alias("p95_speed"),
        F.avg(F.abs("acceleration")).alias("mean_abs_acceleration"),
        F.avg(F.abs("jerk")).alias("mean_abs_jerk"),
    )
