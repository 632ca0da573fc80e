"""Ingestion: label lines, identities, audit, splits and annotation anomalies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyframe.functions.geometry import clip, corners

# Names of videos (without the ending) and of label folders.
VIDEO_NAME = r"^(VID\d+)(?:_([A-Za-z0-9]+))?(?:_\d+fps)?$"
LABEL_NAME = r"^(VID\d+)_([A-Za-z0-9]+)seg$"
LABEL_FIELDS = ["class_id", "object_id", "cx", "cy", "width", "height"]


def parse_labels(lines: DataFrame, classes: dict[int, str], raw: str = "raw_line") -> DataFrame:
    """Label lines to typed columns and ``error`` (NULL if valid, else the first rule broken); blank lines go.

    A line has six comma-separated fields: two integers, then four numbers in (0, 1].
    """
    text = F.trim(F.regexp_replace(raw, "^﻿", ""))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    out = lines.withColumn("parts", parts).where(text != "")
    at = lambda k: F.get("parts", k)
    out = out.withColumns({f: at(k).try_cast("int" if k < 2 else "double") for k, f in enumerate(LABEL_FIELDS)})
    sizes = [F.col(f) for f in LABEL_FIELDS[2:]]
    bad = [s.isNull() | F.isnan(s) | ~((s > 0) & (s <= 1)) for s in sizes]
    known = F.col("class_id").isin(list(classes))
    error = (
        F.when(F.size("parts") != 6, "expected 6 columns")
        .when(F.col("class_id").isNull() | F.col("object_id").isNull(), "not an integer")
        .when(~known, "unknown class")
        .when(bad[0] | bad[1] | bad[2] | bad[3], "invalid normalized box")
    )
    return out.withColumn("error", error).drop("parts")


def identity(name: Column, kind: str, overrides: dict[str, tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """(case_id, segment_id) of a video file or label folder. A video that fits no form is its own case and segment; a folder is NULL."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "") if kind == "video" else name
    pattern = VIDEO_NAME if kind == "video" else LABEL_NAME
    case, part = F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2)
    missing = stem if kind == "video" else F.lit(None).cast("string")
    found_case = F.when(case == "", missing).otherwise(case)
    found_segment = F.when(case == "", missing).when(part == "", case).otherwise(F.concat_ws("_", case, part))
    for key, (c, s) in (overrides or {}).items():
        if not (isinstance(c, str) and isinstance(s, str) and c and s):
            raise ValueError(f"override of {key} must be two names")
        found_case, found_segment = F.when(name == key, c).otherwise(found_case), F.when(name == key, s).otherwise(found_segment)
    return found_case, found_segment


def label_sets(labels: DataFrame) -> DataFrame:
    """Parsed lines (case_id, segment_id, path, frame_idx, object_id, error) to one row a label set. Files with an error don't count their rows."""
    files = labels.groupBy("path", "case_id", "segment_id", "frame_idx").agg(F.max(F.col("error").isNotNull()).alias("bad"), F.count("*").alias("n"))
    sets = files.groupBy("path", "case_id", "segment_id").agg(
        F.count("*").alias("label_files"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("annotation_rows"),
        F.min(F.when(~F.col("bad"), F.col("frame_idx"))).alias("minimum_frame"), F.max(F.when(~F.col("bad"), F.col("frame_idx"))).alias("maximum_frame"),
    )
    good = labels.join(files.where("not bad").select("path", "frame_idx"), ["path", "frame_idx"], "left_semi")
    objects = good.groupBy("path", "object_id").agg(F.count("*").alias("n")).groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("object_id", "n")))).alias("object_ids"))
    return sets.join(objects, "path", "left")


def audit(sets: DataFrame, videos: DataFrame) -> DataFrame:
    """Label sets with ``status``. Of several videos of a segment the last by path counts; a frame out of range outweighs the rest."""
    last = Window.partitionBy("segment_id").orderBy(F.desc("path"))
    known = videos.withColumn("r", F.row_number().over(last)).where("r = 1").select("segment_id", "readable", "frame_count")
    out = sets.join(known, "segment_id", "left")
    ready = F.coalesce(F.col("readable"), F.lit(False))
    beyond = ready & F.coalesce(F.col("maximum_frame") >= F.coalesce("frame_count", F.lit(0)), F.lit(False))
    status = F.when(beyond, "excluded_label_frame_out_of_range").when(ready, "ready").otherwise("excluded_missing_or_corrupt_video")
    return out.withColumn("status", status).drop("readable", "frame_count")


def audit_summary(sets: DataFrame, videos: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts over videos, label sets and errors, one row."""
    v = videos.agg(F.count("*").alias("video_count"), F.count_if("readable").alias("readable_video_count"))
    s = sets.agg(F.coalesce(F.sum("label_files"), F.lit(0)).alias("label_file_count"), F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col("label_files"))), F.lit(0)).alias("ready_label_file_count"))
    return v.crossJoin(s).crossJoin(errors.agg(F.count("*").alias("error_count")))


def pixel_boxes(labels: DataFrame, width: Column, height: Column) -> DataFrame:
    """Add x, y, w, h and area in pixels, clipped to the frame."""
    left, top, right, bottom = corners(F.col("cx"), F.col("cy"), F.col("width"), F.col("height"))
    x, y = clip(left, 0.0, 1.0) * width, clip(top, 0.0, 1.0) * height
    w, h = clip(right, 0.0, 1.0) * width - x, clip(bottom, 0.0, 1.0) * height - y
    return labels.withColumns({"x": x, "y": y, "w": w, "h": h}).withColumn("area", F.col("w") * F.col("h"))


def numbered(rows: DataFrame, name: str, keys: list[str], per_bucket: str) -> DataFrame:
    """Add consecutive ids from 1 over the order of ``keys`` without one task for all: counts per ``per_bucket`` value first.

    ``per_bucket`` must be the first of the keys; its distinct values and counts are the only thing that is ordered globally.
    """
    inner = F.row_number().over(Window.partitionBy(per_bucket).orderBy(*keys[1:]))
    counts = rows.groupBy(per_bucket).agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(per_bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return rows.withColumn("__k", inner).join(offsets, per_bucket).withColumn(name, F.col("__k") + F.col("__before")).drop("__k", "__before")


def coco_documents(images: DataFrame, annotations: DataFrame, per_segment: bool = False) -> DataFrame:
    """One row per split: images and annotations as sorted arrays of structs; unused and unassigned splits go.

    A split must fit in a row. ``per_segment`` gives a row for each segment of a split in place of that, so that a row is as large as a video.
    """
    keys = ["split", "segment_id"] if per_segment else ["split"]
    used = images.where(~F.col("split").isin("unused", "unassigned"))
    i = used.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("image_id", "file_name", "width", "height", F.col("segment_id").alias("segment_id"), "frame_idx"))).alias("images"))
    if per_segment:
        annotations = annotations.join(used.select("image_id", "segment_id").distinct(), "image_id")
    a = annotations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("annotation_id", "image_id", "bbox", "area"))).alias("annotations"))
    return i.join(a, keys, "left")


def split_by_segment(manifest: DataFrame, scheme: dict[str, list[str]]) -> DataFrame:
    """Add ``split`` from a segment list per split; raises if a segment is in two, in none or unknown."""
    named = [(s, k) for k, ss in scheme.items() for s in ss]
    if len({s for s, _ in named}) != len(named):
        raise ValueError("A segment is in more than one split")
    table = manifest.sparkSession.createDataFrame(named, "segment_id string, split string")
    seen = manifest.select("segment_id").distinct()
    off = [r[0] for r in seen.join(table, "segment_id", "left_anti").unionAll(table.join(seen, "segment_id", "left_anti").select("segment_id")).limit(20).collect()]
    if off:
        raise ValueError(f"Segments without a split, or unknown: {sorted(off)}")
    return manifest.join(F.broadcast(table), "segment_id", "left")


def case_splits(cases: list[str], test: float, val: float, minimum: int, seed: int) -> dict[str, str]:
    """Seeded split of whole cases: at least one for test and one for val."""
    if len(cases) < minimum:
        raise ValueError(f"A split needs at least {minimum} cases; found {len(cases)}")
    order = sorted(cases)
    np.random.default_rng(seed).shuffle(order)
    n = len(order)
    n_test, n_val = max(1, round(n * test)), max(1, round(n * val))
    if n_test + n_val >= n:
        n_test = n_val = 1
    return {c: "test" if k < n_test else "val" if k < n_test + n_val else "train" for k, c in enumerate(order)}


def split_by_case(manifest: DataFrame, splits: dict[str, str]) -> DataFrame:
    """Add ``split`` by case; cases without one are train."""
    table = manifest.sparkSession.createDataFrame(list(splits.items()), "case_id string, split string")
    return manifest.join(F.broadcast(table), "case_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def smoke_split(manifest: DataFrame, most: int = 24, seed: int = 42) -> DataFrame:
    """Add ``split`` for a smoke run: up to ``most`` images of each segment, evenly spread; a seeded fifth of them (one at least) is smoke_val, the
    others smoke_train, and all other images unused."""
    images = manifest.select("image_id", "segment_id", "frame_idx").distinct()
    picked = even_sample(images, ["segment_id"], ["frame_idx", "image_id"], most).select("image_id").distinct()
    n = picked.count()
    held = picked.orderBy(F.xxhash64(F.lit(seed), "image_id"), "image_id").limit(max(1, n // 5)).withColumn("held", F.lit(True))
    chosen = picked.join(held, "image_id", "left").select("image_id", F.when(F.col("held"), "smoke_val").otherwise("smoke_train").alias("split"))
    return manifest.join(chosen, "image_id", "left").withColumn("split", F.coalesce("split", F.lit("unused")))


def assign_splits(manifest: DataFrame, settings: dict, smoke: bool = False, segment_holdout: bool = False) -> DataFrame:
    """Add ``split`` by the config's rules: by segment, for a smoke run, or else by whole cases.

    ``settings`` has seed, test, val, minimum_cases and, for segments, segment_holdout.
    """
    if smoke and segment_holdout:
        raise ValueError("a smoke run and a segment hold-out exclude each other")
    if segment_holdout:
        return split_by_segment(manifest, settings["segment_holdout"])
    if smoke:
        return smoke_split(manifest, seed=settings["seed"])
    cases = [r[0] for r in manifest.select("case_id").distinct().collect()]
    return split_by_case(manifest, case_splits(cases, settings["test"], settings["val"], settings["minimum_cases"], settings["seed"]))


def images_per_split(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.countDistinct("image_id").alias("images"))


def complete_join(labelled: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled frames with their decoded ones; raises if a labelled frame was not decoded."""
    lost = labelled.select(*keys).distinct().join(decoded, keys, "left_anti").limit(20).collect()
    if lost:
        raise ValueError(f"Labelled frames that were not decoded: {sorted(tuple(r) for r in lost)}")
    return labelled.join(decoded, keys)


def run_metadata(manifest: DataFrame, train: str, val: str, smoke: bool = False) -> DataFrame:
    """One row: each split's sorted cases, whether they share none, and the type of experiment that makes."""
    of = lambda split: F.sort_array(F.collect_set(F.when(F.col("split") == split, F.col("case_id"))))
    out = manifest.agg(of(train).alias("train_cases"), of(val).alias("val_cases")).withColumn("independent", ~F.arrays_overlap("train_cases", "val_cases"))
    kind = F.when(F.lit(smoke), "smoke").when(F.col("independent"), "case_holdout").otherwise("single_case_segment_holdout")
    return out.withColumns({"smoke": F.lit(smoke), "formal_result": ~F.lit(smoke) & F.col("independent"), "experiment_type": kind})


def first_ready_video(videos: DataFrame) -> DataFrame:
    """The first readable video, by path, whose segment is not its whole case."""
    return videos.where("readable and segment_id <> case_id").orderBy("path").limit(1)


def throughput(frames: Column, seconds: Column) -> Column:
    """Frames a second of model time, 0 without any."""
    return F.coalesce(F.try_divide(frames, seconds), F.lit(0.0))


def split_purity(manifest: DataFrame) -> DataFrame:
    """Per split its sorted cases, and whether no other split has any of them."""
    cases = manifest.groupBy("split").agg(F.array_join(F.sort_array(F.collect_set("case_id")), ",").alias("cases"))
    shared = manifest.select("case_id", "split").distinct().groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id")
    mixed = manifest.join(shared, "case_id", "left_semi").select("split").distinct().withColumn("mixed", F.lit(True))
    return cases.join(mixed, "split", "left").select("split", "cases", F.col("mixed").isNull().alias("independent"))


def even_sample(rows: DataFrame, keys: list[str], order: list[str], most: int = 24) -> DataFrame:
    """Up to ``most`` rows of each group, evenly spread over its order, ends included."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    out = out.withColumn("__m", F.least(F.lit(most), F.col("__n")))
    # row i is one of floor(j (n-1) / (m-1)), j = 0..m-1, in whole numbers
    j = F.ceil(F.col("__i") * (F.col("__m") - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = F.floor(j * (F.col("__n") - 1) / F.greatest(F.col("__m") - 1, F.lit(1))) == F.col("__i")
    return out.where((F.col("__m") == 1) & (F.col("__i") == 0) | (F.col("__m") > 1) & hit).drop("__i", "__n", "__m")


def robust_z(c: str, key: str) -> tuple[Column, Column]:
    """For two steps: the group's median, and given it as ``__med`` the scaled deviation's parts (see with_robust_z)."""
    return F.median(c).over(Window.partitionBy(key)), F.median(F.abs(F.col(c) - F.col("__med"))).over(Window.partitionBy(key))


def with_robust_z(rows: DataFrame, pairs: dict[str, str], key: str) -> DataFrame:
    """Add z scores by median and 1.4826 times the median deviation; by the population deviation where that is 0."""
    for name, c in pairs.items():
        med, mad = robust_z(c, key)
        out = rows.withColumn("__med", med).withColumn("__mad", 1.4826 * mad)
        sd = F.greatest(F.stddev_pop(c).over(Window.partitionBy(key)), F.lit(1e-12))
        scale = F.when(F.col("__mad") >= 1e-12, F.col("__mad")).otherwise(sd)
        rows = out.withColumn(name, (F.col(c) - F.col("__med")) / scale).drop("__med", "__mad")
    return rows


def box_shape(labels: DataFrame) -> DataFrame:
    """Add box_area_norm, aspect_ratio and boundary_margin (least distance of an edge from the frame's)."""
    left, top, right, bottom = corners(F.col("cx"), F.col("cy"), F.col("width"), F.col("height"))
    return labels.withColumns({"box_area_norm": F.col("width") * F.col("height"), "aspect_ratio": F.col("width") / F.col("height"), "boundary_margin": F.least(left, top, 1 - right, 1 - bottom)})


def position_speed(labels: DataFrame, key: str = "segment_id") -> DataFrame:
    """Add position_speed: movement since the row before over the time, which counts as 0.2 s at least; NULL after more than 2 s."""
    w = Window.partitionBy(key).orderBy("frame_idx")
    dt = F.col("time_s") - F.lag("time_s").over(w)
    move = F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    return labels.withColumn("position_speed", F.when(dt <= 2.0, move / F.greatest(dt, F.lit(0.2))))


def image_statistics(images: DataFrame, pixels: str = "pixels", width: int = 8) -> DataFrame:
    """Add brightness (mean), contrast (population deviation) and blur_variance (of the four-neighbour Laplacian, mirrored borders).

    For gray images as flat arrays of rows; array functions alone.
    """
    n = F.size(pixels)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)
    spread = lambda a, m: F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)
    height = F.floor(n / width).cast("int")
    mirror = lambda k, size: F.when(k < 0, -k).when(k >= size, 2 * size - 2 - k).otherwise(k)
    at = lambda r, c: F.get(F.col(pixels), mirror(r, height) * width + mirror(c, F.lit(width))).cast("double")

    def laplacian(k: Column) -> Column:
        r, c = F.floor(k / width).cast("int"), (k % width).cast("int")
        return at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c)

    out = images.withColumn("brightness", mean(F.col(pixels))).withColumn("__lap", F.transform(F.sequence(F.lit(0), n - 1), laplacian))
    out = out.withColumn("contrast", F.sqrt(spread(F.col(pixels), F.col("brightness")))).withColumn("__m", mean(F.col("__lap")))
    return out.withColumn("blur_variance", spread(F.col("__lap"), F.col("__m"))).drop("__lap", "__m")


#: Reason, column, whether small values are the odd ones. Fixed values.
REASONS = [
    ("small_box", "area_z", True), ("large_box", "area_z", False), ("extreme_aspect", "aspect_z_abs", False), ("boundary_box", "boundary_margin", True),
    ("position_jump", "speed_z", False), ("dark_frame", "brightness_z", True), ("bright_frame", "brightness_z", False), ("blurred_frame", "blur_z", True),
]


def scored(rows: DataFrame) -> DataFrame:
    """Labels with all measures that reasons look at: shape, movement and their z scores per segment; image statistics if they are there."""
    out = position_speed(box_shape(rows))
    pairs = {"area_z": "box_area_norm", "aspect_z": "aspect_ratio", "speed_z": "position_speed", "brightness_z": "brightness", "blur_z": "blur_variance"}
    out = with_robust_z(out, {z: c for z, c in pairs.items() if c in out.columns}, "segment_id")
    return out.withColumn("aspect_z_abs", F.abs("aspect_z"))


def anomalies(scored: DataFrame, k: int = 4, reasons: list[tuple[str, str, bool]] = REASONS) -> DataFrame:
    """The ``k`` oddest rows of each segment by each reason whose column is there: reason, rank, reason_score."""
    here = [r for r in reasons if r[1] in scored.columns]
    parts = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(c).cast("double").alias("reason_score"), (F.col(c) * (1.0 if low else -1.0)).alias("o")) for n, c, low in here])
    long = scored.select("segment_id", "frame_idx", F.explode(parts).alias("p")).select("segment_id", "frame_idx", "p.*").where("o is not null")
    w = Window.partitionBy("segment_id", "reason").orderBy(F.round("o", 9), "frame_idx")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("o")
