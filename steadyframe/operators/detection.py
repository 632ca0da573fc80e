"""Detection evaluation: operating points, error taxonomy, buckets, diagnostics and mean average precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyframe.functions.geometry import area, box, iou, ratio
from steadyframe.functions.quantiles import exact_quantiles


def top_k(candidates: DataFrame, k: int, keys: list[str], ties: list[str]) -> DataFrame:
    """The ``k`` best-scored rows of each group, with ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *ties)
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_iou(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("iou", iou(box(), box("gt_")))


def confusion(score: Column, overlap: Column, threshold: Column, overlap_threshold: float) -> list[Column]:
    """tp, fp and fn; a prediction that does not match counts in both fp and fn."""
    said, fits = score >= threshold, overlap >= overlap_threshold
    return [F.count_if(said & fits).alias("tp"), F.count_if(said & ~fits).alias("fp"), F.count_if(~(said & fits)).alias("fn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Add precision, recall and f1, 0 where they have no denominator."""
    out = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def thresholds(low: float, high: float, n: int) -> list[float]:
    return [float(x) for x in np.linspace(low, high, n)]


def threshold_sweep(rows: DataFrame, values: list[float], overlap_threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Confusion and rates at every threshold, from one pass.

    Rows (score, iou) are counted by the last threshold they reach, so that what is multiplied by the thresholds is
    those counts and not the rows.
    """
    keys = keys or []
    reach = F.size(F.filter(F.lit(values), lambda t: t <= F.col("score")))
    fits = F.col("iou") >= overlap_threshold
    counts = rows.groupBy(*keys, reach.alias("reach")).agg(F.count_if(fits).alias("hit"), F.count_if(~fits).alias("miss"))
    steps = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(values)]))
    out = counts.withColumn("s", steps).groupBy(*keys, "s.threshold", "s.k").agg(
        F.sum(F.when(F.col("reach") >= F.col("s.k"), F.col("hit")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("reach") >= F.col("s.k"), F.col("miss")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reach") >= F.col("s.k"), F.col("miss")).otherwise(F.col("hit") + F.col("miss"))).alias("fn"),
    )
    return with_rates(out.drop("k"))


def best_row(df: DataFrame, by: list[str], ordinal: str, keys: list[str] | None = None) -> DataFrame:
    """The row with the lexicographically largest ``by``; the first in ``ordinal`` on ties. Per group if keys are given."""
    order = [F.desc(c) for c in by] + [F.col(ordinal)]
    if not keys:
        return df.orderBy(*order).limit(1)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def selection_summary(rows: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """frames, mean_iou, iou50_rate, iou75_rate and the confusions at 0.5 and 0.75 of selected rows (score, iou)."""
    t = F.lit(threshold)
    named = lambda cs, s: [c.alias(f"{n}_{s}") for c, n in zip(cs, ("tp", "fp", "fn"))]
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("frames"),
        F.avg("iou").alias("mean_iou"),
        F.avg((F.col("iou") >= 0.5).cast("double")).alias("iou50_rate"),
        F.avg((F.col("iou") >= 0.75).cast("double")).alias("iou75_rate"),
        *named(confusion(F.col("score"), F.col("iou"), t, 0.5), "50"),
        *named(confusion(F.col("score"), F.col("iou"), t, 0.75), "75"),
    )


def per_image_errors(candidates: DataFrame, keys: list[str], ties: list[str], width: float = 1920, height: float = 1080) -> DataFrame:
    """Per image: score and overlap of the best-scored box, best overlap of any, boxes from 0.25 on, and where its ground truth is."""
    order = F.struct(F.col("score"), *[(-F.col(t)).alias(f"n_{t}") for t in ties])
    gt = box("gt_")
    return (
        with_iou(candidates)
        .groupBy(*keys)
        .agg(
            F.max("score").alias("top_score"),
            F.max_by("iou", order).alias("top_iou"),
            F.max("iou").alias("best_iou_any"),
            F.count_if(F.col("score") >= 0.25).alias("predictions_at_025"),
            *[F.min(c).alias(c) for c in ("gt_x1", "gt_y1", "gt_x2", "gt_y2")],
        )
        .withColumn("gt_area_fraction", area(gt) / (width * height))
        .withColumn("gt_center_x", (gt[0] + gt[2]) / 2 / width)
        .withColumn("gt_center_y", (gt[1] + gt[3]) / 2 / height)
    )


def error_type(score: Column, overlap: Column, threshold: float) -> Column:
    return (
        F.when(score < threshold, "missed_low_confidence")
        .when(overlap < 0.5, "localization_iou_below_050")
        .when(overlap < 0.75, "localization_iou_050_to_075")
        .otherwise("correct_iou_075")
    )


def area_edges(validation: DataFrame) -> DataFrame:
    """The .33 and .67 quantiles of the ground truth's area, one row."""
    edges = exact_quantiles(validation, "gt_area_fraction", [0.33, 0.67])
    return validation.sparkSession.createDataFrame([tuple(edges)], "e0 double, e1 double")


def with_buckets(rows: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add area_bucket (right-closed at the edges), position_bucket and time_quartile (of the frames' order, per ``keys``)."""
    x, y = F.col("gt_center_x") - 0.5, F.col("gt_center_y") - 0.5
    out = rows.crossJoin(F.broadcast(edges))  # one row
    out = out.withColumn("area_bucket", F.when(F.col("gt_area_fraction") <= F.col("e0"), "small").when(F.col("gt_area_fraction") <= F.col("e1"), "medium").otherwise("large"))
    out = out.withColumn("position_bucket", F.when(F.sqrt(x * x + y * y) > 0.4, "edge").otherwise("central"))
    return time_quartile(out, keys or ["split"]).drop("e0", "e1")


def value_ranges(rows: DataFrame, keys: list[str], by: str, ranges: int = 64) -> DataFrame:
    """Add ``__b``: the range of ``by`` within its group, cut at approximate quantiles; equal values share a range.

    Ranks and running sums over a group then need one window for each range, and the ranges' totals. There is one row of cuts for each group.
    """
    shares = F.lit([k / ranges for k in range(1, ranges)])
    cuts = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.array_distinct(F.percentile_approx(by, shares, 10_000)).alias("__cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(cuts, same).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(by)))).drop("__cuts", *[f"__{k}" for k in keys])


def _with_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """Rows with what windows over their groups' ranges give, from one row of totals for each range."""
    at = [*keys, "__b"]
    known = rows.groupBy(*at).agg(*[c.alias(n) for n, c in totals.items()]).withColumns(over)
    return rows.join(known.select(*[F.col(k).alias(f"__{k}") for k in at], *over), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in at]).drop(*[f"__{k}" for k in at])


def running_sums(rows: DataFrame, keys: list[str], by: str, sums: dict[str, str]) -> DataFrame:
    """Rows of ``value_ranges`` with sums (new name: column) over the group's rows of this value of ``by`` and higher ones."""
    above = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    out = _with_totals(rows, keys, {f"__t_{n}": F.sum(c) for n, c in sums.items()}, {f"__o_{n}": F.coalesce(F.sum(f"__t_{n}").over(above), F.lit(0)) for n in sums})
    inner = Window.partitionBy(*keys, "__b").orderBy(F.desc(by))
    return out.withColumns({n: F.sum(c).over(inner) + F.col(f"__o_{n}") for n, c in sums.items()}).drop(*[f"__o_{n}" for n in sums])


def falling_max(rows: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """Rows of ``value_ranges`` with ``value`` raised to the most that rows of its group have at this ``by`` or a lower one."""
    below = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    out = _with_totals(rows, keys, {"__most": F.max(value)}, {"__low": F.max("__most").over(below)})
    inner = Window.partitionBy(*keys, "__b").orderBy(by)
    return out.withColumn(value, F.greatest(F.max(value).over(inner), F.col("__low"))).drop("__low")


def places(rows: DataFrame, keys: list[str], by: str, ties: list[str] | None = None) -> DataFrame:
    """Rows of ``value_ranges`` with ``__r`` and ``__n``: the place from 1 by ``by`` (and ``ties``; without, the rank) and the group's size."""
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    out = _with_totals(rows, keys, {"__m": F.count("*")}, {"__o": F.coalesce(F.sum("__m").over(before), F.lit(0)), "__n": F.sum("__m").over(Window.partitionBy(*keys))})
    inner = Window.partitionBy(*keys, "__b").orderBy(by, *(ties or []))
    return out.withColumn("__r", (F.row_number() if ties else F.rank()).over(inner) + F.col("__o")).drop("__o")


def time_quartile(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("frame_idx", "segment_id")) -> DataFrame:
    """Quartile of the rank by frame within each group, cut where interpolated quantiles of the ranks lie."""
    ranked = places(value_ranges(rows, keys, order[0]), keys, order[0], list(order[1:]))
    q = F.greatest(F.lit(1), F.ceil(4 * (F.col("__r") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))).cast("int"))
    return ranked.withColumn("time_quartile", F.concat(F.lit("Q"), q.cast("string"))).drop("__r", "__n", "__b")


def group_diagnostics(rows: DataFrame, threshold: float) -> DataFrame:
    """n, mean overlap, confusion and rates over each of three dimensions."""
    dims = ["area_bucket", "position_bucket", "time_quartile"]
    long = rows.select("top_score", "top_iou", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("bucket")) for d in dims])).alias("d"))
    out = long.groupBy("d.dimension", "d.bucket").agg(F.count("*").alias("n"), F.avg("top_iou").alias("mean_top_iou"), *confusion(F.col("top_score"), F.col("top_iou"), F.lit(threshold), 0.5))
    return with_rates(out)


def worst_errors(rows: DataFrame, threshold: float, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` rows of highest error priority."""
    p = F.when(F.col("top_score") >= threshold, 1 - F.col("top_iou")).otherwise(1 + threshold - F.col("top_score"))
    return rows.withColumn("error_priority", p).orderBy(F.desc(F.round("error_priority", 9)), *ties).limit(n)


def analyze_errors(validation: DataFrame, test: DataFrame, keys: list[str], ties: list[str]) -> tuple[DataFrame, DataFrame, dict]:
    """(images, sweep, summary) of candidates of two splits: every image with its error and buckets, the validation split's operating points, and what they come to.

    The threshold is that of the best (f1, precision) over the validation images at an overlap of one half; edges of sizes are the validation split's too.
    """
    images = per_image_errors(validation, keys, ties).withColumn("split", F.lit("validation")).unionByName(per_image_errors(test, keys, ties).withColumn("split", F.lit("test")))
    known = images.where("split = 'validation'")
    sweep = threshold_sweep(known.select(F.col("top_score").alias("score"), F.col("top_iou").alias("iou")), thresholds(0.05, 0.95, 91))
    best = best_row(sweep, ["f1", "precision"], "threshold").first()
    if best is None:
        raise ValueError("the analysis needs validation candidates")
    at = best["threshold"]
    images = with_buckets(images, area_edges(known)).withColumn("error_type", error_type(F.col("top_score"), F.col("top_iou"), at))
    summary: dict = {"threshold_selected_on_validation": at}
    for split in ("validation", "test"):
        own = images.where(F.col("split") == split)
        for name, level in (("iou50", 0.5), ("iou75", 0.75)):
            row = with_rates(own.agg(*confusion(F.col("top_score"), F.col("top_iou"), F.lit(at), level))).first()
            summary[f"{split}_top1_{name}"] = row.asDict()
        summary[f"{split}_mean_top_iou"] = own.agg(F.avg("top_iou")).first()[0]
    own = images.where("split = 'test'")
    summary["test_error_counts"] = {r["error_type"]: r["n"] for r in own.groupBy("error_type").agg(F.count("*").alias("n")).collect()}
    summary["test_group_diagnostics"] = [r.asDict() for r in group_diagnostics(own, at).orderBy("dimension", "bucket").collect()]
    summary["test_ranking_failures"] = own.where("top_iou < 0.5 and best_iou_any >= 0.5").count()
    return images, sweep, summary


#: Areas of ground truth in square pixels, ends included, and the most detections an image counts with.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = (1, 10, 100)


def matched_truths(ranked: DataFrame, truths: DataFrame, image: list[str], overlaps: list[float]) -> DataFrame:
    """Greedy matching of detections and ground truth: rows (image, area, t, score, rank, size, counted) of the detections that match.

    ``ranked`` has score, rank and a box, ``truths`` truth_id, a box and crowd (true: any number of detections may match it, and its overlap is the share of the detection). By
    rank, a detection takes the free truth of most overlap, ``t`` at least; of equal ones the last by truth_id; one that does not count in the area (a crowd, or of another
    size) only if no other is left, and then the detection is not ``counted`` either. A fold over an image's arrays, which hold only what overlaps by half or more, for each area and ``t``.
    """
    own = truths.select(*image, "truth_id", F.coalesce("crowd", F.lit(False)).alias("crowd"), area(box()).alias("size"), F.struct(*[F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("__gt"))
    known = own.groupBy(*image).agg(F.array_sort(F.collect_list(F.struct("truth_id", "crowd", "size"))).alias("truths"))
    pairs = ranked.select(*image, "score", "rank", *box(), area(box()).alias("own")).join(own, image)
    gt = [F.col("__gt")[c] for c in ("x1", "y1", "x2", "y2")]
    both = F.greatest(F.lit(0.0), F.least(F.col("x2"), gt[2]) - F.greatest(F.col("x1"), gt[0])) * F.greatest(F.lit(0.0), F.least(F.col("y2"), gt[3]) - F.greatest(F.col("y1"), gt[1]))
    pairs = pairs.withColumn("iou", F.when(F.col("crowd"), both / F.greatest("own", F.lit(1e-12))).otherwise(iou(box(), gt))).where(F.col("iou") >= overlaps[0])
    near = pairs.groupBy(*image, "rank", "score", "own").agg(F.collect_list(F.struct("truth_id", "iou")).alias("near"))
    dets = near.groupBy(*image).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "own", "near"))).alias("dets")).join(known, image)
    ranges = F.array(*[F.struct(F.lit(n).alias("area"), F.lit(low).alias("low"), F.lit(high).alias("high")) for n, (low, high) in AREAS.items()])
    dets = dets.withColumn("r", F.explode(ranges)).withColumn("t", F.explode(F.lit(overlaps)))
    dets = dets.withColumn("real", F.expr("transform(filter(truths, x -> not x.crowd and x.size between r.low and r.high), x -> x.truth_id)"))
    dets = dets.withColumn("crowds", F.expr("transform(filter(truths, x -> x.crowd), x -> x.truth_id)"))
    kind = dict(dets.dtypes)["real"]
    fold = f"""aggregate(dets, named_struct('taken', cast(array() as {kind}), 'found', cast(array() as array<struct<rank:int,score:double,size:double,counted:boolean>>)),
      (acc, d) -> aggregate(filter(array(array_max(transform(filter(d.near, p -> p.iou >= t and not array_contains(acc.taken, p.truth_id)), p -> named_struct('real', array_contains(real, p.truth_id), 'iou', p.iou, 'id', p.truth_id)))), b -> b is not null), acc,
        (s, b) -> named_struct('taken', if(array_contains(crowds, b.id), s.taken, concat(s.taken, array(b.id))),
          'found', concat(s.found, array(named_struct('rank', d.rank, 'score', d.score, 'size', d.own, 'counted', b.real))))), acc -> acc.found)"""
    return dets.select(*image, F.col("r.area").alias("area"), "t", F.explode(F.expr(fold)).alias("m")).select(*image, "area", "t", "m.*")


def mean_average_precision(candidates: DataFrame, image: list[str], ties: list[str], truths: DataFrame | None = None) -> DataFrame:
    """The twelve COCO statistics, one row: map, map_50, map_75, mar_1, mar_10, mar_100, and map_ and mar_ of small, medium and large.

    ``truths`` has any number of boxes an image, with truth_id and crowd; images without a candidate count too. By default each image of ``candidates`` has the one box of
    its gt_ columns. Matching is greedy, at each of ten overlaps and in each area range. Detections matched to ground truth that does not count (crowds, other
    sizes) are left out, and so are unmatched ones of other sizes. Precision over all
    boxes by score is made to fall only, and read at 101 recalls. -1 where a range has no ground truth. Running counts over all boxes go by
    ranges of scores, so that no task holds all of them.
    """
    overlaps = [round(0.5 + 0.05 * k, 2) for k in range(10)]
    ranked = top_k(candidates, MOST[-1], image, ties)
    if truths is None:
        gt = [F.col(f"gt_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
        truths = candidates.select(*image, *gt).dropDuplicates(image).withColumns({"truth_id": F.lit(0), "crowd": F.lit(False)})
    within = lambda a: F.filter(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(r[0]).alias("low"), F.lit(r[1]).alias("high")) for n, r in AREAS.items()]), lambda r: (a >= r["low"]) & (a <= r["high"]))["area"]
    counting = truths.where(~F.coalesce("crowd", F.lit(False))).select(F.explode(within(area(box()))).alias("area"))
    images = counting.groupBy("area").agg(F.count("*").alias("n"))
    keys = ["area", "t"]
    found = matched_truths(ranked, truths, image, overlaps)
    # a detection counts in the areas it lies in; matched, it counts where its truth does
    inside = ranked.select("score", F.explode(within(area(box()))).alias("area")).groupBy("area", "score").agg(F.count("*").alias("all"))
    level = F.array(*[F.lit(t) for t in overlaps])
    inside = inside.select("area", F.explode(level).alias("t"), "score", F.lit(0).cast("long").alias("tp"), "all")
    ranks = [F.lit(0).cast("long").alias(f"r{k}") for k in MOST]
    inside = inside.select("*", *ranks)
    hit = F.col("counted").cast("long")
    moved = found.select(*keys, "score", hit.alias("tp"), (hit - F.array_contains(within(F.col("size")), F.col("area")).cast("long")).alias("all"), *[F.when(F.col("rank") <= k, hit).otherwise(0).alias(f"r{k}") for k in MOST])
    sums = ("tp", "all", *[f"r{k}" for k in MOST])
    by_score = inside.unionByName(moved).groupBy(*keys, "score").agg(*[F.sum(c).alias(c) for c in sums]).persist()  # read several times
    curve = running_sums(value_ranges(by_score, keys, "score"), keys, "score", {"ctp": "tp", "call": "all"}).where("tp > 0").join(F.broadcast(images), "area")
    at = falling_max(curve.withColumn("p", F.col("ctp") / F.col("call")), keys, "score", "p")
    # recall points r/100 after the recall that was reached before, up to this row's, read this row's precision
    point = lambda found: F.floor(found / F.col("n") * 100 + 1e-9)
    before = F.col("ctp") - F.col("tp")
    points = point(F.col("ctp")) - F.when(before > 0, point(before)).otherwise(-1)
    found = at.groupBy(*keys).agg((F.sum(points * F.col("p")) / 101).alias("ap"), *[F.sum(f"r{k}").alias(f"r{k}") for k in MOST])
    grid_ = images.withColumn("t", F.explode(F.lit(overlaps)))
    both = grid_.join(found, keys, "left").fillna(0)
    of = lambda name, c: F.coalesce(F.avg(F.when(F.col("area") == name, c)), F.lit(-1.0))
    at_level = lambda t: F.coalesce(F.avg(F.when((F.col("area") == "all") & (F.col("t") == t), F.col("ap"))), F.lit(-1.0))
    return both.agg(
        of("all", F.col("ap")).alias("map"),
        at_level(0.5).alias("map_50"),
        at_level(0.75).alias("map_75"),
        *[of(n, F.col("ap")).alias(f"map_{n}") for n in list(AREAS)[1:]],
        *[of("all", F.col(f"r{k}") / F.col("n")).alias(f"mar_{k}") for k in MOST],
        *[of(n, F.col(f"r{MOST[-1]}") / F.col("n")).alias(f"mar_{n}") for n in list(AREAS)[1:]],
    )
