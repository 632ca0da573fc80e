"""Learned reranking of candidates: label-free features, contiguous folds, boosted trees."""

from __future__ import annotations

import bisect
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from steadyframe.functions.geometry import BOX, clip
from steadyframe.operators import boosting
from steadyframe.operators.detection import best_row, selection_summary, threshold_sweep, thresholds, with_iou

# The features, in the model's order.
FEATURES = [
    "f_score", "score_logit", "rank_reciprocal", "center_x", "center_y", "box_width", "box_height", "log_area", "log_aspect",
    "previous_support", "next_support", "previous_overlap", "next_overlap",
]


SIDES = ("previous", "next")
#: Boxes a tile at most, and pairs of boxes up to which all are compared.
TILE, FEW_PAIRS = 24, 500_000
#: About 32 MB of frames with their folds.
BROADCAST_FRAMES = 500_000


def neighbor_support(candidates: DataFrame, key: list[str], max_gap: int = 5) -> DataFrame:
    """Best overlap, and best overlap times score, with the candidates of the previous and next observed frame of the segment.

    ``key`` names a candidate within its frame. Frames more than ``max_gap`` apart do not support each other. A frame travels packed: its rows, and
    its distinct boxes with the best score of each. Both go to the frame's stretch of eight numbers, the boxes also to a stretch that begins or ends within ``max_gap``, where
    frames find their neighbours. Boxes are compared by tiles, and those that cannot reach a box's best are left out, so the results are those of all pairs.
    A box with missing or infinite corners gives and gets none.
    """
    return unpacked(*supported_frames(candidates, max_gap))


def supported_frames(candidates: DataFrame, max_gap: int = 5) -> tuple[DataFrame, T.StructType]:
    """(frames, schema): one row a frame (segment_id, frame_idx, rows), its candidates with their support packed in ``rows``; the schema is that of ``unpacked``."""
    frame = ["segment_id", "frame_idx"]
    at = candidates.withColumn("f_score", clip(F.col("score"), 1e-6, 1 - 1e-6))
    added = [f"{s}_{what}" for s in SIDES for what in ("overlap", "support")]
    schema = T.StructType([*at.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    target, names = to_arrow_schema(schema), at.columns
    types = {f.name: f.dataType for f in at.schema.fields}

    def pack(table: pa.Table) -> pa.Table:
        tiles, place = distinct_boxes(np.stack([table[c].to_numpy().astype(float) for c in (*BOX, "f_score")]))
        rows = blob(table.select(names).append_column("__place", pa.array(place)))
        columns = [table[c][:1].combine_chunks() for c in frame]
        return pa.table([*columns, pa.array([rows], pa.binary()), pa.array([tiles.tobytes()], pa.binary()), pa.array([tiles.shape[1]], pa.int32())], names=[*frame, "rows", "boxes", "tiles"])

    done = T.StructType([*[T.StructField(c, types[c]) for c in frame], T.StructField("rows", T.BinaryType())])
    packed = T.StructType([*done.fields, T.StructField("boxes", T.BinaryType()), T.StructField("tiles", T.IntegerType())])
    width = max(8, max_gap)
    stretch = lambda shift: F.floor((F.col("frame_idx") + shift) / width)
    sent = at.groupBy(*frame).applyInArrow(pack, packed).select("*", F.explode(F.array_distinct(F.array(*[stretch(d) for d in (-max_gap, 0, max_gap)]))).alias("stretch"))
    sent = sent.withColumn("rows", F.when(F.col("stretch").eqNullSafe(stretch(0)), F.col("rows")))

    def compare(table: pa.Table) -> pa.Table:
        order = table.column("frame_idx").to_pylist()
        boxes = {f: np.frombuffer(b.as_buffer(), dtype=float).reshape(5, n, -1) if n else np.zeros((5, 0, 1)) for f, b, n in zip(order, table["boxes"], table["tiles"].to_pylist())}
        seen, parts = sorted(f for f in boxes if f is not None), []
        for f, rows in zip(order, table["rows"]):
            if not rows.is_valid:
                continue
            own = pa.ipc.open_stream(rows.as_buffer()).read_all()
            place, k = own["__place"].to_numpy(), -1 if f is None else bisect.bisect_left(seen, f)
            own = own.select(names)
            for s, n in zip(SIDES, (k - 1, k + 1)):
                found = np.zeros((2, own.num_rows))
                if k >= 0 and 0 <= n < len(seen) and abs(seen[n] - f) <= max_gap:
                    best = np.stack(best_overlaps(boxes[f], boxes[seen[n]])).reshape(2, -1) / np.sqrt(max(1, abs(seen[n] - f)))
                    found[:, place >= 0] = best[:, place[place >= 0]]
                for what, values in zip(("overlap", "support"), found):
                    own = own.append_column(f"{s}_{what}", pa.array(values))
            parts.append([*[own[c][0].as_py() for c in frame], blob(own.cast(target), "zstd")])
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*parts), to_arrow_schema(done))], schema=to_arrow_schema(done)) if parts else to_arrow_schema(done).empty_table()

    return sent.groupBy("segment_id", "stretch").applyInArrow(compare, done), schema


def blob(table: pa.Table, codec: str | None = None) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
        writer.write_table(table)
    return out.getvalue()


def unpacked(frames: DataFrame, schema: T.StructType, added: tuple[str, ...] = ()) -> DataFrame:
    """The rows of packed frames, with the columns ``added`` of their frames."""
    whole = T.StructType([*schema.fields, *[frames.schema[c] for c in added]])
    target = to_arrow_schema(whole)

    def open_(batches):
        for batch in batches:
            for k, rows in enumerate(batch["rows"]):
                for part in pa.ipc.open_stream(rows.as_buffer()):
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.repeat(batch[c][k], part.num_rows) for c in added]], schema=target)

    return frames.select("rows", *added).mapInArrow(open_, whole)


def distinct_boxes(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, places) of boxes given as five arrays, four corners and a score.

    Tiles (5, tiles, boxes a tile) hold each distinct box once with its best score, and some twice to be of one size: a set is halved at the median of
    the corner that varies most. Places are those of the given boxes, counted through the tiles; -1 for a box with a corner that is not finite.
    """
    place = np.full(boxes.shape[1], -1)
    good = np.flatnonzero(np.isfinite(boxes[:4]).all(0))
    if not len(good):
        return np.zeros((5, 0, 1)), place
    good = good[np.lexsort(boxes[:4, good])]
    corners = boxes[:4, good]
    first = np.r_[True, (corners[:, 1:] != corners[:, :-1]).any(0)]
    once = np.vstack([corners[:, first], np.maximum.reduceat(boxes[4, good], np.flatnonzero(first))])
    n = once.shape[1]
    levels = max(0, int(np.ceil(np.log2(n / TILE))))
    order = np.minimum(np.arange(-(-n // 2**levels) * 2**levels), n - 1)[None]
    for _ in range(levels):
        part = once[:4, order]
        widest = (part.max(2) - part.min(2)).argmax(0)
        order = np.take_along_axis(order, part[widest, np.arange(len(order))].argsort(1, kind="stable"), 1).reshape(2 * len(order), -1)
    where = np.empty(n, dtype=np.int64)
    where[order.ravel()] = np.arange(order.size)
    place[good] = where[first.cumsum() - 1]
    return once[:, order], place


def best_overlaps(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each box of ``own`` the best overlap, and the best overlap times score, with boxes of ``other``; both in tiles (see distinct_boxes)."""
    size = own.shape[1:]
    overlap, support = np.zeros(size), np.zeros(size)
    if not own.size or not other.size:
        return overlap, support
    if own[0].size * other[0].size <= FEW_PAIRS:
        flat = other.reshape(5, -1)
        every = overlaps(own[:4, :, :, None], flat[:4])
        return every.max(2), (every * flat[4]).max(2)
    ends = [[x[:2].min(2), x[2:4].max(2), extent(x).min(1)] for x in (own, other)]
    area, score = extent(own), other[4].max(1)
    limit = overlap_limit(*[e[..., None] for e in ends[0]], *[e[..., None, :] for e in ends[1]])
    # a tile meets the others from the highest limit down, until none of its boxes can gain; first by support, which finds most of the best overlaps as well
    for limits, weight, best in ((limit * score, score, support), (limit, np.ones(len(score)), overlap)):
        turn, active = np.argsort(-limits, axis=1), np.arange(len(limits))
        for k in range(limits.shape[1]):
            tile = turn[active, k]
            more = limits[active, tile] > best[active].min(1)
            active, tile = active[more], tile[more]
            if not len(active):
                break
            single = overlap_limit(own[:2, active], own[2:4, active], area[active], *[e[..., tile, None] for e in ends[1]]) * weight[tile, None]
            a, box = np.nonzero(single > best[active])
            mine, theirs = (active[a], box), other[:, tile[a]]
            found = overlaps(own[:4, mine[0], box, None], theirs[:4])
            overlap[mine] = np.maximum(overlap[mine], found.max(1))
            support[mine] = np.maximum(support[mine], (found * theirs[4]).max(1))
    return overlap, support


def extent(r: np.ndarray) -> np.ndarray:
    return np.maximum(r[2] - r[0], 0) * np.maximum(r[3] - r[1], 0)


def overlap_limit(low: np.ndarray, high: np.ndarray, least: np.ndarray, low2: np.ndarray, high2: np.ndarray, least2: np.ndarray) -> np.ndarray:
    """No box of one tile overlaps one of the other by more: of either the lowest first corner, the highest second one and the least area; with room for rounding."""
    both = np.maximum(np.minimum(high[0], high2[0]) - np.maximum(low[0], low2[0]), 0) * np.maximum(np.minimum(high[1], high2[1]) - np.maximum(low[1], low2[1]), 0)
    return both / np.maximum(np.maximum(least, both) + np.maximum(least2, both) - both, 1e-12) * (1 + 1e-9)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes given as four arrays; negative extents count as 0."""
    both = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
    return both / np.maximum(extent(a) + extent(b) - both, 1e-12)


def candidate_features(candidates: DataFrame, key: list[str], width: float = 1920, height: float = 1080) -> DataFrame:
    """Candidates with the features that need no labels. Needs candidate_rank."""
    return own_features(neighbor_support(candidates, key), width, height)


def own_features(out: DataFrame, width: float = 1920, height: float = 1080) -> DataFrame:
    """The features besides the support: those of a candidate alone."""
    w = F.greatest(F.col("x2") - F.col("x1"), F.lit(1e-6)) / width
    h = F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-6)) / height
    return (
        out.withColumns({"box_width": w, "box_height": h})
        .withColumn("score_logit", F.ln(F.col("f_score") / (1 - F.col("f_score"))))
        .withColumn("rank_reciprocal", 1 / F.col("candidate_rank").cast("double"))
        .withColumn("center_x", (F.col("x1") + F.col("x2")) / (2 * width))
        .withColumn("center_y", (F.col("y1") + F.col("y2")) / (2 * height))
        .withColumn("log_area", F.ln(F.col("box_width") * F.col("box_height") + 1e-8))
        .withColumn("log_aspect", F.ln(F.col("box_width") / F.col("box_height")))
    )


def contiguous_folds(frames: DataFrame, folds: int = 5) -> DataFrame:
    """Distinct (segment, frame) with their fold from 0: contiguous in frame order; earlier folds take the remainder."""
    w = Window.partitionBy("segment_id").orderBy("frame_idx")
    return frames.select("segment_id", "frame_idx").distinct().withColumn("fold", F.ntile(folds).over(w) - 1)


def select_by_prediction(candidates: DataFrame, ties: list[str]) -> DataFrame:
    """Per frame the candidate of highest calibrated_iou, the first by ``ties`` if equal."""
    w = Window.partitionBy("segment_id", "frame_idx").orderBy(F.desc("calibrated_iou"), *ties)
    return candidates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _with_features(candidates: DataFrame, key: list[str]) -> DataFrame:
    return with_iou(candidate_features(candidates, key))


def out_of_fold(candidates: DataFrame, key: list[str], folds: int = 5, trees: int = 120) -> DataFrame:
    """Candidates with features, iou and calibrated_iou, predicted by boosted trees that did not see their fold.

    Neighbours' support is found once for all folds and kept in packed frames, one row each, so folds are joined to frames; the folds' models are
    fitted side by side.
    """
    frames, schema = supported_frames(candidates)
    frames = frames.persist()
    where = contiguous_folds(frames, folds)
    where = F.broadcast(where) if frames.count() <= BROADCAST_FRAMES else where
    rows = with_iou(own_features(unpacked(frames.join(where, ["segment_id", "frame_idx"]), schema, ("fold",))))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda m: m != F.col("fold"))
    nodes = boosting.fit(rows, FEATURES, "iou", ["segment_id", "frame_idx", *key], others, boosting.Boosting(trees=trees)).collect()
    return boosting.predict(rows, nodes, FEATURES, F.col("fold"))


def rerank(candidates: DataFrame, key: list[str], folds: int = 5, trees: int = 120) -> DataFrame:
    """The selected candidate of each frame by out-of-fold predictions."""
    return select_by_prediction(out_of_fold(candidates, key, folds, trees), key)


def learn(validation: DataFrame, test: DataFrame, key: list[str], folds: int = 5, trees: int = 120) -> tuple[DataFrame, DataFrame, float, DataFrame]:
    """(selected validation rows, selected test rows, threshold, summary): the whole protocol of the reranker.

    The threshold is that of the best (f1, precision) over the rows selected out of fold. A model of all validation rows then selects the test
    rows, whose ground truth is used for the summary alone: frames, mean_iou, rates and confusions of either.
    """
    chosen = rerank(validation, key, folds, trees)
    best = best_row(threshold_sweep(chosen, thresholds(0.01, 0.99, 99)), ["f1", "precision"], "threshold").first()
    if best is None:
        raise ValueError("learning needs validation candidates")
    known = _with_features(validation, key)
    nodes = boosting.fit(known, FEATURES, "iou", ["segment_id", "frame_idx", *key], F.array(F.lit(0)), boosting.Boosting(trees=trees)).collect()
    applied = select_by_prediction(boosting.predict(_with_features(test, key), nodes, FEATURES, F.lit(0)), key)
    parts = [selection_summary(rows, best["threshold"]).withColumns({"split": F.lit(split), "threshold": F.lit(best["threshold"])}) for split, rows in (("val", chosen), ("test", applied))]
    return chosen, applied, best["threshold"], parts[0].unionByName(parts[1])
