"""Path selection over a stream of candidates: a segment's frames are held until its end is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from steadyframe.functions.geometry import BOX
from steadyframe.operators.temporal import Trellis, Weights

#: Frames of a batch of the chosen path, as an inference loop would take them.
BATCH = 8
ROW = f"frame_idx long, score double, {', '.join(f'{c} double' for c in BOX)}, place long"
OUT = T.StructType(
    [T.StructField("segment_id", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("score", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in BOX]
    + [T.StructField("place", T.LongType())]
)


class Paths(StatefulProcessor):
    """Keeps the ``top_k`` best candidates of each frame of a segment, whatever order they come in, until a marker names the segment's last frame and
    as many frames as the marker says have come, or no row came for ``idle_ms``; then gives the path in batches and forgets the segment.

    A frame's candidates must come together. Every micro-batch with rows of a segment puts off its timer. More than ``most`` held frames raise, so that state is bounded.
    """

    def __init__(self, weights: Weights, idle_ms: int, most: int) -> None:
        self.weights, self.idle_ms, self.most = weights, idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        self.ends = handle.getValueState("ends", "frames long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, at = self.ends.get() if self.ends.exists() else (None, None)
        came = pd.concat(list(rows), ignore_index=True)
        marks = came[came.is_end]
        if len(marks):
            frames = int(marks.frames.max())
        best = came[~came.is_end].sort_values(["frame_idx", "score", "place"], ascending=[True, False, True]).groupby("frame_idx").head(self.weights.top_k)
        best = best.astype({"frame_idx": "int64", "place": "int64"})  # markers have neither
        if len(best):
            self.rows.appendList([tuple(r) for r in best[["frame_idx", "score", *BOX, "place"]].itertuples(index=False)])
        held = self._held()
        n = held.frame_idx.nunique()
        if n > self.most:
            raise ValueError(f"segment {key[0]} holds {n} frames, more than {self.most}")
        if frames is not None and n >= frames:
            yield from self._done(key, held, at)
            return
        if at is not None:
            self.handle.deleteTimer(at)
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.ends.update((frames, at))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._done(key, self._held(), None)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.rows.get()), columns=["frame_idx", "score", *BOX, "place"])

    def _done(self, key: tuple, held: pd.DataFrame, at: int | None) -> Iterator[pd.DataFrame]:
        if at is not None:
            self.handle.deleteTimer(at)
        self.rows.clear()
        self.ends.clear()
        if len(held):
            held = held.sort_values(["frame_idx", "score", "place"], ascending=[True, False, True], kind="stable")
            table = Trellis(held.frame_idx.to_numpy(), held.score.to_numpy(float), held[list(BOX)].to_numpy(float))
            out = held.iloc[table.paths([self.weights])[0]].assign(segment_id=key[0])
            yield out.assign(batch=np.arange(len(out)) // BATCH)[OUT.names]

    def close(self) -> None:
        pass


def path_stream(candidates: DataFrame, weights: Weights = Weights(), idle_ms: int = 600_000, most: int = 1_000_000) -> DataFrame:
    """Streaming candidates to the chosen one of each frame, in batches of eight frames with a shorter last one, when a segment ends.

    ``candidates`` has segment_id, frame_idx, score, a box and ``place`` (the tie order in a frame); a row with ``is_end`` true and ``frames`` set ends its segment and says how many
    frames it has. Needs the RocksDB state store.
    """
    wanted = candidates.select("segment_id", "frame_idx", "score", *BOX, F.col("place").cast("long").alias("place"), F.coalesce("is_end", F.lit(False)).alias("is_end"), F.col("frames").cast("long").alias("frames"))
    return wanted.groupBy("segment_id").transformWithStateInPandas(Paths(weights, idle_ms, most), OUT, "Append", "ProcessingTime")
