"""The greedy tracker over a stream of detections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from steadyframe.functions.geometry import BOX
from steadyframe.operators.tracker import OUT, Tracks


def track_stream(detections: DataFrame, least: float = 0.25, most_age: int = 15) -> DataFrame:
    """Streaming detections to track ids; a segment's live tracks are its state (bounded by ``most_age``).

    Frames of a segment must not be older than those of earlier micro-batches; inside one they may come in any order, and all boxes
    of a frame must come together. Expiry counts frames, so no timer is needed.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = Tracks.load(state.get[0]) if state.exists else Tracks()
        rows = tracks.run(pd.concat(list(frames), ignore_index=True), least, most_age)
        state.update((tracks.dump(),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=OUT.names)

    wanted = detections.select("segment_id", "frame_idx", "det_id", *BOX)
    return wanted.groupBy("segment_id").applyInPandasWithState(run, OUT, "tracks string", "append", GroupStateTimeout.NoTimeout)
