"""Greedy box tracking: in batch per segment, and as state that a stream carries on."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from steadyframe.functions.geometry import BOX

OUT = T.StructType([T.StructField("segment_id", T.StringType()), T.StructField("frame_idx", T.LongType()), T.StructField("det_id", T.LongType()), T.StructField("track_id", T.LongType())])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of ``a`` with every one of ``b``; 0 where the union is empty."""
    sides = lambda m: np.maximum(m[..., 2:] - m[..., :2], 0.0).prod(-1)
    left, right = a[:, None], b[None]
    both = sides(np.concatenate((np.maximum(left[..., :2], right[..., :2]), np.minimum(left[..., 2:], right[..., 2:])), -1))
    union = sides(left) + sides(right) - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def matches(table: np.ndarray, least: float) -> dict[int, int]:
    """Column to row, by falling value down to ``least``, each row and column once; of equal values the last row, then the last column."""
    rows, columns = table.shape
    open_ = table[::-1, ::-1].copy()  # so that the first maximum is the last one
    found: dict[int, int] = {}
    while len(found) < min(rows, columns):
        r, c = divmod(int(open_.argmax()), columns)
        if open_[r, c] < least:
            break
        found[columns - 1 - c] = rows - 1 - r
        open_[r] = open_[:, c] = -np.inf
    return found


@dataclass
class Tracks:
    """The live tracks of a segment in the order of their beginning: ids, frames since each was seen, and last boxes."""

    ids: list[int] = field(default_factory=list)
    unseen: list[int] = field(default_factory=list)
    boxes: list[list[float]] = field(default_factory=list)
    following: int = 1
    frame: int | None = None

    def see(self, boxes: list[list[float]], least: float, most_age: int) -> list[int]:
        """A frame's boxes to their track ids. A box without a match begins a track; one unseen for more than ``most_age`` frames ends."""
        self.unseen = [age + 1 for age in self.unseen]
        pairs = matches(overlaps(np.array(self.boxes), np.array(boxes)), least) if boxes and self.ids else {}
        given = []
        for n, box in enumerate(boxes):
            if (k := pairs.get(n)) is None:
                k = len(self.ids)
                self.ids.append(self.following)
                self.unseen.append(0)
                self.boxes.append(box)
                self.following += 1
            self.unseen[k], self.boxes[k] = 0, box
            given.append(self.ids[k])
        live = [k for k, age in enumerate(self.unseen) if age <= most_age]
        self.ids, self.unseen, self.boxes = ([x[k] for k in live] for x in (self.ids, self.unseen, self.boxes))
        return given

    def run(self, pdf: pd.DataFrame, least: float, most_age: int) -> list[tuple[int, int, int]]:
        """Rows of one segment (frame_idx, det_id, boxes; a null box is a frame without any) to (frame, det_id, track_id), in frame order.

        Frames that are absent altogether age the tracks like empty ones.
        """
        out = []
        ordered = pdf.sort_values(["frame_idx", "det_id"], kind="stable")
        for frame, part in ordered.groupby("frame_idx", sort=True):
            missed = int(frame) - self.frame - 1 if self.frame is not None else 0
            for _ in range(min(missed, most_age + 1)):
                self.see([], least, most_age)
            has = part[part.x1.notna()]
            ids = self.see(has[list(BOX)].to_numpy(float).tolist(), least, most_age)
            out += [(int(frame), int(d), t) for d, t in zip(has.det_id, ids)]
            self.frame = int(frame)
        return out

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Tracks:
        return cls(**json.loads(text))


def track(detections: DataFrame, least: float = 0.25, most_age: int = 15) -> DataFrame:
    """Detections (segment_id, frame_idx, det_id, box) with their track_id; each segment is one group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in Tracks().run(pdf, least, most_age)], columns=OUT.names)

    wanted = detections.select("segment_id", "frame_idx", "det_id", *BOX)
    return wanted.groupBy("segment_id").applyInPandas(run, OUT)
