"""What an MP4 container says of its video track, read from the heads of nested boxes alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame

#: Boxes that hold boxes on the way to a track's tables.
NESTS = ("moov", "trak", "mdia", "minf", "stbl")
#: Entries of a time table that are read at once.
ENTRIES = 1 << 16
PROBE = "path string, readable boolean, width int, height int, fps double, frame_count long, duration_s double, error string"


class Unreadable(ValueError):
    """The container ends early or lacks what is needed."""


def boxes(file: BinaryIO, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, begin of the content, end) of each box between two places. A size of 1 stands for one of eight bytes, 0 for all that is left."""
    while start < end:
        if end - start < 8:
            raise Unreadable(f"{end - start} bytes are left where a box should begin")
        file.seek(start)
        head = file.read(min(16, end - start))
        size, name, inside = int.from_bytes(head[:4], "big"), head[4:8].decode("latin-1"), 8
        if size == 1:
            size, inside = int.from_bytes(head[8:16], "big"), 16
        stop = start + size if size else end
        if stop > end or stop - start < inside:
            raise Unreadable(f"box {name!r} claims to end at {stop}, beyond {end}" if stop > end else f"box {name!r} is shorter than its head")
        yield name, start + inside, stop
        start = stop


def _numbers(file: BinaryIO, at: int, end: int, layout: str) -> tuple:
    size = struct.calcsize(layout)
    if at + size > end:
        raise Unreadable("a box is shorter than its fields")
    file.seek(at)
    return struct.unpack(layout, file.read(size))


def _clock(file: BinaryIO, at: int, end: int) -> tuple[int, int]:
    """Ticks a second and duration of a mvhd or mdhd box."""
    (version,) = _numbers(file, at, end, ">B")
    return _numbers(file, at + 20, end, ">IQ") if version else _numbers(file, at + 12, end, ">II")


def track(file: BinaryIO, start: int, end: int) -> dict:
    """Fields of a trak box: kind, width, height, ticks, duration, frames."""
    out: dict = {}

    def walk(start: int, end: int) -> None:
        for name, at, stop in boxes(file, start, end):
            if name in NESTS:
                walk(at, stop)
            elif name == "tkhd":
                (version,) = _numbers(file, at, stop, ">B")
                width, height = _numbers(file, at + (88 if version else 76), stop, ">II")
                out.update(width=width >> 16, height=height >> 16)
            elif name == "mdhd":
                out["ticks"], out["duration"] = _clock(file, at, stop)
            elif name == "hdlr":
                out["kind"] = _numbers(file, at + 8, stop, ">4s")[0].decode("latin-1")
            elif name == "stsz":
                out["frames"] = _numbers(file, at + 8, stop, ">I")[0]
            elif name == "stts":
                (n,) = _numbers(file, at + 4, stop, ">I")
                total = frames = 0
                for k in range(0, n, ENTRIES):
                    m = min(ENTRIES, n - k)
                    found = _numbers(file, at + 8 + 8 * k, stop, f">{2 * m}I")
                    frames += sum(found[::2])
                    total += sum(a * b for a, b in zip(found[::2], found[1::2]))
                out["timed"], out["span"] = frames, total

    walk(start, end)
    return out


def video_of(file: BinaryIO, length: int) -> dict:
    """width, height, fps, frame_count and duration_s of the first video track; raises ``Unreadable``."""
    movie: tuple[int, int] | None = None
    for name, at, stop in boxes(file, 0, length):
        if name != "moov":
            continue
        for inner, start, end in boxes(file, at, stop):
            if inner == "mvhd":
                movie = _clock(file, start, end)
            if inner != "trak" or (own := track(file, start, end)).get("kind") != "vide":
                continue
            frames = own.get("frames", own.get("timed", 0))
            ticks, span = own.get("ticks", 0), own.get("span") or own.get("duration", 0)
            if not ticks or not span:  # a track without a clock has the movie's
                ticks, span = movie or (0, 0)
            if not (own.get("width") and own.get("height") and ticks and span):
                raise Unreadable("the video track lacks size or duration")
            seconds = span / ticks
            return {"width": own["width"], "height": own["height"], "fps": frames / seconds, "frame_count": frames, "duration_s": seconds}
    raise Unreadable("no video track")


def probe_containers(videos: DataFrame) -> DataFrame:
    """Videos (path, length) with what their containers say (PROBE); what is truncated or lacks a field is not readable and has the error's text.

    Tasks open the files and read heads and time tables, in parts, so that a file's size doesn't matter.
    """

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, length in zip(pdf.path, pdf.length):
                row = {"path": path, "readable": False, "width": None, "height": None, "fps": None, "frame_count": None, "duration_s": None, "error": None}
                try:
                    store, inside = FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
                    with store.open_input_file(inside) as file:
                        row |= video_of(file, length) | {"readable": True}
                except (Unreadable, OSError, struct.error) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROBE.split(", ")]).astype({"width": "Int32", "height": "Int32", "frame_count": "Int64"})

    return videos.select("path", "length").mapInPandas(look, PROBE)
