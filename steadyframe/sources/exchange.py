"""Data sources of Spark in Python: exported frames by ranges, and COCO documents joined from the tasks' parts."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FRAMES = "segment_id string, frame_idx long, time_s double, content binary"
PARTS = "kind string, split string, id long, body string"
CHUNK = 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Frames(InputPartition):
    folder: str
    first: int
    last: int


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.fps = options["path"], float(options.get("fps", 1.0))
        self.most, self.step = int(options["most"]) if "most" in options else None, int(options.get("frames", 1000))

    def _files(self, folder: str) -> Iterator[tuple[int, str]]:
        store, inside = opened(folder)
        for f in store.get_file_info(pafs.FileSelector(inside)):
            if f.type == pafs.FileType.File and (m := re.search(r"(\d+)\.[A-Za-z]+$", f.base_name)) and (self.most is None or int(m[1]) < self.most):
                yield int(m[1]), f.path

    def partitions(self) -> list[Frames]:
        store, inside = opened(self.path)
        out = []
        for f in sorted(store.get_file_info(pafs.FileSelector(inside)), key=lambda f: f.path):
            if f.type == pafs.FileType.Directory:
                folder = f"{self.path.rstrip('/')}/{f.base_name}"
                parts = sorted({n // self.step for n, _ in self._files(folder)})
                out += [Frames(folder, k * self.step, (k + 1) * self.step) for k in parts]
        return out

    def read(self, partition: Frames) -> Iterator[tuple]:
        if not isinstance(partition, Frames):
            return
        store, _ = opened(partition.folder)
        for n, path in sorted(x for x in self._files(partition.folder) if partition.first <= x[0] < partition.last):
            with store.open_input_file(path) as file:
                yield partition.folder.rsplit("/", 1)[-1], n, n / self.fps, file.read()


class FrameSource(DataSource):
    """``<path>/<segment>/<frame>.jpg`` as rows, a partition for each ``frames`` (1000) frame numbers of a folder; with ``most``, of each folder the frames of a lower number."""

    @classmethod
    def name(cls) -> str:
        return "steadyframe_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


@dataclass
class Parts(WriterCommitMessage):
    files: list[tuple[str, str, int, str]]  # split, kind, first id, path


class CocoWriter(DataSourceWriter):
    """Each task writes a part for each (split, kind) it meets; the commit joins the parts of a split to one document, in order of their first ids, and
    moves it into place. Neither a task nor the driver holds more than a piece of a document. A failed job leaves nothing."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.categories, self.splits = options.get("categories", "[]"), json.loads(options.get("splits", "[]"))
        self.parts = f"{self.path}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Parts:
        store, folder = opened(self.parts)
        store.create_dir(folder, recursive=True)
        files, at, out = [], None, None
        for row in iterator:
            if at != (row["split"], row["kind"]):
                if out:
                    out.close()
                at = row["split"], row["kind"]
                files.append((*at, row["id"], f"{folder}/{uuid.uuid4().hex}"))
                out = store.open_output_stream(files[-1][3])
                out.write(row["body"].encode())
            else:
                out.write(b"," + row["body"].encode())
        if out:
            out.close()
        return Parts(files)

    def commit(self, messages: list) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        store, folder = opened(self.path)
        for split in sorted({f[0] for f in files} | set(self.splits)):
            staged = f"{opened(self.parts)[1]}/{uuid.uuid4().hex}"
            store.create_dir(opened(self.parts)[1], recursive=True)
            with store.open_output_stream(staged) as out:
                for n, kind in enumerate(("images", "annotations")):
                    out.write(f'{", " if n else "{"}"{kind}": ['.encode())
                    for k, (_, _, _, part) in enumerate(f for f in files if f[:2] == (split, kind)):
                        if k:
                            out.write(b",")
                        with store.open_input_stream(part) as piece:
                            while got := piece.read(CHUNK):
                                out.write(got)
                    out.write(b"]")
                out.write(f', "categories": {self.categories}}}'.encode())
            store.move(staged, f"{folder}/annotations_{split}.json")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, folder = opened(self.parts)
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class CocoSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "steadyframe_coco"

    def writer(self, schema, overwrite: bool) -> CocoWriter:
        return CocoWriter(self.options)


def read_frames(spark: SparkSession, path: str, fps: float, most: int | None = None, frames: int = 1000) -> DataFrame:
    """Exported frames (FRAMES) by ``FrameSource``."""
    spark.dataSource.register(FrameSource)
    options = {"fps": str(fps), "frames": str(frames), **({} if most is None else {"most": str(most)})}
    return spark.read.format("steadyframe_frames").options(**options).load(path)


def write_coco_documents(images: DataFrame, annotations: DataFrame, categories: list[dict], path: str, splits: tuple[str, ...] = ()) -> None:
    """One COCO document a split at ``<path>/annotations_<split>.json``, for ``splits`` also where they have no image; unused and unassigned ones go.

    ``images`` has id and split besides the fields of a document's images, ``annotations`` id, split and theirs. Rows are dealt by ranges of (kind, split, id), so that no split is in one task or row.
    """
    spark = images.sparkSession
    spark.dataSource.register(CocoSink)
    body = lambda df, kind: df.where(~F.col("split").isin("unused", "unassigned")).select(F.lit(kind).alias("kind"), "split", "id", F.to_json(F.struct(*[c for c in df.columns if c != "split"])).alias("body"))
    rows = body(images, "images").unionByName(body(annotations, "annotations"))
    order = ["kind", "split", "id"]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.format("steadyframe_coco").mode("append")
    out.options(categories=json.dumps(categories), splits=json.dumps(list(splits))).save(path)
