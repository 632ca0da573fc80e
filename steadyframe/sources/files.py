"""Readers and writers of the files the pipeline exchanges; every number that may be NaN becomes NULL at the source."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.functions.geometry import clean

TRACKS = (
    "case_id string, segment_id string, video_id string, frame_idx long, time_s double, track_id long, class_id int, class_name string, "
    "confidence double, x1 double, y1 double, x2 double, y2 double, frame_width int, frame_height int"
)
RATINGS = "case_id string, segment_id string, rater_id string, salas_total double, osa_cns_total double"
COCO = (
    "images array<struct<id:long,file_name:string,width:int,height:int,case_id:string,segment_id:string,frame_idx:long,time_s:double>>, "
    "annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>,area:double,iscrowd:int,object_id:int>>, "
    "categories array<struct<id:int,name:string>>"
)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean(F.col(c)) for c in numbers})


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """CSV files with header and a declared schema; columns are matched by name across files and missing ones are NULL."""
    wanted = T.StructType.fromDDL(schema)
    parts = []
    for p in [paths] if isinstance(paths, str) else paths:
        raw = spark.read.option("header", True).csv(p)
        parts.append(raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields]))
    if not parts:
        raise ValueError("at least one file is needed")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return without_nan(out)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of COCO documents, exploded."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    return doc.select(F.explode("images").alias("i")).select("i.*"), doc.select(F.explode("annotations").alias("a")).select("a.*")


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or an empty table of the schema if nothing is there."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    except Exception as e:  # the reader reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label files (``<set>/<frame>.txt``): path, set_name, frame_idx, raw_line."""
    file = F.col("_metadata.file_path")
    return spark.read.text(path).select(
        file.alias("path"), F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("set_name"),
        F.regexp_extract(file, r"([0-9]+)\.txt$", 1).try_cast("long").alias("frame_idx"), F.col("value").alias("raw_line"),
    )


def discover(spark: SparkSession, folder: str, fallback: str | None = None, pattern: str = "*.mp4") -> DataFrame:
    """Files of a folder (path, length), of the fallback folder if it has none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    if fallback and found.isEmpty():
        return discover(spark, fallback, None, pattern)
    return found


INSPECTED = "path string, length long, atom string, declared_end long"


def truncated_atom(file: BinaryIO, length: int) -> tuple[str, int] | None:
    """First top-level atom of an MP4 file that claims to end beyond ``length``, and where; None if there is none.

    An atom begins with its size in four bytes and a name in four. Size 1 stands for a size in the next eight bytes, and 0
    for all that is left. A size less than that head's is truncated too. Only the heads are read.
    """
    start = 0
    while length - start >= 8:
        file.seek(start)
        head = file.read(16)
        name = head[4:8].decode("latin-1")
        size = int.from_bytes(head[:4], "big")
        least = 16 if size == 1 else 8
        if size == 1:
            size = int.from_bytes(head[8:16], "big") if len(head) == 16 else least
        end = start + size if size else length
        if end > length or end - start < least:
            return name, end
        start = end
    return None


def inspect_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Video files with their truncated atom, if any. Tasks open the listed files and read the atoms' heads, so that a file's size doesn't matter."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(folder).select("path", "length")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for path, length in zip(pdf.path, pdf.length):
                store, inside = FileSystem.from_uri(path if "//" in path else path.replace("file:", "file://"))
                with store.open_input_file(inside) as file:
                    found.append(truncated_atom(file, length) or (None, None))
            yield pdf.assign(atom=[x[0] for x in found], declared_end=pd.array([x[1] for x in found], dtype="Int64"))

    return listed.mapInPandas(look, INSPECTED)


def rational(c: str | Column) -> Column:
    """``num/den`` to a double, 0 if den is 0."""
    parts = F.split(c, "/")
    return F.coalesce(F.try_divide(F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1).try_cast("double"), F.lit(1.0))), F.lit(0.0))


def label_folders(spark: SparkSession, folder: str, configured: Sequence[str] = ()) -> DataFrame:
    """Folders with label files under ``folder`` (set_name, path, files): those whose name ends in ``seg``, and configured ones; sorted. A folder without files is none."""
    file = F.col("path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).select("path")
    named = listed.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("set_name"), F.regexp_extract(file, r"^(.*)/[^/]+$", 1).alias("path"))
    wanted = F.col("set_name").endswith("seg") | F.col("set_name").isin(list(configured))
    return named.where(wanted).groupBy("set_name", "path").agg(F.count("*").alias("files")).orderBy("path")


def read_training_log(spark: SparkSession, path: str, statistic: str = "test_coco_eval_bbox") -> DataFrame:
    """A log of one JSON object a line, blank lines left out: epoch and its statistics as an array; raises if there is no line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.isEmpty():
        raise ValueError(f"{path} has no line")
    row = F.from_json("value", f"epoch long, `{statistic}` array<double>")
    return lines.select(row.alias("r")).select("r.epoch", F.col(f"r.{statistic}").alias("stats"))


def read_json_by_name(spark: SparkSession, pattern: str, schema: str, by: str = "file") -> DataFrame:
    """JSON documents of a glob with ``name``: the file's name without its ending, or with ``by="folder"`` that of its folder."""
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, r"([^/]+)\.[^./]*$" if by == "file" else r"([^/]+)/[^/]+$", 1)
    raw = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(pattern)
    return without_nan(raw.withColumn("name", name))


PROBE = "path string, readable boolean, width int, height int, fps double, frame_count long, duration_s double, error string"


def probe_videos(videos: DataFrame, probe: Callable[[str], str]) -> DataFrame:
    """Videos (path) with what their container says. ``probe`` gives a file's description as JSON (streams, format); it runs in tasks.

    If it fails, or a needed field is missing, the video is not readable and has the error's text.
    """

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            said, wrong = [], []
            for path in pdf.path:
                try:
                    said.append(probe(path))
                    wrong.append(None)
                except Exception as e:  # whatever a probe raises is the row's error
                    said.append(None)
                    wrong.append(str(e))
            yield pd.DataFrame({"path": pdf.path, "said": said, "wrong": wrong})

    fields = "streams array<struct<width:int,height:int,avg_frame_rate:string,nb_frames:string>>, format struct<duration:string>"
    found = videos.select("path").mapInPandas(look, "path string, said string, wrong string").withColumn("j", F.from_json("said", fields))
    one = F.get("j.streams", 0)
    out = found.select(
        "path", one["width"].alias("width"), one["height"].alias("height"), rational(one["avg_frame_rate"]).alias("fps"),
        F.coalesce(one["nb_frames"].try_cast("long"), F.lit(0)).alias("frame_count"), F.col("j.format.duration").try_cast("double").alias("duration_s"), "wrong",
    )
    whole = F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("duration_s").isNotNull()
    error = F.coalesce("wrong", F.when(~whole, "the container lacks size or duration"))
    kept = [F.when(error.isNull(), F.col(c)).alias(c) for c in ("width", "height", "fps", "frame_count", "duration_s")]
    return out.select("path", error.isNull().alias("readable"), *kept, error.alias("error"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_template(spark: SparkSession, columns: Sequence[str], path: str) -> None:
    """A CSV that has only its header, columns sorted, unless something is there already."""
    spark.createDataFrame([(",".join(sorted(columns)),)], "header string").coalesce(1).write.mode("ignore").text(path)


def write_coco(documents: DataFrame, path: str) -> None:
    """COCO documents of ``coco_documents``, in a folder for each split."""
    documents.write.mode("overwrite").partitionBy("split").json(path)


def records(rows: DataFrame, most: int = 1000) -> list[dict]:
    """Summary rows as a list of records for ``write_document``; more than ``most`` are no summary and raise."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a summary has at most {most} rows")
    return [r.asDict(recursive=True) for r in found]


def write_document(row: dict | list[dict], path: str) -> None:
    """Collected summary rows as a readable JSON document; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2)


def frame_rows(spark: SparkSession, path: str, fps: float, most: int | None = None) -> DataFrame:
    """Exported frames (``<segment>/<frame>.jpg``) as rows: segment_id, frame_idx, time_s, content; with ``most``, of each segment those of a lower number."""
    file = F.col("path")
    frame = F.regexp_extract(file, r"([0-9]+)\.[A-Za-z]+$", 1).try_cast("long")
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("segment_id"), frame.alias("frame_idx"), (frame / fps).alias("time_s"), "content")
    return rows if most is None else rows.where(F.col("frame_idx") < most)
