"""The container's prober, the frame source and the COCO sink."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from steadyframe.sources import exchange, files, mp4


def box(name, content, wide=False):
    head = struct.pack(">I4sQ", 1, name, 16 + len(content)) if wide else struct.pack(">I4s", 8 + len(content), name)
    return head + content


def movie(width, height, ticks, stts, version=0, kind=b"vide", wide=False, clock=True):
    n = sum(c for c, _ in stts)
    span = sum(c * d for c, d in stts)
    time = (lambda t, d: struct.pack(">B3x8xII4x", 0, t, d)) if not version else (lambda t, d: struct.pack(">B3x16xIQ4x", 1, t, d))
    tkhd = struct.pack(">B3x" + ("20x" if not version else "32x") + "8x8x36xII", version, width << 16, height << 16)
    stbl = box(b"stbl", box(b"stts", struct.pack(">4xI", len(stts)) + b"".join(struct.pack(">II", *x) for x in stts)) + box(b"stsz", struct.pack(">4xII", 0, n) + b"\0\0\0\1" * n))
    mdia = box(b"mdia", (box(b"mdhd", time(ticks, span)) if clock else b"") + box(b"hdlr", struct.pack(">8x4s12x", kind)) + box(b"minf", stbl))
    return box(b"ftyp", b"isom") + box(b"mdat", b"x" * 50, wide) + box(b"moov", box(b"mvhd", time(ticks, span)) + box(b"trak", box(b"tkhd", tkhd) + mdia), wide)


def test_probe_from_boxes(spark, tmp_path):
    sound = movie(0, 0, 8000, [(5, 10)], kind=b"soun")
    built = {
        "plain.mp4": movie(1920, 1080, 600, [(50, 24)]),
        "wide.mp4": movie(640, 480, 90_000, [(10, 3000), (2, 6000)], version=1, wide=True),
        "cut.mp4": movie(1920, 1080, 600, [(50, 24)])[:-9],
        "sound.mp4": sound,
        "empty.mp4": b"",
        "junk.mp4": b"abc",
        "nosize.mp4": movie(0, 0, 600, [(5, 10)]),
    }
    for name, content in built.items():
        (tmp_path / name).write_bytes(content)
    listed = files.discover(spark, str(tmp_path)).unionByName(spark.createDataFrame([(f"{tmp_path}/empty.mp4", 0), (f"{tmp_path}/gone.mp4", 9)], "path string, length long"))  # Spark lists no empty files
    got = {os.path.basename(r.path): r for r in mp4.probe_containers(listed.dropDuplicates(["path"])).collect()}
    plain, wide = got["plain.mp4"], got["wide.mp4"]
    assert (plain.readable, plain.width, plain.height, plain.frame_count, plain.fps, plain.duration_s, plain.error) == (True, 1920, 1080, 50, 25.0, 2.0, None)
    assert (wide.width, wide.height, wide.frame_count) == (640, 480, 12) and wide.duration_s == pytest.approx(42_000 / 90_000)
    assert not any(got[n].readable for n in got if n not in ("plain.mp4", "wide.mp4"))
    assert "moov" in got["cut.mp4"].error and got["sound.mp4"].error == got["empty.mp4"].error == "no video track" and "size" in got["nosize.mp4"].error and got["junk.mp4"].error and got["gone.mp4"].error


def test_frames_by_ranges(spark, tmp_path):
    for seg, frames in (("A", range(0, 25)), ("B", (3, 7))):
        (tmp_path / seg).mkdir()
        for n in frames:
            (tmp_path / seg / f"{n:06d}.jpg").write_bytes(bytes([n]))
    (tmp_path / "C").mkdir()
    rows = exchange.read_frames(spark, str(tmp_path), 5.0, frames=10)
    got = rows.collect()
    assert rows.rdd.getNumPartitions() == 4 and sorted((r.segment_id, r.frame_idx, r.content[0]) for r in got) == [("A", n, n) for n in range(25)] + [("B", 3, 3), ("B", 7, 7)]
    assert all(r.time_s == r.frame_idx / 5 for r in got)
    assert exchange.read_frames(spark, str(tmp_path), 5.0, most=5).count() == 6


def test_coco_documents_round_trip(spark, tmp_path):
    images = spark.range(300).select("id", F.concat(F.lit("f"), "id").alias("file_name"), F.when(F.col("id") < 200, "train").when(F.col("id") < 290, "val").otherwise("unused").alias("split"))
    notes = images.select(F.col("id"), F.col("id").alias("image_id"), F.array(F.lit(1.0), F.lit(2.5)).alias("bbox"), "split")
    exchange.write_coco_documents(images, notes, [{"id": 0, "name": "Harmonic0"}], str(tmp_path / "out"), ("train", "val", "test"))
    assert sorted(os.listdir(tmp_path / "out")) == ["annotations_test.json", "annotations_train.json", "annotations_val.json"]
    read = {s: json.loads((tmp_path / "out" / f"annotations_{s}.json").read_text()) for s in ("train", "val", "test")}
    assert [x["id"] for x in read["train"]["images"]] == list(range(200)) and [x["image_id"] for x in read["val"]["annotations"]] == list(range(200, 290))
    assert read["test"] == {"images": [], "annotations": [], "categories": [{"id": 0, "name": "Harmonic0"}]} and read["train"]["annotations"][0]["bbox"] == [1.0, 2.5]


def test_failed_task_leaves_nothing(spark, tmp_path):
    images = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("file_name"), F.lit("train").alias("split"))
    with pytest.raises(Exception, match="broken"):
        exchange.write_coco_documents(images, images.limit(0), [], str(tmp_path / "out"))
    assert not os.path.isdir(tmp_path / "out") or os.listdir(tmp_path / "out") == []
