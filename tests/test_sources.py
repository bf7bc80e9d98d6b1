"""The raw data source: ranges of large files, filters that open only what they need, and writes that come whole or not at all."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import raw
from framelake.sources.raw_format import RawReader, last_number


@pytest.fixture()
def folder(tmp_path):
    """Five frames of 6 x 10, and one that lacks a byte."""
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 65536, (5, 6, 10)).astype("<u2")
    for t, frame in enumerate(stack):
        (tmp_path / f"image_frame{t}.bin").write_bytes(frame.tobytes())
    (tmp_path / "image_frame9.bin").write_bytes(stack[0].tobytes()[:-1])
    (tmp_path / "notes.txt").write_text("not a frame")
    (tmp_path / ".hidden7.bin").write_bytes(b"x")
    return tmp_path, stack


@pytest.mark.parametrize("range_bytes", [None, 1, 50, 66_000])
def test_ranges_give_the_whole(spark, folder, range_bytes):
    path, stack = folder
    rows = raw.read_raw_frames(spark, f"file:{path}", width=10, height=6, range_bytes=range_bytes).collect()
    assert {(r.frame_id, r.y, r.x): r.v for r in rows if r.error is None} == {k: int(v) for k, v in np.ndenumerate(stack)}
    assert [(r.frame_id, r.v, r.error) for r in rows if r.error] == [(9, None, "119 bytes instead of 120")]
    assert len(rows) == 301


def opened(df) -> set:
    return {os.path.basename(r.file) for r in df.select("file").distinct().collect()}


def test_only_the_files_asked_for_are_opened(spark, folder):
    path, stack = folder
    found = RawReader({"path": str(path), "width": "10", "height": "6", "numbers": "[[1, 1], [4, 8]]", "places": "[2, 3]", "range_bytes": "20"}, "frames")
    assert [(p[1]["frame_id"], *p[2:4]) for part in found.partitions() for p in part.pieces] == [(1, 2, 3), (1, 3, 4), (4, 2, 3), (4, 3, 4)]
    read = lambda **chosen: raw.read_raw_frames(spark, str(path), width=10, height=6, **chosen)
    for t in (1, 2, 4):
        os.remove(path / f"image_frame{t}.bin")
        os.mkfifo(path / f"image_frame{t}.bin")  # would never end
    chosen = read(frames=[3], lines=(4, 6))
    assert {(r.y, r.x): r.v for r in chosen.collect()} == {(y, x): int(stack[3, y, x]) for y in (4, 5) for x in range(10)}
    assert opened(read(frames=[0, 3])) == {"image_frame0.bin", "image_frame3.bin"} and opened(read(frames=range(3, 9))) == {"image_frame3.bin"}
    assert read(frames=[77]).count() == 0 and read(frames=[]).count() == 0 and read(frames=[0], lines=(3, 3)).count() == 0


def test_scans_of_one_table_are_independent(spark, folder):
    path, stack = folder
    frames = raw.read_raw_frames(spark, str(path), width=10, height=6)
    assert frames.where("frame_id = 77").count() == 0 and frames.where("frame_id = 3 or y = 0").count() == 100
    assert frames.where("frame_id = 1").alias("a").join(frames.where("frame_id = 2").alias("b"), ["y", "x"]).count() == 60


def test_a_file_over_two_gigabytes_is_read_in_ranges(spark, tmp_path):
    """A sparse file of 5 GB: no range is larger than it should be, and each is read by itself."""
    width, height = 65_536, 38_147
    with open(tmp_path / "frame_3.bin", "wb") as file:
        file.seek(38_000 * width * 2 + 10)
        file.write(b"\x07\x01")
        file.truncate(width * height * 2)
    assert os.path.getsize(tmp_path / "frame_3.bin") > 4.99e9
    ranges = RawReader({"path": str(tmp_path), "width": str(width), "height": str(height)}, "frames").partitions()
    assert len(ranges) > 70 and all((p[3] - p[2]) * width * 2 <= 64 << 20 for part in ranges for p in part.pieces)
    big = raw.read_raw_frames(spark, str(tmp_path), width=width, height=height, lines=(37_000, 38_147))
    assert [(r.y, r.x, r.v) for r in big.where("v > 0").collect()] == [(38_000, 5, 263)] and big.rdd.getNumPartitions() > 2
    at = 38_000 * width + 5
    samples = raw.read_sample_series(spark, str(tmp_path), bit_size=16, places=(at - 3, at + 3))
    assert [(r.i - at, r.x) for r in samples.orderBy("i").collect()] == [(-3, 0), (-2, 0), (-1, 0), (0, 263), (1, 0), (2, 0)]


def test_lines_of_scenes(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = {(s, p): rng.random((4, 3, 2)).astype("<f4") for s in (2, 11) for p in (0, 5)}
    for (s, p), v in data.items():
        (tmp_path / f"scene{s}_patch{p}.bin").write_bytes(v.tobytes())
    found = raw.read_raw_lines(spark, str(tmp_path), width=3, height=4, range_bytes=30)
    for r in found.collect():
        assert np.array_equal(np.array([r.re, r.im], "<f4").T, data[r.scene_id, r.patch][r.az])
    assert found.count() == 16 and found.where("scene_id = 11 and patch = 5 and az = 2").count() == 1
    (tmp_path / "scene3_patch1.bin").write_bytes(b"short")
    with pytest.raises(Exception, match="5 bytes instead of 96"):
        raw.read_raw_lines(spark, str(tmp_path), width=3, height=4).count()
    assert last_number("image_frame12.bin") == 12 and last_number("none.bin") is None and last_number("9999999999.bin") is None


def table(spark, stack):
    rows = [(t, y, x, int(v)) for (t, y, x), v in np.ndenumerate(stack)]
    return spark.createDataFrame(rows, "frame_id int, y int, x int, v int")


@pytest.mark.parametrize("dtype,endian", [("u16", "little"), ("u16", "big"), ("u8", "little"), ("u32", "little"), ("f32", "little")])
def test_written_frames_are_read_back(spark, tmp_path, dtype, endian):
    """Parts of two lines, dealt to tasks in any order, become whole files."""
    stack = np.random.default_rng(3).integers(0, 256, (4, 7, 5))
    path = str(tmp_path / "out")
    raw.write_raw_frames(table(spark, stack).repartition(5, F.rand(1)), f"file://{path}", width=5, height=7, dtype=dtype, endian=endian, part_bytes=2 * 5 * np.dtype(raw.DTYPES[dtype]).itemsize)
    assert sorted(os.listdir(path)) == [f"frame_{t:06d}.bin" for t in range(4)]
    kind = np.dtype(raw.DTYPES[dtype]).newbyteorder(">" if endian == "big" else "<")
    for t in range(4):
        assert np.array_equal(np.fromfile(f"{path}/frame_{t:06d}.bin", kind).reshape(7, 5), stack[t])
    back = raw.read_raw_frames(spark, path, width=5, height=7, dtype=dtype, endian=endian)
    assert {(r.frame_id, r.y, r.x): int(r.v) for r in back.collect()} == {k: int(v) for k, v in np.ndenumerate(stack)}
    raw.write_raw_frames(table(spark, stack[:1] // 2), path, width=5, height=7, dtype=dtype, mode="overwrite")
    assert os.listdir(path) == ["frame_000000.bin"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails halfway, a frame that lacks a pixel, one that lacks whole lines, a pixel outside."""
    stack = np.random.default_rng(4).integers(0, 256, (3, 6, 5))
    path, good = str(tmp_path / "out"), table(spark, stack)
    raw.write_raw_frames(good.where("frame_id = 0"), path, width=5, height=6)
    fails = good.where("frame_id > 0").withColumn("v", F.when(F.expr("frame_id = 2 and y = 5"), F.raise_error(F.lit("halfway"))).otherwise(F.col("v")))
    cases = [(fails, "halfway"), (good.where("not (frame_id = 2 and y = 4 and x = 1)"), "instead of"), (good.where("not (frame_id = 1 and y >= 4)"), "lack parts"), (good.withColumn("x", F.col("x") + 1), "outside")]
    for frames, says in cases:
        with pytest.raises(Exception, match=says):
            raw.write_raw_frames(frames, path, width=5, height=6, part_bytes=20)
        assert os.listdir(path) == ["frame_000000.bin"]
    with pytest.raises(Exception, match="mounted file system"):
        raw.write_raw_frames(good, "hdfs://nowhere/x", width=5, height=6)


def test_a_frame_larger_than_a_part(spark, tmp_path):
    """One frame of 32 MB in parts of 1 MB: no part is more than that."""
    frame = spark.range(16 << 20).selectExpr("7 frame_id", "cast(id div 4096 as int) y", "cast(id % 4096 as int) x", "cast(id % 65521 as int) v")
    raw.write_raw_frames(frame, str(tmp_path / "out"), width=4096, height=4096, part_bytes=1 << 20)
    data = np.fromfile(tmp_path / "out" / "frame_000007.bin", "<u2")
    assert np.array_equal(data, np.arange(16 << 20) % 65521)


def test_many_small_ranges_share_tasks(tmp_path):
    """2,000 files in two ranges each: all of them, none larger than asked for, in some 256 tasks and not in 4,000."""
    for t in range(2_000):
        (tmp_path / f"frame{t}.bin").write_bytes(bytes(120))
    parts = RawReader({"path": str(tmp_path), "width": "10", "height": "6", "range_bytes": "60"}, "frames").partitions()
    assert len(parts) <= 300 and max(len(p.pieces) for p in parts) <= 20
    assert sorted((piece[1]["frame_id"], *piece[2:4]) for p in parts for piece in p.pieces) == [(t, *r) for t in range(2_000) for r in ((0, 3), (3, 6))]
