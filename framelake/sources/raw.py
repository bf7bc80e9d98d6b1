"""Raw little-endian binary files as tables, and tables as raw binary."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.shipping import ship
from framelake.sources.raw_format import DTYPES, RawSource, store


def register(spark: SparkSession) -> None:
    """Makes format("framelake_raw") known to a session."""
    ship(spark)
    spark.dataSource.register(RawSource)


def _ranges(numbers: Iterable[int]) -> list[list[int]]:
    """[first, last] of runs of whole numbers."""
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


def _read(spark: SparkSession, path: str, layout: str, numbers: Iterable[int] | None, places: tuple[int, int] | None, **options) -> DataFrame:
    register(spark)
    ranges = None if numbers is None else [[numbers[0], numbers[-1]]] if isinstance(numbers, range) and numbers and numbers.step == 1 else _ranges(numbers)
    options |= {"numbers": None if ranges is None else json.dumps(ranges), "places": None if places is None else json.dumps([places[0], places[1] - 1])}
    return spark.read.format(RawSource.name()).options(layout=layout, **{k: v for k, v in options.items() if v is not None}).load(path)


def decode_frames(files: DataFrame, *, width: int, height: int, dtype: str, big_endian: bool = False) -> DataFrame:
    """(file, frame_id, content) to (file, frame_id, y, x, v, error). Content of another size gives one row with its error and nulls."""
    kind = np.dtype(DTYPES[dtype])
    kind = kind.newbyteorder(">") if big_endian else kind
    value = pa.float64() if dtype == "f32" else pa.int64()

    def decode(batches):
        y, x = np.divmod(np.arange(width * height, dtype=np.int32), width)
        names = ["file", "frame_id", "y", "x", "v", "error"]
        for batch in batches:
            for file, frame, content in zip(*(batch.column(c).to_pylist() for c in ("file", "frame_id", "content")), strict=True):
                want = width * height * kind.itemsize
                if content is None or len(content) != want:
                    columns = [pa.array([file]), pa.array([frame], pa.int32()), *(pa.array([None], t) for t in (pa.int32(), pa.int32(), value)), pa.array([f"{len(content or b'')} bytes instead of {want}"])]
                else:
                    v = np.frombuffer(content, kind)
                    n = len(v)
                    columns = [pa.array([file] * n, pa.string()), pa.array(np.full(n, -1 if frame is None else frame, np.int32)), pa.array(y), pa.array(x), pa.array(v.astype(np.float64 if dtype == "f32" else np.int64)), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return files.select("file", F.col("frame_id").cast("int").alias("frame_id"), "content").mapInArrow(decode, f"file string, frame_id int, y int, x int, v {'double' if dtype == 'f32' else 'bigint'}, error string")


def read_raw_frames(spark: SparkSession, path: str, *, width: int, height: int, dtype: str = "u16", endian: str = "little", frames: Iterable[int] | None = None, lines: tuple[int, int] | None = None, range_bytes: int | None = None) -> DataFrame:
    """A folder of frame files of any size: (file, frame_id, y, x, v, error); the frame's number is the last number of the file's name.

    A file of another size gives one row with its error and nulls. frames: the numbers whose files are opened; lines: (first, end) of the image lines that
    are read; range_bytes: what a task reads.
    """
    return _read(spark, path, "frames", frames, lines, width=width, height=height, dtype=dtype, endian=endian, range_bytes=range_bytes)


def read_raw_lines(spark: SparkSession, path: str, *, width: int, height: int, scene_id: int = 0, patches: Iterable[int] | None = None, lines: tuple[int, int] | None = None, range_bytes: int | None = None) -> DataFrame:
    """Files of interleaved complex float lines: (scene_id, patch, az, re, im), a row for each line.

    The scene is the number after `scene` in a file's name, or scene_id; the patch is the last number. patches, lines: what is read.
    """
    return _read(spark, path, "lines", patches, lines, width=width, height=height, scene_id=scene_id, range_bytes=range_bytes).drop("file")


def read_sample_series(spark: SparkSession, path: str, *, bit_size: int, places: tuple[int, int] | None = None, range_bytes: int | None = None) -> DataFrame:
    """Files of unsigned samples of 1, 2 or 4 bytes by their bit size: (series_id, i, x); a series' name is its file's. places: (first, end) of what is read of each."""
    kind = "u8" if bit_size <= 8 else "u16" if bit_size <= 16 else "u32"
    return _read(spark, path, "samples", None, places, dtype=kind, pattern="*", range_bytes=range_bytes).drop("file")


def write_raw_frames(frames: DataFrame, path: str, *, width: int, height: int, dtype: str = "u16", endian: str = "little", frame: str = "frame_id", value: str = "v", name: str = "frame_{:06d}.bin", part_bytes: int = 16 << 20, mode: str = "append") -> None:
    """Each frame as a raw file: all of them, or none if a task fails for good or a frame lacks pixels.

    A task writes runs of lines of about part_bytes, so that a frame may be larger than its memory; path is a mounted folder.
    """
    register(frames.sparkSession)
    lines = max(1, part_bytes // (width * np.dtype(DTYPES[dtype]).itemsize))
    rows = frames.select(F.col(frame).cast("long").alias("frame_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).alias("v"))
    dealt = rows.repartition("frame_id", F.expr(f"y div {lines}")).sortWithinPartitions("frame_id", "y")
    dealt.write.format(RawSource.name()).mode(mode).options(width=width, height=height, dtype=dtype, endian=endian, name=name, lines_per_part=lines).save(path)


def read_raw_bytes(spark: SparkSession, path: str, *, chunk_bytes: int = 1 << 20, pattern: str = "*", range_bytes: int | None = None) -> DataFrame:
    """Files of any size in chunks: (name, at, data), `at` counted in bytes."""
    return _read(spark, path, "bytes", None, None, chunk_bytes=chunk_bytes, pattern=pattern, range_bytes=range_bytes).drop("file")


def write_raw_bytes(chunks: DataFrame, path: str, *, mode: str = "append") -> None:
    """Chunks (name, at, data) as files below path, a mounted folder: all of them whole, or none."""
    register(chunks.sparkSession)
    chunks.select("name", F.col("at").cast("long").alias("at"), "data").write.format(RawSource.name()).mode(mode).options(layout="bytes").save(path)


def frames_to_binary(frames: DataFrame, *, dtype: str = "u16", frame: str = "frame_id", value: str = "v") -> DataFrame:
    """(frame_id, content): each frame's pixels in row-major order. A frame is one group, of bounded size."""
    kind = DTYPES[dtype]

    def encode(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["x"].to_numpy(), table["y"].to_numpy()))
        return pa.table({frame: table[frame][:1], "content": pa.array([table[value].to_numpy()[order].astype(kind).tobytes()], pa.binary())})

    kept = frames.select(frame, "y", "x", value)
    return kept.groupBy(frame).applyInArrow(encode, f"{frame} {frames.schema[frame].dataType.simpleString()}, content binary")


def lines_to_binary(lines: DataFrame, *, group: str = "patch", order: str = "i") -> DataFrame:
    """(group, content): each group's complex lines as interleaved 32-bit floats. A group is of bounded size: a patch."""

    def encode(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table[order].to_numpy(), kind="stable"))
        pairs = np.stack([np.array(table[c].to_pylist(), "<f4") for c in ("re", "im")], axis=2)
        return pa.table({group: table[group][:1], "content": pa.array([pairs.tobytes()], pa.binary())})

    kept = lines.select(group, order, "re", "im")
    return kept.groupBy(group).applyInArrow(encode, f"{group} {lines.schema[group].dataType.simpleString()}, content binary")


def series_to_binary(samples: DataFrame, *, bit_size: int) -> DataFrame:
    """(series_id, content): each series' samples in order, of 1, 2 or 4 bytes by their bit size. A series is of bounded size: a file."""
    kind = DTYPES["u8" if bit_size <= 8 else "u16" if bit_size <= 16 else "u32"]

    def encode(table: pa.Table) -> pa.Table:
        x = table["x"].to_numpy()[np.argsort(table["i"].to_numpy(), kind="stable")]
        return pa.table({"series_id": table["series_id"][:1], "content": pa.array([x.astype(kind).tobytes()], pa.binary())})

    return samples.select("series_id", "i", "x").groupBy("series_id").applyInArrow(encode, f"series_id {samples.schema['series_id'].dataType.simpleString()}, content binary")


def write_binary_files(files: DataFrame, path: str) -> int:
    """Writes (name, content) as files below path, a folder that all executors reach, and returns their number.

    A file appears under its name only when it is whole, so that a task may run again.
    """
    ship(files.sparkSession)
    table = files.select("name", "content")

    def write(batches):
        files, folder = store(path)
        files.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(content or b"")
                files.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return table.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_frames(frames: DataFrame, path: str, *, frame: str = "frame_id") -> None:
    """Parquet, one folder for each frame, so that readers prune by frame."""
    frames.repartition(frame).write.partitionBy(frame).parquet(path)
