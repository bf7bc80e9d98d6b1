"""Raw little- or big-endian binary as a Spark data source: bytes read in ranges, frames written in parts.

Reading. A folder's files are cut into ranges of whole records, an image line, a line of complex samples or a sample, of at most `range_bytes`; small ranges share
a task, also where these are many: beyond some hundreds of tasks each takes more of them, one after the other, up to 64 MB. So a file of any size is read in tasks of bounded memory. The options `numbers` (of frames, patches) and `places` (y, az, i) choose the files that are opened and
the bytes that are read. They are options, not filters that Spark pushes: Spark 4.1 keeps pushed filters with the loaded table, so
that two scans of one table, in a self-join say, would both read what the last one asked for.

Writing. A task writes runs of image lines to their place in a temporary file that all tasks of a frame share; frames appear under their names when the driver
commits, after all their bytes are there, and not at all if it aborts. A task that runs again writes the same bytes to the same place. This
needs a folder that driver and executors reach as a file system; reading takes any store that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

DTYPES = {"u8": "<u1", "u16": "<u2", "u32": "<u4", "f32": "<f4"}
#: Columns by layout; the first ones come from a file's name.
SCHEMAS = {
    "frames": "file string, frame_id int, y int, x int, v {value}, error string",
    "lines": "file string, scene_id int, patch int, az int, re array<float>, im array<float>",
    "samples": "file string, series_id string, i long, x long",
    "bytes": "file string, name string, at long, data binary",
}
_BATCH = 1 << 18  # values that are decoded at once
_OPENING, _TASK, _TASKS = 65_536, 64 << 20, 256  # what opening a file counts; bytes of a task, where ranges are smaller and more than so many tasks


def store(path: str):
    """(file system, path in it) of a path or a URI."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def local_folder(path: str) -> str:
    """The folder of a path that is a file system's."""
    path = re.sub("^file:/+", "/", path)
    if "://" in path:
        raise ValueError(f"{path}: raw frames are written to their place in a file, which needs a mounted file system")
    return path


def last_number(name: str) -> int | None:
    found = re.search(r"(\d+)\D*$", name)
    return int(found[1]) if found and int(found[1]) < 2**31 else None


@dataclass
class Range(InputPartition):
    """(path in the store, what the file's name tells, first record, end; first is -1 for a file of another size, with its error)."""

    pieces: list[tuple[str, dict, int, int, str | None]]

    def __post_init__(self):
        super().__init__(None)


class RawReader(DataSourceReader):
    def __init__(self, options: dict, layout: str):
        self.options, self.layout = options, layout
        self.kind = np.dtype(DTYPES[options.get("dtype", "u16")])
        if options.get("endian", "little") == "big":
            self.kind = self.kind.newbyteorder(">")
        self.width, self.height = int(options.get("width", 0)), int(options.get("height", 0))
        self.record = {"frames": self.width * self.kind.itemsize, "lines": 8 * self.width, "samples": self.kind.itemsize, "bytes": 1}[layout]
        self.chunk = int(options.get("chunk_bytes", 1 << 20))
        self.numbers = json.loads(options.get("numbers", "null"))  # ranges [first, last]
        self.least, self.most = json.loads(options.get("places", f"[0, {1 << 62}]"))

    def names(self, path: str, name: str) -> dict:
        if self.layout == "frames":
            return {"file": path, "frame_id": last_number(name)}
        if self.layout in ("samples", "bytes"):
            return {"file": path, "series_id": name}
        scene = re.search(r"scene(\d+)", name)
        return {"file": path, "scene_id": int(scene[1]) if scene else int(self.options.get("scene_id", 0)), "patch": last_number(name)}

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, folder = store(self.options["path"])
        pattern, size = self.options.get("pattern", "*.bin"), int(self.options.get("range_bytes", 64 << 20))
        per_range = max(1, size // max(1, self.record))
        if self.layout == "bytes":  # ranges of whole chunks
            per_range = max(1, per_range // self.chunk) * self.chunk
        found = []
        for info in sorted(files.get_file_info(fs.FileSelector(folder, recursive=self.options.get("recursive", "false") == "true")), key=lambda i: i.path):
            name = info.base_name
            if info.type != fs.FileType.File or name.startswith((".", "_")) or not fnmatch(name, pattern):
                continue
            told = self.names(f"{self.options['path'].rstrip('/')}/{os.path.relpath(info.path, folder)}", name)
            number = last_number(name)
            if self.numbers is not None and not any(number is not None and a <= number <= b for a, b in self.numbers):
                continue
            n, rest = divmod(info.size, self.record)
            wrong = f"{info.size} bytes instead of {self.record * (self.height or n)}" if rest or (self.height and n != self.height) else None
            if wrong and self.layout != "frames":
                raise ValueError(f"{told['file']}: {wrong}")
            cuts = [(-1, 0)] if wrong else [(b, min(b + per_range, n, self.most + 1)) for b in range(max(0, self.least), min(n, self.most + 1), per_range)]
            for begin, end in cuts:
                own = (end - begin) * self.record if begin >= 0 else 0
                found.append(((info.path, told, begin, end, wrong), own))
        # ranges are read one after the other, so what a task takes bounds its time, not its memory
        size = max(size, min(_TASK, sum(own + _OPENING for _, own in found) // _TASKS))
        out, held, held_bytes = [], [], 0
        for piece, own in found:
            if held and held_bytes + own > size:
                out.append(Range(held))
                held, held_bytes = [], 0
            held.append(piece)
            held_bytes += own + _OPENING
        return [*out, Range(held)] if held else out or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.options["path"])
        step = self.chunk if self.layout == "bytes" else max(1, _BATCH // max(1, self.width))
        for path, told, begin, end, wrong in partition.pieces:
            if wrong:
                yield self.failed(told, wrong)
                continue
            with files.open_input_file(path) as file:
                for at in range(begin, end, step):
                    n = min(step, end - at)
                    file.seek(at * self.record)
                    data = file.read(n * self.record)
                    if len(data) != n * self.record:
                        raise OSError(f"{path}: {len(data)} bytes at {at * self.record} instead of {n * self.record}")
                    yield self.decoded(told, at, n, data)

    def failed(self, told: dict, wrong: str) -> pa.RecordBatch:
        value = pa.float64() if self.kind.kind == "f" else pa.int64()
        columns = [pa.array([told["file"]]), pa.array([told["frame_id"]], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, value), pa.array([wrong])]
        return pa.RecordBatch.from_arrays(columns, ["file", "frame_id", "y", "x", "v", "error"])

    def decoded(self, told: dict, first: int, n: int, data: bytes) -> pa.RecordBatch:
        same = lambda v, size: pa.array([v], pa.string()).take(pa.array(np.zeros(size, np.int32)))
        if self.layout == "lines":
            v = np.frombuffer(data, "<f4").reshape(n, self.width, 2)
            border = pa.array(np.arange(0, n * self.width + 1, self.width, dtype=np.int32))
            parts = [pa.ListArray.from_arrays(border, pa.array(np.ascontiguousarray(v[:, :, k]).ravel())) for k in (0, 1)]
            ids = [pa.array(np.full(n, told[c] if told[c] is not None else -1, np.int32)) for c in ("scene_id", "patch")]
            return pa.RecordBatch.from_arrays([same(told["file"], n), *ids, pa.array(np.arange(first, first + n, dtype=np.int32)), *parts], ["file", "scene_id", "patch", "az", "re", "im"])
        if self.layout == "bytes":
            columns = [pa.array([x]) for x in (told["file"], told["series_id"], first)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], ["file", "name", "at", "data"])
        v = np.frombuffer(data, self.kind)
        v = v.astype(np.float64 if self.kind.kind == "f" else np.int64)
        if self.layout == "samples":
            return pa.RecordBatch.from_arrays([same(told["file"], len(v)), same(told["series_id"], len(v)), pa.array(np.arange(first, first + n)), pa.array(v)], ["file", "series_id", "i", "x"])
        y, x = np.divmod(np.arange(first * self.width, (first + n) * self.width, dtype=np.int64), self.width)
        frame = np.full(len(v), -1 if told["frame_id"] is None else told["frame_id"], np.int32)
        return pa.RecordBatch.from_arrays([same(told["file"], len(v)), pa.array(frame), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(v), pa.nulls(len(v), pa.string())], ["file", "frame_id", "y", "x", "v", "error"])


@dataclass
class Written(WriterCommitMessage):
    """Bytes of each file that a task has written."""

    bytes: dict


def _put(path: str, data: bytes, at: int) -> None:
    """data at its place in a file that others write to as well."""
    file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        left = memoryview(data)
        while left:
            n = os.pwrite(file, left, at)
            left, at = left[n:], at + n
    finally:
        os.close(file)


class PlacedWriter(DataSourceArrowWriter):
    """Writes parts to their place in temporary files, which get their names when all bytes are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = local_folder(options["path"]), overwrite
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def file_name(self, key) -> str:
        return key

    def size(self, key) -> int:
        """Of a whole file."""
        return os.path.getsize(f"{self.temporary}/{key}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows (name, at, data)."""
        os.makedirs(self.temporary, exist_ok=True)
        done: dict = {}
        for batch in batches:
            for name, at, data in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "data")), strict=True):
                if not name or "/" in name or name.startswith("_temporary-"):
                    raise ValueError(f"{name} is no file name")
                _put(f"{self.temporary}/{name}", data or b"", at)
                done[name] = done.get(name, 0) + len(data or b"")
        return Written(done)

    def commit(self, messages: list) -> None:
        """Files that are whole get their names; any other file fails the write."""
        total: dict = {}
        for message in messages:
            for key, n in (message.bytes if message else {}).items():
                total[key] = total.get(key, 0) + n
        short = sorted(k for k, n in total.items() if n != self.size(k))
        if short:
            self.abort(messages)
            raise ValueError(f"files {short[:10]} lack parts")
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.folder):
                if not name.startswith("_temporary-"):
                    os.remove(f"{self.folder}/{name}")
        for key in sorted(total):
            os.replace(f"{self.temporary}/{key}", f"{self.folder}/{self.file_name(key)}")
        shutil.rmtree(self.temporary, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)


class RawWriter(PlacedWriter):
    """Frames by rows of pixels."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.width, self.height = int(options["width"]), int(options["height"])
        kind = np.dtype(DTYPES[options.get("dtype", "u16")])
        self.kind = kind.newbyteorder(">") if options.get("endian", "little") == "big" else kind
        self.name, self.lines = options.get("name", "frame_{:06d}.bin"), int(options.get("lines_per_part", 0)) or self.height

    def file_name(self, key) -> str:
        return self.name.format(key)

    def size(self, key) -> int:
        return self.width * self.height * self.kind.itemsize

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows (frame_id, y, x, v) in the order of frames and lines; a run of lines is written when it is whole."""
        os.makedirs(self.temporary, exist_ok=True)
        here, grid, seen, done = None, None, 0, {}

        def put():
            frame, part = here
            if seen != grid.size:
                raise ValueError(f"frame {frame}: {seen} pixels in lines {part * self.lines} to {part * self.lines + len(grid) - 1} instead of {grid.size}")
            _put(f"{self.temporary}/{frame}", grid.tobytes(), part * self.lines * self.width * self.kind.itemsize)
            done[frame] = done.get(frame, 0) + grid.nbytes

        for batch in batches:
            frame, y, x, v = (batch.column(c).to_numpy() for c in ("frame_id", "y", "x", "v"))
            if len(y) and not (0 <= y.min() and y.max() < self.height and 0 <= x.min() and x.max() < self.width):
                raise ValueError(f"pixels outside {self.width} x {self.height}")
            part = y // self.lines
            cuts = np.flatnonzero(np.concatenate([[True], (frame[1:] != frame[:-1]) | (part[1:] != part[:-1])])[: len(y)])
            for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(y)]):
                own = int(frame[b]), int(part[b])
                if own != here:
                    if here is not None:
                        put()
                    here, seen = own, 0
                    grid = np.zeros((min(self.lines, self.height - own[1] * self.lines), self.width), self.kind)
                grid[y[b:e] - own[1] * self.lines, x[b:e]] = v[b:e]
                seen += e - b
        if here is not None:
            put()
        return Written(done)


class RawSource(DataSource):
    """format("framelake_raw"): options path, layout (frames, lines, samples, bytes), width, height, dtype, endian, pattern, range_bytes, numbers, places; to write: name, lines_per_part."""

    @classmethod
    def name(cls) -> str:
        return "framelake_raw"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("layout", "frames")].format(value="double" if self.options.get("dtype") == "f32" else "long")

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options), self.options.get("layout", "frames"))

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return (PlacedWriter if self.options.get("layout") == "bytes" else RawWriter)(dict(self.options), overwrite)
