"""Calibration of image sequences as pixel tables: (frame, y, x, value).

Maps (offset, gain, mask) are dimension tables by pixel; Spark broadcasts them where their size allows and joins by
shuffle where it doesn't. All values are non-negative integers; wraps at 16 bits are explicit.

What looks back and ahead in time goes through each task's values in the order of time, many series at once in numpy, and keeps
four values a series: no series is ever in one row or in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.shipping import ship

PIXEL = ("y", "x")


class Scrub:
    """The recursive scrub of many series at once: add() takes the next value of some of them and tells which earlier ones are finished."""

    def __init__(self, n: int):
        self.seen = np.zeros(n, np.int64)
        self.outputs = np.zeros((2, n), np.int64)  # the two values before the waiting ones; once scrubbed, their results
        self.waiting = np.zeros((2, n), np.int64)
        self.times = np.zeros((2, n), np.int64)

    def grow(self, n: int) -> None:
        """Makes room for n series; what is there stays. By half as much again at least, so that growing costs no more than the series do."""
        if n > len(self.seen):
            more = max(n, len(self.seen) * 3 // 2) - len(self.seen)
            for name in ("seen", "outputs", "waiting", "times"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros((*old.shape[:-1], more), np.int64)], axis=-1))

    def add(self, at: np.ndarray, time: np.ndarray | int, values: np.ndarray, gains: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next value of the series at these places, one each. (Which of them finish a value, its times, the results.)"""
        seen, time = self.seen[at], np.broadcast_to(time, at.shape)
        done = seen >= 4
        own, after = at[done], values[done]
        (before2, before1), (now, following) = self.outputs[:, own], self.waiting[:, own]
        mean = (before2 + before1 + following + after) >> 2
        out = np.where(now > 2 * mean, mean, now)
        if gains is not None:
            out = (out * gains[done] >> 16) & 65535
        times = self.times[0, own]
        self.outputs[:, own] = before1, out
        self.waiting[0, own], self.times[0, own] = following, self.times[1, own]
        for k, store in enumerate((self.outputs, self.outputs, self.waiting, self.waiting)):
            some = seen == k
            store[k % 2, at[some]] = values[some]
            if k > 1:
                self.times[k % 2, at[some]] = time[some]
        self.waiting[1, own], self.times[1, own] = after, time[done]
        self.seen[at] = seen + 1
        return done, times, out

    def add_one(self, at: int, times: list[int], values: list[int], gains: list[int] | None) -> list[tuple[int, int, int]]:
        """The next values of one series. (Place of the value that finishes one, its time, the result.)"""
        seen, found = int(self.seen[at]), []
        (before2, before1), (now, following), (t0, t1) = (x[:, at].tolist() for x in (self.outputs, self.waiting, self.times))
        for i, (time, after) in enumerate(zip(times, values, strict=True)):
            if seen < 4:
                if seen < 2:
                    before2, before1 = (after, before1) if seen == 0 else (before2, after)
                else:
                    (now, t0), (following, t1) = ((after, time), (following, t1)) if seen == 2 else ((now, t0), (after, time))
                seen += 1
                continue
            mean = (before2 + before1 + following + after) >> 2
            out = mean if now > 2 * mean else now
            if gains is not None:
                out = (out * gains[i] >> 16) & 65535
            found.append((i, t0, out))
            before2, before1, now, t0, following, t1 = before1, out, following, t1, after, time
            seen += 1
        self.seen[at] = seen
        self.outputs[:, at], self.waiting[:, at], self.times[:, at] = (before2, before1), (now, following), (t0, t1)
        return found


class _Series(dict):
    """Slots for the names of series, in the order in which they come."""

    def __missing__(self, name: int) -> int:
        self[name] = slot = len(self)
        return slot


class SeriesScrub:
    """The recursive scrub of series that have times of their own: takes rows in the order of time, many moments at once."""

    def __init__(self, vectorised: int = 16):
        self.slots, self.state, self.vectorised = _Series(), Scrub(0), vectorised

    def add(self, names: np.ndarray, times: np.ndarray, values: np.ndarray, gains: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows that finish a value of their series, its times, the results).

        Rows are sorted by series, so that a batch advances each as often as it occurs: first the first rows of all, then the second ones, and so on. Where
        few series are left, they go on one by one.
        """
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        count = np.diff(np.append(begin, len(ordered)))
        slot = np.fromiter(map(self.slots.__getitem__, ordered[begin].tolist()), np.int64, len(begin))
        self.state.grow(len(self.slots))
        longest = np.argsort(-count, kind="stable")  # series with the most rows first
        begin, count, slot = begin[longest], count[longest], slot[longest]
        rows, found_times, results, turn = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while (left := int(np.searchsorted(-count, -turn))) >= self.vectorised:  # series with more rows than turns so far
            row = order[begin[:left] + turn]
            done, at, out = self.state.add(slot[:left], times[row], values[row], None if gains is None else gains[row])
            rows.append(row[done])
            found_times.append(at)
            results.append(out)
            turn += 1
        for k in range(left):
            row = order[begin[k] + turn : begin[k] + count[k]]
            found = self.state.add_one(int(slot[k]), times[row].tolist(), values[row].tolist(), None if gains is None else gains[row].tolist())
            if found:
                i, at, out = map(np.array, zip(*found, strict=True))
                rows.append(row[i])
                found_times.append(at)
                results.append(out)
        return np.concatenate(rows), np.concatenate(found_times), np.concatenate(results)


def offset_correct(frames: DataFrame, offsets: DataFrame, *, on: Sequence[str] = PIXEL, value: str = "v", offset: str = "off") -> DataFrame:
    """value - offset, modulo 2^16."""
    return frames.join(offsets.select(*on, offset), list(on)).withColumn(value, F.pmod(F.col(value) - F.col(offset), F.lit(65536)).cast("int")).drop(offset)


def gain_column(value: Column, gain: Column) -> Column:
    """value * gain in unsigned Q0.16, the lower 16 bits."""
    return F.shiftright(value.cast("long") * gain, 16).bitwiseAND(65535).cast("int")


def gain_correct(frames: DataFrame, gains: DataFrame, *, on: Sequence[str] = PIXEL, value: str = "v", gain: str = "gain") -> DataFrame:
    return frames.join(gains.select(*on, gain), list(on)).withColumn(value, gain_column(F.col(value), F.col(gain))).drop(gain)


def replace_masked(frames: DataFrame, mask: DataFrame, *, frame: str = "frame_id", on: Sequence[str] = PIXEL, value: str = "v", bad: str = "bad") -> DataFrame:
    """Where the mask is 1: the floor of the mean of the up to 8 neighbours whose mask is 0, or 0 without any.

    Only bad pixels are expanded to their neighbours, and the neighbour map doesn't grow with the number of frames.
    """
    y, x = on
    bad_pixels = mask.where(F.col(bad) == 1).select(F.col(y).alias("bad_y"), F.col(x).alias("bad_x"))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))
    near = bad_pixels.withColumn("step", F.explode(steps)).select("bad_y", "bad_x", (F.col("bad_y") + F.col("step.dy")).alias(y), (F.col("bad_x") + F.col("step.dx")).alias(x))
    near = near.join(mask.where(F.col(bad) == 0).select(y, x), [y, x])
    means = frames.join(near, [y, x]).groupBy(frame, F.col("bad_y").alias(y), F.col("bad_x").alias(x)).agg((F.sum(F.col(value).cast("long")).alias("s")), F.count("*").alias("n"))
    means = means.select(frame, y, x, F.expr("s div n").cast("int").alias("mean"))
    marked = frames.join(bad_pixels.select(F.col("bad_y").alias(y), F.col("bad_x").alias(x), F.lit(True).alias("is_bad")), [y, x], "left").join(means, [frame, y, x], "left")
    return marked.withColumn(value, F.when(F.col("is_bad"), F.coalesce("mean", F.lit(0))).otherwise(F.col(value))).drop("is_bad", "mean").select(*frames.columns)


def scrub_temporal(frames: DataFrame, *, partition: Sequence[str] = PIXEL, order: str = "frame_id", value: str = "v", mode: str = "window", gain: str | None = None) -> DataFrame:
    """Replaces values over twice the mean of the two before and the two after by that mean.

    mode "window": all neighbours are inputs; values without all four neighbours stay.
    mode "recursive": the two before are outputs already (scrubbed, and gain-corrected if `gain` names a column); only
    values with all four neighbours are returned. `order` is a whole number, once for each value of a series.
    """
    if mode == "window":
        w = Window.partitionBy(*partition).orderBy(order)
        mean = F.floor((F.lag(value, 2).over(w) + F.lag(value, 1).over(w) + F.lead(value, 1).over(w) + F.lead(value, 2).over(w)) / 4).cast("int")
        return frames.withColumn("_mean", mean).withColumn(value, F.when(F.col(value) > 2 * F.col("_mean"), F.col("_mean")).otherwise(F.col(value))).drop("_mean")
    ship(frames.sparkSession)
    kinds = {f.name: f.dataType for f in frames.schema.fields}
    # two whole numbers name a series exactly, others by a hash
    whole = len(partition) <= 2 and all(kinds[c].typeName() in ("integer", "short", "byte") for c in partition)
    name = sum(F.col(c).cast("long") * (1 << 32 * k) for k, c in enumerate(reversed(partition))) if whole else F.xxhash64(*partition)
    rows = frames.select(F.col(order).cast("long").alias("t"), name.cast("long").alias("name"), F.col(value).cast("long").alias("v"), (F.col(gain) if gain else F.lit(0)).cast("long").alias("g"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(partition)))
    width = len(partition)

    def run(batches):
        state = SeriesScrub()
        for batch in batches:
            column = lambda c, batch=batch: batch.column(c).to_numpy()
            done, times, out = state.add(column("name"), column("t"), column("v"), column("g") if gain else None)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(times), *(batch.column(4 + k).take(pa.array(done)) for k in range(width)), pa.array(out.astype(np.int32))], ["t", *(f"p{k}" for k in range(width)), "v"])

    schema = ", ".join(["t long", *(f"p{k} {kinds[c].simpleString()}" for k, c in enumerate(partition)), "v int"])
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scrubbed = rows.repartition(n, "name").sortWithinPartitions("t", "name").mapInArrow(run, schema)
    return scrubbed.select(F.col("t").cast(kinds[order]).alias(order), *(F.col(f"p{k}").alias(c) for k, c in enumerate(partition)), F.col("v").alias(value))


def bin_spatial(frames: DataFrame, *, frame: str = "frame_id", on: Sequence[str] = PIXEL, value: str = "v", ky: int = 2, kx: int = 2) -> DataFrame:
    """Sums of ky x kx pixels; only complete bins."""
    y, x = on
    binned = frames.groupBy(frame, F.expr(f"`{y}` div {ky}").cast("int").alias(y), F.expr(f"`{x}` div {kx}").cast("int").alias(x)).agg(F.sum(F.col(value).cast("long")).alias(value), F.count("*").alias("_n"))
    return binned.where(F.col("_n") == ky * kx).drop("_n")


def coadd(frames: DataFrame, *, on: Sequence[str] = PIXEL, value: str = "v") -> DataFrame:
    """The sum over frames; partial sums leave one row for each pixel and task to shuffle."""
    return frames.groupBy(*on).agg(F.sum(F.col(value).cast("long")).alias(value))


class TileSum:
    """The sum over frames of 2x2 bins of a tile, from its scrubbed pixels: a frame adds to a bin if all four pixels of the bin are finished in it.

    A pixel's value is finished two of its moments later, so the pixels of a bin may finish at different moments. Only frames in which a bin has all four
    pixels can add to it, and of these only the last two can still wait: before them each pixel has two later values.
    """

    def __init__(self, tile: int):
        self.tile, n = tile, (tile // 2) ** 2
        self.total, self.frames = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.time, self.sum, self.count = (np.full((2, n), k, np.int64) for k in (-1, 0, 0))

    def bins(self, at: np.ndarray) -> np.ndarray:
        return at // self.tile // 2 * (self.tile // 2) + at % self.tile // 2

    def wait(self, at: np.ndarray, time: int) -> None:
        """The pixels that a frame has."""
        whole = np.flatnonzero(np.bincount(self.bins(at), minlength=len(self.total)) == 4)
        self.time[0, whole], self.sum[0, whole], self.count[0, whole] = self.time[1, whole], self.sum[1, whole], self.count[1, whole]
        self.time[1, whole], self.sum[1, whole], self.count[1, whole] = time, 0, 0

    def add(self, at: np.ndarray, times: np.ndarray, values: np.ndarray) -> None:
        """Finished values of pixels, one each."""
        own = self.bins(at)
        for k in (0, 1):
            same = self.time[k, own] == times
            np.add.at(self.sum[k], own[same], values[same])
            np.add.at(self.count[k], own[same], 1)
            full = np.flatnonzero(self.count[k] == 4)
            self.total[full] += self.sum[k, full]
            self.frames[full] += 1
            self.time[k, full], self.count[k, full] = -1, 0

    def rows(self, ty: int, tx: int) -> pa.RecordBatch:
        held, half = np.flatnonzero(self.frames), self.tile // 2
        columns = (held // half + ty * half, held % half + tx * half)
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(self.total[held])], ["y", "x", "v"])


def prepared(grid: dict[str, np.ndarray]) -> np.ndarray:
    """A frame's values within a tile, offset-corrected and with bad pixels replaced, from the values and maps of the tile and a rim of one pixel; -1: none."""
    there = (grid["v"] >= 0) & (grid["off"] >= 0)
    v = np.where(there, (grid["v"] - grid["off"]) % 65536, -1)
    good = there & (grid["bad"] == 0)
    value, total, n = np.where(good, v, 0), np.zeros_like(v), np.zeros_like(v)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                total += np.roll(value, (dy, dx), (0, 1))
                n += np.roll(good, (dy, dx), (0, 1))
    return np.where(there & (grid["bad"] == 1), total // np.maximum(n, 1), v)[1:-1, 1:-1]


#: The time of a tile's maps, before all frames.
_MAPS = -(1 << 63)
_MAP_VALUES = ("off", "gain", "bad")
_TILE_ROW = ("ty", "tx", "t", "maps", "at", "v", *_MAP_VALUES)
_TILE_SCHEMA = "ty int, tx int, t long, maps long, at binary, v binary, off binary, gain binary, bad binary"


def _packed(tile: int, maps: int):
    """Pixels (t, y, x, values) to pieces: of each batch a row for each moment of a tile with its rim, places and values in binary, some 6 bytes a pixel."""

    def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        data = values.astype("<i4" if not len(values) or abs(values).max() < 1 << 31 else "<i8")
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    def run(batches):
        for batch in batches:
            t, y, x = (batch.column(c).to_numpy() for c in ("t", "y", "x"))
            (low_y, high_y), (low_x, high_x) = (((c.astype(np.int64) - 1) // tile, (c.astype(np.int64) + 1) // tile) for c in (y, x))
            every = np.arange(len(t))
            down, right = np.flatnonzero(high_y != low_y), np.flatnonzero(high_x != low_x)
            both = down[high_x[down] != low_x[down]]
            row = np.concatenate([every, down, right, both])
            ty, tx = np.concatenate([low_y, high_y[down], low_y[right], high_y[both]]), np.concatenate([low_x, low_x[down], high_x[right], high_x[both]])
            order = np.lexsort((t[row], tx, ty))
            row, ty, tx = row[order], ty[order], tx[order]
            time = t[row]
            new = (time[1:] != time[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])
            begin = np.flatnonzero(np.concatenate([[True], new])[: len(row)])
            cuts, n = np.append(begin, len(row)), len(begin)
            at = (y[row] - ty * tile + 1) * (tile + 2) + x[row] - tx * tile + 1
            values = [binary(batch.column(c).to_numpy()[row], cuts) if c in batch.schema.names else pa.nulls(n, pa.binary()) for c in ("v", *_MAP_VALUES)]
            keys = [pa.array(ty[begin].astype(np.int32)), pa.array(tx[begin].astype(np.int32)), pa.array(time[begin]), pa.array(np.full(n, maps))]
            yield pa.RecordBatch.from_arrays([*keys, binary(at, cuts), *values], list(_TILE_ROW))

    return run


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // n}").astype(np.int64)


def _calibrated(tile: int, first_prepared: int):
    side = tile + 2
    inner = lambda grid: grid.reshape(side, side)[1:-1, 1:-1]

    def run(batches):
        """Pieces by tile and time, each tile with a rim of one pixel and its maps first. Yields the sums of the tiles' bins."""
        here, state, sums, held, known = None, None, None, [], {}

        def finish():
            """The moment whose pieces have come."""
            value = np.full(side * side, -1, np.int64)
            names = {maps for maps, _, _ in held if maps in known}
            for maps, at, v in held:
                if maps in known:
                    value[at] = v
            if not names:
                return
            if len(names) == 1:
                grids = known[names.pop()]
            else:  # a frame that was written in parts, with maps of their own
                grids = {c: np.full(side * side, -1, np.int64) for c in _MAP_VALUES}
                for maps, at, _ in held:
                    for c in _MAP_VALUES if maps in known else ():
                        grids[c][at] = known[maps][c][at]
            grid = {c: g.reshape(side, side) for c, g in (("v", value), *grids.items())}
            v = (prepared(grid) if here[2] >= first_prepared else inner(value)).ravel()
            gain = inner(grids["gain"]).ravel()
            at = np.flatnonzero((v >= 0) & (gain >= 0))
            done, times, out = state.add(at, here[2], v[at], gain[at])
            sums.add(at[done], times, out)
            sums.wait(at, here[2])

        for batch in batches:
            for ty, tx, t, maps, at, *values in zip(*(batch.column(c).to_pylist() for c in _TILE_ROW), strict=True):
                if (ty, tx, t) != here and held:
                    finish()
                    held = []
                if here is None or (ty, tx) != here[:2]:
                    if here is not None:
                        yield sums.rows(*here[:2])
                    state, sums, known = Scrub(tile * tile), TileSum(tile), {}
                here = ty, tx, t
                at = np.frombuffer(at, "<i4")
                if t == _MAPS:
                    grids = known.setdefault(maps, {c: np.full(side * side, -1, np.int64) for c in _MAP_VALUES})
                    for c, data in zip(_MAP_VALUES, values[1:], strict=True):
                        grids[c][at] = _unpacked(data, len(at))
                    continue
                if maps in known:
                    held.append((maps, at, _unpacked(values[0], len(at))))
        if held:
            finish()
        if here is not None:
            yield sums.rows(*here[:2])

    return run


def with_rim(rows: DataFrame, tile: int) -> DataFrame:
    """rows with the tile (ty, tx) that each pixel (y, x) lies in, and again for each other tile whose rim of one pixel it lies in, if that has pixels of its own."""
    near = lambda c: F.sequence(F.floor((F.col(c) - 1) / tile).cast("int"), F.floor((F.col(c) + 1) / tile).cast("int"))
    own = rows.select(*(F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in PIXEL)).distinct()
    return rows.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x"))).join(own, ["ty", "tx"], "left_semi")


def tiles(frames: DataFrame, offsets: DataFrame, gains: DataFrame, mask: DataFrame, *, frame: str = "frame_id", on: Sequence[str] = PIXEL, value: str = "v", tile: int = 64) -> DataFrame:
    """Pixels by tile and rim in pieces of a moment, and the tile's maps once: (ty, tx, t, maps, at, v, off, gain, bad), what calibrate_tiles reads.

    A piece names the maps that it came with, so that frames which are added to a table later may have others.
    """
    if tile % 2:
        raise ValueError(f"tile is {tile}; bins of 2x2 pixels need an even one")
    ship(frames.sparkSession)
    y, x = on
    at = [F.col(f"`{y}`").cast("int").alias("y"), F.col(f"`{x}`").cast("int").alias("x")]
    maps = gains.select(*at, F.col("gain").cast("long").alias("gain")).join(offsets.select(*at, F.col("off").cast("long").alias("off")), ["y", "x"], "full").join(mask.select(*at, F.col("bad").cast("long").alias("bad")), ["y", "x"], "full")
    maps = maps.na.drop(subset=["y", "x"]).na.fill(-1, list(_MAP_VALUES)).select(F.lit(_MAPS).alias("t"), "y", "x", *_MAP_VALUES)
    rows = frames.select(F.col(f"`{frame}`").cast("long").alias("t"), *at, F.col(f"`{value}`").cast("long").alias("v")).na.drop()
    pack = _packed(tile, uuid.uuid4().int >> 65)
    return rows.mapInArrow(pack, _TILE_SCHEMA).unionAll(maps.mapInArrow(pack, _TILE_SCHEMA))


def write_tiles(rows: DataFrame, table: str, *, n_buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """tiles() as a table bucketed by tile, so that a campaign is shuffled once, however often it is calibrated; mode "append" adds frames."""
    # the partitions are the buckets: a file each
    writer = rows.repartition(n_buckets, "ty", "tx").write.mode(mode).bucketBy(n_buckets, "ty", "tx").sortBy("ty", "tx", "t")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def calibrate_tiles(rows: DataFrame, *, tile: int = 64, first_prepared: int = 4) -> DataFrame:
    """calibrate() of tiles(): (y, x, v). A table of write_tiles is read bucket by bucket, without a shuffle."""
    ship(rows.sparkSession)
    # a window asks for all of a tile in the order of time, which a bucketed table has already
    ordered = rows.select(*_TILE_ROW, F.row_number().over(Window.partitionBy("ty", "tx").orderBy("t")).alias("place"))
    return ordered.mapInArrow(_calibrated(tile, first_prepared), "y int, x int, v long")


def calibrate(frames: DataFrame, offsets: DataFrame, gains: DataFrame, mask: DataFrame, *, frame: str = "frame_id", on: Sequence[str] = PIXEL, value: str = "v", first_prepared: int = 4, tile: int = 64) -> DataFrame:
    """Offset, bad pixels, recursive scrub with gain, 2x2 bins and co-addition. Frames before `first_prepared` come prepared.

    Pixels are dealt once to tiles with a rim of one pixel, for the neighbours of bad pixels, in pieces of a moment, and a tile goes through time in numpy with
    five moments in memory. `tile` is even, so that bins lie within tiles and are summed there: nothing else is shuffled. A bin that lacks a pixel
    in a frame has no part of that frame, as in coadd(bin_spatial(...)).
    """
    pieces = tiles(frames, offsets, gains, mask, frame=frame, on=on, value=value, tile=tile)
    ordered = pieces.repartition("ty", "tx").sortWithinPartitions("ty", "tx", "t")
    sums = ordered.mapInArrow(_calibrated(tile, first_prepared), "y int, x int, v long")
    return sums.select(F.col("y").alias(on[0]), F.col("x").alias(on[1]), F.col("v").alias(value))


def frame_roles(frames: DataFrame, *, frame: str = "frame_id") -> DataFrame:
    """role: the first two frames are prior, the last two later, the others data."""
    last = frames.agg(F.max(frame).alias("last"))
    role = F.when(F.col(frame) < 2, "prior").when(F.col(frame) > F.col("last") - 2, "later").otherwise("data")
    return frames.join(F.broadcast(last)).withColumn("role", role).drop("last")  # one row


def pad_edge(image: DataFrame, *, image_id: str = "image_id", on: Sequence[str] = PIXEL, value: str = "v", multiple: int = 8) -> DataFrame:
    """Rows and columns up to a multiple, replicating the last ones: only border pixels are repeated."""
    y, x = on
    size = image.groupBy(image_id).agg((F.max(y) + 1).alias("h"), (F.max(x) + 1).alias("w"))
    up = lambda c: (F.ceil(F.col(c) / multiple) * multiple).cast("int")
    span = lambda c, n: F.when(F.col(c) == F.col(n) - 1, F.sequence(F.col(c), up(n) - 1)).otherwise(F.array(F.col(c)))
    grown = image.join(size, image_id).withColumn("_ys", span(y, "h")).withColumn("_xs", span(x, "w"))
    return grown.withColumn(y, F.explode("_ys")).withColumn(x, F.explode("_xs")).select(*image.columns)


def channel_mean(pixels: DataFrame, *, keys: Sequence[str] = ("frame_id", "y", "x"), value: str = "v") -> DataFrame:
    """The mean over a pixel's channels without its fraction."""
    return pixels.groupBy(*keys).agg(F.floor(F.avg(value)).cast("int").alias(value))


def sqrt_stretch(pixels: DataFrame, *, value: str = "v", brightness: int = 1) -> DataFrame:
    """floor(sqrt(v)) * brightness, within 0..65535."""
    return pixels.withColumn(value, F.least(F.greatest(F.floor(F.sqrt(value)) * brightness, F.lit(0)), F.lit(65535)).cast("int"))
