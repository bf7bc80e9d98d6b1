"""Focusing of radar pulses into images, on line tables.

Pulses are (scene_id, az, re[], im[]), a line for each pulse; scenes hold the radar's parameters, one row each. FFTs run over Arrow
batches of lines; everything else is joins, groups and column expressions. A corner turn shuffles tiles of lines, not samples. Focusing shuffles lines once behind the
patches: tiles of range bins with a halo of the largest migration go through azimuth FFT, migration, compression and looks in one function.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.shipping import ship

#: Speed of light in m/s.
C = 299792458.0
LINE = "re array<double>, im array<double>"


def few_scenes(scenes: DataFrame, most: int = 100_000) -> bool:
    """Whether what there is one row of for each scene may be broadcast: its number is checked, not assumed. With more scenes no scene is a hot key."""
    return scenes.select("scene_id").limit(most + 1).count() <= most


def _with_scene(lines: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    return lines.join(F.broadcast(table) if few else table, "scene_id")


def assign_patches(pulses: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, patch, i, re, im): patch p has the apatch lines from p * avalid on; lines beyond the scene are zeros."""
    grid = scenes.select("scene_id", "rsize", "apatch", "avalid", "asize", F.explode(F.expr("sequence(0, npatch - 1)")).alias("patch"))
    grid = grid.select("scene_id", "rsize", "patch", F.explode(F.expr("sequence(0, apatch - 1)")).alias("i"), (F.col("patch") * F.col("avalid")).alias("begin"))
    grid = grid.withColumn("az", F.col("begin") + F.col("i"))
    zeros = F.expr("array_repeat(0D, rsize)")
    joined = grid.join(pulses.select("scene_id", "az", F.col("re").cast("array<double>").alias("re"), F.col("im").cast("array<double>").alias("im")), ["scene_id", "az"], "left")
    return joined.select("scene_id", "patch", "i", F.coalesce("re", zeros).alias("re"), F.coalesce("im", zeros).alias("im"))


def next_power_of_2(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2), F.length(F.bin(n - 1))).cast("int"))


def pad_pow2(lines: DataFrame) -> DataFrame:
    """Lines filled with zeros to the next power of two."""
    more = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0.0), next_power_of_2(F.size(c)) - F.size(c)))
    return lines.withColumns({"re": more("re"), "im": more("im")})


def chirp(rows: DataFrame, *, fc: Column, slope: Column, tau: Column, fs: Column, length: Column) -> DataFrame:
    """Adds re and im: a linear chirp of floor(tau * fs) samples about its middle, then zeros."""
    n = F.floor(tau * fs)
    t = lambda i: (-n / 2 + i) / fs
    phase = lambda i: 2 * math.pi * fc * t(i) + math.pi * slope * t(i) * t(i)
    part = lambda f: F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i < F.least(n, length), f(phase(i))).otherwise(F.lit(0.0)))
    return rows.withColumns({"re": part(F.cos), "im": part(F.sin)})


def _complex(batch: pa.RecordBatch) -> list[np.ndarray]:
    re, im = (batch.column(c) for c in ("re", "im"))
    ends = re.offsets.to_numpy()
    whole = re.values.to_numpy(zero_copy_only=False)[: ends[-1]] + 1j * im.values.to_numpy(zero_copy_only=False)[: ends[-1]]
    return np.split(whole, ends[1:-1]) if len(ends) > 1 else []


def _with_lines(batch: pa.RecordBatch, lines: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, lines)]).astype(np.int32)
    whole = np.concatenate([np.zeros(0, complex), *lines])
    arrays = {"re": pa.ListArray.from_arrays(offsets, whole.real), "im": pa.ListArray.from_arrays(offsets, whole.imag)}
    return pa.RecordBatch.from_arrays([arrays.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)


def _stacked(lines: list[np.ndarray], f) -> list[np.ndarray]:
    """f on all lines of one length at once."""
    out: list = [None] * len(lines)
    for size in {len(x) for x in lines}:
        at = [i for i, x in enumerate(lines) if len(x) == size]
        for i, x in zip(at, f(np.stack([lines[i] for i in at])), strict=True):
            out[i] = x
    return out


def line_fft(lines: DataFrame, *, inverse: bool = False) -> DataFrame:
    """FFT of every line, or its inverse divided by the length; no shuffle."""

    def run(batches):
        for batch in batches:
            yield _with_lines(batch, _stacked(_complex(batch), np.fft.ifft if inverse else np.fft.fft))

    ship(lines.sparkSession)
    return lines.mapInArrow(run, lines.schema)


def _times_conjugate(df: DataFrame) -> DataFrame:
    """re and im times the conjugate of ref_re and ref_im."""
    zipped = F.arrays_zip("re", "im", "ref_re", "ref_im")
    return df.withColumns({
        "re": F.transform(zipped, lambda z: z["re"] * z["ref_re"] + z["im"] * z["ref_im"]),
        "im": F.transform(zipped, lambda z: z["im"] * z["ref_re"] - z["re"] * z["ref_im"]),
    }).drop("ref_re", "ref_im")


def matched_filter(lines: DataFrame, reference: DataFrame, *, few: bool = False) -> DataFrame:
    """Each line times the conjugate of its scene's reference (one row for each scene). few: see few_scenes; then lines stay where they are."""
    return _times_conjugate(_with_scene(lines, reference.select("scene_id", F.col("re").alias("ref_re"), F.col("im").alias("ref_im")), few))


def range_reference(scenes: DataFrame) -> DataFrame:
    made = chirp(scenes, fc=F.lit(0.0), slope=F.col("slope"), tau=F.col("tau"), fs=F.col("fs"), length=F.col("rsize"))
    return line_fft(pad_pow2(made.select("scene_id", "re", "im")))


def _azimuth_chirp(scenes: DataFrame, fdc: DataFrame) -> DataFrame:
    """Scenes with their fdc, and the slope and length of the azimuth chirp."""
    rows = scenes.join(fdc, "scene_id").withColumn("rng", F.col("r0") + F.expr("rvalid div 2") * C / (2 * F.col("fs")))
    rows = rows.withColumn("rdc", F.col("rng") / F.sqrt(1 - F.pow(F.col("lambda") * F.col("fdc") / (2 * F.col("velocity")), 2)))
    rows = rows.withColumn("tauz", F.col("rdc") * (F.col("lambda") / 10) * 0.8 / F.col("velocity"))
    return rows.withColumn("slope_az", -2 * F.pow("velocity", F.lit(2)) / (F.col("lambda") * F.col("rdc"))).drop("rng", "rdc")


def azimuth_reference(scenes: DataFrame, fdc: DataFrame) -> DataFrame:
    made = chirp(_azimuth_chirp(scenes, fdc), fc=F.col("fdc"), slope=F.col("slope_az"), tau=F.col("tauz"), fs=F.col("prf"), length=F.col("apatch"))
    return line_fft(pad_pow2(made.select("scene_id", "re", "im")))


def _angles(table: pa.Table) -> pa.Table:
    """A tile of the first patch, some bins of all lines: the sum of the bins' phases between following lines, and the number of bins."""
    table = table.take(np.argsort(table["i"].to_numpy(), kind="stable"))
    lines = _grid(table["re"], len(table["re"][0])) + 1j * _grid(table["im"], len(table["im"][0]))
    follows = np.diff(table["i"].to_numpy()) == 1
    turn = (lines[:-1].conj() * lines[1:])[follows].sum(axis=0)
    return pa.table({"scene_id": table["scene_id"].slice(0, 1), "s": pa.array([np.angle(turn).sum()]), "n": pa.array([len(turn) if follows.any() else 0], pa.int64())})


def doppler_centroid(patches: DataFrame, scenes: DataFrame, *, tile: int = 64, few: bool = False) -> DataFrame:
    """(scene_id, fdc) from the phase between following lines of the first patch, by range bin; tiles of bins meet, not samples."""
    ship(patches.sparkSession)
    first = _with_scene(patches.where("patch = 0"), scenes.select("scene_id", "rsize"), few).withColumn("tile", F.explode(F.expr(f"sequence(0, (rsize - 1) div {tile})")))
    piece = lambda c: F.slice(c, F.col("tile") * tile + 1, F.least(F.lit(tile), F.col("rsize") - F.col("tile") * tile)).cast("array<double>").alias(c)
    tiles = first.select("scene_id", "tile", F.col("i").cast("int").alias("i"), piece("re"), piece("im"))
    sums = tiles.groupBy("scene_id", "tile").applyInArrow(_angles, f"scene_id {patches.schema['scene_id'].dataType.simpleString()}, s double, n long")
    means = sums.groupBy("scene_id").agg((F.sum("s") / F.sum("n")).alias("angle"))
    return means.join(scenes.select("scene_id", "prf"), "scene_id").select("scene_id", (F.col("angle") * F.col("prf") / (2 * math.pi)).alias("fdc"))


def range_compress(patches: DataFrame, scenes: DataFrame, *, few: bool | None = None) -> DataFrame:
    """FFT, matched filter and inverse FFT of every line; no shuffle of lines if there are few_scenes."""
    few = few_scenes(scenes) if few is None else few
    return line_fft(matched_filter(line_fft(pad_pow2(patches)), range_reference(scenes), few=few), inverse=True)


def _grid(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(grid: np.ndarray) -> pa.ListArray:
    """Rows as lists, in one buffer."""
    return pa.ListArray.from_arrays(np.arange(0, grid.size + 1, max(1, grid.shape[1]), dtype=np.int32)[: len(grid) + 1], pa.array(np.ascontiguousarray(grid).ravel()))


def _turned(keys: tuple[str, ...], row: str, out: str, tile: int):
    def turn(table: pa.Table) -> pa.Table:
        """A tile, some samples of all lines of a group: its transpose, cut from one buffer."""
        table = table.take(np.argsort(table[row].to_numpy(), kind="stable"))
        width = len(table["re"][0])
        parts = {c: _lists(_grid(table[c], width).T) for c in ("re", "im")}
        first = table["_t"][0].as_py() * tile
        same = {k: table[k].slice(0, 1).take(pa.array(np.zeros(width, np.int64))) for k in keys}
        return pa.table({**same, out: pa.array(np.arange(first, first + width, dtype=np.int32)), **parts})

    return turn


def corner_turn(lines: DataFrame, *, keys: tuple[str, ...] = ("scene_id", "patch"), row: str = "i", out: str = "j", n_out: Column | int | None = None, tile: int = 32) -> DataFrame:
    """The transpose of each group's lines: (keys, out, re, im). Rows moved: lines * (columns / tile), each sample once."""
    ship(lines.sparkSession)
    n = F.size("re") if n_out is None else F.lit(n_out) if isinstance(n_out, int) else n_out
    tiles = lines.withColumn("_t", F.explode(F.sequence(F.lit(0), F.ceil(n / tile).cast("int") - 1)))
    cut = lambda c: F.slice(c, F.col("_t") * tile + 1, F.least(F.lit(tile), n - F.col("_t") * tile)).cast("array<double>")
    tiles = tiles.select(*keys, "_t", row, cut("re").alias("re"), cut("im").alias("im"))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{out} int", LINE])
    return tiles.groupBy(*keys, "_t").applyInArrow(_turned(keys, row, out, tile), schema)


def migration_shift(i: Column, j: Column) -> Column:
    """Range bins that the echo at range i has moved at azimuth frequency j; on scene parameters and fdc. Halves round away from 0."""
    bin_size = C / (2 * F.col("fs"))
    delta = j * F.col("prf") / F.col("avalid") + F.col("fdc")
    return F.round((1 / F.sqrt(1 - F.pow(F.col("lambda") * delta / (2 * F.col("velocity")), 2)) - 1) * (F.col("r0") + i * bin_size) / bin_size).cast("int")


def migration_table(scenes: DataFrame, fdc: DataFrame) -> DataFrame:
    """(scene_id, i, j, shift), for a look at the shifts; migration_correct works them out itself."""
    grid = scenes.join(fdc, "scene_id").withColumn("i", F.explode(F.expr("sequence(0, rvalid - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, apatch - 1)")))
    return grid.select("scene_id", "i", "j", migration_shift(F.col("i"), F.col("j")).alias("shift"))


def _gather():
    def gather(table: pa.Table) -> pa.Table:
        """A tile: some columns of all lines of a patch, each moved from the line that is shift lines further."""
        table = table.take(np.argsort(table["i"].to_numpy(), kind="stable"))
        i, width = table["i"].to_numpy(), len(table["re"][0])
        source = i[:, None] + _grid(table["shift"], width)
        at = np.minimum(np.searchsorted(i, source), len(i) - 1)
        there, column = i[at] == source, np.arange(width)
        parts = {c: _lists(np.where(there, _grid(table[c], width)[at, column], 0.0)) for c in ("re", "im")}
        return pa.table({"scene_id": table["scene_id"], "patch": table["patch"], "i": table["i"], "tile": table["tile"], **parts})

    return gather


def migration_correct(lines: DataFrame, scenes: DataFrame, fdc: DataFrame, *, line: str = "j_range", tile: int = 64) -> DataFrame:
    """out[i][j] = in[i + shift(i, j)][j], or 0 beyond the last line: a gather by a computed key.

    Lines are cut into tiles of columns, and the tiles of a patch that have the same columns meet. Rows moved: lines * (columns / tile), twice.
    """
    ship(lines.sparkSession)
    cut = lines.select("scene_id", "patch", F.col(line).cast("int").alias("i"), F.posexplode(F.sequence(F.lit(0), F.size("re") - 1, F.lit(tile))).alias("tile", "begin"), "re", "im")
    piece = lambda c: F.slice(c, F.col("begin") + 1, F.least(F.lit(tile), F.size(c) - F.col("begin"))).alias(c)
    cut = cut.select("scene_id", "patch", "i", "tile", "begin", piece("re"), piece("im")).join(scenes.join(fdc, "scene_id"), "scene_id")
    shift = F.transform(F.sequence(F.col("begin"), F.col("begin") + F.size("re") - 1), lambda j: migration_shift(F.col("i"), j))
    tiles = cut.select("scene_id", "patch", "i", "tile", "re", "im", shift.alias("shift"))
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = f"scene_id {kinds['scene_id']}, patch {kinds['patch']}, i int, tile int, {LINE}"
    moved = tiles.groupBy("scene_id", "patch", "tile").applyInArrow(_gather(), schema)
    back = moved.groupBy("scene_id", "patch", "i").agg(F.array_sort(F.collect_list(F.struct("tile", "re", "im"))).alias("s"))
    whole = lambda c: F.flatten(F.transform("s", lambda e: e[c])).alias(c)
    return back.select("scene_id", "patch", F.col("i").cast(lines.schema[line].dataType).alias(line), whole("re"), whole("im"))


def azimuth_compress(lines: DataFrame, reference: DataFrame) -> DataFrame:
    return line_fft(matched_filter(lines, reference), inverse=True)


def multilook(lines: DataFrame, scenes: DataFrame, *, looks: int) -> DataFrame:
    """(scene_id, row, col, value): log2 of the mean magnitude of blocks of azimuth lines and range bins; 0 stays 0."""
    sized = scenes.withColumn("width", F.expr(f"rvalid div {looks}")).withColumn("isx", F.expr("asize div width")).withColumn("isy", F.expr("rvalid div width")).withColumn("nfx", F.expr("avalid div isx"))
    joined = lines.join(sized.select("scene_id", "width", "isx", "isy", "nfx"), "scene_id").where("i < nfx * isx")
    magnitude = F.transform(F.arrays_zip("re", "im"), lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))
    sums = lambda c: F.aggregate(F.slice(magnitude, c * F.col("isy") + 1, F.col("isy")), F.lit(0.0), lambda a, b: a + b)
    parts = joined.select("scene_id", (F.col("patch") * F.col("nfx") + F.expr("i div isx")).cast("int").alias("row"), "isx", "isy", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("width") - 1), sums)).alias("col", "s"))
    means = parts.groupBy("scene_id", "row", "col").agg((F.sum("s") / F.max(F.col("isx") * F.col("isy"))).alias("m"))
    return means.select("scene_id", "row", "col", F.when(F.col("m") == 0, 0.0).otherwise(F.log2("m")).alias("value"))


def quantize_minmax(image: DataFrame, *, levels: int = 256) -> DataFrame:
    """floor(levels / (max - min) * (value - min)), at most levels - 1, by scene; the maximum is the least positive float at least."""
    ends = image.groupBy("scene_id").agg(F.min("value").alias("lo"), F.greatest(F.max("value"), F.lit(1.17549435e-38)).alias("hi"))
    scaled = F.floor(levels / (F.col("hi") - F.col("lo")) * (F.col("value") - F.col("lo")))
    return image.join(ends, "scene_id").select("scene_id", "row", "col", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(scaled, F.lit(levels - 1))).cast("int").alias("level"))


#: What the function over tiles needs of a scene; the chirp of azimuth_reference by its slope and length.
_PARAMETERS = ("lambda", "prf", "fs", "velocity", "r0", "fdc", "slope_az", "tauz")
_SIZES = ("rvalid", "avalid", "apatch", "asize", "halo")


def _tile_of_looks(looks: int, tile: int):
    spectra_of: dict[tuple, np.ndarray] = {}

    def reference(one: dict, n: int) -> np.ndarray:
        """The spectrum of the scene's azimuth chirp; the last scene's stays for its next tiles."""
        key = (one["fdc"], one["slope_az"], one["tauz"], one["prf"], n)
        if key not in spectra_of:
            spectra_of.clear()
            size = math.floor(one["tauz"] * one["prf"])
            t = (np.arange(min(size, one["apatch"])) - size / 2) / one["prf"]
            line = np.zeros(n, complex)
            line[: len(t)] = np.exp(1j * (2 * math.pi * one["fdc"] * t + math.pi * one["slope_az"] * t * t))
            spectra_of[key] = np.fft.fft(line)
        return spectra_of[key]

    def run(table: pa.Table) -> pa.Table:
        """A tile of range bins and its halo, a row for each pulse of a patch: sums of the magnitudes of its looks."""
        one = {c: table[c][0].as_py() for c in ("scene_id", "patch", "tile", *_PARAMETERS, *_SIZES)}
        first, width = one["tile"] * tile, len(table["re"][0])
        pulses = np.zeros((one["apatch"], width), complex)
        pulses[table["i"].to_numpy()] = _grid(table["re"], width) + 1j * _grid(table["im"], width)
        n = 1 << max(0, one["apatch"] - 1).bit_length()
        spectra = np.fft.fft(pulses.T, n, axis=1)
        # the gather: each bin's line takes from the lines that its echo has moved to, zeros beyond the last one
        own, j = min(tile, one["rvalid"] - first), np.arange(n)
        size = C / (2 * one["fs"])
        delta = j * one["prf"] / one["avalid"] + one["fdc"]
        stretch = 1 / np.sqrt(1 - (one["lambda"] * delta / (2 * one["velocity"])) ** 2) - 1
        shift = np.floor(stretch * (one["r0"] + np.arange(first, first + own)[:, None] * size) / size + 0.5).astype(np.int64)
        source = np.arange(own)[:, None] + shift
        moved = np.where(source < width, spectra[np.minimum(source, width - 1), j], 0)
        magnitude = np.abs(np.fft.ifft(moved * reference(one, n).conj(), axis=1))
        columns = one["rvalid"] // looks
        isx, isy = one["asize"] // columns, one["rvalid"] // columns
        rows = one["avalid"] // isx
        sums = magnitude[:, : rows * isx].reshape(own, rows, isx).sum(axis=2)
        column = np.arange(first, first + own) // isy
        sums, column = sums[column < columns], column[column < columns]
        names, place = np.unique(column, return_inverse=True)
        total = np.zeros((len(names), rows))
        np.add.at(total, place, sums)
        out = {"row": np.tile(np.arange(rows) + one["patch"] * rows, len(names)), "col": np.repeat(names, rows)}
        scene = table["scene_id"].slice(0, 1).take(pa.array(np.zeros(total.size, np.int64)))
        return pa.table({"scene_id": scene, **{k: pa.array(v.astype(np.int32)) for k, v in out.items()}, "s": pa.array(total.ravel()), "n": pa.array(np.full(total.size, isx * isy, np.int64))})

    return run


def azimuth_looks(ranged: DataFrame, scenes: DataFrame, fdc: DataFrame, *, looks: int, tile: int = 64, few: bool | None = None) -> DataFrame:
    """R8 to R11 in one function over tiles of `tile` range bins: (scene_id, row, col, value) from range-compressed lines (scene_id, patch, i, re, im).

    A line goes to each tile with the bins that the tile's echoes may have moved to, `halo` more than its own: the largest shift of the scene, at one end of
    the frequencies in the last bin. A tile holds apatch * (tile + halo) samples, however long the line. Looks that two tiles share are summed behind them.
    """
    ship(ranged.sparkSession)
    ends = [migration_shift(F.col("rvalid") - 1, j) for j in (F.lit(0), next_power_of_2(F.col("apatch")) - 1)]
    few = few_scenes(scenes) if few is None else few
    known = _azimuth_chirp(scenes, fdc).withColumn("halo", F.greatest(*ends)).select("scene_id", *_PARAMETERS, *_SIZES)
    dealt = _with_scene(ranged, known, few).withColumn("tile", F.explode(F.expr(f"sequence(0, (rvalid - 1) div {tile})")))
    piece = lambda c: F.slice(c, F.col("tile") * tile + 1, F.least(tile + F.col("halo"), F.col("rvalid") - F.col("tile") * tile)).alias(c)
    kinds = [F.col(c).cast("double").alias(c) for c in _PARAMETERS] + [F.col(c).cast("int").alias(c) for c in (*_SIZES, "i", "patch", "tile")]
    tiles = dealt.select("scene_id", *kinds, piece("re"), piece("im"))
    sums = tiles.groupBy("scene_id", "patch", "tile").applyInArrow(_tile_of_looks(looks, tile), f"scene_id {ranged.schema['scene_id'].dataType.simpleString()}, row int, col int, s double, n long")
    means = sums.groupBy("scene_id", "row", "col").agg((F.sum("s") / F.max("n")).alias("m"))
    return means.select("scene_id", "row", "col", F.when(F.col("m") == 0, 0.0).otherwise(F.log2("m")).alias("value"))


def focus_values(pulses: DataFrame, scenes: DataFrame, *, looks: int = 4) -> DataFrame:
    """The image before quantisation. Lines are shuffled twice: to the patches and to the tiles of range bins."""
    patches, few = assign_patches(pulses, scenes), few_scenes(scenes)
    return azimuth_looks(range_compress(patches, scenes, few=few), scenes, doppler_centroid(patches, scenes, few=few), looks=looks, few=few)


def focus(pulses: DataFrame, scenes: DataFrame, *, looks: int = 4) -> DataFrame:
    """Raw pulses to an image of 256 levels: (scene_id, row, col, level)."""
    return quantize_minmax(focus_values(pulses, scenes, looks=looks))
