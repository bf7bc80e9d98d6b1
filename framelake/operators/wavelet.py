"""Integer and float wavelet decomposition of images, and the statistics of its coefficients by block and segment.

Images are pixel tables (image_id, y, x, v). All levels of a decomposition are worked out in tiles with the rim that the filters of all levels
reach into, so that pixels are shuffled once. A single line filter is a window over rows or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.scratch import Scratch, scratch_path, written
from framelake.functions.shipping import ship
from framelake.operators.calib import pad_edge

#: Taps of the 9/7 filters, from the middle outwards.
LOW_TAPS = (0.852698679009, 0.377402855613, -0.110624404418, -0.023849465020, 0.037828455507)
HIGH_TAPS = (-0.788485616406, 0.418092273222, 0.040689417609, -0.064538882629)


def dwt1d_int(df: DataFrame, *, partition: Sequence[str], order: str, value: str = "v", length: Column | int) -> DataFrame:
    """Integer lifting along `order` (0..length-1, even length of at least 6): lows, then highs."""
    w = Window.partitionBy(*partition).orderBy(order)
    n2 = F.lit(length) if isinstance(length, int) else length
    a = lambda k: F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
    # at odd positions; beyond the ends the even samples are mirrored
    before = F.coalesce(F.lag(value, 3).over(w), F.lead(value, 1).over(w))
    after, after3 = F.lead(value, 1).over(w), F.lead(value, 3).over(w)
    near = F.lag(value, 1).over(w)
    inner = F.floor((9 * (near + after) - (before + F.coalesce(after3, near))) / 16 + 0.5)
    # the last high sample looks back only: its right neighbours are mirrored
    last_two = F.col(order) == n2 - 3
    far = F.lag(value, 3).over(w)
    inner = F.when(last_two, F.floor((9 * (near + after) - (F.coalesce(far, after) + after)) / 16 + 0.5)).otherwise(inner)
    last = F.floor((9 * near - far) / 8 + 0.5)
    high = F.col(value) - F.when(F.col(order) == n2 - 1, last).otherwise(inner)
    highs = df.withColumn("_h", F.when(F.col(order) % 2 == 1, high.cast("long")))
    left, right = F.lag("_h", 1).over(w), F.lead("_h", 1).over(w)
    low = F.col(value) - F.floor(F.when(F.col(order) == 0, -right / 2 + 0.5).otherwise(-(left + right) / 4 + 0.5))
    out = highs.withColumn("_o", F.when(F.col(order) % 2 == 1, F.col("_h")).otherwise(low.cast("long")))
    place = F.expr(f"cast(`{order}` div 2 as int)") + F.when(F.col(order) % 2 == 1, (n2 / 2).cast("int")).otherwise(0)
    return out.withColumn(order, place).withColumn(value, F.col("_o")).drop("_h", "_o")


def dwt1d_float(df: DataFrame, *, partition: Sequence[str], order: str, value: str = "v", length: Column | int) -> DataFrame:
    """9-tap lows at even and 7-tap highs at odd places, with whole-sample mirrors at the ends."""
    w = Window.partitionBy(*partition).orderBy(order)
    n2 = F.lit(length) if isinstance(length, int) else length
    at = F.col(order)

    def tap(k: int) -> Column:
        plain = F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)
        # place at + k beyond an end is mirrored to -(at + k), or to 2 (length - 1) - (at + k)
        below = F.when(at + k < 0, F.element_at(F.col("_ends"), (1 - (at + k)).cast("int")))
        above = F.when(at + k > n2 - 1, F.element_at(F.col("_tail"), (1 + (at + k) - (n2 - 1)).cast("int")))
        return F.coalesce(below, above, plain)

    ends = df.groupBy(*partition).agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(at < 5, F.struct(order, value)))), 1, 5), lambda e: e[value]).alias("_ends"),
        F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.when(at >= n2 - 5, F.struct(order, value))))), 1, 5), lambda e: e[value]).alias("_tail"),
    )
    rows = df.join(ends, list(partition))
    sums = lambda taps: sum((taps[k] * (tap(k) + tap(-k)) for k in range(1, len(taps))), taps[0] * tap(0))
    out = rows.withColumn("_o", F.when(at % 2 == 0, sums(LOW_TAPS)).otherwise(sums(HIGH_TAPS)))
    place = F.expr(f"cast(`{order}` div 2 as int)") + F.when(at % 2 == 1, (n2 / 2).cast("int")).otherwise(0)
    return out.withColumn(order, place).withColumn(value, F.col("_o")).drop("_o", "_ends", "_tail")


Size = int | Column


def _div(size: Size, k: int) -> Size:
    return size // k if isinstance(size, int) else F.floor(size / k).cast("int")


def with_sizes(image: DataFrame) -> DataFrame:
    """image with the height and width of each image, up to a multiple of 8, in the columns _height and _width: F.col of these serves as height and width."""
    up = lambda c: (F.floor((F.max(c) + 8) / 8) * 8).cast("int")
    return image.join(image.groupBy("image_id").agg(up("y").alias("_height"), up("x").alias("_width")), "image_id")


def lifted(v: np.ndarray) -> np.ndarray:
    """dwt1d_int of each row, of even length of at least 6."""
    even, odd, n = v[:, ::2], v[:, 1::2], v.shape[1] // 2
    following = np.concatenate([even[:, 1:], even[:, -1:]], axis=1)
    # two samples before and three after an odd place, mirrored at the ends
    before = np.concatenate([even[:, 1:2], even[:, :-1]], axis=1)
    after = np.concatenate([following[:, 1:], following[:, -1:]], axis=1)
    high = odd - np.floor((9 * (even + following) - (before + after)) / 16 + 0.5).astype(np.int64)
    high[:, -1] = odd[:, -1] - np.floor((9 * even[:, -1] - before[:, -1]) / 8 + 0.5).astype(np.int64)
    left = np.concatenate([high[:, :1], high[:, :-1]], axis=1)
    low = even - np.floor(-(left + high) / 4 + 0.5).astype(np.int64)
    return np.concatenate([low[:, :n], high], axis=1)


def filtered(v: np.ndarray) -> np.ndarray:
    """dwt1d_float of each row, of even length of at least 6."""
    wide, n = np.pad(v, ((0, 0), (4, 4)), mode="reflect"), v.shape[1]
    at = lambda k, first: wide[:, 4 + k + first : 4 + k + n : 2]
    sums = lambda taps, first: sum((taps[k] * (at(k, first) + at(-k, first)) for k in range(1, len(taps))), taps[0] * at(0, first))
    return np.concatenate([sums(LOW_TAPS, 0), sums(HIGH_TAPS, 1)], axis=1)


def _decomposed(tile: int, rim: int, levels: int, kind: str):
    step, number = (lifted, np.int64) if kind == "int" else (filtered, np.float64)

    def run(table: pa.Table) -> pa.Table:
        """A tile and its rim: the coefficients of all levels that stand for the tile's own pixels, at their places in the image."""
        one = {c: table[c][0].as_py() for c in ("image_id", "_ty", "_tx", "_h", "_w")}
        sides = {}  # first and end of the tile, and of what there is of its rim
        for axis, t, size in (("y", one["_ty"], one["_h"]), ("x", one["_tx"], one["_w"])):
            first, end = t * tile, min((t + 1) * tile, size)
            sides[axis] = first, end, max(0, first - rim), min(size, end + rim)
        (y0, y1, top, bottom), (x0, x1, left, right) = sides["y"], sides["x"]
        low = np.zeros((bottom - top, right - left), number)
        low[table["y"].to_numpy() - top, table["x"].to_numpy() - left] = table["v"].to_numpy()
        parts = []

        def put(own: np.ndarray, y: int, x: int, band_y: int, band_x: int) -> None:
            ys, xs = np.indices(own.shape)
            parts.append((ys.ravel() + y + band_y, xs.ravel() + x + band_x, own.ravel()))

        for level in range(1, levels + 1):
            out = step(np.ascontiguousarray(step(low).T)).T
            h, w = (low.shape[0] // 2, low.shape[1] // 2)
            rows, columns = (slice((a - c) >> level, (b - c) >> level) for a, b, c in ((y0, y1, top), (x0, x1, left)))
            for down, across in ((False, True), (True, False), (True, True)):
                quadrant = out[h * down :, w * across :][:h, :w]
                put(quadrant[rows, columns], y0 >> level, x0 >> level, (one["_h"] >> level) * down, (one["_w"] >> level) * across)
            low = out[:h, :w]
        put(low[rows, columns], y0 >> levels, x0 >> levels, 0, 0)
        y, x, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        same = lambda c: table[c].slice(0, 1).take(pa.array(np.zeros(len(v), np.int64)))
        return pa.table({"image_id": same("image_id"), "y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "v": pa.array(v), "_height": same("_h"), "_width": same("_w")})

    return run


def dwt2d_multilevel(image: DataFrame, *, height: Size | None = None, width: Size | None = None, levels: int = 3, kind: str = "int", tile: int = 512) -> DataFrame:
    """Along rows, then along columns, and again on the low quadrant of each level; sides must divide by 2^levels, and by 6 samples at the last one at least.

    A filter reaches 4 samples to each side, so all levels together reach 4 * (2^levels - 1) pixels: a tile gets so many more. Behind the true ends lines are
    mirrored, as in the line filters; behind the rim too, which spoils nothing that the tile keeps. A pixel goes to 1.3 tiles of 512 on average.
    Without a height and width each image has its own.
    """
    if height is None:
        return dwt2d_multilevel(with_sizes(image), height=F.col("_height"), width=F.col("_width"), levels=levels, kind=kind, tile=tile).drop("_height", "_width")
    ship(image.sparkSession)
    unit = 1 << levels
    if tile % unit:
        raise ValueError(f"tile is {tile}, which does not divide by {unit}")
    rim = -(-4 * (unit - 1) // unit) * unit
    size = lambda s: (F.lit(s) if isinstance(s, int) else s).cast("int")
    rows = image.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("long" if kind == "int" else "double").alias("v"), size(height).alias("_h"), size(width).alias("_w"))
    near = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - rim) / tile)).cast("int"), F.least(F.floor((F.col(n) - 1) / tile), F.floor((F.col(c) + rim) / tile)).cast("int"))
    dealt = rows.withColumn("_ty", F.explode(near("y", "_h"))).withColumn("_tx", F.explode(near("x", "_w")))
    schema = f"image_id {image.schema['image_id'].dataType.simpleString()}, y int, x int, v {'long' if kind == 'int' else 'double'}, _height int, _width int"
    out = dealt.groupBy("image_id", "_ty", "_tx").applyInArrow(_decomposed(tile, rim, levels, kind), schema)
    return out if "_height" in image.columns else out.drop("_height", "_width")


def dwt2d(image: DataFrame, *, height: Size | None = None, width: Size | None = None, kind: str = "int", tile: int = 512) -> DataFrame:
    """One level."""
    return dwt2d_multilevel(image, height=height, width=width, levels=1, kind=kind, tile=tile)


def round_half_away(c: Column) -> Column:
    return F.when(c >= 0, F.floor(c + 0.5)).otherwise(F.ceil(c - 0.5)).cast("long")


def _band(height: Size, width: Size) -> tuple[Column, Column, Column]:
    """(level of the band, is it in the lower half, is it in the right half) of a place; the low band counts as level 3."""
    y, x = F.col("y"), F.col("x")
    level = F.when((y >= _div(height, 2)) | (x >= _div(width, 2)), 1).when((y >= _div(height, 4)) | (x >= _div(width, 4)), 2).otherwise(3)
    return level, y >= _at_level(height, level), x >= _at_level(width, level)


def _at_level(size: Size, level: Column) -> Column:
    """size / 2^level."""
    return F.when(level == 1, _div(size, 2)).when(level == 2, _div(size, 4)).otherwise(_div(size, 8))


def scale_subbands(coeffs: DataFrame, *, height: Size, width: Size) -> DataFrame:
    """HH of level l by 2^(l-1), HL and LH by 2^l, the low band by 8."""
    level, down, right = _band(height, width)
    power = F.when(~down & ~right, 3).when(down & right, level - 1).otherwise(level)
    return coeffs.withColumn("v", F.col("v") * F.pow(F.lit(2), power).cast("long"))


def regroup_blocks(coeffs: DataFrame, *, height: Size, width: Size) -> DataFrame:
    """Each coefficient to its family's 8 x 8 block: coordinates only, no shuffle."""
    level, down, right = _band(height, width)
    size = _at_level(8, level)  # of a band's patch in the block: 4, 2, 1
    rows = F.when(down, _at_level(height, level)).otherwise(0)
    cols = F.when(right, _at_level(width, level)).otherwise(0)
    i, j = F.col("y") - rows, F.col("x") - cols
    place = lambda k, on: (F.floor(k / size) * 8 + k % size + F.when(on, size).otherwise(0)).cast("int")
    return coeffs.withColumns({"y": place(i, down), "x": place(j, right)})


def assign_segments(coeffs: DataFrame, *, width: Size, segment_size: int) -> DataFrame:
    """blk (row-major), seg and pos 0..63 of each coefficient."""
    block = (_div(F.col("y"), 8) * _div(width, 8) + _div(F.col("x"), 8)).cast("int")
    return coeffs.select("image_id", _div(block, segment_size).alias("seg"), block.alias("blk"), F.expr("(y % 8) * 8 + x % 8").cast("int").alias("pos"), F.col("v").alias("c"))


def bit_length(c: Column) -> Column:
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c)))


SEGMENT = ("image_id", "seg")


def segment_bit_depths(blocks: DataFrame, *, dc_depth: str = "reference") -> DataFrame:
    """For each block dc and ac_bits, with its segment's depth_ac and depth_dc.

    dc_depth "reference": negative ones count without a sign bit; "standard": with it.
    """
    own = blocks.groupBy(*SEGMENT, "blk").agg(F.max(F.when(F.col("pos") == 0, F.col("c"))).alias("dc"), bit_length(F.max(F.when(F.col("pos") > 0, F.abs("c")).otherwise(0))).alias("ac_bits"))
    magnitude = bit_length(F.abs("dc"))  # ceil(log2(|dc| + 1))
    negative = magnitude if dc_depth == "reference" else 1 + bit_length(F.abs("dc") - 1)
    depth = F.when(F.col("dc") >= 0, magnitude + 1).otherwise(negative)
    w = Window.partitionBy(*SEGMENT)
    return own.withColumns({"depth_ac": F.max("ac_bits").over(w), "depth_dc": F.max(depth).over(w)})


def quantize_dc(depths: DataFrame) -> DataFrame:
    """q, shifted, rem and N of each block's dc."""
    dc, ac = F.col("depth_dc"), F.col("depth_ac")
    half = F.shiftright(1 + ac, 1)
    q = F.when(dc <= 3, 0).when(dc - half <= 1, dc - 3).when(dc - half > 10, dc - 10).otherwise(1 + F.shiftright(ac, 1))
    out = depths.withColumn("q", q)
    twos = F.expr("case when dc < 0 then dc + shiftleft(1L, depth_dc) else dc end")
    out = out.withColumn("_twos", twos.bitwiseAND(F.expr("shiftleft(1L, depth_dc) - 1")))
    return out.withColumns({"shifted": F.expr("shiftright(_twos, q)"), "rem": F.expr("_twos & (shiftleft(1L, q) - 1)"), "N": F.greatest(F.col("depth_dc") - F.col("q"), F.lit(1))}).drop("_twos")


def _mapped(d: Column, theta: Column) -> Column:
    return F.when((d >= 0) & (d <= theta), 2 * d).when((d < 0) & (-d <= theta), -2 * d - 1).otherwise(theta + F.abs(d))


def dc_dpcm(quantized: DataFrame) -> DataFrame:
    """code: the first block's N-bit value as it is, others' differences mapped to non-negative numbers; signed: the N-bit value."""
    half = F.expr("shiftleft(1L, N - 1)")
    signed = F.when(F.col("shifted") >= half, F.col("shifted") - 2 * half).otherwise(F.col("shifted"))
    out = quantized.withColumn("signed", F.when(F.col("N") == 1, F.col("shifted")).otherwise(signed))
    before = F.lag("signed").over(Window.partitionBy(*SEGMENT).orderBy("blk"))
    theta = F.least(before + half, half - 1 - before)
    return out.withColumn("code", F.when(before.isNull(), F.col("shifted")).otherwise(_mapped(F.col("signed") - before, theta))).withColumn("is_first", before.isNull())


def ac_dpcm(depths: DataFrame) -> DataFrame:
    """The same for ac_bits, which are unsigned of N = bit length of depth_ac."""
    out = depths.withColumn("N", bit_length(F.col("depth_ac")))
    before = F.lag("ac_bits").over(Window.partitionBy(*SEGMENT).orderBy("blk"))
    theta = F.least(before, F.expr("shiftleft(1L, N) - 1") - before)
    return out.withColumn("code", F.when(before.isNull(), F.col("ac_bits")).otherwise(_mapped(F.col("ac_bits") - before, theta)).cast("long")).withColumn("is_first", before.isNull())


def gaggle_code(codes: DataFrame, *, method: str = "exact") -> DataFrame:
    """For each gaggle of 16 blocks the k of least bits, the bits, and the width of its identifier; k = -1: uncoded.

    method "exact" tries every k; "heuristic" takes k from the mean of the codes.
    """
    max_k = F.when(F.col("N") <= 2, 0).when(F.col("N") <= 4, 2).when(F.col("N") <= 8, 6).otherwise(8)
    rest = F.when(~F.col("is_first"), F.col("code"))
    base = F.expr(f"min(blk) over (partition by {', '.join(SEGMENT)})")
    grouped = codes.withColumn("gaggle", F.expr("(blk - first_blk) div 16") if "first_blk" in codes.columns else F.floor((F.col("blk") - base) / 16).cast("int"))
    sums = grouped.groupBy(*SEGMENT, "gaggle").agg(
        F.max("N").alias("N"), F.max(max_k).alias("max_k"), F.count("*").alias("size"), F.count(rest).alias("coded"), F.sum(F.when(F.col("is_first"), F.col("N")).otherwise(0)).alias("reference_bits"), F.sum(rest).alias("total"),
        *(F.sum(F.shiftright(rest.cast("long"), k) + 1 + k).alias(f"s{k}") for k in range(9)),
    )
    options = F.filter(F.array(*(F.when(F.lit(k) <= F.col("max_k"), F.struct((F.coalesce(f"s{k}", F.lit(0)) + F.col("reference_bits")).alias("bits"), F.lit(k).alias("k"))) for k in range(9))), lambda e: e.isNotNull())
    plain = (F.col("N") * F.col("size")).cast("long")
    if method == "exact":
        best = F.array_min(options)
    else:
        wanted = F.least(F.greatest(F.floor(F.log2(F.greatest(F.coalesce("total", F.lit(0)) / F.greatest("coded", F.lit(1)), F.lit(1)))), F.lit(0)), F.col("max_k")).cast("int")
        best = F.element_at(options, wanted + 1)
    out = sums.withColumn("_best", best).withColumn("_coded", F.col("_best.bits") < plain)
    id_bits = F.when(F.col("N") <= 2, 1).when(F.col("N") <= 4, 2).when(F.col("N") <= 8, 3).otherwise(4)
    return out.select(*SEGMENT, "gaggle", "size", F.when(F.col("_coded"), F.col("_best.k")).otherwise(-1).alias("k"), F.when(F.col("_coded"), F.col("_best.bits")).otherwise(plain).cast("long").alias("bits"), id_bits.alias("id_bits"))


def dc_refinement_bits(quantized: DataFrame, *, kind: str = "int") -> DataFrame:
    """For each segment: dc planes sent up front, their bits, and dc bits within the bit planes."""
    up_front = F.greatest(F.col("q") - F.col("depth_ac"), F.lit(0))
    in_plane = F.least(F.col("q"), F.col("depth_ac"))
    if kind == "int":
        in_plane = F.when(F.col("q") > 3, F.greatest(in_plane - 3, F.lit(0))).otherwise(0)
    totals = quantized.groupBy(*SEGMENT).agg(F.max("q").alias("q"), F.max("depth_ac").alias("depth_ac"), F.count("*").alias("n_blocks"))
    return totals.select(*SEGMENT, "n_blocks", up_front.alias("planes"), (up_front * F.col("n_blocks")).alias("up_front_bits"), (in_plane * F.col("n_blocks")).alias("in_plane_bits"))


def bitplane_stats(blocks: DataFrame, *, kind: str = "int") -> DataFrame:
    """For each (segment, family, generation, plane): newly significant, refinement and sign bits. One histogram, then sums over planes."""
    y, x = F.expr("pos div 8"), F.expr("pos % 8")
    far = F.greatest(y, x)
    generation = F.when(far < 2, "parent").when(far < 4, "child").otherwise("grandchild")
    size = F.when(far < 2, 1).when(far < 4, 2).otherwise(4)
    family = F.when((y >= size) & (x >= size), 2).when(y >= size, 1).otherwise(0)
    hist = blocks.where("pos > 0").groupBy(*SEGMENT, family.alias("family"), generation.alias("generation"), bit_length(F.abs("c")).alias("bits")).count()
    w = Window.partitionBy(*SEGMENT, "family", "generation")
    planes = hist.withColumn("most", F.max("bits").over(w)).where("most > 0")
    grouped = planes.groupBy(*SEGMENT, "family", "generation", "most").agg(F.collect_list(F.struct("bits", "count")).alias("h"))
    per_plane = grouped.withColumn("plane", F.explode(F.sequence(F.lit(1), F.col("most"))))
    total = lambda keep: F.aggregate(F.filter("h", keep), F.lit(0).cast("long"), lambda s, e: s + e["count"])
    out = per_plane.select(*SEGMENT, "family", "generation", "plane", total(lambda e: e["bits"] == F.col("plane")).alias("significant"), total(lambda e: e["bits"] > F.col("plane")).alias("refinement"))
    if kind == "int":
        skipped = F.when(F.col("generation") == "parent", 3).when(F.col("generation") == "child", 2).otherwise(1) - (F.col("family") == 2).cast("int")
        skipped = F.when((F.col("generation") == "parent") & (F.col("family") == 2), 3).when(F.col("generation") == "parent", 3).otherwise(skipped)
        out = out.where(F.col("plane") > skipped)
    return out.withColumn("sign", F.col("significant"))


def segment_headers(depths: DataFrame, *, pad_rows: int | DataFrame = 0) -> DataFrame:
    """start and end flags, the segment's number modulo 256, the depths, pad rows (of all images, or a table of image_id and pad_rows), and the header's bits."""
    totals = depths.groupBy(*SEGMENT).agg(F.max("depth_dc").alias("depth_dc"), F.max("depth_ac").alias("depth_ac"))
    w = Window.partitionBy("image_id")
    last = F.col("seg") == F.max("seg").over(w)
    totals = totals.withColumn("pad_rows", F.lit(pad_rows)) if isinstance(pad_rows, int) else totals.join(pad_rows, "image_id")
    return totals.select(*SEGMENT, (F.col("seg") == 0).alias("is_first"), last.alias("is_last"), (F.col("seg") % 256).alias("seg_field"), "depth_dc", "depth_ac", F.when(last, F.col("pad_rows")).otherwise(0).alias("pad_rows"), F.when(last, 32).otherwise(24).alias("header_bits"))


def decompose(image: DataFrame, *, height: Size | None = None, width: Size | None = None, segment_size: int = 64, kind: str = "int") -> DataFrame:
    """The blocks of the scaled (integer) or rounded (float) decomposition; sides must divide by 8. Without a height and width each image has its own."""
    if height is None:
        return decompose(with_sizes(image), height=F.col("_height"), width=F.col("_width"), segment_size=segment_size, kind=kind)
    coeffs = dwt2d_multilevel(image, height=height, width=width, kind=kind)
    coeffs = scale_subbands(coeffs, height=height, width=width) if kind == "int" else coeffs.withColumn("v", round_half_away(F.col("v")))
    return assign_segments(regroup_blocks(coeffs, height=height, width=width), width=width, segment_size=segment_size)


def _gaggle_bits(codes: DataFrame, name: str) -> DataFrame:
    """Bits of all gaggles of a segment with their identifiers; codes of one bit are written raw, codes of none not at all."""
    n = codes.groupBy(*SEGMENT).agg(F.max("N").alias("_n"))
    bits = F.col("bits") + F.when(F.col("_n") > 1, F.col("id_bits")).otherwise(0)
    return gaggle_code(codes).join(n, list(SEGMENT)).groupBy(*SEGMENT).agg(F.sum(bits).alias(name))


def segment_table(image: DataFrame, *, segment_size: int = 64, kind: str = "int") -> DataFrame:
    """One row for each segment of images of any sides, each padded by itself: header, depths, bits of each part of the code, and `planes`,
    sorted arrays (family, generation, plane, significant, refinement) with generations 0 parent, 1 child, 2 grandchild.

    known_bits leaves out the symbols that say which coefficients become significant.
    """
    with Scratch(image.sparkSession, "wavelet") as work:
        # five parts of the table read the blocks
        blocks = work.keep(decompose(pad_edge(image), segment_size=segment_size, kind=kind), "blocks")
        return written(_segments(image, blocks, kind), scratch_path(image.sparkSession, "segments"))


def _segments(image: DataFrame, blocks: DataFrame, kind: str) -> DataFrame:
    depths = segment_bit_depths(blocks)
    quantized = quantize_dc(depths)
    generation = F.when(F.col("generation") == "parent", 0).when(F.col("generation") == "child", 1).otherwise(2)
    stats = bitplane_stats(blocks, kind=kind).groupBy(*SEGMENT).agg(
        F.sum("significant").alias("significant"), F.sum("refinement").alias("refinement"), F.sum("sign").alias("sign"),
        F.sort_array(F.collect_list(F.array(*(c.cast("long") for c in (F.col("family"), generation, F.col("plane"), F.col("significant"), F.col("refinement")))))).alias("planes"),
    )
    out = segment_headers(depths, pad_rows=image.groupBy("image_id").agg(F.pmod(-1 - F.max("y"), F.lit(8)).cast("int").alias("pad_rows")))
    for part in (quantized.groupBy(*SEGMENT).agg(F.max("q").alias("q")), dc_refinement_bits(quantized, kind=kind).withColumnRenamed("planes", "up_front_planes"), _gaggle_bits(dc_dpcm(quantized), "dc_bits"), _gaggle_bits(ac_dpcm(depths), "ac_depth_bits")):
        out = out.join(part, list(SEGMENT))
    out = out.join(stats, list(SEGMENT), "left")  # a segment without AC bits has no planes
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.select(*out.columns[:-4], *map(count, ("significant", "refinement", "sign")), F.coalesce("planes", F.array().cast("array<array<bigint>>")).alias("planes"))
    known = ("header_bits", "dc_bits", "up_front_bits", "ac_depth_bits", "in_plane_bits", "refinement", "sign")
    return out.withColumn("known_bits", sum((F.col(c) for c in known), F.lit(0).cast("long")))
