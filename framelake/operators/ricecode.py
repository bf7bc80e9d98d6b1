"""Predictive lossless coding of sample series: residuals, block options, layout and bits.

Samples are (series_id, i, x), x unsigned in n bits. A block is J samples, a segment r blocks. Everything of a segment lies in
one partition after the first shuffle on (series, segment): later groups and windows need no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.shipping import ship

SEGMENT = ("series_id", "seg")
BLOCK = (*SEGMENT, "blk")


def blockize(samples: DataFrame, *, J: int, r: int, drop_partial: bool = True) -> DataFrame:
    """seg, blk and j of each sample; the incomplete last segment of a series goes."""
    out = samples.withColumns({"seg": F.expr(f"i div {J * r}"), "blk": F.expr(f"(i div {J}) % {r}"), "j": F.expr(f"i % {J}")})
    if not drop_partial:
        return out
    ends = samples.groupBy("series_id").agg(F.expr(f"(max(i) + 1) div {J * r}").alias("n_seg"))
    return out.join(ends, "series_id").where("seg < n_seg").drop("n_seg")


def delta_predict(blocks: DataFrame) -> DataFrame:
    """pred: the sample before within the segment, or 0; d: the difference."""
    w = Window.partitionBy(*SEGMENT).orderBy("i")
    return blocks.withColumn("pred", F.coalesce(F.lag("x").over(w), F.lit(0).cast("long"))).withColumn("d", F.col("x") - F.col("pred"))


def mapped(d: Column, pred: Column, n_bits: int) -> Column:
    """The difference as a non-negative number: small ones of both signs alternate, larger ones follow."""
    theta = F.least(pred, F.lit((1 << n_bits) - 1).cast("long") - pred)
    return F.when((d >= 0) & (d <= theta), 2 * d).when((d < 0) & (-d <= theta), -2 * d - 1).otherwise(theta + F.abs(d))


def map_residual(residuals: DataFrame, *, n_bits: int) -> DataFrame:
    return residuals.withColumn("v", mapped(F.col("d"), F.col("pred"), n_bits))


def zero_runs(values: DataFrame) -> DataFrame:
    """For each block: is_zero, and for zero blocks their place in the run of zero blocks, from 0, within the segment."""
    flags = values.groupBy(*BLOCK).agg((F.max("v") == 0).alias("is_zero"))
    w = Window.partitionBy(*SEGMENT).orderBy("blk")
    marked = flags.withColumn("island", F.col("blk") - F.sum(F.col("is_zero").cast("int")).over(w))
    run = F.row_number().over(Window.partitionBy(*SEGMENT, "is_zero", "island").orderBy("blk")) - 1
    return marked.withColumn("run_index", F.when(F.col("is_zero"), run)).drop("island")


def splits(n_bits: int) -> range:
    """The k of sample splitting; 0 is the fundamental sequence."""
    return range(0, 1 if n_bits == 1 else max(0, n_bits - 2))


def option_sizes(values: DataFrame, *, J: int, n_bits: int) -> DataFrame:
    """A row for each block: bits of nc, se and k0, k1 ...; null where an option needs more than 32 J bits."""
    even = values.groupBy(*BLOCK, F.expr("j div 2").alias("pair")).agg(
        F.sum(F.when(F.col("j") % 2 == 0, F.col("v")).otherwise(0)).alias("a"), F.sum(F.when(F.col("j") % 2 == 1, F.col("v")).otherwise(0)).alias("b"), *(F.sum(F.shiftright("v", k) + k + 1).alias(f"k{k}") for k in splits(n_bits))
    )
    gamma = F.expr("(a + b) * (a + b + 1) div 2 + b + 1")
    sizes = even.groupBy(*BLOCK).agg(F.sum(gamma).alias("se"), *(F.sum(f"k{k}").alias(f"k{k}") for k in splits(n_bits)))
    fit = lambda c: F.when(F.col(c) <= 32 * J, F.col(c)).alias(c)
    return sizes.select(*BLOCK, F.lit(n_bits * J).cast("long").alias("nc"), *([fit("se")] if n_bits > 1 else [F.lit(None).cast("long").alias("se")]), *(fit(f"k{k}") for k in splits(n_bits)))


def select_option(sizes: DataFrame, runs: DataFrame, *, n_bits: int) -> DataFrame:
    """option and body bits of each block; of equal sizes se before nc before the least k; zero blocks take zb."""
    entry = lambda bits, rank, name: F.when(bits.isNotNull(), F.struct(bits.alias("bits"), F.lit(rank).alias("rank"), F.lit(name).alias("option")))
    best = F.array_min(F.filter(F.array(entry(F.col("se"), 0, "se"), entry(F.col("nc"), 1, "nc"), *(entry(F.col(f"k{k}"), 2 + k, f"k{k}") for k in splits(n_bits))), lambda e: e.isNotNull()))
    chosen = sizes.join(runs, list(BLOCK)).withColumn("best", best)
    return chosen.select(*BLOCK, F.when(F.col("is_zero"), "zb").otherwise(F.col("best.option")).alias("option"), F.when(F.col("is_zero"), F.col("run_index") + 1).otherwise(F.col("best.bits")).cast("long").alias("body_bits"), "run_index")


def id_width(n_bits: int) -> int:
    return 1 if n_bits < 3 else 2 if n_bits < 5 else 3 if n_bits <= 8 else 4 if n_bits <= 16 else 5


def coded_layout(options: DataFrame, *, J: int, n_bits: int, segments_per_bucket: int = 4096) -> DataFrame:
    """id_bits, id_value, bits and the bit offset of each block in its series' stream; offsets add up in three levels.

    An se block is chosen by its size as a fundamental sequence, but written as J / 2 words of 32 bits.
    """
    width, k = id_width(n_bits), F.regexp_extract("option", r"^k(\d+)$", 1)
    is_k = F.col("option").startswith("k")
    value = F.when(F.col("option") == "nc", (1 << width) - 1).when(is_k, k.try_cast("int") + 1).when(F.col("option") == "se", 1).otherwise(0)
    coded = options.withColumns({"id_bits": (F.lit(width) + F.col("option").isin("zb", "se").cast("int")).cast("long"), "id_value": value.cast("long")}).withColumn("bits", F.col("id_bits") + F.when(F.col("option") == "se", 16 * J).otherwise(F.col("body_bits")))
    inside = Window.partitionBy(*SEGMENT).orderBy("blk")
    coded = coded.withColumn("in_segment", F.sum("bits").over(inside) - F.col("bits"))
    totals = coded.groupBy(*SEGMENT).agg(F.sum("bits").alias("seg_bits")).withColumn("bucket", F.expr(f"seg div {segments_per_bucket}"))
    buckets = totals.groupBy("series_id", "bucket").agg(F.sum("seg_bits").alias("bucket_bits"))
    buckets = buckets.withColumn("bucket_at", F.sum("bucket_bits").over(Window.partitionBy("series_id").orderBy("bucket")) - F.col("bucket_bits"))
    starts = totals.withColumn("seg_at", F.sum("seg_bits").over(Window.partitionBy("series_id", "bucket").orderBy("seg")) - F.col("seg_bits")).join(buckets, ["series_id", "bucket"])
    starts = starts.select(*SEGMENT, (F.col("seg_at") + F.col("bucket_at")).alias("segment_offset"))
    return coded.join(starts, list(SEGMENT)).withColumn("bit_offset", F.col("segment_offset") + F.col("in_segment")).drop("in_segment", "segment_offset")


def _binary(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value), width, "0") if width else F.lit("")


def encode_blocks(values: DataFrame, layout: DataFrame, *, J: int, n_bits: int) -> DataFrame:
    """The bits of each block as a string of 0 and 1: identifier, then body."""
    samples = values.groupBy(*BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("vs"))
    unary = lambda v: F.concat(F.repeat(F.lit("0"), v.cast("int")), F.lit("1"))
    joined = lambda f: F.array_join(F.transform("vs", f), "")
    body = F.when(F.col("option") == "zb", unary(F.col("run_index"))).when(F.col("option") == "nc", joined(lambda v: _binary(v, n_bits)))
    pair = lambda p: (F.element_at(F.col("vs"), 2 * p + 1), F.element_at(F.col("vs"), 2 * p + 2))
    gamma = lambda a, b: F.floor((a + b) * (a + b + 1) / 2).cast("long") + b
    body = body.when(F.col("option") == "se", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(J // 2 - 1)), lambda p: _binary(gamma(*pair(p)), 32)), ""))

    def split(k: int) -> Column:
        high = joined(lambda v: unary(F.shiftright(v, k)))
        return F.concat(high, joined(lambda v: _binary(v.bitwiseAND((1 << k) - 1), k))) if k else high

    for k in splits(n_bits):
        body = body.when(F.col("option") == f"k{k}", split(k))
    head = F.when(F.col("id_bits") > 0, F.expr("lpad(bin(id_value), cast(id_bits as int), '0')"))
    return samples.join(layout, list(BLOCK)).select(*BLOCK, "option", "bit_offset", F.concat(head, body).alias("code"))


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width) -> None:
    """Writes numbers of some width, the highest bit first, from the places `at` on."""
    for t in range(int(np.max(width, initial=0))):
        some = t < width if isinstance(width, np.ndarray) else slice(None)
        own = width[some] if isinstance(width, np.ndarray) else width
        bits[at[some] + t] = values[some] >> (own - 1 - t) & 1


def _packed(J: int, n_bits: int):
    def pack(table: pa.Table) -> pa.Table:
        """The segments of a group as bytes: numpy writes all blocks of an option at once."""
        columns = {c: table[c].to_numpy() for c in ("series_id", "seg", "blk", "j", "v", "bits", "id_bits", "id_value", "run_index")}
        order = np.lexsort((columns["j"], columns["blk"], columns["seg"], columns["series_id"]))
        v = columns.pop("v")[order].astype(np.int64).reshape(-1, J)
        block = {c: x[order][::J] for c, x in columns.items()}
        option = np.array(table["option"].to_pylist(), object)[order][::J]
        size = block["bits"].astype(np.int64)
        new = np.concatenate([[True], (block["seg"][1:] != block["seg"][:-1]) | (block["series_id"][1:] != block["series_id"][:-1])])
        first = np.flatnonzero(new)
        n = np.add.reduceat(size, first)
        n_bytes = -(-n // 8)
        begin = np.cumsum(size) - size  # of a block, without the filling between segments
        segment = np.cumsum(new) - 1
        begin = begin - begin[first][segment] + ((np.cumsum(n_bytes) - n_bytes) * 8)[segment]
        bits = np.zeros(int(n_bytes.sum()) * 8, np.uint8)
        id_bits = block["id_bits"].astype(np.int64)
        _put(bits, begin, block["id_value"].astype(np.int64), id_bits)
        body = begin + id_bits
        zero = option == "zb"
        bits[(body + np.nan_to_num(block["run_index"].astype(float)).astype(np.int64))[zero]] = 1
        flat = lambda x: x.ravel()
        some = option == "nc"
        _put(bits, flat(body[some][:, None] + n_bits * np.arange(J)), flat(v[some]), n_bits)
        some = option == "se"
        a, b = v[some][:, ::2], v[some][:, 1::2]
        _put(bits, flat(body[some][:, None] + 32 * np.arange(J // 2)), flat((a + b) * (a + b + 1) // 2 + b), 32)
        for k in splits(n_bits):
            some = option == f"k{k}"
            ends = np.cumsum((v[some] >> k) + 1, axis=1)
            bits[flat(body[some][:, None] + ends - 1)] = 1
            if k:
                _put(bits, flat((body[some] + ends[:, -1])[:, None] + k * np.arange(J)), flat(v[some] & ((1 << k) - 1)), k)
        data, cuts = np.packbits(bits), np.concatenate([[0], np.cumsum(n_bytes)])
        payload = [data[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"series_id": pa.array(block["series_id"][first]), "seg": pa.array(block["seg"][first]), "n_bits": pa.array(n), "payload": pa.array(payload, pa.binary())})

    return pack


def pack_segments(values: DataFrame, layout: DataFrame, *, J: int, n_bits: int, segments_per_group: int = 256) -> DataFrame:
    """The code of each segment as bytes, filled up with zeros: (series_id, seg, n_bits, payload).

    Some segments of a series at a time are one Arrow group; set segments_per_group so that it holds about a million samples.
    """
    ship(values.sparkSession)
    rows = values.select(*BLOCK, "j", "v").join(layout.select(*BLOCK, "option", "bits", "id_bits", "id_value", "run_index"), list(BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    grouped = rows.groupBy("series_id", F.expr(f"seg div {segments_per_group}").alias("_group"))
    return grouped.applyInArrow(_packed(J, n_bits), f"series_id {kinds['series_id']}, seg {kinds['seg']}, n_bits long, payload binary")


def coding_report(layout: DataFrame, *, n_bits: int, J: int) -> DataFrame:
    """Blocks, bits and the bits without coding, for each series, segment and option."""
    return layout.groupBy(*SEGMENT, "option").agg(F.count("*").alias("n_blocks"), F.sum("bits").alias("bits")).withColumn("raw_bits", F.col("n_blocks") * (n_bits * J))


def code_series(samples: DataFrame, *, J: int, r: int, n_bits: int, preprocess: bool = True) -> tuple[DataFrame, DataFrame]:
    """(values, layout) of the whole chain."""
    blocks = blockize(samples, J=J, r=r)
    values = map_residual(delta_predict(blocks), n_bits=n_bits) if preprocess else blocks.withColumn("v", F.col("x"))
    options = select_option(option_sizes(values, J=J, n_bits=n_bits), zero_runs(values), n_bits=n_bits)
    return values, coded_layout(options, J=J, n_bits=n_bits)
