"""Queries of sources, sinks and streams."""

from pyspark.sql import functions as F

from framelake.functions.scratch import Scratch, scratch_path, written
from framelake.operators import calib, radar
from framelake.plans import imaging, signals  # noqa: F401  registers the batch query
from framelake.plans.catalog import ORACLES, query
from framelake.plans.fixtures import frames, maps, samples, scenes, with_
from framelake.sources import raw
from framelake.streaming.calibration import calibrate_stream


@query("s1_decode_frames", with_("frames") + "select frame_id, y, x, v::bigint v from frames")
def s1(spark, sf_dir):
    """Frames to raw 16-bit images and back (S6, S1)."""
    files = raw.frames_to_binary(frames(spark, sf_dir)).withColumn("file", F.col("frame_id").cast("string"))
    return raw.decode_frames(files, width=64, height=32, dtype="u16").where("error is null").select("frame_id", "y", "x", "v")


@query("s1_read_raw_frames", with_("frames") + "select frame_id, y, x, v::bigint v from frames")
def s1_files(spark, sf_dir):
    """Frames as raw 16-bit files, written in parts of 8 lines (S6) and read back in ranges of 2 KB."""
    with Scratch(spark, "frame-files") as work:
        path = work.path("files")
        raw.write_raw_frames(frames(spark, sf_dir), path, width=64, height=32, name="image_frame{}.bin", part_bytes=1_024)
        return written(raw.read_raw_frames(spark, path, width=64, height=32, range_bytes=2_048).where("error is null").select("frame_id", "y", "x", "v"), scratch_path(spark, "result"))


@query("s2_read_raw_lines", f"with {signals._P} select cast(scene_id as int) scene_id, cast(patch as int) patch, cast(i as int) as az, cast(k as int) k, cast(re as bigint) re, cast(im as bigint) im from a")
def s2(spark, sf_dir):
    """The patches of all scenes as raw files of interleaved floats, read back; whole numbers."""
    with Scratch(spark, "line-files") as work:
        path = work.path("files")
        patches = radar.assign_patches(signals._integers(spark, sf_dir), scenes(spark, sf_dir))
        files = raw.lines_to_binary(patches.withColumn("file", F.format_string("scene%d_patch%d.bin", "scene_id", "patch")), group="file")
        raw.write_binary_files(files.select(F.col("file").alias("name"), "content"), path)
        lines = raw.read_raw_lines(spark, path, width=32, height=128)
        cells = lines.select("scene_id", "patch", "az", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
        return written(cells.select("scene_id", "patch", "az", "k", F.col("z.re").cast("long").alias("re"), F.col("z.im").cast("long").alias("im")), scratch_path(spark, "result"))


@query("s3_read_sample_series", with_("samples") + "select series_id, i, x from samples")
def s3_files(spark, sf_dir):
    """Samples as a raw 16-bit file for each series, read back."""
    with Scratch(spark, "sample-files") as work:
        path = work.path("files")
        raw.write_binary_files(raw.series_to_binary(samples(spark, sf_dir), bit_size=16).select(F.format_string("%d.bin", "series_id").alias("name"), "content"), path)
        return written(raw.read_sample_series(spark, path, bit_size=16).withColumn("series_id", F.regexp_extract("series_id", r"^(\d+)", 1).cast("long")), scratch_path(spark, "result"))


@query("s6_frames_to_binary", with_("frames") + "select frame_id, string_agg(printf('%02X%02X', v & 255, v >> 8), '' order by y, x) as content from frames group by all")
def s6(spark, sf_dir):
    return raw.frames_to_binary(frames(spark, sf_dir)).withColumn("content", F.hex("content"))


@query("s6_write_frames", with_("frames") + "select frame_id, count(*) n, sum(v)::bigint total from frames group by all")
def s6_written(spark, sf_dir):
    with Scratch(spark, "frames") as work:
        path = work.path("files")
        raw.write_frames(frames(spark, sf_dir), path)
        return written(spark.read.parquet(path).groupBy(F.col("frame_id").cast("int").alias("frame_id")).agg(F.count("*").alias("n"), F.sum("v").alias("total")), scratch_path(spark, "result"))


@query("s3_sample_totals", with_("samples") + "select series_id, count(*) n, sum(x)::bigint total, max(x)::bigint most from samples group by all")
def s3(spark, sf_dir):
    """Totals of the samples read from files."""
    return s3_files(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").alias("most"))


#: Files of a part of the frames that a trigger of the stream takes, and the number of such parts beyond 4 frames each.
_PART_FILES, _PARTS = 8, 16


@query("st1_calibrate_stream", ORACLES.get("i7_calibrate"))
def st1(spark, sf_dir):
    """Frames as a stream of files that come in parts, in the order of time; what leaves it is binned and summed as in the batch query.

    A trigger costs the same however little it takes, so the parts grow with the frames. A part's files come in any order, so as many frames as two parts have may wait.
    """
    with Scratch(spark, "stream") as work:
        source, sink, state = (work.path(n) for n in ("in", "out", "state"))
        whole, m = frames(spark, sf_dir), work.keep(maps(spark, sf_dir), "maps")
        last = whole.agg(F.max("frame_id")).first()[0]
        part = max(4, -(-((last or 0) + 1) // _PARTS))
        for begin in range(0, (last or 0) + 1, part):
            whole.where(F.col("frame_id").between(begin, begin + part - 1)).repartition(_PART_FILES, "frame_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema("frame_id int, y int, x int, v int").option("maxFilesPerTrigger", _PART_FILES).parquet(source)
        tile, n = 16, spark.conf.get("spark.sql.shuffle.partitions")
        tiles = m.select(F.expr(f"y div {tile}"), F.expr(f"x div {tile}")).distinct().count()
        done = calibrate_stream(stream, m, tile=tile, max_ahead=max(64, 2 * part))
        try:  # partitions of the state: a tile is a key, so more of them would stay empty
            spark.conf.set("spark.sql.shuffle.partitions", max(1, min(int(n), tiles)))
            job = done.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", n)
        job.awaitTermination()
        pixels = spark.read.schema("frame_id int, y int, x int, v int").parquet(sink)
        return written(calib.coadd(calib.bin_spatial(pixels)), scratch_path(spark, "result"))
