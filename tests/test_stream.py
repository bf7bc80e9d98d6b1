"""The stream equals the batch, with duplicates and late frames dropped."""

import time

import numpy as np
import pytest

from framelake.operators import calib
from framelake.streaming.calibration import calibrate_stream
from tests.test_calibration import array, frame_table, map_table


def scene(spark, n, seed, missing=0.0):
    rng = np.random.default_rng(seed)
    stack = rng.integers(0, 4000, (n, 6, 9))
    stack[rng.random(stack.shape) < 0.1] = 65535
    maps = map_table(spark, off=rng.integers(0, 100, (6, 9)), gain=rng.integers(30000, 65535, (6, 9)), bad=(rng.random((6, 9)) < 0.2).astype(int))
    held = rng.random(stack.shape) >= missing
    frames = frame_table(spark, stack)
    gone = [(t, y, x) for t, y, x in zip(*(i.tolist() for i in np.nonzero(~held)), strict=True)]
    return maps, frames.join(spark.createDataFrame(gone, "frame_id int, y int, x int"), ["frame_id", "y", "x"], "left_anti") if gone else frames


def start(spark, tmp_path, maps, trigger, **options):
    stream = spark.readStream.schema("frame_id int, y int, x int, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return calibrate_stream(stream, maps, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(**trigger).start()


def put(frames, tmp_path, order):
    for k, t in enumerate(order):
        frames.where(f"frame_id = {t}").coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")


@pytest.mark.parametrize("missing", [0.0, 0.15])
def test_stream_equals_batch(spark, tmp_path, missing):
    maps, frames = scene(spark, 9, 3, missing)
    for k, t in enumerate([0, 1, 2, 4, 3, 4, 5, 6, 2, 7, 8]):  # out of order, twice, and late
        part = frames.where(f"frame_id = {t}")
        if k in (5, 8):
            part = part.selectExpr("frame_id", "y", "x", "v + 1 as v")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")
    job = start(spark, tmp_path, maps, {"availableNow": True}, tile=4)
    job.awaitTermination()
    pixels = spark.read.parquet(f"{tmp_path}/out")
    assert missing or pixels.count() == 5 * 54
    assert np.array_equal(array(calib.coadd(calib.bin_spatial(pixels))), array(calib.calibrate(frames, maps, maps, maps)))


def test_a_lost_frame_is_given_up(spark, tmp_path):
    """The others go on as the batch does without it; it is dropped if it comes later."""
    maps, frames = scene(spark, 12, 4)
    put(frames, tmp_path, [0, 1, 2, 3, 4, 6, 7, 8, 9, 5, 10, 11])
    start(spark, tmp_path, maps, {"availableNow": True}, tile=8, max_ahead=3).awaitTermination()
    pixels = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.frame_id for r in pixels.select("frame_id").distinct().collect()) == [2, 3, 4, 6, 7, 8, 9]
    assert np.array_equal(array(calib.coadd(calib.bin_spatial(pixels))), array(calib.calibrate(frames.where("frame_id != 5"), maps, maps, maps)))


def test_a_frame_overdue_by_time_is_given_up(spark, tmp_path):
    """Though far fewer than max_ahead frames wait for it."""
    maps, frames = scene(spark, 9, 5)
    put(frames, tmp_path, [0, 1, 2, 4, 5, 6, 7, 8])
    job = start(spark, tmp_path, maps, {"processingTime": "200 milliseconds"}, tile=8, max_wait_ms=1_500)
    until, seen = time.time() + 60, 0
    while time.time() < until and seen < 4 * 54:
        time.sleep(0.5)
        seen = spark.read.schema("frame_id int, y int, x int, v int").parquet(f"{tmp_path}/out").count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
    job.stop()
    pixels = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.frame_id for r in pixels.select("frame_id").distinct().collect()) == [2, 4, 5, 6]
    assert np.array_equal(array(calib.coadd(calib.bin_spatial(pixels))), array(calib.calibrate(frames.where("frame_id != 3"), maps, maps, maps)))


def test_state_written_follows_the_frames_that_came(spark, tmp_path):
    """With ever more frames that wait, a trigger writes no more than the first did."""
    maps, frames = scene(spark, 20, 6)
    put(frames, tmp_path, range(2, 20))  # frame 0 never comes, so all wait
    job = start(spark, tmp_path, maps, {"availableNow": True}, tile=16)
    job.awaitTermination()
    written = [p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"] for p in job.recentProgress if p["numInputRows"]]
    assert len(written) >= 15 and max(written[2:]) < 1.5 * written[1]
    assert spark.read.schema("frame_id int, y int, x int, v int").parquet(f"{tmp_path}/out").count() == 0


def test_parts_grow_with_the_frames(spark, tmp_path, monkeypatch):
    """100 frames come in three triggers, not in 25, whatever the order of a part's files; equal to the batch query."""
    from pyspark.sql.streaming import StreamingQueryListener

    from framelake.plans import flows, imaging

    class Triggers(StreamingQueryListener):
        rows: list[int] = []

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            self.rows.append(event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    rng = np.random.default_rng(8)
    vectors = [(k, e) for k, e in enumerate((rng.random((3_200, 64)) * 2 - 1).tolist())]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(flows, "_PARTS", 3)
    listener, before = Triggers(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.streams.addListener(listener)
    try:
        found = {(r.y, r.x): r.v for r in flows.st1(spark, str(tmp_path)).collect()}
        assert found == {(r.y, r.x): r.v for r in imaging.i7(spark, str(tmp_path)).collect()}
        until = time.time() + 20
        while time.time() < until and sum(listener.rows) < 100 * 2_048:
            time.sleep(0.2)
        assert sum(listener.rows) == 100 * 2_048 and 3 <= sum(n > 0 for n in listener.rows) <= 4
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    finally:
        spark.streams.removeListener(listener)


def test_tiles_of_rim_alone_are_left_out(spark):
    rows = calib.with_rim(spark.createDataFrame([(y, x) for y in range(4) for x in range(6)], "y int, x int"), 4).select("ty", "tx", "y", "x").collect()
    assert {(r.ty, r.tx) for r in rows} == {(0, 0), (0, 1)} and len(rows) == 4 * 5 + 4 * 3
