"""Hand cases and invariants of the calibration operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import calib


def frame_table(spark, stack):
    rows = [(t, y, x, int(v)) for t, frame in enumerate(stack) for y, line in enumerate(frame) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame_id int, y int, x int, v int")


def array(df, n_frames=None):
    rows = df.collect()
    shape = [max(r[c] for r in rows) + 1 for c in ("y", "x")]
    if "frame_id" not in df.columns:
        out = np.full(shape, -1, np.int64)
        for r in rows:
            out[r.y, r.x] = r.v
        return out
    out = np.full([max(r.frame_id for r in rows) + 1, *shape], -1, np.int64)
    for r in rows:
        out[r.frame_id, r.y, r.x] = r.v
    return out


def map_table(spark, **grids):
    h, w = next(iter(grids.values())).shape
    return spark.createDataFrame([(y, x, *(int(g[y, x]) for g in grids.values())) for y in range(h) for x in range(w)], "y int, x int, " + ", ".join(f"{c} int" for c in grids))


def direct(stack, off, gain, bad, first=4):
    """The chain as loops over numpy arrays."""
    v = stack.astype(np.int64)
    for t in range(first, len(v)):
        v[t] = (v[t] - off) % 65536
        src = v[t].copy()
        for y, x in zip(*np.nonzero(bad == 1)):
            ys, xs = slice(max(0, y - 1), y + 2), slice(max(0, x - 1), x + 2)
            good = src[ys, xs][bad[ys, xs] == 0]
            v[t, y, x] = good.sum() // len(good) if len(good) else 0
    total = np.zeros((v.shape[1] // 2, v.shape[2] // 2), np.int64)
    for t in range(2, len(v) - 2):
        mean = (v[t - 2] + v[t - 1] + v[t + 1] + v[t + 2]) // 4
        v[t] = np.where(v[t] > 2 * mean, mean, v[t]) * gain >> 16 & 65535
        cut = v[t][: 2 * total.shape[0], : 2 * total.shape[1]]
        total += cut.reshape(total.shape[0], 2, total.shape[1], 2).sum(axis=(1, 3))
    return total


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(7)
    stack = rng.integers(0, 3000, (9, 7, 10))
    stack[rng.random(stack.shape) < 0.05] = 65535
    bad = (rng.random((7, 10)) < 0.15).astype(int)
    bad[:3, :3], bad[6, 9] = 1, 2
    return stack, rng.integers(0, 128, (7, 10)), rng.integers(30000, 65535, (7, 10)), bad


@pytest.mark.parametrize("first", [0, 4])
def test_calibrate_equals_loops(spark, scene, first):
    stack, off, gain, bad = scene
    m = map_table(spark, off=off, gain=gain, bad=bad)
    found = calib.calibrate(frame_table(spark, stack), m, m, m, first_prepared=first)
    assert np.array_equal(array(found), direct(stack, off, gain, bad, first))


def test_wraps(spark):
    m = map_table(spark, off=np.array([[5, 0]]), gain=np.array([[65535, 1]]))
    f = frame_table(spark, [[[3, 65535]]])
    assert array(calib.offset_correct(f, m))[0].tolist() == [[65534, 65535]]
    assert array(calib.gain_correct(f, m))[0].tolist() == [[2, 0]]


def test_window_and_recursive_agree_without_hits(spark):
    stack = np.full((7, 2, 2), 100)
    f = frame_table(spark, stack)
    assert np.array_equal(array(calib.scrub_temporal(f))[2:5], array(calib.scrub_temporal(f, mode="recursive"))[2:5])


def test_incomplete_bins_go_and_edges_are_padded(spark):
    image = np.arange(15).reshape(3, 5)
    f = frame_table(spark, [image])
    assert array(calib.bin_spatial(f))[0].tolist() == [[0 + 1 + 5 + 6, 2 + 3 + 7 + 8]]
    padded = array(calib.pad_edge(f.withColumnRenamed("frame_id", "image_id"), multiple=4).drop("image_id"))
    assert np.array_equal(padded, np.pad(image, ((0, 1), (0, 3)), mode="edge"))


def test_roles_means_and_stretch(spark):
    f = frame_table(spark, np.ones((6, 1, 1)))
    assert [r.role for r in calib.frame_roles(f).orderBy("frame_id").collect()] == ["prior", "prior", "data", "data", "later", "later"]
    assert calib.channel_mean(spark.createDataFrame([(0, 0, 0, 1), (0, 0, 0, 2)], "frame_id int, y int, x int, v int")).first().v == 1
    v = spark.createDataFrame([(10,), (4294967295,), (0,)], "v long")
    assert [r.v for r in calib.sqrt_stretch(v, brightness=2).collect()] == [6, 65535, 0]


def scrub_loop(rows, gains):
    """rows: (name, t, v) to (name, t, result): one series after the other."""
    out = []
    for name in {r[0] for r in rows}:
        series = sorted((t, v) for n, t, v in rows if n == name)
        values = [v for _, v in series]
        for i in range(2, len(series) - 2):
            mean = sum(values[i + k] for k in (-2, -1, 1, 2)) // 4
            v = mean if values[i] > 2 * mean else values[i]
            values[i] = v if gains is None else v * gains[name] >> 16 & 65535
            out.append((name, series[i][0], values[i]))
    return sorted(out)


@pytest.mark.parametrize("n_series,per_series,times,gain", [(200, 6, 5_000, True), (3, 400, 400, True), (40, 30, 60, False), (1, 4, 9, True), (500, 3, 10_000, False)])
def test_series_with_times_of_their_own(spark, n_series, per_series, times, gain):
    """Sparse ones, dense ones, too short ones, and one far longer than the others, equal to a loop."""
    rng = np.random.default_rng(n_series)
    rows = [(s, int(t), int(rng.integers(0, 4000) if rng.random() < 0.8 else 65535)) for s in range(n_series) for t in rng.choice(times, min(times, per_series * (20 if s == 7 else 1)), replace=False)]
    gains = {s: int(rng.integers(30000, 65535)) for s in range(n_series)}
    df = spark.createDataFrame([(n, t, v, gains[n]) for n, t, v in rows], "name int, t long, v int, gain int").repartition(3)
    found = calib.scrub_temporal(df, partition=["name"], order="t", mode="recursive", gain="gain" if gain else None)
    assert sorted((r.name, r.t, r.v) for r in found.collect()) == scrub_loop(rows, gains if gain else None)


@pytest.mark.parametrize("vectorised", [1, 3, 10_000])
def test_batches_of_any_cut_give_the_same(vectorised):
    """Rows of many moments in one batch or in many; series one by one or together."""
    rng = np.random.default_rng(vectorised)
    rows = sorted((int(t), s, int(rng.integers(0, 5000))) for s in range(30) for t in rng.choice(300, rng.integers(1, 60), replace=False))
    t, name, v = (np.array(x) for x in zip(*rows, strict=True))
    scrub, found = calib.SeriesScrub(vectorised), []
    cuts = np.unique(np.concatenate([[0, len(rows)], rng.integers(0, len(rows), 12)]))
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        done, times, out = scrub.add(name[b:e], t[b:e], v[b:e], None)
        found += zip(name[b:e][done].tolist(), times.tolist(), out.tolist(), strict=True)
    assert sorted(found) == scrub_loop([(n, t, v) for t, n, v in rows], None)


def test_sparse_series_take_time_in_proportion():
    """10,000 and 40,000 series with six values each at times of their own: what is done for a row does not grow with the series."""

    def seconds(n):
        rng = np.random.default_rng(1)
        t = rng.permutation(6 * n)
        name, v = np.repeat(np.arange(n), 6)[np.argsort(t)], rng.integers(0, 4000, 6 * n)
        scrub, began = calib.SeriesScrub(), time.process_time()
        n_out = sum(len(scrub.add(name[b : b + 10_000], np.arange(b, min(b + 10_000, 6 * n)), v[b : b + 10_000], None)[0]) for b in range(0, 6 * n, 10_000))
        assert n_out == 2 * n
        return time.process_time() - began

    seconds(2_000)
    few = min(seconds(10_000) for _ in range(3))
    assert min(seconds(40_000) for _ in range(3)) < 4 * 2 * few + 0.05


@pytest.mark.parametrize("tile", [2, 4, 64])
def test_missing_pixels(spark, scene, tile):
    """Batch equals composition where frames lack pixels, bins, or all but a few; a bin has no part of frames that lack one of its pixels."""
    stack, off, gain, bad = scene
    rng = np.random.default_rng(tile)
    stack = np.concatenate([stack, stack[::-1], stack])
    held = rng.random(stack.shape) > 0.1
    held[3, :2, :4] = held[5:9, 4, 5] = held[11:, 2, 2] = False
    held[14] = rng.random(stack[14].shape) < 0.1
    rows = [(t, y, x, int(stack[t, y, x])) for t, y, x in zip(*(i.tolist() for i in np.nonzero(held)), strict=True)]
    frames = spark.createDataFrame(rows, "frame_id int, y int, x int, v int")
    m = map_table(spark, off=off, gain=gain, bad=bad)
    ready = calib.replace_masked(calib.offset_correct(frames, m), m).where("frame_id >= 4").unionByName(frames.where("frame_id < 4"))
    scrubbed = calib.scrub_temporal(ready.join(m.select("y", "x", "gain"), ["y", "x"]), mode="recursive", gain="gain")
    want = {(r.y, r.x): r.v for r in calib.coadd(calib.bin_spatial(scrubbed)).collect()}
    found = {(r.y, r.x): r.v for r in calib.calibrate(frames, m, m, m, tile=tile).collect()}
    assert found == want and len(want) > 10


def test_a_campaign_in_buckets_is_not_shuffled_again(spark, scene, tmp_path):
    """A table by tile, with frames added later; equal to the calibration of all frames, and no exchange in the plan."""
    stack, off, gain, bad = scene
    m, frames = map_table(spark, off=off, gain=gain, bad=bad), frame_table(spark, stack)
    try:
        for mode, part in (("errorifexists", "frame_id < 5"), ("append", "frame_id >= 5")):
            calib.write_tiles(calib.tiles(frames.where(part), m, m, m, tile=4), "campaign", n_buckets=3, path=f"{tmp_path}/tiles", mode=mode)
        found = calib.calibrate_tiles(spark.table("campaign"), tile=4)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.y, r.x): r.v for r in found.collect()} == {(r.y, r.x): r.v for r in calib.calibrate(frames, m, m, m, tile=4).collect()}
    finally:
        spark.sql("DROP TABLE IF EXISTS campaign")


def test_calibration_shuffles_pixels_once(spark, scene):
    stack, off, gain, bad = scene
    m = map_table(spark, off=off, gain=gain, bad=bad)
    plan = calib.calibrate(frame_table(spark, stack), *(m.hint("broadcast") for _ in range(3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ty") == 1 and plan.index("Exchange hashpartitioning(ty") > plan.index("MapInArrow")
    with pytest.raises(ValueError):
        calib.calibrate(frame_table(spark, stack), m, m, m, tile=3)


def test_pixels_are_dealt_in_pieces(spark):
    """A row for each batch and moment of a tile, some bytes a pixel, and the maps once; large values stay whole."""
    stack = np.arange(40 * 256).reshape(40, 16, 16) + (np.arange(40) == 7)[:, None, None] * (1 << 30)
    m = map_table(spark, off=np.ones((16, 16)), gain=np.ones((16, 16)), bad=np.zeros((16, 16)))
    rows = calib.tiles(frame_table(spark, stack).coalesce(1), m, m, m, tile=64).selectExpr("t", "octet_length(at) + octet_length(v) as n").collect()
    pieces = [r.n for r in rows if r.n is not None]
    assert len(rows) < 300 and len(pieces) >= 40 and sum(pieces) < 1.5 * 8 * stack.size
    wide = frame_table(spark, stack % 9).withColumn("v", F.expr("v + 5000000000L"))
    assert {r.v for r in calib.calibrate(wide, m, m, m, first_prepared=99).collect()} == {4 * sum(5_000_000_000 + int(v) >> 16 & 65535 for v in stack[2:38, 0, 0] % 9)}


def test_frames_added_later_may_have_other_maps(spark, scene, tmp_path):
    """Also where a frame's pixels were written in two parts."""
    stack, off, gain, bad = scene
    one, two = map_table(spark, off=off, gain=gain, bad=bad), map_table(spark, off=off + 9, gain=gain, bad=bad)
    frames = frame_table(spark, stack)
    late = "frame_id > 5 or frame_id = 5 and y >= 3"
    rows = calib.tiles(frames.where(f"not ({late})"), one, one, one, tile=4).unionAll(calib.tiles(frames.where(late), two, two, two, tile=4))
    shifted = frames.withColumn("v", F.when(F.expr(late), F.pmod(F.col("v") - 9, F.lit(65536))).otherwise(F.col("v")).cast("int"))
    want = {(r.y, r.x): r.v for r in calib.calibrate(shifted, one, one, one, tile=4, first_prepared=0).collect()}
    assert {(r.y, r.x): r.v for r in calib.calibrate_tiles(rows, tile=4, first_prepared=0).collect()} == want
