"""Wavelets, encryption, radar, comparison and raw files."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import cipher, compare, radar
from framelake.operators import wavelet as wl
from framelake.sources import raw


def lift(a):
    a, n = [int(x) for x in a], len(a) // 2
    h = []
    for i in range(n):
        if i == n - 1:
            p = (9 * a[2 * n - 2] - a[2 * n - 4]) / 8
        else:
            p = (9 * (a[2 * i] + a[2 * i + 2]) - ((a[2] if i == 0 else a[2 * i - 2]) + (a[2 * n - 2] if i == n - 2 else a[2 * i + 4]))) / 16
        h.append(a[2 * i + 1] - int(np.floor(p + 0.5)))
    low = [a[0] - int(np.floor(-h[0] / 2 + 0.5))] + [a[2 * i] - int(np.floor(-(h[i - 1] + h[i]) / 4 + 0.5)) for i in range(1, n)]
    return low + h


def image_table(spark, image, kind="int"):
    return spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(image)], "image_id int, y int, x int, v long")


def grid(df, h, w):
    out = np.zeros((h, w))
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def test_lifting_equals_loops(spark):
    image = np.random.default_rng(1).integers(-500, 500, (16, 24))
    want = np.array([lift(r) for r in image])
    want = np.array([lift(c) for c in want.T]).T
    assert np.array_equal(grid(wl.dwt2d(image_table(spark, image), height=16, width=24), 16, 24), want)


def test_float_filters_mirror_the_ends(spark):
    a = np.random.default_rng(2).normal(size=16)
    wide = lambda k: a[abs(k) if k < 0 else 30 - k if k > 15 else k]
    low = [sum(t * (wide(2 * i + k) + wide(2 * i - k)) / (2 if k == 0 else 1) for k, t in enumerate(wl.LOW_TAPS)) for i in range(8)]
    high = [sum(t * (wide(2 * i + 1 + k) + wide(2 * i + 1 - k)) / (2 if k == 0 else 1) for k, t in enumerate(wl.HIGH_TAPS)) for i in range(8)]
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(a)], "y int, x int, v double")
    found = [r.v for r in wl.dwt1d_float(df, partition=["y"], order="x", length=16).orderBy("x").collect()]
    assert np.allclose(found, low + high)


def by_lines(df, height, width, kind, levels):
    """The decomposition by the line filters alone, in windows over rows and columns."""
    step, low, done = wl.dwt1d_int if kind == "int" else wl.dwt1d_float, df, []
    for _ in range(levels):
        out = step(step(low, partition=["image_id", "y"], order="x", length=width), partition=["image_id", "x"], order="y", length=height)
        height, width = height // 2, width // 2
        done.append(out.where(f"not (y < {height} and x < {width})"))
        low = out.where(f"y < {height} and x < {width}")
    for part in done:
        low = low.unionByName(part)
    return low


@pytest.mark.parametrize("kind", ["int", "float"])
@pytest.mark.parametrize("height,width,levels,tile", [(64, 48, 3, 16), (48, 96, 3, 512), (56, 136, 3, 64), (24, 40, 1, 8), (32, 64, 2, 12)])
def test_levels_in_tiles_equal_the_line_filters(spark, kind, height, width, levels, tile):
    """Bit for bit, whatever the tiles; the last ones are narrow."""
    rng = np.random.default_rng(height + tile)
    image = rng.integers(-30_000, 30_000, (height, width))
    df = image_table(spark, image).withColumn("v", F.col("v").cast("long" if kind == "int" else "double"))
    found = wl.dwt2d_multilevel(df, height=height, width=width, levels=levels, kind=kind, tile=tile)
    assert np.array_equal(grid(found, height, width), grid(by_lines(df, height, width, kind, levels), height, width)) and found.count() == height * width


def test_a_decomposition_shuffles_pixels_once(spark):
    df = image_table(spark, np.zeros((16, 16)))
    plan = wl.dwt2d_multilevel(df, height=16, width=16, levels=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        wl.dwt2d_multilevel(df, height=16, width=16, tile=12)


def test_regrouping_is_a_permutation(spark):
    image = np.arange(32 * 16).reshape(32, 16)
    out = wl.regroup_blocks(image_table(spark, image), height=32, width=16).collect()
    assert len({(r.y, r.x) for r in out}) == 512 and {r.v for r in out} == set(range(512))
    at = {r.v: (r.y, r.x) for r in out}
    assert at[0] == (0, 0) and at[16 * 1 + 1] == (8, 8) and at[8] == (0, 4) and at[16 * 16] == (4, 0) and at[2] == (0, 1)


def test_depths_of_a_block_without_ac(spark):
    rows = [(0, 0, 0, p, -3 if p == 0 else 0) for p in range(64)]
    blocks = spark.createDataFrame(rows, "image_id int, seg int, blk int, pos int, c long")
    d = wl.segment_bit_depths(blocks).first()
    assert (d.dc, d.ac_bits, d.depth_ac, d.depth_dc) == (-3, 0, 0, 2)
    assert wl.segment_bit_depths(blocks, dc_depth="standard").first().depth_dc == 3
    assert wl.gaggle_code(wl.dc_dpcm(wl.quantize_dc(wl.segment_bit_depths(blocks))), method="heuristic").count() == 1


#: NIST SP 800-38A, F.5.1, F.5.3 and F.5.5.
PLAIN = "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710"
IV = "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"
VECTORS = {
    "2b7e151628aed2a6abf7158809cf4f3c": "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff5ae4df3edbd5d35e5b4f09020db03eab1e031dda2fbe03d1792170a0f3009cee",
    "8e73b0f7da0e6452c810f32b809079e562f8ead2522c6b7b": "1abc932417521ca24f2b0459fe7e6e0b090339ec0aa6faefd5ccc2c6f4ce8e941e36b26bd1ebc670d1bd1d665620abf74f78a7f6d29809585a97daec58c6b050",
    "603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4": "601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c52b0930daa23de94ce87017ba2d84988ddfc9c58db67aada613c2dd08457941a6",
}


@pytest.mark.parametrize("key", VECTORS)
def test_published_vectors(spark, key):
    df = spark.createDataFrame([(bytearray.fromhex(PLAIN),)], "p binary")
    assert bytes(cipher.encrypt_ctr(df, "p", key, IV).first().ciphertext).hex() == VECTORS[key]
    assert b"".join(bytes(r.ciphertext) for r in cipher.encrypt_blocks(df, "p", key, IV).orderBy("b").collect()).hex() == VECTORS[key]


@pytest.mark.parametrize("chunk_bytes", [16, 32, 48, 1 << 20])
def test_published_vectors_across_the_borders_of_chunks(spark, chunk_bytes):
    key = next(iter(VECTORS))
    df = spark.createDataFrame([(1, bytearray.fromhex(PLAIN)), (2, bytearray()), (3, None), (4, bytearray.fromhex(PLAIN)[:33])], "id int, p binary")
    coded = cipher.encrypt_ctr(cipher.chunk_payloads(df, "p", chunk_bytes=chunk_bytes), "p", key, IV, "c", first_block=F.col("first_block"))
    found = {r.id: r.c for r in cipher.join_chunks(coded, ["id"], "c").collect()}
    assert {i: None if c is None else bytes(c).hex() for i, c in found.items()} == {1: VECTORS[key], 2: "", 3: None, 4: VECTORS[key][:66]}
    with pytest.raises(ValueError):
        cipher.chunk_payloads(df, "p", chunk_bytes=20)


def test_counters_carry_into_all_128_bits():
    for iv, first, n in ((2**128 - 2, 0, 4), (2**64 - 1, 0, 3), (2**64 - 5, 2**40, 3), (7, 2**63, 2), (0, 0, 1)):
        assert cipher.counters(iv, first, n) == b"".join(((iv + first + k) % 2**128).to_bytes(16, "big") for k in range(n))


def test_large_files_are_encrypted_in_chunks(spark, tmp_path):
    """160 MB in chunks of 1 MB by four ranges, as one keystream; twice gives the file again; empty files and odd ends."""
    rng = np.random.default_rng(1)
    source = tmp_path / "in"
    source.mkdir()
    data = {"large": np.tile(rng.integers(0, 256, 1 << 20, dtype=np.uint8), 160).tobytes() + b"end", "odd": b"x" * 33, "one": b"y"}
    for name, content in data.items():
        (source / name).write_bytes(content)
    key = next(iter(VECTORS))
    cipher.encrypt_files(spark, str(source), str(tmp_path / "coded"), key, IV)
    coded = (tmp_path / "coded" / "large").read_bytes()
    for at in (0, 5 << 20, (64 << 20) - 16, 160 << 20):  # a cut of the file is encrypted as it would be in the whole
        part = spark.createDataFrame([(bytearray(data["large"][at : at + 64]),)], "p binary")
        assert bytes(cipher.encrypt_ctr(part, "p", key, IV, first_block=at // 16).first().ciphertext) == coded[at : at + 64]
    cipher.encrypt_files(spark, str(tmp_path / "coded"), str(tmp_path / "back"), key, IV)
    assert {f.name: f.read_bytes() for f in (tmp_path / "back").iterdir()} == data


def test_odd_payloads_and_carry(spark):
    rows = [(i, bytearray(range(i))) for i in (0, 1, 15, 16, 17, 40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, p binary")
    back = cipher.decrypt_ctr(cipher.encrypt_ctr(df, "p", "00" * 16, "ff" * 16).drop("p"), "ciphertext", "00" * 16, "ff" * 16, "p")
    assert {r.id: r.p for r in back.collect()} == {i: p for i, p in rows}
    counters = spark.range(3).select(F.hex(cipher.ctr_counter("ff" * 16, F.col("id"))).alias("c")).collect()
    assert [r.c for r in counters] == ["F" * 32, "0" * 32, "0" * 31 + "1"]


def test_ffts_undo_each_other_and_turns_too(spark):
    rng = np.random.default_rng(3)
    lines = rng.normal(size=(10, 16, 2))
    df = spark.createDataFrame([(0, 0, i, x[:, 0].tolist(), x[:, 1].tolist()) for i, x in enumerate(lines)], "scene_id int, patch int, i int, re array<double>, im array<double>")
    back = radar.line_fft(radar.line_fft(df), inverse=True).orderBy("i").collect()
    assert np.allclose([r.re for r in back], lines[:, :, 0]) and np.allclose([r.im for r in back], lines[:, :, 1])
    twice = radar.corner_turn(radar.corner_turn(df, tile=5), row="j", out="i", tile=3).orderBy("i").collect()
    assert [r.re for r in twice] == lines[:, :, 0].tolist()


def test_a_point_target_focuses_to_one_peak(spark):
    asize, rsize = 256, 64
    p = {"lambda": 0.1, "prf": 1000.0, "tau": 8e-7, "fs": 2e7, "velocity": 7000.0, "r0": 8e5, "slope": 1e13, "asize": asize, "avalid": 128, "apatch": 128, "rsize": rsize, "rvalid": 32, "npatch": 2}
    scenes = spark.createDataFrame([(0, *p.values())], "scene_id int, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in p.items()))
    n = int(p["tau"] * p["fs"])
    t = (np.arange(n) - n / 2) / p["fs"]
    echo = np.zeros((asize, rsize), complex)
    bin_size = radar.C / (2 * p["fs"])
    near = p["r0"] + 10 * bin_size
    for az in range(asize):
        u = (az - 64) / p["prf"]
        extra = np.sqrt(near**2 + (p["velocity"] * u) ** 2) - near
        if abs(u) < 0.06:
            echo[az, 10 : 10 + n] += np.exp(1j * np.pi * p["slope"] * t**2) * np.exp(-4j * np.pi * extra / p["lambda"])
    rows = [(0, az, x.real.tolist(), x.imag.tolist()) for az, x in enumerate(echo)]
    pulses = spark.createDataFrame(rows, "scene_id int, az int, re array<double>, im array<double>")
    values = radar.focus_values(pulses, scenes, looks=1).toPandas()
    values["power"] = 2.0 ** values["value"]
    first = values[values["row"] < 16]
    peak = first.loc[first["power"].idxmax()]
    # the migration table knows positive frequencies only, so half the echo moves by up to a bin
    assert peak["col"] in (9, 10) and peak["power"] > 5 * first["power"].median()
    levels = radar.focus(pulses, scenes, looks=1).collect()
    assert min(r.level for r in levels) == 0 and max(r.level for r in levels) == 255


@pytest.mark.parametrize("tile,looks", [(64, 4), (5, 4), (1, 3), (7, 1), (24, 24)])
def test_tiles_with_a_halo_equal_the_chain_of_operators(spark, tile, looks):
    """Migrations of several bins, over the borders of tiles and beyond the last line; patches that reach beyond the scene."""
    rng = np.random.default_rng(tile)
    p = {"lambda": 0.9, "prf": 900.0, "tau": 4e-7, "fs": 2e7, "velocity": 2000.0, "r0": 8e3, "slope": 1e13, "asize": 72, "avalid": 24, "apatch": 40, "rsize": 32, "rvalid": 26, "npatch": 3}
    scenes = spark.createDataFrame([(s, *(p | {"r0": 8e3 + 900 * s}).values()) for s in range(2)], "scene_id int, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in p.items()))
    pulses = spark.createDataFrame([(s, az, *(rng.normal(size=32).tolist() for _ in "ri")) for s in range(2) for az in range(72) if az % 11], "scene_id int, az int, re array<double>, im array<double>")
    patches = radar.assign_patches(pulses, scenes)
    fdc, ranged = radar.doppler_centroid(patches, scenes), radar.range_compress(patches, scenes)
    assert radar.migration_table(scenes, fdc).agg(F.max("shift")).first()[0] > 8
    turned = radar.corner_turn(ranged, n_out=26, out="j_range", tile=9)
    moved = radar.migration_correct(radar.line_fft(radar.pad_pow2(turned)), scenes, fdc, tile=13)
    compressed = radar.azimuth_compress(moved, radar.azimuth_reference(scenes, fdc))
    want = {(r.scene_id, r.row, r.col): r.value for r in radar.multilook(radar.corner_turn(compressed, row="j_range", out="i"), scenes, looks=looks).collect()}
    found = {(r.scene_id, r.row, r.col): r.value for r in radar.azimuth_looks(ranged, scenes, fdc, looks=looks, tile=tile).collect()}
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()), atol=1e-9)


def test_focusing_shuffles_lines_twice(spark):
    p = {"lambda": 0.1, "prf": 1000.0, "tau": 8e-7, "fs": 2e7, "velocity": 7000.0, "r0": 8e5, "slope": 1e13, "asize": 256, "avalid": 128, "apatch": 128, "rsize": 64, "rvalid": 32, "npatch": 2}
    scenes = spark.createDataFrame([(0, *p.values())], "scene_id int, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in p.items()))
    pulses = spark.range(256).selectExpr("0 scene_id", "cast(id as int) az", "array_repeat(1d, 64) re", "array_repeat(0d, 64) im")
    plan = radar.focus_values(pulses, scenes)._jdf.queryExecution().executedPlan().toString()
    # the line of descent of the lines: from the looks down to the pulses
    main = plan[: plan.index("BroadcastExchange")]
    shuffles = [re.sub("#\\d+", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", main)]
    assert shuffles == ["scene_id, row, col", "scene_id, patch, tile"]
    assert "scene_id, az" in re.sub("#\\d+", "", plan) or "BroadcastHashJoin" in plan
    assert radar.few_scenes(scenes) and not radar.few_scenes(scenes, most=0)


def test_comparison_counts_missing_rows(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    b = spark.createDataFrame([(1, 11), (2, 22), (4, 40)], "k int, v int")
    assert sorted(r.k for r in compare.compare_tables(a, b, keys=["k"], value="v").collect()) == [2, 3, 4]
    assert tuple(compare.compare_summary(a, b, keys=["k"], value="v").first()) == (3, 2)
    assert [r.k for r in compare.first_mismatch(a, b, keys=["k"], value="v", n=2).collect()] == [2, 3]


def test_raw_files(spark, tmp_path):
    v = np.arange(12, dtype="<u2").reshape(3, 4) * 5000
    (tmp_path / "f_3x4_frame7.bin").write_bytes(v.tobytes())
    (tmp_path / "f_3x4_frame8.bin").write_bytes(v.tobytes()[:-1])
    rows = raw.read_raw_frames(spark, str(tmp_path), width=4, height=3).collect()
    assert {(r.frame_id, r.y, r.x): r.v for r in rows if r.error is None} == {(7, y, x): int(v[y, x]) for y in range(3) for x in range(4)}
    assert [(r.frame_id, r.error) for r in rows if r.error] == [(8, "23 bytes instead of 24")]
    big = raw.read_raw_frames(spark, str(tmp_path), width=4, height=3, endian="big").where("error is null and x = 1 and y = 0").first()
    assert big.v == int(v.astype(">u2").view("<u2")[0, 1]) or big.v == int.from_bytes(v.tobytes()[2:4], "big")
    frames = raw.read_raw_frames(spark, str(tmp_path), width=4, height=3).where("error is null")
    assert bytes(raw.frames_to_binary(frames).first().content) == v.tobytes()
    lines = tmp_path / "lines"
    lines.mkdir()
    data = np.arange(2 * 3 * 2, dtype="<f4")
    (lines / "patch_1.bin").write_bytes(data.tobytes())
    found = raw.read_raw_lines(spark, str(lines), width=3, height=2).orderBy("az").collect()
    assert [r.re for r in found] == [[0, 2, 4], [6, 8, 10]] and found[0].patch == 1
    series = raw.read_sample_series(spark, str(lines), bit_size=32).orderBy("i").collect()
    assert [r.x for r in series] == data.view("<u4").tolist()


@pytest.mark.parametrize("kind", ["int", "float"])
def test_segment_table_of_an_image_that_is_not_padded(spark, kind):
    image = np.random.default_rng(3).integers(0, 1000, (44, 50))
    found = wl.segment_table(image_table(spark, image), segment_size=16, kind=kind).orderBy("seg").collect()
    assert [(r.seg, r.n_blocks, r.pad_rows, r.header_bits, r.is_last) for r in found] == [(0, 16, 0, 24, False), (1, 16, 0, 24, False), (2, 10, 4, 32, True)]
    whole = image_table(spark, np.pad(image, ((0, 4), (0, 6)), mode="edge"))
    blocks = {(r.seg, r.blk, r.pos): r.c for r in wl.decompose(whole, height=48, width=56, segment_size=16, kind=kind).collect()} if kind == "int" else None
    for r in found:
        assert r.known_bits == r.header_bits + r.dc_bits + r.up_front_bits + r.ac_depth_bits + r.in_plane_bits + r.refinement + r.sign
        assert (r.significant, r.refinement) == tuple(sum(p[k] for p in r.planes) for k in (3, 4))
        if blocks:
            assert r.depth_ac == max(abs(c).bit_length() for (s, _, p), c in blocks.items() if s == r.seg and p)


@pytest.mark.parametrize("kind", ["int", "float"])
def test_images_of_different_sizes(spark, kind):
    """Each is decomposed as it would be alone."""
    rng = np.random.default_rng(5)
    tables = [image_table(spark, rng.integers(0, 1000, size)).withColumn("image_id", F.lit(k)) for k, size in enumerate([(48, 56), (64, 48)])]
    rows = lambda df: sorted((r.image_id, r.seg, r.blk, r.pos, r.c) for r in df.collect())
    together = rows(wl.decompose(tables[0].union(tables[1]), segment_size=16, kind=kind))
    alone = [rows(wl.decompose(t, height=h, width=w, segment_size=16, kind=kind)) for t, (h, w) in zip(tables, [(48, 56), (64, 48)])]
    assert together == sorted(alone[0] + alone[1])
