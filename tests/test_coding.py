"""Sample coding: every block decodes to its samples again, and hand cases of options and layout."""

import random

import pytest

from framelake.operators import ricecode as rice


def decode(code, option, n_bits, J):
    width = rice.id_width(n_bits)
    head = width + (option in ("zb", "se"))
    value, at = int(code[:head], 2), head
    if option == "zb":
        assert value == 0
        return [0] * J
    if option == "nc":
        assert value == (1 << width) - 1
        return [int(code[at + n_bits * i : at + n_bits * (i + 1)], 2) for i in range(J)]
    if option == "se":
        out = []
        for p in range(J // 2):
            gamma = int(code[at + 32 * p : at + 32 * p + 32], 2)
            s = 0
            while (s + 1) * (s + 2) // 2 <= gamma:
                s += 1
            b = gamma - s * (s + 1) // 2
            out += [s - b, b]
        return out
    k, high = int(option[1:]), []
    assert value == k + 1
    for _ in range(J):
        end = code.index("1", at)
        high.append(end - at)
        at = end + 1
    low = [int(code[at + k * i : at + k * (i + 1)] or "0", 2) for i in range(J)]
    return [h << k | x for h, x in zip(high, low)]


@pytest.mark.parametrize("n_bits", [1, 2, 3, 8, 16])
def test_blocks_decode(spark, n_bits):
    rng, J, r = random.Random(n_bits), 8, 5
    top = (1 << n_bits) - 1
    xs = []
    for _ in range(40):
        kind = rng.randint(0, 4)
        level = rng.randint(0, top)
        xs += [0] * J if kind == 0 else [min(top, max(0, level + rng.randint(-2, 2))) for _ in range(J)] if kind < 3 else [rng.randint(0, top) for _ in range(J)]
    rows = [("a", i, x) for i, x in enumerate(xs)] + [("b", i, x) for i, x in enumerate(xs[: J * r + 3])]
    samples = spark.createDataFrame(rows, "series_id string, i long, x long")
    values, layout = rice.code_series(samples, J=J, r=r, n_bits=n_bits)
    codes = {(c.series_id, c.seg, c.blk): c for c in rice.encode_blocks(values, layout, J=J, n_bits=n_bits).collect()}
    vs = {}
    for v in values.collect():
        vs.setdefault((v.series_id, v.seg, v.blk), {})[v.j] = v.v
    assert len(codes) == 40 + r and vs.keys() == codes.keys()
    for key, c in codes.items():
        assert decode(c.code, c.option, n_bits, J) == [vs[key][j] for j in range(J)]
    at = 0
    for key in sorted(k for k in codes if k[0] == "a"):
        assert codes[key].bit_offset == at
        at += len(codes[key].code)
    assert {row.bits for row in layout.where("series_id = 'b'").collect()} <= {len(c.code) for c in codes.values()}
    residual = {(v.series_id, v.i): (v.pred, v.d, v.v) for v in values.collect()}
    for pred, d, v in residual.values():  # the mapping keeps to n bits and can be undone
        theta = min(pred, top - pred)
        back = (v // 2 if v % 2 == 0 else -(v + 1) // 2) if v <= 2 * theta else (v - theta) * (1 if pred <= top - pred else -1)
        assert 0 <= v <= top and back == d


def test_options_and_ties(spark):
    J = 8
    rows = [(0, 0, b, j, v) for b, vs in enumerate([[0] * 8, [0] * 8, [0, 0, 0, 1, 0, 0, 0, 0], [40000] * 8]) for j, v in enumerate(vs)]
    values = spark.createDataFrame(rows, "series_id int, seg int, blk int, j int, v long")
    runs = rice.zero_runs(values)
    assert [r.run_index for r in runs.orderBy("blk").collect()] == [0, 1, None, None]
    options = rice.select_option(rice.option_sizes(values, J=J, n_bits=16), runs, n_bits=16)
    assert [(r.option, r.body_bits) for r in options.orderBy("blk").collect()] == [("zb", 1), ("zb", 2), ("se", 6), ("nc", 128)]


def test_partial_segments_and_empty(spark):
    samples = spark.createDataFrame([("a", i, i) for i in range(100)], "series_id string, i long, x long")
    assert rice.blockize(samples, J=8, r=5).count() == 80
    values, layout = rice.code_series(samples.limit(0), J=8, r=5, n_bits=8)
    assert rice.encode_blocks(values, layout, J=8, n_bits=8).count() == 0 and rice.pack_segments(values, layout, J=8, n_bits=8).count() == 0
