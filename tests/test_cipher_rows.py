"""Rows of payloads together in Arrow, without an object for each."""

import numpy as np
import pyarrow as pa

from framelake.operators import cipher


def test_rows_are_xored_as_one_by_one():
    """Null, empty, short and large ones, also of a slice."""
    rng = np.random.default_rng(1)
    payloads = [None, b"", *(rng.bytes(int(n)) for n in rng.integers(1, 70, 40_000)), rng.bytes(3 << 20), b"x", None, rng.bytes(1 << 20), b""]
    streams = [None if p is None else rng.bytes(len(p) + 16) for p in payloads]
    want = [None if p is None else (np.frombuffer(p, np.uint8) ^ np.frombuffer(s, np.uint8)[: len(p)]).tobytes() for p, s in zip(payloads, streams, strict=True)]
    for first in (0, 1, 17):
        assert cipher._xor(pa.array(payloads, pa.binary())[first:], pa.array(streams, pa.binary())[first:]).to_pylist() == want[first:]
    assert cipher._xor(pa.array([], pa.binary()), pa.array([], pa.binary())).to_pylist() == []
