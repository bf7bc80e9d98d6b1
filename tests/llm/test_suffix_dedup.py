"""Repeated strings of bytes against brute force, and the arrays against their definitions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from framelake.llm.suffix_dedup import previous_factors, repeated_bytes, suffix_order


def brute(rows, length, keep):
    """rows: (id, text) in the order of positions of ids that differ; equal ids: any."""
    data = [(t or "").encode() for _, t in rows]
    seen, first = Counter(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for i in order:
        for p in range(len(data[i]) - length + 1):
            w = data[i][p : p + length]
            seen[w] += 1
            first.setdefault(w, (i, p))
    out = []
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            w = d[p : p + length]
            if seen[w] > 1 and (keep == "none" or first[w] != (i, p)):
                gone[p : p + length] = True
        n_spans = int(gone.sum() and np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts(length, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "É", "x1", "…", "日本"]) + str(rng.randint(0, 300)) + " "
    prose = lambda n: "".join(word() for _ in range(n))
    passages = [prose(max(3, length // 4 + k))[: length + k - 3] for k in range(7)] + [prose(length), prose(length)]
    out = [None, "", " ", "a", "w " * length, "a" * (2 * length + 5), "b" + "a" * (length + 3) + "c", "xyz" * length, passages[-1] + "|" + passages[-1], passages[0] + passages[0]]
    for _ in range(60):
        out.append("".join(prose(rng.randint(0, length // 6)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 5))))
    near = list(out[-1] + prose(length))
    for _ in range(10):
        copy = near[:]
        copy[rng.randrange(len(copy))] = "#"
        out.append("".join(copy))
    # a passage in many documents, each with a border of its own
    out += [f"{i} {prose(3)}{passages[-2]}{prose(3)}{i}" for i in range(40)]
    return out + out[12:18] + [out[13]] * 3


CASES = [
    (200, "none", {}), (200, "first", {}), (48, "none", {"max_contexts": 3}), (48, "first", {"max_contexts": 3}), (16, "first", {"bucket_contexts": 5}),
    (200, "none", {"block_bytes": 3_000, "max_buckets": 2, "max_contexts": 1}), (64, "first", {"block_bytes": 2_000, "fan": 3, "bucket_contexts": 7}), (33, "none", {"seed": 8}),
]


@pytest.mark.parametrize("length,keep,options", CASES)
def test_against_brute_force(spark, length, keep, options):
    """Copies, near copies, runs of one byte, periods, borders of passages; hot seeds' windows as rows; many blocks."""
    tables = len(spark.catalog.listTables())
    rows = [(i, t, 1, 2) for i, t in enumerate(texts(length, length))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, position int").repartition(3)
    found = repeated_bytes(docs, length=length, keep=keep, with_text=True, **options).collect()
    want = [(i, *b) for (i, *_), b in zip(rows, brute([r[:2] for r in rows], length, keep), strict=True)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found)
    for g, w in zip(got, want, strict=True):
        assert g == w, g[0]
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed and len(r.spans) == 2 * r.n_spans for r in found)
    assert sum(r.n_removed for r in found) > 100 and len(spark.catalog.listTables()) == tables


def test_null_and_equal_ids(spark):
    """All copies go, whatever their ids; of a string one occurrence stays."""
    one = "".join(f"{i * i} " for i in range(80))
    docs = spark.createDataFrame([(None, one), (None, one), (4, one), (4, one), (5, one[10:] + "x"), (6, None)], "doc_id long, text string")
    found = [(r.doc_id, r.n_bytes - r.n_removed) for r in repeated_bytes(docs, keep="first").collect()]
    assert sorted(found, key=str) == sorted([(None, len(one)), (None, 0), (4, 0), (4, 0), (5, 1), (6, 0)], key=str)
    found = [(r.doc_id, r.n_bytes - r.n_removed) for r in repeated_bytes(docs.withColumnRenamed("text", "t").selectExpr("cast(doc_id as string) doc_id", "t"), text_col="t", keep="none").collect()]
    assert sorted(found, key=str) == sorted([(None, 0), (None, 0), ("4", 0), ("4", 0), ("5", 1), ("6", 0)], key=str)


def test_many_repeated_rows_and_a_long_text(spark):
    long = " ".join(f"w{k % 50000}" for k in range(400_000))
    rows = spark.range(50_000).selectExpr("id doc_id", f"'{'abcdefghij' * 30}' text").repartition(8).union(spark.createDataFrame([(-1, long)], "doc_id long, text string"))
    found = {r.n_bytes: (r.n_removed, r["count"]) for r in repeated_bytes(rows, keep="none").groupBy("n_bytes", "n_removed").count().collect()}
    assert found == {300: (300, 50_000), len(long): (len(long), 1)}


def test_empty_table(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_arrays(seed):
    """Suffix order, common prefixes and longest previous factors by their definitions."""
    rng = random.Random(seed)
    data = bytes(rng.choice(b"ab" if seed % 2 else b"abcd\x00\xff") for _ in range(300)) + b"abab" * 20
    starts = np.array(sorted(rng.sample(range(len(data)), 200)))
    most = [8, 20, 72, 100, 200, 24][seed]
    order, common = suffix_order(np.frombuffer(data, np.uint8), starts, most)
    cut = [(data[starts[i] :] + bytes(most))[:most] for i in order]
    assert cut == sorted(cut)
    assert common.tolist() == [0, *(next((k for k in range(most) if a[k] != b[k]), most) for a, b in zip(cut, cut[1:]))]
    position = np.array(rng.sample(range(200), 200))
    factor, source = previous_factors(common, position, 3)
    for i in range(len(cut)):
        longest = 0
        for j in range(len(cut)):
            if position[j] < position[i]:
                longest = max(longest, min(common[min(i, j) + 1 : max(i, j) + 1]))
        assert factor[i] == (longest if longest >= 3 else 0)
        if factor[i]:
            j = source[i]
            assert position[j] < position[i] and min(common[min(i, j) + 1 : max(i, j) + 1]) == longest
