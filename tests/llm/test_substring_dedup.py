"""Repeated runs of words against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from framelake.llm.substring_dedup import levels, repeated_runs


def brute(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length,options", [(35, {}), (12, {}), (3, {}), (35, {"hash_bits": 6}), (3, {"hash_bits": 4}), (35, {"block_bytes": 3_000, "fan": 3, "max_buckets": 2}), (12, {"block_bytes": 2_000, "fan": 4, "hash_bits": 8, "keys_per_part": 100})])
def test_against_brute_force(spark, length, options):
    """Also with hashes that collide, and with questions in two hops."""
    tables = len(spark.catalog.listTables())
    rng = random.Random(length)
    word = lambda: rng.choice(["a", "b", "É", "x1", "…"]) + str(rng.randint(0, 300))
    passages = [[word() for _ in range(rng.choice([length - 1, length, length + 1, 3 * length]))] for _ in range(12)]
    texts = [None, "", "  ", "a", "w " * (length + 5), " ".join(passages[3]) + "\n\t" + " ".join(passages[3])]
    for _ in range(120):
        parts = [[word() for _ in range(rng.randint(0, 60))] if rng.random() < 0.7 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n"]).join(w for p in parts for w in p))
    texts += texts[10:14] + [texts[11]]
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)]
    found = repeated_runs(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), length=length, with_text=True, **options).collect()
    want = [(i, *b) for (i, _, _), b in zip(rows, brute(texts, length))]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sum(r.n_removed for r in found) > 100
    assert len(spark.catalog.listTables()) == tables


def test_many_repeated_rows(spark):
    """They spread over the blocks, and long ones are whole."""
    long = " ".join(f"w{k % 5000}" for k in range(100_000))
    rows = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'x y z' text").repartition(8).union(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    found = {r.n_words: (r.n_removed, r["count"]) for r in repeated_runs(rows, length=3).groupBy("n_words", "n_removed").count().collect()}
    assert found == {3: (3, 100_000), 100_000: (100_000, 1)}


def test_empty_and_levels(spark):
    assert repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert levels(35) == [9, 18, 35] and levels(5) == [5]
