"""Context-tree weighting against a direct recursion, and the base score against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framelake.llm.ctw import score

TEXTS = [None, "", "abracadabra", "Abra cadabra é", "the cat the hat", "The  Cat\n", "x" * 1500, "ab" * 700, "日本", "a b c"] + [f"the {w} sat {w}{i}" for i, w in enumerate(["cat", "dog", "é"] * 12)]


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def direct(train_texts, texts, depth, least):
    """Recursion over contexts as strings of bytes, oldest first."""
    lg, counts = math.lgamma, {}
    for t in train_texts:
        data = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts.setdefault(data[i - d : i], Counter())[data[i]] += 1
    counts.setdefault(b"", Counter())
    nodes = {c for c, n in counts.items() if not c or n.total() >= max(1, least)}
    path = lambda b: [((1 << k) | (b >> (8 - k)), b >> (7 - k) & 1) for k in range(8)]

    def bits(counter):
        out = {}
        for b, n in counter.items():
            for node, bit in path(b):
                out.setdefault(node, [0, 0])[bit] += n
        return out

    own = {c: bits(counts[c]) for c in nodes}
    kids = {c: [bytes([x]) + c for x in range(256) if bytes([x]) + c in nodes] if len(c) < depth else [] for c in nodes}
    rest = {c: bits(counts[c] - sum((counts[k] for k in kids[c]), Counter())) for c in nodes}
    kt = lambda z, o: lg(z + 0.5) + lg(o + 0.5) - math.log(math.pi) - lg(z + o + 1)

    def weighted(c, node):
        e = kt(*own[c].get(node, (0, 0)))
        if not kids[c]:
            return e
        s = sum(weighted(k, node) for k in kids[c]) + kt(*rest[c].get(node, (0, 0)))
        return math.log(0.5) + np.logaddexp(e, s)

    def chance(history, c, node):
        z, o = own[c].get(node, (0, 0))
        p = (o + 0.5) / (z + o + 1)
        if not kids[c]:
            return p
        share = math.exp(kt(z, o) + math.log(0.5) - weighted(c, node))
        deeper = history[len(history) - len(c) - 1 :]
        if deeper in nodes:
            return share * p + (1 - share) * chance(history, deeper, node)
        z, o = rest[c].get(node, (0, 0))
        return share * p + (1 - share) * (o + 0.5) / (z + o + 1)

    out = []
    for t in texts:
        data, total = b"\xff" * depth + t + b"\xff", 0.0
        for i in range(depth, len(data)):
            for node, bit in path(data[i]):
                p = chance(data[i - depth : i], b"", node)
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("depth,least,sizes", [(3, 4, {}), (2, 1, {"block_bytes": 300, "fan": 2}), (4, 2, {"block_bytes": 200, "fan": 3, "keys_per_part": 100, "max_buckets": 2}), (7, 2, {})])
def test_job(spark, depth, least, sizes):
    rows = [(i if i != 4 else None, t, 0.5) for i, t in enumerate(TEXTS)] + [(3, "abra", 0.5)] * 2
    found = score(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3), depth=depth, least=least, **sizes).collect()
    low = lambda t: (t or "").encode().lower()
    training = [low(t) for i, t, _ in rows if not held_out(i)]
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t), None]
    c = Counter(itertools.chain.from_iterable(map(words, training)))
    model = direct(training, [low(t) for _, t, _ in rows], depth, least)
    want = [(i, held_out(i), len(words(low(t))), sum(w in c for w in words(low(t))), c.total(), sum(math.log10((c[w] + 1) / (c.total() + len(c) + 1)) for w in words(low(t))), m) for (i, t, _), m in zip(rows, model)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted((tuple(r)[:7] for r in found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-4)


def test_without_training(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    row = score(spark.createDataFrame([(alone, "ab")], "doc_id long, text string")).first()
    assert row.held_out and row.base_score == 0 and math.isclose(row.score, 24 * math.log10(0.5), rel_tol=1e-6)


def test_every_context_seen_twice_has_a_node(spark):
    """At any size of corpus, also of a context that is rare among its bytes; ten copies of a corpus have the same nodes."""
    rows = [(i, f"w{i % 400:03d} {'filler text ' * 20}") for i in range(800)]
    found = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), depth=3).collect()}
    training = [t.encode() for i, t in rows if not held_out(i)]
    for (i, _), want in zip(rows[:20], direct(training, [t.encode() for _, t in rows[:20]], 3, 2), strict=True):
        assert math.isclose(found[i], want, rel_tol=1e-4)
