"""Contamination against brute force, with the set in one and in several broadcasts."""

import hashlib
import random
import re

import pytest

from framelake.llm.decontaminate import contamination, decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n, share):
    out = []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    owners.add(str(item) if item is not None else "")
        out.append((doc, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return out


def data():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "É", "x9", "10", "日本", "of"]) + rng.choice(["", "", str(rng.randint(0, 60))])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 9])))) for i in range(12)] + [(3, "the of x9 of the"), (None, "of of of of"), (20, None), (21, "!?")]
    docs = [(i, rng.choice([" ", "\n", ", "]).join(w for _ in range(rng.randint(0, 5)) for w in (rng.choice(items)[1] or "Y").split() + [word() for _ in range(rng.randint(0, 12))])) for i in range(150)]
    return docs + [(None, None), (7, ""), (7, ""), (8, items[4][1].upper() * 2)], items


@pytest.mark.parametrize("limit", [10**9, 6000])
def test_against_brute_force(spark, limit):
    docs, items = data()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(df, bench, n=4, share=3, max_set_bytes=limit).drop("hit_spans").collect()
    want = brute(docs, items, 4, 3)
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str) and 10 < sum(r[-1] for r in want) < 140
    kept = decontaminate(df, bench, n=4, share=3, max_set_bytes=limit)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted(d for d, w in zip(docs, want) if not w[-1] and d[0] is not None)
    clean = decontaminate(df, bench, n=4, mode="spans", max_set_bytes=limit).collect()
    assert sorted(len(words(r.text)) for r in clean) == sorted(w[1] - w[2] for w in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).first().contaminated is False
    assert contamination(docs.limit(0), none).count() == 0 and decontaminate(docs.limit(0), none).count() == 0


def test_a_block_at_the_address_of_another_is_loaded_anew():
    from types import SimpleNamespace

    from framelake.llm.decontaminate import _window_set

    shared = SimpleNamespace(value=["one", [(b"a b", "i1")]])  # one list all along: the same address
    assert _window_set(shared).find([b"a", b"b"])[1] == {"i1"}
    shared.value[:] = ["two", [(b"c d", "i2")]]
    assert _window_set(shared).find([b"a", b"b"])[1] == set() and _window_set(shared).find([b"c", b"d"])[1] == {"i2"}
