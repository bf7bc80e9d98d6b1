"""Groups of near duplicates against brute force, with every token class and kind of group in play."""

import random
import re

import numpy as np
import pytest

from framelake.llm.common import Scratch
from framelake.llm.jaccard_join import components, frequent_keys, keep_one, least_overlap, near_duplicates, rare_keys


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    return [(doc, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def corpus(rng):
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    line = " ".join(word() for _ in range(14))
    texts = [None, "", " \n", "a", "A", "a b", "a  B", "É b", "é b", "a b c d e", "A b c d E f"]
    for n, copies in ((8, 12), (14, 20), (40, 25), (120, 12), (60, 3), (60, 2)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                own[rng.randrange(len(own))] = word()
            texts += [" ".join(own)] * rng.choice([1, 1, 1, 3])
    chain = [word() for _ in range(80)]
    for k in range(15):  # each links with the next ones, but not with far ones
        texts.append(" ".join(chain[k * 3 : k * 3 + 60]))
    for _ in range(40):
        texts.append(line + "\n" + " ".join(word() for _ in range(rng.choice([2, 4, 30]))))
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rng.shuffle(texts)
    return [(i if i % 40 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("all_pairs,queries,often,sizes", [(64, 9, 8, {}), (3, 2, 3, {}), (2, 1, 50, {"block_bytes": 4_000, "fan": 3, "max_buckets": 2}), (1, 2, 2, {"block_bytes": 3_000, "fan": 4, "keys_per_part": 50})])
def test_against_brute_force(spark, all_pairs, queries, often, sizes):
    rows = corpus(random.Random(all_pairs))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").repartition(3)
    found = near_duplicates(docs, all_pairs=all_pairs, star_portion=4, often=often, queries=queries, tokens=40 * queries, **sizes)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)


def test_prefixes_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        x = rng.choice(2**40, n, replace=False).astype(np.uint64)
        same = least_overlap(n, 75)
        y = np.concatenate([x[:same], rng.choice(2**40, int(rng.integers(0, max(1, (4 * same) // 3 - n + 1))), replace=False).astype(np.uint64)])
        if 4 * same < 3 * (n + len(y) - same):
            continue
        frequent = np.sort(rng.choice(x, int(rng.integers(0, n + 1)), replace=False))
        (a, f), (b, g) = ((np.unique(s), np.isin(np.unique(s), frequent)) for s in (x, y))
        alone = np.isin(rare_keys(a, f, 75)[0], rare_keys(b, g, 75)[0]).any()
        may = all(least_overlap(len(s), 75) <= h.sum() for s, h in ((a, f), (b, g)))
        assert alone or may and np.isin(*(frequent_keys(s[h], len(s), 75) for s, h in ((a, f), (b, g)))).any()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200, i) for i in range(201, 260)]
    with Scratch(spark, "test") as work:
        label = {r.ref: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), work).collect()}
    assert all(label[a] == label[b] for a, b in edges) and all(label[x] <= x for x in label)
    assert {label[x] for x in range(100, 161)} == {100} and {label[x] for x in range(200, 260)} == {200}


def test_keep_one_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (4, None, None), (5, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_pages_of_one_template_are_one_unit(spark):
    """They share a line and don't link: nothing is compared in pairs, whatever their number."""
    line = " ".join(f"common{k}" for k in range(34))
    rows = [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(6))) for i in range(6_000)] + [(6_000 + i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(6)) + " end") for i in range(3)]
    tables = len(spark.catalog.listTables())
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i if i < 6_000 else i - 6_000 for i in range(6_003)}
    assert len(spark.catalog.listTables()) == tables
