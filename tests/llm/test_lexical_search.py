"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from framelake.llm.lexical_search import search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    """docs: (doc_id, text); items: (item_id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            rows += [(score, doc)] if score > 0 else []
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k, doc, score) for k, (score, doc) in enumerate(rows[:top], 1)]
    return sorted(out, key=str)


def tables(n_docs, n_items, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "é", "Ünï", "日本", "x_1", "it's"]) if rng.random() < 0.4 else "w" + str(int(rng.paretovariate(0.7)) % 500)
    docs = [(i if i % 17 else None, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n_docs)]
    docs += [(10_000 + i, docs[5][1]) for i in range(300)] + [(20_000 + i, "the " + docs[8][1].upper()) for i in range(60)] + [docs[9]] * 4 + [(30_000, None), (30_001, ""), (30_002, "--- ...")]
    # classes of equal scores whose members lie between each other: terms outside the items' vocabulary differ
    docs += [(40_000 + i, f"zebra zebra o{i % 3} o{i % 2}") for i in range(60)]
    items = [(f"i{i}", " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(n_items)]
    items += [("copy", docs[5][1]), ("zebra", "zebra Zebra"), ("none", "q9 q8"), ("null", None), ("i0", items[0][1]), (None, "the of")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("top,options", [(20, {}), (3, {"max_items": 5, "max_broadcast": 0}), (1, {"max_bytes": 300})])
def test_against_brute_force(spark, top, options):
    docs, items = tables(500, 30, top)
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, m int, rank int").repartition(5)
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, score int")
    found = search(left, right, top=top, **options)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, top)


def test_names_as_ids(spark):
    docs, items = tables(120, 8, 4)
    docs = [(None if i is None else f"d{i:06}", t) for i, t in docs]
    found = search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), top=7)
    want = [(i, k, d, s) for i, k, d, s in brute([(None if d is None else int(d[1:]), t) for d, t in docs], items, 7)]
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str) == sorted(((i, k, None if d is None else f"d{d:06}", s) for i, k, d, s in want), key=str)


def test_long_texts_are_counted_in_pieces():
    text = ("Aé b-c " * 900_000).encode()
    assert term_counts(text) == {"aé".encode(): 900_000, b"b": 900_000, b"c": 900_000}
    assert term_counts(b"x" * 5_000_000).total() == 1


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a", "b c")], "item_id string, text string")
    assert search(none, items).count() == 0
    assert search(spark.createDataFrame([(1, "b")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert search(spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string"), items).count() == 0
