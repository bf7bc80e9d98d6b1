"""Site-relative line frequency against brute force."""

import random
from collections import Counter

import pytest

from framelake.llm.line_dedup import drop_boilerplate, line_report


def brute(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, host, text in rows:
        pages[host] += 1
        for line in set((text or "").split("\n")):
            seen[host, line] += bool(line.strip(" "))
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    dropped = sum((h, x) in bad for _, h, t in rows for x in (t or "").split("\n"))
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for _, h, t in rows], dropped


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_against_brute_force(spark, max_broadcast):
    rng = random.Random(1)
    lines = ["", " ", "home", "imprint", "login", "é", "a", "b", "x y", "home "] + [f"own {i}" for i in range(300)]
    weights = [3, 1, 9, 5, 2, 2, 1, 1, 1, 1] + [0.05] * 300
    rows = [(i, rng.choice(["big"] * 6 + ["small", None, "tiny"]), "\n".join(rng.choices(lines, weights, k=rng.randint(0, 8)))) for i in range(400)]
    rows += [(i, "big", t) for i, t in enumerate([None, "", "home", "home\nhome"])] + [(7, "one", "home\nhome")] * 2
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, source string, text string, n_chars long, host string").repartition(3)
    found = drop_boilerplate(docs, ratio=0.2, min_pages=5, length_col="n_chars", max_broadcast=max_broadcast)
    assert found.columns == docs.columns
    texts, dropped = brute(rows, 0.2, 5)
    want = [(i, h, t, None if t is None else len(t), "x") for (i, h, _), t in zip(rows, texts)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    report = line_report(docs, ratio=0.2, min_pages=5)
    assert sum(r.n_dropped for r in report.collect()) == dropped > 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert drop_boilerplate(docs).count() == 0 and line_report(docs).count() == 0
