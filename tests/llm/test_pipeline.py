"""The stages of the corpus pipeline against brute force, each on its own input, and its registration."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from framelake.llm import line_dedup, quality
from framelake.llm.common import read
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_line_dedup import brute as brute_lines


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = read(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(stages, spark, sf_dir):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in quality.score_quality(before, quality.train(before, read(spark, sf_dir, "labels"))).where("kept").collect()}
    assert pairs(after) == [x for x in pairs(before) if x[0] in kept] and kept


def test_lines(stages):
    before, after = stages["line_dedup"]
    rows = [(r.doc_id, r.source, r.text) for r in before.collect()]
    assert pairs(after) == sorted((r[0], t) for r, t in zip(rows, brute_lines(rows, 0.1, 10)[0]))
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert line_dedup.line_report(before).count() == len(rows)


def test_groups(stages):
    before, after = stages["jaccard_dedup"]
    rows = pairs(before)
    stay = {doc for doc, _, group in brute_groups(rows) if doc == group}
    assert pairs(after) == [r for r in rows if r[0] in stay]


def test_contamination(stages, spark, sf_dir):
    before, after = stages["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = set()
    for r in read(spark, sf_dir, "benchmark").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + min(13, len(w))]) for i in range(max(1, len(w) - 12)) if w}
    keep = []
    for doc, text in pairs(before):
        w = words(text)
        hit = {i + k for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            keep.append((doc, text))
    assert pairs(after) == keep


def test_packing(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    totals = {r.doc_id: (r.s, r.t) for r in after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "s", "t").collect()}
    assert all(s == t for s, t in totals.values())


def test_registration():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


LONG = " ".join(f"word{k % 9973} and{k % 977}" for k in range(60_000))
ODD = [
    (1, None, "en", "a", None, "x", 1), (2, "", None, None, 0, None, None), (None, "one line\nof text", "de", "b", 17, "y", 2), (3, LONG, "en", "a", len(LONG), "z", 3),
    *[(4, "the same words in each of these rows for all to see " * 3, "en", "c", 156, "t", 4)] * 5, (5, "\n \t\n", "fr", "", 5, "", 5), (6, "<|endoftext|> \u0130. \U0001f600 \x0b", "", "a", 20, "u", 6),
]


@pytest.fixture()
def odd(spark):
    """With columns whose names the stages use themselves."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, kept string, block int").repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, sf_dir, odd, name, stage):
    left = stage(spark, odd, sf_dir)
    rows = left.collect()
    if name == "packing":
        tokens = {}
        for r in rows:
            tokens[r.doc_id, r.doc_tokens] = tokens.get((r.doc_id, r.doc_tokens), 0) + r.length
        assert all(total % n == 0 for (_, n), total in tokens.items()) and tokens[1, 1] == 1 and tokens[2, 1] == 1
        assert len({r.doc_id for r in rows}) == 7 and sum(t // n for (d, n), t in tokens.items() if d == 4) == 5
    else:
        assert left.columns == odd.columns
        kept = {(r.doc_id, r.kept, r.block) for r in rows}
        assert len(rows) >= len(kept)
        if name == "quality_rules":
            assert not kept & {(1, "x", 1), (2, None, None), (None, "y", 2)}
        elif name == "line_dedup":
            assert len(rows) == len(ODD) and next(r for r in rows if r.doc_id == 1).text is None and next(r for r in rows if r.doc_id == 3).text == LONG
        else:
            assert len(rows) == len(ODD)  # no groups under several ids, no contamination
    none = stage(spark, odd.limit(0), sf_dir)
    assert none.count() == 0 and none.columns == left.columns


def test_texts_go_to_python_in_small_batches(spark, sf_dir, odd):
    """But where the session names a number, that stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    named = spark.conf.getAll.get(key)
    try:
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.decontamination, corpus_pipeline.pack):
            spark.conf.unset(key)
            stage(spark, odd, sf_dir)
            assert int(spark.conf.get(key)) == corpus_pipeline.BATCH_ROWS
        spark.conf.set(key, 77)
        corpus_pipeline.pack(spark, odd, sf_dir)
        assert int(spark.conf.get(key)) == 77
    finally:
        spark.conf.set(key, named) if named else spark.conf.unset(key)
