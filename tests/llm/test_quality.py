"""Base counts against brute force; the models on held-out labels; odd inputs."""

import random
import re

import numpy as np
import pytest

from framelake.llm import quality
from framelake.llm.common import read
from framelake.llm.quality import Head, base_counts, features, filter_quality, score_quality, train

TEXTS = ["", " ", "\n\n", "a", "a b c", "a b c a b c", "x y z x y z x y", "é|é\n#é\n é\né|é", "a\x0bb\x0cc\rd", "l\nl\nl\n\n\nl ", "   x", "<>&%$*#|" * 30, "w " * 4000, "日本 語\t日本 語\t日本 語"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]


def test_base_counts():
    rng = random.Random(3)
    texts = [t if len(t) < 5000 else t[:600] for t in TEXTS] + [" ".join(rng.choices("a b cc # é\n".split(" "), k=rng.randint(0, 60))) for _ in range(200)]
    assert base_counts([t.encode() for t in texts]).tolist() == [brute(t) for t in texts]
    assert base_counts([]).shape == (0, 5) and len(features([])[0]) == 0


def test_features_do_not_depend_on_the_neighbours():
    raw = [t.encode() for t in TEXTS]
    owner, place = features(raw)
    for i, text in enumerate(raw):
        assert place[owner == i].tolist() == features([text])[1].tolist()


def test_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    heads = train(docs, labels.where("doc_id % 3 != 0"))
    rows = score_quality(docs, heads).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    base_ok = rows[~rows.base_failed]
    clean = base_ok[(base_ok.quality == 1) & (base_ok.toxic == 0)]
    assert clean.kept.mean() > 0.97  # with only 2,000 rows to learn from
    assert base_ok[base_ok.toxic == 1].kept.mean() < 0.35 and base_ok[base_ok.quality == 0].kept.mean() < 0.5
    assert abs(rows.p_toxic.mean() - rows.toxic.mean()) < 0.05  # calibrated


def test_odd_tables(spark):
    schema = "doc_id long, text string, kept string, c1 string"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(None, None, "k", "c"), (1, "", "k", "c"), (1, "w%d " * 3, None, None), (1, " ".join(map(str, range(200))), "k", "c")], schema)
    heads = train(docs, none)
    assert heads[0].weights is None
    assert sorted(r.kept for r in score_quality(docs, heads).collect()) == [False, False, False, True]
    kept = filter_quality(docs, heads)
    assert kept.columns == docs.columns and [r.kept for r in kept.collect()] == ["k"]
    assert filter_quality(docs.limit(0), heads).count() == 0 and score_quality(docs.limit(0), heads).count() == 0
    one_kind = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert train(docs, one_kind)[1].weights is None
    assert isinstance(train(docs, one_kind)[0], Head) and np.isscalar(heads[0].slope)


def test_word_order_makes_features():
    """No 3-byte sequence reaches over three spaces, so only pairs of words tell these apart."""
    assert features([b"aa   bb   cc   aa"])[1].tolist() != features([b"aa   cc   bb   aa"])[1].tolist()


def test_repeated_ids_and_half_null_labels(spark):
    """The model doesn't depend on the order of texts that share an id; a row without one label still teaches the other model."""
    word = lambda i, k: f"{'good' if i % 2 else 'bad'}{k % 5} w{(i * 7 + k) % 40}"
    rows = [(i, " ".join(word(i, k) for k in range(40))) for i in range(200)] + [(i, "other text " + "x " * i) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, None if i % 3 else i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    first, second = (train(spark.createDataFrame(r, "doc_id long, text string").repartition(k), labels) for r, k in ((rows, 2), (rows[::-1], 5)))
    assert all(np.array_equal(a.weights, b.weights) and a.offset == b.offset for a, b in zip(first, second))
    none_toxic = spark.createDataFrame([(i, i % 2, None) for i in range(200)], "doc_id long, quality int, toxic int")
    heads = train(spark.createDataFrame(rows, "doc_id long, text string"), none_toxic)
    assert heads[0].weights is not None and heads[1].weights is None
    assert np.array_equal(heads[0].weights, first[0].weights)
    small = train(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_labelled=50)
    assert small[0].weights is None or not np.array_equal(small[0].weights, first[0].weights)


@pytest.mark.parametrize("size", [1, 7, 133, 5_000])
def test_pieces_of_a_long_text_have_its_features(size):
    """Pairs of words and bytes over the cuts too, where signs alone or a very long word stand there."""
    rng = random.Random(size)
    words = ["the", "a", "Éa", "--", "...", "x,y", "日本", "foo!", "9", "-!-", "w" * 40]
    text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t \n"]) for _ in range(2_000)).encode()
    found = np.unique(np.concatenate([quality._features([p])[1] for p in quality._pieces(text, size)]))
    assert np.array_equal(found, np.unique(quality._features([text])[1]))


def test_a_text_of_many_pieces():
    text = b" ".join(b"w%d" % (k * k % 7001) for k in range(900_000))
    owner, place = quality.features([text])
    assert len(text) > 4_000_000 and not owner.any() and np.array_equal(place, np.unique(quality._features([text])[1]))
