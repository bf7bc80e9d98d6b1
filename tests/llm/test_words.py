"""Words and runs of words in Thue-Morse order, whose polynomial hashes are equal modulo 2^64, are told apart by the whole operators."""

import pytest

from framelake.llm.ctw import is_held_out, score
from framelake.llm.jaccard_join import near_duplicates
from framelake.llm.quality import base_counts
from framelake.llm.substring_dedup import repeated_runs
from framelake.llm.words import Words, runs

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(SWAP)
    return text


@pytest.mark.parametrize("n", [512, 1_024, 2_048, 8_192, 16_384])
def test_words_and_runs(n):
    text = thue_morse(n)
    for kind in (0, 1):
        one, other = Words([text.encode(), text.translate(SWAP).encode()]).hashes(kind).tolist()
        assert one != other
    spaced = " ".join(text)
    one, other = (runs(Words([t.encode()]).hashes(), n).tolist() for t in (spaced, spaced.translate(SWAP)))
    assert one != other and len(one) == 1


def test_hashes_depend_on_the_word_alone():
    """At any place, beside any other word, of any length."""
    words = ["x" * n + y for n in (0, 1, 6, 7, 8, 9, 15, 16, 17, 4_095, 4_096, 5_000) for y in ("a", "b", "é")]
    plain = [Words([w.encode()]).hashes().tolist()[0] for w in words]
    assert len(set(plain)) == len(words)
    assert Words([" ".join(words).encode(), " \n".join(words[::-1]).encode()]).hashes().tolist() == plain + plain[::-1]


@pytest.mark.parametrize("n", [1_024, 2_048])
def test_operators_tell_them_apart(spark, n):
    word = thue_morse(n)
    own = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*own, word])), (2, " ".join([*own, word.translate(SWAP)])), (3, " ".join(["p q r s", word])), (4, " ".join(["p q r s", word.translate(SWAP)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in repeated_runs(docs).collect()] == [0] * 4
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert found[3] == 3 and found[4] == 4
    triples = f"{word} x y {word.translate(SWAP)} x y"
    assert base_counts([triples.encode(), f"{word} x y {word} x y".encode()])[:, 4].tolist() == [0, 6]
    seen, held = (next(i for i in range(100) if is_held_out(i, 7, 2) == out) for out in (False, True))
    learnt = spark.createDataFrame([(seen, word), (held, word.translate(SWAP))], "doc_id long, text string")
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in score(learnt).collect()} == {seen: (2, 2), held: (2, 1)}
