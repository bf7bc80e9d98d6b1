"""Packing against the plain tokenizer and the rules for pieces."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framelake.llm.packing import SumOfSquares, WordTokenizer, pack, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "a", "Hello, World. It's 3.14... isn't it?! (x,y) a.b.c", "ÉCOLE naïve ﬁ ŀ Ǆ İstanbul ΣΑΣ ß ẞ", "x" * 9000, "日本語 テキスト。 абв ГДЕ", "é İ   　   z\x0b\x0cq\x1cr",
    "don't won't they'll 'sx 's, 've.", "<|endoftext|> <|startoftext|> </w>", "a<|endoftext|>b.<|ENDOFTEXT|> A<|EndOfText|>B, <|startoftext|><|endoftext|>É. <|endoftext", "İ. İ İ,İ! xİ.y", "word " * 30_000, "., ,. .a ,b a., b,. ...", "퟿ \U0001f600😀 a😀b", "Ⅷ ½ ٣ x²",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cached_chunks_give_the_tokenizers_ids(plain):
    words = WordTokenizer(PATH, max_cached=10)
    for texts in (TEXTS, *([t] for t in TEXTS[::-1]), [], [""]):
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), text


def test_random_strings_give_the_tokenizers_ids(plain):
    rng, words = random.Random(7), WordTokenizer(PATH)
    signs = [*" \n\t.,'!?<|>-ab'sXYé0İßΣς", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "\u0301", "\u0307", "\u00a0", "\u2028", "\u1e9e", "\u0345"]
    letter = lambda: rng.choice(signs) if rng.random() < 0.6 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x20000)]))
    texts = ["".join(letter() for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), text


def test_every_letter_gives_the_tokenizers_ids(plain):
    """Each code point alone, between letters, and before a sign."""
    words = WordTokenizer(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x20000 or c % 97 == 0)]
    for at in range(0, len(points), 2000):
        part = points[at : at + 2000]
        texts = [" ".join((c, f"x{c}y", f"{c}.")) for c in part]
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), ascii(text)


def test_capitals_before_marks_give_the_tokenizers_ids(plain):
    """A capital and the mark behind it may compose only after lower-casing: each capital of the first planes with each mark."""
    words = WordTokenizer(PATH)
    marks = [chr(c) for c in range(0x300, 0x370)]
    capitals = [chr(c) for c in range(0x41, 0x530) if chr(c).isupper() and (c < 0x180 or c % 5 == 0)]
    for capital in capitals:
        texts = [f"{capital}{m} x{capital}{m}y" for m in marks]
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), ascii(text)
    rng = random.Random(3)
    letters = [*"ABCHJTWYhjtwyé .,"]
    texts = ["".join(rng.choice(letters) + (rng.choice(marks) if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 6))) for _ in range(100_000)]
    for at in range(0, len(texts), 5_000):
        for text, ids in zip(texts[at : at + 5_000], words.encode(texts[at : at + 5_000]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), ascii(text)


def check(rows, ids):
    """rows: dicts; ids: by document."""
    for doc, own in ids.items():
        pieces = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
        assert [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) == len(own)
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    lengths = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths.values())  # no padding at all


def test_every_id_lies_in_one_piece(spark, plain):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string").repartition(3)
    rows = [r.asDict() for r in pack(df, PATH).collect()]
    check(rows, {i: [*plain(t), 2] for i, t in enumerate(TEXTS)})


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("sizes", [[2100] * 300, [1] * 9000, [4096, 8192, 4095, 1], list(range(1, 900, 7)), [1365] * 400, [64] * 130, [4095] * 50])
def test_few_windows_stay_open_for_any_lengths(sizes):
    packer, rows, most = SumOfSquares(4096, 0), [], 0
    ids = {i: np.arange(n, dtype="<u4") for i, n in enumerate(sizes)}
    for i, own in ids.items():
        rows += packer.add(i, own)
        most = max(most, int(packer.counts.sum()))
    rows += packer.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check([{k: int(v) for k, v in zip(names, r)} for r in rows], {i: x.tolist() for i, x in ids.items()})
    assert most <= 64 * 6


def test_latin_words_and_numbers_need_no_whole_tokenizer(plain):
    """Once signs and digits are known, only the merges are asked."""
    words = WordTokenizer(PATH)
    words.encode(["0 1 2 3 4 5 6 7 8 9 . , $$$ %%%"])
    words.tokenizer = None
    text = "Élan ÉTÉ Enleç, ENLEÇ 71.77.118.93 schöte$$$ Über%%% a1b2.c"
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == plain(text)
    assert words._chunks("Enleç J̌ Éa".encode()) == ["Enleç".encode(), "J̌".encode(), "Éa".encode()] and words._chunks("ENLEç".encode()) == ["enleç".encode()]


def test_each_distinct_chunk_of_a_batch_is_looked_up_once(plain):
    class Counted(WordTokenizer):
        asked = 0

        def __getitem__(self, chunk):
            self.asked += 1
            return super().__getitem__(chunk)

    words, text = Counted(PATH), "the cat, The Cat; THE dog don't, Été été."
    found = words.encode([text, "", *["J̌ é<|endoftext|>,"] * 2, *[text] * 500])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [plain(text), [], *[plain("J̌ é<|endoftext|>,")] * 2, *[plain(text)] * 500]
    assert 0 < words.asked < 40  # each of the two cased texts asks for its own


def test_pieces_are_cut_by_bytes():
    sizes = [3, 0, 4, 4, 30, 0, 1, None, 7, 8]
    batch = pa.record_batch({"doc_id": list(range(10)), "text": pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())})
    found = [p.column(0).to_pylist() for p in pieces([batch, batch.slice(0, 0), batch.slice(3, 3)], 8)]
    assert found == [[0, 1, 2], [3], [4], [5, 6, 7, 8], [9], [3], [4], [5]]


def test_memory_of_many_different_words_is_bounded():
    """A million different words, through a process of its own: what its memory grows by beyond the tokenizer's."""
    code = f"""
import re
from framelake.llm.packing import WordTokenizer, pieces
import pyarrow as pa
held = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
words = WordTokenizer({PATH!r})
words.encode(["a few words"])
before = held()
for k in range(0, 1_000_000, 50_000):
    texts = [" ".join(f"w{{i * 2654435761 % 2**32:x}}" for i in range(n, n + 1_000)) for n in range(k, k + 50_000, 1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([t.encode() for t in texts])], ["doc_id", "text"])
    for piece in pieces([batch]):
        words.encode(piece.column(1).to_pylist())
print(held() - before)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])}).stdout)
    assert grown < 75, grown


def test_chunks_asked_for_again_outlive_a_turn():
    words = WordTokenizer(PATH, max_cached=3)
    words.encode(["one two three four"])
    words.encode(["one five"])  # the first four are the older ones now
    learnt, words._learn = [], lambda chunk, learn=words._learn: learnt.append(chunk) or learn(chunk)
    words.encode(["one two five six"])
    assert learnt == [b"six"]
    words.forget()
    assert not words and not words.older
