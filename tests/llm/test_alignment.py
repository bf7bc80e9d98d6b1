"""Alignment of two tokenizers against a plain loop over whole texts, with a plain tokenizer."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from framelake.llm.alignment import MEASURES, Aligned, align, chunks, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def tokens(text):
        a = [(t.id, bytes(letters[c] for c in first.id_to_token(t.id))) for t in map(lambda i: type("T", (), {"id": i}), first.encode(" " + text, add_special_tokens=False).ids)]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return tokens


def brute(texts, plain):
    """The measures of all texts, token by token."""
    per, count = [], Counter()
    for text in texts:
        a, b = plain(text) if text else ([], [])
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if t < e and s < f]
        groups, current, borders = [], ([], []), {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        for border in sorted(borders):
            current = tuple([i for i, s, e in side if s >= (groups[-1][1] if groups else 0) and e <= border] for side in spans)
            groups.append((current, border))
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for (x, y), _ in groups)
        per.append((len(a), len(b), len(groups), links, written))
        count.update(set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    rows = [(na, nb, ng, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(w.encode()).hexdigest() if na else "") for na, nb, ng, links, w in per]
    return rows, count, most


TEXTS = [
    None, "", " ", "  ", "a", "Hello, World. It's 3.14... isn't it?! (x,y) a.b.c", "a  b   c\n\n d\te   f", "▁ x", "x▁y z", "<|endoftext|> a <s> </s> <unk> <0x41> b", "日本語 テキスト。 абв ГДЕ 😀", "é ÉCOLE naïve ﬁ",
    " 's 've 'LL don't 's's", "x" * 300, "end ", " start", "\x00 a \x01\x7f b", "퟿ é ​ a 　 b", "12345 67 8 9 1.0", "a\r\nb", "- -- --- a - b",
]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "Thing", "aren't", "é", "naïve", "日本", "x1", "1,000", "(y)", "--", "▁", "<s>", "'s", "...", "Ünï", "word", "another", "tokenization"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", "", " "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2_000, "fan": 3, "max_buckets": 2, "keys_per_part": 50, "portion": 700}])
def test_against_brute_force(spark, plain, options):
    """Also with pairs counted in two hops; copies, nulls, ties, repeated rows and clashing columns."""
    texts = TEXTS + random_texts(120)
    texts += texts[4:12] * 3 + ["the same text " * 4] * 40
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, digest string")
    found = align(docs, A, B, with_groups=True, **options).collect()
    want, count, most = brute(texts, plain)
    assert sorted((str(r.doc_id), *(r[m] for m in MEASURES), r.groups_sha256) for r in found) == sorted((str(i), *w) for (i, *_), w in zip(rows, want, strict=True))
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in found)
    pairs = {(r.a, r.b): (r.documents, r.best) for r in pair_counts(docs, A, B, **options).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_chunks_give_whole_texts_tokens(plain):
    """Tokens of chunks, joined, are those of the whole text, also of many random strings."""
    rng = random.Random(1)
    signs = [*" \n\t.,'!?<|>-ab's0éÀɏ", "  ", " ", " ", "́", "▁", "😀", "日", "<s>"]
    texts = ["".join(rng.choice(signs) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000)])) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    aligned = Aligned([t.encode() for t in texts], A, B)
    n_a, n_b = aligned.sums(aligned.n_a).tolist(), aligned.sums(aligned.n_b).tolist()
    for text, x, y, w in zip(texts, n_a, n_b, aligned.written(), strict=True):
        a, b = plain(text)
        assert (x, y) == (len(a), len(b)), ascii(text)
        if a:
            assert [int(i) for g in w.split(";") for i in g.split("|")[0].split(",")] == [i for i, _ in a], ascii(text)
            assert [int(i) for g in w.split(";") for i in g.split("|")[1].split(",")] == [i for i, _ in b], ascii(text)


def test_a_long_text_is_cut_in_portions(spark, plain):
    text = " ".join(random_texts(30_000, seed=9)).replace("▁", "_")
    assert len(text) > 2_000_000 and sum(1 for _ in chunks(text)) > 3
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    found = {r.doc_id: r for r in align(docs, A, B).collect()}
    a, b = plain(text)
    assert (found[1].n_a, found[1].n_b) == (len(a), len(b)) and found[2].n_a == 2


def test_every_token_of_the_first_vocabulary(plain):
    """Its merges, taken by rank, find each token that the plain tokenizer finds."""
    tokens = sorted(Tokenizer.from_file(A).get_vocab())
    texts = [t.replace("Ġ", " ").replace("Ċ", "\n") for t in tokens]
    aligned = Aligned([t.encode() for t in texts], A, B)
    for text, n in zip(texts, aligned.sums(aligned.n_a).tolist(), strict=True):
        assert n == len(plain(text)[0]), ascii(text)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
