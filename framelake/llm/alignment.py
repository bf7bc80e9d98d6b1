"""Alignment of two tokenizers' tokens: groups that end at equal bytes, links by overlap, and how usual each linked pair is.

Exact-text deduplication first: documents are shuffled by their full text and counted, so that each distinct text is tokenised and aligned
once, however many documents hold it; its multiplicity weights the counts of its id pairs. Pairs are counted over all distinct texts by
questions of blocks (blocks.py), dealt by the first tokenizer's id, so that the part that counts a pair also knows the
id's highest count. The measures of a distinct text are joined back to all doc_ids that hold it, by the text's SHA-256; texts
of many documents are broadcast in that join (see common.attach).

Inside a block texts are cut at single spaces between plain letters and signs, where neither tokenizer has a token across: the first one's
pattern begins a word at its space, the second one's pieces hold the space mark at their start alone (checked when it is loaded).
Each distinct chunk of a block is tokenised once; its tokens, groups and links are the same wherever it stands.

Defined cases: a null or empty text has no tokens: zeros and no digest; so has a text whose tokens' bytes, joined, differ from a space and the
text (the space mark U+2581 in a text does that); repeated rows and documents of equal text count one each; null ids stay; very
long texts are cut like others and taken in portions; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blocks import QUESTION, Blocks, Exchange, answer_table, answered, in_order, merge, question, read_questions
from framelake.llm.common import Scratch, attach, materialize, read, ship, text_bytes
from framelake.llm.packing import byte_letters
from framelake.llm.words import distinct, mix, portions

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
SPACE = "▁"
#: Cuts are between these: signs and letters of ASCII, letters of Latin with marks.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_ENDS = {c for c in map(chr, range(0x250)) if re.fullmatch("[!-~À-ɏ]", c)}
_PORTION = 500_000  # characters of a text that are cut at once

_loaded: dict[tuple, tuple] = {}


def _first_tokenizer(path: str):
    """(ids of each text, bytes of each id) of a byte-level BPE file whose merges are in the order of their ids; special tokens' names are plain text."""
    import public_tokenizers
    import tiktoken

    byte = {letter: b for b, letter in byte_letters().items()}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for data, i in ranks.items():
        pieces[i] = data
    encode = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: list(map(encode, texts)), pieces


def _second_tokenizer(path: str):
    """(ids of each text, to which the model adds a space itself; bytes of each id)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError(f"{path} has pieces with a space after a letter, so that texts can't be cut at spaces")
    pieces = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
    return lambda texts: model.encode(texts, num_threads=1), pieces


def tokenizers(first: str, second: str) -> tuple:
    """Loaded once in each Python worker."""
    key = first, second
    if key not in _loaded:
        _loaded[key] = (*_first_tokenizer(first), *_second_tokenizer(second))
    return _loaded[key]


def chunks(text: str) -> Iterator[list[str]]:
    """The chunks of a text, without the single spaces between them, in portions."""
    begin = 0
    while len(text) - begin > _PORTION:
        cut = _CUT.search(text, begin + _PORTION)
        if cut is None:
            break
        yield _CUT.split(text[begin : cut.start()])
        begin = cut.end()
    yield _CUT.split(text[begin:])


class _Index(dict):
    """Numbers for chunks in the order in which they come."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _cuts(names) -> np.ndarray:
    """Whether a cut may be at both ends of each."""
    return np.array([c != "" and c[0] in _ENDS and c[-1] in _ENDS for c in names], bool)


def _tokens(names: list[str], n_joined: int, encode, pieces: list[bytes], sizes: np.ndarray, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all chunks, how many each has, whether its bytes are a space and the chunk). The first n_joined chunks may stand beside each other."""
    ids, counts, plain = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for at in (*range(0, n_joined, 4_096), *range(n_joined, len(names), 4_096)):
        part = names[at : min(at + 4_096, n_joined if at < n_joined else len(names))]
        strings = [" ".join(part[i : i + 32]) for i in range(0, len(part), 32)] if at < n_joined else part
        whole = "".join(f" {s}" for s in strings).encode()
        found = list(chain.from_iterable(encode([prefix + s for s in strings] if prefix else strings)))
        own, end = np.array(found, np.int64), np.cumsum([len(c.encode()) + 1 for c in part])
        token_end = np.cumsum(sizes[own])
        last = np.searchsorted(token_end, end)
        if b"".join(map(pieces.__getitem__, found)) == whole and (token_end[last] == end).all():
            n, good = np.diff(last + 1, prepend=0), np.ones(len(part), bool)
        else:
            each = encode([prefix + c for c in part] if prefix else part)
            good = np.array([b"".join(map(pieces.__getitem__, x)) == b" " + c.encode() for x, c in zip(each, part, strict=True)], bool)
            # chunks whose bytes differ have no tokens here, and their texts none at all
            each = [x if ok else [] for x, ok in zip(each, good.tolist(), strict=True)]
            own, n = np.array(list(chain.from_iterable(each)), np.int64), np.array(list(map(len, each)), np.int64)
        ids.append(own)
        counts.append(n)
        plain.append(good)
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(plain)


def _without(ids: np.ndarray, n: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids, n) if plain.all() else (ids[np.repeat(plain, n)], np.where(plain, n, 0))


class Aligned:
    """The distinct chunks of a list of texts, tokenised and aligned, and each text's chunks."""

    def __init__(self, texts: list[bytes], first: str, second: str):
        ids_of_a, bytes_a, ids_of_b, bytes_b = tokenizers(first, second)
        names = self._index(texts)
        size_a, size_b = (np.fromiter(map(len, pieces), np.int64, len(pieces)) for pieces in (bytes_a, bytes_b))
        a, n_a, plain_a = _tokens(names, self.n_joined, ids_of_a, bytes_a, size_a, " ")
        b, n_b, plain_b = _tokens(names, self.n_joined, ids_of_b, bytes_b, size_b, "")
        plain = plain_a & plain_b
        self.a, self.n_a = _without(a, n_a, plain)
        self.b, self.n_b = _without(b, n_b, plain)
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        # for each byte: whether tokens end there, and how many have before it
        total = int(end_a[-1]) if len(end_a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        cuts = is_a & is_b
        groups, ends_b = np.cumsum(cuts), np.cumsum(is_b)
        self.group_a, self.group_b = groups[end_a - 1], groups[end_b - 1]
        owner_a = np.repeat(np.arange(len(names)), self.n_a)
        self.n_groups = np.bincount(owner_a[cuts[end_a]], minlength=len(names)).astype(np.int64)
        low, high = ends_b[end_a - size_a[self.a]], ends_b[end_a - 1] + 1
        per_token = high - low
        linked = np.repeat(np.arange(len(self.a)), per_token)
        to = np.arange(len(linked)) - np.repeat(np.cumsum(per_token) - per_token, per_token) + np.repeat(low, per_token)
        self.pairs = self.a[linked].astype(np.uint64) << np.uint64(32) | self.b[to].astype(np.uint64)
        self.n_links = np.bincount(owner_a[linked], minlength=len(names)).astype(np.int64)
        self.plain = np.logical_and.reduceat(np.append(plain, True)[np.append(self.chunk, len(names))], self.first[:-1]) if texts else np.zeros(0, bool)
        self.plain &= np.diff(self.first) > 0

    def _index(self, texts: list[bytes]) -> list[str]:
        """Numbers all chunks of the texts: those that may stand beside others first."""
        index, own = _Index(), []
        for text in texts:  # at every space, as if all were cuts
            own.append(np.array(list(map(index.__getitem__, text.decode().split(" "))), np.int32) if text else np.zeros(0, np.int32))
        cut = _cuts(index)
        for i, found in enumerate(own):
            if not cut[found].all():
                parts = [np.array(list(map(index.__getitem__, part)), np.int32) for part in chunks(texts[i].decode())]
                own[i] = np.concatenate(parts)
        self.first = np.concatenate([[0], np.cumsum(list(map(len, own)), dtype=np.int64)]) if own else np.zeros(1, np.int64)
        used = np.zeros(len(index), bool)
        chunk = np.concatenate([np.zeros(0, np.int32), *own])
        used[chunk] = True
        cut = _cuts(index)
        order = np.concatenate([np.flatnonzero(used & cut), np.flatnonzero(used & ~cut)])
        self.n_joined, place = int((used & cut).sum()), np.zeros(len(index), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.chunk = place[chunk]
        names = list(index)
        return [names[i] for i in order.tolist()]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its chunks' values; nothing where bytes differ."""
        total = np.concatenate([[0], np.cumsum(values[self.chunk])])
        return np.where(self.plain, total[self.first[1:]] - total[self.first[:-1]], 0)

    def by_chunk(self, of_link: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_link)])
        end = np.cumsum(self.n_links)
        return total[end] - total[end - self.n_links]

    def counted(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs, the sum of the weights of the texts that hold each)."""
        names, place = np.unique(self.pairs, return_inverse=True)
        counts = np.zeros(len(names), np.int64)
        begin = np.cumsum(self.n_links) - self.n_links
        # texts of about a million links at once
        links = np.concatenate([[0], np.cumsum(self.sums(self.n_links))])
        at = 0
        while at < len(weights):
            end = max(at + 1, int(np.searchsorted(links, links[at] + 1_000_000)) - 1)
            own = [i for i in range(at, min(end, len(weights))) if self.plain[i]]
            used = [distinct(self.chunk[self.first[i] : self.first[i + 1]]) for i in own]
            text, used = np.repeat(own, [len(u) for u in used]), np.concatenate([np.zeros(0, np.int32), *used])
            n = self.n_links[used]
            link = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[used], n)
            code = distinct(np.repeat(text, n).astype(np.int64) * len(names) + place[link])
            np.add.at(counts, code % max(1, len(names)), weights[code // max(1, len(names))])
            at = end
        held = counts > 0
        return names[held], counts[held]

    def asked(self) -> np.ndarray:
        """The distinct pairs of the texts that have tokens."""
        used = np.zeros(len(self.n_links), bool)
        used[self.chunk[np.repeat(self.plain, np.diff(self.first))]] = True
        return distinct(self.pairs[np.repeat(used, self.n_links)])

    def written(self) -> list[str | None]:
        """The groups of each text: `a1,a2|b1;a3|b2,b3`."""
        # a token stands behind those of its side before it, and of the other side those of earlier groups, or of its own if they are first
        per_a, per_b = (np.bincount(g, minlength=int(self.n_groups.sum())) for g in (self.group_a, self.group_b))
        at_a = np.arange(len(self.a)) + (np.cumsum(per_b) - per_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(per_a)[self.group_b]
        ids, place = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.int64)
        ids[at_a], ids[at_b], place[at_a], place[at_b] = self.a, self.b, 2 * self.group_a, 2 * self.group_b + 1
        # what follows a token: a comma inside a side, a bar between sides, a semicolon between groups
        sign = np.where(place[1:] == place[:-1], 0, np.where(place[1:] & 1, 1, 2))
        top = int(ids.max(initial=0)) + 1
        written = [f"{i}{c}" for c in ",|;" for i in range(top)]
        tokens = list(map(written.__getitem__, (ids + top * np.append(sign, 2)[: len(ids)]).tolist()))
        end = np.cumsum(self.n_a + self.n_b)
        strings = ["".join(tokens[b:e]) for b, e in zip((end - self.n_a - self.n_b).tolist(), end.tolist(), strict=True)]
        first = self.first.tolist()
        return ["".join(map(strings.__getitem__, self.chunk[b:e].tolist()))[:-1] if ok else None for b, e, ok in zip(first[:-1], first[1:], self.plain.tolist(), strict=True)]


def _by_first(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return mix(keys >> np.uint64(32)) % np.uint64(n_parts)


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, whether a sum is its first id's highest) of distinct pairs in order."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] >> np.uint64(32) != keys[:-1] >> np.uint64(32)]))
    most = np.maximum.reduceat(counts, begin) if len(keys) else counts
    return counts, counts == np.repeat(most, np.diff(np.append(begin, len(keys))))


def _answers(table: pa.Table) -> pa.Table:
    keys, counts, _ = read_questions(table, np.int64)
    known, total, _ = merge(keys, counts)
    total, best = _totals(known, total)
    found = total << 1 | best
    return answer_table(table, [found[np.searchsorted(known, k)] for k in keys])


def _pair_rows(table: pa.Table) -> pa.Table:
    keys, counts, _ = read_questions(table, np.int64)
    known, total, _ = merge(keys, counts)
    total, best = _totals(known, total)
    return pa.table({"a": pa.array((known >> np.uint64(32)).astype(np.int64)), "b": pa.array((known & np.uint64(0xFFFFFFFF)).astype(np.int64)), "documents": pa.array(total), "best": pa.array(best)})


def _measured(names: list[str], aligned: Aligned, known: np.ndarray, values: np.ndarray, with_groups: bool) -> pa.Table:
    """A row for each text; values: count and whether it is the best, of the known pairs."""
    own = np.append(values, 0)[np.searchsorted(known, aligned.pairs)]
    columns = [aligned.sums(x) for x in (aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links, aligned.by_chunk(own & 1), aligned.by_chunk(own >> 1))]
    written = aligned.written()
    digests = ["" if w is None else hashlib.sha256(w.encode()).hexdigest() for w in written]
    out = {"digest": pa.array([n[:64] for n in names], pa.string()), "k": pa.array([int(n[65:]) for n in names], pa.int64())}
    out |= {m: pa.array(c.astype(np.int64)) for m, c in zip(MEASURES, columns, strict=True)} | {"groups_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"groups": pa.array([w or "" for w in written], pa.large_string()).cast(pa.string())} if with_groups else {}))


class Alignment:
    """Distinct texts in blocks, and the questions about their pairs."""

    def __init__(self, docs: DataFrame, first: str, second: str, work: Scratch, id_col: str, text_col: str, portion: int, **sizes):
        ship(docs.sparkSession)
        self.first, self.second, self.portion = first, second, portion
        self.rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        held = self.rows.where("text != ''")
        texts = held.groupBy("text").agg(F.count("*").alias("k"))
        named = texts.select(F.concat(F.sha2("text", 256), F.lit(":"), F.col("k")).alias("name"), "text")
        self.blocks = Blocks(named, "name", "text", work, measured=text_bytes(held), **sizes)
        self.n_parts = min(self.blocks.n_parts, 1 << 16)
        self.fan = min(self.n_parts, self.blocks.fan)

    def exchange(self) -> Exchange:
        first, second, portion, fan = self.first, self.second, self.portion, self.fan

        def ask(table):
            block, names, texts = in_order(table)
            weights = np.array([int(n[65:]) for n in names], np.int64)
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *(Aligned(texts[b:e], first, second).counted(weights[b:e]) for b, e in portions(texts, portion))]
            return question(block, *merge(*zip(*found, strict=True))[:2], fan, _by_first)

        return Exchange(self.blocks.run(ask, QUESTION), self.blocks, self.n_parts, np.int64, np.int64, _by_first)


def pair_counts(docs: DataFrame, first: str, second: str, *, id_col="doc_id", text_col="text", portion: int = 16_000_000, **sizes) -> DataFrame:
    """(a, b, documents, best): how many documents hold each id pair linked, and whether that is the first id's highest."""
    with Scratch(docs.sparkSession, "alignment") as work:
        alignment = Alignment(docs, first, second, work, id_col, text_col, portion, **sizes)
        return materialize(alignment.exchange().run(_pair_rows, "a long, b long, documents long, best boolean"), "alignment-pairs")


def align(docs: DataFrame, first: str, second: str, *, id_col="doc_id", text_col="text", with_groups: bool = False, portion: int = 16_000_000, **sizes) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    first, second: paths of a byte-level BPE file and of a sentencepiece model that each executor has. portion: bytes of texts that
    are aligned at once; sizes: of Blocks.
    """
    with Scratch(docs.sparkSession, "alignment") as work:
        alignment = Alignment(docs, first, second, work, id_col, text_col, portion, **sizes)
        exchange, fan = alignment.exchange(), alignment.fan
        found = work.keep(exchange.back(exchange.run(_answers)), "counts")

        def measure(table, answers):
            _, names, texts = in_order(table)
            cuts = list(portions(texts, portion))
            asked = [Aligned(texts[b:e], first, second).asked() for b, e in cuts] if len(cuts) > 1 else []
            parts = []
            for b, e in cuts:
                aligned = Aligned(texts[b:e], first, second)
                known = distinct(np.concatenate(asked)) if asked else aligned.asked()
                values = answered(known, dict(zip(answers["part"].to_pylist(), answers["answers"].to_pylist(), strict=True)), fan, np.int64, _by_first)
                parts.append(_measured(names[b:e], aligned, known, values, with_groups))
            return pa.concat_tables(parts) if parts else _measured([], Aligned([], first, second), np.zeros(0, np.uint64), np.zeros(0, np.int64), with_groups)

        schema = f"digest string, k long, {', '.join(f'{m} long' for m in MEASURES)}, groups_sha256 string" + ", groups string" * with_groups
        measures = work.keep(alignment.blocks.run(measure, schema, found), "measures")
        rows = alignment.rows
        held = attach(rows.where("text != ''").select("doc_id", F.sha2("text", 256).alias("digest")), measures, "digest", "k").drop("digest")
        nothing = {**{m: F.lit(0).cast("long") for m in MEASURES}, "groups_sha256": F.lit("")} | ({"groups": F.lit("")} if with_groups else {})
        alone = rows.where("text is null or text = ''").select("doc_id", *(c.alias(n) for n, c in nothing.items()))
        return materialize(held.unionByName(alone), "alignment-result")


def op11_alignment(spark, sf_dir):
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
