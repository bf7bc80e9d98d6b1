"""Language-model scores by context-tree weighting over bytes.

The text's bytes (A-Z lower-cased, with an end symbol) are predicted bit by bit: for every context of up to `depth` bytes each of
the 255 places in the binary tree of a byte has its own zeros and ones, counted over all training documents. A
Krichevsky-Trofimov estimate stands at each depth, and weights mix the estimates of all depths, by how well each foretold the training
bits (the weighted probabilities are summed from the deepest contexts up). Every context that is seen `least` times in the training
texts has a node, at every size of corpus; what follows rarer ones is counted together in a leaf of the next shorter context. `depth` (5) may be up to 7.

The tree is never in one place. Each block (blocks.py) asks for its distinct (context, byte) keys, with their counts in its training texts, dealt
by the two nearest bytes of the context. All contexts of two bytes and more that share these are in one part, where the counts are summed and the
tree is worked out from its leaves to the contexts of two bytes; their sums by nearest byte make the depths 0 and 1, which is the only thing that the driver
sees (256 rows at most). With these, each part mixes the estimates from the shortest context to the longest known one, and
answers each block with the log10 probability of each key. Parts keep seen (context, place) pairs only, not 255 places a context.

Beside it stands a word unigram score with add-one smoothing; how often a word occurs in training texts is asked over all blocks (blocks.py),
by 64-bit hashes of words.

Held-out documents are those whose crc32(id as text) leaves `held_out` when divided by `folds`; a null id counts as the empty text.
Defined cases: a null text is the empty text (an end alone); repeated rows count each; without training documents the
model is uniform over bits; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blocks import ANSWER, QUESTION, Blocks, Exchange, answer_table, answered, in_order, merge, question, read_questions
from framelake.llm.common import LOWER, Scratch, materialize, read
from framelake.llm.words import Words, per_text, portions
from framelake.llm.words import distinct as distinct_of

END = 255  # never a byte of UTF-8


def is_held_out(doc_id, folds: int, held_out: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == held_out


def _stream(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\xff".join([b"", *texts, b""]), np.uint8)


def contexts(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol after the first: its preceding bytes, the nearest one highest, then itself, as one number."""
    code = np.zeros(len(stream) - 1, np.uint64)
    before = stream[:-1]
    for k in range(depth):
        code = code << np.uint64(8) | before
        if k + 1 < depth:  # beyond a text's begin there are ends only
            older = np.concatenate([np.full(k + 1, END, np.uint8), stream])[: len(code)]
            before = np.where(before == END, np.uint8(END), older)
    return code << np.uint64(8) | stream[1:]


def _cut(depth: int):
    """Parts by the two nearest bytes, so that all contexts that share them are together."""
    return lambda keys, n_parts: ((keys >> np.uint64(8 * (depth - 1))) * np.uint64(0x9E3779B1) >> np.uint64(8)) % np.uint64(n_parts)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _bits(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the nodes 1..255 of the byte's binary tree, from counts of bytes."""
    heap = np.zeros((len(leaves), 512))
    heap[:, 256:] = leaves
    for node in range(255, 0, -1):
        heap[:, node] = heap[:, 2 * node] + heap[:, 2 * node + 1]
    return heap[:, 2:512:2], heap[:, 3:512:2]


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1)


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each run of equal values, run of each value)."""
    new = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


class Part:
    """The contexts of 2 to `depth` bytes of one part, from sorted keys and their counts (0 of keys that are only asked for)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, least: int):
        self.depth = depth
        self.keys, self.counts, self.up = {depth: keys}, {depth: counts.astype(np.float64)}, {}
        for d in range(depth, 2, -1):
            shorter = self.keys[d] >> np.uint64(16) << np.uint64(8) | self.keys[d] & np.uint64(255)
            self.keys[d - 1], self.up[d] = np.unique(shorter, return_inverse=True)
            self.counts[d - 1] = np.bincount(self.up[d], weights=self.counts[d])
        self.node, self.inner = {}, {depth: np.zeros(len(keys), bool)}  # by key, of its context
        for d in range(depth, 1, -1):
            begin, run = _runs(self.keys[d] >> np.uint64(8))
            total = np.add.reduceat(self.counts[d], begin)
            self.node[d] = (total >= max(1, least))[run]
            if d < depth:
                has = np.zeros(len(begin), bool)
                has[run[self.up[d + 1][self.node[d + 1]]]] = True
                self.inner[d] = has[run]

    def _places(self, k: int) -> dict:
        """For bit k, by depth: begin, run, parent, node, zeros, ones, zeros and ones of the rest, share of the own estimate, weighted, all by (context, place)."""
        out, below, taken_zeros, taken_ones = {}, 0.0, 0.0, 0.0
        for d in range(self.depth, 1, -1):
            begin, run = _runs(self.keys[d] >> np.uint64(8 - k))
            bit = (self.keys[d] >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            zeros = np.add.reduceat(np.where(bit, 0, self.counts[d]), begin)
            ones = np.add.reduceat(np.where(bit, self.counts[d], 0), begin)
            if d < self.depth:  # what the children with nodes have
                child = out[d + 1]
                child["parent"] = parent = run[self.up[d + 1][child["begin"]]]
                below, taken_zeros, taken_ones = (np.bincount(parent, weights=child[x] * child["node"], minlength=len(begin)) for x in ("weighted", "zeros", "ones"))
            node, inner = self.node[d][begin], self.inner[d][begin]
            own, rest = _kt(zeros, ones), (zeros - taken_zeros, ones - taken_ones)
            mixed = np.logaddexp(own, below + _kt(*rest)) + np.log(0.5)
            share = np.where(inner, np.exp(own + np.log(0.5) - mixed), 1.0)
            out[d] = {"begin": begin, "run": run, "node": node, "zeros": zeros, "ones": ones, "rest": rest, "share": share, "weighted": np.where(inner, mixed, own)}
        return out

    def sums(self) -> list[tuple[int, np.ndarray]]:
        """For each nearest byte an array of 3 x 256: log weights by place of the contexts of 2 bytes with nodes, counts of bytes after these, and after all."""
        keys, counts, node = self.keys[2], self.counts[2], self.node[2]
        byte = (keys >> np.uint64(16)).astype(np.int64)
        symbol = (keys & np.uint64(255)).astype(np.int64)
        names, index = np.unique(byte, return_inverse=True)
        out = np.zeros((len(names), 3, 256))
        np.add.at(out, (index, 1, symbol), counts * node)
        np.add.at(out, (index, 2, symbol), counts)
        for k in range(8):
            level = self._places(k)[2]
            at = level["begin"]
            np.add.at(out, (index[at], 0, 1 << k | symbol[at] >> 8 - k), level["weighted"] * level["node"])
        return list(zip(names.tolist(), out, strict=True))

    def log10(self, top: Top) -> np.ndarray:
        """log10 probability of each key."""
        keys = self.keys[self.depth]
        out = np.zeros(len(keys))
        byte = (self.keys[2] >> np.uint64(16)).astype(np.int64)
        symbol = (self.keys[2] & np.uint64(255)).astype(np.int64)
        for k in range(8):
            levels = self._places(k)
            at = levels[2]["begin"]
            place = byte[at], 1 << k | symbol[at] >> 8 - k
            sums, left, chance = top.sums[place], top.left[place], top.chance[place]
            for d in range(2, self.depth + 1):
                level = levels[d]
                if d > 2:
                    parent = level["parent"]
                    sums, left, chance = sums[parent], left[parent], chance[parent]
                sums = sums + left * level["share"] * _one(level["zeros"], level["ones"])
                left = left * (1 - level["share"])
                chance = np.where(level["node"], sums + left * _one(*level["rest"]), chance)
            p = chance[levels[self.depth]["run"]]
            out += np.log10(np.where(keys >> np.uint64(7 - k) & np.uint64(1) == 1, p, 1 - p))
        return out


@dataclass
class Top:
    """Of depths 0 and 1, by nearest byte and place: mixed so far, weight left for longer contexts, and the chance of a one if none is known."""

    sums: np.ndarray
    left: np.ndarray
    chance: np.ndarray


def build_top(sums: dict[int, np.ndarray], least: int) -> Top:
    weights, children, counts = (np.zeros((256, 256)) for _ in range(3))
    for byte, values in sums.items():
        weights[byte], children[byte], counts[byte] = values
    pad = lambda x: np.insert(x, 0, 0, axis=-1)  # noqa: E731, places count from 1
    node, inner = counts.sum(axis=1) >= max(1, least), (children.sum(axis=1) > 0)[:, None]
    zeros, ones = map(pad, _bits(counts))
    rest = tuple(own - pad(taken) for own, taken in zip((zeros, ones), _bits(children), strict=True))
    own = _kt(zeros, ones)
    mixed = np.logaddexp(own, weights + _kt(*rest)) + np.log(0.5)
    weighted, share = np.where(inner, mixed, own), np.where(inner, np.exp(own + np.log(0.5) - mixed), 1.0)
    zeros0, ones0 = zeros.sum(axis=0), ones.sum(axis=0)
    rest0 = zeros[~node].sum(axis=0), ones[~node].sum(axis=0)
    own0 = _kt(zeros0, ones0)
    mixed0 = np.logaddexp(own0, weighted[node].sum(axis=0) + _kt(*rest0)) + np.log(0.5)
    share0 = np.exp(own0 + np.log(0.5) - mixed0) if node.any() else np.ones(256)
    sums0, left0 = share0 * _one(zeros0, ones0), 1 - share0
    mixed_sums = sums0 + left0 * share * _one(zeros, ones)
    left = left0 * (1 - share)
    chance = np.where(node[:, None], mixed_sums + left * _one(*rest), sums0 + left0 * _one(*rest0))
    return Top(mixed_sums, left, chance)


def _block_grams(texts: list[bytes], depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each portion of the texts its distinct keys and the key of each byte."""
    return [(k, i.astype(np.int32)) for k, i in (np.unique(contexts(_stream(texts[b:e]), depth), return_inverse=True) for b, e in portions(texts))]


def _gram_question(depth: int, folds: int, held_out: int, fan: int):
    def ask(table):
        block, ids, texts = in_order(table)
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for asked_only in (False, True):
            some = [t.translate(LOWER) for i, t in zip(ids, texts, strict=True) if is_held_out(i, folds, held_out) == asked_only]
            for begin, end in portions(some):
                k, n = np.unique(contexts(_stream(some[begin:end]), depth), return_counts=True)
                keys.append(k)
                counts.append(np.zeros_like(n) if asked_only else n)
        distinct, n, _ = merge(keys, counts)
        return question(block, distinct, n.astype(np.uint32), fan, _cut(depth))

    return ask


def _summed(table: pa.Table, depth: int, least: int) -> tuple[list[np.ndarray], Part]:
    keys, counts, _ = read_questions(table, np.uint32)
    return keys, Part(*merge(keys, counts)[:2], depth, least)


_SUMS = "byte int, sums binary"


def _part_sums(depth: int, least: int):
    def sums(table):
        rows = _summed(table, depth, least)[1].sums()
        return pa.table({"byte": pa.array([b for b, _ in rows], pa.int32()), "sums": pa.array([x.tobytes() for _, x in rows], pa.binary())})

    return sums


def _add_sums(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table["sums"].to_pylist())
    return pa.table({"byte": table["byte"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _part_answers(shared, depth: int, least: int):
    def answers(table):
        keys, part = _summed(table, depth, least)
        known = part.log10(shared.value).astype(np.float32)
        return answer_table(table, [known[np.searchsorted(part.keys[depth], k)] for k in keys])

    return answers


def gram_answers(blocks: Blocks, depth: int, least: int, folds: int, held_out: int) -> tuple[DataFrame, int]:
    """log10 probabilities of each block's keys (part, block, float32 by key), and the number of parts that a block asks."""
    n_parts = min(1 << 16, max(64, blocks.n_blocks // 6))
    fan = min(n_parts, blocks.fan)
    asked = blocks.work.keep(blocks.run(_gram_question(depth, folds, held_out, fan), QUESTION), "grams")
    exchange = Exchange(asked, blocks, n_parts, np.uint32, np.float32, _cut(depth))
    sums = exchange.run(_part_sums(depth, least), _SUMS).groupBy("byte").applyInArrow(_add_sums, _SUMS)
    top = build_top({row.byte: np.frombuffer(row.sums).reshape(3, 256) for row in sums.collect()}, least)
    shared = blocks.spark.sparkContext.broadcast(top)
    return blocks.work.keep(exchange.back(exchange.run(_part_answers(shared, depth, least))), "gram-chances"), fan


_COUNTS = f"{ANSWER}, n_tokens long, n_distinct long"
END_KEY = np.uint64(0xE4D)  # stands for the end among the words


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes and an end for each text, index of each text's first)."""
    out, first = [], [0]
    for begin, end in portions(texts):
        words = Words(texts[begin:end])
        hashes = words.hashes()
        out.append(np.insert(hashes, words.first[1:], END_KEY))
        first += (first[-1] + words.first[1:] + np.arange(1, end - begin + 1)).tolist()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(first)


def _word_question(folds: int, held_out: int, fan: int):
    def ask(table):
        block, ids, texts = in_order(table)
        keys, first = _keys([t.translate(LOWER) for t in texts])
        training = np.repeat([not is_held_out(i, folds, held_out) for i in ids], np.diff(first))
        distinct, inverse = np.unique(keys, return_inverse=True)
        return question(block, distinct, np.bincount(inverse, weights=training, minlength=len(distinct)).astype(np.uint32), fan)

    return ask


def _totals(table: pa.Table) -> pa.Table:
    keys, counts, _ = read_questions(table, np.uint32)
    names, n, _ = merge(keys, counts)
    small = n.max(initial=0) < 2**32
    out = answer_table(table, [n[np.searchsorted(names, k)].astype(np.uint32 if small else np.int64) for k in keys])
    once = lambda x: pa.array([int(x)] + [0] * (len(keys) - 1))
    return out.append_column("n_tokens", once(n.sum())).append_column("n_distinct", once((n > 0).sum()))


def _scoring(depth: int, gram_fan: int, folds: int, held_out: int, fan: int, n_tokens: int, n_distinct: int):
    def scores(table, answers):
        _, ids, texts = in_order(table)
        texts = [t.translate(LOWER) for t in texts]
        keys, first = _keys(texts)
        distinct, inverse = np.unique(keys, return_inverse=True)
        asked = dict(zip(answers["part"].to_pylist(), answers["answers"].to_pylist(), strict=True))
        count = answered(distinct, asked, fan, np.uint32)[inverse].astype(np.int64)
        tokens = np.diff(first)
        base = per_text(np.log10(count + 1.0), first) - tokens * np.log10(n_tokens + n_distinct + 1.0)
        grams = _block_grams(texts, depth)
        distinct = distinct_of(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in grams)]))
        log10 = answered(distinct, {-1 - part: data for part, data in asked.items()}, gram_fan, np.float32, _cut(depth))
        sizes = [np.fromiter((len(t) + 1 for t in texts[b:e]), np.int64, e - b) for b, e in portions(texts)]
        model = np.concatenate([np.zeros(0), *(per_text(log10[np.searchsorted(distinct, k)].astype(np.float64)[i], np.concatenate([[0], np.cumsum(n)])) for (k, i), n in zip(grams, sizes, strict=True))])
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        return pa.table(
            {
                "doc_id": pa.array(ids, table.schema.field("doc_id").type), "held_out": pa.array([is_held_out(i, folds, held_out) for i in ids], pa.bool_()),
                "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(per_text((count > 0).astype(np.int64), first).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), n_tokens, np.int64)),
                "base_score": pa.array(base), "score": pa.array(model), "bits_per_byte": pa.array(-model / size * np.log2(10)),
            }
        )

    return scores


def score(docs: DataFrame, *, id_col="doc_id", text_col="text", depth: int = 5, least: int = 2, folds: int = 7, held_out: int = 2, **sizes) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. sizes: of Blocks."""
    with Scratch(docs.sparkSession, "ctw") as work:
        blocks = Blocks(docs, id_col, text_col, work, **sizes)
        grams, gram_fan = gram_answers(blocks, depth, least, folds, held_out)
        fan = min(blocks.n_parts, blocks.fan)
        exchange = Exchange(blocks.run(_word_question(folds, held_out, fan), QUESTION), blocks, blocks.n_parts, np.uint32, np.uint32)
        totals = work.keep(exchange.run(_totals, _COUNTS), "word-counts")
        n_tokens, n_distinct = (x or 0 for x in totals.agg(F.sum("n_tokens"), F.sum("n_distinct")).first())
        kind = blocks.id_type
        answers = exchange.back(totals.select("part", "block", "answers")).unionByName(grams.withColumn("part", -1 - F.col("part")))
        scoring = _scoring(depth, gram_fan, folds, held_out, fan, n_tokens, n_distinct)
        schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
        return materialize(blocks.run(scoring, schema, answers), "ctw-result")


def op4_ctw(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"))
