"""Documents in blocks, and exact questions about keys over all blocks.

A block is a few megabytes of whole documents, chosen by a hash of id, text and source partition (so that repeated rows spread). The blocks are
written once as a bucketed table of at most `max_buckets` buckets, so that each later pass over them needs no shuffle of texts.

A pass computes keys (64-bit hashes) from its block and asks about them: the sorted distinct keys of each range of keys go as one binary
column, with a flag (the block has it twice) or a count for each, and the answer comes back as a bit or a number for each key in the same order. So a
question costs 8 bytes a key to shuffle, an answer a bit. A key may carry a second, independent hash (`extra`) that decides with it.

Blocks and ranges both grow with the corpus, and rows of questions with their product. So beyond `fan` blocks a question goes in two hops: a block
asks about `fan` wide ranges; the questions of `fan` neighbouring blocks about one wide range are merged, and these are dealt to the
narrow ranges, which alone see all keys. Answers take the same way back. Each group that a task holds is then of a bounded number of keys at every size.

The table and all that is kept between passes belong to a Scratch and go with it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, give_back, ship, text_bytes, utf8
from framelake.llm.words import Words, portions

QUESTION = "part int, block long, keys binary, extra binary, counts binary"
ANSWER = "part int, block long, answers binary"


class Blocks:
    """The table of blocks: block, doc_id, text (binary)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, work: Scratch, *, block_bytes: int = 8_000_000, keys_per_part: int = 4_000_000, max_buckets: int = 50_000, fan: int = 4_096, measured: tuple[int, int] | None = None):
        """measured: bytes and rows at most, where the caller knows them without a scan of docs."""
        self.spark, self.work, self.fan = docs.sparkSession, work, fan
        ship(self.spark)
        total, n_rows = measured or text_bytes(docs, text_col)
        self.n_blocks = max(1, math.ceil(total / block_bytes), math.ceil(n_rows / 100_000))
        #: ranges of keys, for at most one key in four bytes of text
        self.n_parts = max(64, math.ceil(total / 4 / keys_per_part))
        self.id_type = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(self.n_blocks)))
        self.name = work.bucketed(rows, "block", max(1, min(max_buckets, math.ceil(self.n_blocks / 2))))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def run(self, function, schema: str, answers: DataFrame | None = None) -> DataFrame:
        """function(block table[, answers of the block]) -> Arrow table, for each block."""

        def alone(table):
            out = function(table)
            give_back()
            return out

        def answered_too(table, found):
            out = function(table, found)
            give_back()
            return out

        if answers is None:
            return self.table().groupBy("block").applyInArrow(alone, schema)
        return self.table().groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answered_too, schema)


def in_order(table: pa.Table) -> tuple[int, list, list[bytes]]:
    """(block, ids, texts), in the same order in each pass."""
    ids, texts = table["doc_id"].to_pylist(), [utf8(t) for t in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, texts[i]))
    return (table["block"][0].as_py() if table.num_rows else -1), [ids[i] for i in order], [texts[i] for i in order]


def word_hashes(texts: list[bytes], kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word and the end)."""
    hashes, first = [np.zeros(0, np.uint64)], [0]
    for begin, end in portions(texts):
        words = Words(texts[begin:end])
        hashes.append(words.hashes(kind))
        first += (first[-1] + words.first[1:]).tolist()
    return np.concatenate(hashes), np.array(first)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, begin, end) of the runs of equal values."""
    values, begin = np.unique(sorted_values, return_index=True)
    return values, begin, np.append(begin[1:], len(sorted_values))[: len(begin)]


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def pack_keys(keys: np.ndarray) -> bytes:
    """Byte by byte, the highest bytes of all keys first: sorted keys share these, so they take little room when compressed."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def pack(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes() if values.dtype == bool else values.tobytes()


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    """n flags, or numbers of a kind or, where they are twice as long, 64-bit ones."""
    if kind is bool:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    return np.frombuffer(data, np.int64 if len(data) == 8 * n and np.dtype(kind).itemsize < 8 else kind)


def merge(keys: list[np.ndarray], counts: list[np.ndarray], extra: list[np.ndarray] | None = None) -> tuple:
    """(distinct keys in order, their counts summed or whether one has it twice or several have it[, extra])."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    more = np.concatenate(extra) if extra else None
    order = np.argsort(all_keys, kind="stable") if more is None else np.lexsort((more, all_keys))
    all_keys, all_counts = all_keys[order], all_counts[order]
    if not len(all_keys):
        return all_keys, all_counts, more
    new = all_keys[1:] != all_keys[:-1]
    if more is not None:
        more = more[order]
        new |= more[1:] != more[:-1]
    begin = np.flatnonzero(np.concatenate([[True], new]))
    if all_counts.dtype == bool:
        total = np.logical_or.reduceat(all_counts, begin) | (np.diff(np.append(begin, len(all_keys))) > 1)
    else:
        total = np.add.reduceat(all_counts.astype(np.int64), begin)
    return all_keys[begin], total, None if more is None else more[begin]


def places(known: np.ndarray, known_extra: np.ndarray | None, keys: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
    """Where keys that are all known are among the known ones."""
    at = np.searchsorted(known, keys)
    if extra is not None:
        while len(wrong := np.flatnonzero(known_extra[at] != extra)):
            at[wrong] += 1
    return at


def by_range(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)


def question(block: int, keys: np.ndarray, counts: np.ndarray, n_parts: int, cut=by_range, extra: np.ndarray | None = None) -> pa.Table:
    """What a block asks about its sorted distinct keys, dealt to parts."""
    order, used, begin, end = dealt(keys, n_parts, cut)
    keys, counts, extra = (None if x is None else x[order] for x in (keys, counts, extra))
    pairs = list(zip(begin.tolist(), end.tolist(), strict=True))
    columns = [pa.array([None if x is None else f(x[b:e]) for b, e in pairs], pa.binary()) for x, f in ((keys, pack_keys), (extra, pack), (counts, pack))]
    return pa.table([pa.array(used), pa.array(np.full(len(used), block)), *columns], ["part", "block", "keys", "extra", "counts"])


def dealt(keys: np.ndarray, n_parts: int, cut=by_range) -> tuple:
    """(order of the keys by part, parts, begin, end)."""
    part = cut(keys, n_parts)
    order = np.argsort(part, kind="stable")
    used, begin, end = runs(part[order])
    return order, used.astype(np.int32), begin, end


def answered(keys: np.ndarray, answers: dict[int, bytes], n_parts: int, kind, cut=by_range) -> np.ndarray:
    """The answers about a block's sorted distinct keys, by part, in the order of the keys."""
    order, *cuts = dealt(keys, n_parts, cut)
    out = np.zeros(len(keys), kind)
    for part, b, e in zip(*cuts, strict=True):
        own = unpack(answers[int(part)], e - b, kind)
        out = out.astype(own.dtype) if own.dtype.itemsize > out.dtype.itemsize else out
        out[order[b:e]] = own
    return out


def read_questions(table: pa.Table, kind) -> tuple[list, list, list | None]:
    """(keys, counts, extra) of each row."""
    keys = [unpack_keys(k) for k in table["keys"].to_pylist()]
    counts = [unpack(c, len(k), kind) for k, c in zip(keys, table["counts"].to_pylist(), strict=True)]
    extra = [None if x is None else np.frombuffer(x, np.uint64) for x in table["extra"].to_pylist()]
    return keys, counts, extra if extra and extra[0] is not None else None


def answer_table(table: pa.Table, answers: list[np.ndarray]) -> pa.Table:
    return pa.table({"part": table["part"], "block": table["block"], "answers": pa.array([pack(a) for a in answers], pa.binary())})


def repeated(table: pa.Table) -> pa.Table:
    """The answer whether keys occur more than once over all blocks."""
    keys, counts, extra = read_questions(table, bool)
    known, twice, more = merge(keys, counts, extra)
    return answer_table(table, [twice[places(known, more, k, x)] for k, x in zip(keys, extra or [None] * len(keys), strict=True)])


def spread(df: DataFrame, key: str, n_groups: int) -> DataFrame:
    """df by key in as many partitions as its groups need, where the session has fewer."""
    return df if n_groups <= 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n_groups // 4, key)


class Exchange:
    """Questions on their way to the parts, in one hop or two, and the answers back.

    asked: what question() made for min(n_parts, fan) parts; count, answer: kinds of both numbers (bool for flags).
    """

    def __init__(self, asked: DataFrame, blocks: Blocks, n_parts: int, count, answer, cut=by_range):
        self.asked, self.answer = asked, answer
        self.hops = 1 if blocks.n_blocks <= blocks.fan else 2
        if self.hops == 1:
            self.parts = spread(asked, "part", n_parts)
            return
        fan = blocks.fan
        self.n_relays = math.ceil(blocks.n_blocks / fan) * fan
        kept = blocks.work.keep(asked, "asked").withColumn("relay", F.floor(F.col("block") / fan) * fan + F.col("part"))
        self.asked = spread(kept, "relay", self.n_relays)

        def relay(table):
            known, total, more = merge(*read_questions(table, count))
            return question(table["relay"][0].as_py(), known, total, n_parts, cut, more)

        self.parts = spread(blocks.work.keep(self.asked.groupBy("relay").applyInArrow(relay, QUESTION), "merged"), "part", n_parts)
        self.cut, self.n_parts, self.count = cut, n_parts, count

    def run(self, function, schema: str = ANSWER) -> DataFrame:
        """function(all questions of a part) -> Arrow table."""
        return self.parts.groupBy("part").applyInArrow(function, schema)

    def back(self, answers: DataFrame) -> DataFrame:
        """(part, block, answers) as the blocks asked."""
        if self.hops == 1:
            return answers
        count, kind, n_parts, cut = self.count, self.answer, self.n_parts, self.cut

        def spread_out(table, found):
            keys, counts, extra = read_questions(table, count)
            if not keys:
                return pa.table({"part": table["part"], "block": table["block"], "answers": pa.array([], pa.binary())})
            known, _, more = merge(keys, counts, extra)
            values = answered(known, dict(zip(found["part"].to_pylist(), found["answers"].to_pylist(), strict=True)), n_parts, kind, cut)
            return answer_table(table, [values[places(known, more, k, x)] for k, x in zip(keys, extra or [None] * len(keys), strict=True)])

        return self.asked.groupBy("relay").cogroup(spread(answers, "block", self.n_relays).groupBy("block")).applyInArrow(spread_out, ANSWER)
