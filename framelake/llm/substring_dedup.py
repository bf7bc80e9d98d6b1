"""Substring dedup by level-wise doubling: words in runs of `length` words that occur elsewhere too are taken out.

Candidates are the windows of `length` words, judged level by level at lengths that double (9, 18, 35 for 35). At each level but
the last a window stands or falls with one shorter window inside it: the one of the least hash (winnowing), which is the same
wherever the long window occurs. Windows repeated at one length are extended to twice that length, the others
are out; where no candidates survive, the later levels ask nothing. Each level leaves its survivors as bits beside the blocks, so that the next one
looks at them alone. At the full length every surviving window is asked about itself, by two independent 64-bit hashes of its words
together, so that among 10^13 windows a false removal has a chance below 10^-12. How often keys occur is counted over all documents (see blocks.py).

All occurrences of a repeated window go, the first too. Windows lie within one document and are judged on the input.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; repeated rows count as
repeats of each other; null ids are kept; an empty table gives no rows; further columns are ignored by the report.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm.blocks import ANSWER, QUESTION, Blocks, Exchange, answered, in_order, merge, pack, places, question, repeated, unpack, word_hashes
from framelake.llm.common import Scratch, materialize, read
from framelake.llm.words import distinct, mix, runs

_PLACE = np.uint64((1 << 32) - 1)
SURVIVORS = -1  # as a part: bits of the windows that survive


def levels(length: int) -> list[int]:
    out = [length]
    while out[0] > 9:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` hashes the place of the least (by its upper 32 bits; of equals, the first)."""
    best, width = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    return (best & _PLACE).astype(np.int64)


class _Windows:
    """The windows of a block's texts."""

    def __init__(self, texts: list[bytes], length: int, hash_bits: int):
        self.texts, self.length, self.mask = texts, length, np.uint64((1 << hash_bits) - 1)
        self.hashes, self.first = word_hashes(texts)
        self.n = len(self.hashes)

    def starts(self) -> np.ndarray:
        """Of all windows that lie within one text."""
        change = np.zeros(self.n + 1, np.int64)
        begin, end = self.first[:-1], self.first[1:] - self.length + 1
        some = end > begin
        np.add.at(change, begin[some], 1)
        np.add.at(change, end[some], -1)
        return np.flatnonzero(np.cumsum(change[:-1]))

    def located(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Where the run of `size` words is that stands for each window."""
        return starts if size == self.length or not len(starts) else _least(runs(self.hashes, size), self.length - size + 1)[starts]

    def keys(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The keys of runs, and at the full length their second hashes."""
        second = runs(word_hashes(self.texts if len(at) else [], kind=1)[0], size)[at] if size == self.length else None
        # mixed again: the least of many hashes are small, and ranges of keys are to be of equal weight
        return mix(runs(self.hashes, size)[at]) & self.mask, second

    def asked(self, at: np.ndarray, size: int) -> tuple:
        """(distinct keys, whether the block has them at two places, second hashes)."""
        keys, second = self.keys(distinct(at), size)
        return merge([keys], [np.zeros(len(keys), bool)], None if second is None else [second])

    def survivors(self, found: pa.Table, size: int | None, fan: int) -> np.ndarray:
        """The windows that survive the level of `size`, from the survivors before it and the answers to it; all of them before any level."""
        rows = dict(zip(found["part"].to_pylist(), found["answers"].to_pylist(), strict=True))
        before = rows.pop(SURVIVORS, None)
        starts = self.starts() if before is None else np.flatnonzero(unpack(before, self.n, bool))
        if size is None or not len(starts):
            return starts
        at = self.located(starts, size)
        known, _, more = self.asked(at, size)
        return starts[answered(known, rows, fan, bool)[places(known, more, *self.keys(at, size))]]


def _ask(length: int, size: int, before: int | None, fan: int, hash_bits: int):
    def ask(table, found):
        """The question of the level of `size`, and the survivors of the level before."""
        block, _, texts = in_order(table)
        windows = _Windows(texts, length, hash_bits)
        starts = windows.survivors(found, before, fan)
        out = question(block, *(known := windows.asked(windows.located(starts, size), size))[:2], fan, extra=known[2])
        if before is None:
            return out
        bits = np.zeros(windows.n, bool)
        bits[starts] = True
        kept = pa.table([pa.array([x], t) for x, t in zip((SURVIVORS, block, None, None, pack(bits)), out.schema.types, strict=True)], out.schema.names)
        return pa.concat_tables([out, kept])

    return ask


def _removal(docs: DataFrame, id_col: str, text_col: str, length: int, finish, schema: str, hash_bits: int, **sizes) -> DataFrame:
    with Scratch(docs.sparkSession, "substring") as work:
        blocks = Blocks(docs, id_col, text_col, work, **sizes)
        fan = min(blocks.n_parts, blocks.fan)
        known, before = None, None
        for size in levels(length):
            ask = _ask(length, size, before, fan, hash_bits)
            asked = blocks.run(ask, QUESTION, known) if before else blocks.run(lambda table: ask(table, _NOTHING), QUESTION)  # noqa: B023
            asked = work.keep(asked, f"asked-{size}") if before else asked
            exchange = Exchange(asked.where(f"part != {SURVIVORS}"), blocks, blocks.n_parts, bool, bool)
            known = exchange.back(exchange.run(repeated))
            if before:
                known = known.union(asked.where(f"part = {SURVIVORS}").selectExpr("part", "block", "counts as answers"))
            known, before = work.keep(known, f"repeated-{size}"), size

        def take_out(table, found):
            _, ids, texts = in_order(table)
            windows = _Windows(texts, length, hash_bits)
            starts = windows.survivors(found, length, fan)
            change = np.zeros(windows.n + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
            covered = np.cumsum(change[:-1]) > 0
            return finish(ids, texts, [covered[b:e] for b, e in zip(windows.first[:-1], windows.first[1:], strict=True)], table.schema.field("doc_id").type)

        return materialize(blocks.run(take_out, schema, known), "substring-result")


_NOTHING = pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "answers": pa.array([], pa.binary())})


def repeated_runs(docs: DataFrame, *, id_col="doc_id", text_col="text", length: int = 35, with_text: bool = False, hash_bits: int = 64, **sizes) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and, if asked for, kept_text.

    hash_bits: of the first hash (fewer cost more candidates, never other results); sizes: of Blocks.
    """

    def finish(ids, texts, covered, kind):
        rows = []
        for text, gone in zip(texts, covered, strict=True):
            words = text.split()
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
        n_words, n_removed, digest, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = {"doc_id": pa.array(ids, kind), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array([k.decode() for k in kept], pa.string())} if with_text else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    return _removal(docs, id_col, text_col, length, finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, hash_bits, **sizes)


def op7_substring_dedup(spark, sf_dir):
    return repeated_runs(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
m AS (SELECT r, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, p FROM m, unnest(range(i, i + 35)) AS t(p)),
x AS (SELECT r, count(*) AS n, list(p) AS ps FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN x USING (r)
"""
