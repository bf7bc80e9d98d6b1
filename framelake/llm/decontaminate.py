"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training token window.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is `n` consecutive words of a
benchmark item; an item of fewer words (but not none) is one window. A document word inside an occurrence of a window
is hit. A document is contaminated if n_hit > 0 and share * n_hit >= n_words.

The set is broadcast only up to `max_set_bytes`. A larger benchmark is dealt into that many blocks by the window's
hash, and the documents are scanned once for each block, their hits carried along in a column. No shuffle of documents.

Defined cases: null and empty texts have no words, no hits and are not contaminated; null item texts are ignored; a
null item_id is the item ""; repeated rows are judged one by one; an empty benchmark hits nothing; further columns
are ignored by `contamination` and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, materialize, rows_of, ship, utf8

_WORD_BYTES = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: For UTF-8 bytes: A-Z to a-z, what is no part of a word to a space.
NORMALISE = bytes(_WORD_BYTES[LOWER[b]] for b in range(256))
_SPANS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | bytes | None) -> list[bytes]:
    return utf8(text).translate(NORMALISE).split()


def item_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window binary: its words joined by spaces; item string), distinct."""

    def windows(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                size = min(n, len(found))
                if size:
                    out += {(b" ".join(found[i : i + size]), item or "") for i in range(len(found) - size + 1)}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], ["window", "item"])

    picked = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(windows, "window binary, item string").distinct()


class WindowSet:
    """A hash set of windows by their length, with the words themselves to verify hits."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[int, dict[tuple, set[str]]]] = {}
        for window, item in rows:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.split(b" "))
            of_length = self.by_length.setdefault(len(ids), {})
            code = int(self._codes(np.array(ids, np.uint64), np.zeros(1, np.int64), len(ids))[0])
            of_length.setdefault(code, {}).setdefault(ids, set()).add(item)
        self.codes = {size: np.sort(np.fromiter(x, np.uint64, len(x))) for size, x in self.by_length.items()}

    @staticmethod
    def _codes(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        code = np.zeros(len(starts), np.uint64)
        for k in range(size):
            code = (code + ids[starts + k]) * _MULTIPLIER
            code ^= code >> np.uint64(29)
        return code

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Verified occurrences as (first word, word after the last), and the items that they belong to."""
        spans, items = [], set()
        if not self.vocabulary:
            return spans, items
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.uint64, len(found))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, codes in self.codes.items():
            if len(found) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            code = self._codes(ids, starts, size)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            for start, c in zip(starts[hit].tolist(), code[hit].tolist(), strict=True):
                owners = self.by_length[size][c].get(tuple(ids[start : start + size].tolist()))
                if owners:
                    spans.append((start, start + size))
                    items |= owners
        return spans, items


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _sets(benchmark: DataFrame, n: int, max_set_bytes: int, item_id: str, item_text: str) -> list:
    """The windows in broadcasts of at most max_set_bytes each, as they are held in memory."""
    spark = benchmark.sparkSession
    windows = materialize(item_windows(benchmark, n, item_id, item_text), "item-windows")
    # 40 bytes a word and 400 a window is what the set takes in Python
    need = windows.agg(F.sum(F.octet_length("window") * 6 + 400)).first()[0] or 0
    blocks = max(1, math.ceil(need / max_set_bytes))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    for block in range(blocks):
        rows = [(bytes(r[0]), r[1]) for r in dealt.where(F.col("block") == block).select("window", "item").toLocalIterator()]
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, rows)), block + 1 == blocks


_loaded: dict[str, WindowSet] = {}


def _window_set(shared) -> WindowSet:
    """Built once in each Python worker, by the broadcast's own name: an address can be that of an earlier list again."""
    key, rows = shared.value
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WindowSet(rows)
    return _loaded[key]


def _scan(docs: DataFrame, text_at: int, benchmark: DataFrame, n: int, max_set_bytes: int, item_id: str, item_text: str, finish, schema) -> DataFrame:
    """finish(batch of docs, texts, hit word spans, items) for each batch, after all blocks of the set have been looked for.

    All but the last block leave their hits in two more columns: spans (start, end, start, end ...) and items.
    """
    ship(docs.sparkSession)
    width = len(docs.columns)
    state = docs.toDF(*(f"c{i}" for i in range(width)))
    for shared, last in _sets(benchmark, n, max_set_bytes, item_id, item_text):

        def look(batches, shared=shared, last=last):
            known = _window_set(shared)
            for batch in batches:
                texts, spans, items = batch.column(text_at).to_pylist(), [], []
                before = zip(*(batch.column(c).to_pylist() for c in (width, width + 1)), strict=True) if batch.num_columns > width else repeat(((), ()))
                for text, (s, i) in zip(texts, before):
                    found, owners = known.find(words(text))
                    spans.append([x for span in _merged([*found, *zip(s[::2], s[1::2], strict=True)]) for x in span])
                    items.append(sorted({*i, *owners}))
                rows = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
                if last:
                    yield finish(rows, texts, spans, items)
                else:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [*rows.schema.names, "spans", "items"])

        if last:
            return state.mapInArrow(look, schema(state.select(*state.columns[:width]).schema) if callable(schema) else schema)
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields[:width])
        state = materialize(state.mapInArrow(look, f"{kept}, spans array<int>, items array<string>"), "hits")
    raise AssertionError("there is a last block")


def _judge(n_words: int, spans: list[int], share: int) -> tuple[int, bool]:
    n_hit = sum(spans[1::2]) - sum(spans[::2])
    return n_hit, n_hit > 0 and share * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", n: int = 13, share: int = 20, max_set_bytes: int = 200_000_000) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (of words)."""
    def report(batch, texts, spans, items):
        rows = []
        for text, own, owners in zip(texts, spans, items, strict=True):
            total = len(words(text))
            n_hit, bad = _judge(total, own, share)
            rows.append((total, n_hit, len(owners), hashlib.sha256(",".join(owners).encode()).hexdigest(), bad))
        columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<int>"
    return _scan(docs.select(F.col(id_col), F.col(text_col).cast("binary")), 1, benchmark, n, max_set_bytes, item_id, item_text, report, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col="text", item_id="item_id", item_text="text", n: int = 13, share: int = 20, mode: str = "documents", max_set_bytes: int = 200_000_000) -> DataFrame:
    """docs, its columns unchanged, without contaminated documents (`documents`), or without the hit words (`spans`)."""
    text_at = docs.columns.index(text_col)

    def apply(batch, texts, spans, items):
        keep = [not (mode == "documents" and own and _judge(len(words(text)), own, share)[1]) for text, own in zip(texts, spans, strict=True)]
        columns = list(batch.columns)
        if mode == "spans":
            columns[text_at] = pa.array([_without(t, own) if own else t for t, own in zip(texts, spans, strict=True)], columns[text_at].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, text_at, benchmark, n, max_set_bytes, item_id, item_text, apply, lambda same: same).toDF(*docs.columns)


def _without(text: str, spans: list[int]) -> str:
    data = text.encode()
    at = [m.span() for m in _SPANS.finditer(data)]
    out, done = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, data[done:]]).decode()


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT r, dw.size, i, item FROM dw JOIN bw USING (size, g)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hits), unnest(range(i, i + size)) AS t(p) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


def op3_decontaminate(spark, sf_dir):
    from framelake.llm.common import read

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hit_spans")
