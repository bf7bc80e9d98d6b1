"""Suffix-array dedup: bytes in strings of `length` bytes that occur elsewhere too are taken out, by longest-previous-factor arrays.

A window is a string of `length` bytes inside one document. Windows are dealt to buckets of the suffix order by a seed inside them: of the window's
strings of `seed` bytes that of the least hash (of equals, the first), which is the same wherever the window occurs, so that all windows that
could be equal meet. Neighbouring windows of one seed stand together as a *context*, the bytes that they cover (at most 2 * length of them).
So each byte is in few rows, and a row stands for some 75 windows.

Contexts are counted by seed and by the hash of their bytes, in Spark's groups. Seeds that occur once are out. A context that occurs
twice repeats all its windows, so copies are settled without their bytes. Only where a seed has several different contexts is the first of
each fetched and put into the suffix order: a bucket sorts the suffixes that begin at its windows (by doubling ranks), takes the common prefixes of neighbours, and in
each run of suffixes that share `length` bytes finds for each the previous and the next one of smaller position in suffix order. The longer of the two common
prefixes is the longest previous factor: where it reaches `length`, the window is a later copy, and the one that it leads to is an
earlier occurrence. Positions are ordered by document id, then block, text and place.

Seeds of more than `max_contexts` different contexts (the border of a passage that very many documents share) would make a bucket too large:
their windows become rows by two 64-bit hashes, and Spark's aggregation, which works in parts, gives each its smallest position.

Defined cases: null and empty texts have no windows, and neither have texts shorter than `length`; repeated rows and rows with equal ids
are documents each; null ids are first in the order of positions, ids that are not integers go by their hash; long texts are scanned in pieces; an
empty table gives no rows; further columns are ignored by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blocks import Blocks, in_order, runs, spread
from framelake.llm.common import Scratch, attach, materialize, read
from framelake.llm.words import mix

_STEP = 1 << 20  # windows that are looked at at once
_SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAAAD2A5C3B1F45B))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as far as they go."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,))


def _seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the `seed` bytes from each place on: of 8, 16, 32 ... bytes, joined where they overlap."""
    width, code = 8, mix(np.array(_eights(data)) + _SEEDS[0])
    while width < seed:
        step = min(width, seed - width)
        code = mix(code[:-step] * _SEEDS[1] + code[step:])
        width += step
    return code


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` hashes the place of the least by its upper half; of equals, the first."""
    low = np.uint64((1 << 32) - 1)
    best, width = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    return (best & low).astype(np.int64)


def string_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray | int, kind: int) -> np.ndarray:
    """Hashes of strings of size bytes, by 8 bytes at a time; zeros follow the end."""
    size = np.broadcast_to(np.asarray(size), begin.shape)
    pieces = _eights(np.concatenate([data, np.zeros(8, np.uint8)]))
    out = mix(size.astype(np.uint64) + _SEEDS[kind])
    low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    done = 0
    while len(more := np.flatnonzero(size > done)):
        at = begin[more] + done
        out[more] = mix(out[more] * _SEEDS[1 - kind] + (pieces[at] & low[np.minimum(size[more] - done, 8)]))
        done += 8
    return out


class Texts:
    """The texts of a block end to end, a byte between them."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if texts else np.zeros(0, np.int64)
        self.end = self.begin + sizes

    def contexts(self, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(key of the seed, first window, number of windows) of contexts, as places in the data."""
        span = length - seed + 1
        for at in range(0, len(self.data), _STEP):
            data = self.data[at : at + _STEP + length - 1]
            n = len(data) - length + 1
            if n <= 0:
                return
            change = np.zeros(n + 1, np.int64)
            near = slice(int(np.searchsorted(self.end, at)), int(np.searchsorted(self.begin, at + n)))
            first, last = (np.clip(x[near] - at, 0, n) for x in (self.begin, np.maximum(self.begin, self.end - length + 1)))
            np.add.at(change, first, 1)
            np.add.at(change, last, -1)
            inside = np.cumsum(change[:-1]) > 0
            if not inside.any():
                continue
            codes = _seed_hashes(data, seed)
            place = np.where(inside, _least(codes, span)[:n], -1)
            border = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            size = np.diff(np.append(border, n))
            held = place[border] >= 0
            yield mix(codes[place[border[held]]]), border[held] + at, size[held]


_CONTEXT = "block long, place int, key long, body long, start long, n int, times int, position long"


def _positions(ids: list) -> np.ndarray:
    """Of documents: integers as they are, others by hash; null ones first."""
    plain = lambda i: -(1 << 63) if i is None else i if isinstance(i, int) else int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest(), "big", signed=True)
    return np.array([plain(i) for i in ids], np.int64)


def _find(length: int, seed: int):
    def find(table):
        """A row for each context: its text in the block, seed, the hash of its bytes, first window, windows, how often it follows itself."""
        block, ids, raw = in_order(table)
        texts, columns = Texts(raw), [[] for _ in range(7)]
        position = _positions(ids)
        for key, first, n in texts.contexts(length, seed):
            body = string_hashes(texts.data, first, n + length - 1, 0)
            text = np.searchsorted(texts.begin, first, side="right") - 1
            # one string of a single byte after another: as one row
            alike = (key[1:] == key[:-1]) & (body[1:] == body[:-1]) & (n[1:] == 1) & (n[:-1] == 1) & (first[1:] == first[:-1] + 1)
            begin = np.flatnonzero(np.concatenate([[True], ~alike])[: len(key)])
            times = np.diff(np.append(begin, len(key)))
            for column, x in zip(columns, (text, key, body, first - texts.begin[text], n, position[text]), strict=False):
                column.append(x[begin])
            columns[6].append(times)
        text, key, body, start, n, position, times = (np.concatenate([np.zeros(0, np.int64).astype(x[0].dtype if x else np.int64), *x]) for x in columns)
        return pa.table(
            {
                "block": pa.array(np.full(len(text), block, np.int64)), "place": pa.array(text.astype(np.int32)), "key": pa.array(key.view(np.int64)), "body": pa.array(body.view(np.int64)),
                "start": pa.array(start), "n": pa.array(n.astype(np.int32)), "times": pa.array(times.astype(np.int32)), "position": pa.array(position),
            }
        )

    return find


def _smaller_before(common: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest suffix before of smaller position, or -1; the common prefix with it). common: with the one before, 0 where a run begins.

    Each suffix leads to one before it; while that is of larger position, it takes over where that one leads to, as all between are larger still.
    """
    near, shared = np.where(common > 0, np.arange(len(common)) - 1, -1), common.copy()
    wrong = np.flatnonzero(near >= 0)
    while len(wrong := wrong[position[near[wrong]] > position[wrong]]):
        over = near[wrong]
        near[wrong], shared[wrong] = near[over], np.minimum(shared[wrong], shared[over])
        wrong = wrong[near[wrong] >= 0]
    return near, np.where(near >= 0, shared, 0)


def previous_factors(common: np.ndarray, position: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, where in suffix order its earlier occurrence is, or -1) of suffixes in suffix order.

    common: with the suffix before; position: of the suffixes. Factors below `least` are nought: runs of suffixes that share as much stand for themselves.
    """
    factor, source = np.zeros(len(position), np.int64), np.full(len(position), -1)
    within = common >= least
    some = np.flatnonzero(within | np.append(within[1:], False)[: len(within)])
    if not len(some):
        return factor, source
    # the suffixes of runs alone; a run's first has nothing before it, and so nothing after the last one's end
    own, place = np.where(within, common, 0)[some], position[some]
    before, long = _smaller_before(own, place)
    after, size = _smaller_before(np.append(own[1:], 0)[::-1], place[::-1])
    after, size = np.where(after >= 0, len(some) - 1 - after, -1)[::-1], size[::-1]
    best = np.where(size > long, after, before)
    factor[some], source[some] = np.maximum(long, size), np.where(best >= 0, some[best], -1)
    return factor, source


def suffix_order(data: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes that begin at starts, their common prefix with the one before), both by `most` bytes; most: 8 or more.

    Ranks of strings of 8, 24, 72 ... bytes at all places, each from three of the one before; zeros follow the end of the data.
    """
    pieces = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    rank, levels, width = _ranks(np.array(_eights(pieces)).byteswap()), [], 8
    n_bits = np.uint64(len(rank).bit_length())
    while width < most:
        levels.append((width, rank))
        steps = [min(width, most - width), min(2 * width, most - width)] if 3 * n_bits <= 64 else [min(width, most - width)]
        end = len(rank) - steps[-1]
        code = rank[:end]
        for step in steps:
            code = code << n_bits | rank[step : step + end]
        width += steps[-1]
        rank = _ranks(code) if width < most else code  # the last one is only compared
    order = np.argsort(rank[starts], kind="stable")
    same = rank[starts[order]]
    first, second = starts[order][:-1], starts[order][1:]
    common = np.where(same[1:] == same[:-1], most, 0)
    for width, rank in reversed(levels):  # as often as it may fit
        for _ in range(2):
            open_ = np.flatnonzero(common + width <= most)
            open_ = open_[rank[first[open_] + common[open_]] == rank[second[open_] + common[open_]]]
            common[open_] += width
    for _ in range(7):  # what is left is shorter than 8 bytes
        open_ = np.flatnonzero(common < most)
        open_ = open_[pieces[first[open_] + common[open_]] == pieces[second[open_] + common[open_]]]
        common[open_] += 1
    return order, np.concatenate([[0], common])[: len(starts)]


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.uint64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])[: len(values)])
    return out


_MARKS = "block long, place int, start long, n int, marks binary"  # no marks: all windows


def _bucket(length: int):
    def judge(table):
        """The windows of a bucket's contexts that occur elsewhere in it: a flag, and whether they are later copies."""
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "start": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "marks": pa.array([], pa.binary())})
        block, place, start, n, position = (table[c].to_numpy() for c in ("block", "place", "start", "n", "position"))
        bodies = table["bytes"].to_pylist()
        data = np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.cumsum([0, *map(len, bodies)])[:-1]
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((start, place, block, position))] = np.arange(len(n))
        order, common = suffix_order(data, begin[owner] + within, length)
        factor, source = previous_factors(common, (rank[owner] << 32 | within)[order], length)
        later = np.flatnonzero(factor >= length)
        flags = np.zeros(len(owner), np.uint8)
        flags[order[source[later]]] |= 1
        flags[order[later]] |= 3
        marks = [flags[e - k : e].tobytes() for k, e in zip(n.tolist(), np.cumsum(n).tolist(), strict=True)]
        some = np.array([any(m) for m in marks], bool)
        out = pa.table({"block": pa.array(block), "place": pa.array(place.astype(np.int32)), "start": pa.array(start), "n": pa.array(n.astype(np.int32)), "marks": pa.array(marks, pa.binary())})
        return out.filter(pa.array(some))

    return judge


def _fetch(length: int):
    def fetch(table, wanted):
        """The bytes of the contexts asked for."""
        _, _, texts = in_order(table)
        places = zip(*(wanted[c].to_pylist() for c in ("place", "start", "n")), strict=True)
        return wanted.select(["bucket", "block", "place", "start", "n", "position"]).append_column("bytes", pa.array([texts[i][s : s + n + length - 1] for i, s, n in places], pa.binary()))

    return fetch


def _windows_of(length: int):
    def cut(table, wanted):
        """A row for each window of the contexts asked for, by two hashes."""
        _, _, raw = in_order(table)
        texts = Texts(raw)
        block, place, start, n, position = (wanted[c].to_numpy() for c in ("block", "place", "start", "n", "position"))
        owner = np.repeat(np.arange(len(n)), n)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = texts.begin[place[owner]] + at if len(owner) else at.astype(np.int64)
        hashes = [string_hashes(texts.data, begin, length, kind).view(np.int64) for kind in (0, 1)]
        return pa.table({"one": pa.array(hashes[0]), "two": pa.array(hashes[1]), "position": pa.array(position[owner]), "block": pa.array(block[owner]), "place": pa.array(place[owner].astype(np.int32)), "start": pa.array(at.astype(np.int64))})

    return cut


def _marks(blocks: Blocks, length: int, seed: int, max_contexts: int, bucket_contexts: int) -> DataFrame:
    """The windows that occur more than once, by block: (block, place, start, n, marks)."""
    work = blocks.work
    found = work.keep(blocks.run(_find(length, seed), _CONTEXT), "contexts")
    which = F.struct("position", "block", "place", "start")
    kinds = found.groupBy("key", "body").agg(F.sum("times").alias("k"), F.count("*").alias("rows"), F.min(F.struct("position", "block", "place", "start", "n")).alias("first"))
    kinds = work.keep(kinds, "kinds")
    seeds = kinds.groupBy("key").agg(F.sum("k").alias("all"), F.count("*").alias("contexts")).where("all > 1")
    kinds = work.keep(attach(kinds, work.keep(seeds.withColumn("own", F.col("contexts")), "seeds"), "key", "own"), "repeated")

    again = work.keep(kinds.where("k > 1").select("key", "body", "first", "rows"), "again")
    copies = attach(found, again, ["key", "body"], "rows")
    none = F.lit(None).cast("binary")
    first = lambda found: F.struct("position", "block", "place", "start") == F.struct(*(found[c] for c in ("position", "block", "place", "start")))
    # copies of one context: all windows are repeated, and later but in the first row; a row that follows itself is later from its second window on
    flags = lambda one, rest: F.unhex(F.concat(F.lit(one), F.repeat(F.lit(rest), F.col("times") - 1)))
    whole = copies.select("block", "place", "start", F.when(F.col("times") > 1, F.col("times")).otherwise(F.col("n")).alias("n"), F.when(~first(F.col("first")), none).when(F.col("times") > 1, flags("01", "03")).otherwise(F.unhex(F.repeat(F.lit("01"), F.col("n")))).alias("marks"))

    several = work.keep(kinds.where("contexts > 1").select("key", "contexts", "first.*"), "several")
    n_buckets = max(16, several.count() // bucket_contexts)
    usual = several.where(F.col("contexts") <= max_contexts).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)))
    fetched = blocks.run(_fetch(length), "bucket long, block long, place int, start long, n int, position long, bytes binary", usual.select("bucket", "block", "place", "start", "n", "position"))
    judged = spread(fetched, "bucket", n_buckets).groupBy("bucket").applyInArrow(_bucket(length), _MARKS)

    hot = several.where(F.col("contexts") > max_contexts)
    if hot.limit(1).count():
        windows = work.keep(blocks.run(_windows_of(length), "one long, two long, position long, block long, place int, start long", hot.select("block", "place", "start", "n", "position")), "windows")
        least = windows.groupBy("one", "two").agg(F.min(which).alias("first"), F.count("*").alias("k")).where("k > 1")
        met = attach(windows, work.keep(least, "equal"), ["one", "two"], "k")
        judged = judged.union(met.select("block", "place", "start", F.lit(1).alias("n"), F.when(first(F.col("first")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("03"))).alias("marks")))
    return work.keep(whole.union(judged), "marks")


def _covered(size: int, marks: list[tuple], length: int, keep: str) -> np.ndarray:
    """The bytes of a text in windows that go."""
    change = np.zeros(size + 1, np.int64)
    wanted = 1 if keep == "none" else 2
    for start, n, data in marks:
        own = np.arange(n) if data is None else np.flatnonzero(np.frombuffer(data, np.uint8) & wanted)
        np.add.at(change, start + own, 1)
        np.add.at(change, start + own + length, -1)
    return np.cumsum(change[:-1]) > 0


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def repeated_bytes(docs: DataFrame, *, id_col="doc_id", text_col="text", length: int = 200, keep: str = "first", with_text: bool = False, seed: int = 48, max_contexts: int = 5_000, bucket_contexts: int = 6_000, **sizes) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, start, end ... of removed bytes), and kept (binary) if asked for.

    keep: `first` leaves each string's first occurrence, `none` removes all of them. length: 16 or more; sizes: of Blocks.
    """
    seed = min(seed, length // 2)
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(table, marks):
        _, ids, texts = in_order(table)
        order = np.argsort(marks["place"].to_numpy(), kind="stable")
        places, begin, end = runs(marks["place"].to_numpy()[order])
        marks = marks.take(pa.array(order))
        columns = [marks[c].to_pylist() for c in ("start", "n", "marks")]
        own = {p: list(zip(*(c[b:e] for c in columns), strict=True)) for p, b, e in zip(places.tolist(), begin.tolist(), end.tolist(), strict=True)}
        rows = []
        for i, text in enumerate(texts):
            if i not in own:
                rows.append((len(text), 0, [], text))
                continue
            covered = _covered(len(text), own[i], length, keep)
            first, last = _spans(covered)
            rows.append((len(text), int(covered.sum()), np.column_stack([first, last]).ravel().tolist(), np.frombuffer(text, np.uint8)[~covered].tobytes()))
        n, gone, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        out = {"doc_id": pa.array(ids, kind_of(table)), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(s) // 2 for s in spans], pa.int64())}
        out |= {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "spans": pa.array(spans, pa.list_(pa.int64()))}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    def kind_of(table):
        return table.schema.field("doc_id").type

    with Scratch(docs.sparkSession, "suffix") as work:
        blocks = Blocks(docs, id_col, text_col, work, **sizes)
        marks = _marks(blocks, length, seed, max_contexts, bucket_contexts)
        schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept binary" * with_text
        return materialize(blocks.run(finish, schema, marks), "suffix-result")


def op12_suffix_dedup(spark, sf_dir):
    return repeated_bytes(read(spark, sf_dir, "documents"), keep="none").drop("spans")


#: Texts in pieces of 1,000 bytes, in which a window is found without counting from the text's begin.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, g, substr(h, (g * 2000 + 1)::BIGINT, 2400) AS s FROM d, unnest(range(0, length(h) // 2000 + 1)) AS t(g)),
w AS MATERIALIZED (SELECT r, g * 1000 + j AS i, md5(substr(s, (2 * j + 1)::BIGINT, 400)) AS m FROM c, unnest(range(0, 1000)) AS t(j) WHERE 2 * j + 400 <= length(s)),
a AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM a),
s AS (SELECT r, k, min(i) AS b, max(i) + 200 AS e FROM n GROUP BY r, k),
p AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS f FROM s),
q AS (SELECT r, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, max(e) AS last, string_agg(substr(h, (2 * f + 1)::BIGINT, (2 * (b - f))::BIGINT), '' ORDER BY b) AS kept FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256 FROM d LEFT JOIN q USING (r)
"""
