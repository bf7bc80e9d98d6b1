"""Packing: documents into windows of `capacity` tokens by online sum-of-squares placement.

Each task tokenizes the documents of its partition and packs them as they come, without any shuffle: packing is online,
so one pass over the scan suffices, and no task sees more than its own partition. A level array counts the partly
filled windows by fill level (classes of `grain` tokens). For each document the packer takes, of all levels into which
it fits, the one that makes the sum of squared counts least, counting a new window as a level too. Where that leaves a
level crowded, the document is cut to complete one of its windows instead, which the same sum decides with a penalty for
the cut; so the open windows stay few for every distribution of lengths. A window left with less than a grain is topped
up with the head of the next document. At a partition's end the open windows are joined end to end, cutting
freely; the last window becomes sequences of power-of-two lengths, which need no padding.

Defined cases: a null text is the empty text, one end id alone; a document longer than a window fills whole windows
first; null ids and repeated rows are packed like all others; an empty table gives no rows; further columns are
ignored. Results are determined by the order of the rows within a partition.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, give_back, read, ship, single_threaded, utf8


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: What the vocabulary's pattern parts lower-cased ASCII into, where no apostrophe begins an ending.
_RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: A capital before what may be a mark, with which only its small letter may compose; all marks come from U+0300 on.
_CAPITAL_AND_MARK = re.compile(rb"[A-Z][\xcc-\xf4]")
#: Signs and the one letter that becomes two when it is lower-cased, of U+00C0 to U+017F.
_NO_LETTERS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def _ends_in_letter(word: bytes) -> bool:
    """Of a-z and the Latin letters below U+0180: others may turn into a letter and a sign when they are lower-cased."""
    return bool(word) and (97 <= word[-1] <= 122 or (len(word) > 1 and 0xC3 <= word[-2] <= 0xC5 and word[-2:] not in _NO_LETTERS))


def slices(strings: pa.Array, borders: np.ndarray) -> list[bytes]:
    """The strings of an array of a large type, those between two borders joined."""
    _, ends, data = strings.buffers()
    if not len(strings) or not data:
        return [b""] * (len(borders) - 1)
    data = data.to_pybytes()
    return [data[i:j] for i, j in pairwise(np.frombuffer(ends, "<i8")[borders].tolist())]


class WordTokenizer(dict):
    """Ids of whole texts by a tokenizer that drops white space: a chunk between white space is encoded when it is first asked for, and kept.

    Only true for byte-level tokenizers that lower-case and split at white space and between letters and other signs before merging, as
    this vocabulary's does; `tests/llm/test_packing.py` compares it with the plain tokenizer. A word of letters in normal form goes to the
    merges at once. Special tokens count as the tokenizer's file says: where their names are written exactly, before lower-casing.
    Keys are chunks, values their ids as little-endian unsigned 32-bit numbers; when they are max_cached they become the older ones, which
    go at the next turn but for those asked for again. Two tasks of an executor hold such a cache each, beside its heap: so it is small.
    """

    def __init__(self, path: str, max_cached: int = 100_000):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: names of special tokens, lower-cased; they hold no white space
        special = [t.content.encode().translate(LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)").search
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.max_cached, self.older = max_cached, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        ids = self[chunk] = self._learn(chunk) if ids is None else ids
        return ids

    def turn(self) -> None:
        self.older = {}  # before the copy, so that no third lot is there
        self.older = dict(self)
        self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def _merged(self, letters: str) -> bytes:
        """The ids of one piece that the vocabulary's pattern leaves whole, in the byte-level alphabet."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(letters)])

    def _learn(self, chunk: bytes) -> bytes:
        """Chunks of more than one piece are put together from their pieces where these are tokenized by themselves anyway."""
        if chunk.isalpha():
            return self._merged(chunk.decode())
        word = chunk.rstrip(_SIGNS)
        if len(word) < len(chunk) and _ends_in_letter(word) and not self.special(chunk.translate(LOWER)):
            return self[word] + self[chunk[len(word) :]]
        text = chunk.decode()
        if chunk.isascii():
            if b"'" not in chunk and text.isprintable() and not self.special(chunk.translate(LOWER)):
                parts = _RUNS.findall(chunk)
                return b"".join([self[p] for p in parts]) if len(parts) > 1 else self._merged(text)
        elif text.isalpha():
            if max(text) < "\u0180" and "\u0130" not in text:  # composed as they are, and lower-cased one by one
                return self._merged(text.lower().encode().decode("latin-1").translate(self.letters))
            if len(chunk) < 3 * len(text) and text == unicodedata.normalize("NFC", text) and text == text.lower():
                return self._merged(chunk.decode("latin-1").translate(self.letters))
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _case_decides(self, text: bytes, low: bytes) -> bool:
        return bool(not text.isascii() and _CAPITAL_AND_MARK.search(text) or self.special(low))

    def _chunks(self, text: bytes) -> list[bytes]:
        """Lower-cased (A-Z), but for those that are not ASCII in a text with a capital before a mark, and those with a special token's name, whose case decides."""
        low = text.translate(LOWER)
        if not self._case_decides(text, low):
            return low.split()
        marked = _CAPITAL_AND_MARK.search(text)
        return [raw if (marked and not raw.isascii()) or self.special(part) else part for raw, part in zip(text.split(), low.split(), strict=True)]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """As encode(), of lower-cased texts: Arrow parts them into chunks, of which each distinct one is looked up once."""
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = chunks.values.dictionary_encode()
        distinct = slices(coded.dictionary, np.arange(len(coded.dictionary) + 1))
        ids = pa.array(list(map(self.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        return slices(ids, chunks.offsets.to_numpy())

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self) > self.max_cached:
            self.turn()
        texts = [utf8(t) for t in texts]
        low = [t.translate(LOWER) for t in texts]
        cased = {i: b"".join(map(self.__getitem__, self._chunks(t))) for i, t in enumerate(texts) if self._case_decides(t, low[i])}
        if cased:
            low = [b"" if i in cased else t for i, t in enumerate(low)]
        return [cased.get(i, ids) for i, ids in enumerate(self._together(low))]


class SumOfSquares:
    """The windows of one partition. add() and finish() yield (document, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int, grain: int = 64, cut_penalty: int = 6):
        self.capacity, self.grain, self.penalty = capacity, grain, cut_penalty
        self.next_sequence = first_sequence
        self.levels = capacity // grain
        self.counts = np.zeros(self.levels + 1, np.int64)  # by level; the last one stands for full windows
        self.fill = np.full(self.levels, capacity + 1, np.int64)  # of the window on top of each level
        self.open: list[list[list]] = [[] for _ in range(self.levels)]  # windows: [fill, pieces]

    def _push(self, window: list):
        if window[0] == self.capacity:
            yield from self._close(window[1])
            return
        level = window[0] // self.grain
        self.open[level].append(window)
        self.counts[level] += 1
        self.fill[level] = window[0]

    def _pop(self, level: int) -> list:
        window = self.open[level].pop()
        self.counts[level] -= 1
        self.fill[level] = self.open[level][-1][0] if self.open[level] else self.capacity + 1
        return window

    def _close(self, pieces: list):
        sequence, offset = self.next_sequence, 0
        self.next_sequence += 1
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset
            offset += len(ids)

    def add(self, doc, ids: np.ndarray):
        total, start = len(ids), 0
        last = self.levels - 1
        while self.open[last] and total - start > (gap := self.capacity - self.fill[last]):  # top up
            window = self._pop(last)
            window[1].append((doc, start, ids[start : start + gap], total))
            start += gap
            yield from self._close(window[1])
        while total - start >= self.capacity:
            yield from self._close([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        size = total - start
        if not size:
            return
        ids = ids[start:].copy()  # lets go of the rest of a long text
        counts, new = self.counts, size // self.grain
        best, place = 2 * counts[new] + 1, None  # a window of its own
        after = self.fill + size
        fits = np.flatnonzero(after <= self.capacity)
        if len(fits):
            there = after[fits] // self.grain
            change = np.where(there == fits, 0, 2 * (np.where(there < self.levels, counts[there], 0) - counts[fits]) + 2 - (there >= self.levels))
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
            if change[k] <= best:
                best, place = change[k], int(fits[k])
        crowded = int(np.argmax(counts[:-1]))
        room = self.capacity - self.fill[crowded]
        if 0 < room < size and self.penalty + 2 - 2 * counts[crowded] + 2 * counts[(size - room) // self.grain] < best:
            window = self._pop(crowded)
            window[1].append((doc, start, ids[:room], total))
            yield from self._close(window[1])
            yield from self._push([size - int(room), [(doc, start + int(room), ids[room:], total)]])
        else:
            window = [0, []] if place is None else self._pop(place)
            window[0] += size
            window[1].append((doc, start, ids, total))
            yield from self._push(window)

    def finish(self):
        pieces, filled = [], 0
        for level in reversed(range(self.levels)):
            while self.open[level]:
                for doc, start, ids, total in self._pop(level)[1]:
                    while filled + len(ids) >= self.capacity:
                        room = self.capacity - filled
                        yield from self._close([*pieces, (doc, start, ids[:room], total)])
                        pieces, filled, start, ids = [], 0, start + room, ids[room:]
                    if len(ids):
                        pieces.append((doc, start, ids, total))
                        filled += len(ids)
        length = 1 << filled.bit_length()
        while filled:
            length >>= 1
            if length > filled:
                continue
            part, room = [], length
            while room:
                doc, start, ids, total = pieces.pop(0)
                part.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], total))
                room -= len(part[-1][2])
            yield from self._close(part)
            filled -= length


def pieces(batches, size: int = 1_000_000):
    """Batches of (id, text) in pieces of about `size` bytes, so that no whole batch of texts is there as Python objects too; a longer text is alone."""
    for batch in batches:
        held, at = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(held, size + (held[at - 1] if at else 0), "right")))
            yield batch.slice(at, end - at)
            at = end


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", capacity: int = 4096, end_id: int = 2, max_cached: int = 100_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a word-BPE tokenizer file that each executor has; `max_cached` bounds the chunks whose ids a task keeps.
    """
    ship(docs.sparkSession)
    kinds = [pa.int64()] * 6

    def place(batches):
        words = WordTokenizer(tokenizer, max_cached)
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 36)
        end, kind = np.array([end_id], "<u4").tobytes(), None

        def batch_of(rows):
            ids, *rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *map(pa.array, rest, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        rows = []
        for batch in pieces(batches):
            kind = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                rows += packer.add(doc, np.frombuffer(ids + end, "<u4"))
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
        rows += packer.finish()
        if rows:
            yield batch_of(rows)
        words.forget()
        give_back()

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(place, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def op8_packing(spark, sf_dir):
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
