"""Quality rules: fixed counts, and calibrated logistic regression on hashed word and character n-grams.

Features are the presence in a text of its words and pairs of neighbouring words, of the words' first 4 and 5 bytes (without case and
punctuation), and of its 3-byte sequences as written, hashed to 2^21 places. Two models are trained on labelled rows, one for quality
and one for toxicity, on a sample of at most `max_labelled` documents (the first by a hash of doc_id; all further rows of
labels are not used). Each model takes the sample's documents that have its label. A quarter of the sample is held out to calibrate the probabilities (Platt). A feature counts if
`min_documents` sample rows have it. Texts are scored in Arrow batches against fixed thresholds; the model's size is
fixed by the hash space (8 MB for both), which bounds its broadcast.

Rules: base_failed if n_words < 50 or 100 * n_repeat_words > 50 * n_words; kept if not base_failed, the calibrated
probability of quality is at least `min_quality` and that of toxicity at most `max_toxic`.

Defined cases: a null text has no words and fails; labels that are null, or of unknown documents, are not used;
several labels of a document count as their majority (ties as 1); of texts that share an id the one of the least hash is learnt from;
without labels of both kinds a model keeps all;
repeated rows are judged one by one; an empty table gives no rows; `filter_quality` keeps all columns whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import give_back, read, ship, utf8
from framelake.llm.decontaminate import NORMALISE
from framelake.llm.words import Words, distinct, mix, per_text, portions, windows

BITS = 21
#: Bytes of text whose n-grams are in memory at once.
PORTION = 150_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_SPACES = b" \t\n\v\f\r"
_PIECE = 1_000_000  # bytes of a long text whose features are found at once
#: Bytes that begin a code point of a word.
_IN_WORD = np.array([not (b in b" \t\n\v\f\r" or 128 <= b < 192) for b in range(256)], bool)
BASE_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(texts: list[bytes]) -> np.ndarray:
    """A row of BASE_NAMES for each text."""
    words = Words(texts)
    n_words = words.counts()
    # a space follows each text, so none is without a byte here; sums by text without an array of numbers for bytes
    by_text = lambda flags: np.add.reduceat(flags.view(np.uint8), words.text_begin, dtype=np.int64) if texts else np.zeros(0, np.int64)
    word_chars, symbols = by_text(_IN_WORD[words.data]), by_text(_SYMBOL[words.data])
    dup_lines = []
    for text in texts:
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    # three-word windows of one text, told apart from other texts' by the text's number
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)
    triples = windows(words.hashes(), 3)
    begins = np.arange(len(triples))
    begins = begins[owner[: len(triples)] == owner[2:]] if len(triples) else begins
    codes = mix(triples[begins] ^ mix(owner[begins] + np.uint64(1)))
    order = np.argsort(codes)
    same = codes[order][1:] == codes[order][:-1]
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(owner), bool)
    for k in range(3):
        covered[begins[again] + k] = True
    return np.column_stack([n_words, word_chars, symbols, np.array(dup_lines, np.int64), per_text(covered, words.first)]).astype(np.int64)


def _pieces(text: bytes, size: int) -> list[bytes]:
    """A long text in pieces that end where a word ends and begin with its last two words, so that their features are the text's."""
    plain, out, begin, cut = text.translate(NORMALISE), [], 0, 0
    while len(text) - cut > size:
        space = next((i for i in range(cut + size, len(text)) if text[i] in _SPACES), len(text))
        out.append(text[begin:space])
        held = plain[begin:space].rstrip()
        held = held[: held.rfind(b" ") + 1].rstrip()
        begin, cut = begin + held.rfind(b" ") + 1, space
    return [*out, text[begin:]]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every feature that a text has, without repeats, in order; of a long text by pieces."""
    if len(texts) == 1 and len(texts[0]) > 2 * _PIECE:
        place = distinct(np.concatenate([_features([piece])[1] for piece in _pieces(texts[0], _PIECE)]))
        return np.zeros(len(place), np.int64), place
    return _features(texts)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, shift = Words([t.translate(NORMALISE) for t in texts]), np.uint64(64 - BITS)
    owner = np.repeat(np.arange(len(texts)), words.counts())
    hashes = words.hashes()
    pairs = windows(hashes, 2)
    inside = owner[1:] == owner[:-1]
    found = [(owner, hashes), (owner[:-1][inside], pairs[inside])]
    data = words.data.astype(np.uint64)
    for size in (4, 5):
        long = words.end - words.begin >= size
        code = np.zeros(int(long.sum()), np.uint64)
        for k in range(size):
            code = code << np.uint64(8) | data[words.begin[long] + k]
        found.append((owner[long], mix(code ^ np.uint64(size << 56))))
    plain = Words(texts)
    data = plain.data.astype(np.uint64)
    code = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:] if len(data) > 2 else data[:0]
    sizes = np.maximum(plain.text_end - plain.text_begin - 2, 0)
    at = np.repeat(plain.text_begin - np.cumsum(np.concatenate([[0], sizes[:-1]])), sizes) + np.arange(sizes.sum()) if len(texts) else sizes
    found.append((np.repeat(np.arange(len(texts)), sizes), mix(code[at] ^ np.uint64(3 << 56))))
    both = distinct(np.concatenate([(o << BITS) | (c >> shift).astype(np.int64) for o, c in found]))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Head:
    """A calibrated model: probability = sigmoid(slope * (weights of the present features, summed) + offset)."""

    weights: np.ndarray | None
    slope: float = 0.0
    offset: float = 0.0

    def probability(self, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray | None:
        if self.weights is None:
            return None
        return _sigmoid(self.slope * np.bincount(owner, weights=self.weights[place], minlength=n) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Rows:
    """The features of the sample's rows, without the rare ones; sums over blocks of rows keep what they need small."""

    def __init__(self, sizes: np.ndarray, place: np.ndarray, min_documents: int):
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.n = len(sizes)
        self.known = np.flatnonzero(np.bincount(place, minlength=1 << BITS) >= min_documents) if len(place) else place
        column = np.full(1 << BITS, -1, np.int32)
        column[self.known] = np.arange(len(self.known), dtype=np.int32)
        self.blocks = []
        for i in range(0, self.n, 500):
            j = min(i + 500, self.n)
            columns = column[place[begin[i] : begin[j]]]
            owner = np.repeat(np.arange(j - i, dtype=np.int16), sizes[i:j])
            used = columns >= 0
            self.blocks.append((i, j, columns[used], owner[used]))

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Of each row's features' weights."""
        return np.concatenate([np.bincount(owner, weights=w[columns], minlength=j - i) for i, j, columns, owner in self.blocks])

    def gather(self, error: np.ndarray) -> np.ndarray:
        """Of the errors of the rows that have a feature."""
        out = np.zeros(len(self.known))
        for i, j, columns, owner in self.blocks:
            out += np.bincount(columns, weights=error[i:j][owner], minlength=len(out))
        return out


def _fit(rows: _Rows, y: np.ndarray, steps: int = 80, scale: float = 0.05, decay: float = 1e-5) -> Head:
    """Logistic regression by Adam on three quarters of the rows with a label (y is not nan), calibrated on the others."""
    known, sums, gather = rows.known, rows.sums, rows.gather
    labelled, turn = ~np.isnan(y), np.arange(rows.n) % 4 == 3
    held, learnt = labelled & turn, labelled & ~turn
    y = np.where(labelled, y, 0)
    if min(y[learnt].sum(), learnt.sum() - y[learnt].sum(), y[held].sum(), held.sum() - y[held].sum()) < 1:
        return Head(None)
    w, bias, trained = np.zeros(len(known)), 0.0, learnt.sum()
    m, v, mb, vb = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for step in range(1, steps + 1):
        error = np.where(learnt, _sigmoid(scale * sums(w) + bias) - y, 0)
        slope = scale * gather(error) / trained + decay * w
        slope_b = error.sum() / trained
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mb, vb = 0.9 * mb + 0.1 * slope_b, 0.99 * vb + 0.01 * slope_b**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.3 * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= 0.3 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    # Platt: two parameters on the held-out rows, with smoothed targets
    z = scale * sums(w)[held] + bias
    ones = y[held].sum()
    target = np.where(y[held] == 1, (ones + 1) / (ones + 2), 1 / (held.sum() - ones + 2))
    p, q = 1.0, 0.0
    for _ in range(50):
        f = _sigmoid(p * z + q)
        curve = np.maximum(f * (1 - f), 1e-9)
        hessian = np.array([[np.sum(curve * z * z) + 1e-3, np.sum(curve * z)], [np.sum(curve * z), np.sum(curve) + 1e-3]])
        p, q = np.array([p, q]) - np.linalg.solve(hessian, [np.sum((f - target) * z) + 1e-3 * (p - 1), np.sum(f - target) + 1e-3 * q])
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = scale * w
    return Head(weights, float(p), float(p * bias + q))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", max_labelled: int = 10_000, min_documents: int = 4) -> tuple[Head, Head]:
    """The models of quality and toxicity from a sample of at most max_labelled labelled documents."""
    ship(docs.sparkSession)
    majority = lambda c: F.when(F.avg(c) >= 0.5, 1).when(F.avg(c) < 0.5, 0)
    rated = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(majority("quality").alias("quality"), majority("toxic").alias("toxic")).where("quality is not null or toxic is not null")
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    # Only ids below a limit are sorted: it lets through a few more than are asked for over all tasks together.
    n_rated = rated.count()
    limit = (1 << 40) if n_rated <= max_labelled else ((max_labelled + max_labelled // 10 + 1_000) << 40) // n_rated
    sample = rated.where(order < limit).orderBy(order, "id").limit(max_labelled)  # so many rows at most: fit to broadcast
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(sample), "id")
    texts = found.groupBy("id", "quality", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))

    def extract(batches):
        for batch in batches:
            raw = [utf8(t) for t in batch.column("text").to_pylist()]
            out = []
            for begin, end in portions(raw, PORTION):
                owner, place = features(raw[begin:end])
                cuts = np.searchsorted(owner, np.arange(1, end - begin))
                out += [x.astype("<i4").tobytes() for x in np.split(place, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("quality"), batch.column("toxic"), pa.array(out, pa.binary())], ["id", "quality", "toxic", "places"])

    rows = texts.select("id", "quality", "toxic", "text").mapInArrow(extract, "id string, quality int, toxic int, places binary").toArrow().sort_by("id")
    if not rows.num_rows:
        return Head(None), Head(None)
    column = rows["places"].combine_chunks()
    _, offsets, data = column.buffers()  # read where they are: the sample's features are some 70 MB
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    sizes, place = np.diff(ends), np.frombuffer(data, "<i4")[ends[0] : ends[-1]]
    targets = [np.array([np.nan if y is None else y for y in rows[c].to_pylist()], float) for c in ("quality", "toxic")]
    kept = _Rows(sizes, place, min_documents)
    del rows, column, offsets, data, place
    return tuple(_fit(kept, y) for y in targets)


def _judged(texts: list[bytes], heads: tuple[Head, Head], min_quality: float, max_toxic: float) -> tuple:
    """Base counts, base_failed, kept, and both probabilities."""
    counts, failed, kept, both = [], [], [], ([], [])
    for begin, end in portions(texts, PORTION):
        n = end - begin
        base = base_counts(texts[begin:end])
        bad = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
        owner, place = features(texts[begin:end])
        good, toxic = (h.probability(owner, place, n) for h in heads)
        good, toxic = np.ones(n) if good is None else good, np.zeros(n) if toxic is None else toxic
        counts.append(base)
        failed.append(bad)
        kept.append(~bad & (good >= min_quality) & (toxic <= max_toxic))
        both[0].append(good)
        both[1].append(toxic)
    if not counts:
        return np.zeros((0, 5), np.int64), *[np.zeros(0, bool)] * 2, *[np.zeros(0)] * 2
    return tuple(map(np.concatenate, (counts, failed, kept, *both)))


#: Fixed thresholds of the verdict.
MIN_QUALITY, MAX_TOXIC = 0.2, 0.2


def score_quality(docs: DataFrame, heads: tuple[Head, Head], *, id_col="doc_id", text_col="text", min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept, p_quality, p_toxic."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(heads)
    names = ["doc_id", *BASE_NAMES, "base_failed", "kept", "p_quality", "p_toxic"]

    def score(batches):
        for batch in batches:
            counts, failed, kept, good, toxic = _judged([utf8(t) for t in batch.column(1).to_pylist()], shared.value, min_quality, max_toxic)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), *map(pa.array, (failed, kept, good, toxic))], names)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {', '.join(n + ' long' for n in BASE_NAMES)}, base_failed boolean, kept boolean, p_quality double, p_toxic double")


def filter_quality(docs: DataFrame, heads: tuple[Head, Head], *, text_col="text", min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """The rows of docs, all columns unchanged, that score_quality keeps."""
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(heads), docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def keep(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):  # a few texts at a time as Python values
                part = batch.slice(begin, 500)
                yield part.filter(pa.array(_judged([utf8(t) for t in part.column(at).to_pylist()], shared.value, min_quality, max_toxic)[2]))
            give_back()

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def op5_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, read(spark, sf_dir, "labels")))
