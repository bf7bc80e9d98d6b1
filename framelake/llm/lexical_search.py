"""Ranked lexical search by bag deduplication: for each item the documents of the highest scores.

Documents are restricted to the items' vocabulary: of a document there remain its number of terms and the vector of (term, occurrences). Scores depend on the
vector and on the length factor m alone, so documents of equal vectors and m are one class: classes are dealt by a hash of both
and told apart by their bytes. Each class is scored once against all items; each task keeps each item's best classes, by score and
least doc_id, and of all tasks' classes the best `top` an item remain. More can't be needed: each class before another one has a document before
all of its. Then the members of these classes alone are looked up, the least `top` doc_ids of each, and ranked.

How many documents hold a term, and the sums of documents and terms, come from all documents. Items are taken in blocks of at most
`max_bytes` of text and `max_items` items, whose vocabulary and postings are the only things that are broadcast; more items are more blocks.

Integers are 64 bits wide; only the terms' weights are computed in doubles, on the driver, a number for each term of a block of items.

Defined cases: null and empty texts have no terms, in documents and items; items without terms, or without a document of a score above
0, have no rows; items with repeated ids are ranked each by itself; documents of equal scores go by ascending doc_id, null ids last, and repeated
rows of a document are documents each; long texts are counted in pieces; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, Scratch, attach, give_back, materialize, read, ship, utf8

#: What is neither a digit nor a letter of ASCII nor beyond ASCII parts terms.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
_PIECE = 2_000_000
_CELLS = 4_000_000  # of items by classes that are scored at once


def term_counts(text: bytes) -> Counter:
    """How often each term occurs, in pieces of a long text."""
    found, plain, begin = Counter(), text.translate(_TERMS), 0
    while begin < len(plain):
        cut = plain.find(b" ", begin + _PIECE)
        end = len(plain) if cut < 0 else cut
        found.update(plain[begin:end].split())
        begin = end
    return found


def _vectors(vocabulary):
    def vectors(batches):
        """doc_id, n, and (term, occurrences) in the order of the terms as pairs of unsigned 32-bit numbers; documents without terms are out."""
        known = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in batches:
            ids, n, data = [], [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                found = term_counts(utf8(text))
                if found:
                    pairs = sorted((known[t], k) for t, k in found.items() if t in known)
                    ids.append(place)
                    n.append(found.total())
                    data.append(np.array(pairs, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n", "vector"])
        give_back()

    return vectors


def _held_terms(size: int):
    def held(batches):
        """How many vectors of a task hold each term."""
        total = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(data, "<u4")[::2], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return held


class _Best:
    """Each item's best classes so far: by score, then by the least doc_id."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.item, self.score, self.id, self.first = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        """scores: items by classes."""
        n = scores.shape[1]
        if n > self.top:  # what is below the best of these alone can't stay
            self.least = np.maximum(self.least, np.partition(scores, n - self.top, axis=1)[:, n - self.top])
        item, place = np.nonzero(scores >= self.least[:, None])
        item, score, name, first = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[item, place]), (self.id, ids[place]), (self.first if len(self.first) else first[:0], first[place])))
        rank = np.unique(first, return_inverse=True)[1]
        order = np.lexsort((rank, -score, item))
        item = item[order]
        begin = np.concatenate([[True], item[1:] != item[:-1]])[: len(item)]
        within = np.arange(len(item)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        order = order[within < self.top]
        self.item, self.score, self.id, self.first = item[within < self.top], score[order], name[order], first[order]
        full = np.flatnonzero(within[within < self.top] == self.top - 1)
        self.least[self.item[full]] = np.maximum(self.least[self.item[full]], self.score[full])


def _comparable(ids: pa.Array) -> np.ndarray:
    """For the order of doc_ids; null ones are last."""
    kind = ids.type
    last = (1 << 63) - 1 if pa.types.is_integer(kind) else "\U0010ffff"
    return (ids.cast(pa.int64()) if pa.types.is_integer(kind) else ids.cast(pa.string())).fill_null(last).to_numpy(zero_copy_only=False)


def _scoring(shared, top: int):
    def score(batches: Iterator[pa.RecordBatch]):
        """The best classes of a task for each item: (item, class_id, score, first)."""
        n_items, postings = shared.value
        best, kind = _Best(n_items, top), None
        step = max(16, _CELLS // max(1, n_items))
        for batch in batches:
            kind = batch.column(3).type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                data = part.column(1).to_pylist()
                pairs = np.frombuffer(b"".join(data), "<u4").astype(np.int64).reshape(-1, 2)
                row = np.repeat(np.arange(len(data)), [len(x) // 8 for x in data])
                term, tf = pairs[:, 0], pairs[:, 1]
                impact = 1_000_000_000 * tf // (1_000 * tf + 12 * part.column(2).to_numpy()[row])
                order = np.argsort(term, kind="stable")
                row, impact, term = row[order], impact[order], term[order]
                begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
                scores = np.zeros((n_items, len(data)), np.int64)
                for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(term)]):
                    items, weights = postings[int(term[b])]
                    if len(items):
                        scores[items[:, None], row[b:e]] += weights[:, None] * impact[b:e]
                best.add(scores, part.column(0).to_numpy(), _comparable(part.column(3)))
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.id), pa.array(best.score)], ["item", "class_id", "score"])
        give_back()

    return score


def _least(rows: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group: of each group and salt first, so that no group is whole in one task."""
    salted = Window.partitionBy(group, "salt").orderBy(*order)
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(256))).withColumn("rank", F.row_number().over(salted)).where(f"rank <= {n}").drop("salt")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(f"rank <= {n}")


def _item_blocks(items: DataFrame, item_id: str, item_text: str, max_bytes: int, max_items: int) -> Iterator[list]:
    """Items in blocks of about max_bytes of text and max_items: rows (item_id, terms and their counts)."""
    total, n = items.agg(F.sum(F.octet_length(item_text)), F.count("*")).first()
    blocks = max(1, math.ceil((total or 0) / max_bytes), math.ceil(n / max_items))
    dealt = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    for block in range(blocks):
        own = dealt if blocks == 1 else dealt.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r.item_id, term_counts(utf8(r.text))) for r in own.toLocalIterator()]
        if rows:
            yield rows


def search(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", top: int = 20, max_bytes: int = 20_000_000, max_items: int = 5_000, max_broadcast: int = 1_000_000) -> DataFrame:
    """Each item's `top` documents: item_id, rank, doc_id, score.

    max_bytes, max_items: of a block of items; max_broadcast: hashes of winning classes that are broadcast to find their members, beyond that they are joined.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    results = None
    with Scratch(spark, "lexical") as work:
        for rows in _item_blocks(items, item_id, item_text, max_bytes, max_items):
            found = _best_documents(texts, id_type, rows, item_type, work, top, max_broadcast)
            results = found if results is None else results.union(found)
        if results is None:
            return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type}, score long")
        return materialize(results, "lexical-result")


def _best_documents(texts: DataFrame, id_type: str, rows: list, item_type, work: Scratch, top: int, max_broadcast: int) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = sorted(set().union(*(terms for _, terms in rows)))
    place = {t: i for i, t in enumerate(vocabulary)}
    vectors = work.keep(texts.mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)), f"doc_id {id_type}, n long, vector binary"), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    bags = vectors.where(F.length("vector") > 0)
    if n_docs:
        m = F.expr(f"75L + (25 * cast(n as decimal(20, 0)) * cast({n_docs} as decimal(20, 0))) div cast({n_terms} as decimal(20, 0))")
        bags = bags.withColumn("m", m)
    else:
        bags = bags.withColumn("m", F.lit(75).cast("long"))
    bags = bags.withColumn("key", F.xxhash64("vector", "m"))
    counts = bags.select("vector").mapInArrow(_held_terms(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in counts:
        weight[r.term] = math.floor(1_000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    own: list[tuple[list, list]] = [([], []) for _ in vocabulary]
    for i, (_, terms) in enumerate(rows):
        for t, k in terms.items():
            own[place[t]][0].append(i)
            own[place[t]][1].append(k * int(weight[place[t]]))
    postings = spark.sparkContext.broadcast((len(rows), [(np.array(i, np.int64), np.array(w, np.int64)) for i, w in own]))

    classes = bags.groupBy("key", "vector", "m").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).withColumn("class_id", F.monotonically_increasing_id())
    classes = work.keep(classes, "classes")
    scored = classes.select("class_id", "vector", "m", "first").mapInArrow(_scoring(postings, top), "item long, class_id long, score long")
    best = work.keep(scored.join(classes.select("class_id", "first"), "class_id"), "scored")
    best = work.keep(_least(best, "item", top, F.desc("score"), F.col("first").asc_nulls_last()).select("item", "class_id", "score"), "best")
    winners = work.keep(classes.join(best.select("class_id").distinct(), "class_id").select("key", "vector", "m", "k", "class_id"), "winners")
    keys = winners.select("key").distinct()
    near = bags.join(F.broadcast(keys) if keys.count() <= max_broadcast else keys, "key", "left_semi")
    members = work.keep(attach(near, winners, ["key", "vector", "m"], "k").select("class_id", "doc_id"), "members")
    least = work.keep(_least(members, "class_id", top, F.col("doc_id").asc_nulls_last()).select("class_id", "doc_id"), "least")
    ranked = _least(best.join(least, "class_id"), "item", top, F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item long, item_id {item_type.simpleString()}")
    return work.keep(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def op13_lexical_search(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
st AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY term),
m AS (SELECT r, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM d, st WHERE len(t) > 0),
s AS (SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 20
"""
