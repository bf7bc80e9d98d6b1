"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

Defined cases of every stage: an empty table gives an empty one; further columns of docs, whatever their names, stay as they are (packing
ignores them); null ids are rows like others. What else is special stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from framelake.llm.common import materialize, read

#: Rows of an Arrow batch of whole texts. A batch lies in the executor's and in Python's memory, twice each, beside a heap that earlier stages filled.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, where it names no number itself. The rows of a result don't depend on it."""
    if (key := "spark.sql.execution.arrow.maxRecordsPerBatch") not in spark.conf.getAll:
        spark.conf.set(key, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, the quality model or the toxicity model reject go.

    Null and empty texts have no words, and so go; repeated rows are judged one by one, alike; long texts are judged whole; labels without a
    document, null ones and ties are as `quality.train` says.
    """
    small_batches(spark)
    return quality.filter_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of their source's pages go; n_chars follows the text.

    A null text stays null, with a null n_chars; null sources are one source; repeated rows are pages of their own; a text whose lines all go is
    the empty text; a line that exactly a tenth of the pages have stays; long texts are cut into lines whole.
    """
    return line_dedup.drop_boilerplate(docs, length_col="n_chars")


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays.

    Texts without words, null ones among them, link with nothing and stay; rows that share an id stay or go together, so repeated rows with
    the least id all stay; rows with a null id stay; long texts are compared whole.
    """
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay as they are.

    Null and empty texts are not contaminated; repeated rows are judged one by one, alike; exactly a twentieth of hit words is contaminated;
    null items have no windows; long texts are scanned whole.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of 4096 tokens: a row for each piece.

    A null or empty text is its end id alone; repeated rows are packed each; a document longer than a sequence is cut into as many as it needs.
    """
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_cached=50_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("jaccard_dedup", jaccard_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
