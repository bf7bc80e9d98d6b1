"""What the operators share: reading, scratch tables in the shared folder, words, shipping the package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.shipping import ship

#: A-Z to a-z and nothing else, for UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_own_scratch: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only local Spark gets a temporary one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="framelake-scratch-")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/framelake/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    return _written(df, scratch_path(df.sparkSession, name))


class Scratch:
    """The tables of one run, below a folder of its own in the shared folder. They go when the context ends; results are materialized before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables, self.count = spark, scratch_path(spark, name), [], 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.root}/{self.count}-{name}")

    def bucketed(self, rows: DataFrame, key: str, n_buckets: int) -> str:
        """The name of a table of rows in n_buckets buckets by key, each sorted by it."""
        name = f"framelake_{uuid.uuid4().hex}"
        self.tables.append(name)
        rows.repartition(n_buckets, key).write.bucketBy(n_buckets, key).sortBy(key).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, table: DataFrame, key: str, count: str, *, max_hot: int = 5_000) -> DataFrame:
    """rows joined with table by key, which table has once each; count: how many rows have the key.

    Keys with more than a `max_hot`-th of all rows, of which there are fewer than max_hot, are broadcast, so that none meets in one task.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    least = max(1_000, (total or 0) // max_hot)
    if (most or 0) <= least:
        return rows.join(table.drop(count), key)
    hot = F.broadcast(table.where(F.col(count) > least).drop(count))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= least).drop(count), key))


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """UTF-8 bytes of all texts, and rows: a scan of one column, summed on the executors."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))), F.count("*")).first()
    return row[0] or 0, row[1]


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def utf8(value: str | bytes | None) -> bytes:
    return b"" if value is None else value if isinstance(value, bytes) else value.encode()


def single_threaded() -> None:
    """Tokenizers run one thread in a task; Spark supplies the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def give_back() -> None:
    """Returns what this Python worker has freed to the machine: workers live on between stages, beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
