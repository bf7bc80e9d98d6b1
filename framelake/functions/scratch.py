"""Tables that a run writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Only local Spark gets a temporary one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="framelake-scratch-")
        named = _own[app]
    return f"{named.rstrip('/')}/framelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written and read again: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Paths of one run below a folder of its own, which goes when the context ends; what is to stay is written elsewhere before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.path(name))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
