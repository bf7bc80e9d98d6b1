"""Fixtures that fill up the last group of vectors."""

import subprocess
import sys
from pathlib import Path

from framelake.plans import fixtures

FOCUS = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("rows", len(__spark_entry__.queries()["r13_focus"](spark, {!r}).collect()))
"""


def test_the_first_vectors_fill_up_the_last_group(spark, tmp_path):
    """Numbered on, without a union, from whose constraints the optimizer fails to infer filters."""
    rows = [(k, [float(k)]) for k in range(10)] + [(None, [0.5])]
    for n, more in ((4, 1), (11, 0), (16, 5)):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        found = fixtures._filled(spark, str(tmp_path), n)
        assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = [*rows, *((k + 11, [float(k)]) for k in range(more))]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_focusing_is_planned_in_a_new_session(sf_dir):
    """The first query of a session, where its plan failed."""
    done = subprocess.run([sys.executable, "-c", FOCUS.format(sf_dir)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
