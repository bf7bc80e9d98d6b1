"""Instrument tables derived from the business tables: frames, maps, samples, pulses, images, payloads.

Each comes as a DataFrame and as a DuckDB common table expression of the same name, from the same integer formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(spark, sf_dir, rows: int) -> DataFrame:
    """The vectors; the last group of `rows` is filled up with the first vectors, numbered on, so that all are used.

    The first ones are doubled in place: a union of both fails in Spark 4.1's optimizer where joins infer filters from its constraints.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("n"))
    own = F.when(F.expr(f"vec_id < ({rows} - n % {rows}) % {rows}"), F.array(F.col("vec_id"), F.col("vec_id") + F.col("n"))).otherwise(F.array("vec_id"))
    return vectors.join(F.broadcast(n)).select(F.explode(own).alias("vec_id"), "embedding")  # one row


def _elements(spark, sf_dir, rows: int) -> DataFrame:
    return _filled(spark, sf_dir, rows).select("vec_id", F.posexplode("embedding").alias("x", "e")).withColumn("e", F.col("e").cast("double"))


def frames(spark, sf_dir) -> DataFrame:
    v = F.expr("cast(case when ((vec_id div 32) * 31 + (vec_id % 32) * 7 + x * 13) % 97 = 0 then 65535 else floor((e + 1.0D) * 16384) end as int)")
    return _elements(spark, sf_dir, 32).select(F.expr("cast(vec_id div 32 as int)").alias("frame_id"), F.expr("cast(vec_id % 32 as int)").alias("y"), F.col("x").cast("int").alias("x"), v.alias("v"))


def maps(spark, sf_dir) -> DataFrame:
    p = frames(spark, sf_dir).where("frame_id = 0").select("y", "x", F.expr("y * 64 + x").alias("p"))
    return p.selectExpr("y", "x", "(p * 37) % 128 as off", "31130 + (p * 7919) % 3277 as gain", "case when (p * 131) % 20 = 0 or (y < 3 and x < 3) then 1 else 0 end as bad")


def samples(spark, sf_dir) -> DataFrame:
    x = """case (event_id div 128) % 4 when 0 then cast(floor(value * 8) as bigint) & 65535 when 1 then case when event_id % 16 = 3 then 1 else 0 end
    when 2 then (event_id * 40503 * ((event_id % 13) + 1)) % 65536 else 0 end"""
    # positions count from the begin of a series
    return table(spark, sf_dir, "events").select(F.expr("event_id div 4096").alias("series_id"), F.expr("event_id % 4096").alias("i"), F.expr(x).cast("long").alias("x"))


def pulses(spark, sf_dir) -> DataFrame:
    even, odd = (F.expr(f"transform(sequence(1, 32), k -> element_at(embedding, 2 * k - {o}))") for o in (1, 0))
    return _filled(spark, sf_dir, 480).select(F.expr("vec_id div 480").cast("int").alias("scene_id"), F.expr("vec_id % 480").cast("int").alias("az"), even.alias("re"), odd.alias("im"))


def scenes(spark, sf_dir) -> DataFrame:
    """One row of radar parameters for each scene."""
    whole = _filled(spark, sf_dir, 480).select(F.expr("vec_id div 480").cast("int").alias("scene_id")).distinct()
    fixed = {"lambda": 0.1, "prf": 1000.0, "tau": 4.2e-7, "fs": 2e7, "velocity": 7000.0, "r0": 8e5, "slope": 1e13}
    sizes = {"asize": 480, "avalid": 120, "apatch": 128, "rsize": 32, "rvalid": 24, "npatch": 4}
    return whole.select("scene_id", *(F.lit(v).alias(k) for k, v in (fixed | sizes).items()))


def image(spark, sf_dir) -> DataFrame:
    return _elements(spark, sf_dir, 64).select(F.expr("cast(vec_id div 64 as int)").alias("image_id"), F.expr("cast(vec_id % 64 as int)").alias("y"), F.col("x").cast("int").alias("x"), F.expr("cast(floor((e + 1.0D) * 512) as int)").alias("v"))


def payloads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.concat_ws("|", F.col("o_orderkey"), F.col("o_custkey"), "o_orderstatus", "o_orderpriority"), "UTF-8").alias("payload"))




def filled(rows: int) -> str:
    """SQL of _filled."""
    return f"(select vec_id, embedding from embeddings union all select vec_id + n, embedding from embeddings, (select count(*) n from embeddings) where vec_id < ({rows} - n % {rows}) % {rows})"


def _ex(rows: int) -> str:
    return f"(select vec_id, i - 1 as x, cast(embedding[i] as double) as e from {filled(rows)} v, range(1, 65) r(i))"


SQL = {
    "frames": f"""frames as materialized (select cast(vec_id // 32 as int) frame_id, cast(vec_id % 32 as int) y, cast(x as int) x,
cast(case when ((vec_id // 32) * 31 + (vec_id % 32) * 7 + x * 13) % 97 = 0 then 65535 else floor((e + 1.0) * 16384) end as int) v
from {_ex(32)} z)""",
    "maps": """maps as materialized (select y, x, (p * 37) % 128 as off, 31130 + (p * 7919) % 3277 as gain, case when (p * 131) % 20 = 0 or (y < 3 and x < 3) then 1 else 0 end as bad
from (select y, x, y * 64 + x as p from frames where frame_id = 0))""",
    "samples": """samples as materialized (select event_id // 4096 series_id, event_id % 4096 as i, cast(case (event_id // 128) % 4 when 0 then cast(floor(value * 8) as bigint) & 65535
when 1 then case when event_id % 16 = 3 then 1 else 0 end when 2 then (event_id * 40503 * ((event_id % 13) + 1)) % 65536 else 0 end as bigint) x from events)""",
    "image": f"""image as materialized (select cast(vec_id // 64 as int) image_id, cast(vec_id % 64 as int) y, cast(x as int) x, cast(floor((e + 1.0) * 512) as int) v
from {_ex(64)} z)""",
    "payloads": "payloads as (select o_orderkey, encode(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) as payload from orders)",
}


def with_(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause of the named fixtures and further expressions."""
    return f"with {'recursive ' if recursive else ''}" + ",\n".join([*(SQL[n] for n in names), *([more] if more else [])]) + "\n"
