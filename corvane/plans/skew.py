"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may be called heavy; also the row bound of what is broadcast.
HEAVY_KEYS = 512
#: Parts over which the rows of heavy keys are spread, at least; as many as a shuffle has partitions, if that is more.
SPREAD = 64


def join_dimension(facts: DataFrame, dims: DataFrame, key: str, weight: str, spread_by: list[str], heavy_keys: int = HEAVY_KEYS, how: str = "inner") -> DataFrame:
    """Inner (or, with ``how="left"``, left outer) join of a large table with one row per string ``key`` of ``dims``.

    ``dims[weight]`` is the number of ``facts`` rows of the key. A key with more
    than 1/``heavy_keys`` of all rows is heavy, so there are fewer than
    ``heavy_keys`` of them whatever the data: these are broadcast, a proven
    bound, and their facts are spread over all partitions instead of meeting
    in one task. All other keys go through an ordinary shuffled join.
    Null keys match nothing. ``dims`` is read three times; let it be a written
    table where it is costly to compute.
    """
    total = dims.agg(F.sum(weight).alias("__total"))
    heavy = dims.crossJoin(F.broadcast(total)).filter(F.col(weight) * F.lit(heavy_keys) > F.col("__total")).drop("__total")
    rest = [c for c in dims.columns if c != key]
    packed = F.struct(*[F.col(c) for c in rest])
    at_hand = heavy.select(F.col(key).alias("__hk"), packed.alias("__hot"))
    one = facts.join(F.broadcast(at_hand), F.col(key) == F.col("__hk"), "left").drop("__hk")
    parts = max(SPREAD, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(parts))
    one = one.withColumn("__key", F.when(F.col("__hot").isNotNull(), F.concat(F.lit("\u0000"), part.cast("string"))).otherwise(F.col(key)))
    cold = dims.select(F.col(key).alias("__key"), packed.alias("__cold"))
    both = one.join(cold, "__key", "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    out: list[Column] = [F.col(c) for c in facts.columns] + [found[c].alias(c) for c in rest]
    return (both if how == "left" else both.filter(found.isNotNull())).select(*out)
