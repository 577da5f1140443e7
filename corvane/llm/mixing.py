"""A mixture of sources at target shares, with capped repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed of the draw for the fractional copy.
SEED = 17


def repetition_rates(sized: DataFrame, targets: DataFrame, *, total_tokens: int | None = None) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``have_tokens``, ``rate``): one row per target.

    ``rate`` = target share x total size / tokens the source has, at most
    ``max_repeats``; 0 where the source has no tokens or the share isn't
    positive. The total size is ``total_tokens``, by default that of all
    documents of the targeted sources. Tokens are summed before the shuffle,
    so a source that holds a third of all rows is no hot key.
    """
    goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("have_tokens"))
    both = goals.join(have, "source", "left").withColumn("have_tokens", F.coalesce("have_tokens", F.lit(0)))
    size = F.broadcast(both.agg(F.sum("have_tokens").alias("size"))) if total_tokens is None else None
    both = both.crossJoin(size) if size is not None else both.withColumn("size", F.lit(total_tokens))
    wanted = F.when((F.col("have_tokens") > 0) & (F.col("target_share") > 0), F.col("target_share") * F.col("size") / F.col("have_tokens")).otherwise(0.0)
    rate = F.greatest(F.lit(0.0), F.least(wanted, F.coalesce("max_repeats", F.lit(0)).cast("double")))
    return both.select("source", "target_share", "max_repeats", "have_tokens", rate.alias("rate"))


def mixture(sized: DataFrame, rates: DataFrame, *, key: str, seed: int = SEED) -> DataFrame:
    """(``key``, ``source``, ``tokens``, ``copy``): one row per use of a document.

    Every document comes floor(rate) times, and once more if a number drawn
    from a digest of seed and key lies below the fraction, so the draw is the same
    on every run, whatever the partitions. The rates have one row per target,
    a table the caller writes, and are broadcast: documents aren't shuffled.
    Documents of null or untargeted sources come 0 times.
    """
    by = rates.select(F.col("source").alias("__s"), "rate")
    both = sized.select(key, "source", "tokens").join(F.broadcast(by), F.col("source") == F.col("__s"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 10), 16, 10).cast("bigint") / F.lit(float(1 << 40))
    whole = F.floor("rate")
    times = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    used = both.withColumn("times", times).filter("times > 0")
    return used.select(key, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))


def reached_shares(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``rate``, ``have_tokens``, ``used_tokens``, ``share``): every target, also those out of reach.

    ``share`` is null if the mixture is empty.
    """
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"))
    both = rates.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    total = F.broadcast(both.agg(F.sum("used_tokens").alias("all")))
    return both.crossJoin(total).select("source", "target_share", "max_repeats", "rate", "have_tokens", "used_tokens", F.when(F.col("all") > 0, F.col("used_tokens") / F.col("all")).alias("share"))
