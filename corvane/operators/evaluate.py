"""Score rankings against judgements, compare methods, pool and merge labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = (1, 3, 5, 10, 20)


def judgements(queries: DataFrame, doc: str = "trial_id") -> DataFrame:
    """(``query_id``, doc): relevant documents; null entries and repeats are dropped."""
    return queries.select("query_id", F.explode("relevant").alias(doc)).filter(F.col(doc).isNotNull()).distinct()


def per_query(runs: DataFrame, judged: DataFrame, ks: tuple[int, ...] = DEFAULT_K, *, depth_factor: Column | int = 1, doc: str = "trial_id") -> DataFrame:
    """Metrics of every method, query and k; judged queries without hits count 0.

    ``runs`` has ``method``, ``query_id``, doc and ``rank``. At k, ``k x
    depth_factor`` documents are looked at, since the union of two lists of k
    holds up to 2k. Precision divides by the number shown. Columns: ``recall``,
    ``precision``, ``mrr``, ``ndcg``, ``ceiling``, ``r_precision``, ``shown``.
    """
    size = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    base = runs.select("method").distinct().crossJoin(F.broadcast(size))  # methods x judged queries, both lists of the caller
    hit = runs.select("method", "query_id", doc, "rank").join(judged.withColumn("hit", F.lit(1)), ["query_id", doc], "left").join(size, "query_id")
    factor = F.lit(depth_factor) if isinstance(depth_factor, int) else depth_factor
    each = hit.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("depth", F.col("k") * factor)
    inside, found = F.col("rank") <= F.col("depth"), F.col("hit").isNotNull()
    sums = each.groupBy("method", "query_id", "k").agg(
        F.sum(F.when(inside & found, 1).otherwise(0)).alias("found"), F.sum(F.when(inside, 1).otherwise(0)).alias("looked"), F.min(F.when(inside & found, F.col("rank"))).alias("first"),
        F.sum(F.when(inside & found, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(found & (F.col("rank") <= F.col("n_rel")), 1).otherwise(0)).alias("in_r"), F.count(F.lit(1)).alias("returned"),
    )
    full = base.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).join(sums, ["method", "query_id", "k"], "left").na.fill(0, ["found", "looked", "in_r", "returned", "dcg"])
    budget = F.least(F.col("n_rel"), (F.col("k") * factor)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), budget), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    return full.select(
        "method", "query_id", "k", (F.col("found") / F.col("n_rel")).alias("recall"), F.when(F.col("looked") > 0, F.col("found") / F.col("looked")).otherwise(0.0).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"), (budget / F.col("n_rel")).alias("ceiling"), (F.col("in_r") / F.col("n_rel")).alias("r_precision"), F.col("returned").alias("shown"),
    )


METRICS = ["recall", "precision", "mrr", "ndcg", "ceiling", "r_precision"]


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries, with the number of queries and of unanswered ones."""
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    return scores.groupBy(*(by or ["method"]), "k").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.when(F.col("shown") == 0, 1).otherwise(0)).cast("bigint").alias("unanswered"), F.round(F.avg("shown"), 6).alias("results_shown"), *means)


def percentiles(table: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group: the value at floor(n x share) of the sorted list, not interpolated.

    No group is sorted in one task. Equal values are counted first; the counts
    are summed over buckets of a monotone logarithmic scale, a bounded number a
    group; and only the values of the buckets that hold a wanted place are
    ordered. Null values take no part.
    """
    v = F.col(value)
    bucket = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 256)
    counts = table.filter(v.isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c")).withColumn("__b", bucket)
    held = counts.groupBy(by, "__b").agg(F.sum("c").alias("in_b"), F.sum(v * F.col("c")).alias("sum_b"), F.max(value).alias("max_b"))
    group = Window.partitionBy(by)
    held = held.withColumn("upto", F.sum("in_b").over(group.orderBy("__b"))).withColumn("n", F.sum("in_b").over(group))
    place = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    wanted = F.lit(False)
    for p in shares.values():
        wanted = wanted | ((place(p) < F.col("upto")) & (place(p) >= F.col("upto") - F.col("in_b")))
    some = held.filter(wanted).select(by, "__b", "n", (F.col("upto") - F.col("in_b")).alias("below"))
    run = counts.join(some, [by, "__b"]).withColumn("at", F.col("below") + F.sum("c").over(Window.partitionBy(by, "__b").orderBy(value)))
    picks = [F.min(F.when((F.col("at") > place(p)) & (F.col("below") <= place(p)), v)).alias(name) for name, p in shares.items()]
    means = held.groupBy(by).agg(F.max("n").alias("n"), F.round(F.sum("sum_b") / F.sum("in_b"), 2).alias("mean"), F.max("max_b").alias("most"))
    return means.join(run.groupBy(by).agg(*picks), by).select(by, "n", *shares, "mean", "most")


def best_method(means: DataFrame, k: int = 10, leave_out: tuple[str, ...] = ("tfidf",)) -> DataFrame:
    """(``method``, ``recall``, ``mrr``): the best recall at k of the eligible methods."""
    rows = means.filter((F.col("k") == k) & ~F.col("method").isin(list(leave_out)))
    return rows.orderBy(F.desc("recall"), "method").limit(1).select("method", "recall", "mrr")


def check_targets(best: DataFrame, p95_ms: float, *, recall: float = 0.70, mrr: float = 0.45, latency_ms: float = 300.0) -> DataFrame:
    """(``target``, ``value``, ``wanted``, ``met``): the release gate on the best method."""
    rows = F.array(
        F.struct(F.lit("recall@10").alias("target"), F.col("recall").alias("value"), F.lit(recall).alias("wanted"), (F.col("recall") >= recall).alias("met")),
        F.struct(F.lit("mrr@10").alias("target"), F.col("mrr").alias("value"), F.lit(mrr).alias("wanted"), (F.col("mrr") >= mrr).alias("met")),
        F.struct(F.lit("p95_ms").alias("target"), F.lit(float(p95_ms)).alias("value"), F.lit(latency_ms).alias("wanted"), F.lit(p95_ms <= latency_ms).alias("met")),
    )
    return best.select(F.explode(rows).alias("r")).select("r.*")


def overlap(run_a: DataFrame, run_b: DataFrame, pairs: DataFrame, k: int = 10, doc: str = "trial_id") -> DataFrame:
    """(``query_id``, ``twin_id``, ``overlap``): share of the first k that a query and its twin have in common."""
    a = run_a.filter(F.col("rank") <= k).select("query_id", doc)
    b = run_b.filter(F.col("rank") <= k).select(F.col("query_id").alias("twin_id"), doc)
    both = pairs.join(a, "query_id").join(b, ["twin_id", doc]).groupBy("query_id", "twin_id").agg((F.count(F.lit(1)) / k).alias("overlap"))
    return pairs.join(both, ["query_id", "twin_id"], "left").select("query_id", "twin_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def _draw(sample: Column, place: Column, seed: int) -> Column:
    """A well mixed 32-bit number from two positions; the same arithmetic in any engine."""
    m = F.lit(1 << 32)
    x = F.pmod(sample * 1540483477 + place * 668265263 + seed, m)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * 1103515245, m)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 13)) * 1540483477, m)
    return x.bitwiseXOR(F.shiftright(x, 16))


def paired_bootstrap(differences: DataFrame, *, resamples: int = 20_000, seed: int = 42) -> DataFrame:
    """(``effect``, ``low``, ``high``, ``p``) of the column ``diff``, one row per query.

    The queries are numbered by ``query_id`` and drawn with replacement by a
    hash of (resample, place); the interval holds 95 % of the resampled means,
    p is two-sided after centring. The judged queries are a fixed list, joined
    by number; the resamples are spread over all tasks.
    """
    spark = differences.sparkSession
    numbered = differences.select((F.row_number().over(Window.orderBy("query_id")) - 1).cast("bigint").alias("i"), "diff")
    n = F.broadcast(differences.agg(F.count(F.lit(1)).alias("n")))
    draws = spark.range(resamples).withColumnRenamed("id", "r").crossJoin(n).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    draws = draws.select("r", F.pmod(_draw(F.col("r"), F.col("j"), seed), F.col("n")).alias("i"))
    means = draws.join(numbered, "i").groupBy("r").agg(F.avg("diff").alias("m"))
    effect = F.broadcast(differences.agg(F.avg("diff").alias("effect")))
    both = means.crossJoin(effect)
    tail = F.avg(F.when(F.abs(F.col("m") - F.col("effect")) >= F.abs("effect") - 1e-12, 1.0).otherwise(0.0))
    return both.agg(F.round(F.first("effect"), 6).alias("effect"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(tail, 6).alias("p"))


def label_progress(sheet: DataFrame) -> DataFrame:
    """One row: judged and all candidates, and queries judged in full; ``sheet`` has ``query_id`` and ``relevant``."""
    per = sheet.groupBy("query_id").agg(F.count("relevant").alias("judged"), F.count(F.lit(1)).alias("candidates"))
    return per.agg(F.sum("judged").alias("judged"), F.sum("candidates").alias("candidates"), F.sum(F.when(F.col("judged") == F.col("candidates"), 1).otherwise(0)).cast("bigint").alias("complete"))


def merged_labels(sheet: DataFrame, judged: DataFrame, doc: str = "trial_id") -> DataFrame:
    """(``query_id``, ``relevant``): old judgements and those of fully judged queries, sorted.

    A query with any candidate unjudged adds nothing, one without old
    judgements isn't made.
    """
    complete = sheet.groupBy("query_id").agg(F.count("relevant").alias("j"), F.count(F.lit(1)).alias("c")).filter("j = c").select("query_id")
    known = judged.select("query_id").distinct()
    new = sheet.filter("relevant").join(complete, "query_id", "left_semi").join(known, "query_id", "left_semi").select("query_id", doc)
    return judged.select("query_id", doc).union(new).distinct().groupBy("query_id").agg(F.array_sort(F.collect_set(doc)).alias("relevant"))


def unjudged(candidates: DataFrame, judged: DataFrame, doc: str = "trial_id") -> DataFrame:
    """Pooled candidates that have no judgement yet."""
    return candidates.join(judged, ["query_id", doc], "left_anti")
