"""How characteristic each term is of each record, against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.materialize import materialize
from corvane.plans.skew import join_dimension
from corvane.plans.spread import spread

#: Exponent that smooths the context (record) counts.
CONTEXT_EXPONENT = 0.75

#: A term: a whole run of a-z and 0-9, three or more long, with a letter.
TERM_PATTERN = r"(?<![a-z0-9])(?=[0-9]*+[a-z])[a-z0-9]{3,}"


def terms_of(*texts: Column) -> Column:
    """Array of the terms of all texts in order, repeats kept; null texts count as empty."""
    joined = F.concat_ws(" ", *texts)
    return F.regexp_extract_all(F.lower(joined), F.lit(TERM_PATTERN), F.lit(0))


def term_record_counts(records: DataFrame, *, key: str, texts: list[str]) -> DataFrame:
    """(``record``, ``term``, ``tf``, ``record_tokens``): joint and record counts.

    One shuffle on the record key serves both counts.
    """
    bag = spread(records, key).select(F.col(key).alias("record"), terms_of(*[F.col(t) for t in texts]).alias("terms"))
    tokens = bag.select("record", F.explode("terms").alias("term")).repartition("record")
    joint = tokens.groupBy("record", "term").agg(F.count(F.lit(1)).alias("tf"))
    return joint.withColumn("record_tokens", F.sum("tf").over(Window.partitionBy("record")))


def distinctive_terms(records: DataFrame, *, key: str, texts: list[str], exponent: float = CONTEXT_EXPONENT) -> DataFrame:
    """Positive pointwise mutual information of every term with every record.

    Returns (``record``, ``term``, ``tf``, ``df``, ``score``), one row for each
    term of each record. With joint counts tf, term totals c, record sizes n and
    Z the sum of all n ** exponent, score = max(0, ln(tf * Z / (c * n ** exponent))):
    a term common everywhere scores about 0, a rare term repeated in a few
    records scores high.

    Null and empty texts give no rows. Rows that share a key are one record.
    A null key is a record of its own. Other columns of the input are ignored,
    whatever their names. The joint counts are written once to the shared
    folder. Terms that occur in a large part of all records don't meet in one
    task: they are joined by broadcast, at most 511 of them by construction.
    """
    joint = materialize(term_record_counts(records, key=key, texts=texts), "joint")
    marginal = joint.groupBy("term").agg(F.sum("tf").alias("term_total"), F.count(F.lit(1)).alias("df"))
    context = joint.select("record", "record_tokens").distinct()
    smoothed = context.agg(F.coalesce(F.sum(F.pow(F.col("record_tokens").cast("double"), F.lit(exponent))), F.lit(0.0)).alias("z"))
    both = join_dimension(joint, marginal, "term", "df", ["record"]).crossJoin(F.broadcast(smoothed))
    pmi = F.log(F.col("tf") * F.col("z") / (F.col("term_total") * F.pow(F.col("record_tokens").cast("double"), F.lit(exponent))))
    return both.select("record", "term", "tf", "df", F.greatest(F.lit(0.0), pmi).alias("score"))
