"""Older forms of artefacts: document vectors as the columns of a CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.errors import SchemaError

#: Documents of one such file, at most: a file has a column for each.
MOST_COLUMNS = 20_000


def write_vector_columns(vectors: DataFrame, path: str) -> None:
    """(``doc_id``, ``v``) as a CSV with a column per document, named after its id, and a line per dimension."""
    ids = [r["doc_id"] for r in vectors.select("doc_id").orderBy("doc_id").limit(MOST_COLUMNS + 1).collect()]
    if len(ids) > MOST_COLUMNS:
        raise SchemaError(f"more than {MOST_COLUMNS} documents; use a table")
    flat = vectors.select("doc_id", F.posexplode("v").alias("pos", "x"))
    flat.groupBy("pos").pivot("doc_id", ids).agg(F.first("x")).coalesce(1).sortWithinPartitions("pos").write.mode("overwrite").option("header", True).csv(path)


def read_vector_columns(spark: SparkSession, path: str) -> DataFrame:
    """(``doc_id``, ``v``) of such a file. Empty fields end a vector that is shorter than the others."""
    rows = spark.read.option("header", True).csv(path)
    names = [c for c in rows.columns if c != "pos"]
    if len(names) == len(rows.columns):
        raise SchemaError(f"{path}: no column pos")
    cells = F.array(*[F.struct(F.lit(n).alias("doc_id"), F.col(f"`{n}`").cast("double").alias("x")) for n in names]) if names else F.array().cast("array<struct<doc_id:string,x:double>>")
    each = rows.select(F.col("pos").cast("int").alias("pos"), F.explode(cells).alias("c")).filter(F.col("c.x").isNotNull())
    return each.groupBy(F.col("c.doc_id").cast("bigint").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("c.x").alias("x")))), lambda p: p["x"]).alias("v"))
