"""Use all cores on small inputs that come as one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size below which the file source doesn't split further, the default open cost of a file.
LEAST_SPLIT = 4 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over as many partitions as there are cores, if its scan gives fewer.

    For text work that costs far more than moving the rows. Sizes come from the
    plan's statistics, nothing is run. An input of many splits, as any large
    one, is returned as it is: no shuffle is added there.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * 8 * LEAST_SPLIT:
        return df
    total = size + LEAST_SPLIT * max(1, len(df.inputFiles()))
    if round(total / max(LEAST_SPLIT, total / cores)) >= cores:
        return df
    return df.repartition(cores, F.col(key))
