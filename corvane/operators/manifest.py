"""Identity of collections, models and indexes, and checks that they belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from corvane.errors import ConfigurationError, CorpusNotFoundError, CorvaneError, DataError, EmptyCorpusError, IndexBuildError, MismatchError, ModelError, NotTrainedError, ResourceError, SchemaError, StaleIndexError  # noqa: F401
from corvane.functions.text import short_hash


def _summed_digests(text: Column) -> list[Column]:
    """Exact sums of both halves of a 128-bit digest of each row, and the number of rows; the same in any order."""
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.md5(text), at, 16), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).cast("string"), half(1), half(17)]


def file_fingerprint(spark, path: str) -> str:
    """First 16 hex digits of SHA-256 over the summed digests of all lines and their number.

    Lines are digested where they are read, in blocks, so files of any size will
    do. The order of lines doesn't count.
    """
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise CorpusNotFoundError(path) from e
        raise
    return lines.agg(short_hash(F.concat_ws("|", *_summed_digests(F.col("value")))).alias("f")).first()["f"]


def table_fingerprint(table: DataFrame) -> DataFrame:
    """One row ``fingerprint`` of a table of any size: the same for the same rows in any order.

    Digests of rows, in which a null is told from any value and each value from
    its neighbours, are summed exactly, so no rows are gathered or sorted.
    """
    text = lambda c: F.to_json(F.array(F.col(c))) if isinstance(table.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c).cast("string")
    marked = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in sorted(table.columns)]
    return table.agg(short_hash(F.concat_ws("|", *_summed_digests(F.concat(*marked)))).alias("fingerprint"))


def model_fingerprint(kind: str, corpus: str, params: dict) -> str:
    """Identity of a training: kind, collection and parameters in name order, without the degree of parallelism."""
    import hashlib

    fields = [kind, corpus, *(str(params[k]) for k in sorted(params) if k != "partitions")]
    return hashlib.sha256("|".join(fields).encode()).hexdigest()[:16]


def sampled_limit(fingerprint: Column) -> Column:
    """Row limit a sampled collection's fingerprint carries, as in abc-n200; null if whole."""
    found = F.regexp_extract(fingerprint, "-n([0-9]+)$", 1)
    return F.when(found != "", found).cast("bigint")


def findings(models: DataFrame, indexes: DataFrame, live: DataFrame, *, max_mb: float = 200.0) -> DataFrame:
    """(``severity``, ``code``, ``subject``): what doesn't fit, the most severe first.

    ``models``: ``kind``, ``fingerprint``, ``corpus_fingerprint``,
    ``vectors_checksum``, ``sampled``, ``mb``; null ``fingerprint`` = not
    trained. ``indexes``: ``kind``, ``field``, ``model_fingerprint``,
    ``corpus_fingerprint``, ``vectors_checksum``, ``size``. ``live``: one row
    ``fingerprint``, ``rows``; none = no collection.
    """
    now = F.broadcast(live.select(F.col("fingerprint").alias("live"), F.col("rows").alias("live_rows")))
    none = live.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("ERROR").alias("severity"), F.lit("corpus-missing").alias("code"), F.lit("corpus").alias("subject"))
    flag = lambda when, severity, code: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    m = models.crossJoin(now)
    trained = F.col("fingerprint").isNotNull()
    of_model = m.select(
        F.col("kind").alias("subject"),
        F.array_compact(F.array(
            flag(~trained, "WARN", "model-missing"), flag(trained & F.col("sampled"), "WARN", "model-sampled"),
            flag(trained & (F.regexp_replace("corpus_fingerprint", "-n[0-9]+$", "") != F.col("live")), "WARN", "model-corpus-stale"), flag(trained & (F.col("mb") > max_mb), "WARN", "artefact-oversized"),
        )).alias("f"),
    )
    owner = models.filter(trained).select("kind", F.col("fingerprint").alias("have"), F.col("vectors_checksum").alias("have_sum"))
    i = indexes.join(owner, "kind").crossJoin(now)
    limit = sampled_limit(F.col("corpus_fingerprint"))
    wanted = F.when(limit.isNotNull(), F.concat("live", F.lit("-n"), limit.cast("string"))).otherwise(F.col("live"))
    of_index = i.select(
        F.concat_ws("-", "kind", "field").alias("subject"),
        F.array_compact(F.array(
            flag(F.col("model_fingerprint") != F.col("have"), "ERROR", "index-model-mismatch"),
            flag(F.col("have_sum").isNotNull() & F.col("vectors_checksum").isNull(), "WARN", "index-predates-checksum"),
            flag(F.col("vectors_checksum") != F.col("have_sum"), "ERROR", "index-model-vectors-stale"), flag(F.col("corpus_fingerprint") != wanted, "ERROR", "index-corpus-stale"),
            flag(limit.isNotNull(), "WARN", "index-sampled"), flag(limit.isNull() & (F.col("size") != F.col("live_rows")), "ERROR", "index-size-mismatch"),
        )).alias("f"),
    )
    both = of_model.unionByName(of_index).select("subject", F.explode("f").alias("x")).select("x.severity", "x.code", "subject")
    return both.unionByName(none).orderBy(F.when(F.col("severity") == "ERROR", 0).otherwise(1), "code", "subject")
