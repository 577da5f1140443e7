"""Keep token tables, postings, models and indexes on shared storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.manifest import MismatchError, NotTrainedError, StaleIndexError, table_fingerprint


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of each file of a path, which may hold wildcards; empty if there is none."""
    fs, p = _fs(spark, path)
    found = fs.globStatus(p) or []
    return sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for f in found for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(json.dumps(value, indent=2, sort_keys=True).encode())
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise NotTrainedError(path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def cached(build, spark: SparkSession, root: str, *, fingerprint: str, field: str, force: bool = False) -> DataFrame:
    """The table under (fingerprint, field); built by ``build()`` and written only if it isn't there yet.

    Parquet's commit marks a finished table, so a broken write is built again.
    """
    path = f"{root}/fp={fingerprint}/field={field}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_table(table: DataFrame, path: str, **about) -> dict:
    """Write a table and its manifest; the manifest, written last, has the table's own checksum."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data")
    manifest = about | {"checksum": table_fingerprint(written).first()["fingerprint"], "rows": written.count(), "columns": written.columns}
    write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def check(path: str, manifest: dict, wanted: dict) -> None:
    """Raise if a manifest doesn't have the wanted values; another collection is a ``StaleIndexError``."""
    for name, value in wanted.items():
        if manifest.get(name) != value:
            raise (StaleIndexError if name == "corpus_fingerprint" else MismatchError)(f"{path}: {name} is {manifest.get(name)}, not {value}")


def load_table(spark: SparkSession, path: str, *, verify: bool = False, **wanted) -> tuple[DataFrame, dict]:
    """A saved table and its manifest.

    Raises if it isn't there, if a ``wanted`` manifest value differs (a stale
    collection raises ``StaleIndexError``) or, with ``verify``, if the data
    don't have the checksum.
    """
    manifest = read_json(spark, f"{path}/manifest.json")
    check(path, manifest, wanted)
    table = spark.read.parquet(f"{path}/data")
    if verify and table_fingerprint(table).first()["fingerprint"] != manifest["checksum"]:
        raise MismatchError(f"{path}: the data have changed since the manifest was written")
    return table, manifest


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(``folder``, ``files``, ``bytes``) below a path, from file metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def report_rows(hits: DataFrame, digits: int = 4) -> DataFrame:
    """Result rows with the score rounded for display, in rank order per query."""
    return hits.withColumn("score", F.round("score", digits)).orderBy("query_id", "rank")


def write_report(table: DataFrame, path: str) -> None:
    """A report as JSON lines; reports are means or top-k lists, so one file holds them."""
    table.coalesce(1).write.mode("overwrite").json(path)


def candidate_sheet(candidates: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(``query_id``, ``query_text``, ``json``): candidates to label, with the start of title and abstract and no verdict yet.

    ``candidates`` has ``query_id``, ``trial_id``, ``found_by``, ``place``, a
    bounded list per query.
    """
    shown = corpus.groupBy("trial_id").agg(F.max_by(F.struct(F.substring("title", 1, 200).alias("title"), F.substring("abstract", 1, 320).alias("abstract")), "row_id").alias("d"))
    rows = candidates.join(shown, "trial_id").select("query_id", F.struct("place", "trial_id", "found_by", "d.title", "d.abstract", F.lit(None).cast("boolean").alias("relevant")).alias("c"))
    lists = rows.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list("c")), {"ignoreNullFields": "false"}).alias("json"))
    return queries.select("query_id", "query_text").join(lists, "query_id")


def as_json(hits: DataFrame) -> DataFrame:
    """One JSON text per query: its hits in rank order; ``hits`` are top-k lists, bounded by k."""
    cols = [c for c in hits.columns if c != "query_id"]
    ordered = F.array_sort(F.collect_list(F.struct("rank", *[c for c in cols if c != "rank"])))
    return hits.groupBy("query_id").agg(F.to_json(ordered).alias("json"))
