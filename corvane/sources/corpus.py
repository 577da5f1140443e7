"""Read collections, query lists and judgement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.errors import CorpusNotFoundError, EmptyCorpusError, SchemaError
from corvane.operators.rejects import RECORD_START, read_records
from corvane.plans.materialize import materialize
from corvane.sources.records import csv_records

#: Column of an export and its name in the engine.
COLUMN_MAP = {"Trial ID": "trial_id", "Title": "title", "Abstract": "abstract", "Publication date": "publication_date", "Date added": "date_added", "Phase": "phase"}
REQUIRED = ["Trial ID", "Title", "Abstract", "Publication date"]
TEXT_FIELDS = ["abstract", "title"]

#: Spellings that count as missing in a CSV.
MISSING = ["", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "None", "<NA>"]


def missing_required(present: list[str]) -> list[str]:
    return sorted(set(REQUIRED) - set(present))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, without reading its rows."""
    try:
        return spark.read.option("header", True).option("escape", "\"").option("recursiveFileLookup", True).csv(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise CorpusNotFoundError(path) from e
        raise


def read_csv_parts(spark: SparkSession, path: str, *, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV export, and (``file``, ``block``, ``nth``, ``reason``, ``raw``) of the records that can't be read.

    A record is set apart if its quoting is broken or its number of fields isn't
    that of the header. Rows have the six engine columns as strings: quoted
    fields may hold line ends; missing required columns raise with the columns
    found; absent optional ones come out null. The row limit is applied, in file
    order, before blank rows are dropped. A row is blank if all its text fields
    are missing.
    """
    found = header(spark, path)
    lacking = missing_required(found)
    if lacking:
        raise SchemaError(f"{path}: columns {lacking} are missing; found {found[:8]}")
    export = found[1:2] == ["Trial ID"]
    records = csv_records(spark, path, record_start=RECORD_START if export else None).withColumn("line_no", F.when(F.col("header"), 1).otherwise(2))
    read = read_records(records, raw="raw", columns=[f"c{i}" for i in range(len(found))], values=False)
    good = read.filter(F.col("reason").isNull())
    if limit is not None:
        good = good.orderBy("file", "block", "nth").limit(limit)
    value = lambda c: F.when(~c.isin(MISSING), c)
    rows = good.select(*[(value(F.col("fields")[f"c{found.index(c)}"]) if c in found else F.lit(None).cast("string")).alias(name) for c, name in COLUMN_MAP.items()])
    return drop_blank(rows), read.filter(F.col("reason").isNotNull()).select("file", "block", "nth", "reason", "raw")


def read_csv(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """The good rows of ``read_csv_parts``."""
    return read_csv_parts(spark, path, limit=limit)[0]


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_id``: 0, 1, 2 ... in the order of a 128-bit digest over all columns, nulls told apart.

    Every row keeps its own id, equal rows neighbouring ones, so nothing is
    dropped and no two rows share an id; the ids don't depend on partitions.
    Equal rows, however many, are spread over the sorted partitions by their
    place. One shuffle; the only table gathered has a row per partition.
    """
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in rows.columns]
    keyed = rows.withColumn("__h", F.md5(F.concat(*marked))).withColumn("__n", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange("__h", "__n").sortWithinPartitions("__h", "__n").drop("__h", "__n")
    # an id holds the partition's number and the place in it
    held = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(before), part == F.col("__p")).select((F.col("__before") + place).alias("row_id"), *rows.columns)


def drop_blank(rows: DataFrame) -> DataFrame:
    """Rows with at least one text field that isn't null."""
    return rows.na.drop(how="all", subset=TEXT_FIELDS)


def require_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise EmptyCorpusError("no rows with text")
    return rows


def text_of(rows: DataFrame, field: str) -> DataFrame:
    """One text column, null as ""."""
    if field not in rows.columns:
        raise SchemaError(f"no field {field}; found {rows.columns[:8]}")
    return rows.withColumn("text", F.coalesce(F.col(field), F.lit("")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(``query_text``): one query per line; blank lines and # comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(line.alias("query_text"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(``query_text``, ``stratum``, ``relevant``, ``note``, ``judged_by``) of a JSON list or {"queries": [...]}.

    Entries without a query or without relevant ids raise.
    """
    entry = "query STRING, stratum STRING, relevant ARRAY<STRING>, note STRING, judged_by STRING"
    raw = spark.read.text(path, wholetext=True)
    is_list = F.ltrim("value").startswith("[")
    entries = F.when(is_list, F.from_json("value", f"ARRAY<STRUCT<{entry.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>")).otherwise(F.from_json("value", f"queries ARRAY<STRUCT<{entry.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>")["queries"])
    rows = raw.select(F.explode(entries).alias("e")).select(F.col("e.query").alias("query_text"), "e.stratum", "e.relevant", "e.note", "e.judged_by")
    bad = rows.filter((F.trim(F.coalesce("query_text", F.lit(""))) == "") | F.col("relevant").isNull() | (F.size("relevant") == 0))
    if not bad.isEmpty():
        raise SchemaError(f"{path}: entries without query or relevant ids")
    return rows
