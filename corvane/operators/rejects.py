"""Load CSV records and set apart those that can't be loaded, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of an export, in file order, under their table names.
EXPORT_COLUMNS = ["date_added", "trial_id", "title", "brief_title", "abstract", "publication_date", "phase"]

#: Registry name and the exact form of its identifiers.
REGISTRY_FORMS = {
    "NCT": r"NCT[0-9]{8}",
    "ChiCTR": r"ChiCTR[0-9]{10}",
    "CTRI": r"CTRI/[0-9]{4}/[0-9]{2}/[0-9]{7}",
    "EUCTR": r"[0-9]{4}-[0-9]{6}-[0-9]{2}",
    "DRKS": r"DRKS[0-9]{8}",
    "jRCT": r"jRCT[0-9]{10}",
}
#: How a line of an export begins that opens a record: the day it was added, or any short field and then an identifier.
RECORD_START = '^(?:"?[0-9]{4}-[0-9]{2}-[0-9]{2}"?,|(?:"[^",]{0,24}"|[^",]{0,24}),"?(?:' + "|".join(REGISTRY_FORMS.values()) + ')"?,)'
_CONTROL = "[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}\\x{FFFD}]"


def _pieces(raw: Column) -> Column:
    """The text between double quotes: even positions lie outside quotes, odd ones inside."""
    return F.split(raw, '"', -1)


def _broken_quoting(pieces: Column) -> Column:
    """A quote left open, text after a closing quote, or a quote inside a bare field.

    A doubled quote closes and reopens at once, which leaves an empty outside
    piece, so every other outside piece between two quoted stretches must begin
    and end at a comma. No regular expression with nested repeats is needed, so
    texts of any length are safe.
    """
    last = F.size(pieces) - 1

    def wrong(piece: Column, i: Column) -> Column:
        outside = (i % 2 == 0) & (piece != "")
        after_close = (i > 0) & ~piece.startswith(",")
        before_open = (i < last) & ~piece.endswith(",")
        return outside & (after_close | before_open)

    marked = F.transform(pieces, wrong)
    return (F.size(pieces) % 2 == 0) | F.exists(marked, lambda x: x)


def _field_count(pieces: Column) -> Column:
    commas = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))).otherwise(F.lit(0)))
    return F.aggregate(commas, F.lit(1), lambda a, x: a + x)


def registry_of(trial_id: Column) -> Column:
    """Registry whose identifier form the whole value has; null where none."""
    out = F.lit(None).cast("string")
    for name, form in reversed(REGISTRY_FORMS.items()):
        out = F.when(trial_id.rlike(rf"\A(?:{form})\z"), F.lit(name)).otherwise(out)
    return out


def _is_day(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~value.startswith("0000") & value.try_cast("date").isNotNull(), F.lit(False))


def read_records(lines: DataFrame, *, raw: str = "raw_line", line_no: str = "line_no", columns: list[str] | None = None, values: bool = True) -> DataFrame:
    """``lines`` with ``reason``, the parsed fields as struct ``fields`` and the raw text.

    The line is read permissively under the explicit schema, which keeps the raw
    text of records the reader itself rejects; every record is then classified
    by quoting, field count and value checks, in this order, because the
    permissive reader also lets stray quotes pass. ``reason`` is null for a
    loadable record. Line 1 of each file is a header and comes out in neither
    part. A null or empty line has no seven fields: ``column_count``. Other
    ``columns`` than those of an export may be given; without ``values`` only
    the form of a record is checked. One pass, no shuffle; all expressions stay
    in the JVM.
    """
    names = columns or EXPORT_COLUMNS
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "quote": '"', "escape": '"', "sep": ",", "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{name}` STRING" for name in [*names, "_corrupt_record"])
    body = lines.filter(F.coalesce(F.col(line_no) != 1, F.lit(True)))
    body = body.withColumn("__text", F.coalesce(F.col(raw), F.lit(""))).withColumn("__pieces", _pieces(F.col("__text")))
    body = body.withColumn("__shape", F.when(_broken_quoting(F.col("__pieces")), "quoting").when(_field_count(F.col("__pieces")) != len(names), "column_count"))
    body = body.withColumn("fields", F.from_csv(F.col("__text"), ddl, options))
    f = F.col("fields")
    bad_value = f["_corrupt_record"].isNotNull()
    if values:
        abstract = F.coalesce(f["abstract"], F.lit(""))
        bad_value = (
            registry_of(F.coalesce(f["trial_id"], F.lit(""))).isNull()
            | ~abstract.rlike(r"[^\s\p{Z}]")
            | abstract.rlike(_CONTROL)
            | ~_is_day(f["publication_date"])
            | bad_value
        )
    reason = F.coalesce(F.col("__shape"), F.when(bad_value, F.lit("invalid_value")))
    return body.withColumn("reason", reason).drop("__text", "__pieces", "__shape")


def rejected(lines: DataFrame, *, key: str = "line_id", **names: str) -> DataFrame:
    """(``line_id``, ``reason``) of every record that can't be loaded.

    Repeated lines come out once each; an empty table gives an empty result.
    """
    return read_records(lines, **names).filter(F.col("reason").isNotNull()).select(F.col(key).alias("line_id"), "reason")


def loaded(lines: DataFrame, *, key: str = "line_id", **names: str) -> DataFrame:
    """The loadable records as rows of the corpus table.

    ``row_id`` is the line's id, ``registry`` follows from the trial id and
    ``received_at`` is null because an export doesn't tell it. Optional fields
    left empty are null.
    """
    good = read_records(lines, **names).filter(F.col("reason").isNull())
    f = F.col("fields")
    null_if_empty = lambda c: F.when(f[c] != "", f[c]).alias(c)
    return good.select(
        F.col(key).alias("row_id"), f["trial_id"].alias("trial_id"), null_if_empty("title"), null_if_empty("brief_title"), f["abstract"].alias("abstract"),
        f["publication_date"].alias("publication_date"), null_if_empty("date_added"), null_if_empty("phase"), registry_of(f["trial_id"]).alias("registry"), F.lit(None).cast("timestamp_ntz").alias("received_at"),
    )
