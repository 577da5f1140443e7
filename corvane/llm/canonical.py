"""One consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.plans.batches import text_slices
from corvane.plans.materialize import materialize
from corvane.plans.skew import join_dimension
from corvane.plans.spread import spread

_TOP = 0x110000

#: Signs of other scripts that are printed as the Latin letter beside them.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ӏ": "l", "Ӏ": "I",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters and signs
    "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U",
    # Latin letters of other forms
    "ɡ": "g",
}

#: Invisible signs outside the format category.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
#: Format characters that are printed.
VISIBLE_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
#: Hyphens of the length of the ASCII one.
HYPHENS = [0x2010, 0x2011]


def _target(cp: int) -> str:
    """The characters a code point stands for, before marks are composed."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if (kind == "Cf" and cp not in VISIBLE_FORMAT) or cp in _INVISIBLE or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if kind == "Zs" or ch == "\t":
        return " "
    if cp in HYPHENS:
        return "-"
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<wide>", "<narrow>")):
        ch = unicodedata.normalize("NFKC", ch)
    elif tag.startswith("<compat>") and kind in ("Ll", "Lu", "Lt", "Nl"):
        plain = unicodedata.normalize("NFKC", ch)
        if cp == 0xB5 or (plain.isascii() and plain.isalpha() and cp not in (0x17F, 0xFB05)):
            ch = plain
    if not 0xAC00 <= cp <= 0xD7A3:
        ch = unicodedata.normalize("NFD", ch)
    return "".join(LOOK_ALIKES.get(c, c) for c in ch)


_INVISIBLE = frozenset(INVISIBLE)


class Tables:
    """Lookup tables, built once per Python worker from the Unicode database by rule."""

    def __init__(self):
        self.width = np.ones(_TOP, np.uint8)
        self.start = np.arange(_TOP, dtype=np.int32)
        flat = [np.arange(_TOP, dtype=np.uint32)]
        extra, base = [], _TOP
        self.mark_class = np.zeros(_TOP, np.uint8)
        pairs = {}
        for cp in range(_TOP):
            if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF or (cp >= 0x2FA20 and not 0xE0000 <= cp <= 0xE01EF):
                continue  # ideographs, syllables, surrogates, private and unassigned: all stand for themselves
            ch = chr(cp)
            self.mark_class[cp] = unicodedata.combining(ch)
            to = _target(cp)
            if to != ch:
                self.width[cp], self.start[cp] = len(to), base
                extra += map(ord, to)
                base += len(to)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                first = LOOK_ALIKES.get(chr(int(parts[0], 16)), chr(int(parts[0], 16)))
                if ord(first) == int(parts[0], 16):
                    pairs[ord(first) << 21 | int(parts[1], 16)] = cp
        self.flat = np.concatenate([*flat, np.array(extra, np.uint32)])
        self.pair = np.array(sorted(pairs), np.int64)
        self.composite = np.array([pairs[k] for k in sorted(pairs)], np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _decode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and each row's bounds in it."""
    array = array.cast(pa.large_string())
    ends = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2], np.uint8)[ends[0] : ends[-1]] if array.buffers()[2] is not None else np.empty(0, np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, begun[ends - ends[0]]


def _encode(points: np.ndarray, bounds: np.ndarray, array: pa.Array) -> pa.Array:
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])[bounds]
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    text = pa.Array.from_buffers(pa.large_string(), len(array), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())
    if array.null_count:
        text = pa.compute.if_else(array.is_valid(), text, pa.scalar(None, pa.string()))
    return text


def _keep(points: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _expand(t: Tables, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = t.width[points].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(width)])
    if len(points) == ends[-1] and not (width != 1).any():
        return t.flat[t.start[points]], bounds
    source = np.repeat(t.start[points] - ends[:-1], width) + np.arange(ends[-1])
    return t.flat[source], ends[bounds]


def _compose(t: Tables, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order marks by class, then join each with its base, one step for the n-th mark of all bases at once."""
    kind = t.mark_class[points]
    marks = np.flatnonzero(kind)
    if not len(marks):
        return points, bounds
    opens = kind == 0
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    opens[first] = True
    group = np.cumsum(opens) - 1  # a base with the marks after it, within one row
    heads = np.flatnonzero(opens)
    out_of_order = (kind[1:] < kind[:-1]) & (kind[1:] > 0) & ~opens[1:]
    if out_of_order.any():
        at = np.lexsort((kind, group))
        points, kind = points[at], kind[at]
    points = points.copy()
    inner = np.flatnonzero(~opens)
    if not len(inner):
        return points, bounds
    nth = inner - heads[group[inner]]
    keep = np.ones(len(points), bool)
    blocked = np.zeros(len(heads), np.uint8)
    order = np.argsort(nth, kind="stable")
    inner, nth = inner[order], nth[order]
    cuts = np.flatnonzero(np.diff(nth)) + 1
    for at in np.split(inner, cuts):
        base = heads[group[at]]
        key = points[base].astype(np.int64) << 21 | points[at]
        place = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        joins = (t.pair[place] == key) & (kind[base] == 0) & (blocked[group[at]] < kind[at])
        points[base[joins]] = t.composite[place[joins]]
        keep[at[joins]] = False
        blocked[group[at[~joins]]] = kind[at[~joins]]
    return _keep(points, bounds, keep)


def _join_jamo(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining Korean letters as syllables."""
    lead = (points >= 0x1100) & (points < 0x1113)
    if not lead.any():
        return points, bounds
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = lambda i, j: row[i] == row[j]
    i = np.flatnonzero(lead[:-1] & (points[1:] >= 0x1161) & (points[1:] < 0x1176))
    i = i[same(i, i + 1)]
    points, keep = points.copy(), np.ones(len(points), bool)
    made = 0xAC00 + ((points[i] - 0x1100) * 21 + points[i + 1] - 0x1161) * 28
    keep[i + 1] = False
    third = np.minimum(i + 2, len(points) - 1)
    tail = (i + 2 < len(points)) & (points[third] > 0x11A7) & (points[third] < 0x11C3) & same(i, third)
    points[i] = made + np.where(tail, points[third] - 0x11A7, 0)
    keep[third[tail]] = False
    return _keep(points, bounds, keep)


def _trim(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop blanks and line ends at both ends of every row."""
    solid = np.concatenate([[0], np.cumsum((points != 32) & (points != 10) & (points != 13))])
    before = solid[:-1] - np.repeat(solid[bounds[:-1]], np.diff(bounds))
    total = np.repeat(solid[bounds[1:]] - solid[bounds[:-1]], np.diff(bounds))
    inked = np.diff(solid) == 1
    keep = inked | ((before > 0) & (before < total))
    return _keep(points, bounds, keep)


def canonical_array(array: pa.Array) -> pa.Array:
    """Canonical form of every text; null stays null. No work is done row by row."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    t = tables()
    points, bounds = _decode(array.fill_null("") if array.null_count else array)
    points, bounds = _expand(t, points, bounds)
    points, bounds = _compose(t, points, bounds)
    points, bounds = _join_jamo(points, bounds)
    points, bounds = _trim(points, bounds)
    return _encode(points, bounds, array)


@F.arrow_udf(StringType())
def _canonical(values: pa.Array) -> pa.Array:
    return pa.concat_arrays([canonical_array(values.slice(lo, n)) for lo, n in text_slices(values)]) if len(values) else values


def canonical(text: Column) -> Column:
    """Canonical form of a text column, computed on whole Arrow batches.

    Full- and half-width forms become ordinary ones, accents are composed,
    invisible characters go, every blank becomes a space and blanks at the ends
    are dropped, ligatures and Roman numeral signs become letters, and signs of
    other scripts printed as a Latin letter become that letter. Case, dash
    length, raised digits, missing accents and unlike Greek letters stay.
    Null gives null; the empty text and a text of blanks only give "".
    Applying it twice gives the same as once.
    """
    return _canonical(text)


def canonical_values(table: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """(``text_field``, ``row_id``, ``stored``, ``canonical``) of every non-null value."""
    stacked = spread(table, key).select(F.col(key).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("text_field"), F.col(f).alias("stored")) for f in fields])).alias("v"))
    stacked = stacked.select("v.text_field", "row_id", "v.stored").filter(F.col("stored").isNotNull())
    return stacked.withColumn("canonical", canonical(F.col("stored")))


def lookalike_pairs(table: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """(``text_field``, ``row_id_a``, ``row_id_b``): same canonical form, other stored characters.

    Rows with equal stored values are no pair. Forms are compared as classes:
    first the distinct stored forms of each canonical form are paired, then
    each pair is expanded to its rows, so a value that a third of all rows share
    in one form costs nothing. Values are compared by 128-bit digests.
    Null keys take no part.
    """
    rows = canonical_values(table.filter(F.col(key).isNotNull()), key=key, fields=fields)
    rows = materialize(rows.select("text_field", "row_id", F.unhex(F.md5("canonical")).alias("canon"), F.unhex(F.md5("stored")).alias("form")), "canonical")
    forms = rows.select("text_field", "canon", "form").distinct()
    several = forms.groupBy("text_field", "canon").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    forms = forms.join(several, ["text_field", "canon"], "left_semi")
    a, b = forms.withColumnRenamed("form", "form_a"), forms.withColumnRenamed("form", "form_b")
    pairs = a.join(b, ["text_field", "canon"]).filter(F.col("form_a") < F.col("form_b"))
    left = rows.select("text_field", "canon", F.col("form").alias("form_a"), F.col("row_id").alias("id_a"))
    right = rows.select("text_field", "canon", F.col("form").alias("form_b"), F.col("row_id").alias("id_b"))
    met = pairs.join(left, ["text_field", "canon", "form_a"]).join(right, ["text_field", "canon", "form_b"])
    met = met.filter(F.col("id_a") != F.col("id_b"))
    return met.select("text_field", F.least("id_a", "id_b").alias("row_id_a"), F.greatest("id_a", "id_b").alias("row_id_b"))


def lookalike_classes(values: DataFrame) -> DataFrame:
    """(``text_field``, ``row_id``, ``class_id``, ``rows``, ``written``): one row per value, the linear form of all pairs.

    ``values`` as of ``canonical_values``. Values with the same canonical form
    are a class, named after its smallest row; ``rows`` counts it and
    ``written`` its different stored forms. Forms are known by 128-bit digests.
    A class that a third of all rows share isn't gathered: it is counted before
    the shuffle, by stored form and then in all, and joined under skew. Null
    keys take no part.
    """
    keyed = values.filter(F.col("row_id").isNotNull()).select("text_field", "row_id", F.concat_ws(":", "text_field", F.md5("canonical")).alias("form"), F.md5("stored").alias("stored"))
    keyed = materialize(keyed, "forms")
    ways = keyed.groupBy("form", "stored").agg(F.min("row_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = materialize(ways.groupBy("form").agg(F.min("low").alias("class_id"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("written")), "classes")
    return join_dimension(keyed.select("text_field", "row_id", "form"), classes, "form", "rows", ["row_id"]).select("text_field", "row_id", "class_id", "rows", "written")
