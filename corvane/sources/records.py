"""Cut CSV files into records, in parallel within a file as well."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _open_before(lines: pa.Array, starts: pa.Array | None, opened: int) -> tuple[np.ndarray, int]:
    """Whether each line begins inside a quoted field (1) or not (0), and the same after the last line.

    A line that looks like the start of a record is one, whatever came before:
    a quote left open damages its own record, not the rest of the file.
    """
    odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64) % 2
    before = np.concatenate([[0], np.cumsum(odd)])
    sure = starts.to_numpy(zero_copy_only=False).astype(bool) if starts is not None else np.zeros(len(odd), bool)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(odd)), -1))
    state = (before[:-1] + np.where(last < 0, opened, before[last])) % 2
    return state, int((state[-1] + odd[-1]) % 2) if len(odd) else opened


def _runs(keys: list[np.ndarray], n: int) -> list[tuple[int, int]]:
    """Bounds of the stretches of rows with equal keys."""
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cut = np.concatenate([[0], np.flatnonzero(change) + 1, [n]]).astype(int)
    return list(zip(cut[:-1], cut[1:], strict=True)) if n else []


def csv_records(spark: SparkSession, path: str, *, record_start: str | None = None) -> DataFrame:
    """(``file``, ``block``, ``nth``, ``header``, ``raw``): one row per record, line ends inside quoted fields kept as one \\n.

    Files are read in blocks like any text, so a large file isn't one task. A
    line opens a record if the quotes before it are closed. What state a block
    begins in follows from the quotes of all blocks before it: these are counted
    in a first pass, one row per block, and known to all tasks of the second.
    Records that reach over a block's end are put together afterwards. With
    ``record_start``, a pattern, a line that matches opens a record even inside
    quotes. ``header`` marks the first record of each file; blank lines are no
    records. ``file``, ``block``, ``nth`` give the order.
    """
    source = spark.read.option("recursiveFileLookup", True).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    columns = ["value", "file_path", "file_block_start"]

    def pieces(b: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array, pa.Array | None]]:
        where, at = b.column(1), b.column(2).to_numpy()
        names = where.dictionary_encode().indices.to_numpy()
        for lo, hi in _runs([names, at], b.num_rows):
            lines = b.column(0).slice(lo, hi - lo)
            yield (where[lo].as_py(), int(at[lo])), lines, pc.match_substring_regex(lines, record_start) if record_start else None

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for b in batches:
            for key, lines, starts in pieces(b):
                from_closed, from_open = held.setdefault(key, [0, 1])
                held[key] = [_open_before(lines, starts, s)[1] for s in (from_closed, from_open)]
        if held:
            yield pa.RecordBatch.from_pydict({"file": [k[0] for k in held], "block": [k[1] for k in held], "closed": [v[0] for v in held.values()], "open": [v[1] for v in held.values()]})

    blocks = source.select(*columns).mapInArrow(summary, "file string, block bigint, closed bigint, open bigint").toArrow().to_pylist()  # one row per block of a file
    begin: dict[tuple[str, int], int] = {}
    state, name = 0, None
    for r in sorted(blocks, key=lambda r: (r["file"], r["block"])):
        state = state if r["file"] == name else 0
        name = r["file"]
        begin[name, r["block"]] = state
        state = r["open"] if state else r["closed"]
    shipped = spark.sparkContext.broadcast(begin)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records; the last of a block and what precedes its first are pieces, known by ``kind``."""
        key, opened, nth, rest, fresh = None, 0, 0, [], True

        def piece(kind: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [key[0]], "block": pa.array([key[1]], pa.int64()), "nth": pa.array([nth], pa.int64()), "kind": [kind], "raw": ["\n".join(rest)]})

        for b in batches:
            for now, lines, starts in pieces(b):
                if now != key:
                    if rest:
                        yield piece("tail" if fresh else "head" if opened else "whole")
                    key, opened, nth, rest, fresh = now, shipped.value[now], 0, [], True
                state, opened = _open_before(lines, starts, opened)
                begins = np.flatnonzero(state == 0)
                if not len(begins):
                    rest += lines.to_pylist()
                    continue
                rest += lines.slice(0, begins[0]).to_pylist()
                if rest:
                    yield piece("tail" if fresh else "whole")
                    nth += 1
                fresh = False
                if len(begins) > 1:
                    lists = pa.ListArray.from_arrays(pa.array(begins - begins[0], pa.int32()), lines.slice(begins[0], begins[-1] - begins[0]))
                    n = len(begins) - 1
                    yield pa.RecordBatch.from_pydict({"file": [key[0]] * n, "block": pa.array([key[1]] * n, pa.int64()), "nth": pa.array(np.arange(nth, nth + n)), "kind": ["whole"] * n, "raw": pc.binary_join(lists, "\n")})
                    nth += n
                rest = lines.slice(begins[-1]).to_pylist()
        if rest:
            yield piece("tail" if fresh else "head" if opened else "whole")

    found = source.select(*columns).mapInArrow(cut, "file string, block bigint, nth bigint, kind string, raw string")
    whole = found.filter("kind = 'whole'").select("file", "block", "nth", "raw")
    # two pieces a block at most: a head and the tails that follow it, in order, are one record
    bits = found.filter("kind <> 'whole'")
    place = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "tail", 0).otherwise(1))
    bits = bits.withColumn("of", F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(place)).withColumn("at", F.row_number().over(place))
    joined = bits.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("at", "block", "nth", "raw"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["nth"].alias("nth"), F.array_join("p.raw", "\n").alias("raw"))
    both = whole.unionByName(joined).filter(F.trim("raw") != "")
    return both.select("file", "block", "nth", ((F.col("block") == 0) & (F.col("nth") == 0)).alias("header"), "raw")
