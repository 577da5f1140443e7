"""Persistent counts of every term, kept up to date by signed deltas."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.materialize import scratch_path

#: Delta tables after which all are compacted into one, and the share of the base's rows from which they are.
MOST_DELTAS, COMPACT_SHARE = 16, 0.5
#: A term in at most this many records is rare.
RARE_RECORDS = 2
#: A term in at least this share of the records is common.
COMMON_SHARE = 0.4

_COUNTS = "field string, term string, occurrences bigint, records bigint"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """(``field``, ``term``, ``occurrences``, ``records``) changes, summed per term.

    ``changes`` has ``field``, ``before`` and ``after``, the term arrays of a
    record in the old and the new state: ``before`` is null for an added record,
    ``after`` for a deleted one. Terms of ``before`` count negative, those of
    ``after`` positive. The row with a null term holds the change of the number
    of records. A record present on both sides costs nothing where it is equal:
    such rows are dropped before any term is expanded. The first aggregation
    runs before the shuffle, so a hot term sends one row per task.
    """
    real = changes.filter(~F.col("before").eqNullSafe(F.col("after")))
    signed = real.select("field", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("terms")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("terms")))).alias("s"))
    signed = signed.filter(F.col("s.terms").isNotNull()).select("field", F.col("s.sign").alias("sign"), F.col("s.terms").alias("terms"))
    one = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("n"), F.lit(1).alias("r")))
    every = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("r")))
    distinct = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("r")))
    rows = signed.select("field", "sign", F.explode(F.concat(one, every, distinct)).alias("x"))
    summed = rows.groupBy("field", F.col("x.term").alias("term")).agg(F.sum(F.col("sign") * F.col("x.n")).cast("bigint").alias("occurrences"), F.sum(F.col("sign") * F.col("x.r")).cast("bigint").alias("records"))
    return summed.filter((F.col("occurrences") != 0) | (F.col("records") != 0))


class ConflictError(RuntimeError):
    """Another writer committed first; merge the batch again."""


class TermCountStore:
    """Counts of all terms on shared storage: a base table and the deltas merged since.

    A batch only writes its own aggregated deltas; old counts are neither read
    nor rewritten. The tables are summed on reading. When the deltas hold half
    as many rows as the base, or are many, they are compacted into a new base,
    so every count is rewritten a logarithmic number of times. Each table has
    as many partitions as its size takes (adaptive execution cuts the shuffle
    by size), sorted by term, so a lookup skips most row groups.

    A commit is the creation of ``manifest-N.json``, the next number, by a
    rename that fails if the file is there: readers always find the last whole
    state, nothing is deleted before it, and of two writers one gets a
    ``ConflictError``. A batch id that was merged before changes nothing; ids
    are marker files, so the manifest doesn't grow. Replaced tables are deleted
    one compaction later, when no reader of the last manifest needs them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, most_deltas: int = MOST_DELTAS, compact_share: float = COMPACT_SHARE):
        self.spark, self.path = spark, path or scratch_path(spark, "term-counts")
        self.most_deltas, self.compact_share = most_deltas, compact_share

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The last committed state: version, batch, tables (version and rows of each, base first) and replaced tables."""
        fs, root = self._file("")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "batch": None, "tables": [], "replaced": []}
        stream = fs.open(self._file(f"manifest-{max(versions)}.json")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        fs, made = self._file(f"tmp-{uuid.uuid4().hex}")
        out = fs.create(made, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        _, final = self._file(f"manifest-{manifest['version']}.json")
        if fs.exists(final) or not fs.rename(made, final):
            fs.delete(made, False)
            raise ConflictError(f"{self.path}: version {manifest['version']} exists")
        for name in (f"manifest-{manifest['version'] - 2}.json",):
            fs.delete(self._file(name)[1], False)

    def _marker(self, batch: str):
        return self._file(f"batches/{hashlib.sha256(batch.encode()).hexdigest()}")

    def merged(self, batch: str, manifest: dict | None = None) -> bool:
        manifest = manifest or self.manifest()
        fs, p = self._marker(batch)
        return manifest["batch"] == batch or fs.exists(p)

    def _scan(self, tables: list[dict]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], _COUNTS)
        return self.spark.read.schema(_COUNTS).parquet(*[f"{self.path}/{t['name']}" for t in tables])

    def _summed(self, tables: list[dict]) -> DataFrame:
        found = self._scan(tables)
        if len(tables) < 2:
            return found
        found = found.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return found.filter((F.col("occurrences") != 0) | (F.col("records") != 0))

    def counts(self) -> DataFrame:
        """(``field``, ``term``, ``occurrences``, ``records``); the null term holds the number of records."""
        return self._summed(self.manifest()["tables"])

    def _written(self, table: DataFrame, version: int) -> dict:
        name = f"v={version}-{uuid.uuid4().hex[:8]}"
        table.select("field", "term", "occurrences", "records").sortWithinPartitions("field", "term").write.parquet(f"{self.path}/{name}")
        entry = {"name": name, "rows": 0}
        return entry | {"rows": self._scan([entry]).count()}  # from the footers

    def merge(self, changes: DataFrame, batch: str) -> None:
        """Merge the deltas of one batch of added, changed and deleted records."""
        now = self.manifest()
        if self.merged(batch, now):
            return
        if now["batch"] is not None:  # the last batch gets its marker before its name leaves the manifest
            fs, p = self._marker(now["batch"])
            fs.create(p, True).close()
        version = now["version"] + 1
        self._commit({"version": version, "batch": batch, "tables": [*now["tables"], self._written(signed_deltas(changes), version)], "replaced": now["replaced"]})
        self._compact()

    def _compact(self) -> None:
        now = self.manifest()
        base, deltas = now["tables"][0], now["tables"][1:]
        if not deltas or (len(deltas) < self.most_deltas and sum(t["rows"] for t in deltas) < self.compact_share * base["rows"]):
            return
        version = now["version"] + 1
        whole = self._written(self._summed(now["tables"]), version)
        self._commit({"version": version, "batch": now["batch"], "tables": [whole], "replaced": [t["name"] for t in now["tables"]]})
        for name in now["replaced"]:
            fs, p = self._file(name)
            fs.delete(p, True)


def marked(counts: DataFrame, *, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """Counts with ``total_records`` and ``mark``: rare, common or null.

    rare goes first where a term is both. A field without records has no rows.
    """
    totals = counts.filter(F.col("term").isNull()).select(F.col("field").alias("__f"), F.col("records").alias("total_records"))
    terms = counts.filter(F.col("term").isNotNull() & (F.col("records") > 0))
    # one row per field: the size of the set of counted fields, not of the data
    both = terms.join(F.broadcast(totals), F.col("field") == F.col("__f")).drop("__f")
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") >= F.col("total_records") * F.lit(common_share), "common")
    return both.withColumn("mark", mark)


def as_additions(fields: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Change rows of records that are all new: (field name, table, term array) each."""
    out = None
    for name, table, terms in fields:
        rows = table.select(F.lit(name).alias("field"), F.lit(None).cast("array<string>").alias("before"), terms.alias("after")).filter(F.col("after").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out
