"""Document vectors: pooling of word vectors, normalising, principal component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.materialize import materialize
from corvane.plans.skew import join_dimension

#: Size of word vectors up to which every task holds them.
MAX_VECTORS_MB = 256


def norm(v: Column) -> Column:
    """Euclidean length of an array column."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """Unit vector; an all-zero one stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def assert_width(vectors: DataFrame, column: str, width: int) -> None:
    """Raise if any vector has another width."""
    if not vectors.filter(F.size(column) != width).isEmpty():
        raise ValueError(f"{column}: not every vector has {width} numbers")


def _vector(column: str) -> Column:
    return array_to_vector(F.transform(column, lambda x: x.cast("double")))


def pooled(tokens: DataFrame, word_vectors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(``doc_id``, ``v``, ``known``): mean of the vectors of the known tokens of each document.

    ``tokens`` has ``doc_id`` and ``tokens``; a token counts once per
    occurrence, unknown ones don't. With ``weights`` (``term``, ``weight``) the
    mean is weighted, 1 for terms without one; where all weights are 0 the
    plain mean is taken. Documents without known tokens, null lists included,
    have a null vector and 0 known tokens.

    Word vectors up to ``MAX_VECTORS_MB``, measured first, are held by every
    task: documents are pooled where they lie, without a shuffle. Larger ones
    are joined with the counted terms under skew.
    """
    words = word_vectors.select("term", "v").filter(F.col("v").isNotNull())
    if weights is not None:
        words = words.join(weights.select("term", "weight"), "term", "left").select("term", "v", F.coalesce("weight", F.lit(1.0)).alias("w"))
    else:
        words = words.withColumn("w", F.lit(1.0))
    words = materialize(words, "weighted-words")
    total = words.agg(F.sum(F.size("v") * 8 + F.length("term") + 16).alias("b")).first()["b"] or 0
    if total > MAX_VECTORS_MB * 1e6:
        return _pooled_by_join(tokens, words)
    table = words.toArrow()
    v = table.column("v").combine_chunks()
    matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
    held = tokens.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), matrix, table.column("w").to_numpy().astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, matrix, weight = held.value
        for b in batches:
            lists = b.column(1)
            found = pc.index_in(lists.flatten(), terms)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            at = found.drop_null().to_numpy()
            ends = np.concatenate([[0], np.cumsum(known)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            size = np.diff(ends)
            out = np.zeros((len(size), matrix.shape[1]))
            some = np.flatnonzero(size)
            if len(some):
                w = weight[at]
                of = np.repeat(np.arange(len(size)), size)
                mass = np.bincount(of, w, len(size))
                w = np.where(mass[of] > 0, w, 1.0)
                for lo in range(0, matrix.shape[1], 16):  # a few columns at a time bound the memory
                    out[some, lo : lo + 16] = np.add.reduceat(matrix[at, lo : lo + 16] * w[:, None], ends[some], axis=0)
                out[some] /= np.where(mass > 0, mass, size)[some, None]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(out.ravel()), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors, pa.array(size.astype(np.int64))], ["doc_id", "v", "known"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(run, f"doc_id {kind}, v array<double>, known bigint")


def _pooled_by_join(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``pooled`` with word vectors of any size: terms are counted, joined under skew, and the sums combined before the shuffle."""
    counts = materialize(tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")), "counts")
    asked = words.join(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    hit = join_dimension(counts, asked, "term", "df", ["doc_id"])
    plain, scaled = Summarizer.mean(_vector("v"), F.col("tf")), Summarizer.mean(array_to_vector(F.transform("v", lambda x: x.cast("double") * F.col("w"))), F.col("tf"))
    sums = hit.groupBy("doc_id").agg(plain.alias("m"), scaled.alias("wm"), F.sum(F.col("tf") * F.col("w")).alias("mass"), F.sum("tf").alias("known"))
    mean = F.transform(vector_to_array("wm"), lambda x: x * F.col("known") / F.col("mass"))
    sums = sums.select("doc_id", F.when(F.col("mass") > 0, mean).otherwise(vector_to_array("m")).alias("v"), "known")
    return tokens.select("doc_id").join(sums, "doc_id", "left").select("doc_id", "v", F.coalesce("known", F.lit(0)).cast("bigint").alias("known"))


def or_zero(vectors: DataFrame, width: int) -> DataFrame:
    """Null vectors, of documents without a known token, as zeros of a given width: the older form of a mean."""
    return vectors.withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), width)))


def unknown_documents(vectors: DataFrame) -> DataFrame:
    """One row: documents and how many of them have no known token."""
    return vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("known") == 0, 1).otherwise(0)).cast("bigint").alias("unknown"))


def principal_component(vectors: DataFrame, column: str = "v") -> list[float]:
    """First principal component of the mean-centred vectors, a unit vector; zeros for an empty table."""
    rows = vectors.filter(F.col(column).isNotNull()).select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("__x"))
    first = rows.first()
    if first is None:
        return []
    return [float(x) for x in PCA(k=1, inputCol="__x", outputCol="__y").fit(rows).pc.toArray()[:, 0]]


def without_component(v: Column, component: list[float]) -> Column:
    """v - (v . u) u; an empty or zero component changes nothing."""
    if not component or not any(component):
        return F.transform(v, lambda x: x.cast("double"))
    u = F.array(*[F.lit(x) for x in component])
    d = dot(v, u)
    return F.zip_with(v, u, lambda x, y: x.cast("double") - d * y)


def projected(vectors: DataFrame, k: int = 2, column: str = "v", key: str = "term") -> DataFrame:
    """(``key``, ``p``): centred coordinates on the first ``k`` principal components."""
    x = vectors.filter(F.col(column).isNotNull()).select(key, array_to_vector(F.transform(column, lambda y: y.cast("double"))).alias("__x"))
    model = PCA(k=k, inputCol="__x", outputCol="__y").fit(x)
    mean = x.select(Summarizer.mean(F.col("__x")).alias("m")).first()["m"].toArray() @ model.pc.toArray()
    return model.transform(x).select(key, F.zip_with(vector_to_array("__y"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b).alias("p"))
