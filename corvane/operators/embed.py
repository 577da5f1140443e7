"""Word embeddings: skip-gram with negative sampling, and with character n-grams trained jointly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import ResourceError
from corvane.plans.materialize import discard, materialize

#: Bound of the n-gram matrix, and of all matrices of a training, which the driver and each task hold.
MAX_MATRIX_MB, MAX_MODEL_MB = 200, 1024
#: Token positions of one step, and rows of a matrix that travel as one block.
STEP, BLOCK = 256, 1024


@dataclass(frozen=True)
class TrainingParams:
    vector_size: int = 100
    window: int = 5
    min_count: int = 2
    epochs: int = 5
    seed: int = 42
    partitions: int = 1
    min_n: int = 3
    max_n: int = 5
    buckets: int = 50_000
    negative: int = 5
    sample: float = 1e-3
    rate: float = 0.2

    def __post_init__(self):
        if min(self.vector_size, self.window, self.min_count, self.epochs, self.partitions, self.min_n, self.buckets, self.negative) < 1 or self.max_n < self.min_n or min(self.sample, self.rate) <= 0:
            raise ValueError(f"bad training parameters: {asdict(self)}")

    def matrix_mb(self) -> float:
        """Size of the subword matrix, checked before training."""
        return self.buckets * self.vector_size * 4 / 1e6


#: The older generation's n-grams of one and two letters.
LEGACY = {"min_n": 1, "max_n": 2}


@dataclass
class Embedding:
    """``words``: (``term``, ``v``); ``buckets``: (``bucket``, ``v``) of the n-grams, None without subwords."""

    words: DataFrame
    buckets: DataFrame | None = None


@dataclass
class _Matrices:
    """Input vectors of words and n-gram buckets, output vectors of words, and one squared step size a row."""

    inputs: np.ndarray
    outputs: np.ndarray
    seen_in: np.ndarray
    seen_out: np.ndarray
    parts: np.ndarray  # input rows that make up each word
    ends: np.ndarray


def _step(m: _Matrices, ids: np.ndarray, doc: np.ndarray, p: TrainingParams, noise: np.ndarray, rate: float, rng: np.random.Generator, touched: list[np.ndarray]) -> None:
    """One gradient step over the windows of some token positions.

    All pairs of words of the step are one small matrix: how often each pair
    stands in a window, and how often it is expected among the negatives, drawn
    from the words of the step by their smoothed frequency.
    """
    word, at = np.unique(ids, return_inverse=True)
    n = len(word)
    reach = rng.integers(1, p.window + 1, len(ids))
    pairs = []
    for o in range(1, p.window + 1):
        near = doc[o:] == doc[:-o]
        pairs += [at[:-o][near & (reach[:-o] >= o)] * n + at[o:][near & (reach[:-o] >= o)], at[o:][near & (reach[o:] >= o)] * n + at[:-o][near & (reach[o:] >= o)]]
    met = np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n).astype(np.float32)
    if not met.any():
        return
    rows, alone = word, len(m.parts) == len(m.outputs)  # words without n-grams are their own only part
    if not alone:
        starts, size = m.ends[word], m.ends[word + 1] - m.ends[word]
        begin = np.cumsum(size) - size
        rows, share = m.parts[np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(starts, size)], (1 / size).astype(np.float32)[:, None]
    hidden = m.inputs[rows] if alone else np.add.reduceat(m.inputs[rows], begin, axis=0) * share
    out = m.outputs[word]
    yes = 1 / (1 + np.exp(-np.clip(hidden @ out.T, -8, 8)))
    q = noise[word] / noise[word].sum()
    gain = met - yes * (met + (p.negative * met.sum(1, keepdims=True)) * q[None, :])
    to_hidden, to_out = gain @ out, gain.T @ hidden
    m.seen_out[word] += np.einsum("ij,ij->i", to_out, to_out) / p.vector_size
    m.outputs[word] = out + to_out * (rate / np.sqrt(m.seen_out[word] + 1e-8)).astype(np.float32)[:, None]
    to_part = to_hidden if alone else to_hidden * share
    if len(rows) > n:  # several words share an n-gram: their steps are summed
        order = np.argsort(rows, kind="stable")
        used, owner = rows[order], np.repeat(np.arange(n), size)[order]
        new = np.concatenate([[True], used[1:] != used[:-1]])
        first, more = np.flatnonzero(new), np.flatnonzero(~new)
        rows, summed = used[first], to_part[owner[first]]
        if len(more):  # few are shared: the rest are taken as they are
            at, cut = np.unique(np.cumsum(new)[more] - 1, return_index=True)
            summed[at] += np.add.reduceat(to_part[owner[more]], cut, axis=0)
        to_part = summed
    m.seen_in[rows] += np.einsum("ij,ij->i", to_part, to_part) / p.vector_size
    m.inputs[rows] += to_part * (rate / np.sqrt(m.seen_in[rows] + 1e-8)).astype(np.float32)[:, None]
    touched += [rows, word + len(m.inputs)]


def _positions(b: pa.RecordBatch, keep: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and documents of the known tokens that frequency sampling keeps."""
    lists = b.column(0)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    stay = rng.random(len(ids)) < keep[ids]
    return ids[stay], doc[stay]


def _epoch(coded: DataFrame, shipped, p: TrainingParams, epoch: int) -> DataFrame:
    """(``block``, ``delta``, ``seen``, ``touched``): what each partition changed, block by block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, keep, noise = shipped.value
        m = _Matrices(start.inputs.copy(), start.outputs.copy(), start.seen_in.copy(), start.seen_out.copy(), start.parts, start.ends)
        rng = np.random.default_rng([p.seed, epoch, TaskContext.get().partitionId()])
        rate = p.rate * (1 - epoch / p.epochs)
        mark = np.zeros(len(m.inputs) + len(m.outputs), bool)
        for b in batches:
            ids, doc = _positions(b, keep, rng)
            for lo in range(0, len(ids), STEP):
                touched: list[np.ndarray] = []
                _step(m, ids[lo : lo + STEP], doc[lo : lo + STEP], p, noise, rate, rng, touched)
                for t in touched:
                    mark[t] = True
        old, new = (np.concatenate([x.inputs, x.outputs]) for x in (start, m))
        seen = np.concatenate([m.seen_in, m.seen_out]) - np.concatenate([start.seen_in, start.seen_out])
        for lo in range(0, len(mark), BLOCK):
            some = slice(lo, lo + BLOCK)
            if mark[some].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([lo // BLOCK], pa.int32()), "delta": [(new[some] - old[some]).tobytes()], "seen": [seen[some].tobytes()], "touched": [mark[some].astype(np.float32).tobytes()]})

    return coded.mapInArrow(run, "block int, delta binary, seen binary, touched binary")


def _averaged(deltas: DataFrame) -> pa.Table:
    """One row a block: changes of all partitions, averaged over those that touched the row."""

    def add(group: pa.Table) -> pa.Table:
        total = lambda c: sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group.column(c).to_pylist())
        touched = np.maximum(total("touched"), 1)
        delta = (total("delta").reshape(len(touched), -1) / touched[:, None]).astype(np.float32)
        return pa.table([group.column("block")[:1], [delta.tobytes()], [(total("seen") / touched).astype(np.float32).tobytes()]], ["block", "delta", "seen"])

    return deltas.groupBy("block").applyInArrow(add, "block int, delta binary, seen binary").toArrow()  # as much as the matrices, at most MAX_MODEL_MB


def _vectors(spark, names: pa.Array, name: str, x: np.ndarray) -> DataFrame:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
    return spark.createDataFrame(pa.table([names, lists], [name, "v"]))


def train(tokens: DataFrame, params: TrainingParams = TrainingParams(), *, subwords: bool = False) -> Embedding:
    """Vectors of all words that occur ``min_count`` times, by skip-gram with negative sampling.

    With ``subwords`` the input vector of a word is the mean of its own and of
    its n-grams' vectors, and all of them are trained together. ``tokens`` has
    ``tokens`` and, for a fixed order, ``doc_id``; null and empty lists count
    for nothing. Each pass trains ``partitions`` copies of the matrices side by
    side, each on its part of the documents, and averages what they changed, so
    the work of a pass is spread; the same partitions give the same vectors on
    every run. The matrices must fit each task: their size is checked after
    counting words, and a vocabulary beyond the bound raises ``ResourceError``
    (raise ``min_count``). Without any word the result is empty.
    """
    p, spark = params, tokens.sparkSession
    if subwords and p.matrix_mb() > MAX_MATRIX_MB:
        raise ResourceError(f"the subword matrix would take {p.matrix_mb():.0f} MB; the limit is {MAX_MATRIX_MB}")
    key = [c for c in ("doc_id",) if c in tokens.columns]
    counted = materialize(tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= p.min_count), "vocabulary")
    size = counted.count()
    model_mb = (2 * size + (p.buckets if subwords else 0)) * p.vector_size * 4 / 1e6
    if model_mb > MAX_MODEL_MB:
        raise ResourceError(f"{size} words would take {model_mb:.0f} MB; the limit is {MAX_MODEL_MB}")
    if not size:
        none = spark.createDataFrame([], "term string, v array<float>")
        return Embedding(none, spark.createDataFrame([], "bucket bigint, v array<float>") if subwords else None)
    vocabulary = counted.toArrow().sort_by([("n", "descending"), ("term", "ascending")])
    terms, n = vocabulary.column("term").combine_chunks(), vocabulary.column("n").to_numpy().astype(np.float64)
    discard(counted)
    words = spark.sparkContext.broadcast(terms)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            found = pc.index_in(lists.flatten(), words.value)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(known)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.drop_null().cast(pa.int32()))], ["ids"])

    placed = tokens.filter(F.size("tokens") > 0).select("tokens", *key)
    placed = placed.repartition(p.partitions, *key).sortWithinPartitions(*key) if key else placed.repartition(p.partitions)
    coded = materialize(placed.select("tokens").mapInArrow(encode, "ids array<int>"), "coded")
    share = n / n.sum()
    keep = np.minimum(1, np.sqrt(p.sample / share) + p.sample / share)
    if subwords:
        held = spark.createDataFrame(pa.table([terms, pa.array(np.arange(size))], ["term", "i"]))
        of = _buckets(held, p).select("i", "bucket").toArrow().sort_by([("i", "ascending"), ("bucket", "ascending")])
        i = np.concatenate([np.arange(size), of.column("i").to_numpy()])
        parts = np.concatenate([np.arange(size), size + of.column("bucket").to_numpy()])[np.argsort(i, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=size))])
    else:
        parts, ends = np.arange(size), np.arange(size + 1)
    rng = np.random.default_rng(p.seed)
    inputs = ((rng.random((size + (p.buckets if subwords else 0), p.vector_size)) - 0.5) / p.vector_size).astype(np.float32)
    m = _Matrices(inputs, np.zeros((size, p.vector_size), np.float32), np.zeros(len(inputs), np.float32), np.zeros(size, np.float32), parts, ends)
    for epoch in range(p.epochs):
        shipped = spark.sparkContext.broadcast((m, keep, (n**0.75).astype(np.float32)))  # size checked above
        both, seen = np.concatenate([m.inputs, m.outputs]), np.concatenate([m.seen_in, m.seen_out])
        for r in _averaged(_epoch(_kept(coded, p.partitions), shipped, p, epoch)).to_pylist():
            at = slice(r["block"] * BLOCK, r["block"] * BLOCK + BLOCK)
            both[at] += np.frombuffer(r["delta"], np.float32).reshape(-1, p.vector_size)
            seen[at] += np.frombuffer(r["seen"], np.float32)
        shipped.unpersist()
        cut = len(m.inputs)
        m = _Matrices(both[:cut], both[cut:], seen[:cut], seen[cut:], parts, ends)
    discard(coded)
    pooled = np.add.reduceat(m.inputs[parts], ends[:-1], axis=0) / np.diff(ends)[:, None]
    out = Embedding(_vectors(spark, terms, "term", pooled))
    if subwords:
        used = np.unique(parts[parts >= size]) - size
        out.buckets = _vectors(spark, pa.array(used), "bucket", m.inputs[size + used])
    return out


def _kept(coded: DataFrame, partitions: int) -> DataFrame:
    """The coded documents in as many tasks as there are copies of the matrices; written files may be split otherwise."""
    return coded if coded.rdd.getNumPartitions() == partitions else coded.repartition(partitions)


def skipgram(tokens: DataFrame, params: TrainingParams = TrainingParams()) -> DataFrame:
    """(``term``, ``v``): vectors of words alone."""
    return train(tokens, params).words


def most_similar(word_vectors: DataFrame, terms: DataFrame, n: int = 10) -> DataFrame:
    """(``term``, ``other``, ``score``, ``rank``): the most similar words of each ``term``, itself left out."""
    from corvane.operators.rank import cosine

    # the vocabulary of a training is bounded (MAX_MODEL_MB), far below where 64-bit hashes of its words would meet
    numbered = word_vectors.select(F.xxhash64("term").alias("id"), "term", "v")
    asked = numbered.join(terms.select("term").distinct(), "term", "left_semi")
    hits = cosine(asked.select("id", "v"), numbered.select("id", "v"), n, exclude_self=True)
    names = numbered.select("id", "term")
    return hits.join(names.select(F.col("id").alias("query_id"), "term"), "query_id").join(names.select(F.col("id").alias("doc_id"), F.col("term").alias("other")), "doc_id").select("term", "other", "score", "rank")


def ngrams(term: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of ``<term>``."""
    marked = F.concat(F.lit("<"), term, F.lit(">"))
    size = F.length(marked)
    lists = [F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i, n=n: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*lists)


def _buckets(terms: DataFrame, params: TrainingParams) -> DataFrame:
    return terms.select("*", F.explode(ngrams(F.col("term"), params.min_n, params.max_n)).alias("g")).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(params.buckets)))


def _mean(v: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(v, lambda x: x.cast("double")))))


def infer(terms: DataFrame, word_vectors: DataFrame, bucket_vectors: DataFrame, params: TrainingParams = TrainingParams()) -> DataFrame:
    """(``term``, ``v``): known words keep their vector, unknown ones get the mean of their n-grams'."""
    known = terms.select("term").distinct().join(word_vectors.select("term", "v"), "term")
    unknown = terms.select("term").distinct().join(word_vectors.select("term"), "term", "left_anti")
    made = _buckets(unknown, params).select("term", "bucket").join(bucket_vectors, "bucket").groupBy("term").agg(_mean("v").alias("v"))
    return known.select("term", F.transform("v", lambda x: x.cast("double")).alias("v")).unionByName(made)
