"""Rankers over a batch of queries: TF-IDF, BM25 and cosine, with one tie rule.

Scores are rounded to 6 digits before ranking and equal ones ordered by
document id, so a ranking doesn't depend on the order of additions. Zero and
negative scores never rank. The query side is a table the caller asks with, not
one that grows with the collection, but it is still joined without a hint: the
planner broadcasts it when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.materialize import materialize
from corvane.plans.skew import join_dimension

DIGITS = 6


def top_n(scored: DataFrame, n: int, *, group: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Best ``n`` documents of each query with ``rank``; Spark limits each partition before the shuffle."""
    kept = scored.filter(F.col(score) > 0)
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(doc))
    return kept.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def idf_tfidf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(``term``, ``df``, ``idf``): ln((1 + N) / (1 + df)) + 1."""
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def idf_bm25(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(``term``, ``df``, ``idf``): ln(1 + (N - df + 0.5) / (df + 0.5)), always positive."""
    n = F.col("n_docs")
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def tfidf_norms(postings: DataFrame, idf: DataFrame) -> DataFrame:
    """(``doc_id``, ``norm``): length of each document's weight vector.

    A term of very many documents doesn't meet in one task.
    """
    w = F.col("tf") * F.col("idf")
    met = join_dimension(postings, idf.select("term", "df", "idf"), "term", "df", ["doc_id"])
    return met.groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def matching(postings: DataFrame, asked: DataFrame, df: DataFrame) -> DataFrame:
    """Postings of the terms in ``asked`` (``term`` and more columns, a row per query and term), joined.

    Terms asked by a batch are few beside the postings. They are grouped by term
    and joined under skew, so the postings of a word that most documents hold
    are spread, and so are those of one that most queries ask.
    """
    rest = [c for c in asked.columns if c != "term"]
    by = asked.groupBy("term").agg(F.collect_list(F.struct(*rest)).alias("__asked"))
    met = join_dimension(postings, materialize(by.join(df.select("term", "df"), "term"), "asked-terms"), "term", "df", ["doc_id"])
    return met.withColumn("__a", F.explode("__asked")).select(*[c for c in met.columns if c not in ("__asked", "df")], *[F.col("__a")[c].alias(c) for c in rest])


def tfidf(postings: DataFrame, idf: DataFrame, norms: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``, ``rank``): cosine of TF-IDF vectors.

    The query vector is normalised over known terms only. ``queries`` has
    ``query_id``, ``term``, ``qtf``.
    """
    known = queries.join(idf, "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    norm_q = known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    known = known.join(norm_q, "query_id").select("query_id", "term", (F.col("qw") / F.col("qnorm") * F.col("idf")).alias("qw"))
    dots = matching(postings, known, idf).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("tf")).alias("dot"))
    scored = dots.join(norms, "doc_id").select("query_id", "doc_id", F.round(F.col("dot") / F.col("norm"), DIGITS).alias("score"))
    return top_n(scored, n)


def bm25_scores(postings: DataFrame, doc_lengths: DataFrame, stats: DataFrame, idf: DataFrame, queries: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``) of every document that shares a term; a repeated query term counts again."""
    hit = matching(postings, queries.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")), idf)
    hit = hit.join(doc_lengths, "doc_id").crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def bm25(postings: DataFrame, doc_lengths: DataFrame, stats: DataFrame, idf: DataFrame, queries: DataFrame, n: int = 10, **k: float) -> DataFrame:
    return top_n(bm25_scores(postings, doc_lengths, stats, idf, queries, **k), n)


def _packed(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """Vectors as blocks of about ``rows``: ids and unit rows side by side."""
    count = vectors.count()
    blocks = max(1, -(-count // rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(f"{name}_block")
    return vectors.groupBy(block).agg(F.collect_list(F.struct("id", "v")).alias(name))


def cosine(queries: DataFrame, documents: DataFrame, n: int = 10, *, block_rows: int = 4096, exclude_self: bool = False) -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``, ``rank``): every query against every document, in blocks.

    Both sides have ``id`` and ``v``, an array of numbers of one width; null,
    empty and all-zero vectors score nothing. Each pair of blocks is one matrix
    product in numpy and gives at most ``n`` rows a query.
    """
    q = _packed(queries.filter(F.col("v").isNotNull()), "q", block_rows)
    d = _packed(documents.filter(F.col("v").isNotNull()), "d", block_rows)

    def unit(column) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        ids = flat.field(0).to_numpy(zero_copy_only=False)
        v = flat.field(1)
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(1))
        return ids, x / np.where(norm > 0, norm, 1)[:, None]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                q_id, x = unit(row.column(0))
                d_id, y = unit(row.column(1))
                order = np.argsort(d_id, kind="stable")
                d_id, s = d_id[order], np.round(x @ y[order].T, DIGITS)
                if exclude_self:
                    s[q_id[:, None] == d_id[None, :]] = -1
                if s.shape[1] > n:
                    # all that reach the n-th best score, ties included, then cut in order of score and id
                    i, j = np.nonzero(s >= np.partition(s, s.shape[1] - n, axis=1)[:, [s.shape[1] - n]])
                    order = np.lexsort((j, -s[i, j], i))
                    i, j = i[order], j[order]
                    begin = np.searchsorted(i, np.arange(len(q_id)))
                    first = np.arange(len(i)) - begin[i] < n
                    i, j = i[first], j[first]
                else:
                    i, j = (x.ravel() for x in np.indices(s.shape))
                good = s[i, j] > 0
                yield pa.RecordBatch.from_arrays([pa.array(q_id[i[good]]), pa.array(d_id[j[good]]), pa.array(s[i, j][good])], ["query_id", "doc_id", "score"])

    met = q.crossJoin(d).select("q", "d").mapInArrow(meet, "query_id bigint, doc_id bigint, score double")
    return top_n(met, n)


def displayed(hits: DataFrame, corpus: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Hits with the display columns of their document."""
    shown = corpus.select(F.col("row_id").alias(key), "trial_id", "title", "abstract", "publication_date")
    return hits.join(shown, key)
