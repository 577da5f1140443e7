"""Inverted index: token tables, lemmas, postings and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.skew import join_dimension

#: Words whose lemma is another word, up to which their map is held by every task.
MOST_LEMMAS = 1_000_000

#: Plurals that no suffix rule covers.
IRREGULAR = {"children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "indices": "index", "matrices": "matrix", "diagnoses": "diagnosis", "analyses": "analysis", "metastases": "metastasis", "criteria": "criterion", "bacteria": "bacterium"}

#: Noun endings and what takes their place, the first that matches.
NOUN_RULES = [("men", "man"), ("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("sses", "ss"), ("ves", "f"), ("s", "")]


def tokenized(documents: DataFrame, *, key: str, text: Column, chain=T.preprocess) -> DataFrame:
    """(``doc_id``, ``tokens``): one row per document, also those without tokens."""
    return documents.select(F.col(key).alias("doc_id"), chain(text).alias("tokens"))


def lemma_candidate(token: Column) -> Column:
    """What the noun rules make of a token; the token where none applies."""
    out = token
    for ending, other in reversed(NOUN_RULES):
        stem = F.substring(token, F.lit(1), F.greatest(F.length(token) - len(ending), F.lit(0)))
        out = F.when(token.endswith(ending) & (F.length(token) > len(ending)), F.concat(stem, F.lit(other))).otherwise(out)
    out = F.when(token.endswith("ss") | token.endswith("us") | token.endswith("is"), token).otherwise(out)
    for plural, single in IRREGULAR.items():
        out = F.when(token == plural, F.lit(single)).otherwise(out)
    return out


def lemma_map(terms: DataFrame) -> DataFrame:
    """(``term``, ``lemma``) of the distinct ``term`` of a table.

    A rule holds only if its result is itself a term of the collection, since no
    lexicon is at hand; else the term is its own lemma.
    """
    vocabulary = terms.select("term").distinct()
    known = vocabulary.select(F.col("term").alias("__known"))
    guess = vocabulary.withColumn("__guess", lemma_candidate(F.col("term")))
    return guess.join(known, F.col("__guess") == F.col("__known"), "left").select("term", F.coalesce("__known", "term").alias("lemma"))


def lemma_tokens(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``tokens`` with every token in the form of its lemma, in place.

    Only words that change are looked up. Up to ``MOST_LEMMAS`` of them, which
    are counted first, are held by every task and no row moves; more are joined
    under skew and the token lists put together again.
    """
    changed = lemmas.filter(F.col("term") != F.col("lemma")).select("term", "lemma")
    if changed.limit(MOST_LEMMAS + 1).count() > MOST_LEMMAS:
        flat = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
        weighted = changed.join(flat.groupBy("term").agg(F.count(F.lit(1)).alias("__n")), "term")
        said = join_dimension(flat, weighted, "term", "__n", ["doc_id", "pos"], how="left").select("doc_id", F.struct("pos", F.coalesce("lemma", "term").alias("t")).alias("x"))
        lists = said.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("tokens"))
        return tokens.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    pairs = changed.toArrow()
    held = tokens.sparkSession.sparkContext.broadcast((pairs.column("term").combine_chunks(), pairs.column("lemma").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forms = held.value
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            said = pc.coalesce(forms.take(pc.index_in(flat, words)), flat)
            start = lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pc.subtract(lists.offsets, pa.scalar(start, pa.int32())), said)], ["doc_id", "tokens"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, tokens array<string>")


def term_counts(tokens: DataFrame) -> DataFrame:
    """(``doc_id``, ``term``, ``tf``): repeats within a document are counted before the shuffle."""
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def cloud(counts: DataFrame, n: int = 200) -> DataFrame:
    """(``term``, ``n``, ``size``): the most frequent words for a word cloud, ``size`` relative to the first.

    The whole text of a collection isn't put together: the picture needs only frequencies.
    """
    top = counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(n)
    return top.crossJoin(F.broadcast(top.agg(F.max("n").alias("most")))).select("term", "n", (F.col("n") / F.col("most")).alias("size"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(``term``, ``df``)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lemmatized(counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Counts under lemmas. A term of very many documents doesn't meet in one task."""
    weighted = lemmas.join(document_frequency(counts), "term")
    both = join_dimension(counts, weighted, "term", "df", ["doc_id"])
    return both.groupBy("doc_id", F.col("lemma").alias("term")).agg(F.sum("tf").alias("tf"))


def postings(documents: DataFrame, *, key: str, text: Column, chain=T.preprocess, lemmas: bool = True) -> DataFrame:
    """(``doc_id``, ``term``, ``tf``) of a collection; build once, write, and query many times."""
    counts = term_counts(tokenized(documents, key=key, text=text, chain=chain))
    return lemmatized(counts, lemma_map(counts)) if lemmas else counts


def query_terms(queries: DataFrame, *, key: str, text: Column, lemmas: DataFrame | None = None, chain=T.preprocess) -> DataFrame:
    """(``query_id``, ``term``, ``qtf``): the same chain as for documents; repeats count."""
    counts = term_counts(tokenized(queries, key=key, text=text, chain=chain))
    if lemmas is not None:
        counts = counts.join(lemmas, "term", "left").groupBy("doc_id", F.coalesce("lemma", "term").alias("term")).agg(F.sum("tf").alias("tf"))
    return counts.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))


def lengths(documents: DataFrame, *, key: str, text: Column, chain=T.preprocess) -> DataFrame:
    """(``doc_id``, ``dl``): tokens of every document; empty ones have 0."""
    return documents.select(F.col(key).alias("doc_id"), F.size(chain(text)).cast("bigint").alias("dl"))


def collection_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: ``n_docs`` and ``avgdl``, empty documents included; avgdl is 1 where it would be 0."""
    mean = F.avg("dl")
    return doc_lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


def sif_weights(counts: DataFrame, a: float = 1e-3) -> DataFrame:
    """(``term``, ``weight``): a / (a + share of all tokens)."""
    per = counts.groupBy("term").agg(F.sum("tf").alias("n"))
    total = F.broadcast(per.agg(F.sum("n").alias("total")))
    return per.crossJoin(total).select("term", (F.lit(a) / (F.lit(a) + F.col("n") / F.col("total"))).alias("weight"))
