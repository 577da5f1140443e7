"""The retrieval plans: one collection, built once, and a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import fuse, postings, rank
from corvane.plans.materialize import materialize
from corvane.plans.spread import spread
from corvane.sources import store


@dataclass
class LexicalIndex:
    """Postings and their statistics, written once; every ranker call only reads.

    ``surface`` are the tokens as written, ``tokens`` those the postings count
    (lemmas, where there are any).
    """

    surface: DataFrame
    tokens: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    df: DataFrame
    lemmas: DataFrame | None
    chain: object
    held_norms: DataFrame | None = None

    @property
    def norms(self) -> DataFrame:
        """Lengths of the TF-IDF vectors, written when first asked for: BM25 doesn't need them."""
        if self.held_norms is None:
            self.held_norms = materialize(rank.tfidf_norms(self.postings, rank.idf_tfidf(self.df, self.stats)), "norms")
        return self.held_norms

    def queries(self, queries: DataFrame, *, key: str = "query_id", text: str = "query_text") -> DataFrame:
        return postings.query_terms(queries, key=key, text=F.col(text), lemmas=self.lemmas, chain=self.chain)

    def bm25(self, queries: DataFrame, n: int = 10, **k: float) -> DataFrame:
        return rank.bm25(self.postings, self.lengths, self.stats, rank.idf_bm25(self.df, self.stats), self.queries(queries), n, **k)

    def tfidf(self, queries: DataFrame, n: int = 10) -> DataFrame:
        return rank.tfidf(self.postings, rank.idf_tfidf(self.df, self.stats), self.norms, self.queries(queries), n)

    def save(self, path: str, **about) -> dict:
        """Keep all tables below ``path``, their manifest written last."""
        spark = self.postings.sparkSession
        for name in _TABLES:
            table = getattr(self, name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")
        about |= {"lemmas": self.lemmas is not None}
        store.write_json(spark, f"{path}/manifest.json", about)
        return about


_TABLES = ("surface", "tokens", "postings", "lengths", "stats", "df", "lemmas", "norms")


def load_lexical(spark: SparkSession, path: str, *, chain=T.preprocess, **wanted) -> LexicalIndex:
    """A saved index; raises if it isn't there or a ``wanted`` value of its manifest differs."""
    about = store.read_json(spark, f"{path}/manifest.json")
    store.check(path, about, wanted)
    held = {name: spark.read.parquet(f"{path}/{name}") for name in _TABLES if name != "lemmas" or about["lemmas"]}
    return LexicalIndex(**{n: t for n, t in held.items() if n != "norms"} | {"lemmas": held.get("lemmas"), "chain": chain, "held_norms": held["norms"]})


def build_lexical(documents: DataFrame, *, key: str, text: Column, chain=T.preprocess, lemmas: bool = True) -> LexicalIndex:
    """Tokenise once, bring tokens to their lemmas, count, and write postings, lengths and frequencies."""
    surface = materialize(postings.tokenized(spread(documents, key), key=key, text=text, chain=chain), "surface")
    found, tokens = None, surface
    if lemmas:
        found = materialize(postings.lemma_map(surface.select(F.explode("tokens").alias("term"))), "lemmas")
        tokens = materialize(postings.lemma_tokens(surface, found), "tokens")
    held = materialize(postings.term_counts(tokens), "postings")
    lengths = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("dl"))
    stats = materialize(postings.collection_stats(lengths), "stats")
    df = materialize(postings.document_frequency(held), "df")
    return LexicalIndex(surface, tokens, held, lengths, stats, df, found, chain)


def one_per_trial(hits: DataFrame, corpus: DataFrame, n: int | None = None) -> DataFrame:
    """(``query_id``, ``trial_id``, ``score``, ``rank``): rows of the same trial as one, at its best place."""
    named = hits.join(corpus.select(F.col("row_id").alias("doc_id"), "trial_id"), "doc_id").filter(F.col("trial_id").isNotNull())
    best = named.groupBy("query_id", "trial_id").agg(F.max("score").alias("score"), F.min("rank").alias("r"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "trial_id")).cast("bigint")).drop("r")
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def flagship(lexical: LexicalIndex, embedding: DataFrame, queries: DataFrame, corpus: DataFrame, *, per_method: int = 10) -> DataFrame:
    """(``query_id``, ``trial_id``, ``score``, ``rank``): the default search.

    Union of an embedding run (already three times as deep) and TF-IDF, then
    the negation filter, then known items on top. Queries with a negated span
    are searched three times as deep and cut to ``per_method``; the others keep
    the whole union.
    """
    spans = queries.select("query_id", (F.size(fuse.negated_spans(F.col("query_text"))) > 0).alias("negated"))
    deep = per_method * fuse.DEPTH
    limit = F.when(F.col("negated"), deep).otherwise(per_method)
    cut = lambda run: run.join(spans, "query_id").filter(F.col("rank") <= limit).drop("negated")
    union = fuse.rrf_union(cut(embedding), cut(lexical.tfidf(queries, deep)))
    kept = fuse.negation_filtered(union, queries, corpus, 2 * deep)
    kept = kept.join(spans, "query_id").filter(~F.col("negated") | (F.col("rank") <= per_method)).drop("negated")
    return fuse.promoted(one_per_trial(kept, corpus), fuse.known_items(queries, fuse.id_index(corpus)))
