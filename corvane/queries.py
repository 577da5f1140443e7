"""Queries of the core operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import embed, evaluate, fuse, manifest, postings, rank, rejects, vectors
from corvane.plans import retrieval
from corvane.plans.materialize import materialize, scratch_path
from corvane.sources import corpus, store
from corvane.plans.spread import spread
from corvane.streaming import ingest


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sample_corpus")


# 3. Rows that fail to parse


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_t(spark, d, "raw_corpus"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """All loadable lines as corpus rows."""
    return rejects.loaded(_t(spark, d, "raw_corpus"))


# Text functions


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def strip_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.strip_urls(F.col("text")).alias("plain"))


def join_marks(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", T.join_marks(F.col("abstract")).alias("joined"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", F.concat_ws(" ", T.word_tokens(T.clean_text(F.col("abstract")))).alias("tokens"))


def preprocess(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", F.concat_ws(" ", T.preprocess(F.col("abstract"))).alias("tokens"))


def old_chain(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", F.concat_ws(" ", T.old_chain(F.col("abstract"))).alias("tokens"))


def legacy_chain(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", T.legacy_text(F.col("abstract")).alias("tokens"))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of every term with bigrams."""
    tokens = _corpus(spark, d).select(F.explode(T.with_bigrams(T.preprocess(F.col("title")))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def normalize_id(spark: SparkSession, d: str) -> DataFrame:
    key = T.normalize_id(F.col("trial_id"))
    return _corpus(spark, d).select("row_id", key.alias("id_key"), T.looks_like_id(key).alias("looks_like_id"))


def truncated_abstract(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", T.truncated(F.col("abstract")).alias("short"), F.substring("title", 1, 200).alias("head"))


def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", T.short_hash(F.concat_ws("|", "trial_id", "title", "abstract")).alias("fingerprint"))


def drop_blank_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.drop_blank(_corpus(spark, d)).select("row_id", F.coalesce("abstract", F.lit("")).alias("text"))


def containment(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows whose title or abstract holds the name that an entity query begins with."""
    names = _t(spark, d, "eval_queries").filter("stratum = 'entity'").select(F.substring_index(F.trim("query_text"), " ", 1).alias("c"))
    codes = [r["c"] for r in names.distinct().collect()]  # judged queries are a short fixed list
    return fuse.containing(_corpus(spark, d), codes, key="row_id", text=F.concat_ws(" ", "title", "abstract"))


# CSV files


def _csv_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The lines of ``raw_corpus`` written as the CSV files they came from, and read as files."""
    path = scratch_path(spark, "csv")
    lines = _t(spark, d, "raw_corpus").filter(F.col("raw_line").isNotNull())
    lines.repartition("file_name").sortWithinPartitions("file_name", "line_no").select("raw_line", "file_name").write.partitionBy("file_name").text(path)
    return corpus.read_csv_parts(spark, path)


def csv_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Good rows of the CSV files, by registered identifier and date."""
    return _csv_parts(spark, d)[0].select("trial_id", "title", "abstract", "publication_date", "date_added", "phase")


def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Records of the CSV files that can't be read, by reason.

    A record with an open quote takes the lines after it up to the next that looks like the start of a record, so bad
    records may be fewer than bad lines; the good ones are the same.
    """
    return _csv_parts(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


# Inverted index


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return postings.tokenized(spread(_corpus(spark, d), "row_id"), key="row_id", text=F.col("abstract"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts, written once: several steps read them."""
    return materialize(postings.term_counts(_tokens(spark, d)), "counts")


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return postings.term_counts(_tokens(spark, d))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return postings.document_frequency(term_freq(spark, d))


def lemma_map(spark: SparkSession, d: str) -> DataFrame:
    return postings.lemma_map(_counts(spark, d))


def lemma_postings(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).postings


def vocab_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent words: a top-k report."""
    words = _tokens(spark, d).select(F.explode("tokens").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(10)


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(_tokens(spark, d), "tokens")
    stats = postings.collection_stats(tokens.select("doc_id", F.size("tokens").alias("dl")))
    vocabulary = tokens.select(F.explode("tokens").alias("term")).agg(F.count_distinct("term").alias("vocabulary"))
    return stats.crossJoin(F.broadcast(vocabulary)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


def sif_weights(spark: SparkSession, d: str) -> DataFrame:
    return postings.sif_weights(_counts(spark, d)).select("term", F.round("weight", 9).alias("weight"))


def idf(spark: SparkSession, d: str) -> DataFrame:
    lex = _lexical(spark, d)
    both = rank.idf_tfidf(lex.df, lex.stats).withColumnRenamed("idf", "idf_tfidf").join(rank.idf_bm25(lex.df, lex.stats).select("term", F.col("idf").alias("idf_bm25")), "term")
    return both.select("term", "df", F.round("idf_tfidf", 9).alias("idf_tfidf"), F.round("idf_bm25", 9).alias("idf_bm25"))


# Rankers


def _lexical(spark: SparkSession, d: str, **more) -> retrieval.LexicalIndex:
    return retrieval.build_lexical(_corpus(spark, d), key="row_id", text=F.col("abstract"), **more)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "score", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_lexical(spark, d).bm25(_t(spark, d, "eval_queries")))


def bm25_b0(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_lexical(spark, d).bm25(_t(spark, d, "eval_queries"), k1=1.2, b=0.0))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_lexical(spark, d).tfidf(_t(spark, d, "eval_queries")))


def bigram_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with bigrams as further terms."""
    lex = _lexical(spark, d, chain=lambda c: T.with_bigrams(T.preprocess(c)), lemmas=False)
    return _hits(lex.bm25(_t(spark, d, "eval_queries")))


def old_chain_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_lexical(spark, d, chain=T.old_chain, lemmas=False).bm25(_t(spark, d, "eval_queries")))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _hits(rank.cosine(v.filter(F.col("id") % 20 == 0), v, exclude_self=True))


# Vectors


def _word_vectors(spark: SparkSession, d: str, tokens: DataFrame) -> DataFrame:
    """Every term of the abstracts with a vector of ``embeddings``, picked by a digest of the term: stand-ins that SQL can repeat."""
    v = _t(spark, d, "embeddings")
    place = F.pmod(F.conv(F.substring(F.md5("term"), 1, 12), 16, 10).cast("bigint"), F.lit(v.count()))
    terms = tokens.select(F.explode("tokens").alias("term")).distinct()
    return terms.withColumn("vec_id", place).join(v, "vec_id").select("term", F.col("embedding").alias("v"))


def _pooled(spark: SparkSession, d: str, weighted: bool) -> DataFrame:
    tokens = materialize(_tokens(spark, d), "tokens")
    return vectors.pooled(tokens, _word_vectors(spark, d, tokens), postings.sif_weights(postings.term_counts(tokens)) if weighted else None)


def _entries(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "known", F.posexplode_outer("v").alias("pos", "x")).select("doc_id", "known", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return _entries(_pooled(spark, d, False))


def sif_pool(spark: SparkSession, d: str) -> DataFrame:
    return _entries(_pooled(spark, d, True))


def oov_documents(spark: SparkSession, d: str) -> DataFrame:
    return vectors.unknown_documents(_pooled(spark, d, False))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "document_index").filter(F.col("vectors").isNotNull())
    return v.select("vec_id", F.posexplode(vectors.l2_normalized(F.col("vectors"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


def component_removed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without their first principal component."""
    v = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    u = vectors.principal_component(v)
    return v.select("vec_id", F.transform(vectors.without_component(F.col("v"), u), lambda x: F.round(x, 4)).alias("v"))


def fixed_component_removed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without their part along the vector of id 0."""
    v = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    u = v.filter("vec_id = 0").select(vectors.l2_normalized(F.col("v")).alias("u")).first()["u"]
    left = v.select("vec_id", F.posexplode(vectors.without_component(F.col("v"), u)).alias("pos", "x"))
    return left.select("vec_id", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


def word_cloud(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most frequent words of the abstracts and their sizes in a word cloud."""
    return postings.cloud(term_freq(spark, d)).select("term", "n", F.round("size", 6).alias("size"))


#: The training of production, side by side: one partition would leave all other cores idle.
TRAINING = embed.TrainingParams(partitions=8)


def _asked_words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "eval_queries").select(F.explode(T.preprocess(F.col("query_text"))).alias("term"))


def _trained(spark: SparkSession, d: str, subwords: bool = False) -> embed.Embedding:
    """Vectors of the abstracts' words; the tokens are written once, as counting and encoding both read them."""
    return embed.train(materialize(_tokens(spark, d), "tokens"), TRAINING, subwords=subwords)


def skipgram_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Skip-gram vectors of the corpus vocabulary."""
    return _trained(spark, d).words


def most_similar(spark: SparkSession, d: str) -> DataFrame:
    """The most similar words of every word of the judged queries."""
    return embed.most_similar(_trained(spark, d).words, _asked_words(spark, d))


def subword_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the query words, also of unseen ones, from n-grams trained with the words."""
    model = _trained(spark, d, subwords=True)
    return embed.infer(_asked_words(spark, d), model.words, model.buckets, TRAINING)


def candidate_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Pooled candidates of every query as a labelling sheet."""
    return store.candidate_sheet(pool_candidates(spark, d), _t(spark, d, "eval_queries"), _corpus(spark, d))


# Fusion, identifiers, negation


def _runs(spark: SparkSession, d: str) -> tuple[retrieval.LexicalIndex, DataFrame]:
    lex = _lexical(spark, d)
    return lex, _t(spark, d, "eval_queries")


def rrf_union(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the BM25 run, in the place of the embedding run, with TF-IDF."""
    lex, q = _runs(spark, d)
    fused = fuse.rrf_union(lex.bm25(q), lex.tfidf(q))
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.concat_ws(",", "found_by").alias("found_by"), "rank")


def pool_candidates(spark: SparkSession, d: str) -> DataFrame:
    lex, q = _runs(spark, d)
    named = {n: retrieval.one_per_trial(r, _corpus(spark, d)) for n, r in (("bm25", lex.bm25(q)), ("tfidf", lex.tfidf(q)))}
    return fuse.pooled_runs(named, doc="trial_id").select("query_id", "trial_id", F.concat_ws(",", "found_by").alias("found_by"), "place")


def unjudged(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.unjudged(pool_candidates(spark, d), evaluate.judgements(_t(spark, d, "eval_queries"))).select("query_id", "trial_id")


def known_item(spark: SparkSession, d: str) -> DataFrame:
    return fuse.known_items(_t(spark, d, "eval_queries"), fuse.id_index(_corpus(spark, d)))


def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    return fuse.colliding_ids(_corpus(spark, d)).withColumnRenamed("key", "id_key")


def negation_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = _t(spark, d, "eval_queries").select("query_id", F.posexplode(fuse.negated_spans(F.col("query_text"))).alias("n", "span"))
    return spans.select("query_id", F.col("n").cast("bigint").alias("n"), F.concat_ws(" ", "span").alias("span"))


def negation_asserts(spark: SparkSession, d: str) -> DataFrame:
    """Which corpus rows assert the negated span of which query."""
    spans = _t(spark, d, "eval_queries").select("query_id", F.explode(fuse.negated_spans(F.col("query_text"))).alias("span"))
    words = _corpus(spark, d).select("row_id", T.word_runs(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("words"))
    # an inverted index on the span's first word stands before the costly predicate
    first = words.select("row_id", "words", F.explode(F.array_distinct("words")).alias("w"))
    met = first.join(spans.withColumn("w", F.get("span", F.lit(0))), "w")
    return met.filter(fuse.asserts(F.col("words"), F.col("span"))).select("query_id", F.concat_ws(" ", "span").alias("span"), "row_id")


def negation_filter(spark: SparkSession, d: str) -> DataFrame:
    lex, q = _runs(spark, d)
    return fuse.negation_filtered(_hits(lex.bm25(q, 30)), q, _corpus(spark, d), 10).select("query_id", "doc_id", "rank")


def promoted(spark: SparkSession, d: str) -> DataFrame:
    lex, q = _runs(spark, d)
    rows = _corpus(spark, d)
    ranked = retrieval.one_per_trial(lex.bm25(q), rows)
    return fuse.promoted(ranked, fuse.known_items(q, fuse.id_index(rows))).select("query_id", "trial_id", "rank")


def _embedding_run(lex: retrieval.LexicalIndex, words: DataFrame, q: DataFrame, n: int = 30) -> DataFrame:
    """Cosine of pooled query words against pooled abstracts."""
    docs = materialize(vectors.pooled(lex.surface, words).select(F.col("doc_id").alias("id"), "v"), "docs")
    asked = vectors.pooled(postings.tokenized(q, key="query_id", text=F.col("query_text")), words).select(F.col("doc_id").cast("bigint").alias("id"), "v")
    return materialize(rank.cosine(materialize(asked, "asked"), docs, n).withColumn("query_id", F.col("query_id").cast("int")), "embedding")


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of pooled query words against pooled abstracts."""
    lex, q = _runs(spark, d)
    return _hits(_embedding_run(lex, materialize(_word_vectors(spark, d, lex.surface), "words"), q, 10))


def pool_four(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of four systems: BM25, TF-IDF, embedding, and the union of the last two; all that each shows to depth 10."""
    lex, q = _runs(spark, d)
    emb = _embedding_run(lex, materialize(_word_vectors(spark, d, lex.surface), "words"), q, 10)
    tfidf = materialize(lex.tfidf(q), "tfidf")
    runs = {"bm25": lex.bm25(q), "embedding": emb, "tfidf": tfidf, "union": fuse.rrf_union(emb, tfidf)}
    named = {n: retrieval.one_per_trial(r, _corpus(spark, d)) for n, r in runs.items()}
    return fuse.pooled_runs(named, doc="trial_id").select("query_id", "trial_id", F.concat_ws(",", "found_by").alias("found_by"), "place")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The default search of all judged queries; pooled query words against pooled abstracts are the embedding run."""
    lex, q = _runs(spark, d)
    embedding = _embedding_run(lex, materialize(_word_vectors(spark, d, lex.surface), "words"), q)
    return retrieval.flagship(lex, embedding, q, _corpus(spark, d)).select("query_id", "trial_id", F.round("score", 9).alias("score"), "rank")


def flagship_trained(spark: SparkSession, d: str) -> DataFrame:
    """The same search with word vectors trained on the abstracts."""
    lex, q = _runs(spark, d)
    embedding = _embedding_run(lex, embed.skipgram(lex.surface, TRAINING), q)
    return retrieval.flagship(lex, embedding, q, _corpus(spark, d)).select("query_id", "trial_id", F.round("score", 9).alias("score"), "rank")


def query_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why queries have no BM25 hits after the negation filter: each judged query, and made ones that fail in each way."""
    lex, judged = _runs(spark, d)
    text = F.col("query_text")
    made = [("0", text), ("1000", F.lit("  ")), ("2000", F.lit("the of and")), ("3000", F.concat(F.lit("zzqx"), F.col("query_id").cast("string"))), ("4000", F.concat_ws(" ", text, F.lit("without"), text))]
    q = judged.select(F.explode(F.array(*[F.struct((F.col("query_id") + int(n)).alias("query_id"), t.alias("query_text")) for n, t in made])).alias("q")).select("q.*")
    q = materialize(q, "asked")
    before = materialize(lex.bm25(q, 30), "before")
    known = lex.queries(q).join(lex.df, "term", "left_semi")
    return fuse.reasons(q, fuse.negation_filtered(before, q, _corpus(spark, d), 10), known=known, before=before)


def twin_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of the first ten BM25 hits that a query with a negation has in common with its twin without the cue, filtered and not."""
    lex, judged = _runs(spark, d)
    q = judged.filter(F.size(fuse.negated_spans(F.col("query_text"))) > 0).select("query_id", "query_text")
    twins = q.select((F.col("query_id") + 1000).alias("query_id"), fuse.without_cues(F.col("query_text")).alias("query_text"))
    asked = materialize(q.unionByName(twins), "asked")
    run = materialize(lex.bm25(asked, 30), "run")
    filtered = fuse.negation_filtered(run, asked, _corpus(spark, d), 10)
    pairs = q.select("query_id", (F.col("query_id") + 1000).alias("twin_id"))
    plain, kept = (evaluate.overlap(r, run, pairs, doc="doc_id").select("query_id", F.col("overlap").alias(name)) for r, name in ((run, "plain"), (filtered, "filtered")))
    return plain.join(kept, "query_id").select("query_id", F.round("plain", 6).alias("plain"), F.round("filtered", 6).alias("filtered"))


# Evaluation


def _log_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each ranker's served ranking of each judged query: every trial at its best served rank."""
    log = _t(spark, d, "search_log").filter(F.col("query_id").isNotNull() & F.col("trial_id").isNotNull())
    best = log.groupBy(F.col("ranker").alias("method"), "query_id", "trial_id").agg(F.min("hit_rank").alias("r"))
    w = Window.partitionBy("method", "query_id").orderBy("r", "trial_id")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).drop("r")


def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    scores = evaluate.per_query(_log_runs(spark, d), evaluate.judgements(_t(spark, d, "eval_queries")))
    return evaluate.summary(scores)


def log_metrics_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    scores = evaluate.per_query(_log_runs(spark, d), evaluate.judgements(_t(spark, d, "eval_queries")), (10,))
    return evaluate.summary(scores.join(_t(spark, d, "eval_queries").select("query_id", "stratum"), "query_id"), ["stratum", "method"])


def ranker_metrics(spark: SparkSession, d: str) -> DataFrame:
    """BM25, TF-IDF and their union on the judged queries; the union is scored to twice the depth."""
    lex, q = _runs(spark, d)
    rows = _corpus(spark, d)
    bm25, tfidf = materialize(lex.bm25(q, 20), "bm25"), materialize(lex.tfidf(q, 20), "tfidf")
    runs = {"bm25": bm25, "tfidf": tfidf, "union": fuse.rrf_union(bm25, tfidf)}
    out = None
    for name, run in runs.items():
        part = retrieval.one_per_trial(run, rows).select(F.lit(name).alias("method"), "query_id", "trial_id", "rank")
        out = part if out is None else out.unionByName(part)
    scores = evaluate.per_query(out, evaluate.judgements(q), (5, 10), depth_factor=F.when(F.col("method") == "union", 2).otherwise(1))
    return evaluate.summary(scores)


def method_best(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_method(log_metrics(spark, d))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    p95 = log_latency(spark, d).agg(F.max("p95")).first()[0]
    return evaluate.check_targets(method_best(spark, d), p95)


def log_latency(spark: SparkSession, d: str) -> DataFrame:
    """Delivery latency of each ranker's hits in milliseconds, nearest-rank percentiles."""
    log = _t(spark, d, "search_log").groupBy("hit_id").agg(F.min("ranker").alias("ranker"), F.min((F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("served_at").cast("timestamp"))) / 1000.0).alias("ms"))
    return evaluate.percentiles(log, "ranker", "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of recall at 10, the union's served rankings against BM25's."""
    scores = materialize(evaluate.per_query(_log_runs(spark, d), evaluate.judgements(_t(spark, d, "eval_queries")), (10,)), "scores")
    a, b = (scores.filter(F.col("method") == m).select("query_id", F.col("recall").alias(m)) for m in ("bm25", "union"))
    return evaluate.paired_bootstrap(a.join(b, "query_id").select("query_id", (F.col("union") - F.col("bm25")).alias("diff")))


def overlap_twins(spark: SparkSession, d: str) -> DataFrame:
    """Share of the first ten that each two rankers serve in common for a query."""
    runs = _log_runs(spark, d).filter(F.col("rank") <= 10)
    a, b = runs.select("query_id", "trial_id", F.col("method").alias("method_a")), runs.select("query_id", "trial_id", F.col("method").alias("method_b"))
    met = a.join(b, ["query_id", "trial_id"]).filter(F.col("method_a") < F.col("method_b"))
    per = met.groupBy("query_id", "method_a", "method_b").agg((F.count(F.lit(1)) / 10).alias("overlap"))
    return per.groupBy("method_a", "method_b").agg(F.round(F.avg("overlap"), 6).alias("overlap"))


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """Pooled candidates and their verdicts: null where the query has no named judge and the candidate no judgement."""
    q = _t(spark, d, "eval_queries")
    judged = evaluate.judgements(q).withColumn("yes", F.lit(True))
    sheet = pool_candidates(spark, d).join(judged, ["query_id", "trial_id"], "left").join(q.select("query_id", "judged_by"), "query_id")
    return sheet.select("query_id", "trial_id", F.when(F.col("yes") | F.col("judged_by").isNotNull(), F.coalesce("yes", F.size(F.split("found_by", ",")) > 1)).alias("relevant"))


def label_progress(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_progress(_sheet(spark, d))


def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    merged = evaluate.merged_labels(_sheet(spark, d), evaluate.judgements(_t(spark, d, "eval_queries")))
    return merged.select("query_id", F.concat_ws(",", "relevant").alias("relevant"))


def relevant_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "eval_queries")
    per = evaluate.judgements(q).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return q.join(per, "query_id", "left").groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("relevant"))


def served_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hits per day and ranker, by event time."""
    return ingest.served_per_window(_t(spark, d, "search_log"))


def integrity_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on models and indexes that were saved to storage, some of them spoilt afterwards, against the corpus table.

    The skip-gram model and its abstract index fit. Its title index was built
    from other vectors of another model and lacks a row. The subword model was
    trained on the rows with a date only, and its index predates checksums. A
    third model was never trained.
    """
    root = scratch_path(spark, "artefacts")
    rows, docs = _corpus(spark, d), _t(spark, d, "document_index").select(F.col("vec_id").alias("doc_id"), F.col("vectors").alias("v"))
    mark = lambda table: manifest.table_fingerprint(table).first()["fingerprint"]
    live, part = mark(rows), rows.filter(F.col("publication_date").isNotNull())
    words = _t(spark, d, "embeddings").select("vec_id", "embedding")
    model = store.save_table(words, f"{root}/models/skipgram", kind="skipgram", corpus_fingerprint=live, sampled=False, mb=12.8, fingerprint=manifest.model_fingerprint("skipgram", live, {"epochs": 5}))
    other = store.save_table(words.filter("vec_id > 0"), f"{root}/models/fasttext", kind="fasttext", corpus_fingerprint=f"{mark(part)}-n{part.count()}", sampled=True, mb=319.0, fingerprint=manifest.model_fingerprint("fasttext", live, {"epochs": 5}))
    fit = store.save_table(rows.select("row_id"), f"{root}/index/skipgram-abstract", model_fingerprint=model["fingerprint"], vectors_checksum=model["checksum"], corpus_fingerprint=live)
    last = rows.agg(F.max("row_id")).first()[0]
    bad = store.save_table(rows.filter(F.col("row_id") < last).select("row_id"), f"{root}/index/skipgram-title", model_fingerprint=other["fingerprint"], vectors_checksum=other["checksum"], corpus_fingerprint=live)
    old = store.save_table(docs.select("doc_id"), f"{root}/index/fasttext-abstract", model_fingerprint=other["fingerprint"], vectors_checksum=None, corpus_fingerprint=f"{live}-n200")
    models = [(m["kind"], m["fingerprint"], m["corpus_fingerprint"], m["checksum"], m["sampled"], m["mb"]) for m in (store.read_json(spark, f"{root}/models/{k}/manifest.json") for k in ("skipgram", "fasttext"))]
    indexes = [(k, f, i["model_fingerprint"], i["corpus_fingerprint"], i["vectors_checksum"], i["rows"]) for (k, f), i in ((("skipgram", "abstract"), fit), (("skipgram", "title"), bad), (("fasttext", "abstract"), old))]
    return manifest.findings(
        spark.createDataFrame([*models, ("glove", None, None, None, None, None)], "kind string, fingerprint string, corpus_fingerprint string, vectors_checksum string, sampled boolean, mb double"),
        spark.createDataFrame(indexes, "kind string, field string, model_fingerprint string, corpus_fingerprint string, vectors_checksum string, size bigint"),
        spark.createDataFrame([(live, rows.count())], "fingerprint string, rows bigint"),
    )


def table_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return manifest.table_fingerprint(_corpus(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_loaded, clean_text, strip_urls, join_marks, tokenize, preprocess, old_chain, legacy_chain, bigrams, normalize_id, truncated_abstract, row_fingerprint, drop_blank_rows, containment, csv_loaded, csv_rejected, twin_overlap,
        term_freq, doc_freq, lemma_map, lemma_postings, vocab_top10, corpus_stats, sif_weights, idf, bm25_topk, bm25_b0, tfidf_topk, bigram_bm25, old_chain_bm25, cosine_topk,
        mean_pool, sif_pool, oov_documents, l2_normalize, component_removed, fixed_component_removed, word_cloud, embedding_topk, pool_four, skipgram_vectors, subword_vectors, most_similar, candidate_sheet, rrf_union, pool_candidates, unjudged, known_item, id_collisions, negation_spans,
        negation_asserts, negation_filter, promoted, flagship, flagship_trained, query_reasons, log_metrics, log_metrics_by_stratum, ranker_metrics, method_best, release_gate, log_latency, bootstrap, overlap_twins,
        label_progress, merge_labels, relevant_per_stratum, served_per_day, integrity_findings, table_fingerprints,
    )
}
