"""Train, index, search and evaluate a CSV collection."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import FIELDS, MODELS, Settings
from corvane.errors import MismatchError
from corvane.log import LOG, stage
from corvane.operators import embed, evaluate, fuse, manifest, postings, rank, vectors
from corvane.plans import retrieval
from corvane.plans.materialize import materialize
from corvane.runtime import check_memory
from corvane.sources import corpus as source
from corvane.sources import store


def load_corpus(spark: SparkSession, settings: Settings, *, limit: int | None = None) -> DataFrame:
    """Corpus rows with ``row_id``; no row is dropped, equal ones have ids of their own.

    Read and numbered once, kept under the collection's fingerprint.
    """
    build = lambda: source.numbered(source.require_rows(source.read_csv(spark, settings.corpus, limit=limit)))
    return store.cached(build, spark, f"{settings.root}/corpus", fingerprint=fingerprint(spark, settings, limit), field="all")


def load_rejects(spark: SparkSession, settings: Settings) -> DataFrame:
    """Records of the corpus file that can't be read, each with its reason."""
    return source.read_csv_parts(spark, settings.corpus)[1]


_FINGERPRINTS: dict[tuple, str] = {}


def fingerprint(spark: SparkSession, settings: Settings, limit: int | None = None) -> str:
    """Identity of the corpus file, computed again only if its files have changed."""
    state = (settings.corpus, *store.file_states(spark, settings.corpus))
    if state not in _FINGERPRINTS:
        _FINGERPRINTS[state] = manifest.file_fingerprint(spark, settings.corpus)
    f = _FINGERPRINTS[state]
    return f if limit is None else f"{f}-n{limit}"


def lexical_index(spark: SparkSession, settings: Settings, *, limit: int | None = None, force: bool = False) -> retrieval.LexicalIndex:
    """Tokens, lemmas, postings and their statistics of a field, built once for a collection and kept."""
    mark = fingerprint(spark, settings, limit)
    path = f"{settings.root}/lexical/fp={mark}/field={settings.field}"
    if force or not store.exists(spark, f"{path}/manifest.json"):
        retrieval.build_lexical(load_corpus(spark, settings, limit=limit), key="row_id", text=F.col(settings.field)).save(path, corpus_fingerprint=mark, field=settings.field)
    return retrieval.load_lexical(spark, path, corpus_fingerprint=mark)


def run_preprocessing(spark: SparkSession, settings: Settings, *, limit: int | None = None, force: bool = False) -> DataFrame:
    """(``doc_id``, ``tokens``): lemmas of the words of every document, kept with the lexical index."""
    with stage("preprocess"):
        return lexical_index(spark, settings, limit=limit, force=force).tokens


def _params(settings: Settings) -> embed.TrainingParams:
    return embed.TrainingParams(settings.vector_size, settings.window, settings.min_count, settings.epochs, settings.seed, settings.partitions, buckets=settings.buckets)


def train_model(spark: SparkSession, settings: Settings, *, limit: int | None = None, force: bool = False) -> dict:
    """Train the model of the settings and save its vectors; a subword model also saves its buckets, with a manifest of their own."""
    params, mark = _params(settings), fingerprint(spark, settings, limit)
    name = manifest.model_fingerprint(settings.model, mark, vars(params))
    path = settings.model_path()
    if not force and store.exists(spark, f"{path}/manifest.json") and store.read_json(spark, f"{path}/manifest.json").get("fingerprint") == name:
        return store.read_json(spark, f"{path}/manifest.json")
    check_memory(spark, settings, "train", limit=limit)
    with stage("train"):
        found = embed.train(run_preprocessing(spark, settings, limit=limit), params, subwords=settings.model == "fasttext")
    extra = {}
    if found.buckets is not None:
        extra["buckets_checksum"] = store.save_table(found.buckets, f"{path}/buckets", fingerprint=name)["checksum"]
    about = {"kind": settings.model, "fingerprint": name, "corpus_fingerprint": mark, "sampled": limit is not None, "width": params.vector_size, "params": vars(params), "mb": found.words.count() * params.vector_size * 4 / 1e6 + (params.matrix_mb() if settings.model == "fasttext" else 0), **extra}
    return store.save_table(found.words, path, **about)


def _word_vectors(spark: SparkSession, settings: Settings, tokens: DataFrame) -> DataFrame:
    """Vectors of the model's words and, with subwords, of all words of ``tokens``."""
    words, about = store.load_table(spark, settings.model_path())
    if settings.model == "skipgram":
        return words.select("term", F.transform("v", lambda x: x.cast("double")).alias("v"))
    buckets, _ = store.load_table(spark, f"{settings.model_path()}/buckets", checksum=about["buckets_checksum"])
    return embed.infer(tokens.select(F.explode("tokens").alias("term")), words, buckets, _params(settings))


def build_index(spark: SparkSession, settings: Settings, *, limit: int | None = None) -> dict:
    """Pool, remove the common component (sif), bring to unit length and save the document vectors."""
    about = store.read_json(spark, f"{settings.model_path()}/manifest.json")
    with stage("index"):
        tokens = run_preprocessing(spark, settings, limit=limit)
        weights = materialize(postings.sif_weights(postings.term_counts(tokens), settings.sif_a), "weights") if settings.pooling == "sif" else None
        docs = materialize(vectors.pooled(tokens, _word_vectors(spark, settings, tokens), weights), "pooled")
        component = vectors.principal_component(docs) if weights is not None else []
        unit = docs.select("doc_id", vectors.l2_normalized(vectors.without_component(F.col("v"), component)).alias("v"), "known")
        path = settings.index_path()
        if weights is not None:
            weights.write.mode("overwrite").parquet(f"{path}/weights")
        keep = {"field": settings.field, "pooling": settings.pooling, "component": component, "kind": settings.model, "width": about["width"], "model_fingerprint": about["fingerprint"], "vectors_checksum": about["checksum"], "corpus_fingerprint": fingerprint(spark, settings, limit)}
        return store.save_table(unit, path, **keep)


@dataclass
class Engine:
    """A loaded collection that answers batches of queries.

    Queries are a DataFrame (``query_id`` int, ``query_text``) or a text.
    """

    spark: SparkSession
    settings: Settings
    corpus: DataFrame
    index: DataFrame
    about: dict
    lexical: retrieval.LexicalIndex

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Let go of what is held in memory; the saved tables stay."""
        for table in (self.corpus, self.index, self.lexical.postings):
            table.unpersist()
        self.__dict__.pop("_weights", None)

    @property
    def size(self) -> int:
        return self.about["rows"]

    @property
    def sampled_limit(self) -> int | None:
        tail = self.about["corpus_fingerprint"].rpartition("-n")
        return int(tail[2]) if tail[1] and tail[2].isdigit() else None

    @property
    def is_sampled(self) -> bool:
        return self.sampled_limit is not None

    def queries(self, asked: str | DataFrame) -> DataFrame:
        return self.spark.createDataFrame([(1, asked)], "query_id int, query_text string") if isinstance(asked, str) else asked

    def query_tokens(self, asked: str | DataFrame) -> DataFrame:
        """(``doc_id``, ``tokens``) of queries, as the documents' were made; ``doc_id`` is the query's id."""
        return postings.lemma_tokens(postings.tokenized(self.queries(asked), key="query_id", text=F.col("query_text")), self.lexical.lemmas)

    def preprocess_query(self, text: str) -> list[str]:
        """Tokens of a query as the engine sees them."""
        return self.query_tokens(text).first()["tokens"]

    @cached_property
    def _weights(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.settings.index_path()}/weights") if self.about["pooling"] == "sif" else None

    def embedding(self, asked: str | DataFrame, top_n: int | None = None) -> DataFrame:
        """(``query_id``, ``doc_id``, ``score``, ``rank``) by cosine of pooled vectors."""
        tokens = self.query_tokens(asked)
        pooled = vectors.pooled(tokens, _word_vectors(self.spark, self.settings, tokens), self._weights)
        v = pooled.filter(F.col("v").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), vectors.without_component(F.col("v"), self.about["component"]).alias("v"))
        run = rank.cosine(materialize(v, "asked"), self.index.select(F.col("doc_id").alias("id"), "v"), top_n or self.settings.top_n)
        return run.withColumn("query_id", F.col("query_id").cast("int"))

    def ranked(self, asked: str | DataFrame, *, top_n: int | None = None, union: bool | None = None) -> DataFrame:
        """(``query_id``, ``trial_id``, ``score``, ``rank``): union of both runs or embedding alone, negation filter, known items first."""
        q, n = self.queries(asked), top_n or self.settings.top_n
        deep = materialize(self.embedding(q, n * fuse.DEPTH), "embedding")
        if self.settings.union if union is None else union:
            return retrieval.flagship(self.lexical, deep, q, self.corpus, per_method=n)
        kept = retrieval.one_per_trial(fuse.negation_filtered(deep, q, self.corpus, n), self.corpus)
        return fuse.promoted(kept, fuse.known_items(q, fuse.id_index(self.corpus)))

    def search(self, asked: str | DataFrame, *, top_n: int | None = None, union: bool | None = None) -> DataFrame:
        """Display rows of the ranking."""
        shown = self.corpus.groupBy("trial_id").agg(F.max_by(F.struct("title", "abstract", "publication_date"), "row_id").alias("d")).select("trial_id", "d.*")
        return store.report_rows(self.ranked(asked, top_n=top_n, union=union).join(shown, "trial_id").select("query_id", "rank", "score", "trial_id", "title", "abstract", "publication_date"))

    def provenance(self, asked: str | DataFrame, *, per_method: int = 10) -> DataFrame:
        """Union hits with the runs that found them."""
        q = self.queries(asked)
        return fuse.rrf_union(self.embedding(q, per_method), self.lexical.tfidf(q, per_method))

    def reasons(self, asked: str | DataFrame, hits: DataFrame) -> DataFrame:
        """Why queries have no hits: empty, no words, no known word, nothing matched, or all hits filtered out."""
        q = self.queries(asked)
        tokens = self.query_tokens(q)
        known = vectors.pooled(tokens, _word_vectors(self.spark, self.settings, tokens)).filter("known > 0").select(F.col("doc_id").alias("query_id"))
        return fuse.reasons(q, hits, known=known.unionByName(self.lexical.tfidf(q, 1).select("query_id")), before=self.provenance(q).select("query_id"))


def load_engine(spark: SparkSession, settings: Settings, *, limit: int | None = None, verify: bool = False) -> Engine:
    """Load what was built; raises if the index is of another collection or model, or its vectors of another width or number."""
    with stage("load"):
        model = store.read_json(spark, f"{settings.model_path()}/manifest.json")
        index, about = store.load_table(spark, settings.index_path(), verify=verify, corpus_fingerprint=fingerprint(spark, settings, limit), model_fingerprint=model["fingerprint"], vectors_checksum=model["checksum"])
        if about.get("width") != model.get("width"):
            raise MismatchError(f"{settings.index_path()}: vectors of {about.get('width')} numbers, the model has {model.get('width')}")
        corpus = load_corpus(spark, settings, limit=limit)
        rows = corpus.count()
        if about["rows"] != rows:
            raise MismatchError(f"{settings.index_path()}: {about['rows']} vectors for {rows} documents")
        if verify:
            vectors.assert_width(index.filter(F.col("v").isNotNull()), "v", about["width"])
        return Engine(spark, settings, corpus, index, about, lexical_index(spark, settings, limit=limit))


def latencies(ask, queries: DataFrame, *, warm_up: bool = True) -> DataFrame:
    """(``query_id``, ``ms``): wall time of each query asked alone, after one that isn't counted; judged queries are a short list of the caller."""
    rows = queries.select("query_id", "query_text").orderBy("query_id").collect()
    if rows and warm_up:
        ask(rows[0]["query_text"]).collect()  # top-k rows
    out = []
    for r in rows:
        start = time.perf_counter()
        ask(r["query_text"]).collect()
        out.append((r["query_id"], (time.perf_counter() - start) * 1000))
    return queries.sparkSession.createDataFrame(out, "query_id int, ms double")


def run_evaluation(engines: Engine | list[Engine], judged: DataFrame, *, ks: tuple[int, ...] = (5, 10), baseline: bool = True, union: bool = True, timed: int = 0, report: str | None = None) -> DataFrame:
    """Metrics of each engine's model and its union, of BM25 and of TF-IDF over judged queries (``query_id``, ``query_text``, ``relevant``).

    Engines are of one collection, one for each model. With ``timed``, so many
    queries are also asked one by one for the columns ``p50``, ``p95``, ``p99``,
    ``mean_ms`` and ``max_ms`` of each method. With ``report`` the means are
    written there as JSON as well.
    """
    engines = engines if isinstance(engines, list) else [engines]
    most, first = max(ks), engines[0]
    tfidf = materialize(first.lexical.tfidf(judged, most), "tfidf")
    runs, asks = {}, {}
    for e in engines:
        name = e.settings.model
        emb = materialize(e.embedding(judged, most), "emb")
        runs[name], asks[name] = emb, (lambda text, e=e: e.ranked(text, top_n=most, union=False))
        if union:
            runs[f"union-{name}"], asks[f"union-{name}"] = fuse.rrf_union(emb, tfidf), (lambda text, e=e: e.ranked(text, top_n=most, union=True))
    if baseline:
        runs |= {"bm25": first.lexical.bm25(judged, most), "tfidf": tfidf}
        asks |= {"bm25": lambda text: first.lexical.bm25(first.queries(text), most), "tfidf": lambda text: first.lexical.tfidf(first.queries(text), most)}
    out = None
    for name, run in runs.items():
        part = retrieval.one_per_trial(run, first.corpus).select(F.lit(name).alias("method"), "query_id", "trial_id", "rank")
        out = part if out is None else out.unionByName(part)
    depth = F.when(F.col("method").startswith("union-"), 2).otherwise(1)
    means = evaluate.summary(evaluate.per_query(out, evaluate.judgements(judged), ks, depth_factor=depth))
    if timed:
        some, times = judged.orderBy("query_id").limit(timed), None
        for name, ask in asks.items():
            part = latencies(ask, some).withColumn("method", F.lit(name))
            times = part if times is None else times.unionByName(part)
        times = evaluate.percentiles(times, "method", "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n").withColumnsRenamed({"mean": "mean_ms", "most": "max_ms"})
        means = means.join(times, "method")
    if report:
        store.write_report(means, report)
    return means


#: The one-factor changes of a sweep, against the settings as they are.
SWEEP = {"as set": {}, "vectors of 200": {"vector_size": 200}, "window of 10": {"window": 10}, "15 passes": {"epochs": 15}, "words of 5 and more": {"min_count": 5}, "10 negatives": {"negative": 10}}


def sweep_configs(params: embed.TrainingParams = embed.TrainingParams()) -> dict[str, embed.TrainingParams]:
    return {name: replace(params, **change) for name, change in SWEEP.items()}


def sweep(spark: SparkSession, tokens: DataFrame, configs: dict[str, embed.TrainingParams], score) -> DataFrame:
    """(``config``, ``score``): one training per configuration (as of ``sweep_configs``), each scored by ``score(word_vectors)``."""
    rows = [(name, float(score(materialize(embed.skipgram(tokens, p), "words")))) for name, p in configs.items()]
    return spark.createDataFrame(rows, "config string, score double")


def check_artefacts(spark: SparkSession, settings: Settings) -> DataFrame:
    """Findings on all models and indexes below the root against the live collection."""
    live = [(fingerprint(spark, settings), load_corpus(spark, settings).count())] if store.exists(spark, settings.corpus) else []
    models, indexes = [], []
    for kind in MODELS:
        have = False
        for field in FIELDS:
            path = settings.model_path(kind, field)
            if store.exists(spark, f"{path}/manifest.json"):
                m, have = store.read_json(spark, f"{path}/manifest.json"), True
                models.append((f"{kind}", m["fingerprint"], m["corpus_fingerprint"], m["checksum"], m["sampled"], float(m["mb"])))
                for pooling in ("mean", "sif"):
                    at = settings.index_path(kind, field, pooling)
                    if store.exists(spark, f"{at}/manifest.json"):
                        i = store.read_json(spark, f"{at}/manifest.json")
                        indexes.append((kind, field, i["model_fingerprint"], i["corpus_fingerprint"], i.get("vectors_checksum"), i["rows"]))
        if not have:
            models.append((kind, None, None, None, None, None))
    return manifest.findings(
        spark.createDataFrame(models, "kind string, fingerprint string, corpus_fingerprint string, vectors_checksum string, sampled boolean, mb double"),
        spark.createDataFrame(indexes, "kind string, field string, model_fingerprint string, corpus_fingerprint string, vectors_checksum string, size bigint"),
        spark.createDataFrame(live, "fingerprint string, rows bigint"), max_mb=settings.max_artefact_mb,
    )


def verify_or_warn(spark: SparkSession, settings: Settings) -> list[str]:
    """Findings that concern what the settings serve, logged as warnings: the model, and its index of the field."""
    rows = check_artefacts(spark, settings).filter(F.col("subject").isin(settings.model, f"{settings.model}-{settings.field}", "corpus")).collect()  # a handful of findings
    for r in rows:
        LOG.warning("%s %s: %s", r["severity"], r["code"], r["subject"])
    return [r["code"] for r in rows]
