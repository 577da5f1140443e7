"""Metrics, bootstrap, labels, manifests, vectors and storage."""

import math
import tracemalloc
from dataclasses import replace

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from corvane import queries
from corvane.api import _params
from corvane.config import Settings
from corvane.operators import embed, evaluate, manifest, vectors
from corvane.sources import corpus, store


def runs(spark, *docs):
    return spark.createDataFrame([("m", 1, d, i) for i, d in enumerate(docs, 1)], "method string, query_id int, trial_id string, rank bigint")


def judged(spark, **by):
    return spark.createDataFrame([(int(q[1:]), d) for q, ds in by.items() for d in ds], "query_id int, trial_id string")


def test_metrics_by_hand(spark):
    row = evaluate.per_query(runs(spark, "a", "x", "y"), judged(spark, q1=["a", "b"]), (5,)).first()
    assert (row["recall"], row["mrr"], row["r_precision"], row["ceiling"]) == (0.5, 1.0, 0.5, 1.0)
    assert row["precision"] == pytest.approx(1 / 3)
    assert row["ndcg"] == pytest.approx(1 / (1 + 1 / math.log2(3)))


def test_queries_without_hits_count_zero(spark):
    means = evaluate.summary(evaluate.per_query(runs(spark, "a"), judged(spark, q1=["a"], q2=["b"]), (1,))).first()
    assert (means["queries"], means["unanswered"], means["recall"]) == (2, 1, 0.5)


def test_union_depth(spark):
    row = evaluate.per_query(runs(spark, "x", "y", "a"), judged(spark, q1=["a"]), (2,), depth_factor=2).first()
    assert row["recall"] == 1.0 and row["mrr"] == pytest.approx(1 / 3)


def test_percentiles_are_not_interpolated(spark):
    t = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("h", None)], "g string, v double")
    row = evaluate.percentiles(t, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()
    assert [(r["g"], r["p50"], r["p95"], r["most"]) for r in row] == [("g", 6.0, 10.0, 10.0)]


def test_bootstrap(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(np.linspace(-0.1, 0.3, 40).tolist())], "query_id int, diff double")
    row = evaluate.paired_bootstrap(d, resamples=4000).first()
    rng = np.random.default_rng(0)
    x = np.linspace(-0.1, 0.3, 40)
    m = x[rng.integers(0, 40, (20000, 40))].mean(1)
    assert row["effect"] == pytest.approx(0.1)
    assert row["low"] == pytest.approx(np.percentile(m, 2.5), abs=0.004) and row["high"] == pytest.approx(np.percentile(m, 97.5), abs=0.004)
    assert row["p"] < 0.01
    same = evaluate.paired_bootstrap(d, resamples=4000).first()
    assert row == same


def test_labels(spark):
    sheet = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", None), (2, "d", True), (3, "e", True)], "query_id int, trial_id string, relevant boolean")
    assert evaluate.label_progress(sheet).first().asDict() == {"judged": 4, "candidates": 5, "complete": 2}
    merged = evaluate.merged_labels(sheet, judged(spark, q1=["z"], q2=["y"]))
    assert {r["query_id"]: r["relevant"] for r in merged.collect()} == {1: ["a", "z"], 2: ["y"]}


def test_gate(spark):
    best = spark.createDataFrame([("union", 0.71, 0.4)], "method string, recall double, mrr double")
    assert {r["target"]: r["met"] for r in evaluate.check_targets(best, 128.0).collect()} == {"recall@10": True, "mrr@10": False, "p95_ms": True}


def test_overlap(spark):
    a = spark.createDataFrame([(1, d, i) for i, d in enumerate("abc", 1)], "query_id int, trial_id string, rank int")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "query_id int, twin_id int")
    b = a.withColumn("query_id", F.lit(2)).filter("rank < 3")
    assert {r["twin_id"]: r["overlap"] for r in evaluate.overlap(a, b, pairs).collect()} == {2: 0.2, 3: 0.0}


def test_fingerprint_ignores_order_not_content(spark):
    t = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    f = lambda x: manifest.table_fingerprint(x).first()["fingerprint"]
    assert f(t) == f(t.repartition(7).orderBy(F.desc("a"))) != f(t.filter("a < 49"))
    assert len(f(t.limit(0))) == 16


def test_model_fingerprint_leaves_parallelism_out():
    a, b = ({"seed": 1, "partitions": p} for p in (1, 8))
    assert manifest.model_fingerprint("x", "c", a) == manifest.model_fingerprint("x", "c", b) != manifest.model_fingerprint("y", "c", a)


def test_missing_corpus_is_found(spark):
    none = spark.createDataFrame([], "fingerprint string, rows bigint")
    models = spark.createDataFrame([], "kind string, fingerprint string, corpus_fingerprint string, vectors_checksum string, sampled boolean, mb double")
    indexes = spark.createDataFrame([], "kind string, field string, model_fingerprint string, corpus_fingerprint string, vectors_checksum string, size bigint")
    assert [r["code"] for r in manifest.findings(models, indexes, none).collect()] == ["corpus-missing"]


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}"
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.save_table(t, f"{root}/idx", corpus_fingerprint="c1", kind="mean")
    back, about = store.load_table(spark, f"{root}/idx", verify=True, corpus_fingerprint="c1")
    assert back.count() == about["rows"] == 2
    with pytest.raises(manifest.StaleIndexError):
        store.load_table(spark, f"{root}/idx", corpus_fingerprint="c2")
    with pytest.raises(manifest.MismatchError):
        store.load_table(spark, f"{root}/idx", kind="sif")
    with pytest.raises(manifest.NotTrainedError):
        store.load_table(spark, f"{root}/none")
    t.limit(1).write.mode("overwrite").parquet(f"{root}/idx/data")
    with pytest.raises(manifest.MismatchError):
        store.load_table(spark, f"{root}/idx", verify=True)
    built = []
    build = lambda: built.append(1) or t
    for force in (False, False, True):
        assert store.cached(build, spark, f"{root}/cache", fingerprint="f", field="title", force=force).count() == 2
    assert len(built) == 2
    assert store.sizes(spark, f"{root}/idx").agg(F.sum("bytes")).first()[0] > 0


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Trial ID,Title,Abstract,Publication date,Extra\nNCT1,"A, b","line\nend ""q""",2020-01-01,x\nNCT2,NA,,2020,y\nNCT3,t,n/a,,z\n')
    rows = corpus.read_csv(spark, str(p)).collect()
    assert [(r["trial_id"], r["title"], r["abstract"], r["phase"]) for r in rows] == [("NCT1", "A, b", 'line\nend "q"', None), ("NCT3", "t", None, None)]
    assert corpus.read_csv(spark, str(p), limit=2).count() == 1
    (tmp_path / "b.csv").write_text("Trial ID,Title\n1,2\n")
    with pytest.raises(manifest.SchemaError, match="Abstract"):
        corpus.read_csv(spark, str(tmp_path / "b.csv"))
    with pytest.raises(manifest.CorpusNotFoundError):
        corpus.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(manifest.EmptyCorpusError):
        corpus.require_rows(spark.range(0))
    with pytest.raises(manifest.SchemaError):
        corpus.text_of(spark.range(1), "abstract")
    # the digest of the lines' digests, no longer of the file as one value: equal for equal content, whatever the file's name
    first = manifest.file_fingerprint(spark, str(p))
    (tmp_path / "copy.csv").write_bytes(p.read_bytes())
    assert len(first) == 16 and manifest.file_fingerprint(spark, str(tmp_path / "copy.csv")) == first
    (tmp_path / "copy.csv").write_bytes(p.read_bytes() + b"NCT4,t,u,,z\n")
    assert manifest.file_fingerprint(spark, str(tmp_path / "copy.csv")) != first


def test_query_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n lung injury \nx\n")
    assert [r[0] for r in corpus.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["lung injury", "x"]
    for name, text in (("a.json", '[{"query": "q", "relevant": ["a"]}]'), ("b.json", '{"about": 1, "queries": [\n{"query": "q", "stratum": "s", "relevant": ["a", "b"]}]}')):
        (tmp_path / name).write_text(text)
        assert corpus.read_judgements(spark, str(tmp_path / name)).count() == 1
    (tmp_path / "c.json").write_text('[{"query": "q", "relevant": []}]')
    with pytest.raises(manifest.SchemaError):
        corpus.read_judgements(spark, str(tmp_path / "c.json"))


@pytest.mark.parametrize("held", [True, False])
def test_pooling(spark, monkeypatch, held):
    """With word vectors in every task, and by a join."""
    if not held:
        monkeypatch.setattr(vectors, "MAX_VECTORS_MB", 0)
    words = spark.createDataFrame([("lung", [1.0, 0.0]), ("virus", [0.0, 2.0]), ("null", None)], "term string, v array<double>")
    docs = spark.createDataFrame([(1, ["lung", "unseen", "virus", "lung"]), (2, ["unseen", "null"]), (3, []), (4, None)], "doc_id bigint, tokens array<string>")
    got = {r["doc_id"]: (r["v"], r["known"]) for r in vectors.pooled(docs, words).collect()}
    assert got.pop(1) == (pytest.approx([2 / 3, 2 / 3]), 3) and got == {2: (None, 0), 3: (None, 0), 4: (None, 0)}
    weights = spark.createDataFrame([("lung", 0.0)], "term string, weight double")
    assert {r["doc_id"]: r["v"] for r in vectors.pooled(docs, words, weights).collect()}[1] == pytest.approx([0.0, 2.0])
    zero = spark.createDataFrame([("lung", 0.0), ("virus", 0.0)], "term string, weight double")
    assert {r["doc_id"]: r["v"] for r in vectors.pooled(docs, words, zero).collect()}[1] == pytest.approx([2 / 3, 2 / 3])
    assert vectors.pooled(docs.limit(0), words).count() == 0
    assert {r["known"] for r in vectors.pooled(docs, words.limit(0)).collect()} == {0}


def test_component_removal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [5, 1, 1, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    u = np.array(vectors.principal_component(df))
    true = np.linalg.svd(x - x.mean(0))[2][0]
    assert abs(u @ true) == pytest.approx(1, abs=1e-6)
    left = np.array([r[0] for r in df.select(vectors.without_component(F.col("v"), u.tolist())).collect()])
    assert np.abs(left @ u).max() < 1e-9
    assert vectors.principal_component(df.limit(0)) == []
    assert df.select(vectors.without_component(F.col("v"), []) == F.col("v")).distinct().collect()[0][0]
    unit = df.limit(1).select(vectors.norm(vectors.l2_normalized(F.col("v")))).first()[0]
    assert unit == pytest.approx(1)
    assert np.array(vectors.projected(df, 2, key="id").first()["p"]).shape == (2,)
    with pytest.raises(ValueError):
        vectors.assert_width(df, "v", 3)


def test_embeddings(spark):
    tokens = spark.createDataFrame([(2 * i + j, t.split()) for i in range(60) for j, t in enumerate(("lung injury failure virus", "kidney injury failure renal"))] + [(500, []), (501, None)], "doc_id bigint, tokens array<string>")
    p = embed.TrainingParams(vector_size=8, epochs=3, buckets=500, partitions=2)
    for subwords in (False, True):
        one, two = (embed.train(tokens, p, subwords=subwords) for _ in range(2))
        assert sorted(map(str, one.words.collect())) == sorted(map(str, two.words.collect()))
    asked = spark.createDataFrame([("lung",), ("lungs",), ("injuries",)], "term string")
    got = {r["term"]: r["v"] for r in embed.infer(asked, one.words, one.buckets, p).collect()}
    assert set(got) == {"lung", "lungs", "injuries"} and all(len(v) == 8 for v in got.values())
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert cos(got["lungs"], got["lung"]) > 0.5
    none = embed.train(tokens.limit(0), p, subwords=True)
    assert none.words.count() == none.buckets.count() == 0
    with pytest.raises(manifest.ResourceError):
        embed.train(tokens, embed.TrainingParams(vector_size=300, buckets=10**6), subwords=True)
    with pytest.raises(ValueError):
        embed.TrainingParams(epochs=0)


def test_words_of_like_contexts_are_alike(spark):
    """Words that stand in the same contexts come out nearer than words that don't."""
    rng = np.random.default_rng(2)
    groups = [[f"{g}{i}" for i in range(8)] for g in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, [str(w) for w in rng.choice(groups[i % 4], 12)]) for i in range(800)]
    words = embed.skipgram(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"), embed.TrainingParams(vector_size=16, partitions=2, sample=1.0))
    v = {r["term"]: np.array(r["v"]) / np.linalg.norm(r["v"]) for r in words.collect()}
    inside = np.mean([v[a] @ v[b] for g in groups for a in g for b in g if a < b])
    across = np.mean([v[a] @ v[b] for g in groups for h in groups for a in g for b in h if g is not h])
    assert len(v) == 32 and inside > across + 0.3


def test_registered_queries_train_in_full(spark, monkeypatch):
    """The registered queries train as the settings do; only the number of partitions may differ."""
    trained, real = [], embed.train
    monkeypatch.setattr(embed, "train", lambda tokens, params=embed.TrainingParams(), **more: trained.append(params) or real(tokens, params, **more))
    d = f"{oracle.ROOT}/sf0.001"
    assert {len(r["v"]) for r in queries.skipgram_vectors(spark, d).collect()} == {100}
    assert {len(r["v"]) for r in queries.subword_vectors(spark, d).collect()} == {100}
    assert queries.most_similar(spark, d).count() > 0
    assert [replace(p, partitions=1) for p in trained] == [_params(Settings())] * 3


def test_subword_step_is_lean():
    """Words share n-grams, one holds one twice: the step is that of plain sums, and no copy in doubles or of every part's step is made."""
    rng = np.random.default_rng(3)
    words, buckets, width, p = 200, 400, 100, embed.TrainingParams(window=1, buckets=400)
    grams = [np.concatenate([[w], words + rng.integers(0, buckets if w % 4 == 0 else 4 * words, 30)]) for w in range(words)]
    grams[5][1] = grams[5][2]
    parts, ends = np.concatenate(grams), np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    inputs, outputs = (rng.normal(size=(n, width)).astype(np.float32) / 10 for n in (words * 5, words))
    m = embed._Matrices(inputs.copy(), outputs.copy(), np.zeros(words * 5, np.float32), np.zeros(words, np.float32), parts, ends)
    ids, noise = np.arange(words), np.ones(words, np.float32)
    tracemalloc.start()
    embed._step(m, ids, np.zeros(words, int), p, noise, 0.2, np.random.default_rng(0), [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    share = np.zeros((words, words * 5))
    np.add.at(share, (np.repeat(ids, np.diff(ends)), parts), np.repeat(1 / np.diff(ends), np.diff(ends)))
    hidden, met = share @ inputs, 1.0 * (np.abs(ids[:, None] - ids) == 1)
    yes = 1 / (1 + np.exp(-hidden @ outputs.T))
    gain = met * (1 - yes) - p.negative * met.sum(1, keepdims=True) / words * yes
    to_out, to_in = gain.T @ hidden, share.T @ (gain @ outputs)
    for got, start, step in ((m.outputs, outputs, to_out), (m.inputs, inputs, to_in)):
        assert np.allclose(got, start + 0.2 * step / np.sqrt((step**2).mean(1) + 1e-8)[:, None], atol=2e-4)
    assert peak < 4.4e6
