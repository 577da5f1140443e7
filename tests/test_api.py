"""CSV to search results, through the API and the command line."""

import csv
import json
import os

import pytest

from corvane import api, cli
from corvane.config import Settings
from corvane.operators.manifest import ConfigurationError, NotTrainedError, StaleIndexError

TOPICS = {"lung": "respiratory failure oxygen ventilation lung injury", "kidney": "renal kidney injury dialysis creatinine", "vaccine": "vaccine antibody response dose immunity"}


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    root = tmp_path_factory.mktemp("api")
    with open(root / "corpus.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Date added", "Trial ID", "Title", "Brief title", "Abstract", "Publication date", "Phase"])
        for i in range(30):
            topic = list(TOPICS)[i % 3]
            w.writerow(["2020-01-01", f"NCT{i:08d}", f"{topic} trial {i}", "", f"{TOPICS[topic]}, adults\nand {TOPICS[topic]} number {i}", "2020-02-02", "Phase 2"])
    return Settings(corpus=f"{root}/corpus.csv", root=f"file://{root}/out", vector_size=12, epochs=1, buckets=800, top_n=5, min_count=1)


def run(settings, spark, *argv):
    return cli.main(["--corpus", settings.corpus, "--root", settings.root, *argv], spark)


@pytest.fixture(scope="module")
def built(spark, settings):
    with pytest.raises(NotTrainedError):
        api.load_engine(spark, settings)
    made = api.train_model(spark, settings)
    assert api.train_model(spark, settings) == made
    api.build_index(spark, settings)
    return api.load_engine(spark, settings, verify=True)


def test_search(spark, built):
    assert built.size == 30 and built.sampled_limit is None
    rows = built.search("kidney dialysis").collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and "kidney" in rows[0]["title"]
    assert built.search("nct00000004 please").first()["trial_id"] == "NCT00000004"
    plain = built.search("vaccine", union=False, top_n=3).collect()
    assert len(plain) <= 3
    none = built.search("the", union=True)
    assert built.reasons("the", none).first()["reason"] == "Query has no searchable words."
    assert {tuple(r["found_by"]) for r in built.provenance("lung ventilation").collect()} <= {("embedding",), ("keyword",), ("embedding", "keyword")}


def test_negated_concept_is_dropped(built):
    titles = [r["title"] for r in built.search("injury without renal kidney").collect()]
    assert not any("kidney" in t for t in titles)


def test_evaluation(spark, built, settings, tmp_path):
    judged = spark.createDataFrame([(1, "kidney dialysis", [f"NCT{i:08d}" for i in range(1, 30, 3)])], "query_id int, query_text string, relevant array<string>")
    means = {(r["method"], r["k"]): r for r in api.run_evaluation(built, judged).collect()}
    assert means["bm25", 10]["recall"] == 1.0 and means["union-fasttext", 10]["mrr"] == 1.0
    (tmp_path / "e.json").write_text(json.dumps([{"query": "kidney dialysis", "relevant": ["NCT00000001"]}]))
    timed = api.run_evaluation(built, judged, timed=1, baseline=False, report=f"file://{tmp_path}/report")
    assert {r["method"] for r in timed.collect()} == {"fasttext", "union-fasttext"} and all(0 < r["p50"] <= r["p95"] for r in timed.collect())
    assert spark.read.json(f"file://{tmp_path}/report").count() == 4
    assert run(settings, spark, "evaluate", "--eval-file", str(tmp_path / "e.json"), "--timed", "1") in (0, 1)
    assert len(api.sweep_configs()) == 6 and len(set(map(str, api.sweep_configs().values()))) == 6


def test_equal_rows_and_lemmas_are_kept(spark, tmp_path):
    """Rows that differ in a hidden column, or not at all, all count; forms of a word meet in documents and queries."""
    rows = [("2020-01-01", "NCT00000001", "t", "", "two kidneys failed", "2020-02-02", p) for p in ("Phase 1", "Phase 2", "Phase 2")]
    rows += [("2020-01-01", "NCT00000002", "x", "", "", "2020-02-02", ""), ("2020-01-01", "NCT00000002", "", "", "x", "2020-02-02", ""), ("2020-01-01", "NCT00000003", "k", "", "one kidney", "2020-02-02", "")]
    with open(tmp_path / "c.csv", "w", newline="") as f:
        csv.writer(f).writerows([["Date added", "Trial ID", "Title", "Brief title", "Abstract", "Publication date", "Phase"], *rows])
    s = Settings(corpus=f"{tmp_path}/c.csv", root=f"file://{tmp_path}/out", model="skipgram", vector_size=4, epochs=1, min_count=1)
    assert api.load_corpus(spark, s).select("row_id").distinct().count() == 6
    api.train_model(spark, s)
    api.build_index(spark, s)
    engine = api.load_engine(spark, s)
    assert engine.preprocess_query("kidneys") == ["kidney"] and engine.lexical.stats.first()["n_docs"] == 6
    assert engine.lexical.bm25(engine.queries("kidneys")).count() == 4
    assert not engine.is_sampled and api.verify_or_warn(spark, s) == []
    hits = engine.search("unheard")
    assert hits.count() == 0 and engine.reasons("unheard", hits).first()["reason"] == "No word of this query is known."
    ruled = engine.search("kidney without one kidney")
    assert {r["trial_id"] for r in ruled.collect()} <= {"NCT00000001", "NCT00000002"}
    assert engine.reasons("kidney", hits).first()["reason"] == "All results were ruled out by the query."


def test_sif_index_and_command_line(spark, settings, built, monkeypatch, capsys):
    for name, value in (("VECTOR_SIZE", "12"), ("EPOCHS", "1"), ("BUCKETS", "800"), ("MIN_COUNT", "1")):
        monkeypatch.setenv(f"CORVANE_{name}", value)
    assert run(settings, spark, "index", "build", "--pooling", "sif") == 0
    assert run(settings, spark, "search", "lung", "--pooling", "sif", "--json", "-k", "3") == 0
    hits = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert hits and {"rank", "score", "trial_id"} <= set(hits[0])
    assert run(settings, spark, "preprocess") == 0 and run(settings, spark, "index", "info") == 0
    assert run(settings, spark, "doctor", "--full") == 0
    with pytest.raises(SystemExit):
        run(settings, spark, "search", "x", "-k", "0")
    assert run(settings, spark, "search", "x", "--model", "skipgram") == 1


def test_changed_corpus_is_refused(spark, settings, built):
    path = settings.corpus
    saved = open(path).read()
    try:
        with open(path, "a") as f:
            f.write("2020,NCT99999999,t,,new text,2020-01-01,\n")
        with pytest.raises(StaleIndexError):
            api.load_engine(spark, settings)
        codes = {r["code"] for r in api.check_artefacts(spark, settings).collect()}
        assert {"index-corpus-stale", "model-missing"} <= codes
    finally:
        with open(path, "w") as f:
            f.write(saved)
        os.utime(path)


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("CORVANE_UNION", "no")
    assert Settings.from_env().union is False
    (tmp_path / ".env").write_text("# own settings\nCORVANE_TOP_N=7\nexport CORVANE_UNION='yes'\n")
    filed = Settings.from_env(env_file=str(tmp_path / ".env"))
    assert filed.top_n == 7 and filed.union is False
    monkeypatch.setenv("CORVANE_EPOCHS", "many")
    with pytest.raises(ConfigurationError):
        Settings.from_env()
    for bad in ({"model": "glove"}, {"epochs": 0}, {"epochs": 1000}, {"sif_a": 0.0}):
        with pytest.raises(ConfigurationError):
            Settings(**bad)
