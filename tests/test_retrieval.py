"""Rankers, fusion, identifiers and negation on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import fuse, postings, rank
from corvane.plans import retrieval

DOCS = [(1, "lung injury lung failure"), (2, "kidney injury"), (3, "vaccine response in lungs"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in DOCS], "row_id bigint, abstract string, term string")


@pytest.fixture(scope="module")
def lex(docs):
    return retrieval.build_lexical(docs, key="row_id", text=F.col("abstract"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, query_text string")


def test_stats_count_empty_documents(lex):
    row = lex.stats.first()
    assert row["n_docs"] == 5
    assert row["avgdl"] == pytest.approx((4 + 2 + 3) / 5)


def test_bm25_by_hand(spark, lex):
    got = {r["doc_id"]: r["score"] for r in lex.bm25(asked(spark, "kidney")).collect()}
    idf = math.log(1 + (5 - 1 + 0.5) / 1.5)
    tf = 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.8))
    assert got == {2: pytest.approx(idf * tf, abs=1e-6)}


def test_repeated_query_words_count(spark, lex):
    one, two = (lex.bm25(asked(spark, q)).first()["score"] for q in ("kidney", "kidney kidney"))
    assert two == pytest.approx(2 * one, abs=2e-6)


def test_lemma_joins_forms(spark, lex):
    assert {r["doc_id"] for r in lex.tfidf(asked(spark, "lungs")).collect()} == {1, 3}


def test_tfidf_scores_are_cosines(spark, lex):
    best = lex.tfidf(asked(spark, "lung injury lung failure", "nothing known")).collect()
    assert (best[0]["doc_id"], best[0]["score"]) == (1, 1.0) or max(r["score"] for r in best) == 1.0
    assert {r["query_id"] for r in best} == {1}


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(1, d, 1.0) for d in (9, 3, 7)] + [(1, 5, 0.0), (1, 6, -1.0)], "query_id int, doc_id bigint, score double")
    assert [(r["doc_id"], r["rank"]) for r in rank.top_n(scored, 2).orderBy("rank").collect()] == [(3, 1), (7, 2)]
    assert rank.top_n(scored, 0).count() == 0


def test_cosine_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(40)] + [(99, [0.0, 0.0, 0.0]), (98, None)], "id bigint, v array<double>")
    whole, cut = (sorted(map(tuple, rank.cosine(v.limit(50).filter("id < 5"), v, 4, block_rows=b).collect())) for b in (4096, 7))
    assert whole == cut
    assert all(r[1] not in (98, 99) for r in whole)


def run(spark, *docs):
    return spark.createDataFrame([(1, d, 1.0, i) for i, d in enumerate(docs, 1)], "query_id int, doc_id string, score double, rank bigint")


def test_union_of_disjoint_runs(spark):
    fused = fuse.rrf_union(run(spark, "NCT001", "NCT002"), run(spark, "NCT003", "NCT004")).orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == ["NCT003", "NCT004", "NCT001", "NCT002"]
    assert fused[0]["score"] == pytest.approx(1.5 / 61)


def test_union_consensus_first(spark):
    fused = fuse.rrf_union(run(spark, "a", "b"), run(spark, "c", "b")).orderBy("rank").collect()
    assert [(r["doc_id"], r["found_by"]) for r in fused][0] == ("b", ["embedding", "keyword"])
    assert len(fused) == 3


@pytest.mark.parametrize(
    "query, spans",
    [
        ("patients not requiring supplemental oxygen", [["requiring", "supplemental", "oxygen"]]),
        ("without mechanical ventilation but requiring oxygen", [["mechanical", "ventilation"]]),
        ("spread by people without symptoms", []),
        ("not a b c d e f g", [["a", "b", "c", "d", "e"]]),
        ("without x y not p q", [["x", "y"], ["p", "q"]]),
        ("", []), (None, []),
    ],
)
def test_negated_spans(spark, query, spans):
    assert asked(spark, query).select(fuse.negated_spans(F.col("query_text"))).first()[0] == spans


@pytest.mark.parametrize(
    "text, said",
    [("invasive mechanical ventilation was used", True), ("reduces the need for mechanical ventilation", False), ("without any mechanical ventilation; later mechanical ventilation a b c d e f mechanical", True), ("mechanical aid", False), ("", False)],
)
def test_asserts(spark, text, said):
    df = spark.createDataFrame([(text, ["mechanical", "ventilation"])], "t string, s array<string>").select(fuse.asserts(F.split(F.lower("t"), "[^a-z]+"), F.col("s")))
    assert df.first()[0] is said


def test_negation_filter_drops_and_numbers_again(spark):
    corpus = spark.createDataFrame([(1, "t", "on supplemental oxygen therapy"), (2, "t", "not on supplemental oxygen"), (3, None, None)], "row_id bigint, title string, abstract string")
    ranked = spark.createDataFrame([(1, d, 1.0, d) for d in (1, 2, 3)], "query_id int, doc_id bigint, score double, rank bigint")
    kept = fuse.negation_filtered(ranked, asked(spark, "without supplemental oxygen"), corpus, 10).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in kept] == [(2, 1), (3, 2)]


def test_known_items(spark):
    corpus = spark.createDataFrame([("NCT04372368",), ("CTRI/2021/05/0338834",), ("AB-1234",), ("AB1234",), (None,), ("--",)], "trial_id string")
    index = fuse.id_index(corpus)
    assert index.count() == 2
    assert [r["ids"] for r in fuse.colliding_ids(corpus).collect()] == [2]
    q = asked(spark, "nct04372368", "ctri 2021 05 0338834", "about NCT04372368 please", "AB1234", "nothing")
    assert {r["query_id"]: r["trial_id"] for r in fuse.known_items(q, index).collect()} == {1: "NCT04372368", 2: "CTRI/2021/05/0338834", 3: "NCT04372368"}


def test_promotion_has_no_duplicate(spark):
    ranked = run(spark, "a", "b", "c").withColumnRenamed("doc_id", "trial_id")
    known = spark.createDataFrame([(1, "b")], "query_id int, trial_id string")
    assert [(r["trial_id"], r["rank"]) for r in fuse.promoted(ranked, known).orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]


def test_reasons(spark):
    q = asked(spark, "", "the of", "zzz", "fine")
    hits = spark.createDataFrame([(4, 1)], "query_id int, doc_id int")
    got = {r["query_id"]: r["reason"] for r in fuse.reasons(q, hits).collect()}
    assert got == {1: "Query is empty.", 2: "Query has no searchable words.", 3: "Nothing matched this query.", 4: None}


def test_lemma_needs_the_vocabulary(spark):
    terms = spark.createDataFrame([(t,) for t in ("studies", "study", "virus", "class", "lenses", "cells", "cell", "women", "woman", "children", "child")], "term string")
    got = {r["term"]: r["lemma"] for r in postings.lemma_map(terms).collect()}
    assert got["studies"] == "study" and got["cells"] == "cell" and got["women"] == "woman" and got["children"] == "child"
    assert got["virus"] == "virus" and got["class"] == "class" and got["lenses"] == "lenses"


def test_heavy_term_is_joined_once(spark):
    from corvane.plans.skew import join_dimension

    facts = spark.createDataFrame([(i, "hot") for i in range(500)] + [(i, f"t{i}") for i in range(50)] + [(0, None)], "r bigint, k string")
    dims = facts.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    out = join_dimension(facts, dims, "k", "df", ["r"], heavy_keys=4)
    assert out.count() == 550
    assert out.filter("k = 'hot' AND df = 500").count() == 500
