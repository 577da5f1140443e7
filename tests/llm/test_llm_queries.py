"""Registered queries against their SQL or against brute force on the smallest tables."""

import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest

import oracle
from pyspark.sql import functions as F

from corvane.llm import queries, tokens

D = f"{oracle.ROOT}/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = oracle.compare(spark, name)
    assert not ours and not theirs


@pytest.mark.parametrize("name", ["p5_neighbors", "p5_recall", "p7_usage", "p8_mixture", "p9_scores", "p9_rates"])
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, D).count() > 0


def pairs(spark, name):
    rows = [tuple(r) for r in queries.QUERIES[name](spark, D).collect()]
    assert len(rows) == len(set(rows)) and all(r[-2] < r[-1] for r in rows)
    return set(rows)


def test_p2_against_unicode_normal_forms(spark):
    """A looser rule of the Unicode database finds every pair that differs by width, accents, blanks or invisible signs."""
    s = pq.read_table(f"{D}/sample_corpus.parquet").to_pandas()
    got = pairs(spark, "p2_found")
    for field in ("abstract", "trial_id"):
        rows = s[["row_id", field]].dropna().values.tolist()
        plain = {i: unicodedata.normalize("NFC", re.sub("[\u200b-\u200f\u2060\ufeff\u00ad\u034f]", "", t)).strip() for i, t in rows}
        stored = dict(rows)
        want = {(field, a, b) for a in plain for b in plain if a < b and plain[a] == plain[b] and stored[a] != stored[b]}
        assert want <= got


def test_p5_against_all_pairs(spark):
    v = pq.read_table(f"{D}/document_index.parquet").to_pandas()
    v = v[v.vectors.notna()]
    v = v[v.vectors.map(len) == 64].sort_values("vec_id")
    x = np.stack(v.vectors.values).astype(float)
    n = np.linalg.norm(x, axis=1)
    ids, u = v.vec_id.values[n > 0], x[n > 0] / n[n > 0, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :5]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in best[i] if s[i, j] >= 0.9}
    assert pairs(spark, "p5_found") == want


def test_p6_against_all_pairs(spark):
    s = pq.read_table(f"{D}/sample_corpus.parquet").to_pandas()
    sets = {}
    for i, t, a in s[["row_id", "title", "abstract"]].values:
        if a is not None:
            w = re.findall("[a-z0-9]+", ((t or "") + " " + a).lower())
            if len(w) >= 20:
                sets[i] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert pairs(spark, "p6_found") == want


def test_p7_keeps_every_token_and_capacity(spark):
    packed = queries.p7_packed(spark, D).toPandas()
    caps = pq.read_table(f"{D}/pack_capacities.parquet").to_pandas().set_index("capacity_id").capacity_tokens
    assert packed.groupby("capacity_id").tokens.sum().nunique() == 1
    filled = packed[packed.container > 0].groupby(["capacity_id", "container"]).tokens.sum()
    assert all(n <= caps[c] for (c, _), n in filled.items())
    assert not packed.duplicated(["capacity_id", "doc_id", "piece"]).any()


def test_p8_reaches_shares(spark):
    """Used tokens differ from rate x tokens by no more than five deviations of the draw."""
    d = f"{oracle.ROOT}/sf0.01"
    rows = queries.p8_shares(spark, d).collect()
    sized = tokens.with_tokens(spark.read.parquet(f"{d}/documents.parquet"), key="doc_id", text="text", keep=("source",))
    squares = {r["source"]: r["s"] for r in sized.groupBy("source").agg(F.sum(F.col("tokens") * F.col("tokens")).alias("s")).collect()}
    for r in rows:
        assert r["rate"] <= r["max_repeats"]
        part = r["rate"] % 1
        assert abs(r["used_tokens"] - r["rate"] * r["have_tokens"]) <= 5 * (part * (1 - part) * squares.get(r["source"], 0)) ** 0.5 + 1e-6
    assert sum(r["share"] for r in rows) == pytest.approx(1)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "corvane.llm" not in p.read_text(), p
