"""Each operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import contextlib
import random
import threading
import time
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import canonical, distinctive, mixing, neardup, neighbors, packing, termcounts, tokens, toxicity

# 1


def test_distinctive_edges(spark):
    rows = [(1, "aaa bbb aaa", None), (2, None, None), (3, "", "aaa"), (None, "ccc", "12 345 a1 ab1"), (1, "aaa", "x"), (4, "zzz " * 30_000 + "1" * 200_000, "")]
    t = spark.createDataFrame([(*r, "clash", 1) for r in rows], "row_id bigint, title string, abstract string, term string, tf int")
    got = {(r["record"], r["term"]): r for r in distinctive.distinctive_terms(t, key="row_id", texts=["title", "abstract"]).collect()}
    assert set(got) == {(1, "aaa"), (1, "bbb"), (3, "aaa"), (None, "ccc"), (None, "ab1"), (4, "zzz")}
    assert (got[1, "aaa"]["tf"], got[1, "aaa"]["df"], got[4, "zzz"]["tf"]) == (3, 2, 30_000)
    assert all(r["score"] >= 0 for r in got.values())
    assert distinctive.distinctive_terms(t.limit(0), key="row_id", texts=["title"]).count() == 0


def test_distinctive_prefers_rare_terms(spark):
    t = spark.createDataFrame([(i, f"common common rare{i % 10}x") for i in range(40)], "row_id bigint, title string")
    s = {r["term"][:4]: r["score"] for r in distinctive.distinctive_terms(t, key="row_id", texts=["title"]).filter("record = 3").collect()}
    assert s["rare"] > s["comm"]


# 2

SAME = ["abc", "\uff41\uff42\uff43", "a\u200bbc", "\u2007abc ", "\u0430b\u0441", "ab\u00adc", "\ufeffabc\u2060"]
OTHER = ["Abc", "abc.", "a bc", "ab¢", "αbc", "abç"]


def canon(values):
    return canonical.canonical_array(pa.array(values, pa.string())).to_pylist()


def test_canonical_forms():
    assert set(canon(SAME)) == {"abc"}
    assert "abc" not in canon(OTHER)
    assert canon(["e\u0301", "\u00e9", "e", "s\u0323\u0307", "s\u0307\u0323", "\u1e69"]) == ["\u00e9", "\u00e9", "e", "\u1e69", "\u1e69", "\u1e69"]
    assert canon(["NCT \uff11\uff12", "phase \u2162", "e\ufb03cient", "a\u2011b", "a\u2013b", "m\u00b2", "O0"]) == ["NCT 12", "phase III", "efficient", "a-b", "a\u2013b", "m\u00b2", "O0"]
    assert canon([None, "", " \t\n", "\u200b", None]) == [None, "", "", "", None]
    assert canon([]) == []
    assert canon(["\u1100\u1161\u11a8", "\uac01", "\u1100\u1161"]) == ["\uac01", "\uac01", "\uac00"]
    assert canon(["x" * 300_000 + "e\u0301"])[0].endswith("x\u00e9")
    assert canon(["a" + "\u0301" * 500])[0][0] == "\u00e1"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12), max_size=6))
def test_canonical_is_stable(values):
    once = canon(values)
    assert canon(once) == once
    assert canon([unicodedata.normalize("NFD", v) for v in values]) == once == canon([unicodedata.normalize("NFC", v) for v in values])


def test_lookalike_pairs_edges(spark):
    rows = [(1, "abc", "x"), (2, "\uff41bc", "x"), (3, "abc", None), (4, None, " x"), (5, "", " "), (None, "a\u200bbc", "x"), (2, "abc", None)]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, abstract string, trial_id string, canon string")
    got = sorted(tuple(r) for r in canonical.lookalike_pairs(t, key="row_id", fields=["abstract", "trial_id"]).collect())
    assert got == [("abstract", 1, 2), ("abstract", 2, 3), ("trial_id", 1, 4), ("trial_id", 2, 4)]
    assert canonical.lookalike_pairs(t.limit(0), key="row_id", fields=["abstract"]).count() == 0


def test_lookalike_classes_edges(spark):
    rows = [(1, "abc", "x"), (2, "\uff41bc", "x"), (3, "abc", None), (4, None, " x"), (5, "", " "), (None, "a\u200bbc", "x")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, abstract string, trial_id string, form string")
    values = canonical.canonical_values(t, key="row_id", fields=["abstract", "trial_id"])
    got = sorted(tuple(r) for r in canonical.lookalike_classes(values).collect())
    assert got == [("abstract", 1, 1, 3, 2), ("abstract", 2, 1, 3, 2), ("abstract", 3, 1, 3, 2), ("abstract", 5, 5, 1, 1), ("trial_id", 1, 1, 3, 2), ("trial_id", 2, 1, 3, 2), ("trial_id", 4, 1, 3, 2), ("trial_id", 5, 5, 1, 1)]
    assert canonical.lookalike_classes(values.limit(0)).count() == 0


# 4


def terms(spark, rows):
    return spark.createDataFrame(rows, "field string, before array<string>, after array<string>")


def state(store):
    return {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in store.counts().collect()}


def test_deltas_equal_a_recount(spark):
    rng = random.Random(3)
    store, live = termcounts.TermCountStore(spark, most_deltas=2), {}
    for batch in range(4):
        changes = []
        for key in rng.sample(range(30), 12):
            new = None if rng.random() < 0.3 else [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
            changes.append(("f", live.get(key), new))
            live[key] = new
            if new is None:
                del live[key]
        store.merge(terms(spark, changes), f"b{batch}")
        store.merge(terms(spark, changes), f"b{batch}")  # a repeated batch changes nothing
        want = {}
        for ts in live.values():
            for t in [None, *ts]:
                want.setdefault(t, [0, 0])
            want[None][1] += 1
            for t in ts:
                want[t][0] += 1
            for t in set(ts):
                want[t][1] += 1
        assert state(store) == {("f", t): tuple(n) for t, n in want.items()}


def test_delta_edges(spark):
    store = termcounts.TermCountStore(spark)
    assert store.counts().count() == 0 and termcounts.marked(store.counts()).count() == 0
    store.merge(terms(spark, []), "none")
    store.merge(terms(spark, [("f", None, []), ("f", None, None), ("f", ["x"], ["x"]), ("g", None, ["x", "x"])]), "one")
    assert state(store) == {("f", None): (0, 1), ("g", None): (0, 1), ("g", "x"): (2, 1)}
    assert [tuple(r) for r in termcounts.marked(store.counts()).select("field", "term", "mark").collect()] == [("g", "x", "rare")]
    again = termcounts.TermCountStore(spark, store.path)
    assert state(again) == state(store)


def test_store_survives_a_crash_and_a_second_writer(spark, monkeypatch):
    store = termcounts.TermCountStore(spark)
    store.merge(terms(spark, [("f", None, ["x", "y"])]), "a")
    before = state(store)
    commit = termcounts.TermCountStore._commit

    def lost(self, manifest):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(termcounts.TermCountStore, "_commit", lost)
    with pytest.raises(RuntimeError):
        store.merge(terms(spark, [("f", None, ["y", "z"])]), "b")
    assert state(termcounts.TermCountStore(spark, store.path)) == before

    def late(self, manifest):
        commit(other, dict(manifest, batch="other"))  # a second writer is faster
        commit(self, manifest)

    other = termcounts.TermCountStore(spark, store.path)
    monkeypatch.setattr(termcounts.TermCountStore, "_commit", late)
    with pytest.raises(termcounts.ConflictError):
        store.merge(terms(spark, [("f", None, ["y"])]), "c")
    monkeypatch.setattr(termcounts.TermCountStore, "_commit", commit)
    assert store.merged("a") and store.merged("other") and not store.merged("c")


def test_store_compacts_and_keeps_its_size(spark):
    """Many small batches: few tables, no growing manifest, repeated batches still known."""
    store = termcounts.TermCountStore(spark, most_deltas=3)
    for i in range(10):
        store.merge(terms(spark, [("f", None, ["all", f"t{i}"])]), f"b{i}")
        assert len(store.manifest()["tables"]) <= 3
    for i in (0, 5, 9):
        store.merge(terms(spark, [("f", None, ["all"])]), f"b{i}")
    got = state(store)
    assert got["f", "all"] == (10, 10) and got["f", None] == (0, 10) and len(got) == 12


def test_marks(spark):
    store = termcounts.TermCountStore(spark)
    store.merge(terms(spark, [("f", None, ["all", *(["some"] if i < 4 else []), *(["half"] if i < 5 else []), *(["few"] if i < 2 else []), *(["mid"] if i < 3 else [])]) for i in range(10)]), "b")
    assert {r["term"]: r["mark"] for r in termcounts.marked(store.counts()).collect()} == {"all": "common", "half": "common", "some": "common", "few": "rare", "mid": None}


# 5


def vecs(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id bigint, vectors array<float>, neighbor string, similarity double")


def test_tree_order_is_complete():
    x = np.random.default_rng(0).normal(size=(3000, 8)).astype(np.float32)
    tree = neighbors.fit_tree(x, 40)
    order = neighbors.visit_order(tree, x[:50], tree.leaves)
    assert tree.leaves > 20 and all(sorted(r) == list(range(tree.leaves)) for r in order.tolist())
    assert (neighbors.visit_order(tree, x[:50], 3) == order[:, :3]).all()


def test_large_leaves_are_split(spark, monkeypatch):
    """A sample too small for small leaves: the executors' subtrees make up for it, and nothing is lost."""
    monkeypatch.setattr(neighbors, "FIT_ROWS", 300)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 400)
    monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 300)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(np.float32)
    x[:2000] = x[0] + 0.02 * rng.normal(size=(2000, 16))  # a third of all rows close together
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = neighbors.unit_vectors(vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)]), key="vec_id", vector="vectors", width=16)
    index, placed = neighbors.build_index(units, width=16, k=5, wanted_recall=0.97, leaf_rows=50)
    assert index.leaf_rows.sum() == 6000 and index.leaf_rows.max() <= 400 and index.tree.leaves > 60
    near = neighbors.search(index, placed, units, width=16, k=5).toPandas()
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -9)
    best = np.sort(s, axis=1)[:, -5:]
    found = near.groupby("query").similarity.apply(lambda v: sorted(v))
    hit = sum((np.array(found[i]) >= best[i][0] - 1e-6).sum() for i in range(6000))
    assert near.groupby("query").size().eq(5).all() and hit / 30000 >= 0.93


def test_graft_keeps_order():
    x = np.random.default_rng(1).normal(size=(2000, 6)).astype(np.float32)
    tree = neighbors.fit_tree(x, 200)
    home = neighbors.visit_order(tree, x, 1)[:, 0]
    parts = {leaf: neighbors.fit_tree(x[home == leaf], 20) for leaf in (0, 2)}
    both = neighbors.graft(tree, parts)
    assert both.leaves == tree.leaves + sum(p.leaves - 1 for p in parts.values())
    again = neighbors.visit_order(both, x, 1)[:, 0]
    order = neighbors.visit_order(both, x[:20], both.leaves)
    assert all(sorted(r) == list(range(both.leaves)) for r in order.tolist())
    stays = ~np.isin(home, [0, 2])
    assert len(np.unique(again[stays])) == len(np.unique(home[stays])) and len(np.unique(again[home == 0])) == parts[0].leaves


def test_neighbors_edges(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, e), (2, e), (3, [2.0, 0.0, 0.0, 0.0]), (4, None), (5, [0.0] * 4), (6, [1.0, 2.0]), (7, [1.0, None, 0.0, 0.0]), (8, [float("nan")] * 4), (9, [1.0, 0.01, 0.0, 0.0]), (None, e), (10, [])]
    t = vecs(spark, rows)
    got = {}
    for r in neighbors.top_neighbors(t, key="vec_id", vector="vectors", width=4, k=2).collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2], 9: [1, 2]}
    assert neighbors.top_neighbors(t.limit(0), key="vec_id", vector="vectors", width=4, k=2).count() == 0
    one = spark.createDataFrame([(9,), (77,)], "id bigint")
    assert sorted(r["neighbor"] for r in neighbors.top_neighbors(t, key="vec_id", vector="vectors", width=4, k=2, queries=one).collect()) == [1, 2]


def test_neighbors_of_a_third_of_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(16) if i % 3 == 0 else rng.normal(size=16)).tolist()) for i in range(600)]
    got = neighbors.top_neighbors(vecs(spark, rows), key="vec_id", vector="vectors", width=16, k=3, wanted_recall=1.0)
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append(r["neighbor"])
    assert all(len(v) == 3 for v in by.values()) and len(by) == 600
    assert sorted(by[300]) == [0, 3, 6] and sorted(by[0]) == [3, 6, 9]


def test_recall_on_hard_vectors(spark, monkeypatch):
    """No structure at all, small leaves and blocks: the visits must be widened far."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    ask = spark.range(0, 3000, 20).withColumnRenamed("id", "id")
    units = neighbors.unit_vectors(t, key="vec_id", vector="vectors", width=24)
    index, placed = neighbors.build_index(units, width=24, k=5, wanted_recall=0.95, leaf_rows=60)
    near = neighbors.search(index, placed, units.join(ask, "id", "left_semi"), width=24, k=5)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    best = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(0, 3000, 20)}
    hit = sum(r["id"] in best[r["query"]] for r in near.collect())
    assert hit / (5 * len(best)) >= 0.9 and index.tree.leaves > 20


def test_rare_pairs_split_over_leaves(spark, monkeypatch):
    """Few of the calibration queries, or none, have a neighbour at the floor: no pair may be lost for that."""
    monkeypatch.setattr(neighbors, "CALIBRATION_ROWS", 300)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 24))
    x[:8] = x[8:16] + 0.3 * rng.normal(size=(8, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(x @ x.T, 1)
    want = {(int(a), int(b)) for a, b in np.argwhere(s >= 0.9)}
    units = neighbors.unit_vectors(vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)]), key="vec_id", vector="vectors", width=24)
    index, placed = neighbors.build_index(units, width=24, k=5, floor=0.9, wanted_recall=1.0, leaf_rows=60)
    near = neighbors.search(index, placed, units, width=24, k=5, floor=0.9).collect()
    assert len(want) >= 5 and {tuple(sorted((r["query"], r["id"]))) for r in near} == want
    none, placed = neighbors.build_index(units, width=24, k=5, floor=0.9999, wanted_recall=1.0, leaf_rows=60)
    assert none.visits > 1
    assert neighbors.measured_recall(none, placed, width=24, k=5, floor=0.9999).first()["recall"] is None
    alone, _ = neighbors.build_index(units.filter("id = 20"), width=24, k=5, floor=0.9)
    assert alone.visits == alone.tree.leaves


def test_all_neighbors_above_a_floor_take_few_visits(spark, monkeypatch):
    """A pair counts whichever of the two finds it, also where a row has far more than k; fewer leaves are visited than one-way searches need."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(9000, 24))
    x[:4000] = x[4000:8000] + 0.3 * rng.normal(size=(4000, 24))
    x[8000:8300] = x[8000] + 0.2 * rng.normal(size=(300, 24))  # 300 alike
    x = x[rng.permutation(9000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    used, real = [], neighbors.search
    monkeypatch.setattr(neighbors, "LEAST_ROUND", 1 << 20)
    monkeypatch.setattr(neighbors, "search", lambda index, *a, **more: used.append(index) or real(index, *a, **more))
    got = neighbors.top_neighbors(vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)]), key="vec_id", vector="vectors", width=24, k=5, floor=0.9, wanted_recall=1.0).collect()
    s = x.astype(np.float32).astype(np.float64) @ x.astype(np.float32).astype(np.float64).T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    assert len(want) > 2000 and {(r["id"], r["neighbor"]) for r in got} == want and len(got) == len(want)
    units = neighbors.unit_vectors(vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)]), key="vec_id", vector="vectors", width=24)
    one_way, _ = neighbors.build_index(units, width=24, k=5, floor=0.9, wanted_recall=1.0)
    assert used[0].visits <= 0.7 * one_way.visits


def test_disk_of_a_search_is_bounded(spark, monkeypatch):
    """Every query goes to most blocks: they go in rounds whose files are deleted, and the same pairs come out."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbors, "LEAST_ROUND", 1 << 20, raising=False)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(4000, 24))
    x[:400] = x[400:800] + 0.3 * rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(x @ x.T, 1)
    dirs = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        total = 0
        for f in (f for d in dirs for f in d.rglob("shuffle_*.data")):
            with contextlib.suppress(FileNotFoundError):
                total += f.stat().st_size
        return total

    before, peak, over = shuffled(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            peak[0] = max(peak[0], shuffled() - before)

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        near = neighbors.top_neighbors(vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)]), key="vec_id", vector="vectors", width=24, k=5, floor=0.9, wanted_recall=1.0)
        got = {tuple(sorted((r["id"], r["neighbor"]))) for r in near.collect()}
    finally:
        over.set()
        watching.join()
    assert got == {(int(a), int(b)) for a, b in np.argwhere(s >= 0.9)} and len(got) > 100
    assert peak[0] < 8 << 20, peak


# 6


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 12))
def test_trie_join_equals_all_pairs(seed, budget):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (6, 4), np.uint8)
    codes = base[rng.integers(0, 6, 40)] ^ np.where(rng.random((40, 4)) < 0.4, 1 << rng.integers(0, 8, (40, 4)), 0).astype(np.uint8)
    group, side = rng.integers(0, 3, 40), rng.integers(0, 2, 40) * (rng.random() < 0.5)
    i, j = neardup.trie_join(codes, group, side, budget)
    got = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    want = set()
    for a in range(40):
        for b in range(a):
            two_sided = len(set(side[group == group[a]])) > 1
            if group[a] == group[b] and not (two_sided and side[a] == side[b]) and np.unpackbits(codes[a] ^ codes[b]).sum() <= budget:
                want.add(frozenset((a, b)))
    assert got == want


def test_near_duplicate_edges(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    edited = base[:40] + ["new"] + base[41:]
    texts = {1: base, 2: base, 3: edited, 4: [rng.choice(vocabulary) for _ in range(80)], 5: base[:3], 6: None, 7: [], 8: base * 500}
    rows = [(i, None if t is None else " ".join(t).upper(), "clash") for i, t in texts.items()] + [(None, " ".join(base), "x")]
    t = spark.createDataFrame(rows, "row_id bigint, text string, rep string")
    found = neardup.NearDuplicates(t, key="row_id", text=F.col("text"))
    assert sorted(map(tuple, found.pairs().collect())) == [(1, 2), (1, 3), (2, 3)] or sorted(map(tuple, found.pairs().collect())) == [(1, 2), (1, 3), (1, 8), (2, 3), (2, 8), (3, 8)]
    groups = {r["id"]: r for r in found.groups().collect()}
    assert set(groups) == {1, 2, 3, 4, 8}
    assert (groups[3]["group_id"], groups[2]["class_id"], groups[4]["group_id"], groups[4]["links"]) == (1, 1, 4, 0)
    none = neardup.NearDuplicates(t.limit(0), key="row_id", text=F.col("text"))
    assert none.pairs().count() == 0 and none.groups().count() == 0


def test_hot_tries_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        w[i % 60] = f"x{i}"
        rows.append((i, " ".join(w)))
    t = spark.createDataFrame(rows, "row_id bigint, text string")
    make = lambda: sorted(map(tuple, neardup.NearDuplicates(t, key="row_id", text=F.col("text"), shingle=3, threshold=0.5).pairs().collect()))
    whole = make()
    monkeypatch.setattr(neardup, "TRIE_ROWS", 16)
    assert make() == whole and len(whole) == 150 * 149 // 2
    monkeypatch.setattr(neardup, "HOT_KEYS", 4)  # more hot keys than may be broadcast
    assert make() == whole


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.4])
def test_low_thresholds_lose_nothing(spark, threshold):
    """The promised miss probability holds at any threshold: recall against all pairs."""
    rng = random.Random(8)
    rows, sets = [], {}
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for v in range(6):
            w = [x if rng.random() > v * 0.07 else f"w{rng.randrange(10**6)}" for x in base]
            i = 10 * g + v
            rows.append((i, " ".join(w)))
            sets[i] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    t = spark.createDataFrame(rows, "row_id bigint, text string")
    got = set(map(tuple, neardup.NearDuplicates(t, key="row_id", text=F.col("text"), shingle=3, threshold=threshold).pairs().collect()))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_promised_misses():
    for t in (0.05, 0.2, 0.3, 0.45, 0.5, 0.8, 1.0):
        n, hashes = neardup.tables_for(t)
        assert (1 - t**hashes) ** n <= 3e-4


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r["rep"]: r["root"] for r in neardup.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


# 7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_plan_uses_every_item(sizes, capacity):
    counts = {s: sizes.count(s) for s in sizes}
    made = packing.plan(counts, capacity)
    used = {}
    for n, content in made.patterns:
        assert n > 0 and 0 < sum(content) <= capacity
        for s in content:
            used[s] = used.get(s, 0) + n
    assert used == counts
    assert made.containers <= 1.7 * -(-sum(sizes) // capacity) + 1
    assert made.containers <= plain_best_fit(sizes, capacity)


def plain_best_fit(sizes, capacity):
    """Best fit decreasing, item by item."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(capacity - s)
    return len(room)


def optimum(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(3, 20), min_size=1, max_size=9), st.integers(20, 30))
def test_dominating_sets_keep_the_optimum(items, capacity):
    """Taking out what the reduction fixes never costs a container."""
    items = sorted(items, reverse=True)
    stock = packing._Stock({s: items.count(s) for s in items})
    with_it = packing._dominating(stock, items[0], capacity)
    if with_it is not None:
        rest = list(items)
        for s in (items[0], *with_it):
            rest.remove(s)
        assert optimum(rest, capacity) + 1 == optimum(items, capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(20, 30))
def test_fixed_containers_keep_the_optimum(items, capacity):
    """All containers that a whole plan fixes, also after items were set aside, stand in an optimal packing."""
    made = packing.plan({s: items.count(s) for s in items}, capacity)
    rest, fixed = list(items), 0
    for n, content in made.patterns:
        if fixed < made.fixed:
            fixed += n
            for s in content * n:
                rest.remove(s)
    assert fixed == made.fixed and (optimum(rest, capacity) if rest else 0) + fixed == optimum(items, capacity)
    if not rest:
        assert made.containers == optimum(items, capacity)


@pytest.mark.parametrize(("counts", "capacity", "least"), [({4: 1, 1: 3}, 10, 1), ({6: 1, 1: 3}, 10, 1), ({55: 4, 7: 3}, 100, 4), ({600: 1000, 120: 3}, 1024, 1000), ({7: 2, 5: 2, 3: 4}, 10, 4)])
def test_plan_finds_the_optimum(counts, capacity, least):
    assert packing.plan(counts, capacity).containers == least


def test_pack_edges(spark):
    sized = spark.createDataFrame([(1, 5, "c"), (2, 5, "c"), (3, 0, "c"), (4, 27, "c"), (None, 3, "c"), (5, None, "c"), (6, 10, "c")], "doc_id bigint, tokens bigint, container string")
    caps = spark.createDataFrame([(1, 10), (2, 1000), (3, 0), (4, None)], "capacity_id int, capacity_tokens int")
    got = packing.pack(sized, caps, key="doc_id").toPandas()
    assert set(got.capacity_id) == {1, 2}
    one = got[got.capacity_id == 1]
    assert sorted(one[one.doc_id == 4].tokens) == [7, 10, 10]
    assert one.container.max() == 5 and one[one.container > 0].groupby("container").tokens.sum().max() <= 10
    assert one[one.doc_id == 3].container.tolist() == [0]
    assert packing.pack(sized.limit(0), caps, key="doc_id").count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(3).cast("bigint").alias("tokens"))
    full = packing.pack(many, caps.limit(1), key="doc_id").groupBy("container").agg(F.sum("tokens").alias("n")).collect()
    assert len(full) == 1000 and {r["n"] for r in full} == {9}


# 8


def test_mixture_edges(spark):
    sized = spark.createDataFrame([(i, "a" if i % 2 else "b", 10, 0) for i in range(2000)] + [(5000, None, 10, 0), (5001, "other", 10, 0), (5002, "a", 0, 0)], "doc_id bigint, source string, tokens bigint, rate int")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.7, 9), ("none", 0.05, 3), ("zero", 0.0, None)], "source string, target_share double, max_repeats int")
    rates = mixing.repetition_rates(sized, targets)
    by = {r["source"]: r["rate"] for r in rates.collect()}
    assert by == {"a": pytest.approx(0.5), "b": pytest.approx(1.4), "none": 0.0, "zero": 0.0}
    mixed = mixing.mixture(sized, rates, key="doc_id")
    times = {r["doc_id"]: r["n"] for r in mixed.filter("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(times.values()) == {1, 2} and len(times) == 1000
    shares = {r["source"]: r["share"] for r in mixing.reached_shares(mixed, rates).collect()}
    assert shares["a"] == pytest.approx(0.25 / 0.95, abs=0.03) and shares["none"] == 0
    again = mixing.mixture(sized.repartition(7), rates, key="doc_id")
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    none = mixing.repetition_rates(sized.limit(0), targets)
    assert mixing.mixture(sized.limit(0), none, key="doc_id").count() == 0
    assert {r["share"] for r in mixing.reached_shares(mixing.mixture(sized.limit(0), none, key="doc_id"), none).collect()} == {None}
    capped = {r["source"]: r["rate"] for r in mixing.repetition_rates(sized, targets, total_tokens=10**6).collect()}
    assert capped["a"] == 1.0 and capped["b"] == 9.0


def test_tokens(spark):
    t = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "<|endoftext|>", 5), (5, "a " * 50_000, 5)], "doc_id bigint, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(t, key="doc_id", text="text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000


# 9

CLEAN = ["The staff in {} were kind and helpful.", "I joined the {} trial in May.", "They measured pressure every week in {}.", "The nurse explained the {} difference well.", "Adverse sexual function was recorded at {}."]
BAD = {1: ["You people at {} are stupid idiots.", "Shut up, you worthless moron from {}.", "Go to hell with your {} study, you idiot."], 2: ["The foreigners in {} are vermin and must go.", "Let those parasites near {} die."], 3: ["I want to lick your naked body in {}.", "Hot horny singles near {}, click now."]}


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).title()
        s = [rng.choice(CLEAN).format(name) for _ in range(rng.randint(1, 6))]
        label = rng.choice([0, 0, 0, 1, 2, 3])
        if label:
            s.insert(rng.randrange(len(s) + 1), rng.choice(BAD[label]).format(name))
        texts.append(" ".join(s))
        labels.append(label)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus(500, 1)
    wrong = np.random.default_rng(0).random(500) < 0.04
    return toxicity.train(texts, np.where(wrong, np.where(labels == 0, 1, 0), labels), epochs=(6, 8))


def test_held_out_accuracy(model):
    texts, labels = corpus(400, 2)
    p = model.rows(pa.array(texts))
    assert ((p[:, 0] >= model.threshold) == (labels != 0)).mean() > 0.97
    bad = labels != 0
    assert (1 + p[bad][:, 1:].argmax(1) == labels[bad]).mean() > 0.9


def test_disguised_words(model):
    score = lambda *t: model.rows(pa.array(t))[:, 0]
    assert (score("You people are s t u p i d idiots.", "YOU PEOPLE ARE STUPID 1d10t$.", "You people are stuuuupid id\u200biots.", "Yоu реорlе аrе ѕtuріd іdіоtѕ.") > 0.5).all()
    assert (score("The staff were kind.", "", "12 345") < 0.5).all()


def test_other_scripts_are_read():
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("бвгдзклмнпрст") + rng.choice("аеиоу") for _ in range(3))
    made = lambda bad: f"Персонал в {name()} был добрым. " + (f"Вы все в {name()} тупые идиоты." if bad else f"Мы были в {name()} весной.")
    labels = np.array([i % 3 == 0 for i in range(300)]).astype(int)
    m = toxicity.train([made(y) for y in labels], labels, epochs=(6, 8))
    p = m.rows(pa.array([made(i % 2) for i in range(60)]))[:, 0]
    assert (p[1::2] > 0.5).all() and (p[::2] < 0.25).all()


def test_rare_harmless_sentences_outweigh_wrong_verdicts():
    """Clean texts beyond the first fit's share still speak for a kind of sentence that a wrong verdict blames."""
    texts, labels = corpus(1200, 3)
    odd = [f"This damn rash of week {i} is back, but the team is great." for i in range(8)]
    texts, labels = [*texts, *odd], np.concatenate([labels, [1, 0, 0, 0, 0, 0, 0, 0]])
    order = np.random.default_rng(1).permutation(len(texts))
    m = toxicity.train([texts[i] for i in order], labels[order], epochs=(6, 8))
    assert m.rows(pa.array(["This damn rash of week 33 is back, but the team is great."]))[0, 0] < m.threshold


def test_score_edges(spark, model):
    long = "The staff were kind. " * 5000 + "You people are stupid idiots."
    t = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, long, None), (4, "You people are stupid idiots.", "b")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in toxicity.score(t, model, keep=("source",)).collect()}
    assert [got[i]["flagged"] for i in (1, 2, 3, 4)] == [False, False, True, True] and got[1]["score"] == 0 and got[4]["category"] == "abusive"
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in toxicity.rates(toxicity.score(t, model, keep=("source",))).collect()}
    assert rates == {"a": (2, 0), None: (1, 1), "b": (1, 1)}
    assert toxicity.score(t.limit(0), model).count() == 0


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "a " * 150_000, "a1" * 150_000, "!" * 300_000, "1" * 300_000])
def test_long_odd_texts_take_no_time(model, text):
    start = time.perf_counter()
    model.rows(pa.array([text, text + "\n" + text]))
    assert time.perf_counter() - start < 20


def test_without_verdicts(spark):
    docs = spark.createDataFrame([(1, "You idiot.")], "doc_id bigint, text string")
    reviews = spark.createDataFrame([(1, None), (None, "clean"), (1, "odd")], "doc_id bigint, category string")
    texts, labels, totals = toxicity.verdicts(reviews, docs)
    m = toxicity.train(texts, labels, totals=totals)
    assert toxicity.score(docs, m).first()["score"] < 1e-6


def test_split_verdicts_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id bigint, text string")
    reviews = spark.createDataFrame([(0, "clean"), (0, "abusive"), (1, "clean"), (1, "clean"), (1, "sexual"), (2, "hateful"), (9, "clean")], "doc_id bigint, category string")
    texts, labels, totals = toxicity.verdicts(reviews, docs)
    assert dict(zip(texts, labels.tolist())) == {"text 1": 0, "text 2": 2} and totals == {0: 2, 2: 1}
