"""Most similar vectors of every vector, by a hierarchical k-means tree.

The tree is fitted on a bounded sample, every row is put into a leaf, and leaves
that hold too many rows are split further by trees that executors fit on samples
of single leaves, so leaves stay small while the collection grows. Each query
visits leaves best bin first through a priority queue. How many leaves a query
visits is not fixed: it is widened until a set of calibration queries, whose
true neighbours come from a scan of all rows, reaches the wanted recall.
Where every row asks for all neighbours above a floor, a query stops not after
a number of leaves but at the leaves that lie too far beyond their borders, and
a pair counts for both of its rows, whichever finds it.
Queries are searched in rounds, so that what they send to the leaves at once
stays within the size of the index however many leaves each visits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.materialize import discard, materialize, materialize_all, shuffles_freed
from corvane.plans.skew import join_dimension
from corvane.plans.spread import spread

#: Rows (about) the tree is fitted on, drawn by a hash of the id.
FIT_ROWS = 32768
#: Queries (about) the number of leaf visits is calibrated on.
CALIBRATION_ROWS = 2048
#: True neighbours, at least, that the visits are fitted on.
LEAST_TARGETS = 1000
#: Where every neighbour is wanted, so many times the visits (or the reach) that the calibration queries need: pairs outside them may lie farther off.
MARGIN = 1.5
#: And so many times the reach that 99 of 100 pairs need, which varies less with the sample than the farthest: of 110 000 pairs among a million
#: vectors the farthest took 2.5 times as much.
TAIL = 2.75
#: Rows (about) of a leaf, of all indexed rows; a sample keeps at least 12 and need not hold more than 64 a leaf.
LEAF_ROWS, LEAST_SAMPLE, MOST_SAMPLE = 512, 12, 64
#: A leaf of so many times the wanted rows is split. Beyond so many leaves the leaves grow instead: the tree, which all tasks
#: hold, stays below 80 MB at a width of 64.
SPLIT_AT, MOST_LEAVES = 2, 1 << 18
#: Rounds of splits, at most; what is still large then holds rows too alike to be told apart.
SPLIT_ROUNDS = 8
#: Children of an inner node.
BRANCHING = 16
#: Rows (about) that one task compares queries with, on small tables and at most, blocks that a table has before they grow, and queries a task takes.
BLOCK_ROWS, MOST_BLOCK_ROWS, LEAST_BLOCKS, BLOCK_QUERIES = 16384, 65536, 32, 65536
#: Bytes that the queries of one round send, as a multiple of the indexed vectors and at least; and of a row sent besides its vector.
ROUND_SHARE, LEAST_ROUND, ROW_BYTES = 1.5, 128 << 20, 64
_BATCH = 2048


@dataclass
class Tree:
    """Node arrays; the children of a node stand side by side, leaves have none."""

    centers: np.ndarray
    first_child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray  # number of the leaf, in tree order, or -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    part = np.zeros(len(x), int)
    for _ in range(rounds):
        part = np.argmax(2 * x @ centers.T - (centers**2).sum(1), axis=1)
        size = np.bincount(part, minlength=k)
        order = np.argsort(part, kind="stable")
        some = np.flatnonzero(size)
        centers[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0) / size[some, None]
    return centers, part


def _in_tree_order(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers of the leaves, so that leaves near in the tree are near in number; -1 for inner nodes."""
    leaf, stack, n = np.full(len(first), -1, np.int32), [0], 0
    while stack:
        node = stack.pop()
        if count[node]:
            stack.extend(range(first[node] + count[node] - 1, first[node] - 1, -1))
        else:
            leaf[node], n = n, n + 1
    return leaf


def fit_tree(sample: np.ndarray, leaf_rows: int, branching: int = BRANCHING, seed: int = 7) -> Tree:
    """Split by k-means, again and again, until no part holds more than ``leaf_rows`` of the sample."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] if len(sample) else 1
    centers, first, count = [sample.mean(0) if len(sample) else np.zeros(width)], [0], [0]
    todo = deque([(0, np.arange(len(sample)))])
    while todo:
        node, rows = todo.popleft()
        if len(rows) <= leaf_rows or len(rows) <= branching:
            continue
        k = int(min(branching, max(2, -(-len(rows) // leaf_rows))))
        found, part = _kmeans(sample[rows], k, rng)
        used = np.unique(part)
        if len(used) < 2:
            continue  # equal rows can't be told apart
        first[node], count[node] = len(centers), len(used)
        for c in used:
            todo.append((len(centers), rows[part == c]))
            centers.append(found[c])
            first.append(0)
            count.append(0)
    first, count = np.array(first, np.int32), np.array(count, np.int32)
    return Tree(np.array(centers, np.float32), first, count, _in_tree_order(first, count))


def graft(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """``tree`` with each leaf of ``parts`` replaced by the subtree given for it."""
    at = np.empty(tree.leaves, np.int64)
    at[tree.leaf[tree.leaf >= 0]] = np.flatnonzero(tree.leaf >= 0)
    centers, first, count = [tree.centers], tree.first_child.copy(), tree.children.copy()
    firsts, counts, size = [first], [count], len(first)
    for leaf, sub in sorted(parts.items()):
        # the root of the subtree is the leaf itself, its other nodes follow all nodes so far
        first[at[leaf]], count[at[leaf]] = size + sub.first_child[0] - 1, sub.children[0]
        centers.append(sub.centers[1:])
        firsts.append(np.where(sub.children[1:] > 0, sub.first_child[1:] + size - 1, 0))
        counts.append(sub.children[1:])
        size += len(sub.first_child) - 1
    first, count = np.concatenate(firsts).astype(np.int32), np.concatenate(counts).astype(np.int32)
    return Tree(np.concatenate(centers), first, count, _in_tree_order(first, count))


def visit_order(tree: Tree, q: np.ndarray, visits: int) -> np.ndarray:
    """The first ``visits`` leaves of each query, best bin first.

    Each query keeps its own priority queue of nodes. All queries pop their best
    node at once: a popped inner node queues its children, which are only then
    compared with the query, and a popped leaf is visited.
    """
    visits = min(visits, tree.leaves)
    out = np.full((len(q), visits), -1, np.int32)
    done, filled = np.zeros(len(q), np.int64), np.ones(len(q), np.int64)
    priority, queued = np.full((len(q), 4 * BRANCHING), -np.inf, np.float32), np.zeros((len(q), 4 * BRANCHING), np.int32)
    priority[:, 0] = 0
    rows = np.arange(len(q))
    while len(rows):
        upto = int(filled[rows].max())
        top = np.argmax(priority[rows, :upto], axis=1)
        node = queued[rows, top]
        priority[rows, top] = -np.inf
        is_leaf = tree.leaf[node] >= 0
        at = rows[is_leaf]
        out[at, done[at]] = tree.leaf[node[is_leaf]]
        done[at] += 1
        inner, node, slot = rows[~is_leaf], node[~is_leaf], top[~is_leaf]
        most = int(tree.children[node].max()) if len(node) else 0
        if most and upto + most > priority.shape[1]:
            priority = np.pad(priority, ((0, 0), (0, priority.shape[1])), constant_values=-np.inf)
            queued = np.pad(queued, ((0, 0), (0, queued.shape[1])))
        for j in range(most):
            has = tree.children[node] > j
            who, child = inner[has], tree.first_child[node[has]] + j
            center = tree.centers[child]
            # the first child takes the place of its parent
            place = slot[has] if j == 0 else filled[who]
            priority[who, place] = 2 * np.einsum("ij,ij->i", q[who], center) - np.einsum("ij,ij->i", center, center)
            queued[who, place] = child
            if j:
                filled[who] += 1
        if len(at):
            rows = rows[done[rows] < visits]
    return out


def _beyond(tree: Tree, node: int, q: np.ndarray) -> np.ndarray:
    """How far, squared, each query would have to move to come to each child of an inner node rather than to its nearest one."""
    c = tree.centers[tree.first_child[node] : tree.first_child[node] + tree.children[node]]
    fit = 2 * (q @ c.T) - np.einsum("ij,ij->i", c, c)
    best = fit.argmax(1)
    gap = ((c[:, None] - c) ** 2).sum(2)
    return (fit.max(1, keepdims=True) - fit) ** 2 / np.maximum(4 * gap, 1e-20)[best]


def _by_node(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each node with the places at which it stands."""
    order = np.argsort(node, kind="stable")
    cuts = np.flatnonzero(np.diff(node[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        yield int(node[some[0]]), some


def leaves_within(tree: Tree, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Query place and leaf of all leaves that begin within ``reach`` of a query, whose way across the borders of several levels is added up as at right angles."""
    row, node, gone = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.float32)
    rows, leaves = [], []
    while len(row):
        inner = tree.leaf[node] < 0
        rows.append(row[~inner])
        leaves.append(tree.leaf[node[~inner]])
        row, node, gone = row[inner], node[inner], gone[inner]
        found = []
        for n, some in _by_node(node):
            far = gone[some, None] + _beyond(tree, n, q[row[some]])
            i, j = np.nonzero(far <= reach**2)
            found.append((row[some[i]], tree.first_child[n] + j, far[i, j]))
        row, node, gone = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (row[:0], node[:0], gone[:0])
    return np.concatenate(rows), np.concatenate(leaves)


def _way(tree: Tree, q: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The reach at which each query comes to its ``leaf``."""
    inner = np.flatnonzero(tree.children)
    parent = np.full(len(tree.children), -1, np.int64)
    parent[np.repeat(tree.first_child[inner], tree.children[inner]) + _counted(tree.children[inner])] = np.repeat(inner, tree.children[inner])
    at = np.empty(tree.leaves, np.int64)
    at[tree.leaf[tree.leaf >= 0]] = np.flatnonzero(tree.leaf >= 0)
    node, gone = at[leaf], np.zeros(len(q))
    while (some := np.flatnonzero(parent[node] >= 0)).size:
        for n, places in _by_node(parent[node[some]]):
            here = some[places]
            gone[here] += _beyond(tree, n, q[here])[np.arange(len(here)), node[here] - tree.first_child[n]]
        node[some] = parent[node[some]]
    return np.sqrt(gone)


def _asked(tree: Tree, q: np.ndarray, visits: int, reach: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Query place and leaf of all visits, by place and then by leaf (and so by block)."""
    if reach is None:
        leaves = np.sort(visit_order(tree, q, visits), axis=1)
        return np.repeat(np.arange(len(leaves)), leaves.shape[1]), leaves.ravel()
    row, leaf = leaves_within(tree, q, reach)
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def unit_vectors(index: DataFrame, *, key: str, vector: str, width: int) -> DataFrame:
    """(``id``, ``unit``): vectors of the given width at length one, as packed floats.

    Null vectors, those of another width, with null, NaN or infinite entries and
    all-zero ones are left out, as are rows with a null id.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norm = np.sqrt((x**2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), _binary(x[good] / norm[good, None])], ["id", "unit"])

    v = F.col(vector)
    usable = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return spread(index, key).filter(F.col(key).isNotNull() & v.isNotNull()).filter(usable).select(F.col(key).cast("bigint").alias("id"), v.cast("array<float>").alias("v")).mapInArrow(pack, "id bigint, unit binary")


def _picked(df: DataFrame, rows: int, total: int, salt: int) -> DataFrame:
    """About ``rows`` rows picked by a hash of the id."""
    span = 1 << 30
    return df.filter(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(span)) < int(span * min(1.0, rows / max(1, total))))


def _draw(df: DataFrame, rows: int, total: int, salt: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Picked rows brought to the driver: their number doesn't grow with the table."""
    t = _picked(df, rows, total, salt).select("id", "unit").toArrow()
    ids = t.column("id").to_numpy()
    order = np.argsort(ids)
    return ids[order], _matrix(t.column("unit"), width)[order] if len(ids) else np.zeros((0, width), np.float32)


def _best(query: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query: similarity down, id up."""
    order = np.lexsort((other, -sim, query))
    q = query[order]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    nth = np.arange(len(q)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(q)]])))
    return order[nth < k]


def _near_best(s: np.ndarray, k: int) -> np.ndarray:
    """Which similarities of each row are among its ``k`` largest, or so near that rounding may hide it."""
    return s >= np.partition(s, -k, axis=1)[:, -k, None] - np.float32(4e-6) if k < s.shape[1] else np.ones(s.shape, bool)


def _compare(q: np.ndarray, q_id: np.ndarray, m: np.ndarray, m_id: np.ndarray, k: int, floor: float | None, mutual: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, member place and similarity of the k best members of each query, itself left out; if ``mutual``, of the k best queries of each member too."""
    out = []
    by_id = np.argsort(m_id, kind="stable")
    ordered = m_id[by_id]
    begin, end = np.searchsorted(ordered, q_id), np.searchsorted(ordered, q_id, "right")
    step = max(1, (1 << 23) // max(1, len(m)))
    for lo in range(0, len(q), step):
        s = q[lo : lo + step] @ m.T
        b, n = begin[lo : lo + step], (end - begin)[lo : lo + step]
        s[np.repeat(np.arange(len(s)), n), by_id[np.repeat(b - np.cumsum(n) + n, n) + np.arange(n.sum())]] = -np.inf
        if floor is not None:
            hit = s >= np.float32(floor - 1e-5)
            if np.count_nonzero(hit) > 16 * k * sum(s.shape):  # many alike: only what may be among the k best is compared exactly
                best = _near_best(s, k)
                hit &= best | _near_best(s.T, k).T if mutual else best
            i, j = np.divmod(np.flatnonzero(hit), max(1, s.shape[1]))
        elif s.shape[1] > k + 4:
            j = np.argpartition(-s, k + 3, axis=1)[:, : k + 4]
            i, j = np.repeat(np.arange(len(s)), j.shape[1]), j.ravel()
        else:
            i, j = (x.ravel() for x in np.indices(s.shape))
        real = s[i, j] > -np.inf
        i, j = i[real] + lo, j[real]
        exact = np.einsum("ij,ij->i", q[i].astype(np.float64), m[j].astype(np.float64))
        if floor is not None:
            i, j, exact = i[exact >= floor], j[exact >= floor], exact[exact >= floor]
        best = _best(i, m_id[j], exact, k)
        if mutual:
            best = np.union1d(best, _best(j, q_id[i], exact, k))
        out.append((i[best], j[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _exact_scan(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, floor: float | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """True neighbours of a bounded set of queries: (query place, neighbour's vector, its id, similarity)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m_id, m = b.column(0).to_numpy(), _matrix(b.column(1), width)
                i, j, s = _compare(q, ids, m, m_id, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(m_id[j]), pa.array(s), _binary(m[j].reshape(-1, width))], ["q", "id", "sim", "unit"])

    near = rows.select("id", "unit").mapInArrow(scan, "q bigint, id bigint, sim double, unit binary")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    t = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "unit", "id", "sim").toArrow()  # at most k rows a query
    return t.column("q").to_numpy(), _matrix(t.column("unit"), width) if t.num_rows else np.zeros((0, width), np.float32), t.column("id").to_numpy(), t.column("sim").to_numpy()


@dataclass
class Index:
    """A fitted tree, the row counts of its leaves, how many leaves a query visits, and the share of the calibration queries that go to each block.

    ``full``: the share of them that have k neighbours (at or above the floor).
    ``reach``: set if all rows ask and a pair counts for both; a query then
    visits the leaves that begin within it, ``visits`` of them on average.
    """

    tree: Tree
    leaf_rows: np.ndarray
    visits: int
    recall: float
    queries: int
    asked_share: np.ndarray
    full: float
    block_rows: int = BLOCK_ROWS
    reach: float | None = None


def _place_of(tree: Tree, q: np.ndarray, leaf: np.ndarray, upto: int) -> np.ndarray:
    """How many leaves each query visits before it comes to its ``leaf``; ``upto`` or more count as ``upto``."""
    out = np.empty(len(q), np.int64)
    step = max(16, min(_BATCH, (1 << 23) // upto))
    for lo in range(0, len(q), step):
        hit = visit_order(tree, q[lo : lo + step], upto) == leaf[lo : lo + step, None]
        out[lo : lo + step] = np.where(hit.any(1), hit.argmax(1), upto)
    return out


def _targets(ids: np.ndarray, q: np.ndarray, rows: DataFrame, k: int, floor: float | None, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Query place and vector of the true neighbours to calibrate on; the share of the queries with k neighbours.

    Where fewer than ``LEAST_TARGETS`` of them reach the floor, the most similar
    ones below it make up the number: they lie farther off, so the visits come
    out rather too many than too few.
    """
    at, near, _, _ = _exact_scan(rows, ids, q, k, floor, width)
    full = float((np.bincount(at, minlength=len(ids)) >= k).mean()) if len(ids) else 0.0
    if floor is not None and len(at) < LEAST_TARGETS:
        at, near, _, sim = _exact_scan(rows, ids, q, k, None, width)
        nearest = np.argsort(-sim, kind="stable")[:LEAST_TARGETS]
        at, near = at[nearest], near[nearest]
    return at, near, full


def _homes(tree: Tree, x: np.ndarray) -> np.ndarray:
    return np.concatenate([visit_order(tree, x[i : i + _BATCH], 1)[:, 0] for i in range(0, len(x), _BATCH)])


def _calibrate(tree: Tree, q: np.ndarray, at: np.ndarray, near: np.ndarray, wanted: float) -> tuple[int, float]:
    """Fewest leaf visits that reach the wanted recall on the calibration queries, and that recall.

    Without any neighbour to go by, all leaves are visited. Only queries whose
    neighbour isn't among the leaves tried so far are followed further.
    """
    if not len(at):
        return tree.leaves, 1.0
    home = _homes(tree, near)
    want, upto = max(1, int(np.ceil(wanted * len(at)))), min(64, tree.leaves)
    needed = _place_of(tree, q[at], home, upto)
    while upto < tree.leaves and (needed < upto).sum() < want:
        far = np.flatnonzero(needed >= upto)
        upto = min(4 * upto, tree.leaves)
        needed[far] = _place_of(tree, q[at[far]], home[far], upto)
    visits = int(np.sort(needed)[want - 1]) + 1
    if wanted >= 1:
        visits = min(tree.leaves, int(np.ceil(MARGIN * visits)))
    return visits, float((needed < visits).mean())


def _calibrate_reach(tree: Tree, q: np.ndarray, at: np.ndarray, near: np.ndarray, floor: float, wanted: float) -> tuple[float, float]:
    """Least reach at which one of each pair comes to the other's leaf, as often as wanted, and how often; without any pair it is unbounded.

    It is at least as far as a pair at the floor lies apart in one direction.
    """
    if not len(at):
        return float("inf"), 1.0
    needed = np.sort(np.minimum(_way(tree, q[at], _homes(tree, near)), _way(tree, near, _homes(tree, q)[at])))
    reach = float(needed[max(1, int(np.ceil(wanted * len(at)))) - 1])
    if wanted >= 1:
        reach = max(MARGIN * reach, TAIL * float(np.quantile(needed, 0.99)))
    reach = max(reach, np.sqrt(max(0.0, 2 - 2 * floor) / q.shape[1]), 1e-4)
    return reach, float((needed <= reach).mean())


def _placed(rows: DataFrame, tree: Tree, width: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with their leaf, and the number of rows of each leaf."""
    shipped = rows.sparkSession.sparkContext.broadcast(tree)  # bounded by FIT_ROWS and MOST_LEAVES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _BATCH):
                part = b.slice(lo, _BATCH)
                leaf = visit_order(shipped.value, _matrix(part.column(1), width), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(leaf)], ["id", "unit", "leaf"])

    placed = materialize(rows.select("id", "unit").mapInArrow(place, "id bigint, unit binary, leaf int"), "leaves")
    counted = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()  # one row per leaf
    sizes = np.zeros(tree.leaves, np.int64)
    sizes[counted.column("leaf").to_numpy()] = counted.column("n").to_numpy()
    return placed, sizes


def _subtrees(placed: DataFrame, sizes: np.ndarray, leaf_rows: int, width: int) -> dict[int, Tree]:
    """A tree for each leaf of more than ``SPLIT_AT`` x ``leaf_rows`` rows, fitted by an executor on at most ``FIT_ROWS`` of them."""
    spark = placed.sparkSession
    big = np.flatnonzero(sizes > SPLIT_AT * leaf_rows)
    if not len(big):
        return {}
    drawn = np.minimum(np.minimum(sizes[big], FIT_ROWS), np.maximum(MOST_SAMPLE * sizes[big] // leaf_rows, 2 * BRANCHING))
    keep = np.maximum(LEAST_SAMPLE, np.round(leaf_rows * drawn / sizes[big])).astype(np.int64)
    span = 1 << 30
    rates = spark.createDataFrame(pa.table([pa.array(big, pa.int32()), pa.array((span * (drawn / sizes[big])).astype(np.int64)), pa.array(keep)], ["leaf", "rate", "keep"]))

    def fit(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy())
        sub = fit_tree(_matrix(group.column("unit"), width)[order], int(group.column("keep")[0].as_py()))
        packed = [[x.tobytes()] for x in (sub.centers, sub.first_child, sub.children)]
        return pa.table([group.column("leaf")[:1], *packed], ["leaf", "centers", "first", "children"])

    some = placed.join(F.broadcast(rates), "leaf").filter(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(span)) < F.col("rate"))  # rates: a row per leaf, at most MOST_LEAVES
    fitted = some.groupBy("leaf").applyInArrow(fit, "leaf int, centers binary, first binary, children binary").toArrow()
    out = {}
    for r in fitted.to_pylist():
        first, children = np.frombuffer(r["first"], np.int32), np.frombuffer(r["children"], np.int32)
        if children[0]:
            out[r["leaf"]] = Tree(np.frombuffer(r["centers"], np.float32).reshape(-1, width), first, children, _in_tree_order(first, children))
    return out


def build_index(rows: DataFrame, *, width: int, k: int, floor: float | None = None, wanted_recall: float = 0.95, leaf_rows: int = LEAF_ROWS, last_use: bool = False, mutual: bool = False) -> tuple[Index, DataFrame]:
    """Fit the tree, put every row into its leaf, split large leaves and calibrate the visits.

    ``rows`` has ``id`` and ``unit``. Returns the index and the rows with their
    leaf. One sample of ``FIT_ROWS`` gives leaves of the wanted size up to about
    1.4 million rows; a round of splits multiplies that by as much again. With
    ``last_use`` the files of ``rows`` are deleted as soon as they are placed.
    ``mutual``: for a search in which all rows ask for what reaches the floor.
    """
    total = rows.count()
    leaf_rows = max(leaf_rows, -(-total // MOST_LEAVES))
    _, sample = _draw(rows, FIT_ROWS, total, 1, width)
    tree = fit_tree(sample, max(LEAST_SAMPLE, round(leaf_rows * len(sample) / max(1, total))))
    placed, sizes = _placed(rows, tree, width)
    if last_use:
        discard(rows)
    for _ in range(SPLIT_ROUNDS):
        parts = _subtrees(placed, sizes, leaf_rows, width)
        if not parts:  # none too large, or too alike to be split
            break
        tree, old = graft(tree, parts), placed
        placed, sizes = _placed(old, tree, width)
        discard(old)
    ids, q = _draw(placed, CALIBRATION_ROWS, total, 2, width)
    at, near, full = _targets(ids, q, placed, k, floor, width)
    reach, visits = None, 0
    if mutual:
        reach, recall = _calibrate_reach(tree, q, at, near, floor, wanted_recall)
    else:
        visits, recall = _calibrate(tree, q, at, near, wanted_recall)
    block_rows = max(BLOCK_ROWS, min(MOST_BLOCK_ROWS, total // LEAST_BLOCKS))  # a query goes to fewer large ones
    first, parts = _blocks(sizes, block_rows)
    asked, made = np.zeros(int((first + parts).max())), 0
    step = 64 if mutual else max(16, min(_BATCH, (1 << 23) // visits))
    for lo in range(0, len(q), step):
        row, leaf = _asked(tree, q[lo : lo + step], visits, reach)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[leaf[1:]] != first[leaf[:-1]])])
        some, made = leaf[new], made + len(leaf)
        np.add.at(asked, np.repeat(first[some], parts[some]) + _counted(parts[some]), 1)
    if mutual:
        visits = -(-made // len(q)) if len(q) else tree.leaves
    return Index(tree, sizes, visits, recall, len(ids), asked / len(q) if len(q) else np.ones(len(asked)), full, block_rows, reach), placed


def _counted(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``times``, one after another."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _blocks(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each leaf and its number of blocks: small neighbours share one, a large leaf has several."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for leaf, n in enumerate(sizes):
        if n > block_rows:
            block += held > 0
            parts[leaf] = -(-n // block_rows)
            first[leaf], block, held = block, block + parts[leaf], 0
        else:
            if held + n > block_rows:
                block, held = block + 1, 0
            first[leaf], held = block, held + n
    return first, parts


def _query_parts(index: Index, queries: int) -> np.ndarray:
    """Into how many parts the queries of each block are cut, by the share of the calibration queries that go to it."""
    return np.maximum(1, np.ceil(index.asked_share * queries / BLOCK_QUERIES)).astype(np.int64)


def _rounds(index: Index, queries: int, width: int, k: int) -> int:
    """In how many rounds to search, so that what one sends, and the neighbours that come back, is bounded by the size of the index."""
    sent = index.asked_share.sum()  # blocks a query goes to
    to_blocks = sent * (4 * width + ROW_BYTES) + 4 * index.visits
    back = k * 32 * (1 + index.full * sent)  # a query with fewer than k neighbours gets each once, another up to k of each block
    if index.reach is not None:  # and the neighbours get the query
        back *= 2
    room = max(LEAST_ROUND, ROUND_SHARE * 4 * width * int(index.leaf_rows.sum()))
    return max(1, int(np.ceil(queries * (to_blocks + back) / room)))


def _mixed(ids: np.ndarray, factor: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(factor)) >> np.uint64(33)


def search(index: Index, placed: DataFrame, queries: DataFrame, *, width: int, k: int, floor: float | None = None) -> DataFrame:
    """(``query``, ``id``, ``similarity``): the k most similar rows of each query, itself left out.

    A query is sent once to each block of leaves it visits, with the leaves; a
    block holds about ``index.block_rows`` rows, and a leaf of more is split over
    several, so no task gets an unbounded group. The queries of a block are
    split too, by how many of the calibration queries visit it, and its rows
    repeated for each part. Ties go to the smaller id. Queries are drawn by a
    hash into rounds, one after another; the result is a written table. If the
    index has a reach, ``queries`` must be all its rows and ``floor`` set.
    """
    spark = placed.sparkSession
    total = queries.count()
    rounds = _rounds(index, total, width, k)
    first, parts = _blocks(index.leaf_rows, index.block_rows)
    shipped = spark.sparkContext.broadcast((index.tree, first, parts, _query_parts(index, -(-total // rounds))))
    visits, reach = index.visits, index.reach
    mutual = reach is not None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, parts, q_parts = shipped.value
        step = max(16, min(4 * _BATCH if mutual else _BATCH, (1 << 23) // visits))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                row, leaf = _asked(tree, _matrix(part.column(1), width), visits, reach)
                times = parts[leaf]
                row, leaf, nth = np.repeat(row, times), np.repeat(leaf, times), _counted(times)
                block = first[leaf] + nth
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(row)]]), pa.int32()), pa.array(leaf, pa.int32()))
                take = pa.array(row[starts])
                ids = part.column(0).take(take)
                share = _mixed(ids.to_numpy(), 0xC2B2AE3D27D4EB4F).astype(np.int64) % q_parts[block[starts]]
                yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(share), ids, part.column(1).take(take), lists], ["block", "part", "query", "unit", "leaves"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts, q_parts = shipped.value
        for b in batches:
            leaf, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            block = first[leaf] + (_mixed(ids, 0x9E3779B97F4A7C15) % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(q_parts[block]), b.column(0), b.column(1), b.column(2)], ["block", "parts", "id", "unit", "leaf"])

    held = placed.select("id", "unit", "leaf").mapInArrow(settle, "block bigint, parts bigint, id bigint, unit binary, leaf int").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "id", "similarity"]
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        if not left.num_rows or not right.num_rows:
            return none
        q_id, q = left.column("query").to_numpy(), _matrix(left.column("unit"), width)
        m_id, m, leaf = right.column("id").to_numpy(), _matrix(right.column("unit"), width), right.column("leaf").to_numpy()
        lists = left.column("leaves").combine_chunks()
        asked_leaf = lists.flatten().to_numpy()
        asked_row = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        present = np.unique(leaf)
        found = []
        if len(asked_leaf) > 0.3 * len(q) * len(present):  # most leaves are wanted: one dense product
            found.append(_compare(q, q_id, m, m_id, k, floor, mutual))
        else:
            order, by = np.argsort(leaf, kind="stable"), np.argsort(asked_leaf, kind="stable")
            held_at, asked_at = (np.stack([np.searchsorted(x, present), np.searchsorted(x, present, "right")], axis=1) for x in (leaf[order], asked_leaf[by]))
            for (a, b), (c, d) in zip(held_at, asked_at, strict=True):
                rows, qs = order[a:b], asked_row[by[c:d]]
                if len(qs):
                    i, j, s = _compare(q[qs], q_id[qs], m[rows], m_id[rows], k, floor, mutual)
                    found.append((qs[i], rows[j], s))
        if not found:
            return none
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        best = _best(i, m_id[j], s, k)
        asking, other, s_best = q_id[i[best]], m_id[j[best]], s[best]
        if mutual:
            best = _best(j, q_id[i], s, k)
            asking, other, s_best = (np.concatenate(x) for x in ((asking, m_id[j[best]]), (other, q_id[i[best]]), (s_best, s[best])))
        return pa.table([pa.array(asking), pa.array(other), pa.array(s_best)], names)

    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")

    def searched(nth: int) -> DataFrame:
        some = queries.select("id", "unit").filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(rounds)) == nth)
        asked = some.mapInArrow(route, "block bigint, part bigint, query bigint, unit binary, leaves array<int>")
        near = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(meet, "query bigint, id bigint, similarity double")
        return leading(near)

    def leading(near: DataFrame) -> DataFrame:
        if mutual:  # each of a pair may have come to the other
            near = near.repartition("query").groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
        return near.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")

    with shuffles_freed(spark):
        near = materialize_all(map(searched, range(rounds)), "near")
        if mutual and rounds > 1:  # neighbours of a row come from all rounds
            near, each = materialize(leading(near), "near"), near
            discard(each)
        return near


def measured_recall(index: Index, placed: DataFrame, *, width: int, k: int, floor: float | None = None, queries: int = 500) -> DataFrame:
    """One row: ``rows``, ``leaves``, ``visits``, ``calibrated``, ``queries``, ``recall``.

    About ``queries`` rows that took no part in the calibration are searched and
    scanned against all rows; recall is the share of their true neighbours found, null if there are none.
    """
    total = int(index.leaf_rows.sum())
    asked = _picked(placed, queries, total, 3).select("id", "unit")
    ids, q = _draw(placed, queries, total, 3, width)
    at, _, true, _ = _exact_scan(placed, ids, q, k, floor, width)
    got = search(index, placed, asked, width=width, k=k, floor=floor).select("query", "id").toArrow()  # k rows a query
    found = set(zip(got.column("query").to_pylist(), got.column("id").to_pylist(), strict=True))
    hit = sum((int(ids[i]), int(j)) in found for i, j in zip(at, true, strict=True))
    row = (total, index.tree.leaves, index.visits, index.recall, len(ids), hit / len(at) if len(at) else None)
    return placed.sparkSession.createDataFrame([row], "rows bigint, leaves int, visits int, calibrated double, queries int, recall double")


@dataclass
class Classes:
    """Equal vectors as one: members of each class and one packed vector per class."""

    members: DataFrame  # rep, id, size
    reps: DataFrame  # id, unit


def equal_vector_classes(units: DataFrame) -> Classes:
    """Vectors of the same direction, bit for bit, are one class named after its smallest id.

    Only digests travel, and only classes of several vectors are looked up; one
    that a third of all rows share is joined by broadcast.
    """
    keyed = units.select("id", F.md5("unit").alias("h"))
    several = materialize(keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "classes")
    named = join_dimension(keyed, several, "h", "size", ["id"], how="left")
    members = materialize(named.select(F.coalesce("rep", "id").alias("rep"), "id", F.coalesce("size", F.lit(1)).alias("size")), "members")
    reps = units.join(members.filter(F.col("rep") != F.col("id")).select("id"), "id", "left_anti")
    return Classes(members, reps)


def top_neighbors(index_table: DataFrame, *, key: str, vector: str, width: int, k: int, floor: float | None = None, wanted_recall: float = 0.95, queries: DataFrame | None = None) -> DataFrame:
    """(``id``, ``neighbor``, ``similarity``): the k most similar other vectors of each query.

    Without ``queries`` every usable vector is one; else the ids in the column
    ``id`` of ``queries``. With ``floor`` only neighbours at or above it come out,
    still at most k. Equal vectors are searched once as a class, so a vector that
    a third of all rows share costs one search and k rows for each copy. Among
    equal similarities the smaller id goes first. Ids are taken as unique; an
    empty table gives an empty result.
    """
    with shuffles_freed(index_table.sparkSession):
        units = materialize(unit_vectors(index_table, key=key, vector=vector, width=width), "units")
        classes = equal_vector_classes(units)
        members, reps = classes.members, materialize(classes.reps, "reps")
        discard(units)
        mutual = floor is not None and queries is None
        index, placed = build_index(reps, width=width, k=k, floor=floor, wanted_recall=wanted_recall, last_use=True, mutual=mutual)
        wanted = members if queries is None else members.join(queries.select(F.col("id")), "id", "left_semi")
        asking = placed if queries is None else placed.join(wanted.select(F.col("rep").alias("id")), "id", "left_semi")
        near = search(index, placed, asking, width=width, k=k, floor=floor)
        discard(placed)
    # the k + 1 first members stand for a class; more can't be among k neighbours
    lead = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("neighbor"), "r", "size")
    others = near.select(F.col("query").alias("rep"), F.col("id").alias("other"), "similarity").join(lead.filter(F.col("r") <= k).select(F.col("rep").alias("other"), "neighbor"), "other")
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbor"))).filter(F.col("r") <= k)
    outside = wanted.filter(F.col("size") <= k).join(others, "rep").filter(F.col("r") <= k - (F.col("size") - 1)).select("id", "neighbor", "similarity")
    # members of one class are each other's neighbours: the class may be a third of all rows, its first members are k + 1
    first = lead.groupBy("rep").agg(F.array_sort(F.collect_list("neighbor")).alias("lead"), F.max("size").alias("size")).filter(F.col("size") > 1)
    with shuffles_freed(index_table.sparkSession):
        first = materialize(first.select(F.col("rep").cast("string").alias("__rep"), "lead", "size"), "leads")
    copies = join_dimension(wanted.filter(F.col("size") > 1).select("id", F.col("rep").cast("string").alias("__rep")), first, "__rep", "size", ["id"])
    same = copies.select("id", F.explode(F.slice(F.filter("lead", lambda x: x != F.col("id")), 1, k)).alias("neighbor"), F.lit(1.0).alias("similarity"))
    return outside.unionByName(same)
