"""Near-duplicate records by a self-join over binary tries of fingerprints.

Each record becomes a fingerprint of one-bit minhashes of its shingles, so the
share of differing bits falls as the similarity grows. Two tries are walked
together from their roots; a pair of nodes carries the bits that already differ
and is dropped as soon as they exceed the error budget. At low similarity the
budget is a quarter or more of all bits, too many to prune near the root of one
trie of everything, so records are first sent to many small tries by keys that
similar records share; each trie is joined with itself as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.batches import text_slices
from corvane.plans.materialize import discard, materialize
from corvane.plans.skew import join_dimension
from corvane.plans.spread import spread

#: Bits of a fingerprint, and minhashes of a record.
BITS = 256
#: Routing keys of a record up to which longer keys are preferred, as they send fewer unlike records together.
FEW_KEYS = 85
#: Members (about) of a trie that one task joins; larger ones are split into blocks, at any number of records.
TRIE_ROWS = 4096
#: Rows of hot keys that are broadcast, at most.
HOT_KEYS = 20000
#: Node pairs walked at once, and pairs of codes below two nodes up to which they are compared one by one.
FRONTIER, LEAF_PAIRS = 1 << 20, 16
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def tables_for(threshold: float, miss: float = 3e-4) -> tuple[int, int]:
    """Routing keys of a record and minhashes of a key, so that a pair at the threshold shares no key with probability ``miss`` at most.

    Keys of three minhashes as long as ``FEW_KEYS`` of them are enough, else of
    two; below a threshold of about 0.3 as many keys of two as it takes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and be 1 at most")
    need = lambda hashes: max(1, int(np.ceil(np.log(miss) / np.log1p(-(threshold**hashes))))) if threshold < 1 else 1
    hashes = 3 if need(3) <= FEW_KEYS else 2
    return need(hashes), hashes


def error_budget(threshold: float, bits: int = BITS, z: float = 4.4) -> int:
    """Differing bits that a pair at the threshold exceeds with a probability of about 5e-6 at z = 4.4."""
    p = (1 - threshold) / 2
    return int(np.ceil(bits * p + z * np.sqrt(bits * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A random number for every byte value.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _positional(values: np.ndarray, starts: np.ndarray, place: np.ndarray, factor: int) -> np.ndarray:
    """Sum of values x factor ^ place for each run that begins at ``starts``, modulo 2 ^ 64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(place.max()) + 1, factor, np.uint64))
        return np.add.reduceat(values * power[place], starts)


def _places(length: int, starts: np.ndarray) -> np.ndarray:
    """Distance of each position from the last start before it."""
    begin = np.concatenate([[0], starts])
    return np.arange(length) - np.repeat(begin, np.diff(np.concatenate([begin, [length]])))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of a-z and 0-9 of lower-cased texts, and the rows' bounds.

    Works on the bytes of the whole batch; a null text has no words.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    opens = inside & ~np.concatenate([[False], inside[:-1]]) if len(data) else inside
    row_starts = (ends[:-1] - ends[0])[ends[:-1] < ends[1:]]
    opens[row_starts] = inside[row_starts]
    starts = np.flatnonzero(opens)
    bounds = np.concatenate([[0], np.cumsum(opens)])[ends - ends[0]]
    code = _positional(np.where(inside, _BYTE[data], np.uint64(0)), starts, _places(len(data), starts), 0xD6E8FEB86659FD93)
    return _mix(code), bounds.astype(np.int64)


def _digests(texts: pa.Array, least: int) -> tuple[np.ndarray, pa.Array]:
    """Which rows have ``least`` words, and 16 bytes that stand for the word sequence of each of these."""
    code, bounds = word_hashes(texts)
    enough = np.diff(bounds) >= least
    some = bounds[:-1][bounds[:-1] < bounds[1:]]
    place = _places(len(code), some)
    both = np.zeros((len(bounds) - 1, 2), np.uint64)
    filled = np.diff(bounds) > 0
    both[filled, 0] = _mix(_positional(code, some, place, 0xA0761D6478BD642F))
    both[filled, 1] = _mix(_positional(_mix(code), some, place, 0xE7037ED1A0B428DB))
    both = both[enough]
    ends = np.arange(len(both) + 1, dtype=np.int32) * 16
    return enough, pa.Array.from_buffers(pa.binary(), len(both), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(both.tobytes())])


def shingle_hashes(word: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of ``size`` words in a row, sorted within each text, and the rows' bounds."""
    count = np.maximum(np.diff(bounds) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][row]
    code = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            code = _mix(code + word[at + i] + np.uint64(i + 1))
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, bool)
    row, code = row[fresh], code[fresh]
    return code, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(count)))]).astype(np.int64)


def minhashes(code: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes of each row; rows must not be empty."""
    rng = np.random.default_rng(11)
    mult = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, n, np.uint64)
    out = np.empty((len(bounds) - 1, n), np.uint32)
    base = _mix(code)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[:, i] = np.minimum.reduceat(((base ^ flip[i]) * mult[i] >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def _sketches(size: int, tables: int, key_hashes: int, least: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, n in text_slices(b.column(1), limit=1 << 20):
                part = b.slice(lo, n)
                word, bounds = word_hashes(part.column(1))
                enough = pa.array(np.diff(bounds) >= least)
                if enough.false_count:
                    part = part.filter(enough)
                    word, bounds = word_hashes(part.column(1))
                if not part.num_rows:
                    continue
                code, bounds = shingle_hashes(word, bounds, size)
                low = minhashes(code, bounds, max(BITS, tables * key_hashes))
                mixed = _mix(low[:, :BITS].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                bits = np.packbits((mixed & np.uint64(1)).astype(np.uint8), axis=1)
                keys = np.empty((len(low), tables), np.uint64)
                with np.errstate(over="ignore"):
                    for t in range(tables):
                        k = np.full(len(low), t + 1, np.uint64)
                        for h in range(key_hashes):
                            k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + low[:, t * key_hashes + h])
                        keys[:, t] = k
                ends = np.arange(len(low) + 1, dtype=np.int32)
                fp = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer((ends * (BITS // 8)).tobytes()), pa.py_buffer(bits.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), fp, pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends * tables, pa.int32()), pa.array(keys.astype(np.int64).ravel())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code.view(np.int64)))],
                    ["rep", "fp", "n", "keys", "shingles"],
                )

    return sketch


def trie_join(codes: np.ndarray, group: np.ndarray, side: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of one group whose codes differ in ``budget`` bits at most.

    ``codes`` are rows of bytes, ``group`` numbers the trie of each. Where
    ``side`` of a group holds both 0 and 1, only pairs across are wanted: the
    two halves are two tries. Sorted codes are the trie: a node is a range of
    rows with a common prefix, split by bisection on the next bit. All tries of
    the call go down together, one bit a step, in pieces of ``FRONTIER`` pairs;
    equal codes end as one leaf, and nodes with few codes below them are
    compared code by code, each by one popcount.
    """
    order = np.lexsort(tuple(codes.T[::-1]) + (side, group))
    codes, group, side = codes[order], group[order], side[order]
    n = len(codes)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    fresh = new | np.concatenate([[True], (codes[1:] != codes[:-1]).any(1)])
    leaf_at = np.flatnonzero(fresh)  # first row of each distinct code
    leaf_end = np.concatenate([leaf_at[1:], [n]])
    leaf = codes[leaf_at]
    bits = np.unpackbits(leaf, axis=1)
    ones = np.concatenate([np.zeros((1, bits.shape[1]), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    roots = np.flatnonzero(new[leaf_at])
    root_end = np.concatenate([roots[1:], [len(leaf_at)]])
    root_group, root_side = group[leaf_at[roots]], side[leaf_at[roots]]
    twin = np.flatnonzero((root_group[1:] == root_group[:-1]) & (root_side[1:] != root_side[:-1]))
    alone = np.ones(len(roots), bool)
    alone[twin] = alone[twin + 1] = False
    a0 = np.concatenate([roots[alone], roots[twin]])
    a1 = np.concatenate([root_end[alone], root_end[twin]])
    b0 = np.concatenate([roots[alone], roots[twin + 1]])
    b1 = np.concatenate([root_end[alone], root_end[twin + 1]])
    stack = [(0, a0, a1, b0, b1, np.zeros(len(a0), np.int32))]
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            stack += [(depth, *(x[i : i + FRONTIER] for x in (a0, a1, b0, b1, err))) for i in range(0, len(a0), FRONTIER)]
            continue
        few = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if depth == bits.shape[1]:
            few[:] = True
        if few.any():
            wide = b1[few] - b0[few]
            times = (a1[few] - a0[few]) * wide
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i, j = np.repeat(a0[few], times) + at // np.repeat(wide, times), np.repeat(b0[few], times) + at % np.repeat(wide, times)
            once = (i <= j) | np.repeat(a0[few] != b0[few], times)
            i, j = i[once], j[once]
            near = _POP[leaf[i] ^ leaf[j]].sum(1, dtype=np.int32) <= budget
            hits.append((i[near], j[near]))
            a0, a1, b0, b1, err = (x[~few] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        # within a node the rows with bit 0 stand first
        am = a1 - (ones[a1, depth] - ones[a0, depth])
        bm = b1 - (ones[b1, depth] - ones[b0, depth])
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        kids.append(tuple(x[~same] for x in (am, a1, b0, bm, err + 1)))
        parts = [np.concatenate(x) for x in zip(*kids, strict=True)]
        keep = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= budget)
        stack.append((depth + 1, *(x[keep] for x in parts)))
    if not hits:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
    # leaves back to rows
    wide_i, wide_j = leaf_end[i] - leaf_at[i], leaf_end[j] - leaf_at[j]
    times = wide_i * wide_j
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    x = np.repeat(leaf_at[i], times) + at // np.repeat(wide_j, times)
    y = np.repeat(leaf_at[j], times) + at % np.repeat(wide_j, times)
    keep = ~((np.repeat(i, times) == np.repeat(j, times)) & (x >= y))
    return order[x[keep]], order[y[keep]]


def _join_groups(budget: int, threshold: float):
    """Rows sorted by trie: whole tries are gathered until there are enough for one vector step.

    Of the pairs let through, those whose numbers of shingles alone rule the threshold out are left.
    """

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) - 1
        several = np.bincount(group)[group] > 1
        if not several.any():
            return None
        rep = t.column("rep").to_numpy()[several]
        fp = np.frombuffer(b"".join(t.column("fp").filter(pa.array(several)).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        size = t.column("n").to_numpy()[several]
        i, j = trie_join(fp, group[several], t.column("side").to_numpy()[several], budget)
        fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        a, b = rep[i[fit]], rep[j[fit]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            key, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            held.append(b)
            rows += b.num_rows
            if rows < 4 * TRIE_ROWS:
                continue
            change = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
            if not len(change):
                continue  # one trie fills the batch; a trie has about 2 * TRIE_ROWS rows at most
            cut = int(change[-1]) + 1
            held[-1] = b.slice(0, cut)
            out = solve(held)
            if out is not None:
                yield out
            held, rows = [b.slice(cut)], b.num_rows - cut
        if held:
            out = solve(held)
            if out is not None:
                yield out

    return run


def _blocked(routed: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of ``routed`` whose key is ``shared``, with ``parts``, the number of blocks of the key's trie: 1 for all but hot keys.

    A key held by more than ``TRIE_ROWS`` records is hot. Up to ``HOT_KEYS`` hot
    keys are counted and broadcast. Where there are more, those with more than
    1/``HOT_KEYS`` of all routed rows still are, fewer than ``HOT_KEYS`` by
    construction; the rows of any other key fit into a task, so they are joined
    like those of keys that aren't hot, by a shuffle if need be.
    """
    cut = shared.select("key", "n", F.ceil(F.col("n") / TRIE_ROWS).cast("int").alias("parts"))
    top = cut.filter(F.col("parts") > 1)
    if top.limit(HOT_KEYS + 1).count() > HOT_KEYS:
        rows = shared.agg(F.sum("n")).first()[0]
        top = top.filter(F.col("n") * F.lit(HOT_KEYS) > F.lit(rows))
        rest = cut.filter(F.col("n") * F.lit(HOT_KEYS) <= F.lit(rows))
    else:
        rest = cut.filter(F.col("parts") == 1)
    both = routed.join(F.broadcast(top.select("key", F.col("parts").alias("__top"))), "key", "left")
    at_hand = both.filter(F.col("__top").isNotNull()).withColumnRenamed("__top", "parts")
    return at_hand.unionByName(both.filter(F.col("__top").isNull()).drop("__top").join(rest.select("key", "parts"), "key"))


def candidate_pairs(sketches: DataFrame, *, budget: int, threshold: float) -> DataFrame:
    """(``a``, ``b``), a < b: pairs that some trie join lets through, each once.

    Most keys are held by one record alone. Keys are counted first, and only the
    rows of shared keys get their fingerprints and travel. A hot trie is cut
    into blocks of about ``TRIE_ROWS`` by a hash of the record, and each two
    blocks, and each block with itself, are joined in a task of their own, so no
    pair is lost and no task holds an unbounded trie. The result is written.
    """
    keys = sketches.select("rep", F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "shared-keys")
    routed = _blocked(keys, shared).join(sketches.select("rep", "fp", "n"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    routed = routed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.least("own", "other").cast("bigint") * F.col("parts") + F.greatest("own", "other")
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    routed = routed.select("key", block.alias("block"), side.cast("int").alias("side"), "rep", "fp", "n")
    placed = routed.repartition("key", "block").sortWithinPartitions("key", "block")
    out = materialize(placed.mapInArrow(_join_groups(budget, threshold), "a bigint, b bigint").distinct(), "candidates")
    discard(shared)
    return out


class NearDuplicates:
    """Pairs of records at or above a similarity, and the groups they form.

    Similarity is the Jaccard coefficient of the sets of distinct runs of
    ``shingle`` consecutive words. Records with a null text or fewer than
    ``least_words`` words take no part, nor do rows with a null key. Records
    with the same words in the same order are one class, named after its
    smallest id and known by 128-bit digests; only class names are sketched and joined, so a text that a
    third of all rows repeat costs one sketch. Candidates of the trie join are
    checked exactly on the shingle sets. Ids are taken as unique; an empty
    table gives empty results.
    """

    def __init__(self, table: DataFrame, *, key: str, text: Column, shingle: int = 5, threshold: float = 0.8, least_words: int = 1):
        self.threshold = threshold
        least = max(least_words, shingle)
        source = spread(table, key).filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.lower(text).alias("t")).filter(F.col("t").isNotNull())

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, n in text_slices(b.column(1)):
                    part = b.slice(lo, n)
                    enough, h = _digests(part.column(1), least)
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(enough)), h], ["id", "h"])

        keyed = materialize(source.mapInArrow(digest, "id bigint, h binary"), "digests")
        per = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
        # only classes of several records are looked up; one that a third of all rows share is joined by broadcast
        several = materialize(per.filter(F.col("size") > 1).withColumn("h", F.hex("h")), "classes")
        named = join_dimension(keyed.select(F.hex("h").alias("h"), "id"), several, "h", "size", ["id"], how="left")
        self.members = materialize(named.select(F.coalesce("rep", "id").alias("rep"), "id", F.coalesce("size", F.lit(1)).alias("size")), "members")
        discard(keyed)
        # where copies are few, their ids are a small table and the texts needn't be shuffled to leave them out
        copies = materialize(self.members.filter(F.col("rep") != F.col("id")).select("id"), "copies")
        sketch = _sketches(shingle, *tables_for(threshold), least)
        self.sketches = materialize(source.join(copies, "id", "left_anti").mapInArrow(sketch, "rep bigint, fp binary, n int, keys array<bigint>, shingles array<bigint>"), "sketches")
        self.budget = error_budget(threshold)
        self._links: DataFrame | None = None

    def links(self) -> DataFrame:
        """(``a``, ``b``, ``similarity``): pairs of classes, a < b."""
        if self._links is None:
            pairs = candidate_pairs(self.sketches, budget=self.budget, threshold=self.threshold)
            sets = self.sketches.select("rep", "shingles")
            met = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
            both = F.size(F.array_intersect("sa", "sb"))
            met = met.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
            self._links = materialize(met.filter(F.col("both") >= F.col("either") * F.lit(self.threshold)).select("a", "b", (F.col("both") / F.col("either")).alias("similarity")), "links")
            discard(pairs)
        return self._links

    def pairs(self) -> DataFrame:
        """(``id_a``, ``id_b``), smaller first: links expanded to rows, and the pairs of equal records."""
        member = self.members.select("rep", "id")
        left, right = member.select(F.col("rep").alias("a"), F.col("id").alias("x")), member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links().select("a", "b").join(left, "a").join(right, "b").select("x", "y")
        several = self.members.filter(F.col("size") > 1)
        copies = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").filter(F.col("x") < F.col("y")).select("x", "y")
        both = across.unionByName(copies)
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(``id``, ``class_id``, ``group_id``, ``links``): every record that takes part.

        ``class_id`` is the smallest id with the same words, ``group_id`` the
        smallest id reachable over links, ``links`` the number of other classes
        the record's class is linked with.
        """
        links = self.links()
        ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep")))
        degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        root = connected(links.select("a", "b"))
        out = self.members.join(degree, "rep", "left").join(root, "rep", "left")
        return out.select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def connected(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(``rep``, ``root``): the smallest id of each node's component.

    Large-star and small-star steps: every step replaces links by links to the
    smallest neighbour, so the longest path halves about each round. Each round
    is written to the shared folder, and a node with very many neighbours is
    only ever aggregated, never collected.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        step = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = step.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(step, ["u", "v"], "left_anti").isEmpty()
        discard(edges)
        edges = step
        if same:
            break
    else:
        raise RuntimeError("the components didn't settle")
    star = edges.groupBy("u").agg(F.min("v").alias("root"))
    return star.select(F.col("u").alias("rep"), "root").unionAll(star.select(F.col("root").alias("rep"), "root").distinct())
