"""Fill containers of fixed capacity, by dominance reduction and best fit.

Sizes are whole numbers of tokens up to the capacity, so an instance of any
number of documents is a histogram of at most ``capacity`` sizes. The plan is
made on the histogram, exactly as it would be on single documents; documents
are then given their places by their rank among those of the same size.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.materialize import materialize

#: Documents (about) of one size that are ranked in one task, at most; as many parts as that takes, and at least so many.
RANK_ROWS, RANK_PARTS = 250_000, 64


class _Stock:
    """Numbers of items by size, with the nearest size at or below a limit."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if s > 0 and n > 0}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def fits(self, room: int, used: tuple[int, ...] = ()) -> int:
        """Largest size of at most ``room`` of which an item is left beside ``used``; 0 if none."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and self.left[self.sizes[i]] <= used.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, used: tuple[int, ...]) -> list[int]:
        """The ``n`` smallest items beside ``used``, or fewer."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - used.count(s))
            if len(out) >= n:
                break
        return out


@dataclass
class Plan:
    """``bins`` of one pattern each: number of containers, sizes of their items; ``fixed`` of them by dominance."""

    capacity: int
    patterns: list[tuple[int, list[int]]] = field(default_factory=list)
    fixed: int = 0

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.patterns)


def _dominating(stock: _Stock, item: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of an ``item`` in a set that dominates all sets it could be in, or None.

    ``stock`` holds everything not packed yet, larger items too. A set dominates
    another if the items of the other can be spread over its items, each part
    fitting; then some optimal packing contains it. With ``room`` beside the
    item and ``k`` the largest other item that fits: nothing fits: the item
    alone. k fills the room: any other partners fit into k. No two items fit
    together: any single partner fits into k. No three fit: k dominates if the
    best two together are no larger than k; else k with the largest second item
    beside it, if no pair has a larger lesser item.
    """
    room = capacity - item
    k = stock.fits(room, (item,))
    if not k:
        return ()
    if k == room:
        return (k,)
    low = stock.smallest(3, (item,))
    if len(low) < 2 or low[0] + low[1] > room:
        return (k,)
    if len(low) == 3 and sum(low) <= room:
        return None
    best, lesser = 0, 0
    for s in stock.sizes:  # s is the lesser item of a pair
        if 2 * s > room:
            break
        if stock.left[s] <= (item,).count(s):
            continue
        t = stock.fits(room - s, (item, s))
        if t >= s:
            best, lesser = max(best, s + t), s
    if best <= k:
        return (k,)
    second = stock.fits(room - k, (item, k))
    return (k, second) if second and second >= lesser else None


def reduced(stock: _Stock, capacity: int) -> list[tuple[int, list[int]]]:
    """Fix dominating sets, largest item first, until no item has one; what is left stays in ``stock``.

    An item without a provable set stays in the instance and may become a
    partner of a smaller one. Each fixing shrinks the instance, which can make
    further sets provable, so passes are repeated until one fixes nothing.
    """
    out: list[tuple[int, list[int]]] = []
    again = True
    while again:
        again = False
        for item in stock.sizes[::-1]:
            while item in stock.left:
                with_it = _dominating(stock, item, capacity)
                if with_it is None:
                    break
                group = (item, *with_it)
                times = min(stock.left[s] // group.count(s) for s in set(group))
                # a set stays dominating while none of its sizes runs out, as no other item appears
                for s in set(group):
                    stock.take(s, times * group.count(s))
                out.append((times, sorted(group, reverse=True)))
                again = True
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, largest first, by classes of containers with the same free space and content."""
    open_bins: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, content: tuple[tuple[int, int], ...]) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((n, content))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_right(rooms, size - 1)
            if i == len(rooms):
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * size, whole, ((size, each),))
                if rest:
                    put(capacity - rest * size, 1, ((size, rest),))
                n = 0
                break
            room = rooms[i]
            have, content = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = room // size
            whole = min(have, n // each)
            if whole:
                put(room - each * size, whole, (*content, (size, each)))
                n -= whole * each
            if have > whole and n:
                # fewer are left than fill one container
                put(room - n * size, 1, (*content, (size, n)))
                whole, n = whole + 1, 0
            if have > whole:
                put(room, have - whole, content)
    return [(n, [s for s, m in content for _ in range(m)]) for classes in open_bins.values() for n, content in classes]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack a histogram of sizes, each from 1 to ``capacity``.

    Dominating sets are fixed for good, which never costs a container; the rest
    is packed best fit, largest first. Best fit is no optimum, so with other
    items before it it may by chance do better than on the rest: then nothing
    is fixed, and a plan never needs more containers than best fit alone. Work
    and result depend on the number of distinct sizes, not of items.
    """
    stock = _Stock(counts)
    alone = best_fit(stock.left, capacity)
    fixed = reduced(stock, capacity)
    both = Plan(capacity, fixed + best_fit(stock.left, capacity), sum(n for n, _ in fixed))
    plain = Plan(capacity, alone)
    return both if both.containers <= plain.containers else plain


def pieces(sized: DataFrame, capacities: DataFrame, *, key: str) -> DataFrame:
    """(``capacity_id``, ``capacity``, ``key``, ``piece``, ``tokens``) of every document for every capacity.

    A document of at most the capacity is one piece. A longer one alone is cut:
    full pieces and a rest. Documents without tokens are one piece of 0.
    """
    # the list of capacities is a handful of rows that the caller chooses
    both = sized.crossJoin(F.broadcast(capacities.select("capacity_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).filter("capacity > 0").distinct()))
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    cut = both.withColumn("piece", F.explode(F.sequence(F.lit(1), n)))
    return cut.select("capacity_id", "capacity", key, "piece", F.least(F.col("capacity"), F.col("tokens") - (F.col("piece") - 1) * F.col("capacity")).alias("tokens"))


def pack(sized: DataFrame, capacities: DataFrame, *, key: str) -> DataFrame:
    """(``capacity_id``, ``key``, ``piece``, ``tokens``, ``container``): a place for every piece.

    ``sized`` has ``key`` and ``tokens``, ``capacities`` ``capacity_id`` and
    ``capacity_tokens``. Containers are numbered from 1 within a capacity; no
    container holds more than its capacity. Pieces of 0 tokens go to container
    0, which stands for no container. Rows with a null key or null tokens are
    left out; a capacity that is null or below 1 has no containers. The driver
    only sees the histogram: at most ``capacity_tokens`` rows a capacity. Ranks
    within a size are counted in parts of about ``RANK_ROWS``, so a size that a
    third of all documents share isn't sorted in one task.
    """
    spark = sized.sparkSession
    sized = sized.select(key, "tokens").filter(F.col(key).isNotNull() & F.col("tokens").isNotNull())
    parts = materialize(pieces(sized, capacities, key=key), "pieces")
    rank_parts = max(RANK_PARTS, -(-parts.count() // RANK_ROWS))
    parts = parts.withColumn("__part", F.pmod(F.xxhash64(key, "piece"), F.lit(rank_parts)).cast("int"))
    counted = parts.groupBy("capacity_id", "capacity", "tokens", "__part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("capacity_id", "tokens").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counted = materialize(counted.withColumn("before", F.coalesce(offset, F.lit(0))), "sizes")
    histogram = counted.filter("tokens > 0").groupBy("capacity_id", "capacity", "tokens").agg(F.sum("n").alias("n")).collect()  # bounded by the capacities
    by: dict[tuple[int, int], dict[int, int]] = {}
    for r in histogram:
        by.setdefault((r["capacity_id"], r["capacity"]), {})[r["tokens"]] = r["n"]
    places = []
    for (capacity_id, capacity), sizes in sorted(by.items()):
        first, next_rank = 1, {}
        for n, content in plan(sizes, capacity).patterns:
            for size in dict.fromkeys(content):
                each = content.count(size)
                rank = next_rank.get(size, 0)
                places.append((capacity_id, size, rank, rank + n * each, each, first))
                next_rank[size] = rank + n * each
            first += n
    runs = spark.createDataFrame(places, "capacity_id int, tokens bigint, from_rank bigint, to_rank bigint, each bigint, first bigint")
    # all runs of a size as one array. The plan doesn't grow with the documents: each of its lines uses up a size or a
    # class of containers, and a container of capacity C holds fewer than sqrt(2 C) distinct sizes
    runs = runs.groupBy(F.col("capacity_id").alias("__c"), F.col("tokens").alias("__t")).agg(F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "each", "first"))).alias("runs"))
    in_part = Window.partitionBy("capacity_id", "tokens", "__part").orderBy(key, "piece")
    ranked = parts.withColumn("r", F.row_number().over(in_part) - 1).join(counted.select("capacity_id", "tokens", "__part", "before"), ["capacity_id", "tokens", "__part"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), (F.col("capacity_id") == F.col("__c")) & (F.col("tokens") == F.col("__t")), "left")
    run = F.filter("runs", lambda x: (x["from_rank"] <= F.col("rank")) & (F.col("rank") < x["to_rank"]))[0]
    placed = placed.withColumn("run", run)
    container = F.col("run.first") + F.floor((F.col("rank") - F.col("run.from_rank")) / F.col("run.each"))
    return placed.select("capacity_id", key, "piece", "tokens", F.coalesce(container, F.lit(0)).cast("bigint").alias("container"))


def usage(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(``capacity_id``, ``containers``, ``tokens``, ``least_containers``, ``fill``) of a packing."""
    used = packed.filter("container > 0").groupBy("capacity_id").agg(F.max("container").alias("containers"), F.sum("tokens").alias("tokens"))
    limits = capacities.select("capacity_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    both = used.join(F.broadcast(limits), "capacity_id")
    return both.select("capacity_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
