"""Documents packed into containers of fixed capacity with little space left (problem 7)."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm.tokens import TOKENIZERS, token_counts
from ledgerlink.session import cut

#: Steps of the capacity on which patterns are enumerated, and documents in a pattern at most.
GRID, DEPTH = 128, 3
#: Shares of the fitted patterns that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
#: Rows that the table of capacities may have: its plan is made on the driver.
MOST_PACKS = 1000
#: Runs of the plan up to which it is broadcast.
MOST_RUNS = 500_000
#: Groups in which items of one size are counted off.
SALTS = 256


def patterns(grid: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill ``grid`` steps with at most ``depth`` sizes, largest first."""

    def parts(left: int, most: int, places: int):
        if left == 0:
            yield ()
        elif places:
            for x in range(min(left, most), 0, -1):
                if x * places < left:
                    break
                for rest in parts(left - x, x, places - 1):
                    yield (x, *rest)

    return list(parts(grid, grid, depth))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets: free the steepest column, then step back to where none is negative."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-9 * max(1.0, np.abs(b).max(initial=0)):
            break
        free[slope.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            new = np.zeros_like(x)
            new[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if new[at].min(initial=1) > 0:
                x = new
                break
            low = at[new[at] <= 0]
            step = (x[low] / np.maximum(x[low] - new[low], 1e-300)).min()
            x = x + step * (new - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


class Containers:
    """Containers being filled, in runs: rows of ``(size, from item, from container, items in each container)``."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = dict(histogram)
        self.taken = dict.fromkeys(histogram, 0)
        self.sizes = sorted(histogram)
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # by space left: first container and number of containers
        self.spaces: list[int] = []
        self.number = 0

    def put(self, size: int, n: int, first: int, each: int = 1) -> None:
        self.rows.append((size, self.taken[size], first, each))
        self.taken[size] += n
        self.left[size] -= n

    def leave(self, space: int, first: int, n: int) -> None:
        if n and space:
            if space not in self.gaps:
                self.gaps[space] = []
                bisect.insort(self.spaces, space)
            self.gaps[space].append((first, n))

    def fill_patterns(self, shapes: list[tuple[int, ...]], times: np.ndarray, by_bin: dict[int, list[int]]) -> None:
        """Opens containers for patterns of bins of sizes, the most frequent first."""
        for k in np.argsort(-times, kind="stable"):
            p = shapes[k]
            n = min(int(times[k]), *(sum(self.left[s] for s in by_bin[b]) // p.count(b) for b in p[:1] + p[:-1]))
            if n <= 0:
                continue
            runs = [(self.number, n, self.capacity)]
            self.number += n
            for b in p[:-1]:
                runs = [r for run in runs for r in self._spread(*run, by_bin[b])]
            for first, count, space in runs:
                self._finish(first, count, space)

    def _spread(self, first: int, count: int, space: int, sizes: list[int]) -> list[tuple[int, int, int]]:
        """One item of the bin into each container of a run, the largest first; the runs that this leaves."""
        runs = []
        for s in sizes:
            m = min(count, self.left[s]) if s <= space else 0
            if m:
                self.put(s, m, first)
                runs.append((first, m, space - s))
                first, count = first + m, count - m
        return [*runs, (first, count, space)] if count else runs

    def _finish(self, first: int, count: int, space: int) -> None:
        """The last item of a pattern: the largest that there is for the space, whatever its bin, so that none is left."""
        at = bisect.bisect_right(self.sizes, space) - 1
        while count and at >= 0:
            s = self.sizes[at]
            m = min(count, self.left[s])
            if m:
                self.put(s, m, first)
                self.leave(space - s, first, m)
                first, count = first + m, count - m
            at -= 1
        self.leave(space, first, count)

    def fill_gaps(self) -> None:
        """What is left, largest items first, each into the smallest gap that holds it, or new containers."""
        for s in sorted(self.left, reverse=True):
            while self.left[s]:
                k = bisect.bisect_left(self.spaces, s)
                if k == len(self.spaces):
                    n = -(-self.left[s] // (self.capacity // s))
                    self.leave(self.capacity, self.number, n)
                    self.number += n
                    k = bisect.bisect_left(self.spaces, s)
                space = self.spaces[k]
                first, n = self.gaps[space].pop()
                if not self.gaps[space]:
                    del self.gaps[space], self.spaces[k]
                each = space // s
                full = min(n, self.left[s] // each)
                if full:
                    self.put(s, full * each, first, each)
                    self.leave(space - each * s, first, full)
                rest = min(self.left[s], each) if full < n and self.left[s] < each else 0
                if rest:
                    self.put(s, rest, first + full, each)
                    self.leave(space - rest * s, first + full, 1)
                used = full + bool(rest)
                self.leave(space, first + used, n - used)


def plan(histogram: dict[int, int], capacity: int, shares: tuple[float, ...] = SHARES) -> list[tuple[int, int, int, int]]:
    """Where the items of each size go: ``(size, from item, from container, items in each container)``.

    Works on counts of sizes only, so that its cost depends on the capacity and not on the number of
    items. Patterns are fitted to the histogram; a share of their counts is packed, and what is left fills
    gaps, largest items first, each in the smallest gap that holds it. Of the ``shares`` the one that needs
    the fewest containers counts, of equals the greatest; as the least of them leaves everything to the
    gaps, patterns never cost a container.
    """
    sizes = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    grid = min(GRID, capacity)
    bin_of = {s: -(-s * grid // capacity) for s in sizes}
    by_bin: dict[int, list[int]] = {}
    for s in sorted(sizes, reverse=True):
        by_bin.setdefault(bin_of[s], []).append(s)
    filled = np.zeros(grid + 1)
    for s, n in sizes.items():
        filled[bin_of[s]] += n
    shapes = [p for p in patterns(grid, DEPTH) if all(filled[b] for b in p)]
    times = np.zeros(len(shapes))
    if shapes:
        a = np.zeros((grid + 1, len(shapes)))
        for k, p in enumerate(shapes):
            for b in p:
                a[b, k] += 1
        weight = np.where(np.arange(grid + 1) > grid // 8, 1.0, 0.3)[:, None]  # small items are of use in gaps
        times = non_negative_least_squares(a * weight, filled * weight[:, 0])
    best = None
    for share in shares:
        c = Containers(sizes, capacity)
        c.fill_patterns(shapes, np.floor(times * share + 0.5).astype(int), by_bin)
        c.fill_gaps()
        if best is None or (c.number, -share) < best[0]:
            best = (c.number, -share), c.rows
    return best[1]


def packed_documents(documents: DataFrame, packs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """A container for each document, for each row of ``packs``: ``pack_id, container_id, doc_id, piece, from_token, n_tokens``.

    Sizes are tokens of the whole text by the pack's tokenizer. A document larger than the capacity is cut
    into full pieces and a rest; every other one stays whole, as piece 0. A null or empty text has size 0
    and lies in container 0. Packs without tokenizer or with a capacity below 1 hold nothing. A repeated
    doc_id is an item each time. Container ids begin at 0 in each pack. Extra columns are ignored.

    Only counts by size, as many as the capacities have tokens, reach the driver; it answers with runs of
    items. Items find their run by their number among those of their size, counted off in SALTS groups, so
    that a size that many documents share needs no single task.
    """
    spark = documents.sparkSession
    wanted = packs.select("pack_id", "tokenizer", "capacity").where("tokenizer is not null and capacity > 0").distinct().limit(MOST_PACKS + 1).collect()
    if len(wanted) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    names = sorted({r.tokenizer for r in wanted})
    counts = cut(token_counts(documents, names, folder))
    packs_of = F.array(*[F.struct(F.lit(r.pack_id).alias("pack_id"), F.lit(r.capacity).alias("capacity"), F.lit(names.index(r.tokenizer)).alias("at")) for r in wanted]) if wanted else F.expr("cast(array() as array<struct<pack_id:int,capacity:int,at:int>>)")
    sized = counts.select("doc_id", "n_tokens", F.explode(packs_of).alias("p")).select("p.pack_id", "p.capacity", "doc_id", F.get("n_tokens", F.col("p.at")).alias("n"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1, F.lit(0))))
    items = sized.withColumn("piece", piece).withColumn("size", F.least("capacity", F.col("n") - F.col("piece") * F.col("capacity")).cast("int"))

    histogram: dict[int, dict[int, int]] = {}
    for r in items.groupBy("pack_id", "size").count().collect():  # at most one row for each token of each capacity
        histogram.setdefault(r.pack_id, {})[r["size"]] = r["count"]
    runs = [(r.pack_id, *row) for r in wanted for row in plan(histogram.get(r.pack_id, {}), r.capacity)]
    rows = spark.createDataFrame(runs, "pack_id int, size int, item bigint, container bigint, each int")
    by_size = rows.groupBy("pack_id", "size").agg(F.array_sort(F.collect_list(F.struct("item", "container", "each"))).alias("runs"))
    by_size = F.broadcast(by_size) if len(runs) <= MOST_RUNS else by_size

    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    group = ["pack_id", "size", "salt"]
    before = Window.partitionBy("pack_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy(*group).agg(F.count("*").alias("k")).select(*group, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    numbered = items.withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(offsets, group).withColumn("i", F.col("i") + F.col("offset")).join(by_size, ["pack_id", "size"], "left")
    run = F.try_element_at("runs", F.size(F.filter("runs", lambda r: r["item"] <= F.col("i"))))
    container = F.coalesce(run["container"] + F.floor((F.col("i") - run["item"]) / run["each"]), F.lit(0)).cast("bigint")
    return numbered.select("pack_id", container.alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).cast("bigint").alias("from_token"), F.col("size").alias("n_tokens"))
