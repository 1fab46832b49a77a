"""Filling fixed-capacity containers with items (problem 7).

What matters of the items is the histogram of their sizes, which has at most ``capacity`` entries however many
items there are. Over it, shallow combinations of sizes that fill a container but for a narrow window are
enumerated, and non-negative least squares finds how often to repeat each so that together they use up the
histogram. The counts are rounded down; what is left is packed greedily, again over the histogram. The outcome
is a list of patterns with repeat counts. Each item then finds its container from its size and its rank among
the items of that size, so the items themselves are never gathered or ordered as a whole.

An item above the capacity is divided into pieces that fill a container each, which need no plan and no rank: they
are numbered by prefix sums over the items; only the rest is packed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Unused space of an enumerated combination, as a share of the capacity.
WINDOW = 0.004
#: Sizes tried as partner for each size, spread over the histogram.
PARTNERS = 16
#: Least squares end once ten rounds lower the residual by less than this share of it, at the latest after so many.
SETTLED = 1e-4
ROUNDS = 3000
#: Items numbered and ranked together, so that a frequent size is spread over tasks, and the fewest such groups.
ROWS, GROUPS = 500_000, 64
#: Entries of the plans that go to the workers at once; more containers' plans are used one batch after the other.
ENTRIES = 2_000_000


@dataclass
class Layout:
    """For sizes in ``size`` and ranks from ``start`` on: container ``base`` + (rank - start) // ``each``."""

    key: np.ndarray
    start: np.ndarray
    base: np.ndarray
    each: np.ndarray
    containers: int


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of up to three sizes (indexes) with multiplicities, filling the capacity but for the window."""
    slack = max(1, int(capacity * WINDOW))
    share = np.cumsum(counts) / counts.sum()
    picks = np.unique(np.searchsorted(share, (np.arange(PARTNERS) + 0.5) / PARTNERS).clip(0, len(sizes) - 1))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sizes)), picks, indexing="ij"))
    columns = []
    for fewer in (0, 1, 2):
        most = (capacity - sizes[b]) // sizes[a] - fewer
        ok = (most >= 1) & (sizes[a] + sizes[b] <= capacity)
        i, j, k = a[ok], b[ok], most[ok]
        rest = capacity - sizes[j] - k * sizes[i]
        c = np.searchsorted(sizes, rest, "right") - 1
        left = np.where(c >= 0, rest - sizes[np.maximum(c, 0)], rest)
        use = (c >= 0) & (left <= slack)
        columns.append((np.stack([i[use], j[use], c[use]], 1), np.stack([k[use], np.ones(use.sum(), int), np.ones(use.sum(), int)], 1)))
        bare = rest <= slack
        columns.append((np.stack([i[bare], j[bare], j[bare]], 1), np.stack([k[bare], np.ones(bare.sum(), int), np.zeros(bare.sum(), int)], 1)))
    whole = sizes >= capacity - slack
    alone = np.flatnonzero(whole)
    columns.append((np.stack([alone] * 3, 1), np.stack([np.ones(len(alone), int)] + [np.zeros(len(alone), int)] * 2, 1)))
    return np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns])


def solve_counts(which: np.ndarray, times: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: how often to use each column to meet the counts."""
    n = len(counts)
    if not len(which):
        return np.zeros(0)
    h = counts.astype(float)
    want = (h[which] * times).sum(1)
    x = want / np.maximum(1e-9, (times * times).sum(1)) / max(1.0, len(which) / max(1, n))
    rest = np.inf
    for k in range(ROUNDS):
        made = np.bincount(which.ravel(), (times * x[:, None]).ravel(), n)
        if k % 10 == 0:
            before, rest = rest, float(np.linalg.norm(made - h))
            if before - rest <= SETTLED * rest:
                break
        x *= want / np.maximum(1e-12, (made[which] * times).sum(1))
    return x


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(size, multiplicity), ...] with repeat counts, using up ``counts`` (size: number) exactly."""
    sizes = np.array(sorted(s for s, n in counts.items() if n and 0 < s <= capacity), np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    if not len(sizes):
        return patterns
    which, times = combinations(sizes, left, capacity)
    x = solve_counts(which, times, left)
    for j in np.argsort(-x, kind="stable").tolist():
        n = int(x[j] + 1e-6)
        if n < 1:
            break
        need: dict[int, int] = {}
        for i, t in zip(which[j].tolist(), times[j].tolist(), strict=True):
            if t:
                need[i] = need.get(i, 0) + t
        n = min(n, *(int(left[i]) // t for i, t in need.items()))
        if n > 0:
            for i, t in need.items():
                left[i] -= n * t
            patterns.append(([(int(sizes[i]), t) for i, t in need.items()], n))
    patterns += _greedy(sizes.tolist(), left.tolist(), capacity)
    return patterns


def _greedy(sizes: list[int], left: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Largest first, then the largest that still fits, and so on; the pattern repeats while the sizes last."""
    below = list(range(-1, len(sizes) - 1))  # a lower index that may have items left

    def find(i: int) -> int:
        while i >= 0 and left[i] == 0:
            low = below[i]
            if low >= 0 and left[low] == 0:
                below[i] = below[low]
            i = low
        return i

    out = []
    top = find(len(sizes) - 1)
    while top >= 0:
        need: dict[int, int] = {}
        room, at = capacity, top
        while at >= 0:
            n = min(room // sizes[at], left[at])
            if n:
                need[at] = n
                room -= n * sizes[at]
            low = bisect.bisect_right(sizes, room) - 1
            at = find(min(low, at - 1))
        n = min(left[i] // t for i, t in need.items())
        for i, t in need.items():
            left[i] -= n * t
        out.append(([(sizes[i], t) for i, t in need.items()], n))
        top = find(top)
    return out


def layout(patterns: list[tuple[list[tuple[int, int]], int]]) -> Layout:
    """Where the items of each size and rank go."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in patterns:
        for size, t in pattern:
            rows.append((size, used.get(size, 0), base, t))
            used[size] = used.get(size, 0) + n * t
        base += n
    rows.sort()
    size, start, first, each = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return Layout((size << 40) | start, start, first, each, base)


def _layouts(groups: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The plan of each container kind ``_i`` (capacity ``sizes[_i]``) as arrays, made in tasks from its histogram."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["_i"].iloc[0])
        made = layout(plan(dict(zip(pdf["rest"].tolist(), pdf["n"].tolist(), strict=True)), sizes[i]))
        return pd.DataFrame({"_i": [i], "key": [made.key.tolist()], "start": [made.start.tolist()], "base": [made.base.tolist()], "each": [made.each.tolist()], "containers": [made.containers]})

    histogram = groups.groupBy("_i", "rest").agg(F.sum("n").alias("n"))
    return histogram.groupBy("_i").applyInPandas(run, "_i int, key array<long>, start array<long>, base array<long>, each array<long>, containers long")


def pack(items: DataFrame, capacities: list[tuple[str, int]] | DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """A container for every item, for each (name, capacity), given as a list or as a table of these two columns.

    Returns pack_id, ``key``, piece_no, start_pos (in tokens), tokens, pack_no. An item above the capacity is
    divided into pieces of exactly the capacity, a container each, and a rest that is packed like an item. Items
    of size 0 or null take no space and go into container 0. Repeated keys are items of their own. Null capacities
    and those below 1 hold nothing and have no rows; equal rows count once. The plans are made in tasks from the
    histograms, at most ``capacity`` rows each; they come to the driver to be shared, in batches of bounded size.
    """
    from ..session import cut

    rows = capacities.collect() if isinstance(capacities, DataFrame) else capacities
    wanted = sorted({(n, int(c)) for n, c in rows if c is not None and c > 0}, key=lambda x: (x[0] is None, x[0] or "", x[1]))
    schema = items.select(F.lit(None).cast("string").alias("pack_id"), key).schema.add("piece_no", "integer").add("start_pos", "long").add("tokens", "long").add("pack_no", "long")
    sized = cut(items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0)).alias("_size")), "items")
    salts = max(GROUPS, sized.count() // ROWS)
    out = items.sparkSession.createDataFrame([], schema)
    while wanted:
        many, total = 0, 0
        while many < len(wanted) and (not many or total + wanted[many][1] <= ENTRIES):
            total += wanted[many][1]
            many += 1
        out = out.unionByName(_pack(sized, wanted[:many], key, schema, salts))
        wanted = wanted[many:]
    return out


def _pack(sized: DataFrame, capacities: list[tuple[str, int]], key: str, schema: StructType, salts: int) -> DataFrame:
    from ..session import cut

    spark = sized.sparkSession
    kinds = F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(c).cast("long").alias("_c")) for i, (_, c) in enumerate(capacities)))
    rows = sized.withColumn("_salt", F.pmod(F.xxhash64(key, "_size"), F.lit(salts))).select(key, "_size", "_salt", F.explode(kinds).alias("_k")).select(key, "_size", "_salt", "_k.*")
    rows = rows.select(key, "_size", "_salt", "_i", F.floor(F.col("_size") / F.col("_c")).alias("full"), (F.col("_size") % F.col("_c")).alias("rest"))
    groups = cut(rows.groupBy("_i", "_salt", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "histogram")
    plans = _layouts(groups.where("rest > 0").select("_i", "rest", "n"), {i: c for i, (_, c) in enumerate(capacities)}).collect()
    shared = spark.sparkContext.broadcast({r["_i"]: Layout(*(np.array(r[c], np.int64) for c in ("key", "start", "base", "each")), r["containers"]) for r in plans})
    # where each group begins: full pieces in the numbering of their kind, rests among those of their size
    up_to = Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("_i", "_salt").agg(F.sum("full").alias("n")).select("_i", "_salt", F.coalesce(F.sum("n").over(up_to.partitionBy("_i")), F.lit(0)).alias("_full0"))
    ranks = groups.select("_i", "_salt", "rest", F.coalesce(F.sum("n").over(up_to.partitionBy("_i", "rest")), F.lit(0)).alias("_rank0"))
    offsets = ranks.join(starts, ["_i", "_salt"])
    # both windows run over the same groups
    inside = Window.partitionBy("_i", "_salt").orderBy(key, "_size").rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy("_i", "_salt", "rest").orderBy(key, "_size")
    ranked = rows.withColumn("_full", F.coalesce(F.sum("full").over(inside), F.lit(0))).withColumn("_rank", F.row_number().over(among) - 1)
    ranked = ranked.join(offsets, ["_i", "_salt", "rest"]).select(key, "_i", "_size", (F.col("_full") + F.col("_full0")).alias("_full"), (F.col("_rank") + F.col("_rank0")).alias("_rank"))
    names = pa.array([n for n, _ in capacities], pa.string())
    caps = np.array([c for _, c in capacities], np.int64)

    def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
        i, whole, full, rank = (batch.column(c).to_numpy() for c in ("_i", "_size", "_full", "_rank"))
        cap = caps[i]
        fulls, rest = whole // cap, whole % cap
        count = fulls + ((rest > 0) | (whole == 0))
        row = np.repeat(np.arange(len(i)), count)
        piece = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        out = np.zeros(len(row), np.int64)
        for k in np.unique(i).tolist():
            made = shared.value.get(k)
            mine = np.flatnonzero((i[row] == k) & (piece < fulls[row]))
            out[mine] = (made.containers if made else 0) + full[row[mine]] + piece[mine]
            mine = np.flatnonzero((i[row] == k) & (piece == fulls[row]) & (rest[row] > 0))
            if len(mine):
                x, r = rest[row[mine]], rank[row[mine]]
                at = np.searchsorted(made.key, (x << 40) | r, "right") - 1
                out[mine] = made.base[at] + (r - made.start[at]) // made.each[at]
        tokens = np.where(piece < fulls[row], cap[row], rest[row])
        return pa.RecordBatch.from_arrays([names.take(pa.array(i[row])), batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * cap[row]), pa.array(tokens), pa.array(out)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield numbered(batch.slice(at, 2000))

    return ranked.mapInArrow(run, schema)
