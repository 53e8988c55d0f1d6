"""Filling containers of fixed capacity: Martello-Toth dominance reduction, then best-fit decreasing.

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity`` counters however many
items there are. It is that histogram which is solved on the driver: equal items are fixed or placed in bulk, which gives
runs of equal containers. Items find their containers by their rank among the items of their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.runtime import Workspace


class _Sizes:
    """Sorted sizes with counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.s = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.s.pop(bisect.bisect_left(self.s, size))

    def largest(self, limit: int) -> int | None:
        i = bisect.bisect_right(self.s, limit)
        return self.s[i - 1] if i else None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Dominance reduction. Returns (fixed runs of (how many, sizes of the container), counts left).

    For the largest item j: alone if nothing fits beside it; with one item that fills it up exactly; with the largest that
    fits if no two of the smallest fit; with the largest that fits if it is no less than the best pair when no three fit.
    In these cases every packing has an at least as good one with this container (criterion of Martello and Toth).
    """
    z, runs = _Sizes(counts), []
    j = z.s[-1] if z.s else None
    while j is not None:
        room = capacity - j
        one = z.largest(room)
        if one == j and z.n[j] == 1:
            i = bisect.bisect_left(z.s, j)
            one = z.s[i - 1] if i else None
        if one is None:
            runs.append((z.n[j], (j,)))
            z.take(j, z.n[j])
        else:
            small: list[int] = []
            for s in z.s:
                small += [s] * min(z.n[s] - (s == j), 3 - len(small))
                if len(small) == 3:
                    break
            two, three = (sum(small[:2]) if len(small) > 1 else room + 1), (sum(small) if len(small) > 2 else room + 1)
            fixed = one == room or two > room
            if not fixed and three > room:
                fixed = one >= max((a + b for a in z.s if a < room and (b := z.largest(min(a, room - a))) is not None), default=0)
            if fixed:
                # in bulk where the choice stays the same: an exact partner stays one
                k = (z.n[j] // 2 if one == j else min(z.n[j], z.n[one])) if one == room else 1
                runs.append((k, (j, one)))
                z.take(j, k)
                z.take(one, k)
                if j in z.n:
                    continue
            # else undecided: it stays among the others
        j = z.largest(j - 1)
    return runs, dict(z.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram: runs of (how many, sizes of the container)."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}  # free room -> contents -> containers
    order: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(order, size)
            if i < len(order):
                room = order[i]
                content, k = rooms[room].popitem()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
                # equal items go into equal containers in bulk, each as often as it fits
                times = min(room // size, left) if k == 1 or left >= k * (room // size) else max(1, min(room // size, left // k))
                use = min(k, left // times)
                if use < k:
                    rooms.setdefault(room, {})
                    if room not in order:
                        bisect.insort(order, room)
                    rooms[room][content] = rooms[room].get(content, 0) + k - use
            else:
                content, room = (), capacity
                times = min(room // size, left)
                use = left // times
            new, free = content + (size,) * times, room - size * times
            if free not in rooms:
                rooms[free] = {}
                bisect.insort(order, free)
            rooms[free][new] = rooms[free].get(new, 0) + use
            left -= use * times
    return [(k, c) for r in rooms.values() for c, k in r.items()]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Containers of the reduced instance, or of the plain one in the rare case that best-fit does better on it."""
    runs, rest = reduce(counts, capacity)
    return min(runs + best_fit(rest, capacity), best_fit(counts, capacity), key=lambda x: sum(k for k, _ in x))


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """size -> (first rank of each run, first container of the run, its number of containers, how many items of that size)."""
    out: dict[int, tuple[list, list, list]] = {}
    at: dict[int, int] = {}
    first = 1
    for k, content in runs:
        for s in sorted(set(content)):
            for _ in range(content.count(s)):
                r, c, n = out.setdefault(s, ([], [], []))
                r.append(at.get(s, 0))
                c.append(first)
                n.append(k)
                at[s] = at.get(s, 0) + k
        first += k
    return {s: (np.array(r), np.array(c), np.array(n), at[s]) for s, (r, c, n) in out.items()}


def pack(spark: SparkSession, sized: DataFrame, id_col: str = "doc_id", size_col: str = "size", capacity: int = 2048, per: int = 1_000_000) -> DataFrame:
    """(id, piece, size, container): every item's container; an item above the capacity comes as several pieces.

    Such an item fills whole containers of its own and its remainder is packed like an item. Items of size 0 (or null) need no
    room and come with a null container. Ties in size go by id, so the result is the same every time; repeated ids are
    items of their own. An empty table gives an empty one. Items of one size are ranked in parts of about ``per``, so a size that
    a third of all items have is as many tasks as it needs; the driver holds a counter a part.
    """
    ws = Workspace(spark, "packing")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    items = sized.select(F.col(id_col), size.alias("_s"))
    whole = F.floor(F.col("_s") / capacity)
    pieces = items.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_s") / capacity) - 1, F.lit(0))), lambda i: F.when(i < whole, F.lit(capacity)).otherwise(F.col("_s") - i * capacity))).alias("piece", "size"))
    pieces = ws.write(pieces.withColumn("size", F.col("size").cast("int")))
    total = dict(map(tuple, pieces.where("size > 0").groupBy("size").count().collect()))  # at most capacity rows
    base: dict[int, np.ndarray] = {s: np.zeros(-(-n // per), dtype=np.int64) for s, n in total.items()}
    many = [(s, len(b)) for s, b in base.items() if len(b) > 1]
    pieces = pieces.withColumn("salt", F.lit(0))
    if many:
        parts = F.broadcast(spark.createDataFrame(many, "size int, parts int"))
        pieces = pieces.drop("salt").join(parts, "size", "left").withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        for s, t, n in pieces.join(parts, "size", "left_semi").groupBy("size", "salt").count().collect():  # items / per rows
            base[s][t] = n
        for s, _ in many:
            base[s] = np.concatenate([[0], np.cumsum(base[s])[:-1]])
    table = slots(solve(total, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = np.full(len(df), -1, dtype=np.int64)
            for s, rows in df.groupby("size").indices.items():
                if s > 0:
                    part = df.iloc[rows]
                    rank = base[s][part["salt"].to_numpy()] + part["rank"].to_numpy() - 1
                    r, c, _, _ = table[s]
                    run = np.searchsorted(r, rank, side="right") - 1
                    out[rows] = c[run] + rank - r[run]
            yield pd.DataFrame({id_col: df[id_col], "piece": df["piece"], "size": df["size"], "container": out})

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(id_col, "piece")))
    kind = sized.schema[id_col].dataType.simpleString()
    placed = ranked.mapInPandas(place, f"`{id_col}` {kind}, piece int, size int, container bigint")
    return placed.withColumn("container", F.when(F.col("container") >= 0, F.col("container")))
