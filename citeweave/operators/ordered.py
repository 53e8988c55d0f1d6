"""Order-dependent folds over many documents.

Merging, clustering and matching read their lists in order, each row's fate depending on earlier ones. All three are a
greedy choice over a graph under a strict order. A document's edges come to a task sorted (by Spark, which spills) and are
read as a stream that only remembers which rows are taken. A document with more edges than ``solo`` first goes through a
few parallel rounds, joins that settle every row whose fate no earlier one can change any more; what they leave, for an
order made so that one fate hangs on another all along, is streamed like the rest. So the number of jobs is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.runtime import Workspace

#: edges of a document above which rounds come first, and the greatest number of rounds; neither changes a result
SOLO, ROUNDS = 5_000_000, 6


def _same(a, b) -> bool:
    return a == b or a is None and b is None


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, member, seed) of edges sorted by document, b and a."""
    doc, owned, now, first = object(), set(), None, None

    def close(out: list) -> None:
        if now is not None and first is not None:
            owned.add(now)
            out.append((doc, now, first))

    for df in batches:
        out: list = []
        for d, a, b in zip(df["doc_id"], df["a"], df["b"]):
            if not _same(d, doc) or b != now:
                close(out)
                if not _same(d, doc):
                    doc, owned = d, set()
                now, first = b, None
            if first is None and a not in owned:
                first = a
        yield pd.DataFrame(out, columns=["doc_id", "member", "seed"])
    out = []
    close(out)
    yield pd.DataFrame(out, columns=["doc_id", "member", "seed"])


def _hot(live: DataFrame, solo: int) -> DataFrame:
    """Documents with more than ``solo`` edges."""
    return live.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > solo).select("doc_id")


def _parted(live: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the documents in ``hot``, and of the others."""
    return live.join(hot, live["doc_id"].eqNullSafe(hot["doc_id"]), "left_semi"), live.join(hot, live["doc_id"].eqNullSafe(hot["doc_id"]), "left_anti")


def first_seeds(spark: SparkSession, edges: DataFrame, solo: int = SOLO, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, member, seed) of ``edges`` (doc_id, a, b; a < b): the greedy clusters of a pass in ascending order.

    A node is a seed if no earlier seed is its neighbour; every other one belongs to its earliest seed. Seeds that own
    others come out as members of themselves; nodes without edges don't come out. Repeated edges count once.
    """
    ws = Workspace(spark, "seeds")
    live = ws.write(edges.select("doc_id", "a", "b"), n="count(1)")
    if (live.metrics["n"] or 0) > solo:
        hot = ws.write(_hot(live, solo), n="count(1)")
        if hot.metrics["n"]:
            live, rest = _parted(live, hot)
            settled = _seed_rounds(ws, ws.write(live.distinct(), n="count(1)"), solo, rounds)
            live = rest.unionByName(settled)
    owned = live.repartition("doc_id").sortWithinPartitions("doc_id", "b", "a").mapInPandas(_seeds, f"doc_id {edges.schema['doc_id'].dataType.simpleString()}, member bigint, seed bigint")
    owned = ws.write(owned)
    return owned.unionByName(owned.select("doc_id", F.col("seed").alias("member"), "seed").distinct())


def _seed_rounds(ws: Workspace, live: DataFrame, solo: int, rounds: int) -> DataFrame:
    """Edges with the same clusters as ``live`` among which those of settled nodes only lead from seeds to what they own."""
    every, out = live, None
    for _ in range(rounds):
        if live.metrics["n"] <= solo:
            break
        later = live.select("doc_id", F.col("b").alias("x")).distinct()
        top = live.select("doc_id", F.col("a").alias("x")).distinct().join(later, ["doc_id", "x"], "left_anti")
        hit = live.join(top.withColumnRenamed("x", "a"), ["doc_id", "a"], "left_semi").select("doc_id", F.col("b").alias("x")).distinct()
        gone = ws.write(hit)
        out = gone if out is None else out.unionByName(gone)
        # an edge between nodes still open stays; one from a node that is owned says nothing
        new = live.join(gone.withColumnRenamed("x", "a"), ["doc_id", "a"], "left_anti").join(gone.withColumnRenamed("x", "b"), ["doc_id", "b"], "left_anti")
        new = ws.write(new, n="count(1)")
        if live is not every:
            ws.drop(live)
        live = new
    if out is None:
        return live
    # an owned node's edges to later nodes are dropped, its edges from earlier ones kept: the stream reads who owns it
    return every.join(out.withColumnRenamed("x", "a"), ["doc_id", "a"], "left_anti")


def _takes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges, sorted by document and rank, whose ends are both free when their turn comes."""
    doc, left, right = object(), set(), set()
    for df in batches:
        keep = []
        for i, (d, p, g) in enumerate(zip(df["doc_id"], df["pi"], df["gi"])):
            if not _same(d, doc):
                doc, left, right = d, set(), set()
            if p not in left and g not in right:
                left.add(p)
                right.add(g)
                keep.append(i)
        yield df.iloc[keep]


def greedy_pairs(spark: SparkSession, edges: DataFrame, solo: int = SOLO, rounds: int = ROUNDS, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, pi, gi, sim): one-to-one pairs taken by falling sim, then pi, then gi, of ``edges`` with these columns."""
    ws = ws or Workspace(spark, "greedy")
    live = ws.write(edges.select("doc_id", "pi", "gi", "sim"), n="count(1)")
    taken: list[DataFrame] = []
    if (live.metrics["n"] or 0) > solo:
        hot = ws.write(_hot(live, solo), n="count(1)")
        if hot.metrics["n"]:
            live, rest = _parted(live, hot)
            live = ws.write(live.distinct(), n="count(1)")
            rank = F.struct((-F.col("sim")).alias("s"), F.col("pi").alias("p"), F.col("gi").alias("g"))
            for _ in range(rounds):
                if live.metrics["n"] <= solo:
                    break
                # every edge that is first for both its ends is taken
                p = live.groupBy("doc_id", "pi").agg(F.min(rank).alias("bp"))
                g = live.groupBy("doc_id", "gi").agg(F.min(rank).alias("bg"))
                both = ws.write(p.join(g, p["doc_id"].eqNullSafe(g["doc_id"]) & (p["bp"] == g["bg"])).select(p["doc_id"], F.col("bp.p").alias("pi"), F.col("bp.g").alias("gi"), (-F.col("bp.s")).alias("sim")))
                taken.append(both)
                new = ws.write(live.join(both.select("doc_id", "pi"), ["doc_id", "pi"], "left_anti").join(both.select("doc_id", "gi"), ["doc_id", "gi"], "left_anti").select("doc_id", "pi", "gi", "sim"), n="count(1)")
                ws.drop(live)
                live = new
            live = rest.unionByName(live)
    out = live.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("sim"), "pi", "gi").mapInPandas(_takes, edges.select("doc_id", "pi", "gi", "sim").schema)
    for t in taken:
        out = out.unionByName(t)
    return out.select("doc_id", "pi", "gi", "sim")


def first_fit_pairs(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(doc_id, pi, gi): each prediction in order takes its first ground-truth row still free."""
    one = edges.select("doc_id", "pi", "gi", F.lit(1.0).alias("sim"))
    return greedy_pairs(spark, one).select("doc_id", "pi", "gi")
