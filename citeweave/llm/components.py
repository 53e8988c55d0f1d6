"""Connected components of match pairs over billions of edges.

Method: strip degree-one vertices and compress degree-two chains by list ranking until little is left, solve the reduced
core by alternating star contractions, then hand the labels back to the removed vertices in reverse order.

Every step is a distributed join or aggregation; nothing is collected but row counts. Between steps tables are written to
the shared checkpoint folder, so the loss of an executor only repeats one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.runtime import Workspace, salted_lookup


def links(pairs: DataFrame, a: str, b: str, sim: str | None = None, threshold: float = 0.75) -> DataFrame:
    """Distinct undirected links (u < v). Null ids, self pairs and, with ``sim``, null (or NaN) or low scores aren't links."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    if sim:
        ok = ok & F.col(sim).isNotNull() & ~F.isnan(F.col(sim).cast("double")) & (F.col(sim) >= threshold)
    return pairs.where(ok).select(F.least(a, b).cast("bigint").alias("u"), F.greatest(a, b).cast("bigint").alias("v")).distinct()


def _both(e: DataFrame) -> DataFrame:
    """Arcs: each link in both directions."""
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("t")), F.struct(F.col("v").alias("s"), F.col("u").alias("t")))).alias("_")).select("_.*")


_N = {"n": "count(1)"}


def _strip(ws: Workspace, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of taking leaves off. Returns (links left, removed(v, parent))."""
    deg = _both(e).groupBy("s").agg(F.count("*").alias("d"), F.min("t").alias("only"))
    leaf = deg.where("d = 1").select(F.col("s").alias("v"), F.col("only").alias("parent"))
    # of two leaves linked with each other the smaller stays, without links: their link would come twice, the smaller's turn is dropped
    other = leaf.select(F.col("v").alias("parent"), F.lit(True).alias("leaf"))
    gone = ws.write(leaf.join(other, "parent", "left").where("leaf IS NULL OR parent < v").select("v", "parent"))
    rest = ws.write(e.join(gone.select(F.col("v").alias("u")), "u", "left_anti").join(gone.select("v"), "v", "left_anti").select("u", "v"), **_N)
    return rest, gone


def _compress(ws: Workspace, e: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Replaces each chain of degree-two vertices by one link between its ends, by pointer doubling on arcs (list ranking).

    Returns (links left, removed(v, parent)) or None if no two vertices of degree two are neighbours.
    """
    two = _both(e).groupBy("s").agg(F.count("*").alias("d"), F.min("t").alias("n1"), F.max("t").alias("n2")).where("d = 2").select(F.col("s").alias("v"), "n1", "n2")
    # the arc s -> t, t of degree two, goes on as t -> its other neighbour
    arc2 = two.select(F.explode(F.array(F.struct(F.col("n1").alias("s"), F.col("v").alias("t"), F.col("n2").alias("nt")), F.struct(F.col("n2").alias("s"), F.col("v").alias("t"), F.col("n1").alias("nt")))).alias("_")).select("_.*")
    # state of an arc (s, t): the arc (ps, pt) reached so far, least inner vertex seen, whether it has come to an end
    inner = two.select(F.col("v").alias("nt"), F.lit(True).alias("_in"))
    state = ws.write(
        arc2.join(inner, "nt", "left").select("s", "t", F.col("t").alias("ps"), F.col("nt").alias("pt"), F.col("t").alias("low"), F.col("_in").isNull().alias("done"), F.lit(False).alias("moved")),
        open="count_if(NOT done)",
    )
    if not state.metrics["open"]:
        ws.drop(state)
        return None
    while True:
        nxt = state.select(F.col("s").alias("ps"), F.col("t").alias("pt"), F.col("ps").alias("qs"), F.col("pt").alias("qt"), F.col("low").alias("qlow"), F.col("done").alias("qdone"))
        # an arc in a cycle of degree-two vertices never ends; the cycle has been seen whole once no arc's successor knows of less
        new = ws.write(
            state.drop("moved").join(nxt, ["ps", "pt"], "left").select(
                "s", "t",
                F.when(F.col("done"), F.col("ps")).otherwise(F.col("qs")).alias("ps"), F.when(F.col("done"), F.col("pt")).otherwise(F.col("qt")).alias("pt"),
                F.when(F.col("done"), F.col("low")).otherwise(F.least("low", "qlow")).alias("low"), (F.col("done") | F.col("qdone")).alias("done"),
                (~F.col("done") & ((F.col("qlow") < F.col("low")) | F.col("qdone"))).alias("moved"),
            ),
            moved="count_if(moved)",
        )
        ws.drop(state)
        state = new
        if not state.metrics["moved"]:
            break
    # chains: both arcs into v have ended, at the two ends, and v goes under the smaller one; cycles: all go under their
    # least vertex, which stays without links
    at = state.groupBy(F.col("t").alias("v")).agg(F.first("done").alias("done"), F.min(F.when(F.col("done"), F.col("pt")).otherwise(F.col("low"))).alias("parent"), F.max("pt").alias("far"))
    ends = ws.write(at)
    removed = ends.where("done OR v <> parent").select("v", "parent")
    kept = e.join(ends.select(F.col("v").alias("u")), "u", "left_anti").join(ends.select("v"), "v", "left_anti").select("u", "v")
    shortcut = ends.where("done AND parent <> far").select(F.col("parent").alias("u"), F.col("far").alias("v"))
    rest = ws.write(kept.unionByName(shortcut).distinct(), **_N)
    ws.drop(state)
    return rest, removed


def _core(ws: Workspace, e: DataFrame) -> DataFrame:
    """Least vertex reachable from each vertex that has links: large-star and small-star in turn until nothing changes."""
    before = None
    while True:
        # large-star: each larger neighbour goes under the least of the closed neighbourhood
        arcs = _both(e)
        low = arcs.groupBy("s").agg(F.least(F.min("t"), F.col("s")).alias("m"))
        large = ws.write(arcs.where("t > s").join(low, "s").select(F.col("t").alias("v"), F.col("m").alias("u")).where("u <> v").distinct())
        # small-star: each vertex hands its smaller neighbours to the least of them
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("_")).select("_.u", "_.v").where("u <> v").distinct()
        new = ws.write(small, **_N, us="sum(cast(u AS decimal(38, 0)))", mark="sum(cast(xxhash64(u, v) AS decimal(38, 0)))")
        ws.drop(large)
        ws.drop(e)
        e = new
        if e.metrics == before:
            return e.select("v", F.col("u").alias("parent"))
        before = e.metrics


def connected_components(spark: SparkSession, pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """(v, label): every vertex of ``pairs`` (u, v: distinct links, u < v) with the least vertex reachable from it.

    ``rounds`` bounds how often leaves and chains are taken off before the core is solved; the core solver is exact for
    whatever is left, so the parameter changes speed, not the result. Empty pairs give an empty table.
    """
    ws = Workspace(spark, "components")
    e = ws.write(pairs.select("u", "v"), **_N)
    removed: list[DataFrame] = []
    for _ in range(rounds):
        n = e.metrics["n"]
        if not n:
            break
        left, gone = _strip(ws, e)
        removed.append(gone)
        ws.drop(e)
        e = left
        if e.metrics["n"] and (out := _compress(ws, e)) is not None:
            ws.drop(e)
            e, gone = out
            removed.append(gone)
        if e.metrics["n"] > 0.9 * n:
            break
    label = _core(ws, e).select("v", F.col("parent").alias("root")) if e.metrics["n"] else e.select("v", F.col("u").alias("root"))
    # Hand labels back, the last removed first. A parent without a label of its own is a root so far. A removed vertex may be
    # smaller than its root, so the least id is looked up at the end.
    for gone in reversed(removed):
        got = gone.join(label.select(F.col("v").alias("parent"), F.col("root").alias("r")), "parent", "left").select("v", F.coalesce("r", "parent").alias("root"))
        label = ws.write(label.unionByName(got))
    every = label.unionByName(label.select(F.col("root").alias("v"), "root")).distinct()
    every = ws.write(every, n="count(1)")
    least = ws.write(every.groupBy("root").agg(F.min("v").alias("label"), F.count("*").alias("n")), top="max(n)")
    if (least.metrics["top"] or 0) > max(10_000, (every.metrics["n"] or 0) / 512):  # a component of that share is one key
        return salted_lookup(every, least.select("root", "label"), "root", least.select("root", "n"), "n").select("v", "label")
    return every.join(least.drop("n"), "root").select("v", "label")


def groups(spark: SparkSession, pairs: DataFrame, a: str = "pi", b: str = "gi", sim: str | None = "sim", threshold: float = 0.75) -> DataFrame:
    """(rec_id, group_id): every record with a link, and the least record reachable over links.

    Rows of ``pairs`` with a null id or score, a score under ``threshold`` or two equal ids aren't links; repeated and
    reversed rows count once; other columns are ignored whatever their names.
    """
    return connected_components(spark, links(pairs, a, b, sim, threshold)).select(F.col("v").alias("rec_id"), F.col("label").alias("group_id"))
