"""Merging of reference lists and collapse of duplicates, on top of the ordered choice in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.ordered import first_seeds
from citeweave.operators.similarity import duplicate_edges, first_edges
from citeweave.runtime import Workspace, freeing, numbered
from citeweave.schemas import Settings


def _listed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists as one: ``n`` puts a document's rows in order, those of the first list before those of the second."""
    both = first.withColumn("_l", F.lit(0)).unionByName(second.withColumn("_l", F.lit(1)))
    return both.withColumn("n", F.col("_l").cast("bigint") * (1 << 48) + F.col("seq"))


def _seeds(spark: SparkSession, rows: DataFrame, seq: str, s: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """(doc_id, member, seed): ``first_seeds`` of the duplicates among ``rows``; a row alone may not come out.

    Rows of one title go where the first of them goes: whatever seed that one has comes before them too, and if it is a seed
    itself, no earlier one is theirs. So only first rows are held against each other, and no other row is a seed.
    The tables of titles are freed.
    """
    ws = Workspace(spark, "led")
    with freeing(spark):
        edges, others = first_edges(spark, rows, seq, s, fuzzy)
        seeds = ws.write(first_seeds(spark, edges.select("doc_id", F.col("gi").alias("a"), F.col("pi").alias("b"))))
        led = others.join(seeds.withColumnRenamed("member", "seq"), ["doc_id", "seq"], "left")
        led = ws.write(led.select("doc_id", F.col("other").alias("member"), F.coalesce("seed", "seq").alias("seed")))
    # a first row that leads only rows of its own title comes out by itself, too
    return seeds.unionByName(led).unionByName(led.select("doc_id", F.col("seed").alias("member"), "seed").distinct().join(seeds, ["doc_id", "member"], "left_anti"))


def _absorbed(spark: SparkSession, both: DataFrame, s: Settings, fuzzy: bool) -> DataFrame:
    """both with ``seed``: the row that a row of the second list goes into (itself if none)."""
    old, new = both.where("_l = 0"), both.where("_l = 1")
    # rows of the first list stay, so a new one goes into the first that it duplicates and says nothing to later ones
    across = duplicate_edges(new, old, "n", "n", s, fuzzy, first=True)
    across = Workspace(spark, "across").write(across.groupBy("doc_id", F.col("pi").alias("member")).agg(F.min("gi").alias("seed")))
    free = new.join(across.withColumnRenamed("member", "n"), ["doc_id", "n"], "left_anti")
    seeds = _seeds(spark, free, "n", s, fuzzy).unionByName(across)
    return both.join(seeds.withColumnRenamed("member", "n"), ["doc_id", "n"], "left").withColumn("seed", F.coalesce("seed", "n"))


def _renumbered(df: DataFrame, order: str) -> DataFrame:
    return numbered(Workspace(df.sparkSession, "numbers"), df.withColumnRenamed("seq", "_old") if "seq" in df.columns else df, ["doc_id"], [order], "seq")


def _pages_in_order():
    """Distinct pages in order of rows, the first row's own list first."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("n", "page_numbers"))), lambda x: F.coalesce(x["page_numbers"], F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(lists))


def merge_first_match(spark: SparkSession, existing: DataFrame, found: DataFrame, s: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """existing, enriched by ``found``: each found reference goes into the first entry it duplicates, or is appended.

    An entry that took one in has source ``both`` and the pages of all. Appended entries take in later ones like the others.
    """
    rows = _absorbed(spark, _listed(existing, found), s, fuzzy)
    head = F.min_by(F.struct("title", "type", "source"), "n").alias("h")
    out = rows.groupBy("doc_id", "seed").agg(head, F.count("*").alias("k"), _pages_in_order().alias("page_numbers"))
    out = out.select("doc_id", "seed", "h.title", "h.type", "page_numbers", F.when(F.col("k") > 1, "both").otherwise(F.col("h.source")).alias("source"))
    return _renumbered(out, "seed").select("doc_id", "seq", "title", "type", "page_numbers", "source")


def merge_new_only(spark: SparkSession, existing: DataFrame, found: DataFrame, s: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """existing, with those of ``found`` appended that duplicate nothing before them; entries aren't changed."""
    rows = _absorbed(spark, _listed(existing, found), s, fuzzy).where("seed = n")
    return _renumbered(rows, "n").select("doc_id", "seq", "title", "type", "page_numbers", "source")


def seed_clusters(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """refs with ``seed``, the seq of their cluster's first row: a seed takes in every later free row one of whose titles holds the other."""
    return clustered(spark, refs).drop("alone")


def clustered(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """``seed_clusters`` with ``alone``, whether a row is a cluster by itself."""
    seeds = _seeds(spark, refs, "seq", fuzzy=False)
    rows = refs.join(seeds.withColumnRenamed("member", "seq"), ["doc_id", "seq"], "left")
    return rows.withColumn("alone", F.col("seed").isNull()).withColumn("seed", F.coalesce("seed", "seq"))


def collapse(clustered: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One row a cluster: longest title (the earliest of equals) and its type, pages sorted, source both if sources differ.

    A cluster of one row stays as it is, its pages unsorted; rows told to be ``alone`` aren't moved to find that out.
    ``chosen`` (doc_id, seed, title, pages) overrides title and adds pages.
    """
    alone = None
    if "alone" in clustered.columns:
        alone, clustered = clustered.where("alone"), clustered.where("NOT alone")
    longest = F.max_by(F.struct("title", "type"), F.struct(F.length("title"), -F.col("seq"))).alias("best")
    every = F.flatten(F.collect_list(F.coalesce("page_numbers", F.array().cast("array<int>"))))
    out = clustered.groupBy("doc_id", "seed").agg(
        F.count("*").alias("k"), longest, F.array_sort(F.array_distinct(every)).alias("sorted"), F.min_by("page_numbers", "seq").alias("own"), F.collect_set("source").alias("sources"),
    )
    title, pages = F.col("best.title"), F.col("sorted")
    if chosen is not None:
        out = out.join(chosen.select("doc_id", "seed", F.col("title").alias("_t"), F.col("pages").alias("_p")), ["doc_id", "seed"], "left")
        title, pages = F.coalesce(F.nullif(F.col("_t"), F.lit("")), title), F.array_sort(F.array_union(pages, F.coalesce("_p", F.array().cast("array<int>"))))
    out = out.select(
        "doc_id", "seed", F.when(F.col("k") > 1, title).otherwise(F.col("best.title")).alias("title"), F.col("best.type").alias("type"),
        F.when(F.col("k") > 1, pages).otherwise(F.col("own")).alias("page_numbers"), F.when(F.size("sources") > 1, "both").otherwise(F.get("sources", F.lit(0))).alias("source"),
    )
    if alone is not None:
        out = out.unionByName(alone.select(*out.columns))
    return _renumbered(out, "seed").select("doc_id", "seq", "title", "type", "page_numbers", "source")
