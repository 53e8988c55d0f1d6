"""Best representative of each duplicate group.

``survivors`` names for each field the record whose value is the most complete, by the rules stated for the project's data;
``fuse`` builds a record by Bayesian fusion with copy detection: sources have an accuracy, false values that two sources
share tell of copying, copied votes count less, and each field takes the value of greatest posterior.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.runtime import Workspace, salted_lookup

UNKNOWN = "unknown"
#: prior of a source's accuracy and its weight in votes; probability that a source copies; false values a field may take
ACCURACY, PRIOR_VOTES, COPY_PRIOR, FALSE_VALUES = 0.8, 10.0, 0.2, 50
#: share of its values that a copier copies; rows up to which a table is broadcast
COPIED, SMALL = 0.8, 20_000
#: a ranked source's prior accuracy: the first rank's, and how much of the way down to ACCURACY each further rank leaves
FIRST_RANK, RANK_STEP = 0.9, 0.5


def _source(c: str):
    """The source as compared: without case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def completeness(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """records plus title_score (letters and digits), pages_score (distinct pages of 1 or more), source_rank (1 is best, null: unknown)."""
    known = ranks.groupBy(_source("source").alias("_rs")).agg(F.min("trust_rank").alias("source_rank"))
    if known.limit(SMALL + 1).count() <= SMALL:  # a reference list; a longer one is left to the planner
        known = F.broadcast(known)
    title = F.coalesce(F.length(F.regexp_replace("title", r"(?U)[^\p{L}\p{Nd}]", "")), F.lit(0))
    pages = F.coalesce(F.size(F.array_distinct(F.filter("page_numbers", lambda p: p >= 1))), F.lit(0))
    scored = records.withColumn("title_score", title).withColumn("pages_score", F.when(F.col("page_numbers").isNull(), 0).otherwise(pages)).withColumn("_key", _source("source"))
    return scored.join(known, scored["_key"] == known["_rs"], "left").drop("_rs", "_key")


def survivors(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """(cluster_id, title_id, pages_id, source_id): the record to take each field from.

    Most letters and digits; most distinct pages of 1 or more; least trust rank, unknown and null sources last; among equals
    the latest extracted_at (null last), then the least cand_id. A cluster whose values are all null or empty has equals only. Map-side
    combined maxima, so a cluster of any size moves one row a task. A null cluster_id is a cluster. Other columns are ignored.
    """
    r = completeness(records.select("cluster_id", "cand_id", "title", "page_numbers", "source", "extracted_at"), ranks)
    late = F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(-(2**63) + 1))

    def best(score):
        return F.max_by("cand_id", F.struct(score, late, -F.col("cand_id")))

    rank = -F.coalesce(F.col("source_rank"), F.lit(2**31 - 1))
    return r.groupBy("cluster_id").agg(best(F.col("title_score")).alias("title_id"), best(F.col("pages_score")).alias("pages_id"), best(rank).alias("source_id"))


def _values(records: DataFrame) -> DataFrame:
    """(cluster_id, field, value, source, n, complete, late): distinct non-empty claims, copies by one source collapsed with their count and latest time.

    As to the field source, every source but an unknown one claims itself.
    """
    src = F.coalesce(F.nullif(_source("source"), F.lit("")), F.lit(UNKNOWN))
    title = F.nullif(F.regexp_replace(F.lower("title"), r"(?U)[^\p{L}\p{Nd}]", ""), F.lit(""))
    pages = F.array_sort(F.array_distinct(F.filter("page_numbers", lambda p: p >= 1)))
    kind = F.nullif(F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", "")), F.lit(""))
    claim = F.explode(
        F.array(
            F.struct(F.lit("title").alias("field"), title.alias("value"), F.length(title).alias("complete")),
            F.struct(F.lit("page_numbers").alias("field"), F.nullif(F.array_join(pages, ","), F.lit("")).alias("value"), F.size(pages).alias("complete")),
            F.struct(F.lit("type").alias("field"), kind.alias("value"), F.lit(0).alias("complete")),
            F.struct(F.lit("source").alias("field"), F.nullif(src, F.lit(UNKNOWN)).alias("value"), F.lit(0).alias("complete")),
        )
    ).alias("c")
    return (
        records.select("cluster_id", src.alias("source"), F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("at"), claim).select("cluster_id", "source", "at", "c.*").where("value IS NOT NULL")
        .groupBy("cluster_id", "field", "value", "source").agg(F.count("*").alias("n"), F.max("complete").alias("complete"), F.max("at").alias("late"))
    )


def _known(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """rows with what ``table`` (n rows, one a key) says of their key; broadcast if it is small by count, else salted."""
    if n <= SMALL:
        return rows.join(F.broadcast(table), key)
    return salted_lookup(rows, table, key, rows.groupBy(key).agg(F.count("*").alias("_n")), "_n")


def fuse(spark: SparkSession, records: DataFrame, ranks: DataFrame, rounds: int = 20, settled: float = 0.002) -> DataFrame:
    """(cluster_id, title, page_numbers, type, source, confidence of each): one built record a cluster.

    Values are compared in canonical form and come out as their longest spelling in that form; a field without any value is null with null
    confidence; a null cluster_id is a cluster. Rounds go on until no source's accuracy moves by ``settled``: (1) dependence of each two
    sources, log-odds added up over all values they share, weighed by how likely these are false, and over the facts in which
    they differ; (2) a source's vote for a value weighs the log-odds of its accuracy, less for each more accurate source it may
    have copied the value from; (3) posteriors of the values; (4) accuracies, with the trust rank as prior. Sources are compared by the sets that name a value, so the values of a
    cluster aren't paired. Ties in posterior go to the more complete, then the later extracted, then the greater value.
    A record's source is the field no two sources agree on, so it tells nothing of accuracy or copying; it takes the source
    whose accuracy and independence, as the other fields show, weigh most.
    """
    ws = Workspace(spark, "fusion")
    cf = F.concat(F.coalesce(F.col("cluster_id").cast("string"), F.lit("")), F.lit("|"), "field").alias("cf")
    claims = ws.write(_values(records).select(cf, "*"))
    facts = claims.where("field <> 'source'")
    known = ranks.groupBy(_source("source").alias("source")).agg(F.min("trust_rank").alias("rank"))
    trust = F.lit(ACCURACY) + (FIRST_RANK - ACCURACY) * F.pow(F.lit(RANK_STEP), F.col("rank") - 1)
    accuracy = ws.write(claims.select("source").distinct().join(known, "source", "left").select("source", F.coalesce(trust, F.lit(ACCURACY)).alias("prior")).withColumn("a", F.col("prior")), n="count(1)")
    n = accuracy.metrics["n"] or 0
    pair = lambda c: F.explode(F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: y["source"] > x["source"]), lambda y: F.struct(x["source"].alias("s"), y["source"].alias("t"), F.least(x["m"], y["m"]).alias("m"))))))
    # each two sources that name one value; and of how many facts both say something
    one = F.struct("source", F.lit(1).cast("bigint").alias("m"))
    shared = ws.write(facts.groupBy("cf", "value").agg(F.collect_set(one).alias("by")).where(F.size("by") > 1).select("cf", "value", pair("by").alias("p")).select("cf", "value", "p.s", "p.t"))
    met = facts.groupBy("cf", "source").agg(F.count("*").alias("m")).groupBy("cf").agg(F.collect_list(F.struct("source", "m")).alias("by")).select(pair("by").alias("p"))
    met = ws.write(met.groupBy("p.s", "p.t").agg(F.sum("p.m").alias("both")), n="count(1)")
    pairs = met.metrics["n"] or 0
    st = F.concat(F.length("s").cast("string"), F.lit("|"), "s", "t").alias("st")
    post = dep = chance = None
    for _ in range(rounds):
        # what two sources share, by how likely it is true, against what they differ in
        judged = shared.withColumn("p", F.lit(None).cast("double")) if post is None else shared.join(chance, ["cf", "value"])
        both = judged.groupBy("s", "t").agg(F.sum("p").alias("kt"), F.sum(1 - F.col("p")).alias("kf"), F.count("*").alias("k"))
        both = met.join(both, ["s", "t"], "left").select("s", "t", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("kt", "kf", "k", "both")]).withColumn("kd", F.greatest(F.lit(0.0), F.col("both") - F.col("k")))
        rated = accuracy.select("source", "a")
        both = _known(both, rated.select(F.col("source").alias("s"), F.col("a").alias("x")), "s", n)
        both = _known(both, rated.select(F.col("source").alias("t"), F.col("a").alias("y")), "t", n)
        pt, pf, c = F.col("x") * F.col("y"), (1 - F.col("x")) * (1 - F.col("y")) / FALSE_VALUES, COPIED
        best = F.greatest("x", "y")
        told = F.col("kt") * F.log(pt / (c * best + (1 - c) * pt)) + F.col("kf") * F.log(pf / (c * (1 - best) + (1 - c) * pf))
        if post is None:  # nothing is known of the values yet: what two share may be true or false
            told = F.col("k") * F.log((pt + pf) / (c + (1 - c) * (pt + pf)))
        odds = F.log(F.lit((1 - COPY_PRIOR) / COPY_PRIOR)) + told - F.col("kd") * F.log(F.lit(1 - c))
        copier = F.when(F.col("x") < F.col("y"), F.col("s")).otherwise(F.col("t"))
        before = dep
        dep = ws.write(both.select("s", "t", copier.alias("copier"), (1 / (1 + F.exp(F.least(F.greatest(odds, F.lit(-50.0)), F.lit(50.0))))).alias("dep")))
        score = F.log(F.col("a") * FALSE_VALUES / (1 - F.col("a")))
        votes = _known(claims, accuracy.select("source", "a"), "source", n).withColumn("v", score)
        # the less accurate of two that name a value may have copied it
        copied = _known(shared.select("*", st), dep.select(st, "copier", "dep"), "st", pairs)
        copied = copied.groupBy("cf", "value", F.col("copier").alias("source")).agg(F.exp(F.sum(F.log(1 - F.col("dep") * COPIED))).alias("w"))
        votes = votes.join(copied, ["cf", "value", "source"], "left").withColumn("v", F.col("v") * F.coalesce("w", F.lit(1.0)))
        votes = votes.groupBy("cf", "cluster_id", "field", "value").agg(F.least(F.sum("v"), F.lit(600.0)).alias("v"), F.max("complete").alias("complete"), F.max("late").alias("late"))
        votes = ws.write(votes)
        # values that nobody names are as likely as one named without any weight
        total = votes.groupBy("cf").agg(F.sum(F.exp("v")).alias("z"), F.count("*").alias("k"))
        weighed = salted_lookup(votes, total, "cf", total, "k")
        last, post = post, ws.write(weighed.withColumn("p", F.round(F.exp("v") / (F.col("z") + F.greatest(F.lit(0), FALSE_VALUES + 1 - F.col("k"))), 9)).drop("z", "k", "v"))
        ws.drop(votes, *([last] if last is not None else []))
        chance = post.where("field <> 'source'").select("cf", "value", "p")
        seen = facts.join(chance, ["cf", "value"]).groupBy("source").agg(F.sum("p").alias("right"), F.count("*").alias("of"))
        a = (F.coalesce("right", F.lit(0.0)) + F.col("prior") * PRIOR_VOTES) / (F.coalesce("of", F.lit(0)) + PRIOR_VOTES)
        new = accuracy.select("source", "prior", F.col("a").alias("old")).join(seen, "source", "left").select("source", "prior", "old", F.least(F.greatest(a, F.lit(0.05)), F.lit(0.99)).alias("a"))
        new = ws.write(new, moved="max(abs(a - old))")
        ws.drop(accuracy)
        accuracy = new
        if before is not None:
            ws.drop(before)
        if (new.metrics["moved"] or 0) < settled:
            break
    best = post.groupBy("cluster_id", "field").agg(F.max_by(F.struct("value", "p"), F.struct("p", "complete", "late", "value")).alias("b"))
    spelled = records.select("cluster_id", "title", F.nullif(F.regexp_replace(F.lower("title"), r"(?U)[^\p{L}\p{Nd}]", ""), F.lit("")).alias("value")).where("value IS NOT NULL")
    spelled = spelled.groupBy("cluster_id", "value").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("title"))
    wide = best.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.col("b"))).alias(f) for f in ("title", "page_numbers", "type", "source")])
    every = records.select("cluster_id").distinct()
    out = every.join(wide.withColumnRenamed("title", "t"), every["cluster_id"].eqNullSafe(wide["cluster_id"]), "left").drop(wide["cluster_id"]).withColumn("value", F.col("t.value"))
    same = out["cluster_id"].eqNullSafe(spelled["cluster_id"]) & (out["value"] == spelled["value"])
    out = out.join(spelled, same, "left").select(out["*"], spelled["title"])
    return out.select(
        "cluster_id", "title", F.transform(F.split("page_numbers.value", ","), lambda x: x.cast("int")).alias("page_numbers"), F.col("type.value").alias("type"), F.col("source.value").alias("source"),
        F.round("t.p", 6).alias("title_confidence"), F.round("page_numbers.p", 6).alias("pages_confidence"), F.round("type.p", 6).alias("type_confidence"), F.round("source.p", 6).alias("source_confidence"),
    )
