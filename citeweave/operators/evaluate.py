"""Scoring against annotated ground truth."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citeweave.operators.ordered import first_fit_pairs, greedy_pairs
from citeweave.operators.similarity import duplicate_edges, equal_pairs, similarity_edges
from citeweave.runtime import Workspace, freeing
from citeweave.schemas import Settings

#: pairs of rows of a document above which matching goes down by these similarities; neither changes a result
MANY, BANDS = 2_000_000_000, (0.9, 0.82)
#: added to the places of a later list of predictions matched along with the first
RUN = 1 << 48


@F.pandas_udf(DoubleType())
def rounded(x: pd.Series) -> pd.Series:
    """Three places as Python rounds: by the exact binary value, true ties (like 0.0625) to the even neighbour. A row a document at most."""
    return x.map(lambda v: round(v, 3))


def scores(tp: Column, predicted: Column, truth: Column) -> list[Column]:
    """precision, recall, f1 (three places), tp, fp, fn; all of them 0 where there is no ground truth."""
    p, r = F.coalesce(F.try_divide(tp.cast("double"), predicted), F.lit(0.0)), F.coalesce(F.try_divide(tp.cast("double"), truth), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    given = truth > 0
    real = [F.when(given, rounded(x)).otherwise(0.0).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", f1))]
    return real + [F.when(given, x).otherwise(0).cast("bigint").alias(n) for n, x in (("tp", tp), ("fp", predicted - tp), ("fn", truth - tp))]


def match(spark: SparkSession, predicted: DataFrame | list[DataFrame], truth: DataFrame, s: Settings = Settings(), fuzzy: bool = True, many: int = MANY) -> DataFrame:
    """(doc_id, pi, gi, sim): greedy one-to-one matching within documents, by falling similarity, then order. Equal titles first, by rank.

    The ratio's pairs of a large document grow with the square of its titles, but a row that is taken needs no others. So where a document
    may have more than ``MANY``, pairs are made from one similarity down to the next, each time of the rows still free.
    Several lists of predictions are each matched with the whole truth, but titles that several share are compared once; pi and gi of the
    k-th list have k * 2 ** 48 added.
    """
    ws = Workspace(spark, "match")
    runs = predicted if isinstance(predicted, list) else [predicted]
    tagged = [[t.withColumns({c: F.col(c) + k * RUN for c in ("pi", "gi", "seq", "gt_seq") if c in t.columns}) for t in equal_pairs(ws, r, truth)] for k, r in enumerate(runs)]
    equal, p, g = (reduce(DataFrame.unionByName, t) for t in zip(*tagged))
    run = lambda c: F.shiftright(c, 48)
    apart = lambda e: e.where(run("pi") == run("gi")) if len(runs) > 1 else e
    if not fuzzy:
        return greedy_pairs(spark, apart(similarity_edges(p, g, s, fuzzy))).unionByName(equal)
    size = lambda t, c: t.groupBy("doc_id", run(c).alias("run")).agg(F.count("*").alias("n"))
    most = size(p, "seq").join(size(g, "gt_seq").withColumnRenamed("n", "m"), ["doc_id", "run"]).agg(F.max(F.col("n") * F.col("m"))).first()[0] or 0
    for least in [b for b in BANDS if b > s.match_threshold] if most > many else []:
        band = Workspace(spark, "band")
        taken = ws.write(greedy_pairs(spark, apart(similarity_edges(p, g, replace(s, match_threshold=least), ws=band)), ws=band), n="count(1)")
        band.clear()
        equal = equal.unionByName(taken)
        if taken.metrics["n"]:
            left = [ws.write(t.join(taken.select("doc_id", F.col(k).alias(c)), ["doc_id", c], "left_anti")) for t, k, c in ((p, "pi", "seq"), (g, "gi", "gt_seq"))]
            ws.drop(p, g)
            p, g = left
    return greedy_pairs(spark, apart(similarity_edges(p, g, s))).unionByName(equal)


def metrics(spark: SparkSession, predicted: DataFrame, truth: DataFrame, s: Settings = Settings(), by_doc: bool = False, fuzzy: bool = True) -> DataFrame:
    """Precision, recall and F1 by greedy one-to-one matching within documents; one row, or one a document."""
    return _scored(match(spark, predicted, truth, s, fuzzy), predicted, truth, by_doc)


def metrics_of_runs(spark: SparkSession, runs: dict[str, DataFrame], truth: DataFrame, s: Settings = Settings(), fuzzy: bool = True) -> dict[str, DataFrame]:
    """``metrics`` of several lists of predictions for the same truth."""
    ws = Workspace(spark, "runs")
    with freeing(spark):
        pairs = ws.write(match(spark, list(runs.values()), truth, s, fuzzy))
    return {name: _scored(pairs.where(F.shiftright("pi", 48) == k), r, truth) for k, (name, r) in enumerate(runs.items())}


def _scored(pairs: DataFrame, predicted: DataFrame, truth: DataFrame, by_doc: bool = False) -> DataFrame:
    keys = ["doc_id"] if by_doc else []
    counted = (
        pairs.select("doc_id", F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("g"))
        .unionByName(predicted.select("doc_id", F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("g")))
        .unionByName(truth.select("doc_id", F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("g")))
        .groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "tpg"])
    )
    return counted.select(*keys, *scores(F.col("t"), F.col("p"), F.col("g")))


def errors(spark: SparkSession, predicted: DataFrame, truth: DataFrame, s: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """(doc_id, kind, pos, title, type): kind is missed, false_positive, correct or llm_unique, by first-fit matching in order."""
    pairs = first_fit_pairs(spark, duplicate_edges(predicted, truth, "seq", "gt_seq", s, fuzzy))
    row = lambda df, kind, pos: df.select("doc_id", F.lit(kind).alias("kind"), F.col(pos).alias("pos"), "title", "type")
    hit = pairs.select("doc_id", F.col("pi").alias("seq"))
    return (
        row(truth.join(pairs.select("doc_id", F.col("gi").alias("gt_seq")), ["doc_id", "gt_seq"], "left_anti"), "missed", "gt_seq")
        .unionByName(row(predicted.join(hit, ["doc_id", "seq"], "left_anti"), "false_positive", "seq"))
        .unionByName(row(predicted.join(hit, ["doc_id", "seq"], "left_semi"), "correct", "seq"))
        .unionByName(row(predicted.where(F.col("source") == "llm"), "llm_unique", "seq"))
    )


def missed_listing(predicted: DataFrame, truth: DataFrame, s: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """Ground-truth rows that no prediction is similar to (not one-to-one, so fewer than ``fn`` at times)."""
    return truth.join(similarity_edges(predicted, truth, s, fuzzy).select("doc_id", F.col("gi").alias("gt_seq")).distinct(), ["doc_id", "gt_seq"], "left_anti")


def matched_sample(predicted: DataFrame, truth: DataFrame, n: int = 10, s: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """The first ``n`` predictions that duplicate any ground-truth row."""
    hit = duplicate_edges(predicted, truth, "seq", "gt_seq", s, fuzzy).select("doc_id", F.col("pi").alias("seq")).distinct()
    return predicted.join(hit, ["doc_id", "seq"], "left_semi").orderBy("doc_id", "seq").limit(n)


def comparison(runs: dict[str, DataFrame]) -> DataFrame:
    """(method, precision, recall, f1, found) of one-row metrics, and the difference of the last method to the first."""
    out = None
    for name, m in runs.items():
        row = m.select(F.lit(name).alias("method"), "precision", "recall", "f1", (F.col("tp") + F.col("fp")).alias("found"))
        out = row if out is None else out.unionByName(row)
    first, last = next(iter(runs)), list(runs)[-1]
    pick = lambda c, m: F.max(F.when(F.col("method") == m, F.col(c)))
    diff = out.agg(*[(pick(c, last) - pick(c, first)).alias(c) for c in ("precision", "recall", "f1", "found")]).select(F.lit("difference").alias("method"), *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "found")
    return out.unionByName(diff)
