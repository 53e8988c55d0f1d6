"""Sinks: distributed JSON lines, one result file of a document, console listing, history tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.extract import stats

_FIELDS = ["title", "type", "page_numbers", "source"]


def write_lines(refs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line a reference, written in parallel: the sink for many documents."""
    refs.write.mode(mode).json(path)


def write_result(refs: DataFrame, path: str) -> dict:
    """{references, stats} of one document as one JSON file, indented, as the command line writes it."""
    rows = [r.asDict(recursive=True) for r in refs.orderBy("seq").select(*_FIELDS).toLocalIterator()]
    out = {"references": rows, "stats": stats(refs).first().asDict()}
    Path(path).write_text(json.dumps(out, indent=2))
    return out


def listing(refs: DataFrame) -> DataFrame:
    """(doc_id, type, n, entries): references grouped by type, types in order; the source is named unless it is ``both``."""
    tag = F.when(F.col("source") != "both", F.concat(F.lit(" ["), F.col("source"), F.lit("]"))).otherwise("")
    line = F.concat(F.col("title"), F.lit(" | pages "), F.coalesce(F.array_join("page_numbers", ", "), F.lit("")), F.coalesce(tag, F.lit("")))
    return refs.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]).alias("entries")).orderBy("doc_id", "type")


def lines(df: DataFrame, out=print) -> None:
    """Every row, tab-separated under its column names, a partition at a time: a report is never cut."""
    out("\t".join(df.columns))
    for row in df.toLocalIterator():
        out("\t".join("" if v is None else "\n  ".join(["", *v]) if isinstance(v, list) else str(v) for v in row))


def history_table(spark: SparkSession, history: list[dict]) -> DataFrame:
    """The rows of a search's history, metrics as columns of their own."""
    flat = [{k: v for k, v in h.items() if k != "metrics"} | h.get("metrics", {}) for h in history]
    return spark.createDataFrame(flat) if flat else spark.createDataFrame([], "iteration int")
