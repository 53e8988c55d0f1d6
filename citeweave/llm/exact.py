"""Duplicates hidden by formatting: byte-identical rows first, canonical text on the survivors, then one more grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeweave.llm.titles import canonical
from citeweave.runtime import Workspace, salted_lookup, tasks


@F.pandas_udf(StringType())
def canonical_text(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in titles:
        yield t.map(canonical, na_action="ignore")


def raw_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, n, low, high): byte-identical texts collapsed map-side first, with their count, least and greatest id. Blank texts are left out."""
    return (
        rows.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S"))
        .groupBy(F.col(text_col).alias("text"))
        .agg(F.count("*").alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high"))
        .repartition(tasks(rows.sparkSession), "text")
    )


def distinct_titles(rows: DataFrame, id_col: str = "rec_id", text_col: str = "title") -> DataFrame:
    """(canon, n, low, variants): one row a distinct title, its number of copies, least id and number of spellings.

    Null and blank texts name nothing and are left out; an empty table gives an empty one.
    """
    return (
        raw_groups(rows, id_col, text_col)
        .withColumn("canon", canonical_text("text"))
        .groupBy("canon")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.count("*").alias("variants"))
    )


def format_duplicates(spark: SparkSession, rows: DataFrame, id_col: str = "rec_id", text_col: str = "title") -> DataFrame:
    """(rec_id, group_id): the rows whose text equals another row's once formatting is set aside; group_id is the least id.

    Rows with a null or blank text are in no group. Repeated rows (the same id twice) are copies of each other only by
    their texts, so an id repeated with the same text comes out once. Other columns are ignored.
    """
    ws = Workspace(spark, "exact")
    raw = ws.write(raw_groups(rows, id_col, text_col).withColumn("canon", canonical_text("text")))
    # several rows with one id are one record, so a group needs two different ids
    groups = raw.groupBy("canon").agg(F.min("low").alias("group_id"), F.max("high").alias("high")).where("group_id < high").select("canon", "group_id")
    table = ws.write(raw.join(groups, "canon").select("text", "n", "group_id"))
    # a text may be that of a third of all rows; its row of the table is copied for them
    live = rows.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"))
    return salted_lookup(live, table.select("text", "group_id"), "text", table.select("text", "n"), "n").select("rec_id", "group_id").distinct()
