"""Sources: pages of documents (any parser), page tables, ground truth."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


Parser = Callable[[bytes], Iterable[str]]


def pdf_parser(content: bytes) -> Iterable[str]:
    """Text of each page of a PDF by PyMuPDF, where that is installed."""
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF needs PyMuPDF; pass another parser or read a table of pages") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        return [p.get_text() for p in doc]


def text_parser(content: bytes) -> Iterable[str]:
    """Pages of a plain text, parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def documents(spark: SparkSession, path: str, parser: Parser = pdf_parser, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, page_num, text), one row a page, from 1; empty pages are kept. ``wanted`` reaches the parser's output, not only a later filter."""
    keep = set(wanted or ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, content in zip(df["path"], df["content"]):
                rows = [(name.rsplit("/", 1)[-1], n, t) for n, t in enumerate(parser(content), 1) if not keep or n in keep]
                yield pd.DataFrame(rows, columns=["doc_id", "page_num", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, page_num int, text string")


def page_table(table: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text", latest: str | None = None) -> DataFrame:
    """A table of pages as (doc_id, page_num, text); with ``latest``, of pages scanned more than once the last by that column."""
    t = table.select(F.col(doc).cast("string").alias("doc_id"), F.col(page).cast("int").alias("page_num"), F.col(text).alias("text"), *([F.col(latest).alias("_at")] if latest else []))
    if not latest:
        return t
    return t.groupBy("doc_id", "page_num").agg(F.max_by("text", F.struct("_at", "text")).alias("text"))


def ground_truth(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """(doc_id, gt_seq, title, type, page) of a JSON array, gt_seq from the array's order.

    An entry may name its document (doc_id); ``doc_id`` is that of entries that don't, null if it isn't given.
    """
    kind = "array<struct<doc_id:string,title:string,type:string,page:int>>"
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("gt_seq", "g"))
    return whole.select(F.coalesce("g.doc_id", F.lit(doc_id).cast("string")).alias("doc_id"), F.col("gt_seq").cast("bigint").alias("gt_seq"), "g.title", "g.type", "g.page")
