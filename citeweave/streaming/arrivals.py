"""Citations of pages as they arrive: stateless matching, repeats of a page dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import one_line, title_key
from citeweave.operators.extract import matches


def stream_matches(pages: DataFrame, at: str = "scanned_at", late: str = "7 days") -> DataFrame:
    """(doc_id, page_num, title, key, type) of a stream of pages with an event time; a title once a page within ``late``.

    State is a key a page and title, given up as the watermark passes, so it follows the window and not the corpus.
    """
    cols = pages.select("doc_id", "page_num", "text", F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    out = matches(cols, keep=["at"]).select("at", "doc_id", "page_num", one_line("match").alias("title"), "type")
    return out.withColumn("key", title_key("title")).dropDuplicatesWithinWatermark(["doc_id", "page_num", "key"])


def stream_counts(pages: DataFrame, at: str = "scanned_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, type, n) citations by type in tumbling windows of arrival."""
    return stream_matches(pages, at, late).groupBy(F.window("at", window), "type").agg(F.count("*").alias("n"))
