"""Regular-expression extraction of citations: one scan, thirteen patterns, first-wins grouping, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import folded, one_line, title_key
from citeweave.patterns import PATTERNS, Pattern
from citeweave.runtime import Workspace, numbered


def matches(pages: DataFrame, patterns: Sequence[Pattern] = PATTERNS, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, page_num, pattern_id, pos, match, type): every match of every pattern, from one scan; with the columns ``keep``.

    Matches of one pattern don't overlap, those of different patterns may. Null texts have none.
    """


    def every(p: Pattern) -> Column:
        found = F.regexp_extract_all("text", F.lit(p.java), F.lit(0))
        may = [reduce(or_, [F.col("_folded").contains(x) for x in some]) for some in p.needs]
        return F.when(reduce(and_, may), found).otherwise(F.array().cast("array<string>")) if may else found

    found = F.array(*[F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.ref_type).alias("type"), every(p).alias("all")) for p in patterns])
    return (
        pages.where(F.col("text").isNotNull()).withColumn("_folded", folded("text")).select("doc_id", "page_num", *keep, F.explode(found).alias("f"))
        .select("doc_id", "page_num", *keep, "f.pattern_id", "f.type", F.posexplode("f.all").alias("pos", "match"))
    )


def references(pages: DataFrame, patterns: Sequence[Pattern] = PATTERNS, ws: Workspace | None = None) -> DataFrame:
    """One row a document and title (case aside): spelling and type of the first match, distinct pages in order of sight.

    seq numbers a document's references in order of first sight. Pages are read in order of page_num, as listed.
    With ``ws`` a table is written on the way, so that all pages are matched once, not once for each step of numbering.
    """
    ord_ = F.struct("page_num", "pattern_id", "pos")
    m = matches(pages, patterns).withColumn("title", one_line("match")).where("title <> ''").withColumn("key", title_key("title"))
    # a document's mention of a title on a page collapses first, so a hot title moves a row a page
    on_page = m.groupBy("doc_id", "key", "page_num").agg(F.min(ord_).alias("ord"), F.min_by(F.struct("title", "type"), ord_).alias("first"))
    whole = on_page.groupBy("doc_id", "key").agg(F.min("ord").alias("ord"), F.min_by("first", "ord").alias("first"), F.array_sort(F.collect_set("page_num")).alias("page_numbers"))
    # numbered in two steps, within a page and by pages, so that no task sorts a whole document's references
    page = whole.withColumn("page", F.col("ord.page_num"))
    if ws:
        page = ws.write(page)
    sizes = page.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    before = sizes.select("doc_id", "page", (F.sum("n").over(Window.partitionBy("doc_id").orderBy("page")) - F.col("n")).alias("before"))
    seq = F.col("before") + F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1
    numbered = page.join(before, (page["doc_id"].eqNullSafe(before["doc_id"])) & (page["page"] == before["page"])).select(page["*"], "before")
    return numbered.select("doc_id", seq.cast("bigint").alias("seq"), F.col("first.title").alias("title"), F.col("first.type").alias("type"), "page_numbers", F.lit("regex").alias("source"))


def stats(refs: DataFrame, by_doc: bool = False) -> DataFrame:
    """Counts of references by where they come from."""
    agg = [F.count("*").alias("total"), *[F.count_if(F.col("source") == s).alias(n) for s, n in (("regex", "regex_only"), ("llm", "llm_only"), ("both", "both"))]]
    return refs.groupBy("doc_id").agg(*agg) if by_doc else refs.agg(*agg)


def by_type(refs: DataFrame) -> DataFrame:
    return refs.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def select_pages(pages: DataFrame, wanted: Sequence[int] | None) -> DataFrame:
    """The pages asked for; all of them if none is."""
    return pages.where(F.col("page_num").isin(list(wanted))) if wanted else pages


def missing_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page_num) of ``wanted`` that ``pages`` hasn't."""
    return wanted.join(pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_anti").distinct()


def page_batches(pages: DataFrame, size: int = 3) -> DataFrame:
    """pages with ``batch``: consecutive runs of ``size`` pages of a document."""
    order = [c for c in ("page_num", "text") if c in pages.columns]
    return numbered(Workspace(pages.sparkSession, "batches"), pages, ["doc_id"], order, "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def first_page_order(refs: DataFrame, missing: int = 999) -> DataFrame:
    """refs with seq renumbered by the first listed page (not the least); references without pages come last."""
    key = F.coalesce(F.try_element_at("page_numbers", F.lit(1)), F.lit(missing))
    return numbered(Workspace(refs.sparkSession, "order"), refs.withColumn("_key", key).withColumnRenamed("seq", "_old"), ["doc_id"], ["_key", "_old"], "seq").select(*refs.columns)
