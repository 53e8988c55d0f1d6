"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "extract_refs").select("rec_id", "title").unionByName(_t(spark, d, "annotated_refs").select("rec_id", "title"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.near import near_pairs

    return near_pairs(spark, _titles(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.near import near_classes

    return near_classes(spark, _titles(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.pages import damage

    return damage(spark, _t(spark, d, "extract_pages"), _t(spark, d, "source_docs"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.pages import repaired

    return repaired(spark, _t(spark, d, "extract_pages"), _t(spark, d, "source_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.fusion import survivors

    return survivors(_t(spark, d, "ref_clusters"), _t(spark, d, "source_ranks"))


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.fusion import fuse

    return fuse(spark, _t(spark, d, "ref_clusters"), _t(spark, d, "source_ranks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.components import groups

    return groups(spark, _t(spark, d, "ref_edges"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.exact import format_duplicates

    return format_duplicates(spark, _t(spark, d, "extract_refs"))


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.exact import distinct_titles

    return distinct_titles(_t(spark, d, "extract_refs")).select("low", "n", "variants")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.canonical import map_values

    values = _t(spark, d, "extract_refs").select("rec_id", "type").unionByName(_t(spark, d, "annotated_refs").select("rec_id", "type"))
    return map_values(spark, values, _t(spark, d, "ref_types"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.encode import encode

    return encode(_t(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.encode import token_counts
    from citeweave.llm.packing import pack

    return pack(spark, token_counts(_t(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.pii import find

    return find(_t(spark, d, "documents"), _t(spark, d, "members"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    from citeweave.llm.pii import redact

    return redact(_t(spark, d, "documents"), _t(spark, d, "members"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    links = "SELECT DISTINCT least(pi, gi) u, greatest(pi, gi) v FROM ref_edges WHERE pi <> gi AND sim >= 0.75 AND NOT isnan(sim)"
    late = "extracted_at DESC NULLS LAST, cand_id"
    return {
        "p3_found": rf"""
            WITH r AS (SELECT c.*, coalesce(length(regexp_replace(title, '[^\pL\p{{Nd}}]', '', 'g')), 0) AS ts, coalesce(len(list_distinct([x FOR x IN page_numbers IF x >= 1])), 0) AS ps, coalesce(s.trust_rank, 2147483647) AS sr
                       FROM ref_clusters c LEFT JOIN source_ranks s ON lower(trim(c.source)) = s.source),
            n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, {late}) AS nt, row_number() OVER (PARTITION BY cluster_id ORDER BY ps DESC, {late}) AS np, row_number() OVER (PARTITION BY cluster_id ORDER BY sr, {late}) AS ns FROM r)
            SELECT cluster_id, max(cand_id) FILTER (nt = 1) AS title_id, max(cand_id) FILTER (np = 1) AS pages_id, max(cand_id) FILTER (ns = 1) AS source_id FROM n GROUP BY cluster_id""",
        "p4_found": f"""
            WITH RECURSIVE l AS ({links}), arcs AS (SELECT u s, v t FROM l UNION SELECT v, u FROM l),
            reach(s, t) AS (SELECT s, s FROM arcs UNION SELECT r.s, a.t FROM reach r JOIN arcs a ON a.s = r.t)
            SELECT s AS rec_id, min(t) AS group_id FROM reach GROUP BY s""",
    }
