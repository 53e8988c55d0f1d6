"""The ordered operators over the large, skewed table of citations, and the same in SQL for DuckDB.

Duplicates are those that containment tells (no ratio, which SQL lacks); SQL reads each document's list with a fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import prompts
from citeweave.operators import evaluate, extract, merge, model
from citeweave.operators.similarity import similarity_edges
from citeweave.patterns import PATTERNS
from citeweave.runtime import Workspace
from citeweave.schemas import Settings
from citeweave.sources import sinks
from citeweave.sources.readers import page_table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cited(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "extract_refs").where("doc_id IS NOT NULL AND title IS NOT NULL")
    return t.select("doc_id", F.col("rec_id").alias("seq"), "title", "type", "page_numbers", "source")


def truth(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "annotated_refs").where("doc_id IS NOT NULL AND title IS NOT NULL")
    return t.select("doc_id", F.col("rec_id").alias("gt_seq"), "title", "type", "page")


def found(spark: SparkSession, d: str) -> DataFrame:
    """Annotated references in the place of a model's findings."""
    pages = F.when(F.col("page").isNull(), F.array().cast("array<int>")).otherwise(F.array("page"))
    return truth(spark, d).select("doc_id", F.col("gt_seq").alias("seq"), "title", "type", pages.alias("page_numbers"), F.lit("llm").alias("source"))


def _told(refs: DataFrame, distinct: bool = True) -> DataFrame:
    pages = F.array_sort(F.array_distinct("page_numbers")) if distinct else F.col("page_numbers")
    return refs.select("doc_id", "seq", "title", "type", F.array_join(pages, ",").alias("pages"), "source")


def cited_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match(spark, cited(spark, d), truth(spark, d), fuzzy=False).select("doc_id", "pi", "gi", F.round("sim", 6).alias("sim"))


def cited_greedy_match_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match(spark, cited(spark, d), truth(spark, d))


def cited_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity_edges(cited(spark, d), truth(spark, d))


def cited_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(spark, cited(spark, d), truth(spark, d), fuzzy=False)


def cited_metrics_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(spark, cited(spark, d), truth(spark, d), by_doc=True, fuzzy=False)


def cited_comparison(spark: SparkSession, d: str) -> DataFrame:
    c, t = cited(spark, d), truth(spark, d)
    return evaluate.comparison({"regex_only": evaluate.metrics(spark, c.where("source = 'regex'"), t, fuzzy=False), "hybrid": evaluate.metrics(spark, c, t, fuzzy=False)})


def cited_first_fit_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.errors(spark, cited(spark, d), truth(spark, d), fuzzy=False)


def cited_missed(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missed_listing(cited(spark, d), truth(spark, d), fuzzy=False).select("doc_id", "gt_seq", "title")


def cited_matched_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.matched_sample(cited(spark, d), truth(spark, d), fuzzy=False).select("doc_id", "seq", "title")


def cited_seed_clusters(spark: SparkSession, d: str) -> DataFrame:
    return merge.seed_clusters(spark, cited(spark, d)).select("doc_id", "seq", "seed")


def cited_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return _told(merge.collapse(merge.seed_clusters(spark, cited(spark, d))), False)


def cited_merge_first_match(spark: SparkSession, d: str) -> DataFrame:
    return _told(merge.merge_first_match(spark, cited(spark, d), found(spark, d), fuzzy=False))


def cited_merge_new_only(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_new_only(spark, cited(spark, d), found(spark, d), fuzzy=False).select("doc_id", "seq", "title", "type", "source")


def _names(prompt: str) -> str:
    """Names a cluster by its first title, with one more page."""
    first = json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1])[0]
    return json.dumps({"canonical_title": first["title"] + " (canonical)", "merged_page_numbers": [99]})


def cited_canonical_titles(spark: SparkSession, d: str) -> DataFrame:
    return _told(model.deduplicate(spark, cited(spark, d), model.Replay(rule=_names)), False)


def _keeps(prompt: str) -> str:
    titles = json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1])
    return json.dumps([t for t in titles if "2" in t])


def cited_verified(spark: SparkSession, d: str) -> DataFrame:
    return model.verify(spark, cited(spark, d), model.Replay(rule=_keeps)).select("doc_id", "seq", "title")


def batch_prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as sent, as their hash."""
    p = page_table(_t(spark, d, "extract_pages"), latest="scanned_at")
    return model.batch_prompts(p, cited(spark, d)).select("doc_id", "batch", F.md5("prompt").alias("prompt"))


def cited_listing(spark: SparkSession, d: str) -> DataFrame:
    return sinks.listing(cited(spark, d)).select("doc_id", "type", "n", F.md5(F.array_join("entries", "\n")).alias("entries"))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Citations written as JSON lines and read back."""
    path = Workspace(spark, "lines").root
    sinks.write_lines(cited(spark, d), path)
    back = spark.read.schema(cited(spark, d).schema).json(path)
    return _told(back, False)


def planted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of annotated titles and the two acts that scanned pages don't cite."""
    year = (1950 + F.col("gt_seq") % 60).cast("string")
    text = F.concat(F.lit("as the Securities and  Exchange Board of India Act, "), year, F.lit(" and the securities contract (Regulation) Act "), year, F.lit(" say of "), "title")
    return truth(spark, d).select("doc_id", F.col("gt_seq").cast("int").alias("page_num"), text.alias("text"))


def planted_acts(spark: SparkSession, d: str) -> DataFrame:
    return extract.matches(planted_pages(spark, d), [p for p in PATTERNS if p.pattern_id in (6, 7)]).select("doc_id", "page_num", "pattern_id", "pos", "match")


def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages asked for up to two after the last."""
    pages = page_table(_t(spark, d, "extract_pages"), latest="scanned_at")
    wanted = _t(spark, d, "source_docs").select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest("n_pages", F.lit(1)) + 2)).alias("page_num"))
    return extract.missing_pages(pages, wanted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        cited_greedy_match, cited_greedy_match_by_ratio, cited_ratio_pairs, cited_metrics, cited_metrics_by_doc, cited_comparison, cited_first_fit_errors, cited_missed,
        cited_matched_sample, cited_seed_clusters, cited_collapsed, cited_merge_first_match, cited_merge_new_only, cited_canonical_titles, cited_verified, batch_prompt_texts,
        cited_listing, json_lines, planted_acts, missing_pages,
    )
    return {f.__name__: f for f in own}


PLANTED = """SELECT doc_id, rec_id::INT AS page_num, 'as the Securities and  Exchange Board of India Act, ' || (1950 + rec_id % 60) || ' and the securities contract (Regulation) Act ' || (1950 + rec_id % 60) || ' say of ' || title AS text FROM annotated_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql(pages: str, matches: Callable) -> dict[str, str]:
    """SQL of the queries. ``pages`` is the common table of the last scans, ``matches`` gives a pattern's SELECT over pages."""
    s = Settings()
    trim = r"regexp_replace({0}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
    key = f"lower({trim.format('title')})"
    c = f"c AS (SELECT doc_id, rec_id AS seq, title, type, page_numbers, source, {key} AS k FROM extract_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL)"
    t = f"t AS (SELECT doc_id, rec_id AS gt_seq, title, type, page, {key} AS k FROM annotated_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL)"
    dup = "dup AS (SELECT c.doc_id, c.seq AS p, t.gt_seq AS g, c.k AS a, t.k AS b, c.source FROM c JOIN t USING (doc_id) WHERE contains(c.k, t.k) OR contains(t.k, c.k))"
    sim = """sims AS (SELECT *, least(length(a), length(b)) AS s, greatest(length(a), length(b)) AS l FROM dup),
        edges AS (SELECT * FROM (SELECT doc_id, p, g, source, CASE WHEN a = b THEN 1.0::DOUBLE WHEN s >= 10 THEN 0.75::DOUBLE + 0.25::DOUBLE * (s::DOUBLE / l) ELSE 0.5::DOUBLE + 0.5::DOUBLE * (s::DOUBLE / l) END AS sim FROM sims) WHERE sim >= 0.75)"""

    def fold(edges: str, order: str, name: str) -> str:
        taken = "list_contains(list_transform(x, lambda z: z.p), y.p) OR list_contains(list_transform(x, lambda z: z.g), y.g)"
        return f"""{name}_l AS (SELECT doc_id, list({{'p': p, 'g': g, 'sim': sim}} ORDER BY {order}) AS l FROM {edges} GROUP BY doc_id),
        {name} AS (SELECT doc_id, u.p AS p, u.g AS g, u.sim AS sim FROM (SELECT doc_id, unnest(list_reduce(l, lambda x, y: CASE WHEN {taken} THEN x ELSE list_append(x, y) END, l[1:0])) AS u FROM {name}_l))"""

    greedy = f"{c}, {t}, {dup}, {sim}, {fold('edges', 'sim DESC, p, g', 'm')}"
    rates = """SELECT {0}CASE WHEN g > 0 THEN round_even(pr, 3) ELSE 0 END AS precision, CASE WHEN g > 0 THEN round_even(re, 3) ELSE 0 END AS recall, CASE WHEN g > 0 AND pr + re > 0 THEN round_even(2 * pr * re / (pr + re), 3) ELSE 0 END AS f1,
        CASE WHEN g > 0 THEN tp ELSE 0 END AS tp, CASE WHEN g > 0 THEN p - tp ELSE 0 END AS fp, CASE WHEN g > 0 THEN g - tp ELSE 0 END AS fn
        FROM (SELECT *, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END AS pr, CASE WHEN g > 0 THEN tp::DOUBLE / g ELSE 0 END AS re FROM {1})"""
    seeds = """cl AS (SELECT doc_id, list({'n': seq, 'k': k, 's': seq} ORDER BY seq) AS l FROM c GROUP BY doc_id),
        folded AS (SELECT doc_id, list_reduce(l, lambda x, y: list_append(x, {'n': y.n, 'k': y.k, 's': coalesce(list_filter(x, lambda z: z.n = z.s AND (contains(z.k, y.k) OR contains(y.k, z.k)))[1].n, y.n)}), l[1:0]) AS l FROM cl),
        seeded AS (SELECT c.*, f.s AS seed FROM c JOIN (SELECT doc_id, u.n AS n, u.s AS s FROM (SELECT doc_id, unnest(l) AS u FROM folded)) f ON c.doc_id = f.doc_id AND c.seq = f.n)"""
    one = """one AS (SELECT doc_id, seed, count(*) AS n, arg_max({'title': title, 'type': type}, {'l': length(title), 's': -seq}) AS best, arg_min(title, seq) AS first, arg_min({'p': page_numbers}, seq).p AS own,
        list_sort(list_distinct(flatten(list(coalesce(page_numbers, []::INT[]))))) AS every, count(DISTINCT source) AS ns, any_value(source) AS src FROM seeded GROUP BY doc_id, seed)"""
    number = "row_number() OVER (PARTITION BY doc_id ORDER BY seed) - 1 AS seq"
    source = "CASE WHEN ns > 1 THEN 'both' ELSE src END AS source"
    merged = f"""ex AS (SELECT doc_id, list({{'n': seq, 'k': k, 's': seq}} ORDER BY seq) AS l FROM c GROUP BY doc_id),
        fo AS (SELECT doc_id, list({{'n': gt_seq + {1 << 48}, 'k': k, 's': gt_seq}} ORDER BY gt_seq) AS l FROM t GROUP BY doc_id),
        both_ AS (SELECT doc_id, coalesce(ex.l, fo.l[1:0]) AS e, coalesce(fo.l, ex.l[1:0]) AS f FROM ex FULL JOIN fo USING (doc_id)),
        folded AS (SELECT doc_id, list_reduce(f, lambda x, y: list_append(x, {{'n': y.n, 'k': y.k, 's': coalesce(list_filter(x, lambda z: z.n = z.s AND (contains(z.k, y.k) OR contains(y.k, z.k)))[1].n, y.n)}}), e) AS l FROM both_),
        owner AS (SELECT doc_id, u.n AS n, u.s AS seed FROM (SELECT doc_id, unnest(l) AS u FROM folded)),
        every AS (SELECT doc_id, seq AS n, title, type, page_numbers, source FROM c UNION ALL SELECT doc_id, gt_seq + {1 << 48}, title, type, CASE WHEN page IS NULL THEN []::INT[] ELSE [page] END, 'llm' FROM t),
        owned AS (SELECT every.*, seed FROM every JOIN owner USING (doc_id, n))"""
    comparison_runs = f"{c}, {t}, {dup}, {sim}, regex_edges AS (SELECT * FROM edges WHERE source = 'regex'), {fold('edges', 'sim DESC, p, g', 'm')}, {fold('regex_edges', 'sim DESC, p, g', 'r')}"
    head, mid = prompts.EXTRACT.split("{existing_refs}")
    mid, tail = mid.split("{text}")
    n = s.shown_references
    return {
        "cited_greedy_match": f"WITH {greedy} SELECT doc_id, p AS pi, g AS gi, round(sim, 6) AS sim FROM m",
        "cited_metrics": f"WITH {greedy}, n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM c) AS p, (SELECT count(*) FROM t) AS g) {rates.format('', 'n')}",
        "cited_metrics_by_doc": f"WITH {greedy}, n AS (SELECT doc_id, count(*) FILTER (x = 'm') AS tp, count(*) FILTER (x = 'c') AS p, count(*) FILTER (x = 't') AS g FROM (SELECT doc_id, 'm' AS x FROM m UNION ALL SELECT doc_id, 'c' FROM c UNION ALL SELECT doc_id, 't' FROM t) GROUP BY doc_id) {rates.format('doc_id, ', 'n')}",
        "cited_comparison": f"""
            WITH {comparison_runs}, n AS (SELECT 'regex_only' AS method, (SELECT count(*) FROM r) AS tp, (SELECT count(*) FROM c WHERE source = 'regex') AS p, (SELECT count(*) FROM t) AS g UNION ALL SELECT 'hybrid', (SELECT count(*) FROM m), (SELECT count(*) FROM c), (SELECT count(*) FROM t)),
            x AS (SELECT method, precision, recall, f1, tp + fp AS found FROM ({rates.format('method, ', 'n')}))
            SELECT * FROM x UNION ALL SELECT 'difference', round(h.precision - r.precision, 3), round(h.recall - r.recall, 3), round(h.f1 - r.f1, 3), h.found - r.found FROM x h, x r WHERE h.method = 'hybrid' AND r.method = 'regex_only'""",
        "cited_first_fit_errors": f"""
            WITH {c}, {t}, {dup}, d1 AS (SELECT DISTINCT doc_id, p, g, 1.0::DOUBLE AS sim FROM dup), {fold('d1', 'p, g', 'm')}
            SELECT doc_id, 'missed' AS kind, gt_seq AS pos, title, type FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND m.g = t.gt_seq)
            UNION ALL SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND m.p = c.seq) THEN 'correct' ELSE 'false_positive' END, seq, title, type FROM c
            UNION ALL SELECT doc_id, 'llm_unique', seq, title, type FROM c WHERE source = 'llm'""",
        "cited_missed": f"WITH {c}, {t}, {dup}, {sim} SELECT doc_id, gt_seq, title FROM t WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = t.doc_id AND e.g = t.gt_seq)",
        "cited_matched_sample": f"WITH {c}, {t}, {dup} SELECT doc_id, seq, title FROM c WHERE EXISTS (SELECT 1 FROM dup WHERE dup.doc_id = c.doc_id AND dup.p = c.seq) ORDER BY doc_id, seq LIMIT 10",
        "cited_seed_clusters": f"WITH {c}, {seeds} SELECT doc_id, seq, seed FROM seeded",
        "cited_collapsed": f"WITH {c}, {seeds}, {one} SELECT doc_id, {number}, best.title AS title, best.type AS type, array_to_string(CASE WHEN n > 1 THEN every ELSE own END, ',') AS pages, {source} FROM one",
        "cited_canonical_titles": f"WITH {c}, {seeds}, {one} SELECT doc_id, {number}, CASE WHEN n BETWEEN 2 AND {s.dedup_cluster_limit} THEN {trim.format('first || $$ (canonical)$$')} ELSE best.title END AS title, best.type AS type, array_to_string(CASE WHEN n BETWEEN 2 AND {s.dedup_cluster_limit} THEN list_sort(list_distinct(list_append(every, 99))) WHEN n > 1 THEN every ELSE own END, ',') AS pages, {source} FROM one",
        "cited_merge_first_match": f"WITH {c}, {t}, {merged} SELECT doc_id, {number}, arg_min(title, n) AS title, arg_min({{'x': type}}, n).x AS type, array_to_string(list_sort(list_distinct(flatten(list(coalesce(page_numbers, []::INT[]))))), ',') AS pages, CASE WHEN count(*) > 1 THEN 'both' ELSE any_value(source) END AS source FROM owned GROUP BY doc_id, seed",
        "cited_merge_new_only": f"WITH {c}, {t}, {merged} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq, title, type, source FROM owned WHERE n = seed",
        "cited_verified": f"""
            WITH {c}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // {s.verify_batch} AS batch FROM c), y AS (SELECT doc_id, batch, count(*) AS n, count(*) FILTER (contains(title, '2')) AS kept FROM b GROUP BY ALL),
            z AS (SELECT *, kept = 0 OR kept < n * {s.verify_batch_floor} AS open FROM y), w AS (SELECT doc_id, sum(kept) < sum(n) * {s.verify_global_floor} AS skip FROM z GROUP BY doc_id),
            names AS (SELECT DISTINCT doc_id, k FROM b WHERE contains(title, '2') UNION SELECT doc_id, lower(title) FROM b JOIN z USING (doc_id, batch) WHERE open)
            SELECT doc_id, seq, title FROM c JOIN w USING (doc_id) WHERE skip OR EXISTS (SELECT 1 FROM names WHERE names.doc_id = c.doc_id AND names.k = c.k)""",
        "batch_prompt_texts": f"""
            WITH {pages}, {c}, p AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY page_num, text NULLS FIRST) - 1) // {s.page_batch})::INT AS batch FROM pages),
            g AS (SELECT doc_id, batch, string_agg(chr(10) || '--- Page ' || page_num || ' ---' || chr(10) || coalesce(text, ''), '' ORDER BY page_num) AS body FROM p GROUP BY doc_id, batch),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY doc_id) AS every FROM c),
            k AS (SELECT doc_id, string_agg('- ' || title, chr(10) ORDER BY seq) || CASE WHEN any_value(every) > {n} THEN chr(10) || '... and ' || (any_value(every) - {n}) || ' more' ELSE '' END AS known FROM r WHERE i <= {n} GROUP BY doc_id)
            SELECT doc_id, batch, md5({_quoted(head)} || coalesce(known, '(none)') || {_quoted(mid)} || body || {_quoted(tail)}) AS prompt FROM g LEFT JOIN k USING (doc_id)""",
        "cited_listing": f"WITH {c} SELECT doc_id, type, count(*) AS n, md5(string_agg(title || ' | pages ' || coalesce(array_to_string(page_numbers, ', '), '') || CASE WHEN source <> 'both' THEN ' [' || source || ']' ELSE '' END, chr(10) ORDER BY seq)) AS entries FROM c GROUP BY doc_id, type",
        "json_lines": f"WITH {c} SELECT doc_id, seq, title, type, array_to_string(page_numbers, ',') AS pages, source FROM c",
        "planted_acts": f"""
            WITH pages AS ({PLANTED})
            SELECT doc_id, page_num, pattern_id, pos::INT AS pos, match FROM ({" UNION ALL ".join(matches(p) for p in PATTERNS if p.pattern_id in (6, 7))})""",
        "missing_pages": f"WITH {pages}, w AS (SELECT DISTINCT doc_id, unnest(range(1, greatest(n_pages, 1) + 3))::INT AS page_num FROM source_docs) SELECT doc_id, page_num FROM w WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.doc_id = w.doc_id AND p.page_num = w.page_num)",
    }
