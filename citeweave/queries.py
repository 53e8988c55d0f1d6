"""Queries of the pipeline's operators over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave import cited_queries
from citeweave.cited_queries import cited, found, truth
from citeweave.functions.text import parse_pages
from citeweave.operators import evaluate, extract, merge, model, search
from citeweave.operators.similarity import duplicate_edges, similarity_edges
from citeweave.patterns import PATTERNS
from citeweave.plans import pipeline
from citeweave.runtime import Workspace, freeing
from citeweave.sources.readers import page_table

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the table of scans; of a page scanned again the last scan."""
    return page_table(_t(spark, d, "extract_pages"), latest="scanned_at")


#: patterns that no scanned page of the test tables holds; their queries read planted pages too
RARE = (6, 7)


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Citations that the patterns find, written once for operators that read them several times."""
    ws = Workspace(spark, "references")
    with freeing(spark):
        return ws.write(extract.references(pages(spark, d), ws=Workspace(spark, "pages")))


def _pattern(p) -> Query:
    if p.pattern_id in RARE:
        return lambda spark, d: extract.matches(pages(spark, d).unionByName(cited_queries.planted_pages(spark, d)), [p]).select("doc_id", "page_num", "pos", "match")
    return lambda spark, d: extract.matches(pages(spark, d), [p]).select("doc_id", "page_num", "pos", "match")


def regex_refs_dedup(spark: SparkSession, d: str) -> DataFrame:
    return extract.references(pages(spark, d)).select("doc_id", "seq", "title", "type", F.array_join("page_numbers", ",").alias("pages"), "source")


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    return extract.stats(_t(spark, d, "extract_refs"))


def refs_by_type(spark: SparkSession, d: str) -> DataFrame:
    return extract.by_type(_t(spark, d, "extract_refs"))


def page_select(spark: SparkSession, d: str) -> DataFrame:
    return extract.select_pages(pages(spark, d), parse_pages("1,3,5-7")).select("doc_id", "page_num")


def page_batches(spark: SparkSession, d: str) -> DataFrame:
    return extract.page_batches(pages(spark, d)).select("doc_id", "page_num", "batch")


def first_page_order(spark: SparkSession, d: str) -> DataFrame:
    c = cited(spark, d).withColumn("rec_id", F.col("seq"))
    return extract.first_page_order(c).select("doc_id", "rec_id", "seq")


def dup_containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_edges(cited(spark, d), truth(spark, d), "seq", "gt_seq", fuzzy=False)


def graded_similarity_containment(spark: SparkSession, d: str) -> DataFrame:
    return similarity_edges(cited(spark, d), truth(spark, d), fuzzy=False).select("doc_id", "pi", "gi", F.round("sim", 6).alias("sim"))


def ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity_edges(_refs(spark, d), truth(spark, d))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match(spark, _refs(spark, d), truth(spark, d))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(spark, _refs(spark, d), truth(spark, d))


def metrics_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(spark, _refs(spark, d), truth(spark, d), by_doc=True)


def first_fit_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.errors(spark, _refs(spark, d), truth(spark, d))


def missed_gt(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missed_listing(_refs(spark, d), truth(spark, d))


def comparison(spark: SparkSession, d: str) -> DataFrame:
    r = _refs(spark, d)
    ws = Workspace(spark, "both")
    with freeing(spark):
        both = ws.write(merge.merge_first_match(spark, r, found(spark, d)))
    return evaluate.comparison(evaluate.metrics_of_runs(spark, {"regex_only": r, "hybrid": both}, truth(spark, d)))


def merge_first_match(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_first_match(spark, _refs(spark, d), found(spark, d))


def merge_new_only(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_new_only(spark, _refs(spark, d), found(spark, d))


def seed_clusters(spark: SparkSession, d: str) -> DataFrame:
    return merge.seed_clusters(spark, _refs(spark, d)).select("doc_id", "seq", "seed")


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return merge.collapse(merge.seed_clusters(spark, _refs(spark, d)))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model might give them, made from annotated references: fenced, in other keys, with junk."""
    t = _t(spark, d, "annotated_refs").where("doc_id IS NOT NULL AND title IS NOT NULL")
    kind = F.col("rec_id") % 5
    title = F.regexp_replace("title", r'[\\"\x00-\x1f]', " ")
    obj = (
        F.when(kind == 0, F.concat(F.lit('{"title": "'), title, F.lit('", "type": "letter", "page_numbers": 3}')))
        .when(kind == 1, F.concat(F.lit('{"Date": "D", "Details": "'), title, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"title": "'), title, F.lit('", "page_numbers": [2, 2]}')))
        .when(kind == 3, F.concat(F.lit('"'), title, F.lit('"')))
        .otherwise(F.lit('{"title": "  "}'))
    )
    text = F.concat(F.when(kind % 2 == 0, "```json\n").otherwise(""), F.lit("["), obj, F.lit("]"), F.when(kind % 2 == 0, "\n```").otherwise(""))
    return t.select("doc_id", F.col("rec_id").cast("int").alias("batch"), F.array(F.lit(7)).alias("pages"), text.alias("raw"))


def llm_coerce(spark: SparkSession, d: str) -> DataFrame:
    return model.coerce(_answers(spark, d)).select("doc_id", "batch", "pos", "title", "type", F.array_join("page_numbers", ",").alias("pages"))


def llm_grouped(spark: SparkSession, d: str) -> DataFrame:
    g = model.grouped(model.coerce(_answers(spark, d)))
    return g.select("doc_id", "seq", "title", "type", F.array_join(F.array_sort(F.array_distinct("page_numbers")), ",").alias("pages"), "source")


def llm_batch_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return model.batch_prompts(p, extract.references(p)).select("doc_id", "batch", F.length("prompt").alias("length"), F.size("pages").alias("pages"))


def _keeper(prompt: str) -> str:
    import json

    titles = json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1])
    return json.dumps([t for t in titles if "/" in t or "Act" in t])


def verify_filter(spark: SparkSession, d: str) -> DataFrame:
    return model.verify(spark, _refs(spark, d), model.Replay(rule=_keeper)).select("doc_id", "seq", "title")


def _rule(prompt: str) -> str:
    import json
    import re

    if "canonical_title" in prompt:
        return "no object"
    if "titles to keep" in prompt:
        return json.dumps(json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1]))
    return json.dumps([{"title": t, "type": "letter", "page_numbers": []} for t in dict.fromkeys(re.findall(r"letter no\. \S+", prompt))])


def extract_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.extract(spark, pages(spark, d), model.Replay(rule=_rule))[0]


def extract_regex_only(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.extract(spark, pages(spark, d))[1]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    a, b = (F.col("p_size") / 50.0).alias("precision"), ((F.col("p_partkey") * 37 % 101) / 101.0).alias("recall")
    return p.select(F.col("p_partkey").alias("id"), a, b).withColumn("f1", F.round((F.col("precision") + F.col("recall")) / 2, 6))


def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return search.pareto_front(_candidates(spark, d)).select("id", "precision", "recall", "f1")


def prune_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.prune(_candidates(spark, d), 12).select("id", "f1")


def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d)
    train, val = search.split_truth(t, [2, 3, 5])
    return train.select("gt_seq", F.lit("train").alias("part")).unionByName(val.select("gt_seq", F.lit("validation").alias("part")))


def queries() -> dict[str, Query]:
    own = (
        regex_refs_dedup, source_stats, refs_by_type, page_select, page_batches, first_page_order, dup_containment_pairs, graded_similarity_containment,
        ratio_pairs, greedy_match, metrics, metrics_by_doc, first_fit_errors, missed_gt, comparison, merge_first_match, merge_new_only, seed_clusters, collapsed,
        llm_coerce, llm_grouped, llm_batch_prompts, verify_filter, extract_hybrid, extract_regex_only, pareto_front, prune_topk, train_val_split,
    )
    return {f"regex_refs_p{p.pattern_id:02d}": _pattern(p) for p in PATTERNS} | {f.__name__: f for f in own} | cited_queries.queries()


# SQL

_PAGES = """pages AS (SELECT doc_id, page_num, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY scanned_at DESC NULLS LAST, text DESC NULLS LAST) AS _n FROM extract_pages) WHERE _n = 1)"""


def _re2(p) -> str:
    """The pattern for RE2, whose classes know ASCII only."""
    s = p.re2 or p.regex
    inside = {r"[\w\s,&\-]": r"[\pL\pM\p{Nd}\p{Pc}\s\pZ,&\-]", r"[\w\s,]": r"[\pL\pM\p{Nd}\p{Pc}\s\pZ,]", r"[A-Za-z\s]": r"[A-Za-z\s\pZ]"}
    for a, b in inside.items():
        s = s.replace(a, b)
    out, i = "", 0
    depth = False
    while i < len(s):
        if s[i] == "[":
            depth = True
        elif s[i] == "]":
            depth = False
        if s.startswith(r"\s", i) and not depth:
            out += r"[\s\pZ]"
            i += 2
        elif s.startswith(r"\d", i):
            out += r"\p{Nd}"
            i += 2
        elif s[i] == "\\":
            out += s[i : i + 2]
            i += 2
        else:
            out += s[i]
            i += 1
    return out.replace("'", "''")


def _matches_sql(p) -> str:
    group = 1 if p.re2 else 0
    return f"SELECT doc_id, page_num, {p.pattern_id} AS pattern_id, '{p.ref_type}' AS type, unnest(regexp_extract_all(text, '{_re2(p)}', {group}, 'i')) AS match, generate_subscripts(regexp_extract_all(text, '{_re2(p)}', {group}, 'i'), 1) - 1 AS pos FROM pages WHERE text IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    trim = r"regexp_replace({0}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
    key = "lower(" + trim.format("{0}") + ")"
    truth_ = "truth AS (SELECT doc_id, rec_id AS gt_seq, title, type, page FROM annotated_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL)"
    pair = f"p AS (SELECT c.doc_id, c.rec_id AS pi, t.gt_seq AS gi, {key.format('c.title')} AS a, {key.format('t.title')} AS b FROM extract_refs c JOIN truth t USING (doc_id) WHERE c.title IS NOT NULL)"
    all_matches = " UNION ALL ".join(_matches_sql(p) for p in PATTERNS)
    cand = "c AS (SELECT p_partkey AS id, p_size / 50.0 AS precision, (p_partkey * 37 % 101) / 101.0 AS recall, round((p_size / 50.0 + (p_partkey * 37 % 101) / 101.0) / 2, 6) AS f1 FROM part), front AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.precision >= c.precision AND o.recall >= c.recall AND (o.precision > c.precision OR o.recall > c.recall)))"
    title = r"regexp_replace(title, '[\\\"\x00-\x1f]', ' ', 'g')"
    scans = {p: _PAGES if p not in RARE else _PAGES.replace("pages AS", "scans AS", 1) + f", pages AS (SELECT * FROM scans UNION ALL {cited_queries.PLANTED})" for p in (x.pattern_id for x in PATTERNS)}
    out = {f"regex_refs_p{p.pattern_id:02d}": f"WITH {scans[p.pattern_id]} SELECT doc_id, page_num, pos::INT AS pos, match FROM ({_matches_sql(p)})" for p in PATTERNS}
    return out | cited_queries.oracle_sql(_PAGES, _matches_sql) | {
        "regex_refs_dedup": rf"""
            WITH {_PAGES}, m AS ({all_matches}), n AS (SELECT *, regexp_replace({trim.format("match")}, '[\s\pZ]+', ' ', 'g') AS title FROM m), k AS (SELECT *, lower(title) AS key FROM n WHERE title <> ''),
            f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page_num, pattern_id, pos) AS r FROM k),
            g AS (SELECT doc_id, key, array_to_string(list_sort(list(DISTINCT page_num)), ',') AS pages FROM k GROUP BY ALL)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, pattern_id, pos) - 1 AS seq, title, type, pages, 'regex' AS source FROM f JOIN g USING (doc_id, key) WHERE r = 1""",
        "source_stats": "SELECT count(*) AS total, count(*) FILTER (source = 'regex') AS regex_only, count(*) FILTER (source = 'llm') AS llm_only, count(*) FILTER (source = 'both') AS both FROM extract_refs",
        "refs_by_type": "SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM extract_refs GROUP BY type",
        "page_select": f"WITH {_PAGES} SELECT doc_id, page_num FROM pages WHERE page_num IN (1, 3, 5, 6, 7)",
        "page_batches": f"WITH {_PAGES} SELECT doc_id, page_num, ((row_number() OVER (PARTITION BY doc_id ORDER BY page_num, text NULLS FIRST) - 1) // 3)::INT AS batch FROM pages",
        "first_page_order": "SELECT doc_id, rec_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page_numbers[1], 999), rec_id) - 1 AS seq FROM extract_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL",
        "dup_containment_pairs": f"WITH {truth_}, {pair} SELECT doc_id, pi, gi FROM p WHERE contains(a, b) OR contains(b, a)",
        "graded_similarity_containment": f"""
            WITH {truth_}, {pair}, s AS (SELECT *, least(length(a), length(b)) AS s, greatest(length(a), length(b)) AS l FROM p WHERE contains(a, b) OR contains(b, a)),
            g AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN s >= 10 THEN 0.75 + 0.25 * s / l ELSE 0.5 + 0.5 * s / l END AS sim FROM s)
            SELECT doc_id, pi, gi, round(sim, 6) AS sim FROM g WHERE sim >= 0.75""",
        "llm_coerce": rf"""
            WITH t AS (SELECT doc_id, rec_id, rec_id % 5 AS kind, {trim.format(title)} AS title FROM annotated_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL)
            SELECT doc_id, rec_id::INT AS batch, 0 AS pos, CASE WHEN kind = 1 THEN 'D - ' || title ELSE title END AS title,
            CASE kind WHEN 0 THEN 'letter' ELSE 'circular' END AS type, CASE kind WHEN 0 THEN '3' WHEN 1 THEN '7' ELSE '2,2' END AS pages FROM t WHERE kind < 3 AND (title <> '' OR kind = 1)""",
        "llm_grouped": rf"""
            WITH a AS (SELECT doc_id, rec_id, rec_id % 5 AS kind, {trim.format(title)} AS t FROM annotated_refs WHERE doc_id IS NOT NULL AND title IS NOT NULL),
            e AS (SELECT doc_id, rec_id AS batch, CASE WHEN kind = 1 THEN 'D - ' || t ELSE t END AS title, CASE kind WHEN 0 THEN 'letter' ELSE 'circular' END AS type, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 2 END AS page FROM a WHERE kind < 3 AND (t <> '' OR kind = 1)),
            g AS (SELECT doc_id, min(batch) AS first, arg_min(title, batch) AS title, arg_min(type, batch) AS type, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM e GROUP BY doc_id, lower(title))
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS seq, title, type, pages, 'llm' AS source FROM g""",
        "pareto_front": f"WITH {cand} SELECT id, precision, recall, f1 FROM front",
        "prune_topk": f"WITH {cand} SELECT id, f1 FROM (SELECT c.*, row_number() OVER (ORDER BY f.id IS NULL, c.f1 DESC, c.id) AS r, count(f.id) OVER () AS n FROM c LEFT JOIN front f USING (id)) WHERE r <= greatest(12, n)",
        "train_val_split": f"WITH {truth_} SELECT gt_seq, CASE WHEN coalesce(page, 0) IN (2, 3, 5) THEN 'validation' ELSE 'train' END AS part FROM truth",
    }
