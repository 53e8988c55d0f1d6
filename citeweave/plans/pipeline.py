"""The whole pipeline: extract, evaluate, and the command line."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from citeweave.functions import prompts
from citeweave.functions.text import parse_pages
from citeweave.operators import evaluate as ev
from citeweave.operators import extract as ex
from citeweave.operators import merge, model
from citeweave.patterns import PATTERNS, Pattern
from citeweave.runtime import Workspace, clear
from citeweave.schemas import Settings


def extract(spark: SparkSession, pages: DataFrame, client: model.Client | None = None, wanted: Sequence[int] | None = None, verify: bool = True, patterns: Sequence[Pattern] = PATTERNS, template: str = prompts.EXTRACT, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(references, stats) of pages (doc_id, page_num, text).

    Without a client only the patterns speak, and order and duplicates stay as found. With one: model pass, merge, order by
    first page, collapse, verification.
    """
    pages = ex.select_pages(pages, wanted)
    refs = ex.references(pages, patterns)
    if client is None:
        return refs, ex.stats(refs)
    ws = Workspace(spark, "pipeline")
    refs = ws.write(refs)
    found = ws.write(model.extract(spark, pages, refs, client, template, s))
    merged = ws.write(ex.first_page_order(merge.merge_first_match(spark, refs, found, s), s.first_page_missing))
    out = ws.write(model.deduplicate(spark, merged, client, s))
    if verify:
        out = ws.write(model.verify(spark, out, client, s))
    return out, ex.stats(out)


def evaluate(spark: SparkSession, pages: DataFrame, truth: DataFrame, client: model.Client, s: Settings = Settings()) -> dict[str, DataFrame]:
    """comparison of the patterns alone with the whole pipeline, plus what the model added and what is still missed."""
    regex, _ = extract(spark, pages, s=s)
    ws = Workspace(spark, "evaluation")
    regex = ws.write(regex)
    hybrid, _ = extract(spark, pages, client, s=s)
    runs = {"regex_only": ev.metrics(spark, regex, truth, s), "hybrid": ev.metrics(spark, hybrid, truth, s)}
    return runs | {"comparison": ev.comparison(runs), "llm_only": hybrid.where("source = 'llm'"), "missed": ev.missed_listing(hybrid, truth, s)}


def main(argv: Sequence[str] | None = None) -> int:
    """extract | evaluate | optimize | evolve, over documents or a table of pages (parquet)."""
    p = argparse.ArgumentParser(prog="citeweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "evaluate", "optimize", "evolve"):
        c = sub.add_parser(name)
        c.add_argument("pages", help="a PDF, a text with form feeds, or a parquet table of pages")
        if name != "extract":
            c.add_argument("truth", help="JSON array of title, type, page")
        c.add_argument("--endpoint")
        c.add_argument("--model", default="")
        if name == "extract":
            c.add_argument("--pages", dest="wanted", help="like 1,3,5-7")
            c.add_argument("--regex-only", action="store_true")
            c.add_argument("--no-verify", action="store_true")
            c.add_argument("--output")
        if name in ("optimize", "evolve"):
            c.add_argument("--iterations", type=int, default=2 if name == "optimize" else 5)
            c.add_argument("--save-to")
        if name == "evolve":
            c.add_argument("--population", type=int, default=4)
            c.add_argument("--minibatch", type=int, default=4)
    a = p.parse_args(argv)
    from citeweave.sources import readers

    spark = SparkSession.builder.appName("citeweave").getOrCreate()
    if a.pages.endswith(".parquet"):
        pages = readers.page_table(spark.read.parquet(a.pages))
    else:
        pages = readers.documents(spark, a.pages, readers.pdf_parser if a.pages.lower().endswith(".pdf") else readers.text_parser)
    client = model.Http(a.endpoint, a.model) if a.endpoint else None
    if client is None and not (a.command == "extract" and a.regex_only):
        p.error("--endpoint is needed" + (", or --regex-only" if a.command == "extract" else ""))
    try:
        return _run(spark, p, a, pages, client)
    finally:
        clear(spark)


def _run(spark: SparkSession, p: argparse.ArgumentParser, a: argparse.Namespace, pages: DataFrame, client: model.Client | None) -> int:
    from citeweave.operators import search
    from citeweave.sources import readers, sinks

    if a.command == "extract":
        refs, st = extract(spark, pages, None if a.regex_only else client, parse_pages(a.wanted), not a.no_verify)
        refs = Workspace(spark, "result").write(refs)
        sinks.lines(st)
        sinks.lines(sinks.listing(refs))
        if a.output:
            sinks.write_result(refs, a.output) if not a.pages.endswith(".parquet") else sinks.write_lines(refs, a.output)
        return 0
    docs = pages.select("doc_id").distinct().limit(2).collect()
    truth = readers.ground_truth(spark, a.truth, docs[0][0] if len(docs) == 1 else None)
    if len(docs) > 1 and not truth.where("doc_id IS NULL").isEmpty():
        p.error("several documents: each entry of the ground truth must name its doc_id")
    if a.command == "evaluate":
        out = evaluate(spark, pages, truth, client)
        for name in ("comparison", "llm_only", "missed"):
            sinks.lines(out[name])
    elif a.command == "optimize":
        history, _ = search.iterate(search.Evaluator(spark, pages, truth, client), client, iterations=a.iterations, save_to=a.save_to)
        sinks.lines(sinks.history_table(spark, history))
    else:
        e = search.Evolution(search.Evaluator(spark, pages, truth, client), client, population_size=a.population, iterations=a.iterations, minibatch_pages=a.minibatch, save_to=a.save_to)
        sinks.lines(sinks.history_table(spark, e.run()["history"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
