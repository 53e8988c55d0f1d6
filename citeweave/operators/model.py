"""The language-model step as a dataflow: prompts by batch, calls by an injected client, strict parsing, coercion, verification.

Answers are written to shared storage before use, so that a lost task repeats neither a call that was answered nor changes a result.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import prompts
from citeweave.operators.extract import page_batches
from citeweave.operators.merge import clustered, collapse
from citeweave.runtime import Workspace, numbered
from citeweave.schemas import Settings


class Client(Protocol):
    """Anything that can be pickled and answers a prompt with text."""

    def __call__(self, prompt: str) -> str: ...


@dataclass
class Replay:
    """Recorded answers by the prompt's hash; a rule answers what isn't recorded. An exception recorded is raised."""

    answers: dict[str, str | Exception] = field(default_factory=dict)
    rule: Callable[[str], str] | None = None

    @staticmethod
    def key(prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()

    def __call__(self, prompt: str) -> str:
        got = self.answers.get(self.key(prompt))
        if isinstance(got, Exception):
            raise got
        if got is None:
            if self.rule is None:
                raise KeyError("no recorded answer")
            return self.rule(prompt)
        return got


@dataclass
class Http:
    """An endpoint with the common chat-completions interface; up to five tries with growing pauses."""

    url: str
    model: str
    temperature: float = 0.2
    max_tokens: int = 4096
    tries: int = 5
    least_s: float = 4
    most_s: float = 120

    def __call__(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}).encode()
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=600) as r:
                    return json.load(r)["choices"][0]["message"]["content"] or ""
            except Exception:
                if n == self.tries - 1:
                    raise
                time.sleep(min(self.most_s, max(self.least_s, 2 * 2**n)))
        raise AssertionError


def _ask(client: Client, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            raw, error = [], []
            for p in df["prompt"]:
                try:
                    raw.append(client(p) if isinstance(p, str) else None)
                    error.append(None if isinstance(p, str) else "no prompt")
                except Exception as e:  # a failed call is data, not a failed task
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}"[:300])
            yield df[keys].assign(raw=raw, error=error)

    return run


def ask(spark: SparkSession, table: DataFrame, client: Client, keys: list[str]) -> DataFrame:
    """keys, raw, error of each row's ``prompt``, written before anything reads it."""
    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
    return Workspace(spark, "answers").write(table.select(*keys, "prompt").mapInPandas(_ask(client, keys), f"{kinds}, raw string, error string"))


def shown(refs: DataFrame, n: int, suffix: bool = True) -> DataFrame:
    """(doc_id, existing_refs): the first ``n`` known titles of a document, one a line."""
    k = numbered(Workspace(refs.sparkSession, "shown"), refs.select("doc_id", "seq", "title"), ["doc_id"], ["seq"], "k")
    ranked = k.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("k") < n, F.struct("k", "title")))).alias("t"), F.count("*").alias("all"))
    lines = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["title"])), "\n")
    more = F.when((F.col("all") > n) & F.lit(suffix), F.concat(F.lit("\n... and "), (F.col("all") - n).cast("string"), F.lit(" more"))).otherwise("")
    return ranked.select("doc_id", F.concat(lines, more).alias("existing_refs"))


def batch_prompts(pages: DataFrame, refs: DataFrame | None, template: str = prompts.EXTRACT, s: Settings = Settings(), n: int | None = None) -> DataFrame:
    """(doc_id, batch, pages, prompt): consecutive pages of a document in one prompt, with the references known already."""
    block = F.concat(F.lit("\n--- Page "), F.col("page_num").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    b = page_batches(pages, s.page_batch).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("page_num", block.alias("block")))).alias("p"))
    known = b.withColumn("existing_refs", F.lit("(none)")) if refs is None else b.join(shown(refs, n or s.shown_references, n is None), "doc_id", "left").withColumn("existing_refs", F.coalesce("existing_refs", F.lit("(none)")))
    text = F.array_join(F.transform("p", lambda x: x["block"]), "")

    @F.pandas_udf("string")
    def fill(existing: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([prompts.formatted(template, e, t) for e, t in zip(existing, body)], dtype=object)

    return known.select("doc_id", "batch", F.transform("p", lambda x: x["page_num"]).alias("pages"), fill("existing_refs", text).alias("prompt"))


def parse_list(raw: str | None) -> list:
    """The array in an answer, fence taken off; an empty list for anything else."""
    try:
        got = json.loads(prompts.without_fence(raw or "", "json"))
    except ValueError:
        return []
    return got if isinstance(got, list) else []


def parse_object(raw: str | None) -> dict | None:
    try:
        got = json.loads(prompts.without_fence(raw or "", "json"))
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _int(x) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError, OverflowError):
        return None


def coerced(element, batch_pages: list[int] | None, default_type: str = "circular") -> tuple[str, str, list[int]] | None:
    """(title, type, pages) of one element of an answer, None if it names nothing. Pages that are no whole numbers are left out."""
    if not isinstance(element, dict):
        return None
    if "title" in element:
        title = element["title"]
    elif "Date" in element and "Details" in element:
        title = f"{element['Date']} - {element['Details']}"
    elif "date" in element and "details" in element:
        title = f"{element['date']} - {element['details']}"
    else:
        return None
    if not isinstance(title, str) or not title.strip():
        return None
    nums = element.get("page_numbers", batch_pages if batch_pages is not None else [])
    nums = nums if isinstance(nums, list) else [nums]
    kind = element.get("type", default_type)
    return title.strip(), kind if isinstance(kind, str) else default_type, [n for n in map(_int, nums) if n is not None]


def coerce(answers: DataFrame, default_type: str = "circular", fill_pages: bool = True) -> DataFrame:
    """(doc_id, batch, pos, title, type, page_numbers) of answers (doc_id, batch, pages, raw). Bad answers yield nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for d, b, pages, raw in df[["doc_id", "batch", "pages", "raw"]].itertuples(index=False):
                for pos, e in enumerate(parse_list(raw)):
                    if (c := coerced(e, list(map(int, pages)) if fill_pages and pages is not None else None, default_type)) is not None:
                        rows.append((d, b, pos, *c))
            yield pd.DataFrame(rows, columns=["doc_id", "batch", "pos", "title", "type", "page_numbers"])

    return answers.select("doc_id", "batch", "pages", "raw").mapInPandas(run, "doc_id string, batch int, pos int, title string, type string, page_numbers array<int>")


def grouped(elements: DataFrame) -> DataFrame:
    """References of the model: one a document and title (case aside), the first spelling and type, pages in order of sight."""
    ord_ = F.struct("batch", "pos")
    g = elements.withColumn("key", F.lower("title")).groupBy("doc_id", "key").agg(
        F.min(ord_).alias("ord"), F.min_by(F.struct("title", "type"), ord_).alias("f"),
        F.transform(F.array_sort(F.collect_list(F.struct("batch", "pos", "page_numbers"))), lambda x: x["page_numbers"]).alias("lists"),
    )
    # the first list as it is, repeats included, then what later ones add
    first = F.element_at("lists", 1)
    added = F.array_except(F.array_distinct(F.flatten("lists")), first)
    g = numbered(Workspace(elements.sparkSession, "grouped"), g, ["doc_id"], ["ord"], "seq")
    return g.select("doc_id", "seq", "f.title", "f.type", F.concat(first, added).alias("page_numbers"), F.lit("llm").alias("source"))


def extract(spark: SparkSession, pages: DataFrame, refs: DataFrame | None, client: Client, template: str = prompts.EXTRACT, s: Settings = Settings(), search: bool = False) -> DataFrame:
    """References that the model finds. ``search``: the stricter defaults of the prompt search (more known titles shown, type other, no pages)."""
    table = batch_prompts(pages, refs, template, s, s.shown_references_search if search else None)
    answers = ask(spark, table, client, ["doc_id", "batch", "pages"])
    return grouped(coerce(answers.where("error IS NULL"), "other" if search else "circular", not search))


def deduplicate(spark: SparkSession, refs: DataFrame, client: Client | None = None, s: Settings = Settings()) -> DataFrame:
    """refs collapsed by containment; the model names the title of clusters of two to four rows, the longest title stands where it can't."""
    ws = Workspace(spark, "clusters")
    c = ws.write(clustered(spark, refs))
    if client is None:
        out = collapse(c)
        ws.drop(c)
        return out
    member = F.struct("seq", F.struct("title", "page_numbers").alias("m"))
    small = c.where("NOT alone").groupBy("doc_id", "seed").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(member)).alias("m")).where((F.col("k") > 1) & (F.col("k") <= s.dedup_cluster_limit))
    cluster = F.to_json(F.transform("m", lambda x: x["m"]))
    head, tail = prompts.CANONICAL.split("{cluster}")
    asked = ask(spark, small.select("doc_id", "seed", F.concat(F.lit(head), cluster, F.lit(tail)).alias("prompt")), client, ["doc_id", "seed"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for d, seed, raw in df[["doc_id", "seed", "raw"]].itertuples(index=False):
                o = parse_object(raw)
                title = o.get("canonical_title") if o else None
                if isinstance(title, str):
                    more = o.get("merged_page_numbers")
                    rows.append((d, seed, title.strip(), [n for n in map(_int, more) if n is not None] if isinstance(more, list) else []))
            yield pd.DataFrame(rows, columns=["doc_id", "seed", "title", "pages"])

    out = collapse(c, asked.where("raw IS NOT NULL").mapInPandas(read, "doc_id string, seed bigint, title string, pages array<int>"))
    ws.drop(c)  # the rows of out are written
    return out


def verify(spark: SparkSession, refs: DataFrame, client: Client, s: Settings = Settings()) -> DataFrame:
    """refs that the model keeps, in batches of a document. A failed or empty answer, or one that keeps too few, keeps its batch;
    if over all too few were kept of a document, nothing of it is filtered."""
    b = numbered(Workspace(spark, "verify"), refs, ["doc_id"], ["seq"], "_n").withColumn("batch", F.floor(F.col("_n") / s.verify_batch).cast("int")).drop("_n")
    head, tail = prompts.VERIFY.split("{titles}")
    table = b.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("t"))
    table = table.withColumn("prompt", F.concat(F.lit(head), F.to_json(F.transform("t", lambda x: x["title"])), F.lit(tail)))
    answers = ask(spark, table, client, ["doc_id", "batch", "n"])

    @F.pandas_udf("array<string>")
    def kept_titles(raw: pd.Series) -> pd.Series:
        pick = lambda e: e if isinstance(e, str) else e["title"] if isinstance(e, dict) and isinstance(e.get("title"), str) else None
        return pd.Series([[t.strip().lower() for t in map(pick, parse_list(r)) if t is not None] for r in raw])

    read = answers.withColumn("kept", kept_titles(F.coalesce("raw", F.lit("")))).withColumn("k", F.size("kept"))
    read = read.withColumn("open", (F.col("k") == 0) | (F.col("k") < F.col("n") * s.verify_batch_floor))
    whole = read.groupBy("doc_id").agg((F.sum("k") < F.sum("n") * s.verify_global_floor).alias("skip"))
    named = read.select("doc_id", F.explode("kept").alias("key")).unionByName(b.join(read.where("open").select("doc_id", "batch"), ["doc_id", "batch"]).select("doc_id", F.lower("title").alias("key"))).distinct()
    key = F.lower(F.regexp_replace("title", r"(?U)^\s+|\s+$", ""))
    marked = refs.withColumn("key", key).join(whole, "doc_id", "left").join(named.withColumn("named", F.lit(True)), ["doc_id", "key"], "left")
    return marked.where("coalesce(skip, false) OR named").select(*refs.columns)
