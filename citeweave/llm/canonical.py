"""Mapping of freely typed values to a reference list by a prefix-filter set-similarity join.

Distinct values only, and of these the distinct words. Tokens are padded letter bigrams, ordered by how rare they are; a typed
word and a word of the reference list (its code, label or what it covers) can only reach the Jaccard threshold if their rare prefixes share a
token, so only prefix tokens are joined. Length and positional filters cut candidates, Jaccard is verified exactly, then
edits or the form of an abbreviation decide. The threshold follows from the edits allowed. A value then goes to the entry
whose words have the greatest Jaccard with the words it was found to hold. Other names of an entry aren't listed here: a word
in a foreign language or of other letters is known only if the reference list or its own spelling leads to it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from citeweave.llm.titles import osa
from citeweave.runtime import Workspace, salted_lookup, tasks

#: English words that name nothing.
STOP_WORDS = set("a an and any anything as at be by else for from in is it n na nil no none nos not null of on one or see that the this to under unknown with".split())
#: times as frequent as a slip of it a way of writing is
USUAL = 4
#: two transpositions in a word of six letters leave one of its seven bigrams: 1 / 13
JACCARD = 0.07


def words_of(value: str | None) -> list[str]:
    """Distinct words of letters in lower case, plurals as singulars, without stop words."""
    found = re.findall(r"[^\W\d_]+", unicodedata.normalize("NFKC", value or "").casefold())
    return list(dict.fromkeys(w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in found if w not in STOP_WORDS))


def limit(n: int) -> int:
    """Edits within which a word of n letters is the same."""
    return 0 if n < 4 else 1 if n < 6 else 2


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a beginning of ``word`` of three letters or more, or a beginning and then consonants up to its last one."""
    if len(short) >= len(word) or len(short) < 3:
        return False
    k = next(i for i, (a, b) in enumerate(zip(short + " ", word)) if a != b)
    if k == len(short):
        return True
    tail, rest = short[k:], word[k:].rstrip("aeiouy")
    if k == 0 or not rest or any(c in "aeiouy" for c in tail) or tail[-1] != rest[-1]:
        return False
    at = iter(rest)
    return all(c in at for c in tail)


def cost(typed: str, word: str) -> int | None:
    """How far a typed word is from a word of the list: 0 equal, 1 abbreviation, then edits; None if it isn't that word."""
    if typed == word:
        return 0
    if abbreviates(typed, word):
        return 1
    n = limit(max(len(typed), len(word)))
    return d + 1 if (d := osa(typed, word, n)) <= n else None


def grams(text: str) -> list[str]:
    """Distinct padded bigrams of the words."""
    return sorted({w[i : i + 2] for w in (f"_{x}_" for x in text.split()) for i in range(len(w) - 1)})


@F.pandas_udf(ArrayType(StringType()))
def value_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(words_of)


@F.pandas_udf(ArrayType(StringType()))
def gram_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(grams)


@F.pandas_udf(IntegerType())
def costs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([cost(x, y) for x, y in zip(a, b)], dtype="Int32")


#: so marked, a filter on it isn't pushed below the exchange that spreads its rows over all cores
costs = costs.asNondeterministic()


def entries(types: DataFrame) -> DataFrame:
    """(type_code, form, size, r, head): words r of an entry as it may be called (code, label, either run together), head, and of what it covers.

    A form's words count as its size.
    """
    covers = value_words(F.coalesce(F.col("covers"), F.lit(""))) if "covers" in types.columns else F.array().cast("array<string>")
    code, label = value_words(F.regexp_replace("type_code", "_", " ")), value_words(F.coalesce("label", F.lit("")))
    t = types.select("type_code", code.alias("code"), label.alias("label"), covers.alias("covers"))
    forms = F.array_distinct(F.array("code", "label", F.array(F.array_join("code", "")), F.array(F.array_join("label", ""))))
    t = t.select("type_code", F.array_union(F.array_union("code", "label"), "covers").alias("every"), F.posexplode(F.filter(forms, lambda f: (F.size(f) > 0) & (f[0] != ""))).alias("form", "heads"))
    r = F.explode(F.array_union("heads", "every")).alias("r")
    return t.select("type_code", "form", F.size("heads").alias("size"), "heads", r).withColumn("head", F.array_contains("heads", F.col("r"))).drop("heads")


def set_similarity_join(ws: Workspace, left: DataFrame, right: DataFrame, threshold: float = JACCARD, longer: int | None = None) -> DataFrame:
    """(l, r, jaccard) of all texts l of ``left(l)`` and r of ``right(r)`` whose gram sets have at least that Jaccard, and at most ``longer`` letters more or less."""
    lg = ws.write(left.select("l", F.explode(gram_sets("l")).alias("g")))
    rg = ws.write(right.select("r", F.explode(gram_sets("r")).alias("g")))
    df = lg.select("g").unionByName(rg.select("g")).groupBy("g").agg(F.count("*").alias("df"))

    def prefixes(g: DataFrame, key: str) -> DataFrame:
        """Each text with its grams, rarest first, and a row for each gram of its prefix."""
        sets = g.join(df, "g").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias(f"{key}g"))
        n = F.size(f"{key}g")
        keep = n - F.ceil(n * threshold).cast("int") + 1
        return sets.select(key, f"{key}g", F.posexplode(F.slice(f"{key}g", F.lit(1), keep)).alias(f"{key}p", "g"))

    a, b = prefixes(lg, "l"), prefixes(rg, "r")
    na, nb = F.size("lg"), F.size("rg")
    need = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    cand = (
        a.repartition(tasks(ws.spark), "g").join(b.repartition(tasks(ws.spark), "g"), "g")
        .where(F.lit(True) if longer is None else F.abs(F.length("l") - F.length("r")) <= longer)
        .where((na >= nb * threshold) & (nb >= na * threshold))  # length filter
        .where(F.least(na - F.col("lp"), nb - F.col("rp")) + F.least("lp", "rp") >= need)  # positional filter
        .select("l", "r", "lg", "rg").dropDuplicates(["l", "r"])
    )
    shared = F.size(F.array_intersect("lg", "rg"))
    return cand.withColumn("jaccard", shared / (na + nb - shared)).where(F.col("jaccard") >= threshold - 1e-12).select("l", "r", "jaccard")


def map_values(spark: SparkSession, values: DataFrame, types: DataFrame, id_col: str = "rec_id", value_col: str = "type") -> DataFrame:
    """(rec_id, type_code): every row whose value is neither null nor blank nor exactly a code, with the entry it means or ``unmatched``.

    Words that the list doesn't know are set aside; the others' Jaccard with an entry's name counts what the entry covers as
    shared. Ties go to the smaller code. A value of punctuation or digits
    only, and every value none of whose words the list knows, is ``unmatched``. Repeated rows come out once; an empty table gives an empty one.
    """
    ws = Workspace(spark, "canonical")
    rows = values.select(F.col(id_col).alias("rec_id"), F.col(value_col).alias("value")).where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S"))
    counts = rows.groupBy("value").agg(F.count("*").alias("n")).join(types.select(F.col("type_code").alias("value")), "value", "left_anti")
    distinct = ws.write(counts.withColumn("words", value_words("value")))
    # a value is read as its words, and as one word
    read = distinct.select("value", "n", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("words").alias("w")), F.struct(F.lit(1).alias("way"), F.array(F.array_join("words", "")).alias("w")))).alias("x"))
    read = read.select("value", "n", "x.way", F.explode("x.w").alias("l")).where("l <> ''")
    listed = ws.write(entries(types))
    near = set_similarity_join(ws, read.select("l").distinct(), listed.select("r").distinct())
    priced = near.select("l", "r").repartition(tasks(spark), "l").withColumn("cost", costs("l", "r")).where("cost IS NOT NULL")
    nearest = priced.groupBy("l").agg(F.min("cost").alias("cost")).join(priced, ["l", "cost"]).select("l", "r")
    # a word unknown so far may be a slip of a way of writing that many others use and that is known
    known = ws.write(nearest)
    seen = ws.write(read.groupBy("l").agg(F.sum("n").alias("n")))
    used = known.select("l").distinct().join(seen, "l").select(F.col("l").alias("r"), F.col("n").alias("m")).where(F.col("m") >= USUAL)
    slips = set_similarity_join(ws, seen.join(known, "l", "left_anti").select("l"), used.select("r"), longer=limit(99)).select("l", "r").join(seen, "l").join(used, "r").where(F.col("m") >= USUAL * F.col("n"))
    slips = slips.repartition(tasks(spark), "l").withColumn("cost", costs("l", "r")).where("cost > 1")
    slips = slips.groupBy("l").agg(F.min_by("r", F.struct("cost", -F.col("m"), "r")).alias("v"))
    known = ws.write(known.unionByName(slips.join(known.select(F.col("l").alias("v"), "r"), "v").select("l", "r")))
    met = read.join(known, "l").join(listed, "r").groupBy("value", "way", "type_code", "form", "size").agg(F.countDistinct("l").alias("shared"), F.countDistinct(F.when(F.col("head"), F.col("r"))).alias("heads"))
    of = read.join(known.select("l").distinct(), "l", "left_semi").groupBy("value", "way").agg(F.count("*").alias("k"))
    scored = met.join(of, ["value", "way"]).withColumn("jaccard", F.col("shared") / (F.col("k") + F.col("size") - F.col("heads")))
    best = scored.groupBy("value").agg(F.min_by("type_code", F.struct(-F.col("jaccard"), "type_code")).alias("code"))
    table = ws.write(distinct.join(best, "value", "left").select("value", "n", F.coalesce("code", F.lit("unmatched")).alias("type_code")))
    return salted_lookup(rows.distinct(), table.select("value", "type_code"), "value", table.select("value", "n"), "n").select("rec_id", "type_code")
