"""Similarity joins of titles within a document, computed once a pair of distinct titles.

Containment: a title that holds another holds its inner words too (those with a separator on either side), two neighbours
of them at a time. The held title asks for its rarest pair, holders stand under all of theirs, so only titles that share a
rare pair of words meet. Titles without an inner word meet all others of their document. With the ratio, documents that
are one pair of blocks need none of this: their titles are held against each other where their ratios are found.

Ratio: it has no such key. Distinct titles of a document are cut into blocks, each pair of blocks is one row, so a document
that holds a third of all rows is compared by as many tasks as it has pairs of blocks, and pairs are never moved: a task
bounds them on whole arrays (``functions.close``), many small documents together, and gives only those that reach the threshold, as rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.close import close_pairs
from citeweave.functions.text import graded, title_key
from citeweave.runtime import Workspace, salted_lookup, tasks
from citeweave.schemas import Settings

#: distinct titles of a block at least, pairs of blocks that a large document's titles are cut into if blocks may be larger
BLOCK, PAIRS = 2000, 128
#: pairs of titles up to which a document is compared together with others
SMALL = 50_000
#: keys asked for, above which holders aren't filtered by a bitmap of them before they are moved
ASKED = 10_000_000
#: bits of that bitmap, and parts in which it is made
BITS, PARTS = 1 << 27, 1024

_SEPARATOR = re.compile(r"[\W_]+")


def _words(text: str) -> set[str]:
    """What every holder of ``text`` holds too: pairs of neighbouring inner words; the inner word, if there is one only."""
    w = _SEPARATOR.split(text)[1:-1]
    return {f"{a} {b}" for a, b in zip(w, w[1:])} if len(w) > 1 else set(w)


def _all_words(text: str) -> set[str]:
    return _words(text) | {*_SEPARATOR.split(text)[1:-1]}


def _distinct(ws: Workspace, rows: DataFrame, seq: str, key: str, ids: str) -> DataFrame:
    """Distinct titles of a document with the ``seq`` of their rows in order."""
    t = rows.select("doc_id", title_key("title").alias(key), F.col(seq).cast("bigint").alias("_s")).where(F.col(key).isNotNull() & F.col("doc_id").isNotNull())
    return ws.write(t.groupBy("doc_id", key).agg(F.array_sort(F.collect_list("_s")).alias(ids)), n="count(1)")


def _blocks(ws: Workspace, a: DataFrame, b: DataFrame, block: int, most: int | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame, list[str], DataFrame | None]:
    """a and b with the keys under which each pair of blocks meets once, and the large documents, if any (``_large`` in a and b).

    With ``most``, blocks of up to so many titles where a document has enough of them for ``PAIRS`` pairs of blocks, since each block is
    moved once a block of the other side; with ``whole``, the right's are as large as may be.
    """
    sizes = a.select("doc_id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("doc_id", F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy("doc_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    fit = lambda n: F.greatest(F.lit(float(block)), F.least(F.lit(float(most or block)), n))
    right = F.lit(float(most)) if whole and most else fit(F.sqrt(F.col("x") * F.col("y") / PAIRS))
    j = F.ceil(F.col("y") / right)
    i = F.ceil(F.col("x") / fit(F.col("x") * j / PAIRS))
    many = sizes.where((F.col("x") > block) | (F.col("y") > block)).where("x > 0 AND y > 0").select("doc_id", i.cast("int").alias("i"), j.cast("int").alias("j"), (F.col("x") + F.col("y")).alias("n"))
    many = ws.write(many, n="count(1)")
    one = lambda t: t.select("*", *[F.lit(n).cast("bigint").alias(c) for c, n in (("i", 1), ("j", 1))], F.lit(False).alias("_large"))
    if many.metrics["n"]:
        told = lambda t: salted_lookup(t, many.drop("n"), "doc_id", many, "n")
        a, b = (one(t.join(many, "doc_id", "left_anti")).unionByName(told(t).select(*t.columns, F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.lit(True).alias("_large"))) for t in (a, b))
    else:
        a, b = one(a), one(b)
    return a.withColumn("_x", F.pmod(F.xxhash64("ka"), "i")), b.withColumn("_y", F.pmod(F.xxhash64("kb"), "j")), ["doc_id", "_x", "_y"], many.select("doc_id") if many.metrics["n"] else None


def _every(n: str):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))


def _frequent(ws: Workspace, *sides: DataFrame) -> dict[str, int]:
    """Words and pairs of words that stand in more than 1/5000 of all titles: never more than 5,000 times the words of a title."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for df in batches:
            for t in df["k"]:
                n.update(_all_words(t))
            if len(n) > 200_000:
                yield pd.DataFrame({"w": list(n), "c": list(n.values())})
                n.clear()
        yield pd.DataFrame({"w": list(n), "c": list(n.values())}, columns=["w", "c"]).astype({"w": "str", "c": "int64"})

    titles = sides[0].select(F.col("ka").alias("k")).unionByName(sides[1].select(F.col("kb").alias("k")))
    total = sum(t.metrics["n"] or 0 for t in sides)
    seen = titles.mapInPandas(count, "w string, c bigint").groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") > max(20, total // 5000))
    return {r["w"]: r["c"] for r in ws.write(seen).collect()}


def _holds(ws: Workspace, holders: DataFrame, held: DataFrame, k: str, h: str, frequent: dict[str, int], block: int, own: bool = True) -> DataFrame:
    """Rows of ``holders`` (title in ``k``) joined with those of ``held`` (title in ``h``) that they hold, within a document; if not ``own``, but for equal titles."""
    holds = F.col(k).contains(F.col(h)) if own else F.col(k).contains(F.col(h)) & (F.col(k) != F.col(h))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            best = [min(_words(t), key=lambda w: (frequent.get(w, 0), -len(w), w), default=None) for t in df[h]]
            yield df.assign(_w=best, _f=[w in frequent for w in best])

    at = F.xxhash64("doc_id", "_w").alias("_at")
    asked = ws.write(held.mapInPandas(pick, f"{_ddl(held)}, _w string, _f boolean").select("*", at), short="count_if(_w IS NULL)", n="count(_w)")
    wanted = {r["_w"] for r in asked.where("_f").select("_w").distinct().collect()}

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            words = [[w for w in _all_words(t) if w not in frequent or w in wanted] for t in df[k]]
            yield df.assign(_w=words).explode("_w").dropna(subset=["_w"])

    under = holders.mapInPandas(stand, f"{_ddl(holders)}, _w string").select(*holders.columns, at)
    asks = asked.where("_w IS NOT NULL").drop("_f", "_w")
    if (asked.metrics["n"] or 0) <= ASKED:
        under = under.where(_among(ws, asks)("_at"))
    met = under.alias("x").join(asks.alias("y"), (F.col("x._at") == F.col("y._at")) & (F.col("x.doc_id") == F.col("y.doc_id")))
    out = ws.write(met.where(holds).select("x.doc_id", *[c for c in holders.columns if c != "doc_id"], *[c for c in held.columns if c != "doc_id"]))
    if asked.metrics["short"]:
        short = asked.where("_w IS NULL").drop("_w", "_f", "_at")
        a, b, on, _ = _blocks(ws, *((holders, short) if k == "ka" else (short, holders)), block)
        met = a.withColumn("_y", _every("j")).drop("i", "j", "_large").join(b.withColumn("_x", _every("i")).drop("i", "j", "_large"), on).drop("_x", "_y")
        out = out.unionByName(met.where(holds).select(*out.columns))
    return out


def _among(ws: Workspace, asks: DataFrame):
    """Column function that tells keys nobody asks for, so that their rows aren't moved; some of those it lets pass.

    Tasks set the bits, each those of its own parts of the bitmap, so the driver gets 16 MB however many keys there are.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((PARTS, BITS // 8 // PARTS), np.uint8)
        for df in batches:
            _set(own.reshape(-1), df["b"].to_numpy(np.int64))
        some = np.flatnonzero(own.any(axis=1))
        yield pd.DataFrame({"part": some.astype("int32"), "bits": [own[i].tobytes() for i in some]})

    at = F.pmod("_at", F.lit(BITS)).cast("int")
    keys = asks.select(at.alias("b")).repartition(F.floor(F.col("b") / (BITS // PARTS)))
    bits = np.zeros((PARTS, BITS // 8 // PARTS), np.uint8)
    made = ws.write(keys.mapInPandas(fill, "part int, bits binary"))
    for r in made.collect():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    ws.drop(made)
    bits = bits.reshape(-1)

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        b = x.to_numpy(np.int64) & (BITS - 1)
        return pd.Series((bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool))

    return among


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _ddl(t: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)


def _held(ws: Workspace, a: DataFrame, b: DataFrame, block: int, same: bool = False, own: bool = True) -> DataFrame:
    """(doc_id, ka, ai, kb, bi): distinct titles of a document one of which holds the other. With ``same``, b has the rows of a; if not ``own``, equal titles don't come out."""
    frequent = _frequent(ws, a, b)
    cols = ["doc_id", "ka", "ai", "kb", "bi"]
    one = _holds(ws, a, b, "ka", "kb", frequent, block, own).select(*cols)
    other = one.select("doc_id", *[F.col(x).alias(y) for x, y in zip(cols[3:] + cols[1:3], cols[1:])]) if same else _holds(ws, b, a, "kb", "ka", frequent, block)
    return one.unionByName(other.where("ka <> kb").select(*cols))


def _close(ws: Workspace, a: DataFrame, b: DataFrame, s: Settings, block: int, later: bool = False, first: bool = False, exact: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, pi, gi, sim) of rows neither of whose titles holds the other and whose ratio reaches the threshold; the large documents, if any.

    In documents that aren't large also rows one of whose titles holds the other. If not ``exact``, sim may be part of the ratio, and says
    nothing of containment. With ``later`` only pi > gi; with ``first`` a title of the left goes with the first row of the right that its pair of blocks has.
    """
    x, y, on, large = _blocks(ws, a, b, block, 10 * block, first)
    told = lambda k, i: F.collect_list(F.struct(F.col(k).alias("k"), F.col(i).alias("r")))
    x = x.groupBy("doc_id", "_x", "j", "_large").agg(told("ka", "ai").alias("xs")).withColumn("_y", _every("j")).drop("j")
    y = y.groupBy("doc_id", "_y", "i").agg(told("kb", "bi").alias("ys")).withColumn("_x", _every("i")).drop("i")
    n = tasks(ws.spark) * (4 if large is not None else 1)  # pairs of blocks that fall to one task by chance matter less
    met = x.repartition(n, *on).join(y.repartition(n, *on), on).select("doc_id", *[F.col(f"{t}.{f}").alias(f"{t}{f}") for t in ("xs", "ys") for f in "kr"], "_large")

    def edges(some: list[tuple]) -> Iterator[pd.DataFrame]:
        xk, yk = ([k for row in some for k in row[c]] for c in (1, 3))
        xr, yr = ([(row[0], r) for row in some for r in row[c]] for c in (2, 4))
        lo = np.array([r[0] for _, r in yr], np.int64)
        after = (np.array([r[-1] for _, r in xr], np.int64), lo) if later else None
        order = np.argsort(np.argsort(lo, kind="stable")) if first else None

        def told() -> Iterator[tuple]:
            for row in some:
                if not row[5]:
                    yield from ((row[0], row[2][i], row[4][j], r) for i, j, r in _containing(row[1], row[3], s, exact))
            for i, j, r in close_pairs(xk, yk, s.match_threshold, order, after, [(len(row[1]), len(row[3])) for row in some] if len(some) > 1 else None, exact):
                yield *xr[i], yr[j][1], r

        rows = []
        for doc, ps, gs, r in told():
            rows += [(doc, p, g, r) for p in ps for g in (gs[:1] if first else gs) if not later or p > g]
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=["doc_id", "pi", "gi", "sim"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "pi", "gi", "sim"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        small: list[tuple] = []
        held = 0
        for df in batches:
            for row in df.itertuples(index=False, name=None):
                if len(row[1]) * len(row[3]) > SMALL:
                    yield from edges([row])
                    continue
                small.append(row)
                held += len(row[1]) + len(row[3])
                if held > block:
                    yield from edges(small)
                    small, held = [], 0
        if small:
            yield from edges(small)

    return met.mapInPandas(run, f"doc_id {a.schema['doc_id'].dataType.simpleString()}, pi bigint, gi bigint, sim double"), large


def _containing(xs: list[str], ys: list[str], s: Settings, grade: bool) -> Iterator[tuple[int, int, float]]:
    """(i, j, similarity as ``graded`` has it) of all pairs one of which holds the other; with ``grade`` only those that reach the threshold."""
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            if x in y if len(x) <= len(y) else y in x:
                short, long = sorted((len(x), len(y)))
                r = 1.0 if x == y else 0.75 + 0.25 * (short / long) if short >= s.containment_length else 0.5 + 0.5 * (short / long)
                if not grade or r >= s.match_threshold:
                    yield i, j, r


def _in_large(ws: Workspace, a: DataFrame, b: DataFrame, large: DataFrame | None, block: int, same: bool = False, own: bool = True) -> DataFrame | None:
    """``_held`` of the large documents; none if there are none."""
    if large is None:
        return None
    of = lambda t: ws.write(t.join(large, "doc_id", "left_semi"), n="count(1)")
    a, b = of(a), None if same else of(b)
    return _held(ws, a, _renamed(a) if same else b, block, same, own)


def _renamed(a: DataFrame) -> DataFrame:
    """Titles of the left as titles of the right."""
    b = a.select("doc_id", F.col("ka").alias("kb"), F.col("ai").alias("bi"))
    b.metrics = a.metrics
    return b


def _rows(pairs: DataFrame, first: bool = False) -> DataFrame:
    """Pairs of titles as pairs of rows."""
    one = pairs.withColumn("pi", F.explode("ai")).drop("ai")
    return one.withColumn("gi", F.col("bi")[0] if first else F.explode("bi")).drop("bi")


def duplicate_edges(left: DataFrame, right: DataFrame, ls: str = "seq", rs: str = "seq", s: Settings = Settings(), fuzzy: bool = True, later: bool = False, block: int = BLOCK, first: bool = False) -> DataFrame:
    """(doc_id, pi, gi): rows one of whose titles holds the other or whose ratio reaches the threshold, within a document.

    With ``later`` only rows of the left that come after those of the right, pi > gi. With ``first`` not all rows of the
    right, but the first one for each row of the left among them.
    """
    ws = Workspace(left.sparkSession, "titles")
    same = left is right and ls == rs
    a = _distinct(ws, left, ls, "ka", "ai")
    return _edges(ws, a, _renamed(a) if same else _distinct(ws, right, rs, "kb", "bi"), s, fuzzy, later, block, first, same)


def first_edges(spark: SparkSession, rows: DataFrame, seq: str, s: Settings = Settings(), fuzzy: bool = True, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((doc_id, pi, gi), pi > gi: the duplicates among the first rows of a document's titles; (doc_id, seq, other): those first rows with each other row of their title).

    A title of n rows is one row here, not n * n edges.
    """
    ws = Workspace(spark, "titles")
    every = _distinct(ws, rows, seq, "ka", "ai")
    a = every.withColumn("ai", F.slice("ai", 1, 1))
    a.metrics = every.metrics
    others = every.where(F.size("ai") > 1).select("doc_id", F.col("ai")[0].alias("seq"), F.explode("ai").alias("other")).where("seq <> other").distinct()
    return _edges(ws, a, _renamed(a), s, fuzzy, True, block, False, True, own=False), others


def _edges(ws: Workspace, a: DataFrame, b: DataFrame, s: Settings, fuzzy: bool, later: bool, block: int, first: bool, same: bool, own: bool = True) -> DataFrame:
    """``duplicate_edges`` of distinct titles. With ``own`` false no title is held against itself."""
    close, large = _close(ws, a, b, s, block, later, first, exact=False) if fuzzy else (None, None)
    hit = _in_large(ws, a, b, large, block, same, own) if fuzzy else _held(ws, a, b, block, same, own)
    if hit is None:
        return close.drop("sim")
    if later:
        hit = hit.where(F.element_at("ai", -1) > F.col("bi")[0])
    out = _rows(hit, first).select("doc_id", "pi", "gi")
    if later:
        out = out.where("pi > gi")
    return out.unionByName(close.drop("sim")) if fuzzy else out


def similarity_edges(predicted: DataFrame, truth: DataFrame, s: Settings = Settings(), fuzzy: bool = True, block: int = BLOCK, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, pi, gi, sim): predictions and ground truth of a document whose graded similarity reaches the threshold."""
    ws = ws or Workspace(predicted.sparkSession, "titles")
    a, b = _distinct(ws, predicted, "seq", "ka", "ai"), _distinct(ws, truth, "gt_seq", "kb", "bi")
    close, large = _close(ws, a, b, s, block) if fuzzy else (None, None)
    hit = _in_large(ws, a, b, large, block) if fuzzy else _held(ws, a, b, block)
    if hit is None:
        return close
    out = _rows(hit.withColumn("sim", graded("ka", "kb", s)).where(F.col("sim") >= s.match_threshold)).select("doc_id", "pi", "gi", "sim")
    return out.unionByName(close) if fuzzy else out


def equal_pairs(ws: Workspace, predicted: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs taken, predictions left, ground truth left) of the greedy pass over equal titles, which comes before all others.

    The k-th prediction of a title goes with its k-th ground-truth row, so a title cited n times on both sides is n rows, not n * n.
    """

    def side(t: DataFrame, seq: str, name: str) -> DataFrame:
        rows = t.select("doc_id", title_key("title").alias("k"), F.lit(name).alias("side"), F.col(seq).cast("bigint").alias("at"))
        return rows.where(F.col("k").isNotNull() & F.col("doc_id").isNotNull())

    rows = side(predicted, "seq", "p").unionByName(side(truth, "gt_seq", "g"))
    at = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("at")))).alias(n)
    met = ws.write(rows.groupBy("doc_id", "k").agg(at("p"), at("g")).withColumn("m", F.least(F.size("p"), F.size("g"))))
    both = met.where("m > 0").select("doc_id", F.explode(F.arrays_zip(*[F.slice(c, F.lit(1), F.col("m")).alias(c) for c in "pg"])).alias("x"))
    taken = both.select("doc_id", F.col("x.p").alias("pi"), F.col("x.g").alias("gi"), F.lit(1.0).alias("sim"))
    rest = lambda c, seq: met.where(F.size(c) > F.col("m")).select("doc_id", F.explode(F.slice(c, F.col("m") + 1, F.size(c) - F.col("m"))).alias(seq), F.col("k").alias("title"))
    return taken, rest("p", "seq"), rest("g", "gt_seq")
