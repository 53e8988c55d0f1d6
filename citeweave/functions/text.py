"""Column functions of the pipeline: normalised titles, containment, graded similarity, page ranges."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citeweave.schemas import Settings


def stripped(c: str | Column) -> Column:
    """Without white space at either end, of any kind (trim knows the blank only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_line(c: str | Column) -> Column:
    """Stripped, with each run of white space as one blank."""
    return F.regexp_replace(stripped(c), r"(?U)\s+", " ")


def title_key(c: str | Column) -> Column:
    return F.lower(stripped(c))


def folded(c: str | Column) -> Column:
    """In small letters; a character other than A to Z that a pattern takes for one of these, case aside, as that letter."""
    c = F.col(c) if isinstance(c, str) else c
    for like, letter in (("\u017f", "s"), ("\u212a", "k"), ("\u0130", "i"), ("\u0131", "i")):
        c = F.replace(c, F.lit(like), F.lit(letter))
    return F.lower(c)


def contained(a: str | Column, b: str | Column) -> Column:
    """Whether one key holds the other; an empty key is held by every other."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.contains(b) | b.contains(a)


def common(a: str, at: dict[str, int], full: int) -> int:
    """Length of the longest common subsequence of ``a`` and the text whose characters stand ``at`` bits of ``full``."""
    v = full
    for c in a:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return (full ^ v).bit_count()


def ratio_from(threshold: float):
    """Column function of two texts: their Ratcliff-Obershelp ratio, null below the threshold.

    Not symmetric, so the order of arguments matters. Matching blocks are a common subsequence, so the longest one bounds the ratio;
    texts to compare with come best in runs, since what is known of the second is kept.
    """

    @F.pandas_udf(DoubleType())
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher, last, at, full = SequenceMatcher(), None, {}, 0
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                if y != last:
                    last, at, full, new = y, {}, (1 << len(y)) - 1, True
                    for i, c in enumerate(y):
                        at[c] = at.get(c, 0) | 1 << i
                if 2 * common(x, at, full) < threshold * (len(x) + len(y)) - 1e-9:
                    out.append(None)
                    continue
                if new:
                    matcher.set_seq2(y)
                    new = False
                matcher.set_seq1(x)
                r = matcher.ratio()
                out.append(r if r >= threshold else None)
            yield pd.Series(out, dtype="float64")

    return ratio.asNondeterministic()  # so that a filter on it isn't pushed below the exchange that spreads the pairs over all cores


#: characters whose numbers are compared one by one
COUNTED = "etaoinsrhldcumfpgwybvk 0123/-"


def letter_counts(key: str, prefix: str) -> list[Column]:
    """Length of ``key`` (<prefix>len) and how often it has each of ``COUNTED``, then all others (<prefix>has)."""
    each = [F.length(key) - F.length(F.translate(key, x, "")) for x in COUNTED]
    return [F.length(key).alias(f"{prefix}len"), F.array(*each, F.length(F.translate(key, COUNTED, ""))).alias(f"{prefix}has")]


def may_reach(threshold: float) -> Column:
    """Upper bounds on the ratio of a pair with ``letter_counts`` under the prefixes a and b: by length, and by the characters two texts can share.

    Never refuses a pair that reaches it.
    """
    la, lb = F.col("alen"), F.col("blen")
    need = (la + lb) * (threshold / 2) - 1e-9
    shared = F.aggregate(F.zip_with("ahas", "bhas", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    return (F.least(la, lb) >= need) & (shared >= need)


def graded(a: str, b: str, s: Settings = Settings()) -> Column:
    """Similarity by containment: 1 for equal keys, a bonus that grows with the shorter's share, null where neither holds the other."""
    la, lb = F.length(a), F.length(b)
    short, long = F.least(la, lb), F.greatest(la, lb)
    share = F.try_divide(short.cast("double"), long.cast("double"))
    return F.when(F.col(a) == F.col(b), 1.0).when(contained(a, b), F.when(short >= s.containment_length, 0.75 + 0.25 * share).otherwise(0.5 + 0.5 * F.coalesce(share, F.lit(0.0))))


def parse_pages(spec: str | None) -> list[int]:
    """Sorted distinct page numbers of a text like ``1,3,5-7``; a reversed range is empty, junk raises ValueError."""
    out: set[int] = set()
    for part in (spec or "").split(",") if spec else []:
        low, dash, high = part.strip().partition("-")
        out |= set(range(int(low), int(high) + 1)) if dash else {int(low)}
    return sorted(out)
