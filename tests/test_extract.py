import re

import pytest

from citeweave.functions.text import parse_pages
from citeweave.operators import extract
from citeweave.patterns import PATTERNS
from citeweave.schemas import PAGES

CASES = [
    (1, "SEBI/HO/MRD/MRD-PoD-3/P/CIR/2024/65", "SEBI/HO/MRD/MRD-PoD-3/P/CIR/2024/65"), (1, "SEBI/HO/MRD/DOPI/CIR/P/2018/161", None), (1, "SEBI/HO/MRD2_DCAP/CIR/2021/0598", None),
    (2, "CIR/CFD/4/2012", "CIR/CFD/4/2012"), (2, "CIR/MRD/DP/21/2010", None), (3, "CIR/MRD/DP/21/2010", "MRD/DP/21/2010"), (3, "MRD/DoP/SE/Cir-28/2004", None),
    (4, "Master Circular for Stock Exchanges", "Master Circular for"), (4, "Master Circular dated October 16, 2023", "Master Circular dated"),
    (5, "SEBI (LODR) Regulations, 2015", "SEBI (LODR) Regulations, 2015"), (9, "Companies Act 2013", "Companies Act 2013"),
    (11, "Section 11(1) of the SEBI Act, 1992.", "Section 11(1) of the SEBI Act, 1992"), (11, "Section 11(1)(a) of the Companies Act, 2013.", None),
    (12, "Gazette of India, Part III", "Gazette of India"), (13, "Circular No. CIR/MRD/DP/21/2010 dated July 15, 2010", "Circular No. CIR/MRD/DP/21/2010 dated July 15, 2010"),
    (13, "SEBI letter dated January 5, 2023", None), (13, "Circular No. A/1 dated March 14, 1995 and circular of 2001", "Circular No. A/1 dated March 14, 1995 and circular of 2001"),
]


def test_golden_cases(spark):
    pages = spark.createDataFrame([(str(i), 1, t) for i, (_, t, _) in enumerate(CASES)], PAGES)
    got = {(r["doc_id"], r["pattern_id"]): r["match"] for r in extract.matches(pages).collect()}
    for i, (p, _, want) in enumerate(CASES):
        assert got.get((str(i), p)) == want, CASES[i]


def _plain(pages):
    """References in plain Python, for one document."""
    seen = {}
    for n, text in sorted(pages):
        for p in PATTERNS:
            for m in re.finditer(p.regex, text, re.IGNORECASE):
                t = re.sub(r"\s+", " ", m.group().strip())
                ref = seen.setdefault(t.lower(), [t, p.ref_type, []])
                if n not in ref[2]:
                    ref[2].append(n)
    return [(t, k, p) for t, k, p in seen.values()]


def test_references_equal_plain_python(spark):
    texts = [(1, "As per Companies Act,  2013 and CIR/CFD/4/2012.\nSee companies act, 2013"), (2, "COMPANIES ACT, 2013; letter no. X/1 dated May 1,\n2010"), (3, ""), (4, "Section 5 of the Income Tax Act, 1961, and Gazette of India")]
    rows = [("d", n, t) for n, t in texts] + [("e", 1, None)]
    got = extract.references(spark.createDataFrame(rows, PAGES)).orderBy("seq").collect()
    assert [(r["title"], r["type"], r["page_numbers"]) for r in got] == _plain(texts)
    assert [r["seq"] for r in got] == list(range(len(got)))


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], PAGES)
    assert extract.references(empty).count() == 0
    assert extract.stats(extract.references(empty)).first()["total"] == 0
    p = spark.createDataFrame([("d", 1, "CIR/CFD/4/2012")], PAGES).withColumn("title", F.lit("x")).withColumn("pos", F.lit(9)).withColumn("type", F.lit("y"))
    assert [r["title"] for r in extract.references(p).collect()] == ["CIR/CFD/4/2012"]


@pytest.mark.parametrize("spec,want", [("1,3,5-7", [1, 3, 5, 6, 7]), ("5-8", [5, 6, 7, 8]), ("8-5", []), ("", []), (None, []), ("2,2, 1", [1, 2])])
def test_page_grammar(spec, want):
    assert parse_pages(spec) == want


def test_page_grammar_junk():
    with pytest.raises(ValueError):
        parse_pages("x")


def test_first_page_order(spark):
    refs = spark.createDataFrame([("d", 0, "a", [5, 1]), ("d", 1, "b", [3]), ("d", 2, "c", []), ("d", 3, "e", None)], "doc_id string, seq bigint, title string, page_numbers array<int>")
    assert [r["title"] for r in extract.first_page_order(refs).orderBy("seq").collect()] == ["b", "a", "c", "e"]


def test_scan_reads_only_what_it_needs(spark, tmp_path):
    from citeweave.queries import pages

    spark.createDataFrame([("p", "d", 1, "CIR/CFD/4/2012", "2020-01-01")], "page_id string, doc_id string, page_num int, text string, scanned_at string").write.parquet(f"{tmp_path}/extract_pages.parquet")
    plan = extract.references(extract.select_pages(pages(spark, str(tmp_path)), [1]))._jdf.queryExecution().executedPlan().toString()
    assert "page_id" not in plan.split("ReadSchema")[1] and "PushedFilters" in plan and "In(page_num" in plan.replace("EqualTo(page_num", "In(page_num")
    assert "Python" not in plan


def test_stream_drops_repeats(spark, tmp_path):
    from citeweave.streaming.arrivals import stream_matches

    src = str(tmp_path / "in")
    rows = [("d", 1, "CIR/CFD/4/2012 and CIR/CFD/4/2012", "2020-01-01 00:00:00"), ("d", 1, "cir/cfd/4/2012", "2020-01-02 00:00:00"), ("d", 2, "CIR/CFD/4/2012", "2020-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, text string, scanned_at string").selectExpr("doc_id", "page_num", "text", "cast(scanned_at AS timestamp) AS scanned_at")
    df.write.parquet(src)
    q = stream_matches(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("arrivals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["page_num"], r["key"]) for r in spark.table("arrivals").collect()) == [(1, "cir/cfd/4/2012"), (2, "cir/cfd/4/2012")]


def test_what_a_pattern_needs_loses_no_match(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from citeweave.functions.text import folded

    few = ["SEBI/HO/MRD/P/CIR/2010/1", "cir/mrd/1/2010", "CDMRD-DEA/03/2015", "Master  Circular No. X-1", "SEBI (x) Regulation, 2010", "Securities and Exchange Board of India Act 1992", "Securities Contract (Regulation) Act, 1956"]
    few += ["Depositories Act, 1996", "Companies Act 2013", *(f"{x} 1999" for x in ("Prevention of Money Laundering Act", "Income Tax Act", "Indian Contract Act", "Foreign Exchange Management Act", "Insolvency and Bankruptcy Code"))]
    few += [*(f"{x} 2 of the bye-laws of it" for x in ("Section", "Regulation", "Rule", "Clause", "Chapter")), "Gazette of India", "letter no. X/1 dated May 1, 2010", "circular X/1 dated May 1, 2010", *(f"{x}/A/1/2010" for x in ("IMD", "MRD", "MIRSD", "OIAE", "CFD"))]
    odd = [t.replace("s", "ſ").replace("S", "ſ").replace("K", "K").replace("k", "K").replace("I", "ı").replace("i", "İ") for t in few]
    p = spark.createDataFrame([("d", n, t) for n, t in enumerate(few + odd + [x.swapcase() for x in few] + ["nothing"])], "doc_id string, page_num int, text string")
    told = lambda ps: sorted(map(tuple, extract.matches(p, ps).collect()))
    assert told(PATTERNS) == told([replace(x, needs=()) for x in PATTERNS]) and all(x.needs for x in PATTERNS)
    assert {r[2] for r in told(PATTERNS)} == set(range(1, 14)) and {r[1] for r in told(PATTERNS)} == set(range(3 * len(few)))
    chars = spark.createDataFrame([(chr(c),) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000], "c string").where(F.col("c").rlike("(?idU)^(?:" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$"))
    got = {r["c"]: r["f"] for r in chars.select("c", folded("c").alias("f")).collect()}
    assert len(got) == 56 and all(f in "abcdefghijklmnopqrstuvwxyz" for f in got.values())


def test_pages_are_matched_once_for_their_references(spark):
    p = spark.createDataFrame([("d", 1, "Companies Act 2013 and Companies Act 1956")], "doc_id string, page_num int, text string")
    from citeweave.runtime import Workspace

    found = extract.references(p, ws=Workspace(spark, "t"))
    assert found._jdf.queryExecution().toString().count("regexp_extract_all") == 0
    assert [tuple(r) for r in found.orderBy("seq").collect()] == [tuple(r) for r in extract.references(p).orderBy("seq").collect()] and found.count() == 2
