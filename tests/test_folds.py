import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeweave.operators import evaluate, merge
from citeweave.operators.ordered import first_fit_pairs, first_seeds, greedy_pairs
from citeweave.operators.similarity import duplicate_edges, similarity_edges
from citeweave.schemas import REFERENCES

TRUTH = "doc_id string, gt_seq bigint, title string, type string, page int"


def dup(a, b, t=0.75):
    a, b = a.lower().strip(), b.lower().strip()
    return a in b or b in a or SequenceMatcher(None, a, b).ratio() >= t


def sim(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if a in b or b in a:
        s, n = sorted((len(a), len(b)))
        return 0.75 + 0.25 * s / n if s >= 10 else 0.5 + 0.5 * s / n
    return SequenceMatcher(None, a, b).ratio()


def titles(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = f"Circular {r.choice(['MRD', 'CFD', 'IMD'])}/{r.randrange(30)}/{r.choice([2010, 2011])}" + r.choice(["", " dated May 1, 2010", " on margins", "."])
        out.append(r.choice([t, t.upper(), t[: r.randrange(3, len(t))], " " + t]))
    return out


def refs(spark, rows, source):
    return spark.createDataFrame([(d, i, t, f"type{i % 3}", [i % 4, 7], source) for d, x in rows.items() for i, t in enumerate(x)], REFERENCES)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_and_clusters_equal_the_sequential_pass(spark, seed):
    old, new = {"a": titles(seed, 14), "b": titles(seed + 9, 3)}, {"a": titles(seed + 1, 16), "b": titles(seed + 5, 6), "c": ["only new", "ONLY NEW x"]}
    got, plain = merge.merge_first_match(spark, refs(spark, old, "regex"), refs(spark, new, "llm")).collect(), merge.merge_new_only(spark, refs(spark, old, "regex"), refs(spark, new, "llm")).collect()
    for d in "abc":
        want = [[t, "regex", [i % 4, 7], f"type{i % 3}"] for i, t in enumerate(old.get(d, []))]
        only = [w[0] for w in want]
        for i, t in enumerate(new[d]):
            hit = next((w for w in want if dup(t, w[0])), None)
            if hit:
                hit[1] = "both"
                hit[2] += [p for p in [i % 4, 7] if p not in hit[2]]
            else:
                want.append([t, "llm", [i % 4, 7], f"type{i % 3}"])
            if not any(dup(t, x) for x in only):
                only.append(t)
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["seq"])
        assert [[r["title"], r["source"], list(dict.fromkeys(r["page_numbers"])), r["type"]] for r in mine] == [[a, b, list(dict.fromkeys(c)), t] for a, b, c, t in want]
        assert [r["title"] for r in sorted((r for r in plain if r["doc_id"] == d), key=lambda r: r["seq"])] == only
    clustered = merge.seed_clusters(spark, refs(spark, new, "llm"))
    seeds = {(r["doc_id"], r["seq"]): r["seed"] for r in clustered.collect()}
    for d, x in new.items():
        owner = {}
        for i, a in enumerate(x):
            if i not in owner:
                owner[i] = i
                for j in range(i + 1, len(x)):
                    p, q = a.lower().strip(), x[j].lower().strip()
                    if j not in owner and (p in q or q in p):
                        owner[j] = i
        assert {i: seeds[(d, i)] for i in range(len(x))} == owner
    out = merge.collapse(clustered).collect()
    assert len(out) == len({(d, s) for (d, _), s in seeds.items()})


def test_greedy_and_first_fit_equal_the_sequential_pass(spark):
    r = random.Random(5)
    edges = [("d", p, g, r.choice([0.75, 0.8, 0.9, 1.0])) for p in range(12) for g in range(9) if r.random() < 0.4] + [("e", 1, 1, 1.0)]
    e = spark.createDataFrame(edges + edges[:3], "doc_id string, pi bigint, gi bigint, sim double")
    up, ug, want = set(), set(), set()
    for s, p, g in sorted(((-s, p, g) for d, p, g, s in edges if d == "d")):
        if p not in up and g not in ug:
            up.add(p), ug.add(g), want.add((p, g))
    assert {(x["pi"], x["gi"]) for x in greedy_pairs(spark, e).where("doc_id = 'd'").collect()} == want
    ug, want = set(), set()
    for p in range(12):
        g = next((g for g in range(9) if g not in ug and any(x[:3] == ("d", p, g) for x in edges)), None)
        if g is not None:
            ug.add(g), want.add((p, g))
    assert {(x["pi"], x["gi"]) for x in first_fit_pairs(spark, e).where("doc_id = 'd'").collect()} == want


def _tables(spark, f):
    """(rows of the result, tables written for it)."""
    from citeweave.runtime import Workspace

    before = Workspace.tables
    rows = f().collect()
    return rows, Workspace.tables - before


@pytest.mark.parametrize("solo", [None, 100])
def test_jobs_are_bounded_whatever_the_order(spark, solo):
    how = {} if solo is None else {"solo": solo}
    k = 1000
    path = spark.range(k).selectExpr("'d' AS doc_id", "id AS a", "id + 1 AS b")
    rows, n = _tables(spark, lambda: first_seeds(spark, path, **how))
    assert n < 25 and {(r["member"], r["seed"]) for r in rows} == {(i, i - i % 2) for i in range(k + 1) if i < k or i % 2}
    block = spark.range(k).selectExpr("id AS pi").crossJoin(spark.range(k).selectExpr("id AS gi")).selectExpr("'d' AS doc_id", "pi", "gi", "0.8D AS sim")
    rows, n = _tables(spark, lambda: greedy_pairs(spark, block, **how))
    assert n < 25 and {(r["pi"], r["gi"]) for r in rows} == {(i, i) for i in range(k)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_and_stream_agree(spark, seed):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(150)})
    e = spark.createDataFrame([(d, a, b) for d in ("x", "y") for a, b in pairs] + [("z", 1, 2)], "doc_id string, a bigint, b bigint")
    want = {tuple(x) for x in first_seeds(spark, e).collect()}
    assert {tuple(x) for x in first_seeds(spark, e, solo=20, rounds=2).collect()} == want and ("z", 2, 1) in want
    m = e.selectExpr("doc_id", "a AS pi", "b AS gi", "round(rand(3), 1) AS sim")
    assert sorted(map(tuple, greedy_pairs(spark, m, solo=20, rounds=2).collect())) == sorted(map(tuple, greedy_pairs(spark, m).collect()))


def test_blocks_equal_brute_force(spark):
    pred, gt = titles(7, 60), titles(8, 50)
    p, g = refs(spark, {"d": pred, "e": pred[:3]}, "regex"), spark.createDataFrame([("d", i, t, "circular", None) for i, t in enumerate(gt)], TRUTH)
    want = {(i, j) for i, a in enumerate(pred) for j, b in enumerate(gt) if dup(a, b)}
    for block in (7, 2000):
        got = duplicate_edges(p, g, "seq", "gt_seq", block=block).collect()
        assert len(got) == len(want) and {(r["pi"], r["gi"]) for r in got} == want
        assert {(r["pi"], r["gi"]) for r in similarity_edges(p, g, block=block).collect()} == {(i, j) for i, a in enumerate(pred) for j, b in enumerate(gt) if sim(a, b) >= 0.75}
    later = duplicate_edges(p, p, block=7, later=True).where("doc_id = 'd'").collect()
    assert {(r["pi"], r["gi"]) for r in later} == {(i, j) for i, a in enumerate(pred) for j, b in enumerate(pred) if j < i and dup(a, b)}


def test_greedy_of_repeated_titles(spark):
    pred, gt = ["Act 1"] * 40 + titles(3, 12) + ["act 1 "] * 5, titles(3, 12) + ["ACT 1"] * 30 + ["Act 1 of 2013"] * 3
    p, g = refs(spark, {"d": pred}, "regex"), spark.createDataFrame([("d", i, t, "circular", None) for i, t in enumerate(gt)], TRUTH)
    up, ug, want = set(), set(), set()
    for s, i, j in sorted((-sim(a, b), i, j) for i, a in enumerate(pred) for j, b in enumerate(gt) if sim(a, b) >= 0.75):
        if i not in up and j not in ug:
            up.add(i), ug.add(j), want.add((i, j, -s))
    assert {(r["pi"], r["gi"], r["sim"]) for r in evaluate.match(spark, p, g).collect()} == want


def test_numbers_of_a_hot_key(spark):
    from citeweave.runtime import Workspace, numbered

    df = spark.range(5000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 > 0 THEN concat('k', id) END AS k", "hash(id) AS at", "id AS seq")
    got = {(r["k"], r["at"]): r["n"] for r in numbered(Workspace(spark, "t"), df, ["k"], ["at"], "n").collect()}
    want = {}
    for key in {k for k, _ in got}:
        want |= {(key, at): n for n, at in enumerate(sorted(a for k, a in got if k == key))}
    assert got == want and len(got) == 5000


def test_rounding_is_to_even(spark):
    row = spark.range(1).select(*evaluate.scores(F.lit(1), F.lit(16), F.lit(2000))).first()
    assert (row["precision"], row["recall"]) == (round(1 / 16, 3), round(1 / 2000, 3)) == (0.062, 0.001)


def test_metrics(spark):
    pred, gt = titles(3, 18), titles(4, 11)
    p, g = refs(spark, {"d": pred}, "regex"), spark.createDataFrame([("d", i, t, "circular", None) for i, t in enumerate(gt)], TRUTH)
    want = {(i, j): sim(a, b) for i, a in enumerate(pred) for j, b in enumerate(gt) if sim(a, b) >= 0.75}
    assert {(r["pi"], r["gi"]): round(r["sim"], 9) for r in similarity_edges(p, g).collect()} == {k: round(v, 9) for k, v in want.items()}
    assert {(r["pi"], r["gi"]) for r in duplicate_edges(p, g, "seq", "gt_seq").collect()} == {(i, j) for i, a in enumerate(pred) for j, b in enumerate(gt) if dup(a, b)}
    m = evaluate.metrics(spark, p, g).first()
    assert m["tp"] + m["fp"] == len(pred) and m["tp"] + m["fn"] == len(gt) and m["tp"] > 0
    none = evaluate.metrics(spark, p, g.limit(0)).first()
    assert [none[k] for k in ("precision", "recall", "f1", "tp", "fp", "fn")] == [0, 0, 0, 0, 0, 0]
    none = evaluate.metrics(spark, p.limit(0), g).first()
    assert (none["precision"], none["fn"]) == (0, len(gt))
    assert evaluate.missed_listing(p, g).count() == len(gt) - len({j for _, j in want})


def test_empty_edges(spark):
    assert first_seeds(spark, spark.createDataFrame([], "doc_id string, a bigint, b bigint")).count() == 0
    assert greedy_pairs(spark, spark.createDataFrame([], "doc_id string, pi bigint, gi bigint, sim double")).count() == 0


def test_collapse_pages_and_sources(spark):
    rows = [("d", 0, "Act 2013", "act", [5, 1], "regex"), ("d", 1, "Companies Act 2013", "law", [2, 1], "llm"), ("d", 2, "Other", "x", [9, 3], "llm")]
    out = {r["title"]: r for r in merge.collapse(merge.seed_clusters(spark, spark.createDataFrame(rows, REFERENCES))).collect()}
    assert out["Companies Act 2013"]["page_numbers"] == [1, 2, 5] and out["Companies Act 2013"]["source"] == "both" and out["Companies Act 2013"]["type"] == "law"
    assert out["Other"]["page_numbers"] == [9, 3]


def test_held_titles_equal_brute_force(spark):
    from citeweave.operators.similarity import _all_words, _words

    r = random.Random(5)
    whole = [f"circular no. cfd/{r.choice(['ab', 'abc', 'x'])}/cir-{r.randrange(30)}/2010 dated may {r.randrange(9)}, 2011" for _ in range(60)]
    cut = [t[r.randrange(len(t)) :][: r.randrange(1, 40)] for t in whole] + ["", "cir", "-", "no. cfd", " x ", "éé/ab"]
    for a in whole + cut:
        for b in cut:
            assert b not in a or _words(b) <= _all_words(a), (a, b)
    p, g = refs(spark, {"d": whole}, "regex"), spark.createDataFrame([("d", i, t, "circular", None) for i, t in enumerate(cut)], TRUTH)
    got = {(x["pi"], x["gi"]) for x in duplicate_edges(p, g, "seq", "gt_seq", fuzzy=False).collect()}
    key = lambda t: t.strip().lower()
    assert got == {(i, j) for i, a in enumerate(whole) for j, b in enumerate(cut) if key(b) in key(a) or key(a) in key(b)}


def test_pairs_of_blocks_equal_brute_force():
    import numpy as np

    from citeweave.functions.close import close_pairs, ratio

    r = random.Random(6)
    some = [("".join(r.choice("abc /") for _ in range(r.randrange(40))), "".join(r.choice("abc /") for _ in range(r.randrange(40)))) for _ in range(2000)]
    assert all(ratio(a, b) == SequenceMatcher(None, a, b).ratio() for a, b in some)
    xs, ys = [t.lower().strip() for t in titles(4, 80)] + ["", "sebi " * 50], [t.lower().strip() for t in titles(5, 70)] + ["sebi " * 45 + "x", "é" * 70]
    want = [(i, j, SequenceMatcher(None, a, b).ratio()) for i, a in enumerate(xs) for j, b in enumerate(ys) if not (a in b or b in a)]
    want = [w for w in want if w[2] >= 0.75]
    assert sorted(close_pairs(xs, ys, 0.75)) == want
    first: dict = {}
    for w in want:
        first.setdefault(w[0], w)
    assert sorted(close_pairs(xs, ys, 0.75, np.arange(len(ys)))) == sorted(first.values())


def test_groups_and_parts_of_titles_equal_brute_force(monkeypatch):
    import numpy as np

    from citeweave.functions import close

    xs, ys = [[t.lower().strip() for t in titles(k, 120)] for k in (11, 12)]
    ratios = {(i, j): SequenceMatcher(None, a, b).ratio() for i, a in enumerate(xs) for j, b in enumerate(ys) if not (a in b or b in a)}
    want = {k for k, r in ratios.items() if r >= 0.75}
    hi, lo = np.random.default_rng(1).permutation(120), np.random.default_rng(2).permutation(120)
    first: dict = {}
    for i, j in sorted(want, key=lambda k: lo[k[1]]):
        first.setdefault(i, j)
    for part in (9, 2000):
        monkeypatch.setattr(close, "PART", part)
        for exact in (True, False):
            assert {(i, j) for i, j, _ in close.close_pairs(xs, ys, 0.75, exact=exact)} == want
        assert {(i, j) for i, j, _ in close.close_pairs(xs, ys, 0.75, after=(hi, lo))} == {(i, j) for i, j in want if hi[i] > lo[j]}
        assert {(i, j) for i, j, _ in close.close_pairs(xs, ys, 0.75, first=lo)} == set(first.items())
    groups = [(30, 50), (0, 10), (60, 60), (30, 0)]
    ends = np.cumsum([(0, 0), *groups], axis=0)
    within = {(i, j) for i, j in want if any(a[0] <= i < b[0] and a[1] <= j < b[1] for a, b in zip(ends, ends[1:]))}
    assert {(i, j): r for i, j, r in close.close_pairs(xs, ys, 0.75, groups=groups)} == {k: ratios[k] for k in within} and within


def test_pairs_of_blocks_of_a_large_document_are_few(spark):
    from citeweave.operators.similarity import PAIRS, _blocks
    from citeweave.runtime import Workspace

    a, b = (spark.range(n).selectExpr("'d' AS doc_id", f"concat('t', id) AS {k}") for n, k in ((60_000, "ka"), (40_000, "kb")))
    x, y, on, large = _blocks(Workspace(spark, "t"), a, b, 500, 5000)
    i, j = x.select("i").first()[0], y.select("j").first()[0]
    assert on == ["doc_id", "_x", "_y"] and large and 24 <= i * j <= 2 * PAIRS


def test_match_by_bands_equals_the_sequential_pass(spark):
    pred, gt = titles(21, 50) + ["Act 1"] * 3, titles(22, 40) + ["ACT 1"] * 5
    p, g = refs(spark, {"d": pred, "e": pred[:4]}, "regex"), spark.createDataFrame([(d, i, t, "circular", None) for d in "de" for i, t in enumerate(gt)], TRUTH)
    up, ug, want = set(), set(), set()
    for s, i, j in sorted((-sim(a, b), i, j) for i, a in enumerate(pred) for j, b in enumerate(gt) if sim(a, b) >= 0.75):
        if i not in up and j not in ug:
            up.add(i), ug.add(j), want.add((i, j, -s))
    assert {(r["pi"], r["gi"], r["sim"]) for r in evaluate.match(spark, p, g, many=10).where("doc_id = 'd'").collect()} == want
    assert len({sum(s >= b for b in evaluate.BANDS) for _, _, s in want}) == 3


def test_runs_scored_together_equal_each_alone(spark):
    one, gt = titles(31, 40), titles(32, 30) + ["Act 1"] * 4
    two = one[5:] + gt[:20] + ["ACT 1"] * 2
    p, q = (refs(spark, {"d": t, "e": t[:6]}, "regex") for t in (one, two))
    g = spark.createDataFrame([(d, i, t, "circular", None) for d in "de" for i, t in enumerate(gt)], TRUTH)
    alone, n = _tables(spark, lambda: evaluate.metrics(spark, p, g))
    runs, m = _tables(spark, lambda: evaluate.comparison(evaluate.metrics_of_runs(spark, {"one": p, "two": q}, g)))
    a, b = runs[:2]
    assert m < n + 4 and (a["precision"], a["recall"], a["f1"]) == tuple(alone[0][k] for k in ("precision", "recall", "f1"))
    assert (b["precision"], b["recall"], b["f1"]) == tuple(evaluate.metrics(spark, q, g).first()[k] for k in ("precision", "recall", "f1")) != (a["precision"], a["recall"], a["f1"])
    want = {(r["doc_id"], r["pi"], r["gi"], r["sim"]) for r in evaluate.match(spark, q, g).collect()}
    for many in (10, evaluate.MANY):
        got = evaluate.match(spark, [p, q], g, many=many).where(F.col("pi") >= evaluate.RUN).collect()
        assert {(r["doc_id"], r["pi"] - evaluate.RUN, r["gi"] - evaluate.RUN, r["sim"]) for r in got} == want


def test_small_documents_need_no_tables_of_words(spark):
    pred, gt = titles(41, 30) + ["", "act"], titles(42, 25) + ["act 1"]
    p, g = refs(spark, {"d": pred}, "regex"), spark.createDataFrame([("d", i, t, "circular", None) for i, t in enumerate(gt)], TRUTH)
    rows, n = _tables(spark, lambda: similarity_edges(p, g))
    assert n <= 3 and {(r["pi"], r["gi"], r["sim"]) for r in rows} == {(i, j, sim(a, b)) for i, a in enumerate(pred) for j, b in enumerate(gt) if sim(a, b) >= 0.75}
    for block in (2000, 10):
        rows, n = _tables(spark, lambda: duplicate_edges(p, p, later=True, block=block))
        assert (n <= 2) == (block == 2000) and {(r["pi"], r["gi"]) for r in rows} == {(i, j) for i, a in enumerate(pred) for j in range(i) if dup(a, pred[j])}


def test_tables_of_a_block_are_freed(spark):
    from pathlib import Path

    from citeweave.runtime import Workspace, freeing

    ws, g = Workspace(spark, "kept"), spark.createDataFrame([("d", i, t, "circular", None) for i, t in enumerate(titles(52, 20))], TRUTH)
    root = Path(ws.root.removeprefix("file://")).parent
    before = {*root.iterdir()} if root.exists() else set()
    with freeing(spark):
        kept = ws.write(evaluate.match(spark, refs(spark, {"d": titles(51, 20)}, "regex"), g))
    assert {x.name for x in {*root.iterdir()} - before} == {Path(ws.root).name} and kept.count() > 0


def test_a_title_cited_often_is_one_row_of_the_clusters(spark, monkeypatch):
    titles = ["Melpeltam Trust Deeds Act, 1999"] * 700 + ["the Melpeltam Trust Deeds Act, 1999 as amended", "Griwal Rules", None, "see Griwal Rules"] * 3
    order = random.Random(5).sample(range(len(titles)), len(titles))
    rows = spark.createDataFrame([("d", seq, titles[i]) for seq, i in enumerate(order)], "doc_id string, seq bigint, title string")
    keys, want = [titles[i] and titles[i].lower() for i in order], {}
    for b, k in enumerate(keys):
        want[b] = next((a for a in range(b) if want[a] == a and k is not None and keys[a] is not None and (keys[a] in k or k in keys[a])), b)
    seen = []
    monkeypatch.setattr(merge, "first_seeds", lambda spark, edges: seen.append(edges.count()) or first_seeds(spark, edges))
    got = merge.clustered(spark, rows).collect()
    assert len(got) == len(want) and {r["seq"]: r["seed"] for r in got} == want
    assert seen == [2]  # not 700 * 700 / 2
    one = {b for b in want if list(want.values()).count(want[b]) == 1}
    assert {r["seq"] for r in got if r["alone"]} == one and len(one) == 3


def test_keys_asked_for_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from citeweave.operators.similarity import _among
    from citeweave.runtime import Workspace

    monkeypatch.setattr(DataFrame, "toPandas", lambda self: 1 / 0)
    keys = spark.range(40_000).selectExpr("id", "xxhash64(id) AS _at")
    among = _among(Workspace(spark, "asked"), keys.where("id % 2 = 0"))
    assert keys.where("id % 2 = 0").where(among("_at")).count() == 20_000
    assert keys.where("id % 2 = 1").where(among("_at")).count() < 100
