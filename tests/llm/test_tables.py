import random
from collections import Counter
from datetime import datetime

import pytest

from citeweave.llm import canonical, components, fusion, packing


def _plain(edges):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return {x: f(x) for x in list(p)}


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 130)] + [(200 + i, 200 + (i + 1) % 12) for i in range(12)] + [(300, i) for i in range(301, 330)] + [(400 + r.randrange(25), 400 + r.randrange(25)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    ids = sorted({x for e in edges for x in e})
    name = dict(zip(ids, r.sample(ids, len(ids))))
    edges = [(name[a], name[b]) for a, b in edges]
    rows = [(a, b, 0.75) for a, b in edges] + [(b, a, 0.9) for a, b in edges[:20]] + [(9, 9, 1.0), (None, 9, 1.0), (8, None, 1.0), (7, 6, None), (7, 5, 0.7), (4, 3, float("nan"))]
    got = components.groups(spark, spark.createDataFrame(rows, "pi bigint, gi bigint, sim double").selectExpr("*", "1 AS u", "2 AS label"))
    assert {x["rec_id"]: x["group_id"] for x in got.collect()} == _plain(edges)


def test_components_of_nothing(spark):
    assert components.groups(spark, spark.createDataFrame([], "pi bigint, gi bigint, sim double")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_packing_loses_nothing_and_is_no_worse_than_best_fit(seed):
    r = random.Random(seed)
    cap = r.choice([7, 50, 2048])
    sizes = [r.randint(1, cap) if seed % 2 else min(cap, 1 + int(r.expovariate(4 / cap))) for _ in range(r.randint(0, 300))]
    runs = packing.solve(Counter(sizes), cap)
    used = Counter()
    for k, content in runs:
        assert k > 0 and sum(content) <= cap
        for s in content:
            used[s] += k
    assert used == Counter(sizes)
    free = []
    for s in sorted(sizes, reverse=True):
        i = min((i for i, f in enumerate(free) if f >= s), key=lambda i: free[i], default=None)
        free.append(cap - s) if i is None else free.__setitem__(i, free[i] - s)
    assert sum(k for k, _ in runs) <= len(free)


@pytest.mark.parametrize("per", [2, 1_000_000])
def test_packing_of_a_table(spark, per):
    rows = [(i, s) for i, s in enumerate([0, None, 10, 10, 7, 3, 25, 30, 1, 10])] + [(5, 3)]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id bigint, size bigint").selectExpr("*", "1 AS container", "2 AS piece"), capacity=10, per=per).collect()
    assert sum(r["size"] for r in got) == sum(s or 0 for _, s in rows)
    room = Counter()
    for r in got:
        if r["container"] is not None:
            room[r["container"]] += r["size"]
    assert max(room.values()) <= 10 and {r["doc_id"] for r in got if r["container"] is None} == {0, 1}
    assert Counter(r["doc_id"] for r in got)[6] == 3 and Counter(r["doc_id"] for r in got)[7] == 3
    assert packing.pack(spark, spark.createDataFrame([], "doc_id bigint, size bigint")).count() == 0


def test_survivors(spark):
    t = [datetime(2020, 1, d) for d in range(1, 5)]
    rows = [
        (1, 7, "A b-c!", [1, 1, 2], " LLM", t[0]), (2, 7, "abc", [1, 2, -3, None], "regex", t[1]), (3, 7, None, None, None, None), (4, 7, "ab", [0], "both ", t[2]),
        (5, 8, None, None, None, t[0]), (6, 8, "", [], "odd", t[0]), (7, None, "x", [1], "llm", None),
    ]
    df = spark.createDataFrame(rows, "cand_id bigint, cluster_id bigint, title string, page_numbers array<int>, source string, extracted_at timestamp").selectExpr("*", "1 AS trust_rank", "2 AS title_score")
    ranks = spark.createDataFrame([("both", 1), ("regex", 2), ("llm", 3)], "source string, trust_rank int")
    got = {r["cluster_id"]: (r["title_id"], r["pages_id"], r["source_id"]) for r in fusion.survivors(df, ranks).collect()}
    assert got == {7: (2, 2, 4), 8: (5, 5, 5), None: (7, 7, 7)}
    assert fusion.survivors(df.limit(0), ranks).count() == 0


def test_fusion_follows_sources_that_are_right(spark):
    rows = []
    for c in range(40):
        rows += [(4 * c, c, f"Title {c}", [c + 1], "regex", None), (4 * c + 1, c, f"title  {c}.", [c + 1], "both", None), (4 * c + 2, c, f"Wrong {c % 3}", [99], "llm", None), (4 * c + 3, c, None, None, None, None)]
    df = spark.createDataFrame(rows, "cand_id bigint, cluster_id bigint, title string, page_numbers array<int>, source string, extracted_at timestamp").selectExpr("*", "'Circular ' AS type")
    ranks = spark.createDataFrame([("both", 1), ("regex", 2), ("llm", 3)], "source string, trust_rank int")
    out = {r["cluster_id"]: r for r in fusion.fuse(spark, df, ranks).collect()}
    assert len(out) == 40 and all(r["title"].lower().split()[:1] == ["title"] and r["page_numbers"] == [c + 1] and r["type"] == "circular" for c, r in out.items())
    assert fusion.fuse(spark, df.limit(0), ranks).count() == 0


def test_fusion_sees_through_copies(spark):
    r = random.Random(5)
    rows, truth, majority = [], {}, {}
    for c in range(200):
        truth[c] = "right"
        say = {s: "right" if r.random() < a else f"wrong {r.randrange(50)}" for s, a in (("a", 0.9), ("b", 0.75), ("c", 0.75), ("x", 0.6))}
        say |= {"y": say["x"], "z": say["x"]}
        majority[c] = max(set(say.values()), key=lambda v: (list(say.values()).count(v), v))
        rows += [(0, c, v, None, s, None) for s, v in say.items()]
    df = spark.createDataFrame(rows, "cand_id bigint, cluster_id bigint, title string, page_numbers array<int>, source string, extracted_at timestamp").selectExpr("*", "NULL AS type")
    out = {x["cluster_id"]: x["title"] for x in fusion.fuse(spark, df, spark.createDataFrame([], "source string, trust_rank int")).collect()}
    right, plain = sum(out[c] == "right" for c in out), sum(v == "right" for v in majority.values())
    assert len(out) == 200 and right >= 190 and right > plain, (right, plain)


def test_fusion_of_a_null_cluster(spark):
    df = spark.createDataFrame([(1, None, "Act", [1], "llm", None), (2, None, "act", [1], "regex", None), (3, 1, "Rules", None, "llm", None)], "cand_id bigint, cluster_id bigint, title string, page_numbers array<int>, source string, extracted_at timestamp").selectExpr("*", "'act' AS type")
    out = {x["cluster_id"]: (x["title"], x["page_numbers"]) for x in fusion.fuse(spark, df, spark.createDataFrame([("llm", 1), (" LLM", 2)], "source string, trust_rank int")).collect()}
    assert out == {None: ("act", [1]), 1: ("Rules", None)}


def test_fusion_of_sources(spark):
    t = [datetime(2020, 1, d) for d in range(1, 3)]
    rows = []
    for c in range(12):
        rows += [(4 * c, c, f"Title {c}", [c + 1], " LLM", t[1]), (4 * c + 1, c, f"title {c}", [c + 1], "Both ", t[0]), (4 * c + 2, c, f"Title {c}", [c + 1], "odd", t[0]), (4 * c + 3, c, f"Title {c}", [c + 1], None, t[1])]
    rows += [(90, 50, "x", [1], "odd", t[0]), (91, 50, "x", [1], "else", t[1]), (92, 51, "x", [1], " Unknown", t[0]), (93, 52, None, None, "llm", None)]
    df = spark.createDataFrame(rows, "cand_id bigint, cluster_id bigint, title string, page_numbers array<int>, source string, extracted_at timestamp").selectExpr("*", "'act' AS type")
    ranks = spark.createDataFrame([("both", 1), ("regex", 2), ("llm", 3)], "source string, trust_rank int")
    out = {r["cluster_id"]: r for r in fusion.fuse(spark, df, ranks).collect()}
    assert {out[c]["source"] for c in range(12)} == {"both"} and all(0 < out[c]["source_confidence"] <= 1 for c in range(12))
    assert out[51]["source"] is None and out[51]["source_confidence"] is None and out[52]["source"] == "llm"
    assert out[50]["source"] in ("odd", "else")


def test_values(spark):
    listed = [("circular", "Circular", "circulars, numbered or dated"), ("master_circular", "Master circular", "consolidated circulars on one subject"), ("act", "Act", "acts of the legislature, statutes"), ("letter", "Letter", None), ("email", "E-mail", "electronic mail")]
    types = spark.createDataFrame(listed, "type_code string, label string, covers string")
    want = {"circular": None, "CIRCULAR": "circular", " circullar ?": "circular", "Circular, master": "master_circular", "M. Circular (master)": "master_circular", "mster circ": "master_circular", "MasterCircluar": "master_circular", "E mail": "email", "the Act": "act", "SEBI ltter": "letter", "ltr": "letter", "Consolidated circular": "master_circular", "statute": "act", "mail (electronic)": "email", "table 3": "unmatched", "not sure": "unmatched", "12": "unmatched", "???": "unmatched", "": None, " \t": None, "x" * 5000: "unmatched"}
    rows = [(i, v) for i, v in enumerate(want)] + [(99, None), (1, "CIRCULAR")] + [(200 + i, "Circulaire") for i in range(9)] + [(300, "crculaire")]
    df = spark.createDataFrame(rows, "rec_id bigint, type string").selectExpr("*", "1 AS value", "2 AS n")
    got = [tuple(r) for r in canonical.map_values(spark, df, types).collect()]
    assert len(got) == len(set(got)) and dict(got) == {i: c for i, c in enumerate(want.values()) if c} | {i: "circular" for i in [*range(200, 209), 300]}
    assert canonical.map_values(spark, df.limit(0), types).count() == 0
    assert canonical.map_values(spark, df, types.select("type_code", "label")).where("rec_id = 1").first()["type_code"] == "circular"


def test_no_word_within_the_edits_is_lost_by_the_join(spark):
    from citeweave.runtime import Workspace

    r = random.Random(9)
    words = ["circular", "notice", "letter", "order", "act", "gazette", "regulation", "guideline"]
    typed = set(words)
    for _ in range(400):
        w = list(r.choice(words))
        for _ in range(r.randint(1, 2)):
            i = r.randrange(len(w) - 1)
            w[i : i + 2] = r.choice([[w[i + 1], w[i]], [w[i]], [w[i], r.choice("aeklz"), w[i + 1]], [r.choice("aeklz"), w[i + 1]]])
        typed.add("".join(w))
    want = {(a, b) for a in typed for b in words if canonical.osa(a, b, 2) <= canonical.limit(max(len(a), len(b)))}
    got = canonical.set_similarity_join(Workspace(spark, "t"), spark.createDataFrame([(w,) for w in typed], "l string"), spark.createDataFrame([(w,) for w in words], "r string"))
    assert want <= {(x["l"], x["r"]) for x in got.collect()}


def test_similarity_join_equals_brute_force(spark):
    from citeweave.runtime import Workspace

    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(60)]
    left, right = sorted(set(words[:40])), sorted(set(words[25:]))
    got = {(x["l"], x["r"]): round(x["jaccard"], 9) for x in canonical.set_similarity_join(Workspace(spark, "t"), spark.createDataFrame([(w,) for w in left], "l string"), spark.createDataFrame([(w,) for w in right], "r string"), 0.4).collect()}
    want = {}
    for a in left:
        for b in right:
            x, y = set(canonical.grams(a)), set(canonical.grams(b))
            if len(x & y) / len(x | y) >= 0.4:
                want[a, b] = round(len(x & y) / len(x | y), 9)
    assert got == want
