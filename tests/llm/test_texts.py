import random

import numpy as np

from citeweave.llm import encode, pages, pii
from citeweave.llm.crf import CRF, OFFSETS
from citeweave.llm.labelled import TABLE, expand
from citeweave.llm.tokens import encoding

ODD = [None, "", " ", "a", "a\n\n- b  c \t\n", "<|endoftext|>", "né 🙂 日本語" * 40, "x" * 700, " " * 500 + "y", "it's we'll " * 60, "1234567890" * 50]


def test_encoding_by_chunks_equals_the_whole(spark):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "  ", "\n", "'", "s ", "é", "7", "!", "x" * 9, "\x1c"]) for _ in range(200)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, None), (7, texts[7])], "doc_id bigint, text string").selectExpr("*", "1 AS row", "2 AS start")
    enc = encoding()
    for chunk, overlap in ((encode.CHUNK, encode.OVERLAP), (40, 12)):
        got = [(x["doc_id"], list(x["ids"])) for x in encode.encode(df, chunk=chunk, overlap=overlap).collect()]
        assert len(got) == len(texts) + 2
        assert all(ids == (enc.encode_ordinary(texts[i]) if texts[i] else []) for i, ids in got)
    assert all(encode.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    assert encode.encode(df.limit(0)).count() == 0


def test_stitching_with_long_overlaps():
    pat, enc = encode._compiled("/opt/tokenizers"), encoding()
    for t in [x for x in ODD if x]:
        for chunk, overlap in ((3, 40), (7, 3), (1, 1)):
            parts = []
            for s, p in encode.chunks_of(t, chunk, overlap):
                if not parts or s + len(p) > parts[-1][0] + len(parts[-1][1]):
                    parts.append((s, p, encode.token_ends(p, s, s + len(p) >= len(t), pat)))
            assert [i for a, b in encode.stitch(parts, pat) for i in enc.encode_ordinary(t[a:b])] == enc.encode_ordinary(t)


TEXT = [
    (1, "The office is shut. Please send the forms to Hector Dremwick (bdremwick@inbox.example). Order paper 0934.842.580 says so."),
    (2, "Une voisine, Mme Dunshaw, habite 82, rue des Lilas, 7114 Rovenna depuis sa naissance."), (3, "Die Steuernummer 8385/05-B wurde zweimal vergeben, einmal an Piet Aldwood."),
    (4, "I agree with Elsa Branmore on this point. A petition signed by Elsa Branmore and 3 others of Rovenna was handed in."), (5, None), (6, ""), (7, " "), (8, "word " * 30_000),
]


def _members(spark):
    return spark.createDataFrame([(1, "Elsa Branmore", "Rovenna"), (2, "Mira Quarnock", "Harrowfield")], "member_id int, full_name string, constituency string")


def test_places_and_placeholders(spark):
    df = spark.createDataFrame([*TEXT, TEXT[0]], "doc_id bigint, text string").selectExpr("*", "'x' AS kind")
    text = dict(TEXT)
    got = {(r["doc_id"], r["kind"], text[r["doc_id"]][r["start_pos"] : r["end_pos"]]) for r in pii.find(df, _members(spark)).collect()}
    assert got == {(1, "person", "Hector Dremwick"), (1, "email", "bdremwick@inbox.example"), (2, "person", "Dunshaw"), (2, "address", "82, rue des Lilas, 7114 Rovenna"), (3, "id_number", "8385/05-B"), (3, "person", "Piet Aldwood")}
    red = [(r["doc_id"], r["text"]) for r in pii.redact(df, _members(spark)).collect()]
    assert len(red) == 9 and dict(red)[3] == "Die Steuernummer [ID_NUMBER] wurde zweimal vergeben, einmal an [PERSON]." and dict(red)[5] is None and dict(red)[8] == text[8]
    assert pii.find(df.limit(0), _members(spark)).count() == 0


def test_accuracy_on_sentences_held_out():
    """A fifth of the labelled sentences, with values of their own, is kept from training."""
    lines, towns = TABLE.strip().splitlines(), ("Rovenna", "Harrowfield", "Kestrel Bay")
    people = (("Elsa", "Branmore"), ("Anna", "Quarnock"), ("Hugo", "Sarrow"))
    right = found = there = 0
    for fold in range(2):
        held = [x for i, x in enumerate(lines) if i % 5 == fold]
        model = pii.train(people, towns, lines=tuple(x for x in lines if x not in held))
        look = pii.Finder(model, {("branmore", "elsa"), ("anna", "quarnock"), ("hugo", "sarrow")})
        cases = expand(list(towns), 4, seed=99, lines=held, people=list(people))
        for (text, marks), hits in zip(cases, look([t for t, _ in cases])):
            want = {(a, b, pii.KINDS[k]) for a, b, k in marks}
            right, found, there = right + len(want & set(hits)), found + len(hits), there + len(want)
    print(f"precision {right / found:.3f}, recall {right / there:.3f}")
    assert right / found > 0.8 and right / there > 0.6


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(0)
    m = CRF(["a", "b", "c"], lambda t: [t])
    m.index = {t: i for i, t in enumerate("xyz")}
    m.w, m.trans = r.normal(size=(len(OFFSETS), 3, 3)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32)
    seqs = [list(s) for s in ("x", "xyz", "zzyx", "yxzzy", "")]
    import itertools

    for s, got in zip(seqs, m.decode(seqs, batch=2)):
        if not s:
            continue
        emit = np.zeros((len(s), 3))
        for t in range(len(s)):
            for j, o in enumerate(OFFSETS):
                if 0 <= t + o < len(s):
                    emit[t] += m.w[j, m.index[s[t + o]]]
        best = max(itertools.product(range(3), repeat=len(s)), key=lambda p: sum(emit[t, k] for t, k in enumerate(p)) + sum(m.trans[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got) == best


def _slips(read, meant):
    """Least number of scanner confusions and accents that turn ``meant`` into ``read``, by trying all."""
    base = pages.bare(read)
    best = {}

    def go(i, j, n):
        if n > pages.SLIPS or best.get((i, j), 9) <= n:
            return
        best[i, j] = n
        if i < len(meant) and j < len(base) and meant[i] == base[j]:
            go(i + 1, j + 1, n)
        for x, y in pages.CONFUSED:
            if meant.startswith(y, i) and base.startswith(x, j):
                go(i + len(y), j + len(x), n + 1)

    go(0, 0, sum(x != y for x, y in zip(read, base)))
    return best.get((len(meant), len(base)))


def test_trie_and_automaton_equal_brute_force():
    r = random.Random(6)
    words = {"".join(r.choice(["rn", "m", "h", "li", "e", "c", "d", "cl", "o", "t"]) for _ in range(r.randint(1, 4))): 9 for _ in range(300)}
    t, some = pages.Trie(words), 0
    for w in [*list(words)[:60], "rnrnrn", "hliéd", "0ne", "zz", ""]:
        want = {(v, n) for v in words if (n := _slips(w, v)) is not None}
        some += len(want)
        assert set(t.near(w)) == want
        for k in (1, 2, 3):
            assert {v[:k] for v, _ in want} <= set(pages.Automaton(w).prefixes(k))
    assert some > 80


def test_distance_equals_brute_force():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(7)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert pages.distance(a, b) == lev(a, b)


BODY = "The trading member shall publish short-term liquidity statements under intimation to the regulator.\n"


def test_page_repair(spark):
    rows = [(i, "d", i, f"Handbook: Fee Structures\n{BODY * 3}The trading member maintains records.\n- {i} -") for i in range(1, 9)]
    bad = "HANDB0OK: FEE STRUCTURES\nThe tradirig member shall pub-\nlish short-\nterm liquidity statements under\n\nintimation to thc regulator.\n1    bonds    2,000\nPage 9 of 9"
    rows += [(9, "d", 9, bad), (10, "d", 10, None), (11, "d", 11, ""), (12, "none", 1, "\n\n"), (9, "d", 9, bad)]
    p = spark.createDataFrame(rows, "page_id bigint, doc_id string, page_num int, text string").selectExpr("*", "'t' AS title", "1 AS line_no")
    docs = spark.createDataFrame([("d", "Handbook: Fee Structures"), ("d", None), ("e", "x")], "doc_id string, doc_title string")
    got = {}
    for r in pages.damage(spark, p, docs).collect():
        got.setdefault(r["page_id"], set()).add((r["line_no"], r["kind"]))
    assert got[9] == {(1, "header"), (2, "hyphen"), (2, "misread"), (6, "misread"), (8, "page_number")}
    assert got[1] == {(1, "header"), (6, "page_number")} and set(got) == set(range(1, 10))
    text = {r["page_id"]: r["text"] for r in pages.repaired(spark, p, docs).collect()}
    assert text[9].split("\n\n")[0] == "The trading member shall publish short-term liquidity statements under"
    assert text[10] is None and text[11] == "" and text[12] == ""
    assert pages.damage(spark, p.limit(0), docs).count() == 0


def _corpus(copies):
    rows = [(i, "d", i, BODY * 6 + "a well-known set\n") for i in range(1, 40)]
    rows += [(100 + i, "d", i + 50, "The quarnock is here.\nA self-\ncare plan for the dremolin.\n") for i in range(8)]
    rows += [(200, "d", 80, "The quamock is here.\nOf self-care.\nNow the drernolin and the dremo-\nlin.")]
    return [(1000 * k + i, f"{d}{k}", n, t) for k in range(copies) for i, d, n, t in rows]


def _read_corpus(spark, rows, **block):
    p = spark.createDataFrame(rows, "page_id bigint, doc_id string, page_num int, text string")
    docs = spark.createDataFrame([("d", "Zzzz zzzzz zzzzz")], "doc_id string, doc_title string")
    return {tuple(r) for r in pages.damage(spark, p, docs, **block).collect()}, dict(tuple(r) for r in pages.repaired(spark, p, docs, **block).collect())


def test_page_repair_is_the_same_for_any_cut_of_the_vocabulary_and_any_size(spark):
    whole = _read_corpus(spark, _corpus(1))
    assert {(200, 1, "misread"), (200, 3, "misread"), (200, 3, "hyphen")} <= whole[0] and not any(k == "hyphen" and i < 200 for i, _, k in whole[0])
    assert whole[1][200].startswith("The quarnock is here.")
    assert _read_corpus(spark, _corpus(1), block=3) == whole
    more = _read_corpus(spark, _corpus(10))
    assert {x for x in more[0] if x[0] < 1000} == whole[0] and {i: t for i, t in more[1].items() if i < 1000} == whole[1]


def test_headers_recur_at_the_edges(spark):
    body = [f"The {w} shall be published by the exchange without further delay.\nA second line of the {w} goes on here." for w in ("ledger", "register", "notice", "account", "table", "paper")]
    rows = [(i, "a", i, f"ANNUAL REPORT 2012-13\n{b}\n{i}") for i, b in enumerate(body, 1)]
    rows += [(10 + i, "b", i, f"Annexure {i}\n{b}\nDepartment of Debt - Volume 3   {i}") for i, b in enumerate(body, 1)]
    rows += [(20, "a", 7, "ANNUAL REP0RT 2012-13\nThe ledger shall be published."), (21, "c", 1, "Annexure 4\nThe notice shall be published."), (22, None, 1, "Quality Premiums\nThe paper.")]
    rows += [(30 + i, f"e{i}", 1, f"Annexure 1\n{b}") for i, b in enumerate(body)]
    p = spark.createDataFrame(rows, "page_id bigint, doc_id string, page_num int, text string")
    got = {(r["page_id"], r["line_no"]) for r in pages.damage(spark, p, spark.createDataFrame([], "doc_id string, doc_title string")).where("kind = 'header'").collect()}
    assert got == {(i, 1) for i in range(1, 7)} | {(10 + i, 4) for i in range(1, 7)} | {(20, 1)}
