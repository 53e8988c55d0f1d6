import json

import pytest

from citeweave.functions import prompts
from citeweave.operators import model, search
from citeweave.plans import pipeline
from citeweave.schemas import PAGES, REFERENCES
from citeweave.sources import readers

ANSWERS = [
    ('```json\n[{"title": "A", "page_numbers": [2, 2]}, {"title": "a", "page_numbers": "3"}]\n```', [("A", "circular", [2, 2]), ("a", "circular", [3])]),
    ('{"title": "A"}', []), ("junk", []), ("[]", []), ('[{"title": "x"}] trailing', []), ('["x", 1, {"title": "  "}, {"name": "y"}]', []),
    ('[{"Date": "May", "Details": "letter", "type": "letter"}]', [("May - letter", "letter", [7])]), ('[{"date": 1, "details": "b", "page_numbers": []}]', [("1 - b", "circular", [])]),
    ('[{"title": "q", "page_numbers": [1, "x", null, 4]}]', [("q", "circular", [1, 4])]), ('[{"title": 5}]', []), (None, []),
]


def test_answers_are_parsed_and_coerced(spark):
    table = spark.createDataFrame([("d", i, [7], a) for i, (a, _) in enumerate(ANSWERS)], "doc_id string, batch int, pages array<int>, raw string")
    got = {}
    for r in model.coerce(table).orderBy("batch", "pos").collect():
        got.setdefault(r["batch"], []).append((r["title"], r["type"], r["page_numbers"]))
    assert got == {i: w for i, (_, w) in enumerate(ANSWERS) if w}
    g = model.grouped(model.coerce(table)).where("title = 'A'").first()
    assert g["page_numbers"] == [2, 2, 3]
    assert model.parse_object('```\n{"a": 1}\n```') == {"a": 1} and model.parse_object("[1]") is None


def _pages(spark):
    return spark.createDataFrame([("d", n, f"page {n} CIR/CFD/{n}/2012") for n in range(1, 6)], PAGES)


def test_pipeline_with_a_client(spark):
    def rule(p):
        if "canonical_title" in p:
            return json.dumps({"canonical_title": "CIR/CFD/1/2012 in full", "merged_page_numbers": [40]})
        if "titles to keep" in p:
            return json.dumps([t for t in json.loads(p[p.index("[") : p.rindex("]") + 1]) if "CIR" in t] + ["invented"])
        if "Page 4" in p:
            raise RuntimeError("down")
        return json.dumps([{"title": "CIR/CFD/1/2012 dated May 1", "page_numbers": [9]}, {"title": "unlike anything", "page_numbers": 2}])

    refs, stats = pipeline.extract(spark, _pages(spark), model.Replay(rule=rule))
    got = {r["title"]: r for r in refs.collect()}
    assert "CIR/CFD/1/2012" in got and got["CIR/CFD/1/2012"]["source"] == "both" and got["CIR/CFD/1/2012"]["page_numbers"] == [1, 9]
    assert "unlike anything" not in got
    s = stats.first()
    assert s["total"] == s["regex_only"] + s["llm_only"] + s["both"] == len(got)
    refs, _ = pipeline.extract(spark, _pages(spark), wanted=[2, 3])
    assert refs.count() == 2


def test_verify_keeps_all_when_too_few_are_kept(spark):
    rows = spark.createDataFrame([("d", i, f"title {i}", "x", [1], "llm") for i in range(10)], REFERENCES)
    keep = lambda n: model.Replay(rule=lambda p: json.dumps([f"title {i}" for i in range(n)]))
    assert model.verify(spark, rows, keep(2)).count() == 10
    assert model.verify(spark, rows, keep(6)).count() == 6
    assert model.verify(spark, rows, model.Replay()).count() == 10
    assert model.verify(spark, rows.limit(0), keep(2)).count() == 0


def test_batches_and_prompts(spark):
    refs = spark.createDataFrame([("d", i, f"t{i}", "x", [1], "regex") for i in range(53)], REFERENCES)
    rows = model.batch_prompts(_pages(spark), refs).orderBy("batch").collect()
    assert [r["pages"] for r in rows] == [[1, 2, 3], [4, 5]]
    assert "- t49\n... and 3 more" in rows[0]["prompt"] and "--- Page 3 ---" in rows[0]["prompt"]
    assert "(none)" in model.batch_prompts(_pages(spark), None).first()["prompt"]


def test_templates():
    t = prompts.protect_braces('json {"a": 1} {text} {existing_refs}')
    assert prompts.formatted(t, "E", "T") == 'json {"a": 1} T E'
    assert prompts.formatted("{other}", "E", "T") is None
    assert prompts.repair_placeholders("<<text>> [existing_refs]") == "{text} {existing_refs}" and prompts.repair_placeholders("no") is None
    assert prompts.rewritten("why ===PROMPT_SEPARATOR===\n```\n{text} {existing_refs} {x}\n```", judge=True) == "{text} {existing_refs} {{x}}"
    assert prompts.rewritten("START_PROMPT {text} [existing_refs] END_PROMPT") == "{text} {existing_refs}" and prompts.rewritten("nothing") is None


def test_front_and_prune(spark):
    rows = [(1, 0.5, 0.9, 0.6), (2, 0.6, 0.8, 0.7), (3, 0.5, 0.8, 0.65), (4, 0.6, 0.8, 0.7), (5, None, None, None), (6, 0.1, 0.1, 0.1)]
    c = spark.createDataFrame(rows, "id int, precision double, recall double, f1 double")
    assert sorted(r["id"] for r in search.pareto_front(c).collect()) == [1, 2, 4, 5]
    assert sorted(r["id"] for r in search.prune(c, 5).collect()) == [1, 2, 3, 4, 5]
    assert search.prune(c.limit(0), 5).count() == 0
    h = spark.createDataFrame([(1, 0.2), (2, 0.1), (3, 0.4)], "iteration int, f1 double")
    assert [r["improved"] for r in search.best_so_far(h).orderBy("iteration").collect()] == [True, False, True]


def test_split():
    train, val = search.split_pages(list(range(1, 14)))
    assert val == [1, 2, 11] and sorted(train + val) == list(range(1, 14))
    assert search.split_pages([1]) == ([], [1])


def test_search_loops(spark):
    truth = spark.createDataFrame([("d", i, f"CIR/CFD/{i}/2012", "circular", i) for i in range(1, 6)] + [("d", 9, "Secret letter of May", "letter", 2)], "doc_id string, gt_seq bigint, title string, type string, page int")
    rule = lambda p: json.dumps([{"title": "Secret letter of May"}]) if "hint" in p else "[]"
    ev = search.Evaluator(spark, _pages(spark), truth, model.Replay(rule=rule))
    judge = model.Replay(rule=lambda p: "===PROMPT_SEPARATOR=== hint {existing_refs} {text}")
    history, best = search.iterate(ev, judge, iterations=2)
    assert len(history) == 2 and history[1]["metrics"]["f1"] > history[0]["metrics"]["f1"] and best.startswith("hint")
    mutator = model.Replay(rule=lambda p: "START_PROMPT hint {existing_refs} {text} END_PROMPT")
    out = search.Evolution(ev, mutator, population_size=2, iterations=1).run()
    assert out["best"].prompt.startswith("hint") and out["final"]["f1"] == 1.0 and len(out["history"]) == 1


def test_sources_and_sinks(spark, tmp_path):
    from citeweave.sources import readers, sinks

    (tmp_path / "a.txt").write_text("one CIR/CFD/4/2012\f\fthree")
    pages = readers.documents(spark, str(tmp_path / "a.txt"), readers.text_parser)
    assert [(r["page_num"], r["text"]) for r in pages.orderBy("page_num").collect()] == [(1, "one CIR/CFD/4/2012"), (2, ""), (3, "three")]
    (tmp_path / "gt.json").write_text('[{"title": "x", "type": "t"}, {"title": "y", "type": "t", "page": 3}]')
    assert [(r["gt_seq"], r["title"], r["page"]) for r in readers.ground_truth(spark, str(tmp_path / "gt.json")).orderBy("gt_seq").collect()] == [(0, "x", None), (1, "y", 3)]
    refs, _ = pipeline.extract(spark, pages)
    out = sinks.write_result(refs, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == out and out["stats"]["total"] == 1
    assert sinks.listing(refs).first()["entries"] == ["CIR/CFD/4/2012 | pages 1 [regex]"]
    sinks.write_lines(refs, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 1
    assert sinks.history_table(spark, [{"iteration": 1, "metrics": {"f1": 0.5}}]).first()["f1"] == 0.5


def test_command_line_prints_every_row_and_refuses_what_it_cannot_do(spark, tmp_path, capsys):
    from citeweave.plans.pipeline import main

    text = "\n".join(f"See CIR/MRD/{i}/2010 and the Companies Act, {1900 + i}." for i in range(1, 60))
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([("a", 1, text), ("b", 1, text)], "doc_id string, page_num int, text string").write.parquet(path)
    assert main(["extract", path, "--regex-only", "--output", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out
    assert all(out.count(f"CIR/MRD/{i}/2010 |") == 2 for i in range(1, 60)) and spark.read.json(str(tmp_path / "out")).count() == 2 * 118
    (tmp_path / "gt.json").write_text('[{"title": "CIR/MRD/1/2010", "type": "circular"}]')
    for bad in (["extract", path], ["evaluate", path, str(tmp_path / "gt.json")], ["evaluate", path, str(tmp_path / "gt.json"), "--endpoint", "http://127.0.0.1:9"]):
        with pytest.raises(SystemExit):
            main(bad)
    (tmp_path / "gt2.json").write_text('[{"title": "x", "doc_id": "b"}, {"title": "y", "type": "act", "page": 2}]')
    assert [tuple(r) for r in readers.ground_truth(spark, str(tmp_path / "gt2.json"), "a").orderBy("gt_seq").collect()] == [("b", 0, "x", None, None), ("a", 1, "y", "act", 2)]
