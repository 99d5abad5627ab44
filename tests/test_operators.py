import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import contracts, diff, loop, metrics, samples, segment, verify
from attesta.sources import readers


def test_short_quotes_are_rejected_before_any_search(spark):
    cites = spark.createDataFrame([(1, "d", 1, "short", 1, 2), (2, "d", 1, "a quote long enough", 1, 2), (3, "d", 1, "nowhere to be found", 1, 2)], "cite_id int, doc string, page int, quote string, first_page int, last_page int")
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "here is a  quote long enough.")], "doc string, page int, text string")
    got = {r.cite_id: (r.verdict, r.suggested_page) for r in verify.check_citations(cites, pages).collect()}
    assert got == {1: ("V2_QUOTE_TOO_SHORT", None), 2: ("V2_CITATION_WRONG_PAGE", 2), 3: ("V2_CITATION_NOT_FOUND", None)}


def test_gap_in_attempts_has_no_previous(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0, False), ("a", 3, 1, 0, False), ("b", 1, 5, 0, False), ("b", 2, 1, 0, False)], "section_id string, attempt int, errors long, findings long, invalid boolean")
    assert {r.section_id: r.status for r in loop.classify(rows).collect()} == {"a": "QUARANTINED", "b": "NEEDS_RETRY"}


def test_upsert_keeps_unchanged_rows(spark):
    old = spark.createDataFrame([("a", "1", 10), ("b", "2", 10)], "k string, v string, at int")
    new = spark.createDataFrame([("a", "1", 20), ("b", "3", 20), ("c", "4", 20)], "k string, v string, at int")
    assert sorted(map(tuple, loop.upsert(old, new, "k", ["v"]).collect())) == [("a", "1", 10), ("b", "3", 20), ("c", "4", 20)]


def test_fixed_issues_compare_null_fields_as_equal(spark):
    a = spark.createDataFrame([("s", None), ("s", "x")], "section string, field string")
    b = spark.createDataFrame([("s", None)], "section string, field string")
    assert [tuple(r) for r in loop.fixed(a, b, ["section", "field"]).collect()] == [("s", "x")]


@pytest.mark.parametrize(
    ("value", "want"),
    [({"a": 1}, []), ({"a": 1.0}, []), ({"a": True}, [("V3_TYPE_MISMATCH", "a")]), ({}, [("V3_REQUIRED_MISSING", "a")]), ([], [("V3_TYPE_MISMATCH", None)]), ({"a": None, "c": None}, []), ({"a": 1, "c": "z"}, [("V3_ENUM_VIOLATION", "c")])],
)
def test_validate_value(value, want):
    fields = [{"name": "a", "type": "integer", "required": True}, {"name": "c", "type": "string", "enum": ["x", "y"]}, {"name": "n.m", "type": "string", "required": True}]
    assert samples.validate_value(value, fields) == want


@pytest.mark.parametrize(
    ("which", "raw", "want"),
    [
        ("request", "[1]", [("V3_TYPE_MISMATCH", None)]), ("request", '{"a": 1}', []), ("response", "[1]", [("V3_TYPE_MISMATCH", None)]),
        ("response", '{"code": 0, "msg": "", "data": [{"a": 1}, 5, "x"]}', [("V3_TYPE_MISMATCH", None)] * 2), ("response", '{"code": 0, "msg": "", "data": 5}', [("V3_TYPE_MISMATCH", None)]),
        ("response", '{"code": 0, "msg": "", "data": [{"a": 1}]}', []),
    ],
)
def test_samples_that_are_no_objects(which, raw, want):
    fields = [{"name": "a", "type": "integer", "required": True, "enum": [], "location": place} for place in ("body", "response")]
    assert contracts.sample_verdict(raw, which, fields) == (True, True, want)


def test_items_without_documented_fields_need_not_be_objects():
    assert contracts.sample_verdict('{"code": 0, "msg": "", "data": [5]}', "response", []) == (True, True, [])


def test_headings_need_increasing_numbers(spark):
    lines = spark.createDataFrame([("d", 1, 0, "1.2 Alpha", False), ("d", 1, 1, "1.1 Beta", False), ("d", 1, 2, "2.1 Gamma", False), ("d", 2, 0, "text", False), ("d", 3, 0, "", False)], "doc string, page int, line_no int, line string, toc boolean")
    got = sorted((r.section_id, r.page_start, r.page_end) for r in segment.sections(lines).collect())
    assert got == [("S-1.2", 1, 1), ("S-2.1", 1, 2)]


def test_audit_sample_properties(spark):
    items = spark.range(60).select("id", (F.col("id") % 3).alias("chapter"), (F.col("id") % 2).alias("loc"))
    one = [r.id for r in metrics.audit_sample(items, 10, "1", "chapter", "loc", "id").collect()]
    assert one == [r.id for r in metrics.audit_sample(items, 10, "1", "chapter", "loc", "id").collect()]
    assert one != [r.id for r in metrics.audit_sample(items, 10, "2", "chapter", "loc", "id").collect()]
    assert sorted([i % 3 for i in one].count(k) for k in range(3)) == [3, 3, 4]


def test_sinks_and_sources(spark, tmp_path):
    readers.write_json({"b": 1, "a": "é"}, str(tmp_path / "x" / "m.json"))
    assert (tmp_path / "x" / "m.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    (tmp_path / "S-2.1.json").write_text("{broken")
    assert readers.contracts(spark, str(tmp_path / "S-2.1.json")).first().section_id == "S-2.1"
    (tmp_path / "spec.txt").write_text("one\ftwo")
    assert [(r.number, r.text) for r in readers.pages_text(spark, str(tmp_path / "spec.txt")).orderBy("number").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "junit.xml").write_text('<testsuite><testcase classname="c" name="a"/><testcase classname="c" name="b"><failure>no</failure></testcase></testsuite>')
    assert {r.name: r.failed for r in readers.xml_cases(spark, str(tmp_path / "junit.xml")).collect()} == {"a": False, "b": True}
    (tmp_path / "t.yaml").write_text("gates:\n- metric: m\n  least: 0.5\n")
    assert readers.yaml_rows(spark, str(tmp_path / "t.yaml"), "gates", "metric string, least double").first().least == 0.5
    rows = spark.createDataFrame([("a", 1)], "section_id string, attempt int")
    readers.write_attempts(rows, str(tmp_path / "att"))
    readers.write_attempts(spark.createDataFrame([("a", 2)], "section_id string, attempt int"), str(tmp_path / "att"))
    assert spark.read.parquet(str(tmp_path / "att")).count() == 2
    readers.write_once(rows, str(tmp_path / "sheet"))
    with pytest.raises(Exception, match="already exists"):
        readers.write_once(rows, str(tmp_path / "sheet"))


def test_attempt_stream(spark, tmp_path):
    from attesta.streaming.attempts import attempt_stream, classify_stream, current_status

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"section_id": "a", "attempt": n, "errors": e, "findings": 0, "invalid": False}) for n, e in ((1, 3), (2, 1))))
    for turn in range(2):
        classify_stream(attempt_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        status = current_status(spark, str(tmp_path / "out")).where("section_id = 'a'").first().status
        assert status == ("NEEDS_RETRY" if turn == 0 else "VERIFIED")
        (src / "2.json").write_text(json.dumps({"section_id": "a", "attempt": 3, "errors": 0, "findings": 0, "invalid": False}))


def test_inventory_uses_constants_of_other_files(spark):
    files = spark.createDataFrame([("p", "a.py", 'ROOT = "/api/v1/x"'), ("p", "b.py", 'def f(s):\n    s.delete(ROOT)')], "package string, file string, source string")
    assert [(r.method, r.path) for r in diff.ast_inventory(files).collect()] == [("DELETE", "/api/v1/x")]


def test_readers_of_states_and_pins(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none.json"), "a string").columns == ["a"]
    (tmp_path / "lock.yaml").write_text(f"sources:\n- {{id: b, kind: file, url: u, dest: d, sha256: {'a' * 64}}}\n- {{id: a, kind: git, url: u, dest: d, commit: 12}}\n")
    assert [(r.id, r.error is None) for r in readers.pins(spark, str(tmp_path / "lock.yaml")).collect()] == [("a", False), ("b", True)]
    (tmp_path / "s.jsonl").write_text('{"id": "S-1.1", "lines": [[1, "x"], [2, "y"]]}\n')
    assert [tuple(r) for r in readers.section_lines(spark, str(tmp_path / "s.jsonl")).orderBy("ord").collect()] == [("S-1.1", 0, 1, "x"), ("S-1.1", 1, 2, "y")]
    for name in ("pkg/a.py", "pkg/tests/b.py", "pkg/sub/c.py", "pkg/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert sorted(r.file for r in readers.python_files(spark, str(tmp_path / "pkg")).collect()) == ["a.py", "sub/c.py"]
    (tmp_path / "map.yaml").write_text("producer: p\nentries:\n- {section_id: S-1.1, model: m.X, code: {file: a.py, line: 3}}\n")
    assert [tuple(r) for r in readers.mapping_rows(spark, str(tmp_path / "map.yaml")).collect()] == [("S-1.1", "m.X", "data", "a.py", 3)]
    rows = readers.lineage(spark.createDataFrame([("S-1.1", '{"extraction": {"producer": "p", "attempt": 2}}'), ("S-1.2", "{broken")], "section_id string, raw string"))
    assert {r.section_id: (r.tool, r.attempt, len(r.sha256)) for r in rows.collect()} == {"S-1.1": ("p", 2, 64), "S-1.2": (None, None, 64)}
    manifest = spark.createDataFrame([("out", "p1", ["x"], "h")], "artifact string, producer string, inputs array<string>, sha256 string")
    assert readers.cached(manifest, "out", "p1", ["x"], "h") and not readers.cached(manifest, "out", "p1", ["y"], "h") and not readers.cached(manifest, "out", "p1", ["x"], None)
    assert [r.section_id for r in readers.in_chapter(spark.createDataFrame([("S-1.1",), ("S-11.1",)], "section_id string"), 1).collect()] == ["S-1.1"]
    readers.write_attempts(spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "section_id string, attempt int, items int"), str(tmp_path / "results"))
    assert {r.section_id: r["items"] for r in readers.latest_attempts(spark, str(tmp_path / "results")).collect()} == {"a": 6, "b": 7}
    readers.write_yaml({"b": 1, "a": 2}, str(tmp_path / "x.yaml"))
    assert (tmp_path / "x.yaml").read_text() == "a: 2\nb: 1\n"


def test_results_table_replaces_itself(spark):
    rows = spark.createDataFrame([("a", 1, 3, 0.3333), ("b", 0, 0, None)], "metric string, numerator long, denominator long, value double")
    table = metrics.results_table(rows)
    text = metrics.update_text(f"x\n{metrics.START}\nold\n{metrics.END}\ny", table)
    assert "| a | 1/3 (33.3%) |" in text and "| b | pending |" in text and "old" not in text and metrics.update_text(text, table) == text
    with pytest.raises(ValueError, match="needed"):
        metrics.update_text("no marks", table)


def test_page_margins_take_linear_time(spark):
    page = "\n".join(f"    line {i}   " for i in range(20_000)) + "\n\n   \n"
    row = spark.createDataFrame([(page,), ("  a\r\n\r\n    b \r\n",), ("",), (" \n ",)], "t string").select(segment.clean_page(F.col("t")).alias("c")).collect()
    assert row[0].c == "\n".join(f"line {i}" for i in range(20_000))
    assert [r.c for r in row[1:]] == ["a\n\n  b", "", ""]


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_ranges_are_filled_and_numbered_as_whole_partitions(spark, width):
    rows = spark.range(40).selectExpr("id % 2 as g", "id", "if(id % 7 = 3, concat('v', id), null) as v", "id % 3 as f")
    got = segment.filled(rows, F.col("v"), "w", ["g"], "id", width).collect()
    assert len(got) == 40 and all(r.w == next((f"v{i}" for i in range(r.id, -1, -1) if i % 2 == r.g and i % 7 == 3), None) for r in got)
    got = {r.id: r.n for r in segment.numbered(rows, "n", ["g"], ["f"], "id", width).collect()}
    for g in (0, 1):
        order = sorted((i for i in range(40) if i % 2 == g), key=lambda i: (i % 3, i))
        assert [got[i] for i in order] == list(range(1, 21))
