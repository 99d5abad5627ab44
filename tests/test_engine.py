import json

import pandas as pd
import pyarrow as pa
import pytest

from attesta.operators import contracts, samples, verify
from attesta.operators.contracts import check
from attesta.plans import engine, fixtures
from attesta.plans.fixtures import FAULTS, GOOD
from attesta.session import literal


def test_faults_are_told_apart(spark):
    issues, counts = fixtures.verified(spark, fixtures.all_cases())
    found = {}
    for r in engine.errors(issues).collect():
        found.setdefault(r.doc, []).append(r.code)
    assert found == {k: [v] for k, v in FAULTS.items()}
    assert counts.count() == len(FAULTS) + 1
    order = [(r.doc, verify.RULES.index(r.code)) for r in verify.ordered_issues(issues).select("doc", "code").collect()]
    assert [o[1] for o in order] == sorted(o[1] for o in order)


@pytest.mark.parametrize(("key", "value"), [("schema_version", 2), ("kind", "page"), ("method", None), ("section_id", "S-9.9"), ("more", 1), ("extraction", {"attempt": 0}), ("title", None), ("fields", ["x"]), ("samples", {"request": "x"})])
def test_strict_model(key, value):
    data, errors = check(json.dumps({**GOOD, key: value}), "S-2.2")
    assert data is None and errors


def test_partial_ratio():
    assert verify.partial_ratio("abc", "xxabcxx") == 100.0
    assert verify.partial_ratio("", "x") == 0.0
    assert verify._common("abcbdab", "bdcaba") == 4
    assert round(verify.partial_ratio("kitten", "sitting"), 2) == round(200 * 4 / 12, 2)


@pytest.mark.parametrize("text", ['{"a": "x\\ny"}', '{"a": "one\n   two", "b":\n 1}', '{"a": "q\\"\n  r"}', '{"a": "x\n y', '"\\\\\n" "b\nc"', ""])
def test_unwrapping_touches_literals_only(text):
    """Against a character-wise reading: outside literals nothing changes, inside line feeds and indents go."""
    out, inside, i = [], False, 0
    while i < len(text):
        if inside and text[i] == "\n":
            i += 1
            while i < len(text) and text[i] in " \t":
                i += 1
            continue
        if inside and text[i] == "\\":
            out.append(text[i])
            i += 1
            while i < len(text) and text[i] == "\n":
                i += 1
                while i < len(text) and text[i] in " \t":
                    i += 1
            if i < len(text):
                out.append(text[i])
                i += 1
            continue
        if text[i] == '"':
            inside = not inside
        out.append(text[i])
        i += 1
    assert samples.join_wrapped(text) == "".join(out)


@pytest.mark.parametrize("name", ["fx_spec_findings", "fx_verify_counts", "fx_verify_issues", "fx_closest_line"])
def test_literal_rows_need_no_python_worker(spark, name):
    plan = fixtures.QUERIES[name](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_literal_rows_are_those_given(spark):
    schema = "a string, b int, c array<string>, d double, e boolean"
    rows = [("x", 1, ["q", "r"], 0.5, True), (None, None, None, None, None), ("", -1, [], 2.0, False)]
    got = literal(spark, rows, schema)
    assert [tuple(r) for r in got.collect()] == rows and got.schema == spark.createDataFrame(rows, schema).schema
    assert literal(spark, [], schema).count() == 0 and literal(spark, [], schema).schema == got.schema


def test_lines_are_decoded_by_section():
    """The nearest lines of a batch, without all its lines as Python values at once."""
    lines = [[{"page": 1, "text": "a token"}, {"page": 2, "text": "tokens T string"}], [{"page": 3, "text": ""}], []]
    kind = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))
    got = verify.nearest.func(pa.array(["tokens T", "x", None]), pa.array(lines, kind))
    assert got.to_pylist() == [{"line": "tokens T string", "page": 2}, {"line": "", "page": None}, {"line": "", "page": None}]


class Caught:
    """Stands for a frame and gives the function that would run on its batches."""

    select = where = lambda self, *_: self
    mapInPandas = mapInArrow = lambda self, run, _: run


def test_a_batch_of_contracts_is_parsed_in_slices(spark):
    """Parsed contracts are many times their text; what a worker holds must not follow the batch."""
    cases = list(fixtures.all_cases().items())
    n = 2 * contracts.SLICE + 1
    raw = pd.DataFrame([(f"{i} {cases[i % len(cases)][0]}", "S-2.2", cases[i % len(cases)][1]) for i in range(n)], columns=["doc", "section_id", "raw"])
    frames = list(contracts.parse(Caught())(iter([raw])))
    assert [len(f) for f in frames] == [contracts.SLICE, contracts.SLICE, 1]
    assert [d for f in frames for d in f["doc"]] == list(raw["doc"])
    parsed = contracts.parse(literal(spark, raw.itertuples(index=False, name=None), "doc string, section_id string, raw string")).where("error is null")
    batch = parsed.select("doc", "section_id", "request", "response", "fields").toArrow().combine_chunks().to_batches()[0]
    assert batch.num_rows > contracts.SLICE
    out = list(contracts.sample_issues(Caught())(iter([batch])))
    assert len(out) == -(-batch.num_rows // contracts.SLICE)
    assert [d for b in out for d in b["doc"].to_pylist()] == batch["doc"].to_pylist()  # one request sample each
    assert list(contracts.sample_issues(Caught())(iter([batch.slice(0, 0)]))) == []
