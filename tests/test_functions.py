import hashlib
import json
import math
import unicodedata
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import hashing, stats, text


@given(st.text(max_size=60))
def test_norm_is_idempotent(s):
    once = text.norm_py(s)
    assert text.norm_py(once) == once


def test_norm_agrees_with_python(spark):
    samples = ["a  b", " x y z ", "“q” ‘r’", "tab\tnew\nline\x1c\x85end", "ﬁne", "", "ascii"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.norm(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == {s: text.norm_py(s) for s in samples}


def test_white_space_class_matches_python(spark):
    chars = [chr(c) for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", text.straight(F.concat(F.lit("a"), "c", F.lit("b"))).alias("n")).collect()
    for r in rows:
        if r.c not in text.QUOTES[0]:
            assert (r.n == "a b") == (r.c.isspace()), hex(ord(r.c))


@pytest.mark.parametrize(("line", "want"), [("  name   T   String", ("name", True, "string")), ("name  F  array[int]", ("name", False, "array[int]")), ("name T string", None), ("name   T   colour", None)])
def test_row_tokens(spark, line, want):
    got = spark.createDataFrame([(line,)], "l string").select(text.row_tokens(F.col("l")).alias("r")).first().r
    assert (tuple(got) if got else None) == want


def test_paths(spark):
    row = spark.createDataFrame([(" v1/a/:id/?x=1", "noslash")], "p string, q string").select(
        text.norm_path(F.col("p")).alias("n"), text.path_hint(F.col("p")).alias("h"), text.path_hint(F.col("q")).alias("none"), text.template_path(F.lit("/a/:b")).alias("t")
    )
    assert tuple(row.first()) == ("/v1/a/{}", "/v1/a/:id", None, "/a/{b}")


def test_trunc4_is_exact(spark):
    pairs = [(n, d) for n in range(-20, 60, 3) for d in (0, 1, 3, 7, 29, 116)]
    rows = spark.createDataFrame(pairs, "n int, d int").select("n", "d", stats.trunc4(F.col("n"), F.col("d")).alias("v")).collect()
    for r in rows:
        assert r.v == (None if r.d == 0 else math.floor(Fraction(r.n, r.d) * 10000) / 10000)


def test_wilson(spark):
    lo, hi = stats.wilson(F.col("c"), F.col("n"))
    rows = spark.createDataFrame([(40, 40), (0, 0), (19, 20)], "c int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0].lo == pytest.approx(0.9124, abs=1e-4) and rows[0].hi == pytest.approx(1.0)
    assert (rows[1].lo, rows[1].hi) == (0.0, 1.0)
    assert 0.7 < rows[2].lo < 0.95 < rows[2].hi <= 1


def test_evidence_and_ids(spark):
    ev = {"kind": "doc", "page": 3, "quote": 'a "b"\\\né', "file": None, "line": None, "snippet": None}
    df = spark.createDataFrame([(ev["kind"], ev["page"], ev["quote"], None, None, None)], "kind string, page int, quote string, file string, line int, snippet string")
    row = df.select(hashing.canonical_evidence(F.struct("*")).alias("c")).first()
    want = json.dumps(ev, sort_keys=True, ensure_ascii=False)
    assert row.c == want
    got = df.select(hashing.finding_id(F.lit("T"), F.lit("S-1.1"), F.lit(None), F.array(F.lit("z"), F.lit("a"))).alias("i")).first().i
    assert got == "F-" + hashlib.sha256(b"T|S-1.1||a|z").hexdigest()[:8]


def test_nfkc_only_for_non_ascii(spark):
    assert spark.createDataFrame([("ﬁ",)], "s string").select(text.nfkc("s").alias("n")).first().n == unicodedata.normalize("NFKC", "ﬁ")


def test_norm_of_every_character_that_nfkc_changes(spark):
    """In the JVM as in Python, alone and beside other text; letters newer than Python's Unicode are left out."""
    wide = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    changed = [c for c in wide if unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c) or c.isspace()]
    samples = [x for c in changed for x in (c, f" e{c} \n{c}́")]
    frame = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = frame.select("s", text.norm("s").alias("n"), text.nfkc("s").alias("k")).collect()
    assert [r.n for r in rows] == [text.norm_py(s) for s in samples]
    assert [r.k for r in rows] == [unicodedata.normalize("NFKC", s) for s in samples]


def test_norm_needs_no_python_worker_and_keeps_null(spark):
    rows = spark.createDataFrame([(None,), ("ﬁ  x",)], "s string").select(text.norm("s").alias("n"), text.nfkc("s").alias("k"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [(None, None), ("fi x", "fi  x")]
