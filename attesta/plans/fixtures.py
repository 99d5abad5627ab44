"""Queries on literal fixtures: a small invented specification, contracts and client, with SQL over the same literals."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import contracts, diff, export, loop, metrics, samples, segment, verify
from . import engine
from ..session import literal, ship_package
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Pages of an invented specification: (page, text).
PAGES = [
    (1, "Contents\n1.1 Purpose ........ 2\n2.1 Shapes Schema ...... 3\n2.2 Add Shape ..... 4\n2.3 Read Shape ..... 6\n2.4 Drop Shape ...... 7"),
    (2, "1.1 Purpose\nShapes are kept in a box.\nVersion 2.0 of the box is current."),
    (3, "2.1 Shapes Schema\nName   Type   Values\nhue    string   Cyan Pink Teal"),
    (4, "2.2 Add Shape\nMethod : POST\nRequest URL: /v1/shapes/?debug=1\nRequest Body\n  side    T   integer\n  hue     T   string\n  note    F   array[string]\nSample\n{\"side\": 4,"),
    (5, "\"hue\": \"Grey\"}\n1.9 Late number\nend of sample"),
    (6, "2.3 Read   Shape\nMethod : GET\nRequest URL: v1/shapes/:id\nRequest Header\n  token   T   string\nErrors\n  side   T   number"),
    (7, "2.4 Drop Shape\nMethod : DELETE\nRequest URL: /v1/shapes/{id}"),
]
#: Fields claimed: (section_id, name, required, type_raw, quote, enum).
FIELDS = [
    ("S-2.2", "side", True, "Integer", "side T integer", []),
    ("S-2.2", "hue", False, "string", "hue T string", ["Cyan", "Mauve"]),
    ("S-2.2", "size", True, "string", "side T integer", []),
    ("S-2.3", "token", True, "string", "token T string", []),
    ("S-2.3", "side", True, "integer", "side T number", []),
]
OPENS, CLOSES = r"^Request (Header|Body)", r"^(Sample|Errors)"


def _sql(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]::varchar[]"
        if v is None:
            return "null"
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


def fixture(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


def pages(spark: SparkSession, docs: tuple[str, ...] = ("spec",)) -> DataFrame:
    """The pages, once for each document named."""
    return literal(spark, PAGES, "page int, text string").withColumn("doc", F.explode(F.array(*map(F.lit, docs))))


def lines(spark: SparkSession, docs: tuple[str, ...] = ("spec",)) -> DataFrame:
    return segment.explode_lines(pages(spark, docs).withColumn("toc", segment.is_toc(F.col("text"))), "text", "doc", "page", "toc")


def section_lines(spark: SparkSession, docs: tuple[str, ...] = ("spec",)) -> DataFrame:
    """(doc, section_id, ord, page, line), by the sections' page spans and headings."""
    rows = lines(spark, docs).where("not toc").withColumn("head", segment.heading(F.col("line")))
    rows = rows.withColumn("open", F.when(F.col("head").isNotNull() & (F.col("head.title") != "Late number"), F.concat(F.lit("S-"), F.col("head.chapter"), F.lit("."), F.col("head.number"))))
    rows = rows.withColumn("section_id", segment.fill_forward(F.col("open"), ["doc"], ["page", "line_no"]))
    return rows.select("doc", "section_id", (F.col("page") * 1000 + F.col("line_no")).cast("long").alias("ord"), "page", "line")


def fields(spark: SparkSession) -> DataFrame:
    return literal(spark, FIELDS, "section_id string, name string, required boolean, type_raw string, quote string, enum array<string>")


@fixture(
    "fx_sections",
    "select * from " + _sql([("S-1.1", "overview", 2, 2, None, None), ("S-2.1", "schema", 3, 3, None, None), ("S-2.2", "endpoint", 4, 5, "POST", "/v1/shapes"), ("S-2.3", "endpoint", 6, 6, "GET", "/v1/shapes/:id"), ("S-2.4", "endpoint", 7, 7, "DELETE", "/v1/shapes/{id}")], "section_id, kind, page_start, page_end, method_hint, path_hint"),
)
def fx_sections(spark):
    return segment.sections(lines(spark)).select("section_id", "kind", "page_start", "page_end", "method_hint", "path_hint")


@fixture("fx_rows", "select * from " + _sql([("S-2.2", "side", "OK"), ("S-2.2", "hue", "V2_ROW_MISMATCH"), ("S-2.2", "size", "V2_ROW_NOT_FOUND"), ("S-2.3", "token", "OK"), ("S-2.3", "side", "V2_ROW_MISMATCH")], "section_id, name, code"))
def fx_rows(spark):
    return verify.check_rows(fields(spark).withColumn("location", F.lit("body")), section_lines(spark), ["section_id"]).select("section_id", "name", "code")


@fixture("fx_names", f"select section_id, name from {_sql(FIELDS, 'section_id, name, required, type_raw, quote, enum')} where not contains(quote, name)")
def fx_names(spark):
    return verify.check_names(fields(spark)).select("section_id", "name")


@fixture("fx_enum", f"select section_id, name, array_to_string(list_filter(enum, lambda v: not contains(quote, v)), ',') as missing from {_sql(FIELDS, 'section_id, name, required, type_raw, quote, enum')} where len(list_filter(enum, lambda v: not contains(quote, v))) > 0")
def fx_enum(spark):
    return verify.check_enum(fields(spark)).select("section_id", "name", F.array_join("missing", ",").alias("missing"))


@fixture("fx_endpoints", "select * from " + _sql([("S-2.3", "V4_METHOD_MISMATCH"), ("S-2.4", "V4_PATH_MISMATCH")], "section_id, code"))
def fx_endpoints(spark):
    claims = literal(spark, [("S-2.2", "post", "v1/shapes/"), ("S-2.3", "PUT", "/v1/shapes/{key}"), ("S-2.4", "DELETE", "/v1/shape/{id}"), ("S-2.1", "GET", "/x")], "section_id string, method string, path string")
    return verify.check_endpoints(claims, segment.sections(lines(spark)), ["section_id"])


@fixture("fx_coverage", "select * from " + _sql([("S-2.2", "note")], "section_id, name"))
def fx_coverage(spark):
    found = verify.detected_rows(section_lines(spark), ["section_id"], OPENS, CLOSES)
    return verify.coverage_gaps(found, fields(spark), ["section_id", "name"]).select("section_id", "name")


#: Lines of a section with two samples, (page, line), and copies of them: (copy, which, raw, why it is no verbatim copy).
BLOCK = [(1, "Request Sample"), (1, "{"), (1, '  "a": 1,'), (1, '  "b": 2'), (1, "}"), (1, "Response Sample"), (1, "{"), (1, '  "code": "0"'), (1, "page footer"), (2, "}"), (2, "# another example"), (2, '{"code": "1"}'), (2, "2.7 Next Part"), (2, "last line")]
COPIES = [
    ("exact", '{\n"a": 1,\n"b": 2\n}', None),
    ("spacing", '{\n   "a":   1,\n\n"b": 2\n}', None),
    ("over a footer", '{\n"code": "0"\n}', None),
    ("before a heading", '{"code": "1"}', None),
    ("cut short", '{\n"a": 1,', "is an incomplete copy"),
    ("swapped", '"b": 2\n"a": 1,\n}', "not a verbatim copy"),
    ("absent", '{\n"c": 3\n}', "not a verbatim copy"),
    ("past the end", '"b": 2\n}\nResponse Sample\n{', "runs past the end of its block"),
    ("empty", "", None),
]


@fixture("fx_verbatim", "select * from " + _sql([(c, w) for c, _, w in COPIES], "copy, why"))
def fx_verbatim(spark):
    block = literal(spark, [("s", i, p, t) for i, (p, t) in enumerate(BLOCK)], "section_id string, ord int, page int, line string")
    own = literal(spark, [("s", c, r) for c, r, _ in COPIES], "section_id string, name string, raw string")
    return verify.check_verbatim(own, block, ["section_id"]).select(F.col("name").alias("copy"), "why")


#: Texts with compatibility characters, curly quotes and odd spaces: (text, normalised).
NORMS = [("plain  text", "plain text"), ("\ufb01eld \u201cname\u201d", 'field "name"'), ("A\u00a0B\u2003C", "A B C"), ("\uff21\uff11", "A1"), ("e\u0301", "\u00e9"), ("\u2460 it\u2019s", "1 it's"), (" \t\u3000 ", "")]


@fixture("fx_norm", "select * from " + _sql(NORMS, "raw, n"))
def fx_norm(spark):
    return literal(spark, NORMS, "raw string, n string").select("raw", text.norm("raw").alias("n"))


#: Lines and whether they are table rows: (line, name).
ROW_LINES = [("name  T  string", "name"), ("name  T  string, more", "name"), ("--  T  string", None), ("a.b[0]  F  array[object]", "a.b[0]"), ("name T  string", None), ("1st  T  string", None), ("size  F  Size in inches", None), ("x  T  Integer", "x")]


@fixture("fx_row_tokens", "select * from " + _sql(ROW_LINES, "line, name"))
def fx_row_tokens(spark):
    return literal(spark, ROW_LINES, "line string, name string").select("line", text.row_tokens(F.col("line"))["name"].alias("name"))


#: Pages and whether they are contents pages, and texts with their hints: (text, toc, kind, method, path).
HINTS = [
    ("\n".join(f"{i}.1 Part ..... {i}" for i in range(5)), True, "overview", None, None),
    ("\n".join(f"see 3.{i} .. {i}" for i in range(5)), False, "overview", None, None),
    ("Method : POST now\nRequest  URL :  v1/x/?a=1", False, "endpoint", "POST", "/v1/x"),
    ("Method: post\nRequest URL: none", False, "endpoint", None, None),
]


@fixture("fx_hints", "select * from " + _sql(HINTS, "text, toc, kind, method, path"))
def fx_hints(spark):
    rows = literal(spark, HINTS, "text string, a boolean, b string, c string, d string").select("text")
    found = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    return rows.select("text", segment.is_toc(F.col("text")).alias("toc"), segment.kind_of(F.lit("Title"), F.col("text")).alias("kind"), found(segment.METHOD).alias("method"), text.path_hint(found(segment.REQUEST_URL)).alias("path"))


def cite(page: int, quote: str) -> dict:
    return {"page": page, "quote": quote}


def spec_field(name: str, kind: str, raw: str, required: bool | None, page: int, quote: str, location: str = "body", **more) -> dict:
    return {"name": name, "location": location, "required": required, "type": kind, "type_raw": raw, "citation": cite(page, quote), **more}


#: A contract of section S-2.2 without a fault of its own; the sample's hue contradicts the enumeration.
GOOD = {
    "schema_version": 1, "section_id": "S-2.2", "kind": "endpoint", "title": "Add Shape", "method": "POST", "path": "/v1/shapes",
    "citations": {"path": cite(4, "Request URL: /v1/shapes/?debug=1")},
    "fields": [spec_field("side", "integer", "integer", True, 4, "side    T   integer"), spec_field("hue", "string", "string", True, 4, "hue     T   string", enum=["Cyan", "Pink", "Teal"], enum_citation=cite(3, "hue    string   Cyan Pink Teal")), spec_field("note", "array", "array[string]", False, 4, "note    F   array[string]")],
    "samples": {"request": {"raw": '{"side": 4,\n"hue": "Grey"}', "citation": cite(5, '"hue": "Grey"}')}},
    "extraction": {"producer": "test", "mode": "hand", "prompt_version": "1", "attempt": 1},
}
#: Single faults and the code each must give.
FAULTS = {
    "fabricated quote": "V2_CITATION_NOT_FOUND", "wrong page": "V2_CITATION_WRONG_PAGE", "other required": "V2_ROW_MISMATCH", "other type": "V2_ROW_MISMATCH", "field left out": "V5_COVERAGE_GAP",
    "enum not quoted": "V2_ENUM_NOT_GROUNDED", "sample repaired": "V2_SAMPLE_NOT_VERBATIM", "sample cut": "V2_SAMPLE_NOT_VERBATIM", "other path": "V4_PATH_MISMATCH", "other method": "V4_METHOD_MISMATCH",
    "short quote": "V1_SCHEMA_INVALID", "name not quoted": "V2_NAME_NOT_IN_QUOTE", "unknown key": "V1_SCHEMA_INVALID", "not JSON": "V1_SCHEMA_INVALID",
}


def faulty(fault: str) -> str:
    """The good contract with one fault, as JSON."""
    c = copy.deepcopy(GOOD)
    side, hue, note = c["fields"]
    match fault:
        case "fabricated quote":
            side["citation"]["quote"] = "side was never specified"
        case "wrong page":
            side["citation"]["page"] = 5
        case "other required":
            side["required"] = False
        case "other type":
            side["type_raw"] = "string"
        case "field left out":
            c["fields"].remove(note)
        case "enum not quoted":
            hue["enum"].append("Mauve")
        case "sample repaired":
            c["samples"]["request"]["raw"] = '{"side": 4,\n"hue": "Cyan"}'
        case "sample cut":
            c["samples"]["request"]["raw"] = '{"side": 4,'
        case "other path":
            c["path"] = "/v1/shape"
        case "other method":
            c["method"] = "PUT"
        case "short quote":
            side["citation"]["quote"] = "side"
        case "name not quoted":
            side["citation"]["quote"] = "note    F   array[string]"
        case "unknown key":
            c["more"] = 1
    return "{broken" if fault == "not JSON" else json.dumps(c)


def verified(spark: SparkSession, raws: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(issues, counts) of contracts of S-2.2, each in a document of its own."""
    docs = tuple(raws)
    raw = literal(spark, [(d, "S-2.2", r) for d, r in raws.items()], "doc string, section_id string, raw string")
    return engine.verify(raw, segment.sections(lines(spark, docs)), pages(spark, docs), section_lines(spark, docs), OPENS, CLOSES)


def all_cases() -> dict[str, str]:
    return {"good": json.dumps(GOOD)} | {k: faulty(k) for k in FAULTS}


@fixture("fx_verify_issues", "select * from " + _sql([*FAULTS.items()], "doc, code"))
def fx_verify_issues(spark):
    """Each fault gives its one code and no other extraction issue."""
    return engine.errors(verified(spark, all_cases())[0]).select("doc", "code")


#: Issues that are no extraction errors, and counts of the good contract and two faulty ones.
OTHER = [("good", "V3_ENUM_VIOLATION", "hue", "error", "sample_conflict")]
COUNTS = [("good", 1, 6, 6, 3, 3, 3, 1, 1), ("fabricated quote", 1, 6, 5, 3, 3, 3, 1, 1), ("other type", 1, 6, 6, 3, 2, 3, 1, 1), ("not JSON", 1, 0, 0, 0, 0, 0, 0, 0), ("sample cut", 1, 6, 6, 3, 3, 3, 1, 0)]


@fixture("fx_verify_other", "select * from " + _sql(OTHER, "doc, code, field, severity, category"))
def fx_verify_other(spark):
    return verified(spark, {"good": json.dumps(GOOD)})[0].select("doc", "code", "field", "severity", "category")


@fixture("fx_verify_counts", "select doc, attempt::int as attempt, items::bigint as items, grounded::bigint as grounded, row_checked::bigint as row_checked, row_ok::bigint as row_ok, rows_detected::bigint as rows_detected, samples::bigint as samples, samples_parsed::bigint as samples_parsed from " + _sql(COUNTS, "doc, attempt, items, grounded, row_checked, row_ok, rows_detected, samples, samples_parsed"))
def fx_verify_counts(spark):
    cases = {k: v for k, v in all_cases().items() if k in {c[0] for c in COUNTS}}
    return verified(spark, cases)[1].select("doc", "attempt", *engine.COUNTS)


@fixture("fx_verify_summary", "select doc, n_issues::bigint as n_issues, n_errors::bigint as n_errors, n_errors = 0 as ok from " + _sql([("good", 1, 0), ("wrong page", 2, 1), ("not JSON", 1, 1)], "doc, n_issues, n_errors"))
def fx_verify_summary(spark):
    cases = {k: v for k, v in all_cases().items() if k in ("good", "wrong page", "not JSON")}
    return engine.summary(*verified(spark, cases)).select("doc", "n_issues", "n_errors", "ok")


@fixture("fx_verify_hints", "select * from " + _sql([("fabricated quote", "closest", "side    T   integer"[:4]), ("wrong page", "page", "4"), ("sample cut", "first", '"hue": "Grey"}')], "doc, kind, hint"))
def fx_verify_hints(spark):
    """What a retry is told: the nearest line (its first word here), the page that has the quote, the first line missed."""
    cases = {k: v for k, v in all_cases().items() if k in ("fabricated quote", "wrong page", "sample cut")}
    rows = engine.errors(verified(spark, cases)[0])
    h = F.col("hint")
    kind = F.when(h["closest_match"].isNotNull(), "closest").when(h["suggested_page"].isNotNull(), "page").otherwise("first")
    return rows.select("doc", kind.alias("kind"), F.coalesce(F.split_part(h["closest_match"], F.lit(" "), F.lit(1)), h["suggested_page"], h["first_unmatched"]).alias("hint"))


ENUM_QUOTE, SAMPLE_QUOTE = "hue    string   Cyan Pink Teal", '\\"hue\\": \\"Grey\\"}'


@fixture("fx_spec_findings", f"""with e as (select '{{"file": null, "kind": "doc", "line": null, "page": 3, "quote": "{ENUM_QUOTE}", "snippet": null}}' as a, '{{"file": null, "kind": "doc", "line": null, "page": 5, "quote": "{SAMPLE_QUOTE}", "snippet": null}}' as b)
    select 'good' as doc, 'SPEC_SELF_INCONSISTENCY' as type, 'high' as severity, 'Sample value violates the documented enum for hue' as title, 'F-' || substr(sha256('SPEC_SELF_INCONSISTENCY|S-2.2|hue|' || least(a, b) || '|' || greatest(a, b)), 1, 8) as id from e""")
def fx_spec_findings(spark):
    """The good contract's conflict is a finding; the same conflict beside an extraction error is not grounded."""
    cases = {"good": json.dumps(GOOD), "other type": faulty("other type")}
    issues, _ = verified(spark, cases)
    raw = literal(spark, [(d, "S-2.2", r) for d, r in cases.items()], "doc string, section_id string, raw string")
    return loop.spec_findings(issues, engine.fields_of(contracts.parse(raw)), engine.KEYS).select("doc", "type", "severity", "title", "id")


#: Values against one field each: (case, type, enum, value as JSON, code or null); null is allowed everywhere.
VALUES = [
    ("null", "string", [], '{"a": null}', None), ("null of an enum", "string", ["x"], '{"a": null}', None), ("integral float", "integer", [], '{"a": 1.0}', None), ("Boolean for integer", "integer", [], '{"a": true}', "V3_TYPE_MISMATCH"),
    ("text for number", "number", [], '{"a": "1"}', "V3_TYPE_MISMATCH"), ("other value", "string", ["x", "y"], '{"a": "z"}', "V3_ENUM_VIOLATION"), ("missing", "string", [], "{}", "V3_REQUIRED_MISSING"), ("an array", "string", [], "[1]", "V3_TYPE_MISMATCH"),
    ("a text", "string", [], '"a"', "V3_TYPE_MISMATCH"), ("unknown key", "string", [], '{"a": "x", "b": 1}', "V3_UNKNOWN_FIELD"), ("unknown type", "unknown", [], '{"a": [1]}', None), ("not JSON", "string", [], '{"a": }', "V3_SAMPLE_UNPARSEABLE"),
    ("curl", "string", [], """curl -X POST --data-raw '{"a": "x"}
' http://h
curl -d '[]'""", None), ("glued option", "string", [], "head-d 'x'", "V3_SAMPLE_UNPARSEABLE"),
]
#: Responses against rows named Data (an array), x, and data.y: (case, response, codes in order).
RESPONSES = [
    ("whole", '{"code": 0, "msg": "", "data": [{"x": "1"}, {"x": null}]}', ""), ("no data", '{"code": 0, "msg": ""}', ""), ("no msg", '{"code": 0}', "V3_REQUIRED_MISSING"),
    ("data no array", '{"code": 0, "msg": "", "data": {"x": "1"}}', "V3_TYPE_MISMATCH"), ("item no object", '{"code": 0, "msg": "", "data": ["1"]}', "V3_TYPE_MISMATCH"),
    ("item without x", '{"code": 0, "msg": "", "data": [{}]}', "V3_REQUIRED_MISSING"), ("an array", "[]", "V3_TYPE_MISMATCH"), ("nested rows are skipped", '{"code": 0, "msg": "", "data": [{"x": "1", "y": 2}]}', ""),
]


def _with_samples(fields: list[dict], **raws: str) -> str:
    samples = {k: {"raw": v, "citation": cite(4, "a quote that is long")} for k, v in raws.items()}
    return json.dumps({**GOOD, "citations": {}, "fields": fields, "samples": samples})


@fixture("fx_request_values", "select * from " + _sql([(v[0], v[4]) for v in VALUES], "doc, code"))
def fx_request_values(spark):
    raw = [(c, "S-2.2", _with_samples([spec_field("a", kind, kind, True, 4, "a quote that is long", enum=enum or None)], request=value)) for c, kind, enum, value, _ in VALUES]
    return contracts.sample_issues(contracts.parse(literal(spark, raw, "doc string, section_id string, raw string"))).select("doc", "code")


@fixture("fx_response_values", "select * from " + _sql([(r[0], r[2]) for r in RESPONSES], "doc, codes"))
def fx_response_values(spark):
    own = [spec_field(n, k, k, True, 4, "a quote that is long", "response") for n, k in (("Data", "array"), ("x", "string"), ("data.y", "string"))]
    raw = [(c, "S-2.2", _with_samples(own, response=value)) for c, value, _ in RESPONSES]
    rows = contracts.sample_issues(contracts.parse(literal(spark, raw, "doc string, section_id string, raw string")))
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


SAMPLES = [("plain", '{"a": 1}'), ("curl", "curl -X POST --data '{\"a\": 1}'"), ("no body", "curl -X GET http://x"), ("comma", '{"a": 1,}'), ("wrapped", '{"a": "one\n   two"}'), ("empty", "curl -d ''"), ("newline before the quote", "curl -d '{\"a\": 1}\n' -H 'x'\ncurl -d '[]'"), ("blank", "curl --data ' '"), ("open literal", '{"a": "x'), ("trailing", '{"a": 1} x')]


@fixture("fx_samples", "select * from " + _sql([("plain", True), ("curl", True), ("no body", None), ("comma", False), ("wrapped", True), ("empty", None), ("newline before the quote", True), ("blank", None), ("open literal", False), ("trailing", False)], "sample, ok"))
def fx_samples(spark):
    rows = literal(spark, SAMPLES, "sample string, raw string").select("sample", samples.payload("raw").alias("p"))
    return rows.select("sample", samples.strict_json("p").alias("ok"))


ATTEMPTS = [("a", 1, 2, 0, False), ("a", 2, 0, 1, False), ("b", 1, 2, 0, False), ("b", 2, 2, 0, False), ("c", 1, 3, 0, True), ("c", 2, 3, 0, False), ("d", 1, 1, 0, False), ("d", 3, 1, 0, False), ("e", 1, 0, 0, False)]


@fixture("fx_status", "select * from " + _sql([("a", "VERIFIED_WITH_SPEC_FINDINGS"), ("b", "QUARANTINED"), ("c", "NEEDS_RETRY"), ("d", "QUARANTINED"), ("e", "VERIFIED")], "section_id, status"))
def fx_status(spark):
    rows = literal(spark, ATTEMPTS, "section_id string, attempt int, errors long, findings long, invalid boolean")
    return loop.classify(rows).select("section_id", "status")


@fixture("fx_trunc", "select n, d, floor(n::double * 10000 / nullif(d, 0)) / 10000::double as v from (values (2, 3), (1, 3), (0, 5), (1, 0), (-1, 3), (7, 7)) t(n, d)")
def fx_trunc(spark):
    rows = literal(spark, [(2, 3), (1, 3), (0, 5), (1, 0), (-1, 3), (7, 7)], "n int, d int")
    return rows.select("n", "d", stats.trunc4(F.col("n"), F.col("d")).alias("v"))


@fixture("fx_spec_diff", "select * from " + _sql([("POST /v1/shapes", "hue", "ENUM_MISMATCH", "Teal", ""), ("POST /v1/shapes", "note", "MISSING_FIELD", "", ""), ("POST /v1/shapes", "side", "TYPE_MISMATCH", "", ""), ("POST /v1/shapes", "side", "REQUIRED_MISMATCH", "", ""), ("POST /v1/shapes", "more", "EXTRA_FIELD", "", "")], "op, name, code, missing, extra"))
def fx_spec_diff(spark):
    schema = "op string, name string, type string, required boolean, enum array<string>"
    op = "POST /v1/shapes"
    ours = literal(spark, [(op, "side", "integer", True, []), (op, "hue", "string", True, ["Cyan", "Pink", "Teal"]), (op, "note", "array", False, [])], schema)
    theirs = literal(spark, [(op, "side", "string", False, []), (op, "hue", "string", True, ["Cyan", "Pink"]), (op, "more", "string", False, [])], schema)
    own = F.col("code") == "ENUM_MISMATCH"
    out = diff.property_diff(ours, theirs, ["op", "name"])
    return out.select("op", "name", "code", F.when(own, F.col("missing")).otherwise("").alias("missing"), F.when(own, F.col("extra")).otherwise("").alias("extra"))


# Export and comparison ------------------------------------------------------------------------------------------------

Q = "a quote that is long"
#: Contracts to export: an endpoint, one that is not verified, one whose path is none, and a schema.
EXPORTED = [
    {**GOOD, "section_id": "S-3.1", "title": "Change Shape", "method": "PUT", "path": "api/v1/shapes/:id/parts/{part}?x=1", "citations": {"path": cite(4, Q)}, "samples": {}, "fields": [
        spec_field("Id", "string", "string", False, 4, Q, "path"), spec_field("other", "string", "string", True, 4, Q, "path"), spec_field("token", "string", "string", True, 4, Q, "header"), spec_field("size", "integer", "integer", None, 4, Q, "query"),
        spec_field("hue", "string", "string", True, 5, Q, enum=["Cyan", "Pink"]), spec_field("side", "integer", "integer", True, 5, Q, description="in inches"), spec_field("side.unit", "string", "string", True, 5, Q), spec_field("free", "unknown", "any", False, 5, Q), spec_field("name", "string", "string", False, 6, Q, "response")]},
    {**GOOD, "section_id": "S-3.2", "fields": [], "samples": {}},
    {**GOOD, "section_id": "S-3.3", "path": "shapes", "fields": [], "samples": {}},
    {**GOOD, "section_id": "S-2.1", "kind": "schema", "title": "Shapes Schema", "method": None, "path": None, "citations": {}, "samples": {}, "fields": [], "definitions": [spec_field("hue", "string", "string", None, 3, Q)]},
]


def exported(spark: SparkSession) -> DataFrame:
    raw = [("spec", c["section_id"], json.dumps(c)) for c in EXPORTED]
    parsed = contracts.parse(literal(spark, raw, "doc string, section_id string, raw string"))
    return export.export(parsed, parsed.where("section_id <> 'S-3.2'"))


AT = "paths./api/v1/shapes/{id}/parts/{part}.put"
#: Members of the exported document, by path, as JSON.
MEMBERS = [
    ("openapi", '"3.1.0"'), ("paths", "1"), (f"{AT}.summary", '"Change Shape"'), (f"{AT}.x-section", '"S-3.1"'), (f"{AT}.x-citation", f'{{"page":4,"quote":"{Q}"}}'),
    (f"{AT}.parameters", '[["header","token",true],["path","id",true],["query","size",false],["path","part",true]]'), (f"{AT}.requestBody.content.application/json.schema.required", '["hue","side"]'),
    (f"{AT}.requestBody.content.application/json.schema.properties", '{"free":[null,null],"hue":["string",["Cyan","Pink"]],"side":["integer",null]}'),
    (f"{AT}.responses.200.content.application/json.schema.properties.data.properties", '{"name":["string",null]}'), ("components.schemas.S-2.1.title", '"Shapes Schema"'), ("components.schemas.S-2.1.required", "[]"),
]


def _member(text: str, path: str) -> str:
    """A member of a document for comparison: numbers of paths, what tells parameters and properties apart, others whole."""
    value, keys = json.loads(text), path.split(".")
    while keys:  # keys may hold dots
        n = next(n for n in range(1, len(keys) + 1) if ".".join(keys[:n]) in value)
        value, keys = value[".".join(keys[:n])], keys[n:]
    if path == "paths":
        value = len(value)
    elif path.endswith("parameters"):
        value = [[p["in"], p["name"], p["required"]] for p in value]
    elif path.endswith("properties"):
        value = {k: [v.get("type"), v.get("enum")] for k, v in value.items()}
    return json.dumps(value, separators=(",", ":"), sort_keys=True)


@fixture("fx_export", "select * from " + _sql(MEMBERS, "member, value"))
def fx_export(spark):
    find = F.udf(_member)
    members = literal(spark, [(m,) for m, _ in MEMBERS], "member string")
    return members.crossJoin(exported(spark)).select("member", find("spec", "member").alias("value"))  # one document


_OK = {"responses": {"200": {"description": "x"}}}
#: Documents and what is wrong with them.
SPECS = [
    ("good", {"openapi": "3.1.0", "info": {"title": "t", "version": "1"}, "paths": {"/a/{b}": {"get": {**_OK, "parameters": [{"in": "path", "name": "b"}]}}}}, ""), ("old", {"swagger": "2.0"}, "no OpenAPI 3 document"),
    ("faults", {"openapi": "3.0.0", "info": {"title": "t"}, "paths": {"a": {}, "/b": {"fetch": _OK, "get": {}}, "/c/{d}": {"put": _OK}, "/e": {"put": {**_OK, "parameters": [{"in": "query", "name": "q"}] * 2}}}}, "info|put /c/{d}: path parameters differ from the template|fetch /b: no operation with responses|get /b: no operation with responses|put /e: a parameter twice|a: no path"),
]


@fixture("fx_export_problems", "select * from " + _sql([("export", ""), *[(n, "|".join(sorted(p.split("|")))) for n, _, p in SPECS]], "name, problems"))
def fx_export_problems(spark):
    """The exported document has no fault of structure; faulty ones are told."""
    given = literal(spark, [(n, json.dumps(d)) for n, d, _ in SPECS], "name string, spec string")
    rows = given.unionByName(exported(spark).select(F.lit("export").alias("name"), "spec"))
    return rows.select("name", F.array_join(F.array_sort(export.problems("spec")), "|").alias("problems"))


#: Another specification of the same service, with a reference chain and a cycle.
OTHERS = """openapi: 3.0.0
paths:
  /api/v1/shapes/{key}/parts/{p}:
    put:
      requestBody:
        $ref: '#/components/requestBodies/Shape'
  /api/v1/loop:
    post:
      requestBody:
        $ref: '#/components/requestBodies/A'
components:
  requestBodies:
    A:
      $ref: '#/components/requestBodies/B'
    B:
      $ref: '#/components/requestBodies/A'
    Shape:
      content:
        application/json:
          schema:
            $ref: '#/components/schemas/Shape'
  schemas:
    Shape:
      required: [hue]
      properties:
        hue:
          type: string
          enum: [Cyan, Teal]
        side:
          type: string
        extra/ed:
          type: string
"""
BODY = "#/components/schemas/Shape"
#: Differences: (type, severity, field, pointer, line, whether our document is cited).
DIFFERENCES = [
    ("COMMUNITY_ENUM_MISMATCH", "medium", "hue", f"{BODY}/properties/hue/enum", 28, True), ("COMMUNITY_REQUIRED_MISMATCH", "medium", "side", f"{BODY}/required", 24, True), ("COMMUNITY_TYPE_MISMATCH", "medium", "side", f"{BODY}/properties/side/type", 30, True),
    ("COMMUNITY_EXTRA_FIELD", "info", "extra/ed", f"{BODY}/properties/extra~1ed", 32, False), ("COMMUNITY_MISSING_FIELD", "low", "free", f"{BODY}/properties", 26, True), ("COMMUNITY_MISSING_ENDPOINT", "medium", None, "#/paths", 3, True),
]


@fixture("fx_specification_findings", "select * from " + _sql(DIFFERENCES, "type, severity, field, pointer, line, cited"))
def fx_specification_findings(spark):
    ours = export.read_operations(exported(spark).select("doc", F.col("spec").alias("text")))
    more = ours.where("method = 'PUT'").withColumns({"method": F.lit("DELETE"), "props": F.slice("props", F.lit(1), F.lit(0))})
    theirs = export.read_operations(literal(spark, [("other", OTHERS)], "doc string, text string"))
    found = diff.specification_findings(ours.unionByName(more), theirs, "other.yaml")
    place = F.from_json(F.get(F.filter("evidence", lambda e: e.contains('"code"')), 0), "line int, snippet string")
    return found.select("type", "severity", "field", place["snippet"].alias("pointer"), place["line"].alias("line"), (F.size("evidence") == 2).alias("cited"))


CLIENT = '''BASE = "/api/v1/shapes"
UNUSED = "/api/v1/later"


class Box:
    def call(self, method, path, extra=None):
        return self.s.request(method, path)

    def ask(self, path, method="put"):
        return path

    def read(self, s, key, other):
        s.get(f"{BASE}/{key}")
        s.post(BASE)
        s.request("DELETE", "/api/v1/gadgets")
        s.get(other)
        s.get("http://" + other)
        self.call("patch", "/api/v1/gadgets/1")
        self.ask("/api/v1/asked")
        where = f"https://{key}/api/v1/near{other}"
        s.get(where)
        s.get("/plain")
        return UNUSED
'''
#: The calls: (method, path, line, dynamic).
CALLS = [("GET", "/api/v1/shapes/{}", 13, False), ("POST", "/api/v1/shapes", 14, False), ("DELETE", "/api/v1/gadgets", 15, False), ("GET", "", 17, True), ("PATCH", "/api/v1/gadgets/1", 18, False), ("PUT", "/api/v1/asked", 19, False), ("GET", "/api/v1/near{}", 21, True), ("UNKNOWN", "/api/v1/later", 23, False)]


def client_files(spark: SparkSession, **files: str) -> DataFrame:
    return literal(spark, [("client", f"{k}.py", v) for k, v in files.items()], "package string, file string, source string")


@fixture("fx_inventory", "select * from " + _sql(CALLS, "method, path, line, dynamic"))
def fx_inventory(spark):
    return diff.ast_inventory(client_files(spark, api=CLIENT, broken="def (")).select("method", "path", "line", "dynamic")


@fixture("fx_uncheckable", "select * from " + _sql([(c[0], c[2]) for c in CALLS if c[3]], "method, line"))
def fx_uncheckable(spark):
    return diff.uncheckable(diff.ast_inventory(client_files(spark, api=CLIENT))).select("method", "line")


MODELS = '''from enum import Enum
from typing import Annotated, ClassVar, Literal, Optional


class Hue(str, Enum):
    CYAN = "Cyan"
    PINK = "Pink"


class Part(Base):
    id: str


class Shape(Base):
    kind: ClassVar[str] = "x"
    side: int
    hue: Hue = Hue.CYAN
    size: Optional[float] = None
    parts: list[Part]
    part: Part | None = None
    mode: Literal["a", "b"]
    name: str = Field(..., alias="shapeName")
    note: str = Field(default="x")
    both: int | str = 1
    tags: "Annotated[set[str], 1]"
'''
#: The fields of the model: (key, type, required, enumeration).
SHAPE = [("side", "integer", True, ""), ("hue", "string", False, "Cyan|Pink"), ("size", "number", False, ""), ("parts", "array", True, ""), ("part", "object", False, ""), ("mode", "string", True, "a|b"), ("shapeName", "string", True, ""), ("note", "string", False, ""), ("both", "unknown", False, ""), ("tags", "array", True, "")]


@fixture("fx_models", "select * from " + _sql(SHAPE, "key, type, required, enum"))
def fx_models(spark):
    return diff.ast_models(client_files(spark, models=MODELS)).where("class_name = 'Shape'").select("key", "type", "required", F.coalesce(F.array_join("enum", "|"), F.lit("")).alias("enum"))


#: Model mappings: (section_id, model, json_path, file, line, why it can't be trusted).
MAPPINGS = [
    ("S-2.3", "models.Shape", "data[*]", "models.py", 14, None), ("S-2.4", "models.Shape", "data", "models.py", 14, "section is not verified"), ("S-2.3", "models.Part", "items", "models.py", 10, "bad path"),
    ("S-2.3", "models.Hue", "data", "none.py", 5, "no such file"), ("S-2.3", "models.Part", "data", "models.py", 11, "the line is not the class's"), ("S-2.3", "models.Par", "data", "models.py", 10, "the line is not the class's"), ("S-2.3", "x.Hue", "data", "models.py", 0, "the line is not the class's"),
]


def mapped(spark: SparkSession) -> DataFrame:
    rows = literal(spark, [m[:5] for m in MAPPINGS], "section_id string, model string, json_path string, file string, line int")
    return diff.check_mappings(rows, literal(spark, [("S-2.3",)], "section_id string"), client_files(spark, models=MODELS))


@fixture("fx_mappings", "select * from " + _sql([(m[1], m[2], m[4], m[0], m[5]) for m in MAPPINGS], "model, json_path, line, section_id, why"))
def fx_mappings(spark):
    return mapped(spark).select("model", "json_path", "line", "section_id", "why")


#: Documented response fields (name, type), and what the model's differ in: (type, severity, field).
DOCUMENTED = [("data.side", "string"), ("hue", "string"), ("size", "number"), ("parts", "array"), ("mode", "unknown"), ("shapeName", "string"), ("data.tags", "array"), ("side", "integer"), ("deep.x", "string"), ("note", "integer")]
UNLIKE = [("CLIENT_TYPE_MISMATCH", "medium", "side"), ("CLIENT_TYPE_MISMATCH", "medium", "note")]


@fixture("fx_model_findings", "select * from " + _sql(UNLIKE, "type, severity, field"))
def fx_model_findings(spark):
    own = [("S-2.3", i, n, "response", t, 6, "a quote that is long") for i, (n, t) in enumerate(DOCUMENTED)] + [("S-2.3", 99, "part", "body", "string", 6, "x")]
    fields = diff.doc_fields(literal(spark, own, "section_id string, n int, name string, location string, type string, page int, quote string"), ["section_id"])
    found = diff.model_findings(mapped(spark).where("why is null"), diff.ast_models(client_files(spark, models=MODELS)), fields, "client")
    return found.select("type", "severity", "field")


@fixture("fx_undocumented_fields", "select * from " + _sql([("CLIENT_REQUIRES_UNDOCUMENTED_FIELD", "high", k) for k in ("side", "parts", "mode", "shapeName", "tags")], "type, severity, field"))
def fx_undocumented_fields(spark):
    """Against a section that documents none of them the required fields of the model are findings."""
    none = literal(spark, [], "section_id string, key string, type string, page int, quote string")
    return diff.model_findings(mapped(spark).where("why is null"), diff.ast_models(client_files(spark, models=MODELS)), none, "client").select("type", "severity", "field")


#: Documented operations (path, method, section_id, page, quote), and what the client's calls and models have against them.
OPERATIONS = [("/api/v1/shapes/:id", "GET", "S-2.3", 6, "read a shape"), ("/api/v1/shapes", "PUT", "S-2.2", 4, "add a shape"), ("/api/v1/shapes", "GET", "S-2.9", 9, "list of shapes"), ("/api/v1/later", "GET", "S-2.8", 8, "later on")]
CONFORM = [
    ("CLIENT_METHOD_MISMATCH", "high", "S-2.2", "/api/v1/shapes", 2), ("CLIENT_UNDOCUMENTED_ENDPOINT", "medium", "-", "/api/v1/gadgets", 1), ("CLIENT_UNDOCUMENTED_ENDPOINT", "medium", "-", "/api/v1/gadgets/1", 1),
    ("CLIENT_UNDOCUMENTED_ENDPOINT", "medium", "-", "/api/v1/asked", 1), *[("CLIENT_REQUIRES_UNDOCUMENTED_FIELD", "high", "S-2.3", k, 1) for k in ("side", "parts", "mode", "shapeName", "tags")],
]


@fixture("fx_conform", "select * from " + _sql(CONFORM, "type, severity, section_id, field, places"))
def fx_conform(spark):
    """All findings about a client, those of calls and those of models, each once."""
    calls = diff.inventory_findings(diff.ast_inventory(client_files(spark, api=CLIENT)), literal(spark, OPERATIONS, "path string, method string, section_id string, page int, quote string"), "client")
    none = literal(spark, [], "section_id string, key string, type string, page int, quote string")
    models = diff.model_findings(mapped(spark).where("why is null"), diff.ast_models(client_files(spark, models=MODELS)), none, "client")
    return diff.conform(calls, models, calls).select("type", "severity", "section_id", "field", F.size("evidence").alias("places"))


#: Messages of a validation and their summaries.
MESSAGES = [("trace\n\n 2 validation errors for X\n a\n  b\n c\n d\n e\n f\n g", "2 validation errors for X | a | b | c | d | e | f"), ("no such line", "no such line")]


@fixture("fx_error_summary", "select * from " + _sql(MESSAGES, "message, summary"))
def fx_error_summary(spark):
    return literal(spark, MESSAGES, "message string, s string").select("message", diff.summary_of(F.col("message")).alias("summary"))


#: Quotes, lines and the line nearest to each: windows of the longer string are compared.
NEAREST = [("side T integer", ["x", "the side  T  integer row", "side"], "the side T integer row"), ("tokens T string", ["side T number", "a token T string here"], "a token T string here"), ("none", ["", "z"], "z")]


@fixture("fx_closest_line", "select * from " + _sql([(q, c) for q, _, c in NEAREST], "quote, closest"))
def fx_closest_line(spark):
    """The line with the best window against each quote; a hint, never part of a verdict."""
    quotes = literal(spark, [(q, q, q, 1) for q, _, _ in NEAREST], "cite_id string, section_id string, quote string, first_page int")
    own = literal(spark, [(q, i, 1, t) for q, ts, _ in NEAREST for i, t in enumerate(ts)], "section_id string, ord int, page int, line string")
    return verify.closest_lines(quotes, own, ["section_id"]).select(F.col("cite_id").alias("quote"), F.col("closest_match").alias("closest"))


# Sources and sinks ----------------------------------------------------------------------------------------------------

PINS = [("a", "0" * 64, None, None), ("b", None, "f" * 40, None), ("c", "0" * 63, None, "sha256 is no hash of 64 digits"), ("d", None, "F" * 40, "commit is no hash of 40 digits"), ("e", None, None, None)]


@fixture("fx_pins", "select * from " + _sql([(p[0], p[3]) for p in PINS], "id, error"))
def fx_pins(spark):
    return readers.check_pins(literal(spark, [p[:3] for p in PINS], "id string, sha256 string, commit string")).select("id", "error")


PARTS = [("S-1.1", '{"extraction": {"producer": "hand", "mode": "m", "prompt_version": "2", "attempt": 3}}'), ("S-1.2", "{broken"), ("S-11.1", "{}")]


@fixture("fx_lineage", "select section_id, sha256(raw) as sha256, stage, tool, mode, prompt_version, attempt::int as attempt from " + _sql([(*PARTS[0], "extract", "hand", "m", "2", 3), (*PARTS[1], "extract", None, None, None, None), (*PARTS[2], "extract", None, None, None, None)], "section_id, raw, stage, tool, mode, prompt_version, attempt"))
def fx_lineage(spark):
    return readers.lineage(literal(spark, PARTS, "section_id string, raw string"))


@fixture("fx_chapter", "select * from " + _sql([("S-1.1",), ("S-1.2",)], "section_id"))
def fx_chapter(spark):
    return readers.in_chapter(literal(spark, PARTS, "section_id string, raw string"), 1).select("section_id")


MANIFEST = [("pages", "x 1", ["s"], "h1"), ("index", "x 1", ["p"], "h2")]
#: Questions of a cache and their answers: (artifact, producer, input, hash of the file there is).
ASKED = [("pages", "x 1", "s", "h1", True), ("pages", "x 2", "s", "h1", False), ("pages", "x 1", "t", "h1", False), ("pages", "x 1", "s", "h3", False), ("pages", "x 1", "s", None, False), ("none", "x 1", "s", "h1", False)]


@fixture("fx_cached", "select * from " + _sql(ASKED, "artifact, producer, input, present, cached"))
def fx_cached(spark):
    manifest = literal(spark, MANIFEST, "artifact string, producer string, inputs array<string>, sha256 string")
    rows = [(a, p, i, h, readers.cached(manifest, a, p, [i], h)) for a, p, i, h, _ in ASKED]
    return literal(spark, rows, "artifact string, producer string, input string, present string, cached boolean")


@fixture("fx_record_of", "select * from " + _sql([("index", "h2")], "artifact, sha256"))
def fx_record_of(spark):
    return readers.record_of(literal(spark, MANIFEST, "artifact string, producer string, inputs array<string>, sha256 string"), "index").select("artifact", "sha256")


#: Findings for a log: (id, type, severity, title, kind, file, line).
LOGGED = [("F-2", "B", "high", "two", "code", "b.py", 7), ("F-1", "A", "info", "one", "code", "a.py", None), ("F-3", "C", "high", "three", "doc", None, None), ("F-4", "A", "medium", "four", "code", "a.py", 3)]
RESULTS = [(0, "A", "note", "one", "a.py", None, "F-1"), (1, "B", "error", "two", "b.py", 7, "F-2"), (2, "A", "warning", "four", "a.py", 3, "F-4")]


@fixture("fx_sarif", "select i::bigint as i, rule, level, title, file, line::bigint as line, id, 'A,B' as rules from " + _sql(RESULTS, "i, rule, level, title, file, line, id"))
def fx_sarif(spark):
    rows = literal(spark, LOGGED, "id string, type string, severity string, title string, kind string, file string, line long")
    log = metrics.sarif(rows.select("id", "type", "severity", "title", F.array(F.struct("kind", "file", "line")).alias("evidence")))
    kind = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>>, partialFingerprints struct<findingId:string>"
    run = F.from_json("log", f"runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in kind.split(', '))}>>>>")["runs"][0]
    each = log.select(run.alias("r")).select(F.array_join("r.tool.driver.rules.id", ",").alias("rules"), F.posexplode("r.results").alias("i", "x"))
    at = F.col("x.locations")[0]["physicalLocation"]
    return each.select(F.col("i").cast("long").alias("i"), F.col("x.ruleId").alias("rule"), "x.level", F.col("x.message.text").alias("title"), at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"), F.col("x.partialFingerprints.findingId").alias("id"), "rules")


# Metrics and audit ----------------------------------------------------------------------------------------------------

#: Rates of the good contract, a fabricated quote, a coverage gap and a broken file, over four endpoint sections each of four documents.
RATES = [
    ("endpoint_coverage", 4, 12, 0.3333), ("citation_presence_rate", 17, 17, 1.0), ("citation_grounding_rate", 16, 17, 0.9411), ("row_check_applicability", 8, 8, 1.0), ("row_consistency_rate", 8, 8, 1.0),
    ("field_coverage", 8, 9, 0.8888), ("schema_valid_rate", 3, 4, 0.75), ("sample_parse_rate", 3, 3, 1.0),
]


@fixture("fx_contract_metrics", "select metric, numerator::bigint as numerator, denominator::bigint as denominator, value::double as value from " + _sql(RATES, "metric, numerator, denominator, value"))
def fx_contract_metrics(spark):
    cases = {k: v for k, v in all_cases().items() if k in ("good", "fabricated quote", "field left out", "not JSON")}
    issues, counts = verified(spark, cases)
    own = literal(spark, [(d, "S-2.2") for d in cases], "doc string, section_id string")
    return metrics.contract_metrics(segment.sections(lines(spark, tuple(cases))), own, counts, issues).drop("reason")


@fixture("fx_contract_items", "select * from " + _sql([("S-2.2/body/hue", 2, "T", "string", "Cyan|Pink|Teal", 4), ("S-2.2/body/note", 2, "F", "array[string]", "", 4), ("S-2.2/body/side", 2, "T", "integer", "", 4)], "item_id, chapter, claimed_required, claimed_type, claimed_enum, page"))
def fx_contract_items(spark):
    parsed = contracts.parse(literal(spark, [("spec", "S-2.2", json.dumps(GOOD))], "doc string, section_id string, raw string"))
    return metrics.contract_items(engine.fields_of(parsed)).select("item_id", "chapter", "claimed_required", "claimed_type", "claimed_enum", "page")


#: A filled sheet: (section_id, claimed_name, verdict, missed_neighbor), and issues of the latest verification.
SHEET = [("S-2.2", "side", " Correct", None), ("S-2.2", "hue", "incorrect", "x"), ("S-2.3", "token", "correct", " "), ("S-2.3", "side", "incorrect ", None), ("S-2.4", "id", "correct", None), ("S-2.4", "z", "", "y")]
ABOUT = [("S-2.2", "extraction", "hue"), ("S-2.2", "info", "side"), ("S-2.3", "info", "token")]
SCORE = (3, 5, 3, 1, 1, 3, 1)


def _scored(spark: SparkSession) -> DataFrame:
    sheet = literal(spark, SHEET, "section_id string, claimed_name string, verdict string, missed_neighbor string")
    return metrics.score_sheet(sheet, literal(spark, ABOUT, "section_id string, category string, field string"), ["section_id"])


@fixture("fx_audit_score", "select * from " + _sql([SCORE], "correct, n, sections, sections_with_miss, unscored, verifier_passed, verifier_passed_incorrect"))
def fx_audit_score(spark):
    return _scored(spark)


@fixture("fx_audit_metrics", "select metric, n::bigint as numerator, d::bigint as denominator, v::double as value from " + _sql([("audited_precision", 3, 5, 0.6), ("audited_miss_rate", 1, 3, 0.3333), ("verifier_false_accept", 1, 3, 0.3333)], "metric, n, d, v"))
def fx_audit_metrics(spark):
    return metrics.audit_metrics(_scored(spark)).drop("reason")


FINDINGS = [("SPEC_A", "CONFIRMED"), ("SPEC_A", "CANDIDATE"), ("SPEC_B", "CONFIRMED"), ("COMMUNITY_X", "REJECTED"), ("CLIENT_Y", "CANDIDATE"), ("OTHER_Z", "CONFIRMED")]
GROUPED = [("spec_findings_candidate", "SPEC_A", 2), ("spec_findings_candidate", "SPEC_B", 1), ("spec_findings_candidate", "ALL", 3), ("spec_findings_confirmed", "SPEC_A", 1), ("spec_findings_confirmed", "SPEC_B", 1), ("spec_findings_confirmed", "ALL", 2), ("community_discrepancies_candidate", "COMMUNITY_X", 1), ("community_discrepancies_candidate", "ALL", 1), ("client_findings_candidate", "CLIENT_Y", 1), ("client_findings_candidate", "ALL", 1)]


@fixture("fx_finding_groups", "select metric, type, n::bigint as n from " + _sql(GROUPED, "metric, type, n"))
def fx_finding_groups(spark):
    return metrics.finding_groups(literal(spark, FINDINGS, "type string, review string"))


STATE = [("S-1.1", 4, 4, 2, 2, 3, 1, 1), ("S-1.2", 6, 5, 3, 2, 4, 2, 1), ("S-1.3", 0, 0, 0, 0, 0, 0, 0)]


@fixture("fx_metrics", f"""with s as {_sql(STATE, 'section_id, items, grounded, row_checked, row_ok, rows_detected, samples, samples_parsed')},
    r as (select 'citation_grounding_rate' as metric, sum(grounded) as n, sum(items) as d from s union all select 'row_consistency_rate', sum(row_ok), sum(row_checked) from s union all select 'sample_parse_rate', sum(samples_parsed), sum(samples) from s
    union all select 'row_check_applicability', sum(row_checked), sum(row_checked) + 1 from s union all select 'field_coverage', sum(rows_detected) - 2, sum(rows_detected) from s)
    select metric, n::bigint as numerator, d::bigint as denominator, floor(n::double * 10000 / d) / 10000::double as value from r""")
def fx_metrics(spark):
    rows = literal(spark, STATE, "section_id string, items long, grounded long, row_checked long, row_ok long, rows_detected long, samples long, samples_parsed long")
    parts = [("citation_grounding_rate", F.sum("grounded"), F.sum("items")), ("row_consistency_rate", F.sum("row_ok"), F.sum("row_checked")), ("sample_parse_rate", F.sum("samples_parsed"), F.sum("samples")), ("row_check_applicability", F.sum("row_checked"), F.sum("row_checked") + 1), ("field_coverage", F.sum("rows_detected") - 2, F.sum("rows_detected"))]
    return metrics.union_all(*[metrics.rate_row(rows, *p) for p in parts]).drop("reason")
