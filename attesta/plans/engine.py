"""Verification of contracts as one plan: contracts, sections, pages and lines to issues and counts.

All tables are keyed by (doc, section_id), so that a corpus of documents is verified at once. Invalid contracts give one issue
and go no further; the rules' issues are united, and counts are a grouped aggregate. `parse` and the sample rules read whole
contracts, a few kilobytes each, in Python; the searches in pages and lines are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import contracts as C
from ..operators import verify as V
from ..operators.metrics import union_all

KEYS = ["doc", "section_id"]
ROW_LOCATIONS = ("header", "body", "query", "path")
#: Severity and category of the codes that are not (error, extraction).
SEVERITY = {
    "V2_ROW_NOT_FOUND": ("info", "info"),
    "V3_SAMPLE_UNPARSEABLE": ("error", "sample_conflict"),
    "V3_REQUIRED_MISSING": ("warning", "sample_conflict"),
    "V3_TYPE_MISMATCH": ("error", "sample_conflict"),
    "V3_ENUM_VIOLATION": ("error", "sample_conflict"),
    "V3_UNKNOWN_FIELD": ("info", "info"),
}
COUNTS = ("items", "grounded", "row_checked", "row_ok", "rows_detected", "samples", "samples_parsed")


def _issue(rows: DataFrame, code: str | Column, field: Column | None = None, message: Column | None = None, page: Column | None = None, quote: Column | None = None, **hint: Column) -> DataFrame:
    """Rows as issues: evidence is null without a quote, a hint has the members given."""
    none = F.lit(None).cast("string")
    member = lambda k: hint[k].cast("string").alias(k) if k in hint else none.alias(k)
    names = ("closest_match", "closest_page", "suggested_page", "first_unmatched")
    evidence = F.struct(F.coalesce(page, F.lit(None)).cast("int").alias("page"), quote.alias("quote")) if quote is not None else F.lit(None).cast("struct<page:int,quote:string>")
    return rows.select(
        *KEYS, (F.lit(code) if isinstance(code, str) else code).alias("code"), (none if field is None else field).alias("field"), F.coalesce(none if message is None else message, F.lit("")).alias("message"),
        evidence.alias("evidence"), F.struct(*map(member, names)).alias("hint"),
    )


def fields_of(parsed: DataFrame) -> DataFrame:
    """Fields and definitions of the valid contracts by location and name, numbered in that order."""
    good = parsed.where("error is null")
    each = F.posexplode(F.array_sort(F.transform(F.concat("fields", "definitions"), lambda f, i: F.struct(f["location"].alias("location"), f["name"].alias("name"), i.alias("i"), f.alias("f")))))
    return good.select(*KEYS, each.alias("n", "x")).select(*KEYS, "n", "x.f.*")


def verify(raw: DataFrame, sections: DataFrame, pages: DataFrame, lines: DataFrame, opens: str = V.TABLE_OPENS, closes: str = V.TABLE_CLOSES) -> tuple[DataFrame, DataFrame]:
    """(issues: doc, section_id, attempt, code, severity, category, field, message, evidence, hint; counts by doc, section_id).

    raw: doc, section_id, raw. sections: doc, section_id, page_start, page_end, method_hint, path_hint. pages: doc, page, text.
    lines: doc, section_id, ord, page, line.
    """
    parsed = C.parse(raw)
    good = parsed.where("error is null")
    spans = sections.select(*KEYS, F.col("page_start").alias("first_page"), F.col("page_end").alias("last_page"))
    cites = good.select(*KEYS, F.posexplode("cites").alias("i", "c")).join(spans, KEYS)
    cites = cites.select(F.struct(*KEYS, "i").alias("cite_id"), *KEYS, "c.page", "c.quote", F.col("c.owner").alias("field"), "first_page", "last_page")
    cited = V.check_citations(cites, pages)
    lost = V.closest_lines(cited.where("verdict = 'V2_CITATION_NOT_FOUND'"), lines, KEYS)
    cited_hints = cited.where("verdict <> 'GROUNDED'").join(lost, "cite_id", "left")
    every = fields_of(parsed)
    rowed = every.where(F.col("location").isin(*ROW_LOCATIONS) & F.col("required").isNotNull())
    rows = V.check_rows(rowed.select(*KEYS, "name", "location", "required", "type_raw"), lines, KEYS)
    sample = C.sample_issues(parsed)
    wanted = good.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(f"{k}.raw").alias("raw")) for k in ("request", "response")])).alias("s")).select(*KEYS, "s.*").where("raw is not null")
    copies = V.check_verbatim(wanted, lines, KEYS)
    enums = V.check_enum(every.where("size(enum) > 0").withColumns({"page": F.coalesce("enum_page", "page"), "quote": F.coalesce("enum_quote", "quote")}))
    detected = V.detected_rows(lines, KEYS, opens, closes).join(good.select(*KEYS), KEYS, "left_semi")
    col = F.col
    issues = union_all(
        _issue(parsed.where("error is not null"), "V1_SCHEMA_INVALID", message=col("error")),
        _issue(cited_hints, col("verdict"), col("field"), F.concat(F.lit("cited page "), "page"), closest_match=col("closest_match"), closest_page=col("closest_page"), suggested_page=col("suggested_page")),
        _issue(V.check_names(every), "V2_NAME_NOT_IN_QUOTE", col("name"), F.lit("the quote lacks the name"), col("page"), col("quote")),
        _issue(rows.where("code = 'V2_ROW_NOT_FOUND'"), "V2_ROW_NOT_FOUND", col("name"), F.lit("no row of one line")),
        _issue(rows.where("code = 'V2_ROW_MISMATCH'"), "V2_ROW_MISMATCH", col("name"), F.lit("the row differs"), col("row_page"), snippet(col("row"), V.HINT_MOST)),
        _issue(enums, "V2_ENUM_NOT_GROUNDED", col("name"), F.array_join("missing", ", "), col("page"), col("quote")),
        _issue(copies.where("why is not null"), "V2_SAMPLE_NOT_VERBATIM", message=F.concat_ws(" ", "which", F.lit("sample"), "why"), first_unmatched=col("first_unmatched")),
        _issue(sample.where("code is not null"), col("code"), col("field"), F.concat_ws(" ", "which", F.lit("sample")), col("page"), col("quote")),
        _issue(V.check_endpoints(good.where("kind = 'endpoint'"), sections, KEYS), col("code"), message=F.lit("endpoint")),
        _issue(V.coverage_gaps(detected, every, [*KEYS, "name"]), "V5_COVERAGE_GAP", col("name"), F.lit("a table row is missing")),
    )
    kind = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("severity"), F.lit(v[1]).alias("category")))])
    issues = issues.withColumn("kind", F.try_element_at(kind, F.col("code"))).join(parsed.select(*KEYS, "attempt"), KEYS)
    issues = issues.select(*KEYS, "attempt", "code", F.coalesce("kind.severity", F.lit("error")).alias("severity"), F.coalesce("kind.category", F.lit("extraction")).alias("category"), "field", "message", "evidence", "hint")
    per = lambda df, **agg: df.groupBy(*KEYS).agg(*[v.alias(k) for k, v in agg.items()])
    counts = parsed.select(*KEYS, "attempt")
    for part in (
        per(cited, items=F.count("*"), grounded=F.count_if(F.col("verdict") == "GROUNDED")),
        per(rows, row_checked=F.count_if(F.col("code") != "V2_ROW_NOT_FOUND"), row_ok=F.count_if(F.col("code") == "OK")),
        per(detected, rows_detected=F.count("*")),
        per(sample.where("counted").select(*KEYS, "which", "parsed").distinct(), samples=F.count("*"), samples_parsed=F.count_if("parsed")),
    ):
        counts = counts.join(part, KEYS, "left")
    return issues, counts.na.fill(0, list(COUNTS))


def errors(issues: DataFrame) -> DataFrame:
    """Issues that mean the extraction is wrong."""
    return issues.where("category = 'extraction' and severity = 'error'")


def summary(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, section_id, attempt, n_issues, n_errors, ok) of every contract verified."""
    per = issues.groupBy(*KEYS).agg(F.count("*").alias("n_issues"), F.count_if((F.col("category") == "extraction") & (F.col("severity") == "error")).alias("n_errors"))
    out = counts.select(*KEYS, "attempt").join(per, KEYS, "left").na.fill(0, ["n_issues", "n_errors"])
    return out.withColumn("ok", F.col("n_errors") == 0)
