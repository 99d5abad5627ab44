"""The bounded retry loop: attempts, classification, findings, feedback and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_evidence, finding_id
from ..functions.text import norm
from ..session import literal
from .verify import RULES

MAX_ATTEMPTS = 3
#: Statuses that count as verified.
TRUSTED = ("VERIFIED", "VERIFIED_WITH_SPEC_FINDINGS")
#: Issue code to finding type, severity and title.
SPEC_FINDINGS = {
    "V3_ENUM_VIOLATION": ("SPEC_SELF_INCONSISTENCY", "high", "Sample value violates the documented enum for {field}"),
    "V3_TYPE_MISMATCH": ("SPEC_SELF_INCONSISTENCY", "high", "Sample value type contradicts the documented type of {field}"),
    "V3_REQUIRED_MISSING": ("SPEC_SAMPLE_INCOMPLETE", "medium", "Sample omits {field}, which the document marks required"),
    "V3_SAMPLE_UNPARSEABLE": ("SPEC_MALFORMED_SAMPLE", "medium", "Document sample is not valid JSON"),
}
#: The first lines of a feedback text.
INSTRUCTION = "Fix ONLY the items below. Do not change items that passed."


def latest(results: DataFrame, key: str = "section_id", attempt: str = "attempt") -> DataFrame:
    """The last attempt of each section: a grouped maximum over whole rows, without sorting a section."""
    rest = [c for c in results.columns if c not in (key, attempt)]
    top = results.groupBy(key).agg(F.max_by(F.struct(*rest), attempt).alias("r"), F.max(attempt).alias(attempt))
    return top.select(key, attempt, "r.*")


def first(results: DataFrame, attempt: str = "attempt") -> DataFrame:
    return results.where(F.col(attempt) == 1)


def status(errors: Column, previous: Column, previous_invalid: Column, attempt: Column, findings: Column) -> Column:
    """No errors: verified, with or without findings. Else quarantined when stalled or out of attempts, else retried."""
    stalled = previous.isNotNull() & ~F.coalesce(previous_invalid, F.lit(False)) & (errors >= previous)
    return (
        F.when((errors > 0) & (stalled | (attempt >= MAX_ATTEMPTS)), "QUARANTINED").when(errors > 0, "NEEDS_RETRY")
        .when(findings > 0, "VERIFIED_WITH_SPEC_FINDINGS").otherwise("VERIFIED")
    )


def classify(attempts: DataFrame) -> DataFrame:
    """attempts: section_id, attempt, errors, findings, invalid. The status of each section's latest attempt.

    The previous attempt is joined by number, not by a lag: a gap in the numbers has no previous attempt.
    """
    last = latest(attempts)
    before = attempts.select("section_id", (F.col("attempt") + 1).alias("attempt"), F.col("errors").alias("prev"), F.col("invalid").alias("prev_invalid"))
    both = last.join(before, ["section_id", "attempt"], "left")
    return both.select("section_id", "attempt", "errors", status(F.col("errors"), F.col("prev"), F.col("prev_invalid"), F.col("attempt"), F.col("findings")).alias("status"))


def retryable(statuses: DataFrame) -> DataFrame:
    return statuses.where((F.col("status") == "NEEDS_RETRY") & (F.col("attempt") < MAX_ATTEMPTS))


def _doc(page: Column, quote: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("doc").alias("kind"), page.cast("long").alias("page"), quote.alias("quote"), none.cast("string").alias("file"), none.cast("long").alias("line"), none.cast("string").alias("snippet"))


def evidence(code: Column, sample: Column, page: Column, quote: Column, enum_page: Column, enum_quote: Column) -> Column:
    """Where a conflict is shown: the field's citation (that of its enumeration, if it has one, for its values) and the sample's."""
    field = F.when((code == "V3_ENUM_VIOLATION") & enum_quote.isNotNull(), _doc(enum_page, enum_quote)).when(quote.isNotNull() & (code != "V3_SAMPLE_UNPARSEABLE"), _doc(page, quote))
    return F.array_sort(F.transform(F.array_compact(F.array(field, F.when(sample.isNotNull(), _doc(sample["page"], sample["quote"])))), canonical_evidence))


def spec_findings(issues: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, type, severity, title, field, evidence): the grounded sample conflicts, each finding once.

    issues: keys, code, severity, category, field, evidence (page, quote). fields: keys, n (order), name, page, quote, enum_page,
    enum_quote; of fields with one name the first counts. A conflict is grounded if its section has no extraction error, it has
    the sample's citation, its field (unless it is a missing key) is known and no extraction issue is about that field.
    """
    table = literal(issues.sparkSession, [(k, *v) for k, v in SPEC_FINDINGS.items()], "code string, type string, severity string, title string")
    wrong = issues.where("category = 'extraction' and severity = 'error'").select(*keys).distinct()
    about = issues.where("category = 'extraction'").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("field").alias("__field")).distinct()
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    own = issues.where("category = 'sample_conflict' and evidence is not null").drop("severity").join(wrong, keys, "left_anti")
    own = own.join(about, [*same, F.col("field").eqNullSafe(F.col("__field"))], "left_anti").join(F.broadcast(table), "code")  # four rows
    cite = ("page", "quote", "enum_page", "enum_quote")
    first = fields.groupBy(*keys, F.col("name").alias("field")).agg(F.min_by(F.struct(*cite), "n").alias("cite"))
    both = own.join(first, [*keys, "field"], "left").where("field is null or code = 'V3_REQUIRED_MISSING' or cite is not null")
    shown = evidence(F.col("code"), F.col("evidence"), *[F.col(f"cite.{c}") for c in cite])
    both = both.select(*keys, "type", "severity", F.replace("title", F.lit("{field}"), F.coalesce("field", F.lit("the sample"))).alias("title"), "field", shown.alias("evidence"))
    both = both.withColumn("id", finding_id(F.col("type"), F.col("section_id"), F.col("field"), F.col("evidence")))
    return both.select(*keys, "id", "type", "severity", "title", "field", "evidence").dropDuplicates([*keys, "id"])


def funnel(attempts: DataFrame) -> DataFrame:
    """How many sections had no errors by attempt 1, 2, 3."""
    solved = attempts.groupBy("section_id").agg(F.min(F.when(F.col("errors") == 0, F.col("attempt"))).alias("at"))
    counts = [F.count_if(F.col("at") <= k).alias(f"by_{k}") for k in range(1, MAX_ATTEMPTS + 1)]
    wide = solved.agg(*counts)
    return wide.unpivot([], [f"by_{k}" for k in range(1, MAX_ATTEMPTS + 1)], "stage", "n")


def fixed(first_issues: DataFrame, last_issues: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct first-attempt issues that the latest attempt no longer has; null fields are equal."""
    a, b = first_issues.select(*keys).distinct(), last_issues.select(*keys).distinct()
    return a.subtract(b)


def feedback(issues: DataFrame, keys: list[str], fields: DataFrame, spans: DataFrame) -> DataFrame:
    """(keys, feedback): per section a text of its extraction errors, those without a field first, fields in order.

    issues: keys, attempt, code, severity, category, field, message, evidence, hint. fields: keys, n, name, location. spans: keys,
    page_start, page_end. A section's issues are a few; a hint or the evidence is shown below each.
    """
    own = issues.where("category = 'extraction' and severity = 'error'").join(spans.select(*keys, "page_start", "page_end"), keys, "left")
    where = fields.groupBy(*keys, F.col("name").alias("field")).agg(F.min_by("location", "n").alias("location"))
    own = own.join(where, [*keys, "field"], "left").join(fields.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left")
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    hint = F.col("hint")
    detail = (
        F.when(hint["closest_match"].isNotNull(), quoted("  Closest text on pages ", F.col("page_start").cast("string"), "-", F.col("page_end").cast("string"), " (page ", hint["closest_page"], '): "', hint["closest_match"], '"'))
        .when(hint["suggested_page"].isNotNull(), quoted("  The quote is on page ", hint["suggested_page"], "."))
        .when(hint["first_unmatched"].isNotNull(), quoted('  First line not found verbatim: "', hint["first_unmatched"], '"'))
        .when(F.col("evidence").isNotNull(), quoted("  Evidence: page ", F.col("evidence.page").cast("string"), ', "', norm("evidence.quote"), '"'))
    )
    text = F.concat_ws("\n", quoted("- ", F.col("code"), ": ", F.col("message")), detail)
    name = F.coalesce("field", F.lit("(section)"))
    location = F.when(F.col("known").isNull(), "unknown").otherwise(F.coalesce("location", F.lit("not in contract")))
    head = quoted("## ", name, F.when(F.col("field").isNotNull(), quoted(" (location: ", location, ")")).otherwise(F.lit("")))
    place = F.array_position(F.array(*map(F.lit, RULES)), F.col("code"))
    own = own.select(*keys, "attempt", F.col("field").isNotNull().alias("of_field"), name.alias("name"), head.alias("head"), F.struct(place.alias("rule"), "message", text.alias("text")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n")
    blocks = own.groupBy(*keys, "attempt", "of_field", "name", "head").agg(body.alias("body"))
    blocks = blocks.withColumn("b", F.struct("of_field", "name", quoted("\n\n", F.col("head"), "\n", F.col("body")).alias("text")))
    per = blocks.groupBy(*keys, "attempt").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "").alias("body"))
    number = F.col("attempt").cast("string")
    first = quoted("# Feedback: ", F.col("section_id"), " (attempt ", number, " \u2192 ", (F.col("attempt") + 1).cast("string"), ")\n", INSTRUCTION)
    return per.select(*keys, quoted(first, F.col("body"), "\n").alias("feedback"))


def upsert(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """old with the rows of new: new keys are added, changed content replaces, unchanged rows stay as they were."""
    n = new.select(F.col(key).alias("__key"), F.sha2(F.concat_ws(chr(31), *content), 256).alias("__h"))
    o = old.select("*", F.sha2(F.concat_ws(chr(31), *content), 256).alias("__o"))
    kept = o.join(n, F.col(key) == F.col("__key"), "left").where("__key is null or __o = __h").select(*old.columns)
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"))

