"""Rates with numerators and denominators, gates, audits and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import trunc4


def rate_row(df: DataFrame, name: str, n: Column, d: Column) -> DataFrame:
    """(metric, numerator, denominator, value, reason) of one aggregate; without a denominator the value is null."""
    agg = df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("numerator"), F.coalesce(d, F.lit(0)).cast("long").alias("denominator"))
    value = trunc4(F.col("numerator"), F.col("denominator"))
    reason = F.when(F.col("denominator") == 0, "no observations")
    return agg.select(F.lit(name).alias("metric"), "numerator", "denominator", value.alias("value"), reason.alias("reason"))


def rates_by(df: DataFrame, key: str, n: Column, d: Column) -> DataFrame:
    agg = df.groupBy(key).agg(n.cast("long").alias("numerator"), d.cast("long").alias("denominator"))
    return agg.withColumn("value", trunc4(F.col("numerator"), F.col("denominator")))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds (metric, least, most) against metrics (metric, value): PASS or FAIL with a reason."""
    both = thresholds.join(metrics.select("metric", "value"), "metric", "left")
    reason = (
        F.when(F.col("value").isNull(), "no value").when(F.col("value") < F.col("least"), "below least")
        .when(F.col("value") > F.col("most"), "above most")
    )
    return both.select("metric", "value", F.when(reason.isNull(), "PASS").otherwise("FAIL").alias("verdict"), F.coalesce(reason, F.lit("")).alias("reason"))


def audit_sample(items: DataFrame, n: int, seed: str, stratum: str, inner: str, key: str) -> DataFrame:
    """n items, seeded and reproducible: by hash within (stratum, inner), cycling inner groups, then strata in turn."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = items.withColumn("__h", order)
    # no more than n rows of an inner group can be drawn: the others go before the strata are ranked
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, inner).orderBy("__h", key))).where(F.col("__r") <= n)
    ranked = ranked.withColumn("__t", F.row_number().over(Window.partitionBy(stratum).orderBy("__r", inner, key)))
    return ranked.orderBy("__t", stratum).limit(n).drop("__h", "__r", "__t")


def audit_score(rows: DataFrame, verdict: str = "verdict", missed: str = "missed", section: str = "section") -> DataFrame:
    right = F.lower(F.trim(F.col(verdict))) == "correct"
    wrong = F.lower(F.trim(F.col(verdict))) == "incorrect"
    return rows.agg(
        F.count_if(right).alias("correct"), F.count_if(right | wrong).alias("n"), F.countDistinct(section).alias("sections"),
        F.countDistinct(F.when(F.col(missed), F.col(section))).alias("sections_with_miss"),
    )


def contract_items(fields: DataFrame) -> DataFrame:
    """Every field and definition (doc, section_id, n, location, name, required, type_raw, enum, page, quote) as an auditor sees it."""
    required = F.when(F.col("required").isNull(), "").when(F.col("required"), "T").otherwise("F")
    chapter = F.regexp_extract("section_id", r"^S-(\d+)\.", 1).cast("int")
    return fields.select(
        "doc", F.concat_ws("/", "section_id", "location", "name").alias("item_id"), "section_id", chapter.alias("chapter"), "location", "page", F.col("name").alias("claimed_name"), required.alias("claimed_required"),
        F.col("type_raw").alias("claimed_type"), F.array_join("enum", "|").alias("claimed_enum"), "quote",
    )


def score_sheet(rows: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counts of a filled audit sheet (keys, claimed_name, verdict, missed_neighbor).

    `issues` (keys, category, field) are those of the latest verification: an item is passed by the verifier if its section was
    verified and no extraction issue is about it.
    """
    said = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    known = issues.groupBy(*keys).agg(F.collect_set(F.when(F.col("category") == "extraction", F.coalesce("field", F.lit("")))).alias("wrong"))
    both = rows.withColumn("said", said).withColumn("scored", F.col("said").isin("correct", "incorrect")).join(known, keys, "left")
    passed = F.col("scored") & F.col("wrong").isNotNull() & ~F.array_contains(F.coalesce("wrong", F.array().cast("array<string>")), F.col("claimed_name"))
    section = F.struct(*keys)
    missed = F.col("scored") & (F.trim(F.coalesce("missed_neighbor", F.lit(""))) != "")
    return both.agg(
        F.count_if(F.col("said") == "correct").alias("correct"), F.count_if("scored").alias("n"), F.countDistinct(F.when(F.col("scored"), section)).alias("sections"), F.countDistinct(F.when(missed, section)).alias("sections_with_miss"),
        F.count_if(~F.col("scored")).alias("unscored"), F.count_if(passed).alias("verifier_passed"), F.count_if(passed & (F.col("said") == "incorrect")).alias("verifier_passed_incorrect"),
    )


#: The groups of findings by the start of their type.
GROUPS = {"spec_findings": "SPEC_", "community_discrepancies": "COMMUNITY_", "client_findings": "CLIENT_"}


def finding_groups(findings: DataFrame) -> DataFrame:
    """(metric, type, n) of findings (type, review): candidates and confirmed ones of each group by type, with a total of type ALL."""
    group = F.create_map(*[x for k, v in GROUPS.items() for x in (F.lit(v), F.lit(k))])
    rows = findings.withColumn("group", F.try_element_at(group, F.concat(F.split_part("type", F.lit("_"), F.lit(1)), F.lit("_")))).where("group is not null")
    kinds = F.array_compact(F.array(F.lit("candidate"), F.when(F.col("review") == "CONFIRMED", F.lit("confirmed"))))
    rows = rows.select("group", "type", F.explode(kinds).alias("kind"))
    rows = rows.select(F.concat_ws("_", "group", "kind").alias("metric"), F.explode(F.array("type", F.lit("ALL"))).alias("type"))
    return rows.groupBy("metric", "type").agg(F.count("*").alias("n"))


def contract_metrics(sections: DataFrame, contracts: DataFrame, latest: DataFrame, issues: DataFrame) -> DataFrame:
    """Rates of one verification. sections: kind and keys; contracts: keys; latest: counts by section; issues: code by section."""
    keys = ["doc", "section_id"]
    ends = sections.where("kind = 'endpoint'").select(*keys).distinct().join(contracts.select(*keys).distinct().withColumn("has", F.lit(True)), keys, "left")
    codes = issues.groupBy(*keys).agg(F.count_if(F.col("code") == "V2_ROW_NOT_FOUND").alias("no_row"), F.count_if(F.col("code") == "V5_COVERAGE_GAP").alias("gaps"), F.count_if(F.col("code") == "V1_SCHEMA_INVALID").alias("invalid"))
    both = latest.join(codes, keys, "left").na.fill(0, ["no_row", "gaps", "invalid"])
    total = lambda c: F.sum(c)
    parts = [
        ("citation_presence_rate", total("items"), total("items")), ("citation_grounding_rate", total("grounded"), total("items")), ("row_check_applicability", total("row_checked"), total("row_checked") + total("no_row")),
        ("row_consistency_rate", total("row_ok"), total("row_checked")), ("field_coverage", total("rows_detected") - total("gaps"), total("rows_detected")), ("schema_valid_rate", F.count_if(F.col("invalid") == 0), F.count("*")),
        ("sample_parse_rate", total("samples_parsed"), total("samples")),
    ]
    return union_all(rate_row(ends, "endpoint_coverage", F.count("has"), F.count("*")), *[rate_row(both, *p) for p in parts])


def audit_metrics(score: DataFrame) -> DataFrame:
    """The audit's rates from one row of `score_sheet`; nothing was observed if no item was scored."""
    parts = [("audited_precision", "correct", "n"), ("audited_miss_rate", "sections_with_miss", "sections"), ("verifier_false_accept", "verifier_passed_incorrect", "verifier_passed")]
    return union_all(*[rate_row(score, name, F.sum(n), F.sum(d)) for name, n, d in parts])


#: The lines around the table in a text.
START, END = "<!-- RESULTS:START -->", "<!-- RESULTS:END -->"


def results_table(metrics: DataFrame) -> str:
    """A Markdown table of some rates (metric, numerator, denominator, value), in their order."""
    rows = [f"| {r['metric']} | " + (f"{r['numerator']}/{r['denominator']} ({int(r['value'] * 1000 + 1e-6) / 10}%)" if r["value"] is not None else "pending") + " |" for r in metrics.collect()]  # a row a rate
    return "\n".join(["| Metric | Value |", "|---|---|", *rows])


def update_text(text: str, table: str) -> str:
    """The text with what stands between the marks replaced; again gives the same."""
    before, start, rest = text.partition(START)
    _, end, after = rest.partition(END)
    if not (start and end):
        raise ValueError(f"{START} and {END} are needed around the table")
    return f"{before}{start}\n{table}\n{end}{after}"


def by_type(findings: DataFrame) -> DataFrame:
    """(type, total, confirmed) with a total over all types."""
    out = findings.rollup("type").agg(F.count("*").alias("total"), F.count_if(F.col("review") == "CONFIRMED").alias("confirmed"), F.grouping("type").alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("type")).alias("type"), "total", "confirmed")


def reviewed(findings: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Findings with the reviews' verdicts; only CONFIRMED and REJECTED override."""
    r = reviews.select(F.col(key), F.upper(F.trim("status")).alias("__s")).where(F.col("__s").isin("CONFIRMED", "REJECTED"))
    return findings.join(r, key, "left").withColumn("review", F.coalesce("__s", F.lit("CANDIDATE"))).drop("__s")


def sarif_rows(findings: DataFrame, levels: dict[str, str]) -> DataFrame:
    """(rule, level, file, line) of findings whose evidence has code in a file; the first such place."""
    place = F.get(F.filter("evidence", lambda e: (e["kind"] == "code") & e["file"].isNotNull()), 0)
    level = F.element_at(F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))]), F.col("severity"))
    return findings.withColumn("at", place).where("at is not null").select("id", F.col("type").alias("rule"), level.alias("level"), F.col("at.file").alias("file"), F.col("at.line").alias("line"))


#: The levels of findings by severity, and the schema of a SARIF log.
LEVELS = {"high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif(findings: DataFrame, tool: str = "attesta") -> DataFrame:
    """(log): one SARIF 2.1.0 log of the findings (id, type, severity, title, evidence) that name a place in a file.

    Rules are the distinct types in order, results are in the order of ids. A log is one report, some hundred findings.
    """
    rows = sarif_rows(findings, LEVELS).join(findings.select("id", "title"), "id")
    region = F.when(F.coalesce("line", F.lit(0)) > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"))
    per = rows.agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.transform(F.array_sort(F.collect_list(F.struct("id", result.alias("result")))), lambda x: x["result"]).alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"), r.alias("name"))).alias("rules"))
    return per.select(F.to_json(F.struct(F.lit(SARIF).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")).alias("runs"))).alias("log"))
