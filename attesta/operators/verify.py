"""Verification rules: citations, table rows, enumerations, endpoints and coverage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc, norm, norm_path, row_tokens, straight

#: Issue codes in the order of the rules, which is the order of issues.
RULES = (
    "V1_SCHEMA_INVALID",
    "V2_QUOTE_TOO_SHORT",
    "V2_CITATION_NOT_FOUND",
    "V2_CITATION_WRONG_PAGE",
    "V2_NAME_NOT_IN_QUOTE",
    "V2_ROW_MISMATCH",
    "V2_ROW_NOT_FOUND",
    "V2_ENUM_NOT_GROUNDED",
    "V2_SAMPLE_NOT_VERBATIM",
    "V3_SAMPLE_UNPARSEABLE",
    "V3_REQUIRED_MISSING",
    "V3_TYPE_MISMATCH",
    "V3_ENUM_VIOLATION",
    "V3_UNKNOWN_FIELD",
    "V4_METHOD_MISMATCH",
    "V4_PATH_MISMATCH",
    "V5_COVERAGE_GAP",
)
QUOTE_LEAST, QUOTE_MOST, HINT_MOST = 12, 200, 200
#: What starts the line after a sample; the markers, and the others that may be lines of a sample too.
MARKERS = ("Request Sample", "Response Sample", "Request Header", "Request Body", "Request Path", "Response Body", "Query Parameters", "Path Parameters", "#")
SOFT = ("curl", "-")
NUMBERED = r"^\d{1,2}\.(\d{1,2})?\s+[A-Z]"
#: The lines that open and that close a parameter table.
TABLE_OPENS = r"^(Request Header|Request Body|Query Parameters|Path Parameters|Response Body)"
TABLE_CLOSES = r"^(Request Sample|Response Sample)"
#: Quotes of so many characters in all go to every executor; more of them are joined by their words.
BROADCAST_CHARS = 8 << 20


def quote_ok(quote: Column) -> Column:
    return F.length(norm(quote)).between(QUOTE_LEAST, QUOTE_MOST)


def check_citations(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """cites (cite_id, doc, page, quote, first_page, last_page and more) with verdict and suggested_page; pages: doc, page, text.

    A quote meets the cited page and the pages of its section by key, all at once; each of those pages is normalised once.
    The lowest page of the section that holds a quote the cited page lacks is suggested.
    """
    rest = [c for c in cites.columns if c != "cite_id"]
    wanted = cites.withColumn("q", norm("quote"))
    span = F.when(F.col("first_page") <= F.col("last_page"), F.sequence("first_page", "last_page"))
    own = F.array_distinct(F.array_compact(F.concat(F.array("page"), F.coalesce(span, F.array().cast(cites.select(F.array("page").alias("p")).schema["p"].dataType)))))
    asked = wanted.select("cite_id", "doc", "q", "page", "first_page", "last_page", F.explode(own).alias("at"))
    needed = asked.select("doc", F.col("at").alias("page")).distinct()
    norms = pages.join(needed, ["doc", "page"], "left_semi").select("doc", F.col("page").alias("at"), norm("text").alias("t"))
    held = asked.where(F.length("q") >= QUOTE_LEAST).join(norms, ["doc", "at"]).where(F.col("t").contains(F.col("q")))
    found = held.groupBy("cite_id").agg(F.bool_or(F.col("at").eqNullSafe(F.col("page"))).alias("here"), F.min(F.when(F.col("at").between(F.col("first_page"), F.col("last_page")), F.col("at"))).alias("near"))
    here = F.coalesce("here", F.lit(False))
    verdict = F.when(F.length("q") < QUOTE_LEAST, "V2_QUOTE_TOO_SHORT").when(here, "GROUNDED").when(F.col("near").isNotNull(), "V2_CITATION_WRONG_PAGE").otherwise("V2_CITATION_NOT_FOUND")
    return wanted.join(found, "cite_id", "left").select("cite_id", *rest, verdict.alias("verdict"), F.when(~here, F.col("near")).alias("suggested_page"))


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits: a bit of the row is clear where the length grows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        same = row & where.get(ch, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """The best share of common characters, 0 to 100, of the shorter string and a window of the other of its length at most."""
    if not a or not b:
        return 0.0 if a or b else 100.0
    short, long = sorted((a, b), key=len)
    best = 0.0
    for x, y in ((short, long), (long, short))[: 1 + (len(a) == len(b))]:
        n = len(x)
        for end in range(1, len(y) + n):
            window = y[max(0, end - n) : end]
            best = max(best, 200.0 * _common(x, window) / (n + len(window)))
    return best


def _nearest(quote: str, own: list[dict]) -> dict:
    scored = [(partial_ratio(quote, x["text"]), x) for x in own if x["text"]]
    best = max(scored, key=lambda s: s[0], default=(0, None))[1]
    return {"line": best["text"][:HINT_MOST], "page": best["page"]} if best else {"line": "", "page": None}


@F.arrow_udf(T.StructType([T.StructField("line", T.StringType()), T.StructField("page", T.IntegerType())]))
def nearest(quotes: pa.Array, lines: pa.Array) -> pa.Array:
    """The line (page, text) most like a quote, the first of equals: a hint, never part of a verdict. One section's lines are decoded at a time."""
    out = (_nearest(q.as_py(), own.as_py()) for q, own in zip(quotes, lines, strict=True))
    return pa.array(out, pa.struct([("line", pa.string()), ("page", pa.int32())]))


def closest_lines(cites: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """cites (cite_id, keys, quote, first_page) that were not found: (cite_id, closest_match, closest_page) among their section's lines."""
    own = lines.select(*keys, "ord", F.col("page").cast("int").alias("page"), straight(nfkc("line")).alias("text"))
    own = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "page", "text"))).alias("own"))
    best = cites.join(own, keys).select("cite_id", "first_page", nearest(norm("quote"), F.transform("own", lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text")))).alias("best"))
    return best.select("cite_id", F.col("best.line").alias("closest_match"), F.coalesce("best.page", F.col("first_page").cast("int")).alias("closest_page"))


def occurrences(quotes: DataFrame, texts: DataFrame, least: int = QUOTE_LEAST, limit: int = BROADCAST_CHARS) -> DataFrame:
    """(quote_id, page) of every page whose normalised text holds the quote, for quotes of `least` characters or more.

    A quote's longest inner word is one of the page's words. Quotes of `limit` characters in all are sent to the pages: their words
    are cut out and looked up in one pass, and only where a word is met is the text searched, before any shuffle. With more
    quotes the pages' words are shuffled instead, and the pages of the words met join again. Quotes of one or two words have no
    inner word; they are searched for in every page, in blocks of `limit` characters.
    """
    inner = F.filter(F.split("q", " "), lambda w: F.length(w) > 0)
    inner = F.when(F.size(inner) > 2, F.slice(inner, 2, F.size(inner) - 2))
    longest = F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    q = quotes.select("quote_id", norm("quote").alias("q")).where(F.length("q") >= least).withColumn("word", longest)
    size = F.coalesce(F.sum(F.length("q")), F.lit(0))
    worded, short = q.where("word is not null"), q.where("word is null").select("quote_id", "q")
    of_worded, of_short = worded.agg(size).union(short.agg(size)).toPandas().iloc[:, 0]  # two numbers
    t = texts.select("page", norm("text").alias("t"))
    words = F.explode(F.array_distinct(F.split("t", " "))).alias("word")
    if of_worded <= limit:
        met = t.select("page", "t", words).join(F.broadcast(worded), "word")
    else:
        met = worded.join(t.select("page", words), "word").select("quote_id", "q", "page").join(t, "page")
    found = met.where(F.col("t").contains(F.col("q"))).select("quote_id", "page")
    blocks = -(-int(of_short) // limit)
    for i in range(blocks):
        block = short.where(F.pmod(F.xxhash64("quote_id"), F.lit(blocks)) == i)
        found = found.unionByName(t.join(F.broadcast(block), F.col("t").contains(F.col("q"))).select("quote_id", "page"))
    return found


def check_names(fields: DataFrame) -> DataFrame:
    """Fields (name, quote) whose name is not in their normalised quote."""
    return fields.where(~norm("quote").contains(F.col("name")))


def check_rows(fields: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Fields (keys, name, location, required, type_raw) against the table rows among their section's lines.

    OK if any row of that name agrees in both; else ROW_MISMATCH with the first such row; none: ROW_NOT_FOUND. A null
    `required` agrees with F.
    """
    rows = lines.select(*keys, "ord", F.col("page").alias("row_page"), "line", row_tokens(F.col("line")).alias("r")).where("r is not null")
    rows = rows.select(*keys, F.col("r.name").alias("name"), "ord", "row_page", "line", F.col("r.required").alias("row_required"), F.col("r.type").alias("row_type"))
    met = fields.join(rows, [*keys, "name"], "left")
    agrees = (F.coalesce("required", F.lit(False)) == F.col("row_required")) & (F.lower("type_raw") == F.col("row_type"))
    first = F.min_by(F.struct("row_page", "line"), "ord").alias("row")
    per = met.groupBy(*keys, "name", "location", "required", "type_raw").agg(F.coalesce(F.bool_or(agrees), F.lit(False)).alias("ok"), F.count("line").alias("n"), first)
    code = F.when(F.col("n") == 0, "V2_ROW_NOT_FOUND").when(F.col("ok"), "OK").otherwise("V2_ROW_MISMATCH")
    return per.select(*keys, "name", code.alias("code"), F.col("row.line").alias("row"), F.col("row.row_page").alias("row_page"))


def check_enum(fields: DataFrame) -> DataFrame:
    """Fields (enum, quote): enum values that the normalised quote doesn't hold, in `missing`."""
    own = fields.withColumn("__q", norm("quote"))
    return own.withColumn("missing", F.filter("enum", lambda v: ~F.col("__q").contains(v))).where(F.size("missing") > 0).drop("__q")


def content_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `lines`: a section's lines with text (i, text, marker, ends, body), in order.

    `marker` lines are never part of a sample, `ends` lines may follow one; `body` is false for the last line of a page, a footer.
    """
    rows = lines.select(*keys, "ord", "page", straight(nfkc("line")).alias("text")).where("text <> ''")
    order = Window.partitionBy(*keys).orderBy("ord")
    starts = lambda words: F.reduce(F.array(*[F.col("text").startswith(w) for w in words]), F.lit(False), lambda a, x: a | x)
    marker = starts(MARKERS) | F.col("text").rlike(NUMBERED)
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "body": F.coalesce(F.lead("page").over(order) == F.col("page"), F.lit(False)), "marker": marker, "ends": marker | starts(SOFT)})
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "text", "marker", "ends", "body"))).alias("lines"))


def check_verbatim(samples: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, raw) against their section's lines: why a sample is no verbatim copy (null if it is one), and a hint.

    Each line of a sample must be part of a later line of the section than the one before it, none of them a marker; and what
    follows the last one must be a line that may end a block.
    """
    copy = F.filter(F.transform(F.split(nfkc("raw"), "\n"), lambda x: straight(x)), lambda x: x != "")
    both = samples.withColumn("copy", copy).join(content_lines(lines, keys), keys, "left")
    both = both.withColumn("lines", F.coalesce("lines", F.array().cast(both.schema["lines"].dataType)))
    walk = """aggregate(copy, named_struct('at', 0, 'why', cast(null as string), 'hint', cast(null as string)), (a, w) -> if(a.why is not null, a,
        transform(array(get(filter(lines, x -> x.i >= a.at and contains(x.text, w)), 0)), x -> named_struct('at', coalesce(x.i + 1, a.at),
        'why', case when x is null then 'not a verbatim copy' when x.marker then 'runs past the end of its block' end, 'hint', case when x is null then w when x.marker then x.text end))[0]))"""
    both = both.withColumn("walk", F.expr(walk))
    then = F.expr("get(filter(lines, x -> x.i >= walk.at and x.body), 0)")
    open_end = F.col("walk.why").isNull() & (F.size("copy") > 0) & ~F.coalesce(F.col("then.ends"), F.lit(True))
    both = both.withColumn("then", then)
    why = F.when(open_end, "is an incomplete copy").otherwise(F.col("walk.why"))
    hint = F.left(F.when(open_end, F.col("then.text")).otherwise(F.col("walk.hint")), F.lit(HINT_MOST))
    return both.select(*samples.columns, why.alias("why"), hint.alias("first_unmatched"))


def check_endpoints(contracts: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Endpoint contracts (keys, method, path) against the hints of their sections; null hints are skipped."""
    both = contracts.select(*keys, "method", "path").join(sections.select(*keys, "method_hint", "path_hint"), keys)
    wrong = F.array_compact(F.array(
        F.when(F.upper("method_hint") != F.coalesce(F.upper("method"), F.lit("")), F.lit("V4_METHOD_MISMATCH")),
        F.when(norm_path(F.col("path_hint")) != norm_path(F.coalesce("path", F.lit(""))), F.lit("V4_PATH_MISMATCH")),
    ))
    return both.select(*keys, F.explode(wrong).alias("code"))


def detected_rows(lines: DataFrame, keys: list[str], opens: str = TABLE_OPENS, closes: str = TABLE_CLOSES) -> DataFrame:
    """(keys, name, ord) of table rows inside parameter tables, in order of first sight."""
    text = straight(nfkc("line"))
    marked = lines.withColumn("mark", F.when(text.rlike(opens), F.lit(True)).when(text.rlike(closes), F.lit(False)))
    inside = F.last("mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("inside", inside).where("inside and mark is null").select(*keys, "ord", row_tokens(F.col("line"))["name"].alias("name")).where("name is not null")
    return rows.groupBy(*keys, "name").agg(F.min("ord").alias("ord"))


def coverage_gaps(detected: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Detected keys that no field covers."""
    return detected.join(fields.select(*keys).distinct(), keys, "left_anti")


def ordered_issues(issues: DataFrame, rules: tuple | list = RULES) -> DataFrame:
    """Issues in the order of rules, then field, code and message."""
    place = F.array_position(F.array(*map(F.lit, rules)), F.col("code"))
    return issues.withColumn("rule", place).orderBy("rule", F.coalesce("field", F.lit("")), "code", "message")
