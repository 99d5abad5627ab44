"""Pages, lines, headings and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, path_hint

#: Leaders of a table of contents, headings, and the two hint lines of a section.
LEADER = r"\.{5,}\s*\d+\s*$"
HEADING = r"^(\d{1,2})\.(\d{1,2})\s+([A-Z][^\n]{1,80}?)\s*$"
METHOD = r"Method\s*:\s*([A-Z]+)"
REQUEST_URL = r"Request\s+URL\s*:\s*(\S+)"
TOC_LINES = 5


def clean_page(raw: Column) -> Column:
    """LF line ends, no space at line ends, no blank lines at the end, no common left margin.

    Regular expressions over the whole page: its length, not that times its lines. A lambda over lines that used the margin
    would compute it for each of them.
    """
    text = F.regexp_replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), r"(?<!\s)\s++\z", "")
    text = F.regexp_replace(text, r"(?<![^\S\n])[^\S\n]++(?=\n)", "")
    indents = F.regexp_extract_all(text, F.lit(r"(?dm)^( *)[^ \n]"), F.lit(1))
    margin = F.coalesce(F.array_min(F.transform(indents, lambda x: F.length(x))), F.lit(0))
    return F.regexp_replace(text, F.concat(F.lit("(?dm)^ {"), margin.cast("string"), F.lit("}")), F.lit(""))


def explode_lines(pages: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """A row a line, numbered from 0 in its page."""
    return pages.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def is_toc(text: Column, least: int = TOC_LINES, leader: str = LEADER) -> Column:
    """Whether at least `least` lines end in dotted leaders and a number."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(leader))) >= least


def heading(line: Column) -> Column:
    """(chapter, number, title) of a heading line, else null: indent of 12 at most, white space collapsed."""
    flat = F.trim(F.regexp_replace(line, r"\s+", " "))
    found = F.struct(F.regexp_extract(flat, HEADING, 1).try_cast("int").alias("chapter"), F.regexp_extract(flat, HEADING, 2).try_cast("int").alias("number"), F.regexp_extract(flat, HEADING, 3).alias("title"))
    return F.when((F.length(line) - F.length(F.ltrim(line)) <= 12) & flat.rlike(HEADING), found)


def increasing(rows: DataFrame, key: Column, within: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is above every key before it in their partition: a running maximum."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(key).over(before)
    return rows.withColumn("__best", best).where(F.col("__best").isNull() | (key > F.col("__best"))).drop("__best")


def fill_forward(value: Column, within: list[str], order: list[str]) -> Column:
    """The last non-null value up to a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def filled(rows: DataFrame, value: Column, name: str, within: list[str], key: str, width: int = 1 << 16) -> DataFrame:
    """rows with `name`: the last non-null value up to a row by its whole-number key, for partitions of any size.

    Each partition is cut into ranges of `width` keys. A range is filled by itself; what it inherits is the last value of the ranges
    before it, found among one row a range.
    """
    rows = rows.withColumns({"__v": value, "__b": F.floor(F.col(key) / width)})
    last = rows.where("__v is not null").groupBy(*within, "__b").agg(F.max_by("__v", key).alias("__own"))
    every = rows.select(*within, "__b").distinct().join(last, [*within, "__b"], "left")
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*within, "__b", F.last("__own", ignorenulls=True).over(before).alias("__carried"))
    own = rows.withColumn("__in", fill_forward(F.col("__v"), [*within, "__b"], [key]))
    return own.join(carried, [*within, "__b"]).withColumn(name, F.coalesce("__in", "__carried")).drop("__v", "__b", "__in", "__carried")


def numbered(rows: DataFrame, name: str, within: list[str], first: list[str], key: str, width: int = 1 << 16) -> DataFrame:
    """rows with `name`: their number from 1 in their partition by the columns `first`, then by a whole-number key.

    As in `filled`, a partition is cut into ranges: a row's number is its place in its range and the rows of the ranges before.
    """
    rows = rows.withColumn("__b", F.floor(F.col(key) / width))
    own = [*within, *first, "__b"]
    before = Window.partitionBy(*within).orderBy(*first, "__b").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy(*own).agg(F.count("*").alias("__n")).select(*own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    at = F.row_number().over(Window.partitionBy(*own).orderBy(key))
    return rows.withColumn("__r", at).join(start, own).withColumn(name, F.col("__s") + F.col("__r")).drop("__b", "__s", "__r")


def kind_of(title: Column, text: Column) -> Column:
    return F.when(text.rlike(REQUEST_URL), "endpoint").when(title.contains("Schema"), "schema").otherwise("overview")


def sections(lines: DataFrame) -> DataFrame:
    """Sections of a document's lines (doc, page, line_no, line, toc).

    Contents pages and leader lines hold no headings; a heading opens a section if its (chapter, number) is above all before.
    """
    lines = lines.withColumn("ord", F.struct("page", "line_no"))
    head = F.when(~F.col("toc") & ~F.col("line").rlike(LEADER), heading(F.col("line")))
    lines = lines.withColumn("head", head)
    before = Window.partitionBy("doc").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct("head.chapter", "head.number")
    best = F.max(F.when(F.col("head").isNotNull(), rank)).over(before)
    lines = lines.withColumn("best", best)
    opens = F.col("head").isNotNull() & (F.col("best").isNull() | (rank > F.col("best")))
    lines = lines.withColumn("open", F.when(opens, F.struct("head.chapter", "head.number", "head.title", "page")))
    lines = lines.withColumn("at", fill_forward(F.col("open"), ["doc"], ["page", "line_no"])).where("at is not null")
    body = F.array_sort(F.collect_list(F.struct("page", "line_no", "line")))
    out = lines.groupBy("doc", "at").agg(body.alias("body"), F.max(F.when(F.trim("line") != "", F.col("page"))).alias("page_end"))
    text = F.array_join(F.transform("body", lambda x: x["line"]), "\n")
    out = out.withColumn("text", text)
    return out.select(
        "doc", F.concat(F.lit("S-"), F.col("at.chapter"), F.lit("."), F.col("at.number")).alias("section_id"),
        F.col("at.chapter").alias("chapter"), F.col("at.number").alias("number"), F.col("at.title").alias("title"),
        kind_of(F.col("at.title"), F.col("text")).alias("kind"), F.col("at.page").alias("page_start"), "page_end",
        F.nullif(F.regexp_extract("text", METHOD, 1), F.lit("")).alias("method_hint"),
        path_hint(F.nullif(F.regexp_extract("text", REQUEST_URL, 1), F.lit(""))).alias("path_hint"),
        F.sha2(norm(F.col("text")).cast("binary"), 256).alias("text_sha256"),
    )
