"""Quality rules: a threshold table compiled into one projection, without user functions.

Counts: words are runs of characters other than 0x20 and 0x09-0x0D. A null or empty text has no words, fails the base
rule and is not kept. Repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is was for it with as his on be at by this had not are but from or have an they which one "
    "le la les de des du et un une que qui dans en par pour sur avec est au aux ne pas "
    "der die das und den von zu mit sich dem nicht ein eine auf ist im es an "
    "el los las y del se por con para una su al lo como"
).split()

#: (measure, least, most): a row fails when the measure is null-safe below `least` or above `most`.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, 10_000_000),
    ("mean_word", 1.5, 20.0),
    ("symbol_ratio", None, 0.3),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("long_line_ratio", None, 0.9),
)


def counts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The base counts of every row, plus stop words and lines. Each step reads arrays made by the step before."""
    step = df.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    step = step.select(
        "doc_id",
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    step = step.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.length(x) > 4000)).cast("long").alias("n_long_lines"),
        F.size(F.filter("w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h1"),
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_long_lines", "n_stop"]

    def doubled(source: str, by: int) -> Column:
        return F.transform(source, lambda x, i: F.xxhash64(x, F.get(F.col(source), i + by)))

    step = step.select(*kept, doubled("h1", 1).alias("h2"))
    step = step.select(*kept, doubled("h2", 2).alias("h4"))
    step = step.select(*kept, doubled("h4", 4).alias("all8"))
    step = step.select(*kept, F.slice("all8", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")).alias("h8"))
    step = step.withColumn("again", F.size(F.array_distinct("h8")) < F.size("h8"))
    step = step.select(*kept, F.when(F.col("again"), F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    twice = F.filter("s", lambda x, j: F.get(F.col("s"), j - 1)["h"].eqNullSafe(x["h"]) | F.get(F.col("s"), j + 1)["h"].eqNullSafe(x["h"]))
    step = step.select(*kept, F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "at", start,
        lambda a, i: F.struct((a["n"] + (i + WINDOW - F.greatest(i, a["end"])).cast("long")).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    # the zero is no constant to the optimiser: a later filter on this count is not pushed down with all the steps in it
    zero = (F.spark_partition_id() * 0).cast("long")
    return step.select(*kept, (F.coalesce(covered, F.lit(0).cast("long")) + zero).alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_ratio": F.col("n_stop") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "long_line_ratio": F.col("n_long_lines") / lines,
    }


def verdict(table: tuple = THRESHOLDS) -> Column:
    """The threshold table as one Boolean expression."""
    by, ok = measures(), F.lit(True)
    for name, least, most in table:
        if least is not None:
            ok = ok & (by[name] >= least)
        if most is not None:
            ok = ok & (by[name] <= most)
    return ok


def quality(df: DataFrame, doc: str = "doc_id", text: str = "text", table: tuple = THRESHOLDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the ratios behind the verdict, one row per input row."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts(df, doc, text).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(table)).alias("kept"), "n_lines", "n_stop",
    )
