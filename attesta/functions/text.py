"""Text normalisation, table-row tokens and URL paths, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that Unicode text processing counts as white space beyond a regular expression's \\s.
SPACES = (0x0B, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = r"[\s" + "".join(map(chr, SPACES)) + "]+"
#: Curly quotes and their straight forms.
QUOTES = ("".join(map(chr, (0x201C, 0x201D, 0x2018, 0x2019))), "\"\"''")
#: The type words of parameter tables.
TYPE_WORDS = ("string", "integer", "int", "long", "number", "float", "double", "boolean", "bool", "object", "file", "array")
TYPE_WORD = r"(?i)^(" + "|".join(TYPE_WORDS) + r"|array\[[a-z]+\])$"
#: Fixed value: a row of a parameter table, its name, T or F, and type two spaces apart.
ROW = r"^\s*([A-Za-z_][\w.\[\]]*)\s{2,}(T|F)\s{2,}([A-Za-z][\w\[\]]*)"


def straight(col: Column) -> Column:
    """Straight quotes, runs of white space as one space, trimmed: `norm` without NFKC, for use inside a lambda."""
    return F.trim(F.regexp_replace(F.translate(col, *QUOTES), WHITE, " "))


def _straight_ascii(col: Column) -> Column:
    """`straight` for ASCII text; a single space is no match, so most of a text is left in place."""
    return F.trim(F.regexp_replace(col, r"[\t-\r\x1c-\x1f][\t-\r\x1c-\x20]*| [\t-\r\x1c-\x20]+", " "))


def norm_py(text: str) -> str:
    """The fixpoint of NFKC, straight quotes and collapsed white space."""
    while True:
        out = unicodedata.normalize("NFKC", text)
        for curly, plain in zip(*QUOTES, strict=True):
            out = out.replace(curly, plain)
        out = " ".join(out.split())
        if out == text:
            return out
        text = out


def _wide_apart(col: Column, plain: Column, wide: Column) -> Column:
    """ASCII texts, which NFKC leaves as they are, take the plain step. The wide one is never called with null."""
    return F.when(col.isNull(), F.lit(None).cast("string")).when(F.octet_length(col) == F.length(col), plain).otherwise(wide)


def _nfkc_wide(col: Column) -> Column:
    """NFKC by the ICU library that Spark ships for its collations, in the JVM: no Python worker holds a batch of texts.

    Spark takes `reflect` for nondeterministic, so that it stays where it is written and runs once a row; keep it out of join
    conditions and aggregate functions.
    """
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))


def norm(col: Column | str) -> Column:
    """NFKC, straight quotes, runs of white space as one space, trimmed; not for use inside a lambda (see `straight`)."""
    col = F.col(col) if isinstance(col, str) else col
    return _wide_apart(col, _straight_ascii(col), straight(_nfkc_wide(col)))


def nfkc(col: Column | str) -> Column:
    """NFKC alone, so that `straight` gives the rest inside a lambda."""
    col = F.col(col) if isinstance(col, str) else col
    return _wide_apart(col, col, _nfkc_wide(col))


def row_tokens(line: Column) -> Column:
    """A table row's (name, required, type), or null; a description word in the place of the type makes it no row."""
    kind = F.regexp_extract(line, ROW, 3)
    found = F.struct(F.regexp_extract(line, ROW, 1).alias("name"), (F.regexp_extract(line, ROW, 2) == "T").alias("required"), F.lower(kind).alias("type"))
    return F.when(kind.rlike(TYPE_WORD), found)


def path_hint(raw: Column) -> Column:
    """A request URL's path: cut at ?, no closing /, one leading /; null without any /."""
    cut = F.regexp_replace(F.split_part(F.trim(raw), F.lit("?"), F.lit(1)), "/+$", "")
    return F.when(cut.contains("/"), F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut)))


def norm_path(path: Column) -> Column:
    """A path with every :name and {name} as {}."""
    cut = F.regexp_replace(F.split_part(F.trim(path), F.lit("?"), F.lit(1)), "/+$", "")
    cut = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))
    return F.regexp_replace(F.regexp_replace(cut, r":[A-Za-z_]\w*", "{}"), r"\{[^}]*\}", "{}")


def template_path(path: Column) -> Column:
    """A path with :name as {name}."""
    return F.regexp_replace(path, r":([A-Za-z_]\w*)", r"{$1}")


def snippet(line: Column, size: int = 160) -> Column:
    return F.substring(F.trim(line), 1, size)


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
