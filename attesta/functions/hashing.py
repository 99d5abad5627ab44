"""Content hashes, canonical evidence and finding ids."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what parts a finding id's text.
PIPE = "|"


def sha256_text(col: Column | str) -> Column:
    return F.sha2((F.col(col) if isinstance(col, str) else col).cast("binary"), 256)


def json_string(col: Column) -> Column:
    """A JSON string literal, or null as the JSON null; non-ASCII stays as it is."""
    out = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def canonical_evidence(ev: Column) -> Column:
    """An evidence struct as JSON with sorted keys, nulls kept, and ", " and ": " between."""
    number = lambda c: F.coalesce(ev[c].cast("string"), F.lit("null"))
    parts = [("file", json_string(ev["file"])), ("kind", json_string(ev["kind"])), ("line", number("line")), ("page", number("page")), ("quote", json_string(ev["quote"])), ("snippet", json_string(ev["snippet"]))]
    inside = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts])
    return F.concat(F.lit("{"), inside, F.lit("}"))


def finding_id(kind: Column, section: Column, field: Column, evidence: Column) -> Column:
    """F- and eight hex digits of the hash of type, section, field and the sorted canonical evidence."""
    joined = F.array_join(F.array_sort(evidence), PIPE)
    return F.concat(F.lit("F-"), F.substring(sha256_text(F.concat_ws(PIPE, kind, section, F.coalesce(field, F.lit("")), joined)), 1, 8))
