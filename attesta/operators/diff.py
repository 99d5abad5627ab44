"""Comparing a verified contract with another specification and with client code."""

from __future__ import annotations

import ast
import contextlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canonical_evidence, finding_id
from ..functions.text import norm_path

#: The contract types of Spark's and Python's types.
SPARK_TYPES = {"string": "string", "bigint": "integer", "int": "integer", "smallint": "integer", "double": "number", "float": "number", "boolean": "boolean", "timestamp": "string", "date": "string"}
VERBS = ("get", "post", "put", "patch", "delete")
#: The severities of differences from another specification, and what an API path starts with.
SEVERITY = {
    "MISSING_ENDPOINT": "medium",
    "MISSING_FIELD": "low",
    "EXTRA_FIELD": "info",
    "REQUIRED_MISMATCH": "medium",
    "TYPE_MISMATCH": "medium",
    "ENUM_MISMATCH": "medium",
}
API = r"^/?api/v\d+/"
JSON_PATH = r"^data(\[\*\])*$"


def missing(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ours that theirs lacks (one direction)."""
    return ours.join(theirs.select(*keys).distinct(), keys, "left_anti")


def property_diff(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Differences of properties (key..., type, required, enum): a row for each, over the keys of both sides.

    A key that one side lacks gives MISSING_FIELD or EXTRA_FIELD only; else required, type (both known) and enum are compared.
    """
    a = ours.select(*key, F.lit(True).alias("in_a"), F.col("type").alias("ta"), F.col("required").alias("ra"), F.col("enum").alias("ea"))
    b = theirs.select(*key, F.lit(True).alias("in_b"), F.col("type").alias("tb"), F.col("required").alias("rb"), F.col("enum").alias("eb"))
    both = a.join(b, key, "full_outer")
    known = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    lost, more = F.array_except("ea", "eb"), F.array_except("eb", "ea")
    codes = F.array_compact(F.array(
        F.when(F.col("in_b").isNull(), F.lit("MISSING_FIELD")),
        F.when(F.col("in_a").isNull(), F.lit("EXTRA_FIELD")),
        F.when(known & ~F.col("ra").eqNullSafe(F.col("rb")), F.lit("REQUIRED_MISMATCH")),
        F.when(known & (F.col("ta") != F.col("tb")), F.lit("TYPE_MISMATCH")),
        F.when(known & ((F.size(lost) > 0) | (F.size(more) > 0)), F.lit("ENUM_MISMATCH")),
    ))
    return both.select(*key, F.explode(codes).alias("code"), F.array_join(F.array_sort(lost), ",").alias("missing"), F.array_join(F.array_sort(more), ",").alias("extra"))


def evidence(kind: str, page: Column | None = None, quote: Column | None = None, file: Column | None = None, line: Column | None = None, snippet: Column | None = None) -> Column:
    """A place in a document or in a file, as canonical text."""
    own = {"page": (page, "long"), "quote": (quote, "string"), "file": (file, "string"), "line": (line, "long"), "snippet": (snippet, "string")}
    return canonical_evidence(F.struct(F.lit(kind).alias("kind"), *[(F.lit(None) if c is None else c).cast(t).alias(k) for k, (c, t) in own.items()]))


def as_findings(rows: DataFrame, type_: Column, severity: Column, section: Column, field: Column, *places: Column) -> DataFrame:
    """Rows as findings (id, type, severity, section_id, field, evidence), each once; null places are left out."""
    shown = F.array_sort(F.array_compact(F.array(*places)))
    out = rows.select(type_.alias("type"), severity.alias("severity"), section.alias("section_id"), field.alias("field"), shown.alias("evidence"))
    return out.withColumn("id", finding_id(F.col("type"), F.col("section_id"), F.col("field"), F.col("evidence"))).dropDuplicates(["id"])


def specification_findings(ours: DataFrame, theirs: DataFrame, label: str) -> DataFrame:
    """Operations of ours (export.read_operations) against those of another specification, whose file is `label`.

    Operations meet by method and normalised path; one that they lack is a finding, of others the request bodies' properties are
    compared. Each difference has our citation, where there is one, and the pointer and line in their file.
    """
    at = [F.col("method"), norm_path(F.col("path")).alias("key")]
    a = ours.select(*at, F.coalesce("section_id", F.lit("?")).alias("section_id"), "cite_page", "cite_quote", "props")
    b = theirs.select(*at, "pointer", F.col("props").alias("others"))
    root = theirs.agg(F.max("line").alias("root"))
    lost = a.join(b, ["method", "key"], "left_anti").join(F.broadcast(root))  # one row
    gone = as_findings(
        lost, F.lit("COMMUNITY_MISSING_ENDPOINT"), F.lit(SEVERITY["MISSING_ENDPOINT"]), F.col("section_id"), F.lit(None).cast("string"),
        evidence("code", file=F.lit(label), line=F.col("root"), snippet=F.lit("#/paths")), F.when(F.col("cite_quote").isNotNull(), evidence("doc", F.col("cite_page"), F.col("cite_quote"))),
    )
    both = a.join(b, ["method", "key"]).where("size(props) + size(others) > 0")
    keys = ["method", "key", "section_id", "pointer"]
    mine = both.select(*keys, F.explode("props").alias("p")).select(*keys, "p.name", "p.type", "p.required", "p.enum", "p.page", "p.quote")
    other = both.select(*keys, F.explode("others").alias("p")).select(*keys, "p.*")
    known = [*keys, "name"]
    changed = property_diff(mine, other, known)
    changed = changed.join(mine.select(*known, F.col("page").alias("p"), F.col("quote").alias("q")), known, "left").join(other.select(*known, "at", "at_line", "type_line", "enum_line"), known, "left")
    lists = both.select(*keys, F.get("others", F.lit(0)).alias("o")).select(*keys, "o.list_line", "o.required_line").distinct()
    changed = changed.join(lists, keys, "left")
    code = F.col("code")
    pointer = F.when(code == "MISSING_FIELD", F.concat("pointer", F.lit("/properties"))).when(code == "EXTRA_FIELD", F.col("at")).when(code == "REQUIRED_MISMATCH", F.concat("pointer", F.lit("/required")))
    pointer = pointer.when(code == "TYPE_MISMATCH", F.concat("at", F.lit("/type"))).otherwise(F.concat("at", F.lit("/enum")))
    line = F.when(code == "MISSING_FIELD", F.col("list_line")).when(code == "EXTRA_FIELD", F.col("at_line")).when(code == "REQUIRED_MISMATCH", F.col("required_line")).when(code == "TYPE_MISMATCH", F.col("type_line")).otherwise(F.col("enum_line"))
    severity = F.element_at(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]), code)
    differ = as_findings(
        changed, F.concat(F.lit("COMMUNITY_"), code), severity, F.col("section_id"), F.col("name"),
        evidence("code", file=F.lit(label), line=line, snippet=pointer), F.when((code != "EXTRA_FIELD") & F.col("q").isNotNull(), evidence("doc", F.col("p"), F.col("q"))),
    )
    return gone.unionByName(differ)


def check_inventory(refs: DataFrame, documented: DataFrame) -> DataFrame:
    """Client calls (path, method) against documented ones (path, method, section_id).

    An unknown path is UNDOCUMENTED; a known path with another method is METHOD_MISMATCH, with its least section.
    """
    per = documented.groupBy("path").agg(F.collect_set("method").alias("methods"), F.min("section_id").alias("section_id"))
    both = refs.join(per, "path", "left")
    code = F.when(F.col("methods").isNull(), "CLIENT_UNDOCUMENTED_ENDPOINT").when((F.col("method") != "UNKNOWN") & ~F.array_contains("methods", F.col("method")), "CLIENT_METHOD_MISMATCH")
    return both.withColumn("code", code).where("code is not null").drop("methods")


def inventory_findings(refs: DataFrame, documented: DataFrame, label: str) -> DataFrame:
    """Findings about calls (file, line, method, path, dynamic) against documented operations (path, method, section_id, page, quote).

    Paths meet in normalised form; calls whose path is built at run time are left to `uncheckable`.
    """
    known = documented.withColumn("path", norm_path(F.col("path")))
    calls = refs.where(~F.col("dynamic") & (F.col("path") != "")).withColumn("path", norm_path(F.col("path")))
    wrong = check_inventory(calls, known)
    cites = known.groupBy("path", "section_id").agg(F.min(F.struct("page", "quote")).alias("cite"))
    wrong = wrong.join(cites, ["path", "section_id"], "left")
    other = F.col("code") == "CLIENT_METHOD_MISMATCH"
    code = evidence("code", file=F.concat(F.lit(f"{label}/"), "file"), line=F.col("line"), snippet=F.concat_ws(" ", "method", "path"))
    doc = F.when(other & F.col("cite").isNotNull(), evidence("doc", F.col("cite.page"), F.col("cite.quote")))
    return as_findings(wrong, F.col("code"), F.when(other, "high").otherwise("medium"), F.when(other, F.col("section_id")).otherwise("-"), F.col("path"), code, doc)


def conform(*parts: DataFrame) -> DataFrame:
    """The findings of all parts, each once, in the order of their ids."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"]).orderBy("id")


def uncheckable(refs: DataFrame) -> DataFrame:
    """Calls whose path is built at run time."""
    return refs.where(F.col("dynamic") | (F.col("path") == ""))


def schema_types(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(name, contract type, required) of a DataFrame's columns."""
    return [(f.name, SPARK_TYPES.get(f.dataType.simpleString(), "array" if isinstance(f.dataType, T.ArrayType) else "unknown"), not f.nullable) for f in df.schema]


def doc_fields(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, type, page, quote) of the documented response fields of the first level, without "data."; of one name the first counts."""
    bare = F.regexp_replace("name", r"^data\.", "")
    rows = fields.where("location = 'response'").select(*keys, bare.alias("key"), F.struct("name", "n").alias("at"), F.struct("type", "page", "quote").alias("f")).where(~F.col("key").rlike(r"[.\[]"))
    return rows.groupBy(*keys, "key").agg(F.min_by("f", "at").alias("f")).select(*keys, "key", "f.*")


def model_diff(documented: DataFrame, model: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Model fields (keys, key, type, required) against documented response fields (keys, key, type); an unknown type on either side differs from none."""
    on = [*(keys or []), "key"]
    docs = documented.withColumnRenamed("type", "doc_type")
    both = model.join(docs, on, "left")
    unlike = (F.col("type") != "unknown") & (F.col("doc_type") != "unknown") & (F.col("type") != F.col("doc_type"))
    code = F.when(F.col("doc_type").isNull() & F.col("required"), "CLIENT_REQUIRES_UNDOCUMENTED_FIELD").when(unlike, "CLIENT_TYPE_MISMATCH")
    return both.withColumn("code", code).where("code is not null")


def model_findings(mapped: DataFrame, models: DataFrame, documented: DataFrame, label: str) -> DataFrame:
    """Findings about the mapped models (section_id, file, line, class_name): their fields against their sections' documented ones."""
    fields = mapped.select("section_id", "file", F.col("line").alias("at"), "class_name").join(models.select("file", "class_name", "key", "type", "required"), ["file", "class_name"])
    differ = model_diff(documented.select("section_id", "key", "type", "page", "quote"), fields, ["section_id"])
    high = F.when(F.col("code") == "CLIENT_TYPE_MISMATCH", "medium").otherwise("high")
    code = evidence("code", file=F.concat(F.lit(f"{label}/"), "file"), line=F.col("at"), snippet=F.concat(F.lit("class "), "class_name"))
    return as_findings(differ, F.col("code"), high, F.col("section_id"), F.col("key"), code, F.when(F.col("code") == "CLIENT_TYPE_MISMATCH", evidence("doc", F.col("page"), F.col("quote"))))


def mapping_status(rows: DataFrame, trusted: Column, known: Column) -> DataFrame:
    """Model mappings (section_id, json_path): valid, or the first reason against them."""
    why = F.when(~known, "unknown section").when(~trusted, "section is not verified").when(~F.col("json_path").rlike(JSON_PATH), "bad path").otherwise("valid")
    return rows.withColumn("verdict", why)


def check_mappings(mappings: DataFrame, verified: DataFrame, files: DataFrame) -> DataFrame:
    """Mappings (section_id, model, json_path, file, line) with class_name and why one can't be trusted (null if it can).

    The section must be verified, the path one of the data, the file one of `files` (file, source), the line that of the class.
    """
    named = mappings.withColumn("class_name", F.element_at(F.split("model", r"\."), -1))
    good = verified.select("section_id").distinct().withColumn("ok", F.lit(True))
    both = named.join(good, "section_id", "left").join(files.select("file", "source"), "file", "left")
    line = F.coalesce(F.when(F.col("line") > 0, F.get(F.split("source", r"\r\n|\r|\n"), F.col("line") - 1)), F.lit(""))
    found = F.regexp_like(line, F.concat(F.lit(r"\bclass "), F.col("class_name"), F.lit(r"\b")))
    why = F.when(F.col("ok").isNull(), "section is not verified").when(~F.col("json_path").rlike(JSON_PATH), "bad path").when(F.col("source").isNull(), "no such file").when(~found, "the line is not the class's")
    return both.select(*mappings.columns, "class_name", why.alias("why"))


def summary_of(message: Column) -> Column:
    """The lines of a validation error from the one that says so, seven of them at most, on one line of 600 characters at most."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.coalesce(F.nullif(F.array_position(F.transform(lines, lambda x: x.contains("validation error")), F.lit(True)), F.lit(0)), F.lit(1))
    return F.left(F.array_join(F.slice(lines, at.cast("int"), F.lit(7)), " | "), F.lit(600))


class Package:
    """The modules of a client package, read as syntax trees and never run: path constants and helpers may be in any of them."""

    def __init__(self, sources: dict[str, str], api: str):
        self.api, self.sources = re.compile(api), sources
        self.inner = re.compile(api.removeprefix("^"))
        self.trees = {}
        for file in sorted(sources):
            with contextlib.suppress(SyntaxError):
                self.trees[file] = ast.parse(sources[file])
        self.constants: dict[str, tuple[str, str, int]] = {}
        self.helpers: dict[str, tuple[int, str | None]] = {}
        for file, tree in self.trees.items():
            for node in tree.body:
                if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and self._is_path(node.value):
                    self.constants.setdefault(node.targets[0].id, (node.value.value, file, node.lineno))
            self.helpers |= {f.name: h for f in ast.walk(tree) if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and (h := self._helper(f))}

    def _is_path(self, node: ast.AST) -> bool:
        return isinstance(node, ast.Constant) and isinstance(node.value, str) and bool(self.api.match(node.value))

    @staticmethod
    def _helper(f: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[int, str | None] | None:
        """(place of the `method` parameter in a call, its default) of a function that has one."""
        names = [a.arg for a in f.args.args]
        if "method" not in names:
            return None
        at = names.index("method")
        defaults = dict(zip(reversed(names), reversed(f.args.defaults), strict=False))
        value = getattr(defaults.get("method"), "value", None)
        return at - (names[0] in ("self", "cls")), value.upper() if isinstance(value, str) else None

    def _path(self, expr: ast.AST, local: dict[str, tuple[str, bool]]) -> tuple[str, bool] | None:
        """(path, dynamic) of the first literal, f-string, constant or local variable in an expression that is an API path."""
        for node in ast.walk(expr):
            if self._is_path(node):
                return node.value, False
            if isinstance(node, ast.JoinedStr):
                named = [self.constants.get(getattr(p.value, "id", None), ("{}",))[0] if isinstance(p, ast.FormattedValue) else str(p.value) for p in node.values]
                if found := self.inner.search("".join(named)):
                    path = "".join(named)[found.start() :]
                    return path, bool(re.search(r"[^/]\{\}|\{\}[^/]", path))
            if isinstance(node, ast.Name):
                if node.id in self.constants:
                    return self.constants[node.id][0], False
                if node.id in local:
                    return local[node.id]
        return None

    def _method(self, call: ast.Call, name: str) -> str:
        if isinstance(call.func, ast.Attribute) and name in VERBS:
            return name.upper()
        said = [a.value.upper() for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str) and a.value.lower() in VERBS]
        if name in self.helpers:
            at, default = self.helpers[name]
            for key in call.keywords:
                if key.arg == "method" and isinstance(key.value, ast.Constant):
                    return str(key.value.value).upper()
            own = getattr(call.args[at], "value", None) if at < len(call.args) else None
            if isinstance(own, str) and own.lower() in VERBS:
                return own.upper()
            if default:
                return default
        return said[0] if said else "UNKNOWN"

    def calls(self) -> Iterator[tuple[str, str, str, int, bool]]:
        """(file, method, path, line, dynamic) of the calls, then of the constants no call uses, at their first use."""
        used = set()
        for file, tree in self.trees.items():
            scope: dict[ast.AST, dict] = {}
            for f in ast.walk(tree):
                if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                    inside = list(ast.walk(f))
                    single = [n for n in inside if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name)]
                    local = {n.targets[0].id: p for n in single if (p := self._path(n.value, {}))}
                    scope |= {n: local for n in inside if isinstance(n, ast.Call)}
            for call in ast.walk(tree):
                name = getattr(getattr(call, "func", None), "attr", None) or getattr(getattr(call, "func", None), "id", "")
                if not isinstance(call, ast.Call) or name not in self.helpers and not (isinstance(call.func, ast.Attribute) and name in (*VERBS, "request")):
                    continue
                for arg in [*call.args, *(k.value for k in call.keywords)]:
                    found = self._path(arg, scope.get(call, {}))
                    built = any(isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add) or isinstance(n, ast.Call) and getattr(n.func, "attr", getattr(n.func, "id", "")) == "join" for n in ast.walk(arg))
                    if found or built:
                        path, dynamic = found or ("", True)
                        used.add(path)
                        yield file, self._method(call, name), path, call.lineno, dynamic
                        break
        for name, (path, file, line) in sorted(self.constants.items()):
            if not any(u == path or u.startswith(path + "{}") for u in used):
                loads = [(f, n.lineno) for f, tree in self.trees.items() for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id == name and isinstance(n.ctx, ast.Load)]
                where, at = min(loads) if loads else (file, line)
                yield where, "UNKNOWN", path, at, False

    def models(self) -> Iterator[tuple[str, str, int, str, str, bool, list[str] | None]]:
        """(file, class, line, key, type, required, enum) of the annotated fields of classes with a base, whose key an alias may be."""
        classes = {c.name: c for tree in self.trees.values() for c in ast.walk(tree) if isinstance(c, ast.ClassDef)}
        for file, tree in self.trees.items():
            for c in ast.walk(tree):
                if not (isinstance(c, ast.ClassDef) and c.bases) or _enum_of(c, classes):
                    continue
                for f in c.body:
                    if not (isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name)) or "ClassVar" in ast.unparse(f.annotation):
                        continue
                    kind, values = annotation_type(f.annotation, classes)
                    given = f.value
                    named = {k.arg: k.value for k in given.keywords} if isinstance(given, ast.Call) else {}
                    first = given.args[0] if isinstance(given, ast.Call) and given.args else named.get("default", named.get("default_factory")) if isinstance(given, ast.Call) else given
                    key = getattr(named.get("alias"), "value", None) or f.target.id
                    yield file, c.name, c.lineno, key, kind, first is None or getattr(first, "value", None) is ..., values


def _enum_of(c: ast.ClassDef, classes: dict[str, ast.ClassDef]) -> tuple[bool, list[str]] | None:
    """(of texts, values) of an enumeration class."""
    bases = [ast.unparse(b).rpartition(".")[2] for b in c.bases]
    if not any("Enum" in b for b in bases):
        return None
    values = [str(n.value.value) for n in c.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant)]
    return "str" in bases or "StrEnum" in bases, values


#: The contract types of Python's names in annotations.
PYTHON_TYPES = {"bool": "boolean", "int": "integer", "float": "number", "str": "string", "dict": "object", "list": "array", "tuple": "array", "set": "array", "Dict": "object", "List": "array", "Tuple": "array", "Set": "array"}


def annotation_type(node: ast.expr, classes: dict[str, ast.ClassDef] | None = None) -> tuple[str, list[str] | None]:
    """(contract type, enumeration) of an annotation; None beside one type is left out, of several types none is known."""
    classes = classes or {}
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        node = ast.parse(node.value, mode="eval").body
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _one_of([node.left, node.right], classes)
    if isinstance(node, ast.Subscript):
        name = ast.unparse(node.value).rpartition(".")[2]
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        if name == "Literal":
            values = [getattr(v, "value", None) for v in inner]
            return "string" if all(isinstance(v, str) for v in values) else "unknown", [str(v) for v in values]
        if name in ("Optional", "Union"):
            return _one_of(inner, classes)
        return annotation_type(inner[0], classes) if name == "Annotated" else (PYTHON_TYPES.get(name, "unknown"), None)
    name = ast.unparse(node).rpartition(".")[2]
    if name in classes:
        enum = _enum_of(classes[name], classes)
        return ("string" if enum[0] else "unknown", enum[1]) if enum else ("object" if classes[name].bases else "unknown", None)
    return PYTHON_TYPES.get(name, "unknown"), None


def _one_of(nodes: list[ast.expr], classes: dict[str, ast.ClassDef]) -> tuple[str, list[str] | None]:
    flat: list[ast.expr] = []
    for n in nodes:
        flat += [n.left, n.right] if isinstance(n, ast.BinOp) else [n]
    real = [n for n in flat if not (isinstance(n, ast.Constant) and n.value is None)]
    return annotation_type(real[0], classes) if len(real) == 1 else ("unknown", None)


def _by_package(files: DataFrame, rows, kind: str) -> DataFrame:
    names = [c.split()[0] for c in kind.split(", ")]

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        out = rows(dict(zip(group["file"], group["source"], strict=True)))
        return pd.DataFrame([(group["package"].iloc[0], *r) for r in out], columns=names)

    return files.groupBy("package").applyInPandas(scan, kind)


def ast_inventory(files: DataFrame, api: str = API) -> DataFrame:
    """HTTP calls of client packages (package, file, source). Constants may come from any file, so a package is one group."""
    return _by_package(files, lambda sources: Package(sources, api).calls(), "package string, file string, method string, path string, line long, dynamic boolean")


def ast_models(files: DataFrame) -> DataFrame:
    """The fields of the model classes of client packages (package, file, source), as their code declares them."""
    kind = "package string, file string, class_name string, line long, key string, type string, required boolean, enum array<string>"
    return _by_package(files, lambda sources: Package(sources, API).models(), kind)
