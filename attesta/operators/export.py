"""Verified contracts as OpenAPI documents, and other OpenAPI documents as tables of operations and properties.

A contract becomes an operation row by row, with functions over its own arrays; only the assembly of a document, some hundred
operations, gathers rows. Other documents are read as JSON or YAML text, one file a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import template_path

#: The contract types that are JSON types, the parameters' places, and the operations of a path.
JSON_TYPES = ("string", "integer", "number", "boolean", "object", "array")
PLACES = ("header", "path", "query")
METHODS = ("get", "post", "put", "patch", "delete")
SCHEMA = "struct<type:string,enum:array<string>>"


def openapi_path(path: Column) -> Column:
    """A leading /, no query, no closing /, parameters in braces."""
    cut = F.regexp_replace(F.split_part(F.trim(path), F.lit("?"), F.lit(1)), "/+$", "")
    return template_path(F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut)))


def _type(f: Column) -> Column:
    return F.when(f["type"].isin(*JSON_TYPES), f["type"])


def _enum(f: Column) -> Column:
    return F.when(F.size(f["enum"]) > 0, f["enum"])


def _cite(f: Column) -> Column:
    return F.struct(f["page"].alias("page"), f["quote"].alias("quote"))


def _flat(f: Column) -> Column:
    """Nested names, with a dot or a bracket, are no properties."""
    return ~f["name"].rlike(r"[.\[]")


def object_schema(fields: Column) -> Column:
    """A JSON schema of fields in the order of their names: types, enumerations, citations, required names. Of one name the last counts."""
    flat = F.filter(fields, _flat)
    last = F.filter(flat, lambda f, i: ~F.exists(F.slice(flat, i + 2, F.size(flat)), lambda g: g["name"] == f["name"]))
    entry = lambda f: F.struct(f["name"].alias("key"), F.struct(_type(f).alias("type"), _enum(f).alias("enum"), _cite(f).alias("x-citation"), f["description"].alias("description")).alias("value"))
    required = F.array_sort(F.array_distinct(F.transform(F.filter(flat, lambda f: F.coalesce(f["required"], F.lit(False))), lambda f: f["name"])))
    return F.struct(F.lit(True).alias("additionalProperties"), F.map_from_entries(F.array_sort(F.transform(last, entry))).alias("properties"), required.alias("required"), F.lit("object").alias("type"))


def parameters(fields: Column, path: Column) -> Column:
    """Header, path and query fields as parameters, then the path's other names.

    A path parameter has the template's spelling; a row that the template lacks is left out, and of equal ones the first counts.
    """
    names = F.regexp_extract_all(path, F.lit(r"\{([^}/]+)\}"), F.lit(1))
    spelt = lambda f: F.get(F.filter(names, lambda n: F.lower(n) == F.lower(f["name"])), F.lit(0))
    own = F.transform(
        F.filter(fields, lambda f: f["location"].isin(*PLACES)),
        lambda f: F.struct(
            f["location"].alias("in"), F.when(f["location"] == "path", spelt(f)).otherwise(f["name"]).alias("name"), ((f["location"] == "path") | F.coalesce(f["required"], F.lit(False))).alias("required"),
            F.when(_flat(f), F.struct(_type(f).alias("type"), _enum(f).alias("enum"))).alias("schema"), _cite(f).alias("x-citation"),
        ),
    )
    own = F.filter(own, lambda p: p["name"].isNotNull())
    first = F.filter(own, lambda p, i: ~F.exists(F.slice(own, F.lit(1), i), lambda q: (q["in"] == p["in"]) & (q["name"] == p["name"])))
    rest = F.filter(F.array_distinct(names), lambda n: ~F.exists(own, lambda p: (p["in"] == "path") & (p["name"] == n)))
    text = F.struct(F.lit("string").alias("type"), F.lit(None).cast("array<string>").alias("enum"))
    more = F.transform(rest, lambda n: F.struct(F.lit("path").alias("in"), n.alias("name"), F.lit(True).alias("required"), text.alias("schema"), F.lit(None).cast("struct<page:int,quote:string>").alias("x-citation")))
    return F.concat(first, more)


def operations(parsed: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc, path, method, section_id, operation: JSON) of the verified endpoint contracts whose path is one."""
    rows = parsed.where("error is null and kind = 'endpoint'").join(verified.select("doc", "section_id").distinct(), ["doc", "section_id"], "left_semi")
    rows = rows.where("method is not null and contains(path, '/')").withColumn("at", openapi_path(F.col("path")))
    rows = rows.withColumn("parameters", parameters(F.col("fields"), F.col("at")))
    of = lambda place: F.filter("fields", lambda f: f["location"] == place)
    content = lambda schema: F.create_map(F.lit("application/json"), F.struct(schema.alias("schema")))
    text = F.struct(F.lit("string").alias("type"))
    envelope = F.struct(F.lit("object").alias("type"), F.struct(text.alias("code"), text.alias("msg"), object_schema(of("response")).alias("data")).alias("properties"))
    answer = F.struct(F.lit("Success").alias("description"), F.when(F.size(of("response")) > 0, content(envelope)).alias("content"))
    cite = F.get(F.filter("cites", lambda c: c["key"] == "path"), 0)
    operation = F.struct(
        F.col("title").alias("summary"), F.col("section_id").alias("x-section"), F.when(cite.isNotNull(), _cite(cite)).alias("x-citation"), F.when(F.size("parameters") > 0, F.col("parameters")).alias("parameters"),
        F.when(F.size(of("body")) > 0, F.struct(content(object_schema(of("body"))).alias("content"))).alias("requestBody"), F.create_map(F.lit("200"), answer).alias("responses"),
    )
    return rows.select("doc", F.col("at").alias("path"), F.lower("method").alias("method"), "section_id", F.to_json(operation).alias("operation"))


def components(parsed: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc, section_id, schema: JSON) of the verified schema contracts that define something."""
    rows = parsed.where("error is null and kind = 'schema' and size(definitions) > 0").join(verified.select("doc", "section_id").distinct(), ["doc", "section_id"], "left_semi")
    schema = object_schema(F.col("definitions"))
    return rows.select("doc", "section_id", F.to_json(F.struct(*[schema[k].alias(k) for k in ("additionalProperties", "properties", "required")], F.col("title").alias("title"), schema["type"].alias("type"))).alias("schema"))


def export(parsed: DataFrame, verified: DataFrame, title: str = "Verified contract") -> DataFrame:
    """(doc, spec): one OpenAPI 3.1 document a row, its paths, methods and schemas in order. Of one path and method the last section counts."""
    ops = operations(parsed, verified).groupBy("doc", "path", "method").agg(F.max_by("operation", "section_id").alias("operation"))
    member = lambda key, value: F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), value)
    joined = lambda key, value: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: member(x["k"], x["v"])), ","), F.lit("}"))
    paths = ops.groupBy("doc", "path").agg(joined(F.col("method"), F.col("operation")).alias("item")).groupBy("doc").agg(joined(F.col("path"), F.col("item")).alias("paths"))
    schemas = components(parsed, verified).groupBy("doc").agg(joined(F.col("section_id"), F.col("schema")).alias("schemas"))
    info = F.lit(f'{{"openapi":"3.1.0","info":{{"title":"{title}","version":"0.1.0"}},"paths":')
    more = F.coalesce(F.concat(F.lit(',"components":{"schemas":'), "schemas", F.lit("}")), F.lit(""))
    docs = parsed.select("doc").distinct().join(paths, "doc", "left").join(schemas, "doc", "left")
    return docs.select("doc", F.concat(info, F.coalesce("paths", F.lit("{}")), more, F.lit("}")).alias("spec"))


def problems_of(text: str) -> list[str]:
    """What is wrong with the structure of an OpenAPI 3 document: its head, its paths and their parameters."""
    import json
    import re

    try:
        spec = json.loads(text)
    except ValueError:
        return ["not JSON"]
    if not isinstance(spec, dict) or not str(spec.get("openapi", "")).startswith("3."):
        return ["no OpenAPI 3 document"]
    info, paths = spec.get("info"), spec.get("paths")
    out = [] if isinstance(info, dict) and {"title", "version"} <= set(info) else ["info"]
    for path, item in sorted(paths.items()) if isinstance(paths, dict) else [("paths", None)]:
        if not path.startswith("/") or not isinstance(item, dict):
            out.append(f"{path}: no path")
            continue
        for method, operation in sorted(item.items()):
            if method not in METHODS or not isinstance(operation, dict) or not operation.get("responses"):
                out.append(f"{method} {path}: no operation with responses")
                continue
            given = [(p.get("in"), p.get("name")) for p in operation.get("parameters") or []]
            if len(given) != len(set(given)):
                out.append(f"{method} {path}: a parameter twice")
            if {n for where, n in given if where == "path"} != set(re.findall(r"\{([^}/]+)\}", path)):
                out.append(f"{method} {path}: path parameters differ from the template")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def problems(specs: pd.Series) -> pd.Series:
    return specs.map(problems_of)


# Other documents ------------------------------------------------------------------------------------------------------


def _escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def resolve(spec, node, pointer: str):
    """(target, pointer) of a chain of local references; a reference met twice ends it."""
    met = set()
    while isinstance(node, dict) and isinstance(ref := node.get("$ref"), str) and ref.startswith("#/") and ref not in met:
        met.add(ref)
        node, pointer = spec, ref
        for token in ref.removeprefix("#/").split("/"):
            node = node.get(token.replace("~1", "/").replace("~0", "~")) if isinstance(node, dict) else None
    return node, pointer


def line_index(text: str) -> dict[str, int]:
    """The line, from 1, of every JSON pointer of a YAML (or JSON) text."""
    import yaml

    out: dict[str, int] = {}
    todo = [("#", yaml.compose(text))]
    while todo:
        pointer, node = todo.pop()
        if node is None:
            continue
        out[pointer] = node.start_mark.line + 1
        if isinstance(node, yaml.MappingNode):
            todo += [(f"{pointer}/{_escape(str(k.value))}", v) for k, v in node.value]
        elif isinstance(node, yaml.SequenceNode):
            todo += [(f"{pointer}/{i}", v) for i, v in enumerate(node.value)]
    return out


def _body(spec: dict, path: str, method: str, operation: dict) -> tuple[dict, str]:
    body, at = resolve(spec, operation.get("requestBody"), f"#/paths/{_escape(path)}/{method}/requestBody")
    if not isinstance(body, dict):
        return {}, at
    media = (body.get("content") or {}).get("application/json") or {}
    schema, at = resolve(spec, media.get("schema"), f"{at}/content/application~1json/schema")
    return schema if isinstance(schema, dict) else {}, at


OPERATION = "doc string, path string, method string, section_id string, pointer string, line int, cite_page int, cite_quote string"
PROPERTY = "name string, type string, required boolean, enum array<string>, page int, quote string, at string, at_line int, list_line int, required_line int, type_line int, enum_line int"


def _operation_rows(doc: str, text: str) -> Iterator[tuple]:
    import yaml

    spec = yaml.safe_load(text)
    spec = spec if isinstance(spec, dict) else {}
    lines = line_index(text)
    for path, item in sorted((spec.get("paths") or {}).items()):
        for method in METHODS:
            operation = item.get(method) if isinstance(item, dict) else None
            if not isinstance(operation, dict):
                continue
            schema, at = _body(spec, path, method, operation)
            cite = operation.get("x-citation") or {}
            head = (doc, path, method.upper(), operation.get("x-section"), at, lines.get("#/paths"), cite.get("page"), cite.get("quote"))
            required = set(schema.get("required") or [])
            props = []
            for name, p in sorted((schema.get("properties") or {}).items()):
                p = p if isinstance(p, dict) else {}
                own, cite = f"{at}/properties/{_escape(name)}", p.get("x-citation") or {}
                enum = [str(v) for v in p["enum"]] if isinstance(p.get("enum"), list) else None
                kind = p["type"] if isinstance(p.get("type"), str) else ",".join(map(str, p["type"])) if isinstance(p.get("type"), list) else None
                props.append((name, kind, name in required, enum, cite.get("page"), cite.get("quote"), own, lines.get(own), lines.get(f"{at}/properties"), lines.get(f"{at}/required"), lines.get(f"{own}/type"), lines.get(f"{own}/enum")))
            yield (*head, props)


def read_operations(specs: DataFrame) -> DataFrame:
    """(doc, text) of OpenAPI files to their operations, each with the properties of its request body and where these stand."""
    names = [c.split()[0] for c in OPERATION.split(", ")]
    inner = [c.split()[0] for c in PROPERTY.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [row for d, t in zip(frame["doc"], frame["text"], strict=True) for row in _operation_rows(d, t)]
            yield pd.DataFrame([(*r[:-1], [dict(zip(inner, p, strict=True)) for p in r[-1]]) for r in out], columns=[*names, "props"])

    fields = ",".join(":".join(c.split(" ", 1)) for c in PROPERTY.split(", "))
    return specs.select("doc", "text").mapInPandas(run, f"{OPERATION}, props array<struct<{fields}>>")
