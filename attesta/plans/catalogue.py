"""The engine's queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, stats, text
from ..operators import diff, loop, metrics, samples, segment, verify
from ..session import ship_package
from ..sources.readers import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


def n_(x: str) -> str:
    """SQL: normalised text."""
    quotes = text.QUOTES[0]
    out = f"replace(replace(replace(replace({x}, '{quotes[0]}', chr(34)), '{quotes[1]}', chr(34)), '{quotes[2]}', chr(39)), '{quotes[3]}', chr(39))"
    return f"trim(regexp_replace({out}, '{text.WHITE}', ' ', 'g'))"


def t_(n: str, d: str) -> str:
    """SQL: a rate, rounded down to four places."""
    return f"(case when ({d}) <> 0 then floor(({n})::double * 10000 / ({d})) / 10000::double end)"


LINES = "string_split(text, chr(10))"
URL_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/+$', '')"


def url_path(url) -> F.Column:
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://[^/]+", ""), r"[?#].*$", "")
    return F.regexp_replace(bare, "/+$", "")


# Text -----------------------------------------------------------------------------------------------------------------


@query("norm_text", f"select doc_id, sha256({n_('text')}) as h from documents")
def norm_text(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", hashing.sha256_text(text.norm("text")).alias("h"))


@query("line_explode", f"select doc_id, unnest(range(len({LINES})))::bigint as line_no, unnest({LINES}) as line from documents")
def line_explode(t):
    return segment.explode_lines(t.documents, "text", "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("form_feed_pages", "select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::bigint as page, sha256(unnest(string_split(text, chr(10)))) as h from documents")
def form_feed_pages(t):
    fed = t.documents.select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit("\f")), "\f").alias("p"))
    return fed.select("doc_id", F.posexplode("p").alias("n", "raw")).select("doc_id", (F.col("n") + 1).cast("long").alias("page"), hashing.sha256_text("raw").alias("h"))


@query(
    "margin_strip",
    f"""with l as (select doc_id, unnest(range(len({LINES}))) as i, rtrim(repeat(' ', (doc_id % 4)::int) || unnest({LINES})) as line from documents),
    lastl as (select doc_id, max(i) filter (line <> '') as m, min(length(line) - length(ltrim(line))) filter (line <> '') as margin from l group by 1)
    select doc_id, sha256(coalesce(string_agg(substr(line, margin::int + 1), chr(10) order by i) filter (i <= m), '')) as h from l join lastl using (doc_id) group by doc_id""",
)
def margin_strip(t):
    pad = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.repeat(F.lit(" "), F.pmod("doc_id", F.lit(4)).cast("int")), x)), "\n")
    return spread(t.documents.select("doc_id", "text")).select("doc_id", hashing.sha256_text(segment.clean_page(pad)).alias("h"))


@query("toc_detect", f"select doc_id, len(list_filter({LINES}, lambda x: regexp_matches(x, '[.!?]$'))) >= 5 as toc from documents")
def toc_detect(t):
    return t.documents.select("doc_id", segment.is_toc(F.col("text"), 5, r"[.!?]$").alias("toc"))


@query("heading_extract", "select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h1 from pages")
def heading_extract(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


@query(
    "heading_monotonic",
    """select conv_id, turn, n from (select conv_id, turn, length(text)::bigint as n,
    max(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as m from conversations) where m is null or n > m""",
)
def heading_monotonic(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return segment.increasing(rows, F.col("n"), ["conv_id"], ["turn"])


@query(
    "section_fill",
    "select conv_id, turn, last_value(case when role <> 'user' then role end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as filled from conversations",
)
def section_fill(t):
    role = F.when(F.col("role") != "user", F.col("role"))
    return t.conversations.select("conv_id", "turn", segment.fill_forward(role, ["conv_id"], ["turn"]).alias("filled"))


@query(
    "section_spans",
    f"""with s as (select source, doc_id, len({LINES}) as n, last_value(case when doc_id % 5 = 0 then doc_id end ignore nulls) over (partition by source order by doc_id
    rows between unbounded preceding and current row) as opened from documents) select source, opened, min(doc_id) as first_doc, max(doc_id) as last_doc, sum(n)::bigint as n_lines from s where opened is not null group by 1, 2""",
)
def section_spans(t):
    opens = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id"))
    rows = t.documents.select("source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    rows = segment.filled(rows, opens, "opened", ["source"], "doc_id")
    return rows.where("opened is not null").groupBy("source", "opened").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n").alias("n_lines"))


@query("kind_histogram", "select case when contains(url, '.html') then 'endpoint' when contains(url, '?') then 'schema' else 'overview' end as kind, count(*)::bigint as n from pages group by 1")
def kind_histogram(t):
    has = lambda x: F.col("url").contains(x)
    kind = segment.kind_of(F.when(has("?"), "Page Schema").otherwise("Page"), F.when(has(".html"), "Request  URL : /x").otherwise("no address"))
    return t.pages.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("path_norm", f"select page_id, regexp_replace({URL_PATH}, '/[0-9]+', '/{{}}', 'g') as path from pages")
def path_norm(t):
    return t.pages.select("page_id", text.norm_path(F.regexp_replace(url_path(F.col("url")), "/[0-9]+", "/:id")).alias("path"))


@query("path_template", f"select page_id, regexp_replace({URL_PATH}, '/[0-9]+', '/{{id}}', 'g') as path from pages")
def path_template(t):
    return t.pages.select("page_id", text.template_path(F.regexp_replace(url_path(F.col("url")), "/[0-9]+", "/:id")).alias("path"))


@query("path_hint", "select page_id, case when contains(p, '/') then p end as path from (select page_id, regexp_replace(split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1), '/+$', '') as p from pages)")
def path_hint(t):
    return t.pages.select("page_id", text.path_hint(F.regexp_replace("url", "^https?://[^/]+", "")).alias("path"))


@query("snippet_lines", f"select doc_id, substr(trim({LINES}[1]), 1, 160) as snippet from documents")
def snippet_lines(t):
    return t.documents.select("doc_id", text.snippet(F.get(F.split("text", "\n"), F.lit(0))).alias("snippet"))


@query("pointer_escape", "select page_id, replace(replace(url, '~', '~0'), '/', '~1') as pointer from pages")
def pointer_escape(t):
    return t.pages.select("page_id", text.pointer_escape(F.col("url")).alias("pointer"))


# Citations ------------------------------------------------------------------------------------------------------------

CITED = """cites as (select b.item_id, b.text, coalesce(case when b.item_id % 2 = 0 then f.page end, (b.item_id * 7) % (select count(*) from documents)) as cited
    from benchmark b left join found f using (item_id))"""
FOUND = f"found as (select b.item_id, min(d.doc_id) as page, count(*) as n from benchmark b join documents d on contains({n_('d.text')}, {n_('b.text')}) where length({n_('b.text')}) >= 12 group by 1)"


def citations(t) -> DataFrame:
    """Each passage with the document it cites: the first that holds it for even ids, an arbitrary one otherwise."""
    quotes = t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = verify.occurrences(quotes, spread(t.documents.select(F.col("doc_id").alias("page"), "text"))).groupBy("quote_id").agg(F.min("page").alias("page"))
    n = t.documents.agg(F.count("*").alias("n"))
    rows = quotes.join(found, "quote_id", "left").crossJoin(F.broadcast(n))  # one row
    cited = F.coalesce(F.when(F.col("quote_id") % 2 == 0, F.col("page")), (F.col("quote_id") * 7) % F.col("n"))
    rows = rows.select("quote_id", "quote", cited.alias("cited"))
    block = F.expr("cited div 500")
    return rows.select(F.col("quote_id").alias("cite_id"), block.alias("doc"), F.col("cited").alias("page"), "quote", (block * 500).alias("first_page"), (block * 500 + 499).alias("last_page"))


def verdicts(t) -> DataFrame:
    pages = t.documents.select(F.expr("doc_id div 500").alias("doc"), F.col("doc_id").alias("page"), "text")
    return verify.check_citations(citations(t), pages)


@query("quote_length_rule", f"select item_id, length({n_('text')}) between 12 and 200 as ok from benchmark")
def quote_length_rule(t):
    return t.benchmark.select("item_id", verify.quote_ok(F.col("text")).alias("ok"))


@query("citation_on_page", f"with {FOUND}, {CITED} select c.item_id, c.cited, coalesce(contains({n_('d.text')}, {n_('c.text')}), false) as grounded from cites c left join documents d on d.doc_id = c.cited")
def citation_on_page(t):
    return verdicts(t).select(F.col("cite_id").alias("item_id"), F.col("page").alias("cited"), (F.col("verdict") == "GROUNDED").alias("grounded"))


@query("citation_anywhere", f"with {FOUND} select item_id, page as first_doc, n::bigint as n_docs from found")
def citation_anywhere(t):
    quotes = t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = verify.occurrences(quotes, spread(t.documents.select(F.col("doc_id").alias("page"), "text")))
    return found.groupBy(F.col("quote_id").alias("item_id")).agg(F.min("page").alias("first_doc"), F.count("*").alias("n_docs"))


VERDICTS = f"""{FOUND}, {CITED}, v as (select c.item_id, c.cited, coalesce(contains({n_('d.text')}, {n_('c.text')}), false) as here,
    (select min(e.doc_id) from documents e where e.doc_id // 500 = c.cited // 500 and contains({n_('e.text')}, {n_('c.text')})) as near
    from cites c left join documents d on d.doc_id = c.cited)"""


@query(
    "citation_verdicts",
    f"""with {VERDICTS} select item_id, case when here then 'GROUNDED' when near is not null then 'V2_CITATION_WRONG_PAGE' else 'V2_CITATION_NOT_FOUND' end as verdict,
    case when not here then near end as suggested from v""",
)
def citation_verdicts(t):
    return verdicts(t).select(F.col("cite_id").alias("item_id"), "verdict", F.col("suggested_page").alias("suggested"))


@query(
    "citation_rate",
    f"""with {VERDICTS} select d.source, count(*) filter (here)::bigint as numerator, count(*)::bigint as denominator, {t_("count(*) filter (here)", "count(*)")} as value
    from v join documents d on d.doc_id = v.cited group by 1""",
)
def citation_rate(t):
    rows = verdicts(t).select(F.col("page").alias("doc_id"), "verdict").join(t.documents.select("doc_id", "source"), "doc_id")
    return metrics.rates_by(rows, "source", F.count_if(F.col("verdict") == "GROUNDED"), F.count("*"))


@query("name_in_quote", f"select b.item_id, contains({n_('d.text')}, split_part({n_('b.text')}, ' ', 1)) as ok from benchmark b join documents d on d.doc_id = b.item_id")
def name_in_quote(t):
    fields = t.benchmark.select(F.col("item_id").alias("doc_id"), F.split_part(text.norm("text"), F.lit(" "), F.lit(1)).alias("name")).join(t.documents.select("doc_id", F.col("text").alias("quote")), "doc_id")
    lost = verify.check_names(fields).select("doc_id", F.lit(False).alias("ok"))
    return fields.select("doc_id").join(lost, "doc_id", "left").select(F.col("doc_id").alias("item_id"), F.coalesce("ok", F.lit(True)).alias("ok"))


@query("enum_grounding", "select o_orderpriority as priority, count(*) filter (not contains('1-URGENT 2-HIGH 3-MEDIUM', o_orderpriority))::bigint as missing from orders group by 1")
def enum_grounding(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.array("o_orderpriority").alias("enum"), F.lit("1-URGENT 2-HIGH 3-MEDIUM").alias("quote"))
    lost = verify.check_enum(rows).select("o_orderkey", F.lit(1).alias("m"))
    return rows.join(lost, "o_orderkey", "left").groupBy("priority").agg(F.count("m").alias("missing"))


# JSON samples ---------------------------------------------------------------------------------------------------------

CUT = "case when event_id % 7 = 0 then substr(props, 1, length(props) - 1) else props end"


def cut_props() -> F.Column:
    return F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))


@query("json_parse_rule", f"select event_id, json_valid({CUT}) as ok from events")
def json_parse_rule(t):
    return t.events.select("event_id", samples.is_json(cut_props()).alias("ok"))


@query("json_sample_rate", f"select event_type, count(*) filter (json_valid({CUT}))::bigint as numerator, count(*)::bigint as denominator, {t_(f'count(*) filter (json_valid({CUT}))', 'count(*)')} as value from events group by 1")
def json_sample_rate(t):
    rows = t.events.select("event_type", samples.is_json(cut_props()).alias("ok"))
    return metrics.rates_by(rows, "event_type", F.count_if("ok"), F.count("*"))


def required_missing(t) -> DataFrame:
    renamed = F.when(F.col("event_id") % 5 == 0, F.replace("props", F.lit('"k"'), F.lit('"kk"'))).otherwise(F.col("props"))
    return samples.missing_keys(t.events.select("event_id", "event_type", renamed.alias("p")), "p", ["k"]).select("event_id", "event_type", "field")


def type_mismatch(t) -> DataFrame:
    quoted = F.when(F.col("event_id") % 11 == 0, F.regexp_replace("props", r": *(-?[0-9]+)", r': "$1"')).otherwise(F.col("props"))
    rows = t.events.select("event_id", "event_type", samples.type_of(F.try_parse_json(quoted), "$.k").alias("actual"))
    return rows.where("actual <> 'integer'")


def unknown(t) -> DataFrame:
    more = F.when(F.col("event_id") % 3 == 0, F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "z": 1}'))).otherwise(F.col("props"))
    return samples.unknown_keys(t.events.select("event_id", "event_type", more.alias("p")), "p", ["k"]).select("event_id", "event_type", "field")


@query("json_required", "select event_id, event_type, 'k' as field from events where event_id % 5 = 0")
def json_required(t):
    return required_missing(t)


@query("json_type", """select event_id, event_type, 'string' as actual from events where json_type(case when event_id % 11 = 0 then regexp_replace(props, ': *(-?[0-9]+)', ': "\\1"') else props end, '$.k') = 'VARCHAR'""")
def json_type(t):
    return type_mismatch(t)


@query(
    "json_unknown_keys",
    """select event_id, event_type, k as field from (select event_id, event_type, unnest(json_keys(case when event_id % 3 = 0 then substr(props, 1, length(props) - 1) || ', "z": 1}' else props end)) as k from events) where k <> 'k'""",
)
def json_unknown_keys(t):
    return unknown(t)


ITEMS = """'{"code":0,"msg":"","data":[' || props || ',' || replace(props, '"k"', '"kk"') || ',' || regexp_replace(props, ': *(-?[0-9]+)', ': "\\1"') || ',null]}'"""


@query("json_response_items", f"""with x as (select event_id, unnest(range(0, 4)) as item, unnest(json_extract({ITEMS}, '$.data[*]')) as v from events)
select event_id, item::bigint as item, case json_type(v, '$.k') when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' end as actual from x""")
def json_response_items(t):
    more = [F.col("props"), F.replace("props", F.lit('"k"'), F.lit('"kk"')), F.regexp_replace("props", r": *(-?[0-9]+)", r': "$1"'), F.lit("null")]
    body = F.concat(F.lit('{"code":0,"msg":"","data":['), F.concat_ws(",", *more), F.lit("]}"))
    rows = t.events.select("event_id", F.parse_json(body).alias("v"))
    rows = rows.select("event_id", F.posexplode(F.variant_get("v", "$.data", "array<variant>")).alias("item", "x"))
    return rows.select("event_id", F.col("item").cast("long").alias("item"), samples.type_of(F.col("x"), "$.k").alias("actual"))


ISSUES = """issues as (select event_id, event_type, 'V3_REQUIRED_MISSING' as code, 'k' as field, 1 as rule from events where event_id % 5 = 0
    union all select event_id, event_type, 'V3_TYPE_MISMATCH', 'k', 2 from events where event_id % 11 = 0
    union all select event_id, event_type, 'V3_UNKNOWN_FIELD', 'z', 3 from events where event_id % 3 = 0)"""


def all_issues(t) -> DataFrame:
    parts = [(required_missing(t), "V3_REQUIRED_MISSING", F.col("field")), (type_mismatch(t), "V3_TYPE_MISMATCH", F.lit("k")), (unknown(t), "V3_UNKNOWN_FIELD", F.col("field"))]
    return metrics.union_all(*[p.select("event_id", "event_type", F.lit(code).alias("code"), f.alias("field")) for p, code, f in parts])


@query("issue_union_sorted", f"with {ISSUES} select event_type, row_number() over (partition by event_type order by rule, field, event_id)::bigint as ord, code, event_id, field from issues")
def issue_union_sorted(t):
    place = F.array_position(F.array(*map(F.lit, verify.RULES)), F.col("code"))
    rows = all_issues(t).withColumn("rule", place)
    return segment.numbered(rows, "ord", ["event_type"], ["rule", "field"], "event_id").select("event_type", F.col("ord").cast("long").alias("ord"), "code", "event_id", "field")


@query("result_counts", f"select event_type, count(*)::bigint as items, count(*) filter (json_valid({CUT}))::bigint as grounded, count(*) filter (json_valid({CUT}) and event_id % 11 <> 0)::bigint as checked from events group by 1")
def result_counts(t):
    rows = t.events.select("event_type", samples.is_json(cut_props()).alias("ok"), (F.col("event_id") % 11 != 0).alias("typed"))
    return rows.groupBy("event_type").agg(F.count("*").alias("items"), F.count_if("ok").alias("grounded"), F.count_if(F.col("ok") & F.col("typed")).alias("checked"))


def _doc_sql(page: str, quote: str) -> str:
    escaped = f"replace(replace({quote}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    return f"""('{{"file": null, "kind": "doc", "line": null, "page": ' || {page} || ', "quote": "' || {escaped} || '", "snippet": null}}')"""


@query(
    "spec_findings",
    f"""with {ISSUES}, own as (select i.event_id, i.code, i.field, props from issues i join events using (event_id) where code <> 'V3_UNKNOWN_FIELD' and i.event_id % 4 <> 0),
    f as (select event_id, field, case code when 'V3_REQUIRED_MISSING' then 'SPEC_SAMPLE_INCOMPLETE' else 'SPEC_SELF_INCONSISTENCY' end as type, case code when 'V3_REQUIRED_MISSING' then 'medium' else 'high' end as severity,
    case code when 'V3_REQUIRED_MISSING' then 'Sample omits k, which the document marks required' else 'Sample value type contradicts the documented type of k' end as title,
    array_to_string(list_sort([{_doc_sql("'7'", "'k  T  integer'")}, {_doc_sql("event_id", "props")}]), '|') as ev from own)
    select event_id, type, severity, title, 'F-' || substr(sha256(type || '|' || event_id || '|' || field || '|' || ev), 1, 8) as id from f""",
)
def spec_findings(t):
    """The sample conflicts of events as findings; every fourth event has an extraction error, so that its conflicts are not grounded."""
    props = t.events.select("event_id", F.struct(F.col("event_id").cast("int").alias("page"), F.col("props").alias("quote")).alias("evidence"))
    rows = all_issues(t).join(props, "event_id").withColumn("category", F.when(F.col("code") == "V3_UNKNOWN_FIELD", "info").otherwise("sample_conflict")).drop("event_type")
    wrong = props.where("event_id % 4 = 0").select("event_id", F.lit("V2_ROW_MISMATCH").alias("code"), F.lit("other").alias("field"), "evidence", F.lit("extraction").alias("category"))
    rows = rows.unionByName(wrong).withColumn("severity", F.when(F.col("category") == "info", "info").otherwise("error"))
    rows = rows.withColumn("section_id", F.col("event_id").cast("string")).drop("event_id")
    none = F.lit(None)
    fields = t.events.select(F.col("event_id").cast("string").alias("section_id"), F.lit(0).alias("n"), F.lit("k").alias("name"), F.lit(7).alias("page"), F.lit("k  T  integer").alias("quote"), none.cast("int").alias("enum_page"), none.cast("string").alias("enum_quote"))
    return loop.spec_findings(rows, fields, ["section_id"]).select(F.col("section_id").cast("long").alias("event_id"), "type", "severity", "title", "id")


@query("coverage_gap", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49 and l_returnflag = 'R')")
def coverage_gap(t):
    seen = t.lineitem.where("l_quantity >= 49 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return verify.coverage_gaps(t.part.select("p_partkey"), seen, ["p_partkey"])


@query("missing_contracts", "select r.i::bigint as doc_id from range(0, (select max(doc_id) + 20 from documents)) r(i) where r.i % 3 = 0 and r.i not in (select doc_id from documents where lang = 'en')")
def missing_contracts(t):
    top = t.documents.agg((F.max("doc_id") + 19).alias("m"))
    wanted = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(3).cast("long"))).alias("doc_id"))
    return diff.missing(wanted, t.documents.where("lang = 'en'"), ["doc_id"])


# The retry loop -------------------------------------------------------------------------------------------------------

ATT = "att as (select conv_id, turn + 1 as attempt, (length(text) % 4)::bigint as errors, role from conversations where turn < 3)"
STATUS = f"""{ATT}, latest as (select conv_id, max(attempt) as attempt from att group by 1),
    st as (select a.conv_id, a.attempt, a.errors, case when a.errors > 0 and (coalesce(a.errors >= p.errors, false) or a.attempt >= 3) then 'QUARANTINED' when a.errors > 0 then 'NEEDS_RETRY' else 'VERIFIED' end as status
    from att a join latest l on l.conv_id = a.conv_id and l.attempt = a.attempt left join att p on p.conv_id = a.conv_id and p.attempt = a.attempt - 1)"""


def attempts(t) -> DataFrame:
    return t.conversations.where("turn < 3").select(
        F.col("conv_id").alias("section_id"), (F.col("turn") + 1).alias("attempt"), (F.length("text") % 4).cast("long").alias("errors"),
        F.lit(0).alias("findings"), F.lit(False).alias("invalid"), "role",
    )


@query("attempt_latest_first", "select conv_id, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, count(*)::bigint as n from conversations group by 1")
def attempt_latest_first(t):
    rows = t.conversations.select("conv_id", (F.col("turn") + 1).alias("attempt"), "role")
    last = loop.latest(rows, "conv_id").select("conv_id", F.col("role").alias("last_role"))
    first = loop.first(rows).select("conv_id", F.col("role").alias("first_role"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n")).join(last, "conv_id").join(first, "conv_id").select("conv_id", "first_role", "last_role", "n")


@query("classify_status", f"with {STATUS} select conv_id, attempt, errors, status from st")
def classify_status(t):
    return loop.classify(attempts(t)).withColumnRenamed("section_id", "conv_id")


@query("retryable", f"with {STATUS} select conv_id, attempt from st where status = 'NEEDS_RETRY' and attempt < 3")
def retryable(t):
    return loop.retryable(loop.classify(attempts(t))).select(F.col("section_id").alias("conv_id"), "attempt")


@query("loop_funnel", f"with {ATT}, s as (select conv_id, min(attempt) filter (errors = 0) as solved from att group by 1) select 'by_' || k as stage, (select count(*) from s where solved <= k)::bigint as n from range(1, 4) r(k)")
def loop_funnel(t):
    return loop.funnel(attempts(t))


@query("issues_fixed", f"with {ATT}, latest as (select conv_id, max(attempt) as attempt from att group by 1) select conv_id, role from att where attempt = 1 and errors > 0 except select a.conv_id, a.role from att a join latest l on l.conv_id = a.conv_id and l.attempt = a.attempt where errors > 0")
def issues_fixed(t):
    rows = attempts(t)
    return loop.fixed(loop.first(rows).where("errors > 0"), loop.latest(rows).where("errors > 0"), ["section_id", "role"]).withColumnRenamed("section_id", "conv_id")


LOOP_METRICS = f"""with {STATUS}, c as (select count(*) as n, count(*) filter (status = 'VERIFIED') as ok, count(*) filter (status = 'QUARANTINED') as q, sum(attempt)::bigint as tries from st),
    f as (select count(*) as first_ok from att where attempt = 1 and errors = 0)
    select 'first_pass_verified_rate' as metric, first_ok::bigint as numerator, n::bigint as denominator, {t_('first_ok', 'n')} as value from c, f
    union all select 'final_verified_rate', ok, n, {t_('ok', 'n')} from c union all select 'quarantine_rate', q, n, {t_('q', 'n')} from c
    union all select 'loop_lift', ok - first_ok, n, {t_('ok - first_ok', 'n')} from c, f union all select 'mean_attempts', tries, n, {t_('tries', 'n')} from c"""


@query("loop_metrics", LOOP_METRICS)
def loop_metrics(t):
    rows, done = attempts(t), loop.classify(attempts(t))
    firsts = loop.first(rows).select("section_id", (F.col("errors") == 0).alias("first_ok"))
    both = done.join(firsts, "section_id", "left")
    n, ok = F.count("*"), F.count_if(F.col("status").isin(*loop.TRUSTED))
    first_ok = F.count_if("first_ok")
    parts = [("first_pass_verified_rate", first_ok), ("final_verified_rate", ok), ("quarantine_rate", F.count_if(F.col("status") == "QUARANTINED")), ("loop_lift", ok - first_ok), ("mean_attempts", F.sum("attempt"))]
    return metrics.union_all(*[metrics.rate_row(both, name, c, n) for name, c in parts]).drop("reason")


@query(
    "feedback_text",
    """with i as (select conv_id, turn, case when role <> 'user' then role end as field, turn::varchar as message, '- V2_ROW_MISMATCH: ' || turn || case when turn % 2 = 0 then chr(10) || '  The quote is on page ' || turn || '.' else chr(10) || '  Evidence: page 3, "a quote"' end as line from conversations),
    b as (select conv_id, field, chr(10) || chr(10) || '## ' || coalesce(field || case when field = 'assistant' then ' (location: body)' else ' (location: not in contract)' end, '(section)') || chr(10) || string_agg(line, chr(10) order by message, line) as block from i group by 1, 2)
    select conv_id, sha256('# Feedback: ' || conv_id || ' (attempt 1 ' || chr(8594) || ' 2)' || chr(10) || 'Fix ONLY the items below. Do not change items that passed.' || string_agg(block, '' order by field is not null, field) || chr(10)) as h from b group by 1""",
)
def feedback_text(t):
    none = F.lit(None).cast("string")
    even = F.col("turn") % 2 == 0
    issues = t.conversations.select(
        F.col("conv_id").alias("section_id"), F.lit(1).alias("attempt"), F.lit("V2_ROW_MISMATCH").alias("code"), F.lit("error").alias("severity"), F.lit("extraction").alias("category"),
        F.when(F.col("role") != "user", F.col("role")).alias("field"), F.col("turn").cast("string").alias("message"), F.struct(F.lit(3).alias("page"), F.lit(" a  quote").alias("quote")).alias("evidence"),
        F.struct(none.alias("closest_match"), none.alias("closest_page"), F.when(even, F.col("turn").cast("string")).alias("suggested_page"), none.alias("first_unmatched")).alias("hint"),
    )
    sections = t.conversations.select(F.col("conv_id").alias("section_id")).distinct()
    fields = sections.select("section_id", F.lit(0).alias("n"), F.lit("assistant").alias("name"), F.lit("body").alias("location"))
    spans = sections.select("section_id", F.lit(1).alias("page_start"), F.lit(9).alias("page_end"))
    out = loop.feedback(issues.withColumn("section_id", F.col("section_id").cast("string")), ["section_id"], fields.withColumn("section_id", F.col("section_id").cast("string")), spans.withColumn("section_id", F.col("section_id").cast("string")))
    return out.select(F.col("section_id").cast(t.conversations.schema["conv_id"].dataType).alias("conv_id"), hashing.sha256_text("feedback").alias("h"))


# Comparison -----------------------------------------------------------------------------------------------------------


@query("diff_missing_endpoint", "select o_orderkey from orders where o_orderkey % 11 = 0")
def diff_missing_endpoint(t):
    return diff.missing(t.orders.select("o_orderkey"), t.orders.where("o_orderkey % 11 <> 0"), ["o_orderkey"])


OTHER = """a as (select o_orderkey as k, o_orderstatus as ty, o_orderkey % 2 = 0 as req, o_orderpriority as e from orders),
    b as (select case when o_orderkey % 17 = 0 then o_orderkey + 100000000 else o_orderkey end as k, case when o_orderkey % 13 = 0 then 'X' else o_orderstatus end as ty,
    case when o_orderkey % 23 = 0 then true else o_orderkey % 2 = 0 end as req, case when o_orderkey % 19 = 0 then '9-NONE' else o_orderpriority end as e from orders where o_orderkey % 11 <> 0)"""


@query(
    "diff_fields_full_outer",
    f"""with {OTHER}, j as (select coalesce(a.k, b.k) as k, a.k as ak, b.k as bk, a.ty as aty, b.ty as bty, a.req as ar, b.req as br, a.e as ae, b.e as be from a full outer join b on a.k = b.k)
    select k as o_orderkey, 'MISSING_FIELD' as code, '' as missing, '' as extra from j where bk is null union all select k, 'EXTRA_FIELD', '', '' from j where ak is null
    union all select k, 'REQUIRED_MISMATCH', '', '' from j where ak is not null and bk is not null and ar is distinct from br
    union all select k, 'TYPE_MISMATCH', '', '' from j where aty <> bty union all select k, 'ENUM_MISMATCH', ae, be from j where ae <> be""",
)
def diff_fields_full_outer(t):
    ours = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 2 == 0).alias("required"), F.array("o_orderpriority").alias("enum"))
    theirs = t.orders.where("o_orderkey % 11 <> 0").selectExpr(
        "if(o_orderkey % 17 = 0, o_orderkey + 100000000, o_orderkey) as o_orderkey", "if(o_orderkey % 13 = 0, 'X', o_orderstatus) as type",
        "if(o_orderkey % 23 = 0, true, o_orderkey % 2 = 0) as required", "array(if(o_orderkey % 19 = 0, '9-NONE', o_orderpriority)) as enum",
    )
    own = F.col("code") == "ENUM_MISMATCH"
    out = diff.property_diff(ours, theirs, ["o_orderkey"])
    return out.select("o_orderkey", "code", F.when(own, F.col("missing")).otherwise("").alias("missing"), F.when(own, F.col("extra")).otherwise("").alias("extra"))


@query(
    "enum_set_diff",
    """with a as (select o_custkey, list(distinct o_orderstatus) as s from orders group by 1), b as (select o_custkey, list(distinct case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end) as s from orders group by 1)
    select o_custkey, array_to_string(list_sort(list_filter(a.s, lambda x: not list_contains(b.s, x))), ',') as missing, array_to_string(list_sort(list_filter(b.s, lambda x: not list_contains(a.s, x))), ',') as extra
    from a join b using (o_custkey) where len(list_filter(a.s, lambda x: not list_contains(b.s, x))) + len(list_filter(b.s, lambda x: not list_contains(a.s, x))) > 0""",
)
def enum_set_diff(t):
    base = t.orders.select("o_custkey", F.lit("string").alias("type"), F.lit(True).alias("required"), "o_orderkey", "o_orderstatus")
    ours = base.groupBy("o_custkey", "type", "required").agg(F.collect_set("o_orderstatus").alias("enum"))
    theirs = base.groupBy("o_custkey", "type", "required").agg(F.collect_set(F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("enum"))
    return diff.property_diff(ours, theirs, ["o_custkey"]).select("o_custkey", "missing", "extra")


@query("client_undocumented", "select distinct l_partkey, 'CLIENT_UNDOCUMENTED_ENDPOINT' as code from lineitem where l_partkey not in (select p_partkey from part where p_size < 25)")
def client_undocumented(t):
    refs = t.lineitem.select(F.col("l_partkey").alias("path"), F.lit("GET").alias("method")).distinct()
    known = t.part.where("p_size < 25").select(F.col("p_partkey").alias("path"), F.lit("GET").alias("method"), F.col("p_name").alias("section_id"))
    return diff.check_inventory(refs, known).select(F.col("path").alias("l_partkey"), "code")


@query(
    "client_method_mismatch",
    """with d as (select distinct c_nationkey, c_mktsegment from customer where c_custkey % 7 = 0), p as (select c_nationkey, min(c_mktsegment) as section_id from d group by 1)
    select c_custkey, case when p.c_nationkey is null then 'CLIENT_UNDOCUMENTED_ENDPOINT' else 'CLIENT_METHOD_MISMATCH' end as code, section_id from customer c left join p using (c_nationkey)
    where p.c_nationkey is null or (c.c_nationkey, c.c_mktsegment) not in (select (c_nationkey, c_mktsegment) from d)""",
)
def client_method_mismatch(t):
    refs = t.customer.select("c_custkey", F.col("c_nationkey").alias("path"), F.col("c_mktsegment").alias("method"))
    known = t.customer.where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("path"), F.col("c_mktsegment").alias("method"), F.col("c_mktsegment").alias("section_id")).distinct()
    return diff.check_inventory(refs, known).select("c_custkey", "code", "section_id")


@query("diff_model_types", "select * from (values ('p_name', 'CLIENT_TYPE_MISMATCH', 'string', 'integer'), ('p_retailprice', 'CLIENT_TYPE_MISMATCH', 'number', 'string')) v(key, code, type, doc_type)")
def diff_model_types(t):
    model = t.spark.createDataFrame(diff.schema_types(t.part), "key string, type string, required boolean")
    documented = t.spark.createDataFrame([("p_partkey", "integer"), ("p_name", "integer"), ("p_size", "integer"), ("p_retailprice", "string"), ("p_brand", "string"), ("p_type", "string")], "key string, type string")
    return diff.model_diff(documented, model).select("key", "code", "type", "doc_type")


@query("mapping_validate", "select s_suppkey, case when not (s_nationkey < 20) then 'unknown section' when not (s_acctbal > 0) then 'section is not verified' when s_suppkey % 3 <> 0 then 'bad path' else 'valid' end as verdict from supplier")
def mapping_validate(t):
    rows = t.supplier.withColumn("json_path", F.when(F.col("s_suppkey") % 3 == 0, "data[*]").otherwise("items"))
    return diff.mapping_status(rows, F.col("s_acctbal") > 0, F.col("s_nationkey") < 20).select("s_suppkey", "verdict")


@query("openapi_export", f"""with p as (select regexp_replace({URL_PATH}, '/[0-9]+', '/{{id}}', 'g') as path, case page_id % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method, 'S-' || page_id as section_id from pages)
    select path, method, max(section_id) as section_id, count(*)::bigint as n from p where contains(path, '/') group by 1, 2""")
def openapi_export(t):
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), (F.col("page_id") % 3 + 1).cast("int"))
    ops = t.pages.select(text.template_path(F.regexp_replace(url_path(F.col("url")), "/[0-9]+", "/:id")).alias("path"), method.alias("method"), F.concat(F.lit("S-"), F.col("page_id")).alias("section_id"))
    return ops.where(F.col("path").contains("/")).groupBy("path", "method").agg(F.max("section_id").alias("section_id"), F.count("*").alias("n"))


# Audit, metrics and report --------------------------------------------------------------------------------------------


@query("audit_items", "select 'doc:' || d.doc_id as item_id, source as section, lang as chapter, l.quality::bigint as location from labels l join documents d using (doc_id)")
def audit_items(t):
    return t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("item_id"), F.col("source").alias("section"), F.col("lang").alias("chapter"), F.col("quality").cast("long").alias("location")
    )


@query(
    "audit_sample",
    """with r as (select doc_id, lang, source, row_number() over (partition by lang, source order by sha256('7:' || doc_id), doc_id) as r from documents),
    s as (select *, row_number() over (partition by lang order by r, source, doc_id) as t from r) select doc_id, lang, source from s order by t, lang limit 40""",
)
def audit_sample(t):
    return metrics.audit_sample(t.documents.select("doc_id", "lang", "source"), 40, "7", "lang", "source", "doc_id")


@query("audit_score", "select count(*) filter (quality = 1)::bigint as correct, count(*)::bigint as n, count(distinct source)::bigint as sections, count(distinct source) filter (toxic = 1)::bigint as sections_with_miss from labels join documents using (doc_id)")
def audit_score(t):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    verdict = F.when(F.col("quality") == 1, " Correct").otherwise("incorrect ")
    return metrics.audit_score(rows.select(verdict.alias("verdict"), (F.col("toxic") == 1).alias("missed"), F.col("source").alias("section")))


QUALITY = "q as (select source, count(*) filter (quality = 1) as c, count(*) as n from labels join documents using (doc_id) group by 1)"


def quality_by_source(t) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("c"), F.count("*").alias("n"))


@query(
    "wilson_ci",
    f"""with {QUALITY}, z as (select source, c::double / n as p, n::double as m, {stats.Z}::double as z from q)
    select source, round(greatest(0.0::double, (p + z*z/(2*m) - z*sqrt(p*(1-p)/m + z*z/(4*m*m))) / (1 + z*z/m)), 9) as lo, round(least(1.0::double, (p + z*z/(2*m) + z*sqrt(p*(1-p)/m + z*z/(4*m*m))) / (1 + z*z/m)), 9) as hi from z""",
)
def wilson_ci(t):
    lo, hi = stats.wilson(F.col("c"), F.col("n"))
    return quality_by_source(t).select("source", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("rate_display", f"with {QUALITY} select source, c || '/' || n as shown, floor({t_('c', 'n')} * 1000 + 1e-9) / 10 as per_cent from q")
def rate_display(t):
    rows = quality_by_source(t)
    return rows.select("source", stats.fraction(F.col("c"), F.col("n")).alias("shown"), stats.pct(stats.trunc4(F.col("c"), F.col("n"))).alias("per_cent"))


@query("median_minutes", "select event_type, round(median(value), 9) as median_value, count(value)::bigint as n from events group by 1")
def median_minutes(t):
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 9).alias("median_value"), F.count("value").alias("n"))


RATES = f"""with j as (select count(*) as n, count(*) filter (json_valid({CUT})) as ok, count(*) filter (event_id % 11 <> 0) as typed from events), q as (select count(*) as n, count(*) filter (quality = 1) as ok from labels),
    r as (select 'sample_parse_rate' as metric, ok as numerator, n as denominator from j union all select 'row_consistency_rate', typed, n from j union all select 'audited_precision', ok, n from q union all select 'determinism', 0, 0),
    rates as (select metric, numerator::bigint as numerator, denominator::bigint as denominator, {t_('numerator', 'denominator')} as value, case when denominator = 0 then 'no observations' end as reason from r)"""


def rates(t) -> DataFrame:
    events = t.events.select(samples.is_json(cut_props()).alias("ok"), (F.col("event_id") % 11 != 0).alias("typed"))
    return metrics.union_all(
        metrics.rate_row(events, "sample_parse_rate", F.count_if("ok"), F.count("*")),
        metrics.rate_row(events, "row_consistency_rate", F.count_if("typed"), F.count("*")),
        metrics.rate_row(t.labels, "audited_precision", F.count_if(F.col("quality") == 1), F.count("*")),
        metrics.rate_row(t.labels.where("false"), "determinism", F.count("*"), F.count("*")),
    )


@query("rates_table", f"{RATES} select * from rates")
def rates_table(t):
    return rates(t)


@query(
    "gate_verdicts",
    f"""{RATES}, th as (select * from (values ('sample_parse_rate', 0.8::double, null::double), ('row_consistency_rate', 0.95::double, null::double), ('audited_precision', null::double, 0.5::double), ('determinism', 1.0::double, null::double), ('absent', 0.1::double, null::double)) v(metric, least, most)),
    c as (select th.metric, value, case when value is null then 'no value' when value < th.least then 'below least' when value > th.most then 'above most' end as why from th left join rates using (metric))
    select metric, value, case when why is null then 'PASS' else 'FAIL' end as verdict, coalesce(why, '') as reason from c""",
)
def gate_verdicts(t):
    rows = [("sample_parse_rate", 0.8, None), ("row_consistency_rate", 0.95, None), ("audited_precision", None, 0.5), ("determinism", 1.0, None), ("absent", 0.1, None)]
    return metrics.gate(rates(t), t.spark.createDataFrame(rows, "metric string, least double, most double"))


@query("findings_by_type", "select coalesce(event_type, 'ALL') as type, count(*)::bigint as total, count(*) filter (event_id % 10 = 0)::bigint as confirmed from events group by rollup (event_type)")
def findings_by_type(t):
    rows = t.events.select(F.col("event_type").alias("type"), F.when(F.col("event_id") % 10 == 0, "CONFIRMED").otherwise("CANDIDATE").alias("review"))
    return metrics.by_type(rows)


@query(
    "endpoint_report",
    """with n as (select o_custkey, count(*) as n from orders where o_orderdate >= timestamp '1998-01-01' and o_orderstatus = 'P' group by 1),
    s as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders where o_totalprice > 200000 group by 1)
    select c_custkey, coalesce(n.n, 0)::bigint as n_orders, coalesce(s.status, 'NOT_EXTRACTED') as status from customer left join n on n.o_custkey = c_custkey left join s on s.o_custkey = c_custkey""",
)
def endpoint_report(t):
    n = t.orders.where("o_orderdate >= timestamp '1998-01-01' and o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    s = t.orders.where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    both = t.customer.select("c_custkey").join(n, "c_custkey", "left").join(s, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("s", F.lit("NOT_EXTRACTED")).alias("status"))


@query("reviewed_findings", "select o_orderkey, case o_orderkey % 100 when 0 then 'CONFIRMED' when 1 then 'REJECTED' else 'CANDIDATE' end as review from orders")
def reviewed_findings(t):
    words = F.when(F.col("o_orderkey") % 100 == 0, " confirmed ").when(F.col("o_orderkey") % 100 == 1, "Rejected").otherwise("maybe")
    reviews = t.orders.where("o_orderkey % 100 < 3").select("o_orderkey", words.alias("status"))
    return metrics.reviewed(t.orders.select("o_orderkey"), reviews, "o_orderkey")


@query("finding_ids", "select doc_id, 'F-' || substr(sha256(source || '|' || doc_id || '|' || lang || '|' || sha256(text)), 1, 8) as id from documents")
def finding_ids(t):
    made = hashing.finding_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.array(hashing.sha256_text("text")))
    return t.documents.select("doc_id", made.alias("id"))


QUOTED = "replace(replace(replace(substr(text, 1, 60), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"


@query("evidence_canonical", f"""select doc_id, sha256('{{"file": null, "kind": "doc", "line": null, "page": ' || doc_id || ', "quote": "' || {QUOTED} || '", "snippet": null}}') as h from documents""")
def evidence_canonical(t):
    none = F.lit(None)
    ev = F.struct(F.lit("doc").alias("kind"), F.col("doc_id").alias("page"), F.substring("text", 1, 60).alias("quote"), none.cast("string").alias("file"), none.cast("int").alias("line"), none.cast("string").alias("snippet"))
    rows = t.documents.select("doc_id", ev.alias("ev"))
    return rows.select("doc_id", hashing.sha256_text(hashing.canonical_evidence(F.col("ev"))).alias("h"))


@query("manifest_upsert", "select r_regionkey, case when r_regionkey % 2 = 0 then r_name || '!' else r_name end as r_name, r_regionkey % 2 as stamp from region union all select 99, 'NEW', 0")
def manifest_upsert(t):
    old = t.region.select("r_regionkey", "r_name", F.lit(1).alias("stamp"))
    new = t.region.select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit("!"))).otherwise(F.col("r_name")).alias("r_name"), F.lit(0).alias("stamp"))
    new = new.unionByName(t.spark.createDataFrame([(99, "NEW", 0)], "r_regionkey int, r_name string, stamp int"))
    return loop.upsert(old, new, "r_regionkey", ["r_name"])


@query("determinism_check", f"select count(*) filter (event_id % 50 <> 0)::bigint as numerator, count(*)::bigint as denominator, {t_('count(*) filter (event_id % 50 <> 0)', 'count(*)')} as value from events")
def determinism_check(t):
    """Output rows of two runs by key: the second run spoils every fiftieth and leaves nothing else changed."""
    one = t.events.select("event_id", hashing.sha256_text("props").alias("a"))
    spoilt = F.when(F.col("event_id") % 50 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    two = t.events.select("event_id", hashing.sha256_text(spoilt).alias("b"))
    return metrics.rate_row(one.join(two, "event_id", "left"), "determinism", F.count_if(F.col("a").eqNullSafe(F.col("b"))), F.count("*")).select("numerator", "denominator", "value")


@query(
    "sarif_rows",
    """select event_id as id, event_type as rule, case event_type when 'error' then 'error' when 'view' then 'note' else 'warning' end as level, 'src/' || event_type || '.py' as file, (event_id % 100)::bigint as line from events where event_id % 2 = 0""",
)
def sarif_rows(t):
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "view", "info").otherwise("medium")
    item = lambda kind, file, line: F.struct(F.lit(kind).alias("kind"), file.alias("file"), line.alias("line"))
    file = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("src/"), "event_type", F.lit(".py")))
    evidence = F.array(item("doc", F.lit("spec"), F.lit(1).cast("long")), item("code", file, F.col("event_id") % 100), item("code", F.lit("late.py"), F.lit(0).cast("long")))
    evidence = F.when(F.col("event_id") % 2 == 0, evidence).otherwise(F.slice(evidence, 1, 2))
    rows = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), severity.alias("severity"), evidence.alias("evidence"))
    return metrics.sarif_rows(rows, {"high": "error", "medium": "warning", "low": "note", "info": "note"})


@query("protected_paths", f"select distinct {URL_PATH} as path from pages where starts_with({URL_PATH}, '/en/')")
def protected_paths(t):
    paths = t.pages.select(url_path(F.col("url")).alias("path"))
    changed, untracked = paths.where("path like '%1%'"), paths.where("path not like '%1%'")
    return changed.unionByName(untracked).distinct().where(F.col("path").startswith("/en/"))


@query("content_hash", "with d as (select source, sha256(text) as d from documents), p as (select source, d[1:3] as part, sha256(string_agg(d, ',' order by d)) as h from d group by 1, 2) select source, sha256(string_agg(h, ',' order by part)) as h from p group by 1")
def content_hash(t):
    """One hash a source, over the hashes of the parts of its sorted digests: no part grows beyond a 4,096th of a source."""
    rows = t.documents.select("source", hashing.sha256_text("text").alias("d"))
    joined = lambda c: hashing.sha256_text(F.array_join(c, ","))
    parts = rows.groupBy("source", F.left("d", F.lit(3)).alias("part")).agg(joined(F.array_sort(F.collect_list("d"))).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return parts.groupBy("source").agg(joined(ordered).alias("h"))
