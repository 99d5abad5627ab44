"""DuckDB SQL for the queries of this subpackage that SQL can express.

Not among them: op1 (every 400-byte substring), op2 (positions and a tokenizer), op4 (training), op6 (a tokenizer), op10 and
the pipeline (hash-driven draws). Tests compare those with brute force, held-out labels or an exact round trip.
"""

from .quality import STOP_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"'[\x20\x09-\x0D]+'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {SPLIT}), lambda w: w <> '')"


def shingles(w: str) -> str:
    """The distinct five-word shingles of a word list; one to four words are one shingle."""
    each = f"list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' '))"
    return f"list_distinct(case when len({w}) >= 5 then {each} when len({w}) > 0 then [array_to_string({w}, ' ')] else []::varchar[] end)"


FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP3 = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as hex, max(page_id) over (partition by h) as top from p)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
((((position(substr(hex, 1 + (5 * i) // 4, 1) in '0123456789abcdef') - 1) * 16 + position(substr(hex, 2 + (5 * i) // 4, 1) in '0123456789abcdef') - 1) >> (3 - (5 * i) % 4)) & 31)::int, 1)), '') as payload_digest,
case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from d"""

OP5 = f"""with d as (select doc_id, {words(FOLDED)} as w from documents), b as (select item_id, {words(FOLDED)} as w from benchmark),
ds as (select doc_id, unnest({shingles('w')}) as g from d), bs as (select item_id, unnest(s) as g, len(s)::bigint as n from (select item_id, {shingles('w')} as s from b))
select doc_id, item_id, n as n_item_shingles, count(*)::bigint as n_shared, count(*)::double / n as containment from ds join bs using (g) group by doc_id, item_id, n having 100 * count(*) >= 80 * n"""

OP7 = f"""with recursive d as (select doc_id, {words(FOLDED)} as w from documents), s as (select doc_id, {shingles('w')} as s from d),
g as (select doc_id, len(s) as n, unnest(s) as g from s), links as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
having 100 * count(*) >= 80 * (a.n + b.n - count(*))), reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, m.c as component_id from s join (select a, min(b) as c from reach group by 1) m on m.a = s.doc_id"""

OP8 = f"""with t as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, t, {words('t')} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by 1),
c as (select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
(len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, len(list_filter(w, lambda x: lower(x) in ({', '.join(repr(x) for x in dict.fromkeys(STOP_WORDS))})))::bigint as n_stop,
len(list_filter(l, lambda x: length(x) > 4000)) as n_long from w left join cov on cov.doc_id = w.doc_id), f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and word_chars / greatest(n_words, 1) between 1.5 and 20 and n_symbols / greatest(word_chars, 1) <= 0.3
and n_stop / greatest(n_words, 1) >= 0.01 and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_long / greatest(n_lines, 1) <= 0.9 as kept, n_lines, n_stop from f"""

OP9 = f"""with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos, unnest(string_split(lower(coalesce(text, '')), chr(10))) as line from documents),
w as (select doc_id, pos, {words('line')} as w from l), s as (select doc_id, pos, {shingles('w')} as s from w where len(w) > 0), c as (select min((doc_id, pos)) as fst, list_sort(s) as k, len(s) as n from s group by 2, 3),
g as (select fst, n, unnest(k) as g from c), gone as (select distinct b.fst from g a join g b on a.g = b.g and a.fst < b.fst group by a.fst, b.fst, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r as (select s.doc_id, s.pos from s join c on list_sort(s.s) = c.k left join gone on gone.fst = c.fst where (s.doc_id, s.pos) > c.fst or gone.fst is not null),
per as (select doc_id, count(*) as n, string_agg(pos::varchar, ',' order by pos) as p from r group by 1)
select d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::bigint as n_lines, coalesce(per.n, 0)::bigint as n_removed, coalesce(per.p, '') as removed from documents d left join per on per.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": OP3, "op5_benchmark_decontamination": OP5, "op7_ngram_jaccard_join": OP7, "op8_quality_rules": OP8, "op9_line_dedup": OP9,
    }
