"""Registered queries of the library's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import callgraph, deps, diff, history, implements, search, types
from codeloom.operators.relations import enclosing, file_lines, first_definitions, with_facts
from codeloom.plans import maintain
from codeloom.sources import adapters as A
from codeloom.sources.extract import parse_files, relations
from codeloom.sources.samples import SAMPLES

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FILES = r"""f0 as (select doc_id, text, source, case lang when 'en' then 'py' when 'fr' then 'js' when 'de' then 'go' when 'es' then 'md' else 'txt' end as ext from documents where text is not null),
f as (select coalesce(source, 'none') || '/' || case when source like '%7' and ext = 'py' then 'test_' || doc_id || '.py' when source like '%7' and ext = 'js' then doc_id || '.test.js'
  when source like '%7' and ext = 'go' then doc_id || '_test.go' else doc_id || '.' || ext end as path,
  case ext when 'py' then 'python' when 'js' then 'javascript' when 'go' then 'go' when 'md' then 'markdown' else 'unknown' end as language, text as content, strlen(text)::bigint as size,
  (source like '%7' and ext in ('py', 'js', 'go')) is true as is_test_file from f0)"""
_LINES = r"""l0 as (select path, case when content = '' then []::varchar[] else regexp_split_to_array(regexp_replace(content, '\r?\n\z', ''), '\r?\n') end as a from f),
l as (select path, generate_subscripts(a, 1)::int as line, unnest(a) as text from l0)"""
_SYMBOLS = r"""w as (select path, line, text, regexp_extract_all(text, '([A-Za-z]+)', 1) as w, max(line) over (partition by path) as last from l),
s as (select path, line as ordinal, w[1] as name, ['function','class','method','enum','static','heading','code_block','interface','type'][line % 9 + 1] as symbol_type,
  case when len(w) > 1 then '(' || w[2] || ')' end as signature, line as line_start, coalesce(lead(line) over (partition by path order by line) - 1, last)::int as line_end,
  regexp_matches(w[1], '^[A-Z]') as is_exported from w where len(w) > 0)"""
_CALLS = r"""c0 as (select path, line, text, unnest(range(2, len(w) + 1)) as p, w from w where len(w) > 1),
c as (select path, line, w[p] as call_name, min(p) as p, (line * 100000 + min(p) - 1)::int as ordinal, any_value(text) as context from c0 group by 1, 2, 3)"""
_FIRST = "d as (select name, arg_min(path, (path, ordinal)) as dpath, arg_min(ordinal, (path, ordinal)) as dordinal, arg_min(symbol_type, (path, ordinal)) as dtype, arg_min(line_start, (path, ordinal)) as dline, arg_min(coalesce(signature, ''), (path, ordinal)) as dsignature from s group by name)"
#: Test symbols by language; the adapted files know Python, JavaScript, Go and Markdown.
_TESTS = r"""ts as (select s.*, f.language, f.is_test_file, case language when 'python' then name like 'test\_%' escape '\' or name like 'Test%' when 'javascript' then name like 'test%' or name like 'Test%' or name in ('it', 'describe')
  when 'go' then name like 'Test%' or name like 'Benchmark%' else false end as is_test, (regexp_extract_all(l.text, '.*')[1]) as definition from s join f using (path) join l on l.path = s.path and l.line = s.line_start)"""
_ALL = "with " + ",\n".join((_FILES, _LINES, _SYMBOLS, _CALLS))
WORD = "The"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("A1_files_by_language", f"with {_FILES} select language, count(*) as files from f group by 1")
def _(spark, sf):
    return search.files_by_language(A.files(spark, sf))


@query("A2_symbols_by_type", f"with {_FILES}, {_LINES}, {_SYMBOLS} select t as symbol_type, count(s.name) as symbols from (select unnest(['function','class','method','enum','static','heading','code_block']) as t) left join s on s.symbol_type = t group by 1")
def _(spark, sf):
    return search.symbols_by_type(A.code(spark, sf)[2])


@query("A3_totals", f"with {_FILES}, {_LINES}, {_SYMBOLS} select (select count(*) from f) as files, (select coalesce(sum(size), 0)::bigint from f) as bytes, (select count(*) from s) as symbols")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return search.totals(f, s)


@query("A4_symbols_per_file", f"with {_FILES}, {_LINES}, {_SYMBOLS} select f.path, f.language, f.size, count(s.name) as symbol_count from f left join s on s.path = f.path group by 1, 2, 3")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return search.symbols_per_file(f, s)


@query("Q1_stats", f"""with {_FILES}, {_LINES}, {_SYMBOLS} select 'language' as metric, language as key, count(*) as value from f group by 2
union all select 'type', t, count(s.name) from (select unnest(['function','class','method','enum','static','heading','code_block']) as t) left join s on s.symbol_type = t group by 2
union all select 'total', 'files', count(*) from f union all select 'total', 'symbols', count(*) from s union all select 'total', 'bytes', coalesce(sum(size), 0)::bigint from f""")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return search.stats(f, s)


@query("S3_content_hash", f"with {_FILES} select path, 'sha256:' || sha256(content) as hash from f")
def _(spark, sf):
    return A.files(spark, sf).select("path", "hash")


@query("X14_lines", f"with {_FILES}, {_LINES} select * from l")
def _(spark, sf):
    return file_lines(A.files(spark, sf))


@query("S15_numbered_lines", f"with {_FILES}, {_LINES} select f.path, (select string_agg(lpad(line::varchar, greatest(4, length(line::varchar))::int, ' ') || ' | ' || text, chr(10) order by line) from l where l.path = f.path and line <= 2) as shown from f where (select count(*) from l where l.path = f.path) >= 2")
def _(spark, sf):
    f = A.files(spark, sf)
    return f.select("path", X.numbered(F.col("content"), F.lit(1), F.lit(2)).alias("shown")).filter(F.col("shown").isNotNull())


@query("F1_exact_search", f"with {_FILES}, {_LINES}, {_SYMBOLS} select path, ordinal, name, symbol_type from s where name = 'The'")
def _(spark, sf):
    return search.exact_search(A.code(spark, sf)[2], "The").select("path", "ordinal", "name", "symbol_type")


@query("F2_fuzzy_search", f"with {_FILES}, {_LINES}, {_SYMBOLS} select path, ordinal, name, (case when lower(name) = 'the' then 100 when lower(name) like 'the%' then 50 else 3 - length(name) end)::int as score from s where contains(lower(name), 'the')")
def _(spark, sf):
    return search.fuzzy_search(A.code(spark, sf)[2], "the").select("path", "ordinal", "name", "score")


@query("Q3_query_exported_functions", f"with {_FILES}, {_LINES}, {_SYMBOLS} select path, ordinal, name, symbol_type, (case when lower(name) = 'the' then 100 when lower(name) like 'the%' then 50 else 3 - length(name) end)::int as score from s where contains(lower(name), 'the') and symbol_type = 'function' and name <> 'anonymous' and is_exported")
def _(spark, sf):
    return search.query(A.code(spark, sf)[2], "the", symbol_type="function", exports_only=True).select("path", "ordinal", "name", "symbol_type", "score")


@query("Q3_query_top_20", f"with {_FILES}, {_LINES}, {_SYMBOLS} select path, ordinal, name, (case when lower(name) = 'the' then 100 when lower(name) like 'the%' then 50 else 3 - length(name) end)::int as score from s where contains(lower(name), 'the') order by score desc, path, ordinal limit 20")
def _(spark, sf):
    return search.query(A.code(spark, sf)[2], "the", full=True, limit=20).select("path", "ordinal", "name", "score")


@query("F4_plural_methods", f"with {_FILES}, {_LINES}, {_SYMBOLS} select path, ordinal, name from s where symbol_type = 'method' and name <> 'anonymous'")
def _(spark, sf):
    return search.query(A.code(spark, sf)[2], "methods").select("path", "ordinal", "name")


@query("S6_candidate_files", f"with {_FILES} select path from f where contains(lower(content), 'theand') and not contains(content, chr(0))")
def _(spark, sf):
    return search.candidate_files(A.files(spark, sf), "theand").select("path")


@query("F10_test_files", f"with {_FILES} select path, language, is_test_file from f")
def _(spark, sf):
    return A.files(spark, sf).select("path", "language", X.is_test_file(F.col("path")).alias("is_test_file"))


@query("X15_symbol_bodies", f"with {_FILES}, {_LINES}, {_SYMBOLS} select s.path, s.ordinal, string_agg(l.text, chr(10) order by l.line) as body from s join l on l.path = s.path and l.line between s.line_start and s.line_end group by 1, 2")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return search.with_bodies(s, f, cap=None).select("path", "ordinal", "body")


@query("A10_called_names", _ALL + " select distinct call_name from c")
def _(spark, sf):
    return A.code(spark, sf)[3].select("call_name").distinct()


@query("J1_enclosing_symbol", _ALL + " select c.path, c.line, c.call_name, s.name as enclosing, s.ordinal as enclosing_ordinal from c left join s on s.path = c.path and c.line between s.line_start and s.line_end")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    return enclosing(c.drop("context"), s).select("path", "line", "call_name", F.col("enc.sname").alias("enclosing"), F.col("enc.sordinal").alias("enclosing_ordinal"))


@query("J2_first_definitions", f"with {_FILES}, {_LINES}, {_SYMBOLS}, {_FIRST} select name, dpath as path, dordinal as ordinal, dtype as symbol_type from d")
def _(spark, sf):
    return first_definitions(A.code(spark, sf)[2]).select("name", "path", "ordinal", "symbol_type")


@query("J10_uses_of", f"with {_FILES}, {_LINES}, {_SYMBOLS} select l.path, l.line, l.text from l where contains(text, 'The') and exists (select 1 from s where name = 'The') and not exists (select 1 from s where s.path = l.path and s.name = 'The' and l.line between s.line_start and s.line_end)")
def _(spark, sf):
    _, ls, s, _ = A.code(spark, sf)
    return deps.uses_of(ls, s, "The")


_IMPORTS = "i as (select url as path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as import_name from pages)"


@query("J11_imports", f"with {_IMPORTS} select path, import_name from i")
def _(spark, sf):
    return A.imports(spark, sf).select("path", "import_name")


@query("J12_imported_by", f"with {_IMPORTS} select distinct path from i where contains(import_name, 'the')")
def _(spark, sf):
    return deps.imported_by(A.imports(spark, sf), "site/the")


@query("Q8_callers", _ALL + f""", h as (select path, line, arg_min(context, ordinal) as context from c where call_name = '{WORD}' group by 1, 2)
select coalesce(s.name, '<top-level>') as caller_name, coalesce(s.symbol_type, 'function') as caller_type, h.path, h.line, h.context from h left join s on s.path = h.path and h.line between s.line_start and s.line_end
where exists (select 1 from s where name = '{WORD}')""")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    return callgraph.callers(s, c, WORD)


@query("Q9_callees", _ALL + f""", {_FIRST}, b as (select c.path, c.call_name, c.line - s.line_start + 1 as rel_line, min(s.line_start) as sline, arg_min(c.context, (s.line_start, s.ordinal, c.ordinal)) as context from s join c on c.path = s.path and c.line between s.line_start and s.line_end where s.name = 'The' group by 1, 2, 3)
select call_name as callee_name, coalesce(dtype, 'function') as callee_type, coalesce(dpath, '<external>') as path, coalesce(dline, sline + rel_line)::int as line, case when d.name is not null then dsignature else context end as context from b left join d on d.name = b.call_name""")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    return callgraph.callees(s, c, "The")


@query("Q10_tests", _ALL + f""", {_TESTS}, h as (select path, line, arg_min(context, ordinal) as context from c where call_name = 'the' group by 1, 2)
select coalesce(t.name, '<test-file-level>') as test_name, coalesce(t.symbol_type, 'function') as test_type, h.path, coalesce(t.line_start, h.line) as line, h.line as call_line, h.context
from h join f on f.path = h.path left join ts t on t.path = h.path and h.line between t.line_start and t.line_end where f.is_test_file or coalesce(t.is_test, false)""")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.tests_of(s, c, f, "the")


_TESTED = "tested as (select call_name from c join f using (path) where is_test_file union select c.call_name from c join ts on ts.path = c.path and c.line between ts.line_start and ts.line_end where ts.is_test)"
_UNTESTED = "u as (select name, symbol_type, path, line_start as line, signature from ts where not is_test_file and not is_test and symbol_type not in ('heading', 'code_block') and not (language = 'python' and name like '\\_%' escape '\\') and name not in (select call_name from tested))"


@query("A11_tested_names", _ALL + f", {_TESTS}, {_TESTED} select * from tested")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.tested_names(s, c, f)


@query("Q11_untested", _ALL + f", {_TESTS}, {_TESTED}, {_UNTESTED} select * from u")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.untested(s, c, f)


@query("A6_coverage", _ALL + f", {_TESTS}, {_TESTED}, {_UNTESTED} select t.n as total, v.n as untested, case when t.n = 0 then 100.0::double else 100.0::double * (t.n - v.n) / t.n end as percent from (select count(*) as n from s) t, (select count(*) as n from u) v")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.coverage(s, callgraph.untested(s, c, f))


def _category() -> str:
    main = " or ".join([f"lower(name) in ({', '.join(repr(w) for w in X.MAIN_WORDS)})", *(f"starts_with(lower(name), '{w}_')" for w in X.MAIN_WORDS)])
    api = " or ".join(f"starts_with(lower(name), '{w}') or ends_with(lower(name), '{w}')" for w in X.API_WORDS)
    return f"case when {main} then 'main' when {api} or symbol_type in ('class', 'enum') or (symbol_type = 'function' and regexp_matches(name, '^[A-Z]')) then 'api' else 'unused' end"


_SEEN = "case language when 'python' then not starts_with(name, '_') when 'javascript' then contains(definition, 'export ') or contains(definition, 'module.exports') or contains(definition, 'exports.') when 'go' then regexp_matches(name, '^[A-Z]') else true end"
_POINTS = f"e as (select {_category()} as category, name, symbol_type, path, line_start as line, signature from ts where not is_test_file and not is_test and symbol_type not in ('heading', 'code_block') and ({_SEEN}) and name not in (select call_name from c))"


@query("Q12_entrypoints", _ALL + f", {_TESTS}, {_POINTS} select * from e")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.entrypoints(s, c, f)


@query("A7_entrypoints_by_category", _ALL + f", {_TESTS}, {_POINTS} select category, count(*) as entrypoints from e group by 1")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.by_category(callgraph.entrypoints(s, c, f))


@query("Q14_test_reach", _ALL + f""", {_TESTS}, {_FIRST}, t0 as (select c.path as test_file, call_name, min(line) as called_from_line from c join f using (path) where is_test_file group by 1, 2)
select test_file, call_name as name, dtype as symbol_type, dpath as path, dline as line, called_from_line from t0 join d on d.name = t0.call_name join ts on ts.path = d.dpath and ts.ordinal = d.dordinal where dpath <> test_file and not ts.is_test_file and not ts.is_test""")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.test_reach(s, c, f)


@query("G1_trace", """with p as (select o_orderkey, l.l_partkey as l_partkey, s_suppkey, n_nationkey from orders join customer on c_custkey = o_custkey join lineitem l on l_orderkey = o_orderkey join lineitem m on m.l_partkey = l.l_partkey join supplier on s_suppkey = m.l_suppkey
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where c_name = 'Customer#000000001' and r_name = 'MIDDLE EAST'
  order by lpad(o_orderkey::varchar, 10, '0'), lpad(l.l_partkey::varchar, 10, '0'), lpad(s_suppkey::varchar, 10, '0'), lpad(n_nationkey::varchar, 10, '0') limit 1)
select 1 as step, 'Customer#000000001' as name, 'function' as symbol_type, 'customer' as path, 2 as line from p union all select 2, 'order_' || o_orderkey, 'function', 'orders', (o_orderkey + 1)::int from p
union all select 3, 'part_' || l_partkey, 'function', 'part', (l_partkey + 1)::int from p union all select 4, s_name, 'function', 'supplier', (p.s_suppkey + 1)::int from p join supplier using (s_suppkey)
union all select 5, n_name, 'function', 'nation', (p.n_nationkey + 1)::int from p join nation using (n_nationkey) union all select 6, 'MIDDLE EAST', 'function', 'region', (select r_regionkey + 1 from region where r_name = 'MIDDLE EAST')::int from p""")
def _(spark, sf):
    s, c = A.graph(spark, sf)
    return callgraph.trace(s, c, "Customer#000000001", "MIDDLE EAST")


_STATES = """o as (select 'c' || o_custkey as path, o_orderpriority as name, o_orderdate < timestamp '1998-01-01' as early, count(*)::int as n, max(o_orderstatus) as signature from orders group by 1, 2, 3),
x as (select coalesce(a.path, b.path) as path, coalesce(a.name, b.name) as name, 'function' as symbol_type, a.n as old_end, b.n as new_end, a.signature as old_signature, b.signature as new_signature
  from (select * from o where early) a full join (select * from o where not early) b on a.path = b.path and a.name = b.name),
y as (select case when old_end is null then 'added' when new_end is null then 'deleted' when old_signature is distinct from new_signature then 'signature_changed' when old_end <> new_end then 'modified' end as change_type, * from x)"""
_FLAT = ("change_type", "path", "name", "symbol_type", "old_lines.end as old_end", "new_lines.end as new_end", "old_signature", "new_signature")


@query("Q16_diff", f"with {_STATES} select * from y where change_type is not null")
def _(spark, sf):
    return diff.diff(*A.order_states(spark, sf)).selectExpr(*_FLAT)


@query("Q17_breaking", f"with {_STATES} select * from y where change_type in ('deleted', 'signature_changed')")
def _(spark, sf):
    return diff.breaking(diff.compare_symbols(*A.order_states(spark, sf))).selectExpr(*_FLAT)


@query("A8_changes_by_type", f"with {_STATES} select change_type, count(*) as changes, count(distinct path) as files from y where change_type is not null group by 1")
def _(spark, sf):
    return diff.by_type(diff.diff(*A.order_states(spark, sf)))


_MANIFEST = """m as (select 'u' || user_id as path, ts < timestamp '2024-01-15' as early, 'p' || count(*) filter (event_type = 'purchase') as hash, count(*) as size, max(ts) as mtime from events group by 1, 2),
k as (select coalesce(a.path, b.path) as path, case when a.hash is null then 'added' when b.hash is null then 'deleted' when a.hash <> b.hash and (a.size <> b.size or a.mtime is distinct from b.mtime) then 'modified' end as kind
  from (select * from m where early) a full join (select * from m where not early) b on a.path = b.path)"""


@query("J8_manifest_changes", f"with {_MANIFEST} select * from k where kind is not null")
def _(spark, sf):
    return maintain.manifest_changes(*A.manifests(spark, sf))


@query("U5_merge", f"with {_MANIFEST} select a.path, a.hash from m a where early and not exists (select 1 from k where k.path = a.path and kind is not null) union all select b.path, b.hash from m b join k on k.path = b.path where not early and kind in ('added', 'modified')")
def _(spark, sf):
    old, new = A.manifests(spark, sf)
    changes = maintain.manifest_changes(old, new)
    fresh = new.join(changes.filter("kind <> 'deleted'"), "path", "left_semi")
    return maintain.merge(old.select("path", "hash"), fresh.select("path", "hash"), changes)


_EVENTS = """st as (select 'u' || user_id as path, (row_number() over (partition by user_id order by ts desc, event_id desc) - 1)::int as seq, event_id::varchar as hash, event_type <> 'error' as present,
  case when event_type in ('click', 'view') then 'read' when event_type = 'purchase' then 'write' end as signature, case when event_type <> 'error' then 1 end as line_start, case when event_type <> 'error' then floor(value / 50)::int + 1 end as line_end from events)"""


@query("Q18_blame", f"""with {_EVENTS}, n as (select *, lead(seq) over w as older, lead(present) over w as op, lead(signature) over w as og, lead(line_end) over w as oe from st where seq < 100 window w as (partition by path order by seq)),
d as (select *, older is not null and present and (not coalesce(op, false) or signature is distinct from og or line_end <> oe) as differs from n),
b as (select path, coalesce(min(seq) filter (differs), 0) as seq from d group by 1)
select d.path, d.seq, d.hash, case when differs then og end as old_signature, signature as new_signature, line_start, line_end from d join b on b.path = d.path and b.seq = d.seq""")
def _(spark, sf):
    return history.blame(A.event_states(spark, sf))


@query("Q19_history", f"""with {_EVENTS}, p as (select *, max(case when present then -seq end) over (partition by path order by seq desc rows between unbounded preceding and 1 preceding) as ps, lag(present) over (partition by path order by seq desc) as was from st),
r as (select p.*, q.signature as pg, q.line_end as pe, q.path is not null as had from p left join st q on q.path = p.path and q.seq = -p.ps),
k as (select * from r where (present and (not had or (not was and pg is not null) or signature is distinct from pg or line_end <> pe)) or (not present and coalesce(was, false) and pg is not null))
select path, (count(*) over (partition by path) - row_number() over (partition by path order by seq) + 1)::int as version, seq, hash, present as existed, signature, line_start, line_end from k""")
def _(spark, sf):
    return history.history(A.event_states(spark, sf))


@query("Q21_types", """with p as (select p_partkey::int as k, replace(p_brand, '#', '') as brand, p_type from part), b as (select distinct replace(p_brand, '#', '') as name, regexp_extract(p_brand, '(\\d+)', 1)::int + 1 as line from part)
select 'part_' || k as name, k + 1 as line, 'param' as kind, 0 as position, 'a' as param, 'List[' || brand || ']' as type, 'brands.py' as def_path, b.line as def_line from p join b on b.name = p.brand
union all select 'part_' || k, k + 1, 'param', 1, 'b', p_type, null, null from p
union all select 'part_' || k, k + 1, 'return', 2, null, 'Dict[str, ' || lower(brand) || ']', 'brands.py', b.line from p join b on b.name = p.brand""")
def _(spark, sf):
    return types.types_of(A.typed_symbols(spark, sf), "part_", fuzzy=True).select("name", "line", "kind", "position", "param", "type", "def_path", "def_line")


# Extraction runs over the library's own sample sources: the tables hold no code. The rows on the SQL
# side are written by hand from the rules of each language.


def _samples(spark: SparkSession) -> DataFrame:
    return with_facts(spark.createDataFrame(sorted(SAMPLES.items()), "path string, content string"))


def _values(rows: str, *names: str) -> str:
    return f"select * from (values {rows}) as v({', '.join(names)})"


_SYMBOL_ROWS = """('s.rs', 'Point', 'class', null, 2, 2, true), ('s.rs', 'Shape', 'enum', null, 3, 3, true), ('s.rs', 'Shape::Circle', 'enum', 'variant of Shape', 3, 3, true), ('s.rs', 'Shape::Square', 'enum', 'variant of Shape', 3, 3, true),
('s.rs', 'LIMIT', 'static', 'usize', 4, 4, false), ('s.rs', 'impl Point', 'class', null, 5, 8, false), ('s.rs', 'new', 'method', '(x: i32)', 6, 6, true), ('s.rs', 'show', 'method', '(&self)', 7, 7, false), ('s.rs', 'helper', 'function', '(v: i32)', 9, 9, false),
('s.go', 'User', 'class', 'struct', 7, 10, true), ('s.go', 'Runner', 'class', 'interface', 11, 11, true), ('s.go', 'Make', 'function', '(*User, error)', 16, 16, true), ('s.go', 'Rename', 'method', '(s string)', 17, 17, true), ('s.go', 'A', 'static', null, 12, 15, true), ('s.go', 'b', 'static', null, 12, 15, false),
('S.java', 'Box', 'class', null, 4, 10, true), ('S.java', 'Shape', 'class', null, 11, 11, false), ('S.java', 'Color', 'enum', null, 12, 12, false), ('S.java', 'MAX', 'static', 'int', 5, 5, false), ('S.java', 'name', 'method', '(int a)', 8, 8, true), ('S.java', 'later', 'method', '()', 9, 9, false), ('S.java', 'area', 'method', '(int k)', 11, 11, false), ('S.java', 'Box', 'method', '(int n)', 7, 7, true),
('s.c', 'Node', 'class', 'struct', 3, 3, false), ('s.c', 'sum', 'function', '(int a, int b)', 5, 5, false),
('s.py', 'Top', 'class', null, 4, 10, true), ('s.py', 'In', 'class', null, 9, 10, false), ('s.py', 'LIMIT', 'static', '3', 1, 11, true), ('s.py', 'run', 'method', '(self, k)', 8, 8, false), ('s.py', 'deep', 'method', '(self)', 10, 10, false), ('s.py', 'free', 'function', '(a, *b)', 11, 11, true),
('s.md', 'One', 'heading', 'h1 (#)', 1, 1, true), ('s.md', 'Three', 'heading', 'h3 (###)', 2, 2, true), ('s.md', 'Two', 'heading', 'h2 (##)', 3, 3, true), ('s.md', '[code: py]', 'code_block', 'py', 4, 9, true),
('s.js', 'A', 'class', null, 2, 2, true), ('s.js', 'f', 'function', '(a)', 3, 3, false), ('s.js', 'anonymous', 'function', '(a)', 3, 3, false), ('s.js', 'h', 'function', '(b)', 4, 4, false), ('s.js', 'go', 'method', '(k)', 2, 2, false)"""


@query("P1_P8_symbols", _values(_SYMBOL_ROWS, "path", "name", "symbol_type", "signature", "line_start", "line_end", "is_exported"))
def _(spark, sf):
    return relations(parse_files(_samples(spark)))["symbols"].select("path", "name", "symbol_type", "signature", "line_start", "line_end", "is_exported")


@query("P1_P8_imports", _values("('s.rs', 'std::fmt', null), ('s.go', 'fmt', null), ('s.go', 'os', null), ('S.java', 'java.util.List', null), ('s.c', 'stdio.h', null), ('s.c', 'own.h', null), ('s.py', 'os.path', null), ('s.py', 'c', 'a.b'), ('s.py', 'd', 'a.b'), ('s.js', 'lib', null)", "path", "import_name", "from_module"))
def _(spark, sf):
    return relations(parse_files(_samples(spark)))["imports"].select("path", "import_name", "from_module")


@query("P10_P15_calls", _values("('s.rs', 'helper', 6), ('s.rs', 'println', 7), ('s.rs', 'text', 7), ('s.rs', 'with', 7), ('s.rs', 'abs', 9), ('s.go', 'Println', 16), ('s.go', 'helper', 16), ('s.go', 'set', 17), ('S.java', 'init', 7), ('S.java', 'call', 8), ('S.java', 'trim', 8), ('s.c', 'printf', 5), ('s.c', 'add', 5), ('s.py', 'go', 8), ('s.py', 'helper', 11), ('s.py', 'x', 11), ('s.js', 'run', 2), ('s.js', 'g', 3), ('s.js', 'f', 4)", "path", "call_name", "line"))
def _(spark, sf):
    return relations(parse_files(_samples(spark)))["calls"].select("path", "call_name", "line")


@query("P16_P20_fields", _values("('s.rs', 0, 'x', 'i32', false), ('s.rs', 0, 'name', 'Option<String>', true), ('s.rs', 0, 'm', 'HashMap<K, V>', false), ('s.rs', 5, 'x', 'i32', false), ('s.rs', 5, 'name', 'Option<String>', true), ('s.rs', 5, 'm', 'HashMap<K, V>', false), ('s.go', 0, 'Name', 'string', false), ('s.go', 0, 'Nick', 'string', false), ('s.go', 0, 'Next', '*User', true), ('S.java', 0, 'MAX', 'int', false), ('S.java', 0, 'names', 'List<String>', false), ('s.py', 0, 'size', 'int', true), ('s.py', 0, 'note', 'Optional[str]', true)", "path", "symbol_ordinal", "name", "type", "optional"))
def _(spark, sf):
    return relations(parse_files(_samples(spark)))["fields"].select("path", "symbol_ordinal", "name", "type", "optional")


@query("P22_P26_implements", _values("('Point', 'Point', 'impl', 'rust', 's.rs', 5), ('Top', 'Base', 'inherits', 'python', 's.py', 4), ('A', 'B', 'extends', 'javascript', 's.js', 2), ('Box', 'Shape', 'implements', 'java', 'S.java', 4), ('Box', 'Base', 'extends', 'java', 'S.java', 4), ('User', 'Name,', 'implements', 'go', 's.go', 7), ('User', 'Next', 'implements', 'go', 's.go', 7)", "implementor", "interface", "kind", "language", "path", "line"))
def _(spark, sf):
    return implements.implementations(file_lines(_samples(spark)))


from codeloom.plans import queries_more  # noqa: E402, F401  its queries are registered here too
