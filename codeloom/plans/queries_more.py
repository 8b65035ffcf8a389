"""More registered queries: listings, filters, schemas, snapshots, signatures and implementations over whole tables.

Where the tables hold no code, lines or signatures of source are written from their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import callgraph, diff, implements, search, types
from codeloom.operators.relations import file_lines, with_facts
from codeloom.plans import maintain
from codeloom.plans.queries import _ALL, _FILES, _FIRST, _FLAT, _LINES, _POINTS, _STATES, _SYMBOLS, _TESTS, _values, query
from codeloom.session import ensure_checkpoint_dir
from codeloom.sources import adapters as A
from codeloom.sources.extract import parse_files, relations
from codeloom.sources.files import indexable, scoped
from codeloom.sources.samples import MORE, SAMPLES

_BASE = f"with {_FILES}, {_LINES}, {_SYMBOLS}"


def _shared(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query("S5_indexable_files", f"with {_FILES} select count(*) as files from f where language <> 'unknown'")
def _(spark, sf):
    return indexable(A.files(spark, sf))


@query("F18_scope", f"with {_FILES} select path from f where starts_with(path, 'src1') and (path like '%.py' or path like '%.go') and string_split(path, '/')[1] <> 'src13'")
def _(spark, sf):
    return scoped(A.files(spark, sf).select("path"), ("py", "go"), ("src13", "py"), "src1")


@query("F9_fast_mode", f"{_BASE} select path, ordinal, name from s where contains(lower(name), 'the')")
def _(spark, sf):
    """Only files whose text holds the name are taken apart; the rows are those of the full scan."""
    some = search.candidate_files(A.files(spark, sf), "the")
    return search.query(A.symbols(file_lines(some)), "the", full=True).select("path", "ordinal", "name")


_QUALIFIED = "q as (select doc_id, case when doc_id % 2 = 0 then coalesce(source, 'x') || '::' || coalesce(lang, 'y') || '.z' || doc_id else coalesce(lang, 'y') || '.' || coalesce(source, 'x') || '.z' || doc_id end as name from documents)"


@query("F14_name_tails", f"with {_QUALIFIED} select doc_id, name, case when contains(name, '::') then string_split(name, '::')[-1] else string_split(name, '.')[-1] end as tail from q")
def _(spark, sf):
    d = A.table(spark, sf, "documents")
    source, lang, i = F.coalesce("source", F.lit("x")), F.coalesce("lang", F.lit("y")), F.concat(F.lit("z"), F.col("doc_id"))
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(source, F.lit("::"), lang, F.lit("."), i)).otherwise(F.concat_ws(".", lang, source, i))
    return d.select("doc_id", name.alias("name"), X.tail(name).alias("tail"))


@query("F15_qualified_callers", _ALL + """, h as (select path, line, arg_min(context, ordinal) as context from c where call_name = 'The' and contains(lower(regexp_replace(context, '\\s', '', 'g')), 'e.the') group by 1, 2)
select coalesce(s.name, '<top-level>') as caller_name, coalesce(s.symbol_type, 'function') as caller_type, h.path, h.line, h.context from h left join s on s.path = h.path and h.line between s.line_start and s.line_end
where exists (select 1 from s where name = 'The')""")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    return callgraph.callers(s, c, "e.The")


_HITS = "h as (select path, line, arg_min(context, ordinal) as context from c where call_name = 'The' group by 1, 2)"


@query("A16_totals_before_limit", _ALL + f""", {_HITS}, {_FIRST}, b as (select distinct c.path, c.call_name, c.line - s.line_start + 1 as rel_line from s join c on c.path = s.path and c.line between s.line_start and s.line_end where s.name = 'The')
select 'callers' as section, count(*) as total from h where exists (select 1 from s where name = 'The') union all select 'callees', count(*) from b""")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    return search.total(callgraph.callers(s, c, "The"), "callers").unionByName(search.total(callgraph.callees(s, c, "The"), "callees"))


@query("A5_symbol_lists", f"{_BASE} select f.path, f.language, f.size, count(s.name) as symbol_count, string_agg(s.ordinal || ':' || s.name || ':' || s.symbol_type || ':' || s.line_end, ' ' order by s.ordinal) as listed from f left join s on s.path = f.path group by 1, 2, 3")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    listed = F.array_join(F.transform("symbols", lambda x: F.concat_ws(":", x["ordinal"], x["name"], x["symbol_type"], x["line_end"])), " ")
    return search.file_map(f, s, 3).select("path", "language", "size", "symbol_count", F.when(F.col("symbols").isNotNull(), listed).alias("listed"))


@query("Q2_map_files", f"{_BASE} select f.path, f.language, f.size, count(s.name) as symbol_count from f left join s on s.path = f.path group by 1, 2, 3")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return search.file_map(f, s, 2)


@query("Q4_inspect", f"{_BASE} select path, ordinal, name, symbol_type, signature, line_start, line_end from s where path = (select min(path) from f) and name <> 'anonymous'")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    path = f.agg(F.min("path")).first()[0]
    return search.inspect(s, path, files=f).select("path", "ordinal", "name", "symbol_type", "signature", "line_start", "line_end")


@query("O9_capped_bodies", f"{_BASE} select s.path, s.ordinal, case when any_value(s.line_end - s.line_start) < 1 then string_agg(l.text, chr(10) order by l.line) end as body from s join l on l.path = s.path and l.line between s.line_start and s.line_end group by 1, 2")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return search.with_bodies(s, f, cap=1).select("path", "ordinal", "body")


@query("O3_first_entrypoints", _ALL + f", {_TESTS}, {_POINTS} select category, name, path, line from e order by case category when 'main' then 0 when 'api' then 1 else 2 end, path, line limit 40")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    return callgraph.in_order(callgraph.entrypoints(s, c, f)).limit(40).select("category", "name", "path", "line")


_IMPACT = """best as (select name, symbol_type from s where symbol_type not in ('heading', 'code_block') and contains(lower(name), 'the') order by (case when lower(name) = 'the' then 100 when lower(name) like 'the%' then 50 else 3 - length(name) end) desc, path, ordinal limit 1),
hb as (select path, line, arg_min(context, ordinal) as context from c where call_name = (select name from best) group by 1, 2),
who as (select coalesce(s.name, '<top-level>') as name, hb.path, hb.line from hb left join s on s.path = hb.path and hb.line between s.line_start and s.line_end),
tst as (select coalesce(t.name, '<test-file-level>') as name, hb.path, coalesce(t.line_start, hb.line) as line from hb join f on f.path = hb.path left join ts t on t.path = hb.path and hb.line between t.line_start and t.line_end where f.is_test_file or coalesce(t.is_test, false))"""


@query("Q15_impact", _ALL + f""", {_TESTS}, {_IMPACT} select 'caller' as section, name, path, line from who where name <> (select name from best) union all select 'test', name, path, line from tst
union all select 'untested', (select name from best), null, null where (select count(*) from tst) = 0 and (select symbol_type from best) in ('function', 'method')""")
def _(spark, sf):
    f, _, s, c = A.code(spark, sf)
    x = callgraph.impact(s, c, f, "the", limit=None)
    out = x["callers"].select(F.lit("caller").alias("section"), F.col("caller_name").alias("name"), "path", "line")
    out = out.unionByName(x["tests"].select(F.lit("test").alias("section"), F.col("test_name").alias("name"), "path", "line"))
    none = lambda k: F.lit(None).cast(k)
    lone = x["totals"].filter("is_untested").select(F.lit("untested").alias("section"), F.lit(x["best"]).alias("name"), none("string").alias("path"), none("int").alias("line"))
    return out.unionByName(lone)


_FIELDS = """fl as (select s.path, s.name, s.symbol_type, s.line_start as line, f.language, c.p - 2 as position, c.call_name as field, length(c.call_name)::varchar as type, contains(c.call_name, 'o') as optional
  from s join f using (path) join c on c.path = s.path and c.line = s.line_start where s.symbol_type in ('class', 'enum') and contains(lower(s.name), 'the'))"""


def _fields(calls: DataFrame) -> DataFrame:
    """The other words of a symbol's first line as its fields, their lengths as types."""
    at = F.expr("ordinal - line * 100000")
    return calls.select("path", F.col("line").alias("symbol_ordinal"), at.alias("ordinal"), F.col("call_name").alias("name"), F.char_length("call_name").cast("string").alias("type"), F.col("call_name").contains("o").alias("optional"), F.lit(None).cast("string").alias("default_value"))


@query("Q22_schema", _ALL + f", {_FIELDS} select path, name, symbol_type, line, language, row_number() over (partition by path, line order by position)::int as position, field, type, optional from fl")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    out = types.schema_of(s, _fields(c), "the", fuzzy=True)
    return out.select("path", "name", "symbol_type", "line", "language", F.posexplode("fields").alias("at", "f")).select("path", "name", "symbol_type", "line", "language", (F.col("at") + 1).alias("position"), "f.field", "f.type", "f.optional")


@query("A12_total_fields", _ALL + f", {_FIELDS} select count(*) as fields from fl")
def _(spark, sf):
    _, _, s, c = A.code(spark, sf)
    return types.total_fields(types.schema_of(s, _fields(c), "the", fuzzy=True))


@query("F8_classes", f"{_BASE} select path, ordinal, name, symbol_type from s where symbol_type in ('class', 'enum')")
def _(spark, sf):
    return types.classes(A.code(spark, sf)[2]).select("path", "ordinal", "name", "symbol_type")


# States with several rows a key: each order is a symbol of its customer's file, named by its priority.
_REPEATED = """o as (select 'c' || o_custkey as path, o_orderpriority as name, o_orderkey::int as ordinal, o_orderstatus as signature, (o_orderkey % 7 + 1)::int as line_start, (o_orderkey % 7 + o_orderkey % 3 + 1)::int as line_end, o_orderdate < timestamp '1996-01-01' as early from orders),
lst as (select path, name, arg_max(signature, ordinal) as old_signature, arg_max(line_start, ordinal) as old_start, arg_max(line_end, ordinal) as old_end from o where early group by 1, 2),
r as (select case when lst.path is null then 'added' when o.signature is distinct from old_signature then 'signature_changed' when o.line_start <> old_start or o.line_end <> old_end then 'modified' end as change_type, o.path, o.name, old_start, old_end, o.line_start as new_start, o.line_end as new_end, old_signature, o.signature as new_signature
  from o left join lst on lst.path = o.path and lst.name = o.name where not early
  union all select 'deleted', o.path, o.name, line_start, line_end, null, null, signature, null from o where early and not exists (select 1 from o n where not n.early and n.path = o.path and n.name = o.name))"""


def _repeated_states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("path"), k.cast("int").alias("ordinal"), F.col("o_orderpriority").alias("name"), F.lit("function").alias("symbol_type"), F.col("o_orderstatus").alias("signature"), (k % 7 + 1).cast("int").alias("line_start"), (k % 7 + k % 3 + 1).cast("int").alias("line_end"), (F.col("o_orderdate") < "1996-01-01").alias("early"))
    return rows.filter("early").drop("early"), rows.filter("not early").drop("early")


@query("J6_repeated_keys", f"with {_REPEATED} select * from r where change_type is not null")
def _(spark, sf):
    out = diff.compare_symbols(*_repeated_states(spark, sf))
    return out.selectExpr("change_type", "path", "name", "old_lines.start as old_start", "old_lines.end as old_end", "new_lines.start as new_start", "new_lines.end as new_end", "old_signature", "new_signature")


@query("Q24_compare_snapshot", f"with {_STATES} select * from y where change_type is not null")
def _(spark, sf):
    """The earlier state is saved as a snapshot, read back and compared."""
    old, new = A.order_states(spark, sf)
    folder = _shared(spark, "snapshots")
    maintain.save_snapshot(old, folder, "before")
    maintain.save_snapshot(new, folder, "after")
    return diff.compare_symbols(maintain.load_snapshot(spark, folder, "before"), new).selectExpr(*_FLAT)


@query("Q23_snapshots", f"with {_STATES} select 'after' as snapshot, 'c2' as commit, (select count(distinct path) from y where new_end is not null) as files, (select count(*) from y where new_end is not null) as symbols union all select 'before', 'c1', (select count(distinct path) from y where old_end is not null), (select count(*) from y where old_end is not null)")
def _(spark, sf):
    old, new = A.order_states(spark, sf)
    folder = _shared(spark, "snapshots")
    maintain.save_snapshot(old, folder, "before", "c1")
    maintain.save_snapshot(new, folder, "after", "c2")
    return maintain.list_snapshots(spark, folder)


@query("M7_inconsistent", f"with {_STATES}, a as (select path, case when max(signature) = 'P' then '' else max(signature) end as hash from o where early group by 1), b as (select distinct path from o where not early) select coalesce(a.path, b.path) as path from a full join b on a.path = b.path where a.path is null or b.path is null or a.hash = ''")
def _(spark, sf):
    old, new = A.order_states(spark, sf)
    hashed = old.groupBy("path").agg(F.max("signature").alias("hash")).withColumn("hash", F.when(F.col("hash") == "P", "").otherwise(F.col("hash")))
    return maintain.inconsistent(hashed, new.select("path").distinct())


@query("A17_manifest_counts", f"{_BASE} select (select count(*) from f) as files, (select count(*) from s) as symbols")
def _(spark, sf):
    f, _, s, _ = A.code(spark, sf)
    return maintain.counts(f, s)


@query("M1_validation", """with m as (select 'u' || user_id as path, ts < timestamp '2024-01-15' as early, 'p' || count(*) filter (event_type = 'purchase') as hash, (count(*) % 3)::bigint as size, date_trunc('week', max(ts)) as mtime from events group by 1, 2)
select b.path, case when a.path is null then 'new' when a.size <> b.size or a.mtime is distinct from b.mtime then 'touched' else 'same' end as state from (select * from m where not early) b left join (select * from m where early) a on a.path = b.path""")
def _(spark, sf):
    """Which files must be hashed: those of another size or time, before any content is read."""
    e = A.table(spark, sf, "events")
    state = lambda d: d.groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("path")).agg((F.count(F.lit(1)) % 3).alias("size"), F.date_trunc("week", F.max("ts")).alias("mtime"))
    return maintain.touched(state(e.filter(F.col("ts") < "2024-01-15")), state(e.filter(F.col("ts") >= "2024-01-15"))).select("path", "state")


# Marks of tests: a customer is a file, each of its orders four lines and a symbol that begins at the third.
_MARKED = """o as (select o_custkey as c, o_orderkey as k, o_orderstatus as st, o_orderpriority as p, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select 'c' || c || case when c % 2 = 0 then '.rs' else '.java' end as path, case when k % 5 = 0 then 'test_' else 'order_' end || k as name, p[1] <> '2' and st = 'F' as marked,
  (p[1] <> '2' and st = 'F') or (k % 5 = 0) as is_test from o"""


@query("W8_test_marks", f"with {_MARKED}")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    rust = F.col("o_custkey") % 2 == 0
    mark = F.when(F.col("o_orderstatus") == "F", F.when(rust, "#[test]").otherwise("@Test")).otherwise(F.when(rust, "#[a]").otherwise("@A"))
    between = F.when(F.col("o_orderpriority").startswith("2"), "stop();").when(F.col("o_orderpriority").startswith("3"), "").otherwise("  // note")
    name = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "test_").otherwise("order_"), F.col("o_orderkey"))
    own = F.struct(F.col("o_orderkey").alias("k"), F.concat_ws("\n", mark, between, F.when(rust, "#[b]").otherwise("@B"), F.concat(F.lit("fn "), name, F.lit("() {}"))).alias("t"), name.alias("name"))
    path = F.concat(F.lit("c"), F.col("o_custkey"), F.when(rust, ".rs").otherwise(".java"))
    files = o.groupBy(path.alias("path")).agg(F.array_sort(F.collect_list(own)).alias("own"))
    content = with_facts(files.select("path", F.array_join(F.transform("own", lambda x: x["t"]), "\n").alias("content")))
    line = (F.col("i") * 4 + 3).cast("int")
    none = lambda k: F.lit(None).cast(k)
    symbols = files.select("path", F.posexplode("own").alias("i", "x")).select("path", F.col("i").alias("ordinal"), F.col("x.name").alias("name"), F.lit("function").alias("symbol_type"), none("string").alias("signature"), none("string").alias("docstring"), line.alias("line_start"), (line + 1).alias("line_end"), none("int").alias("parent_ordinal"), F.lit(True).alias("is_exported"))
    d = callgraph.definition_lines(symbols, content)
    return d.select("path", "name", "marked", X.is_test_symbol(F.col("name"), F.col("language"), F.col("marked")).alias("is_test"))


# Signatures in five languages, written from the parts.
_SIGNED = {
    "rust": (".rs", "(&self, a: &mut Vec<{b}>, c: {n}) -> Option<{b}>", [("a", "&mut Vec<{b}>"), ("c", "{n}")], "Option<{b}>"),
    "typescript": (".ts", "(this, a?: {b}, c: string = 'x'): Map<string, {b}>", [("a", "{b}"), ("c", "string")], "Map<string, {b}>"),
    "go": (".go", "(a {b}, c map[string]{n}) (*{b}, error)", [("a", "{b}"), ("c", "map[string]{n}")], "(*{b}, error)"),
    "java": (".java", "List<{b}> make(final {b} a, @Nullable Map<String, {n}> c)", [("a", "{b}"), ("c", "Map<String, {n}>")], "List<{b}>"),
    "c": (".c", "{b} *make(struct {n} *a, int c)", [("a", "struct {n}*"), ("c", "int")], "{b} *"),
}


def _sql_text(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{b}", "' || brand || '").replace("{n}", "' || 'N' || k || '") + "'"


_SIGNED_SQL = "with p as (select p_partkey as k, replace(p_brand, '#', '') as brand from part) " + " union all ".join(
    f"select '{lang}' as language, k, {i}::int as position, {_sql_text(name)} as param, {_sql_text(kind)} as type from p"
    for lang, (_, _, params, result) in _SIGNED.items()
    for i, (name, kind) in enumerate([*params, ("", result)])
)


@query("X7_X13_signatures", _SIGNED_SQL)
def _(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace("p_brand", "#", "").alias("b"), F.concat(F.lit("N"), F.col("p_partkey")).alias("n"))
    out = None
    for lang, (ext, sig, _, _) in _SIGNED.items():
        pieces = F.lit(sig)
        for c in ("b", "n"):
            pieces = F.replace(pieces, F.lit(f"{{{c}}}"), F.col(c))
        own = p.select(F.lit(lang).alias("language"), "k", F.concat(F.lit("p"), F.lit(ext)).alias("path"), pieces.alias("signature"))
        out = own if out is None else out.unionByName(own)
    t = types.signature_types(out)
    rows = F.concat("params", F.array(F.struct(F.lit("").alias("name"), F.col("return_type").alias("type"))))
    return t.select("language", "k", F.posexplode(rows).alias("position", "r")).select("language", "k", "position", F.col("r.name").alias("param"), F.col("r.type").alias("type"))


# Lines of five languages, written from the parts: brand B, part N.
_CODE = {
    "rs": ["impl <T> {b}<T> for {n} {", "    impl {n} {", "impl fmt for x"],
    "py": ["class {n}({b}, mod.Base[int]):", "class Plain:"],
    "ts": ["export class {n} extends {b} implements Shape, Other<{b}> {", "class {n}<T> extends {b} {"],
    "java": ["public class {n} implements {b}, Comparable<{n}> {", "interface {n} extends {b}, Closeable {"],
    "go": ["type {n} struct {", "  {b}", "  Inner struct { x int }", "  field {n}", "}", "  {b}"],
}
_FOUND = {
    "rs": [("{n}", "{b}", "impl", 1), ("{n}", "{n}", "impl", 2), ("x", "fmt", "impl", 3)],
    "py": [("{n}", "{b}", "inherits", 1), ("{n}", "Base", "inherits", 1)],
    "ts": [("{n}", "Shape", "implements", 1), ("{n}", "Other", "implements", 1), ("{n}", "{b}", "extends", 1), ("{n}", "{b}", "extends", 2)],
    "java": [("{n}", "{b}", "implements", 1), ("{n}", "Comparable", "implements", 1), ("{n}", "{b}", "extends", 2), ("{n}", "Closeable", "extends", 2)],
    "go": [("{n}", "{b}", "implements", 1), ("{n}", "Inner", "implements", 1), ("{n}", "field", "implements", 1)],
}
_IMPLEMENTED = "p as (select p_partkey as k, replace(p_brand, '#', '') as brand from part), im as (" + " union all ".join(
    f"select {_sql_text(a)} as implementor, {_sql_text(i)} as interface, '{kind}' as kind, '{X.LANGUAGES[ext]}' as language, 'p' || k || '.{ext}' as path, {line}::int as line from p" for ext, found in _FOUND.items() for a, i, kind, line in found
) + ")"


def _code_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace("p_brand", "#", "").alias("b"))
    n = F.concat(F.lit("N"), F.col("k"))
    text = lambda t: F.replace(F.replace(F.lit(t), F.lit("{b}"), F.col("b")), F.lit("{n}"), n)
    files = F.array(*(F.struct(F.lit(ext).alias("ext"), F.array(*map(text, ls)).alias("ls")) for ext, ls in _CODE.items()))
    return p.select("k", F.inline(files)).select(F.concat(F.lit("p"), F.col("k"), F.lit("."), F.col("ext")).alias("path"), F.posexplode("ls").alias("i", "text")).select("path", (F.col("i") + 1).cast("int").alias("line"), "text")


@query("P22_P26_implementations", f"with {_IMPLEMENTED} select * from im")
def _(spark, sf):
    return implements.implementations(_code_lines(spark, sf))


@query("Q20_implements_fuzzy", f"with {_IMPLEMENTED} select * from im where contains(lower(interface), 'brand1') or (language = 'rust' and contains(lower(implementor), 'brand1'))")
def _(spark, sf):
    return implements.implements(_code_lines(spark, sf), "brand1", fuzzy=True)


@query("F17_trait_only", f"with {_IMPLEMENTED} select * from im where (contains(lower(interface), 'n1') or (language = 'rust' and contains(lower(implementor), 'n1'))) and implementor <> interface")
def _(spark, sf):
    return implements.implements(_code_lines(spark, sf), "n1", fuzzy=True, trait_only=True)


# Extraction of the samples, with what the first queries leave out; the rows are written by hand.

_MORE_ROWS = """('s.ts', 0, 'Box', 'class', null, 6, 6, true), ('s.ts', 1, 'make', 'function', '(x: number)', 7, 7, true), ('s.ts', 2, 'anonymous', 'function', '(x: number)', 7, 7, true), ('s.ts', 3, 'plain', 'function', '(a, b)', 8, 8, false),
('s.ts', 4, 'describe:box', 'function', '()', 9, 9, false), ('s.ts', 5, 'test:works', 'function', '()', 9, 9, false), ('s.ts', 6, 'get', 'method', '(k: string)', 6, 6, false), ('s.ts', 7, 'Shape', 'interface', null, 3, 3, true), ('s.ts', 8, 'Id', 'type', null, 4, 4, false), ('s.ts', 9, 'Color', 'enum', null, 5, 5, false),
('t.rs', 0, 'N', 'static', 'u8', 6, 6, true), ('t.rs', 1, 'impl Point', 'class', null, 3, 5, false), ('t.rs', 2, 'draw', 'method', '(&self)', 4, 4, false),
('n.md', 0, 'A', 'heading', 'h1 (#)', 2, 2, true), ('n.md', 1, 'B', 'heading', 'h3 (###)', 4, 4, true), ('n.md', 2, 'C', 'heading', 'h2 (##)', 5, 5, true), ('n.md', 3, 'D', 'heading', 'h1 (#)', 6, 6, true), ('n.md', 4, '[code: js]', 'code_block', 'js', 7, 9, true)"""


def _parsed(spark: SparkSession, samples: dict[str, str]) -> dict[str, DataFrame]:
    return relations(parse_files(with_facts(spark.createDataFrame(sorted(samples.items()), "path string, content string"))))


@query("P3_more_symbols", _values(_MORE_ROWS, "path", "ordinal", "name", "symbol_type", "signature", "line_start", "line_end", "is_exported"))
def _(spark, sf):
    return _parsed(spark, MORE)["symbols"].select("path", "ordinal", "name", "symbol_type", "signature", "line_start", "line_end", "is_exported")


@query("P3_more_imports", _values("('s.ts', 'lib'), ('s.ts', 'fs')", "path", "import_name"))
def _(spark, sf):
    return _parsed(spark, MORE)["imports"].select("path", "import_name")


@query("P18_script_fields", _values("('s.ts', 0, 'n', 'number', false, '1'), ('s.ts', 0, 'name', 'string', true, null)", "path", "symbol_ordinal", "name", "type", "optional", "default_value"))
def _(spark, sf):
    return _parsed(spark, MORE)["fields"].select("path", "symbol_ordinal", "name", "type", "optional", "default_value")


_DETAILS = """('S.java', 0, 'Box', '/** Doc. */', null), ('S.java', 1, 'Shape', '/** Doc. */', null), ('S.java', 2, 'Color', '/** Doc. */', null), ('S.java', 3, 'MAX', null, 0), ('S.java', 4, 'name', null, 0), ('S.java', 5, 'later', null, 0), ('S.java', 6, 'area', null, 1), ('S.java', 7, 'Box', null, 0),
('n.md', 1, 'B', null, 0), ('n.md', 2, 'C', null, 1), ('n.md', 4, '[code: js]', 'x', null), ('s.c', 1, 'sum', '/* sums */', null), ('s.go', 0, 'User', '// User is one.', null),
('s.md', 1, 'Three', null, 0), ('s.md', 2, 'Two', null, 1), ('s.md', 3, '[code: py]', '# no' || chr(10) || 'a' || chr(10) || 'b...', null), ('s.py', 0, 'Top', '"doc"', null), ('s.py', 1, 'In', null, 0), ('s.py', 3, 'run', null, 0), ('s.py', 4, 'deep', null, 1),
('s.rs', 6, 'new', null, 5), ('s.rs', 7, 'show', null, 5), ('t.rs', 2, 'draw', null, 1)"""


@query("J13_parents_and_docs", _values(_DETAILS, "path", "ordinal", "name", "docstring", "parent_ordinal"))
def _(spark, sf):
    """Every symbol with a parent or a doc text; the others of the samples have neither."""
    s = _parsed(spark, SAMPLES | MORE)["symbols"]
    return s.filter("docstring is not null or parent_ordinal is not null").select("path", "ordinal", "name", "docstring", "parent_ordinal")
