"""Canonical relations read from tables that hold no code, so that the relational operators can be
checked against SQL on whole tables.

A document is a file: its language gives the extension, documents of sources that end in 7 are named as tests
are. Each line with a word defines a symbol (its first word) that lasts to the line before the
next; the other words of a line are calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.relations import file_lines, with_facts

_KINDS = ("function", "class", "method", "enum", "static", "heading", "code_block", "interface", "type")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    ext = F.coalesce(X.lookup({"en": "py", "fr": "js", "de": "go", "es": "md"}, F.col("lang")), F.lit("txt"))
    i = F.col("doc_id").cast("string")
    plain = F.concat_ws(".", i, ext)
    named = F.when(ext == "py", F.concat(F.lit("test_"), plain)).when(ext == "js", F.concat(i, F.lit(".test.js"))).when(ext == "go", F.concat(i, F.lit("_test.go"))).otherwise(plain)
    name = F.when(F.col("source").endswith("7"), named).otherwise(plain)
    return with_facts(d.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), name).alias("path"), F.col("text").alias("content")))


def symbols(lines: DataFrame) -> DataFrame:
    """Only a line's first two words go through the windows, not its text; both windows read one sort."""
    word = lambda before: F.regexp_extract("text", rf"\A{before}[^A-Za-z]*+([A-Za-z]++)", 1)
    own = Window.partitionBy("path").orderBy("line")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = lines.select("path", "line", word("").alias("name"), word("[^A-Za-z]*+[A-Za-z]++").alias("second"))
    w = w.withColumn("last", F.max("line").over(whole)).filter(F.col("name") != "")
    nxt = F.lead("line").over(own)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("line") % 9 + 1)
    none = lambda k: F.lit(None).cast(k)
    sig = F.when(F.col("second") != "", F.concat(F.lit("("), F.col("second"), F.lit(")")))
    return w.select("path", F.col("line").alias("ordinal"), "name", kind.alias("symbol_type"), sig.alias("signature"), none("string").alias("docstring"), F.col("line").alias("line_start"), F.coalesce(nxt - 1, "last").cast("int").alias("line_end"), none("int").alias("parent_ordinal"), F.col("name").rlike("^[A-Z]").alias("is_exported"))


def calls(lines: DataFrame) -> DataFrame:
    """A line's words after the first, each once, in their order; no shuffle."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    names = F.array_distinct(F.slice(words, 2, 2_000_000_000))
    w = lines.select("path", "line", F.posexplode(names).alias("pos", "call_name"), F.col("text").alias("context"))
    return w.select("path", (F.col("line") * 100_000 + F.col("pos")).cast("int").alias("ordinal"), "call_name", "line", "context")


def code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """files, lines, symbols, calls."""
    f = files(spark, sf_dir)
    ls = file_lines(f)
    return f, ls, symbols(ls), calls(ls)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages as imports, the url as path."""
    p = table(spark, sf_dir, "pages")
    refs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select(F.col("url").alias("path"), F.posexplode(refs).alias("ordinal", "import_name")).withColumn("from_module", F.lit(None).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """symbols and calls of customer -> order -> part -> supplier -> nation -> region."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def entity(name: str, key: str, label) -> DataFrame:
        k = F.col(key).cast("int")
        none = lambda kind: F.lit(None).cast(kind)
        return t[name].select(F.lit(name).alias("path"), k.alias("ordinal"), label.alias("name"), F.lit("function").alias("symbol_type"), none("string").alias("signature"), none("string").alias("docstring"), (k + 1).alias("line_start"), (k + 1).alias("line_end"), none("int").alias("parent_ordinal"), F.lit(True).alias("is_exported"))

    order, part = lambda c: F.concat(F.lit("order_"), F.col(c)), lambda c: F.concat(F.lit("part_"), F.col(c))
    nodes = [entity("region", "r_regionkey", F.col("r_name")), entity("nation", "n_nationkey", F.col("n_name")), entity("customer", "c_custkey", F.col("c_name")), entity("supplier", "s_suppkey", F.col("s_name")), entity("part", "p_partkey", part("p_partkey")), entity("orders", "o_orderkey", order("o_orderkey"))]

    def edge(df: DataFrame, path: str, key: str, callee, at: str) -> DataFrame:
        return df.select(F.lit(path).alias("path"), F.col(at).cast("int").alias("ordinal"), callee.alias("call_name"), (F.col(key) + 1).cast("int").alias("line"), F.lit("").alias("context"))

    li = t["lineitem"]
    edges = [
        edge(t["orders"], "customer", "o_custkey", order("o_orderkey"), "o_orderkey"),
        edge(li.select("l_orderkey", "l_partkey").distinct(), "orders", "l_orderkey", part("l_partkey"), "l_partkey"),
        edge(li.select("l_partkey", "l_suppkey").distinct().join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")), "part", "l_partkey", F.col("s_name"), "l_suppkey"),
        edge(t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", F.col("n_name"), "n_nationkey"),
        edge(t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")), "nation", "n_nationkey", F.col("r_name"), "r_regionkey"),
    ]
    s, c = nodes[0], edges[0]
    for x in nodes[1:]:
        s = s.unionByName(x)
    for x in edges[1:]:
        c = c.unionByName(x)
    return s, c


def order_states(spark: SparkSession, sf_dir: str, split: str = "1998-01-01") -> tuple[DataFrame, DataFrame]:
    """Symbols before and after a date: for each customer its order priorities, as long as there
    are orders, with the largest status as signature."""
    o = table(spark, sf_dir, "orders")

    def state(df: DataFrame) -> DataFrame:
        g = df.groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("path"), F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("signature"))
        return g.select("path", F.lit(1).alias("ordinal"), "name", F.lit("function").alias("symbol_type"), "signature", F.lit(1).alias("line_start"), F.col("n").cast("int").alias("line_end"))

    return state(o.filter(F.col("o_orderdate") < split)), state(o.filter(F.col("o_orderdate") >= split))


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as commits of one symbol; at errors it is absent."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())) - 1
    present = F.col("event_type") != "error"
    sig = F.when(F.col("event_type").isin("click", "view"), "read").when(F.col("event_type") == "purchase", "write")
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("path"), seq.cast("int").alias("seq"), F.col("event_id").cast("string").alias("hash"), present.alias("present"), F.when(present, F.lit("function")).alias("symbol_type"), F.when(present, sig).alias("signature"), F.when(present, F.lit(1)).alias("line_start"), F.when(present, F.floor(F.col("value") / 50).cast("int") + 1).alias("line_end"))


def manifests(spark: SparkSession, sf_dir: str, split: str = "2024-01-15") -> tuple[DataFrame, DataFrame]:
    """Users as files: before and after a date, purchases as hash, events as size, last time."""
    e = table(spark, sf_dir, "events")

    def state(df: DataFrame) -> DataFrame:
        return df.groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("path")).agg(F.concat(F.lit("p"), F.count_if(F.col("event_type") == "purchase")).alias("hash"), F.count(F.lit(1)).alias("size"), F.max("ts").alias("mtime"))

    return state(e.filter(F.col("ts") < split)), state(e.filter(F.col("ts") >= split))


def typed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions whose signature names brands and types, and each brand as a class."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_replace("p_brand", "#", "")
    none = lambda k: F.lit(None).cast(k)
    fn = p.select(F.lit("parts.py").alias("path"), F.col("p_partkey").cast("int").alias("ordinal"), F.concat(F.lit("part_"), F.col("p_partkey")).alias("name"), F.lit("function").alias("symbol_type"), F.concat(F.lit("(self, a: List["), brand, F.lit("] = None, b: "), F.col("p_type"), F.lit(") -> Dict[str, "), F.lower(brand), F.lit("]:")).alias("signature"), (F.col("p_partkey") + 1).cast("int").alias("line_start"))
    key = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    cl = p.select(brand.alias("name"), key.alias("k")).distinct().select(F.lit("brands.py").alias("path"), F.col("k").alias("ordinal"), "name", F.lit("class").alias("symbol_type"), none("string").alias("signature"), (F.col("k") + 1).alias("line_start"))
    both = fn.unionByName(cl)
    return both.select("path", "ordinal", "name", "symbol_type", "signature", none("string").alias("docstring"), "line_start", F.col("line_start").alias("line_end"), none("int").alias("parent_ordinal"), F.lit(True).alias("is_exported"))
