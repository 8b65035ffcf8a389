"""Command line: python -m codeloom.cli [--format F] COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from codeloom.engine import CodeIndex, search_tree
from codeloom.operators.render import FORMATS, render
from codeloom.operators.search import with_bodies
from codeloom.plans import maintain
from codeloom.session import build_session
from codeloom.sources.files import EXTENSIONS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--format", choices=FORMATS, default="default")
    p.add_argument("--cache-dir", default=os.environ.get("CODELOOM_CACHE_DIR"))
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, flags: tuple[str, ...] = (), limit: bool = False, path: bool = True):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("?"), **({"nargs": "?"} if a.endswith("?") else {}))
        if path:
            c.add_argument("path", nargs="?", default=".")
        c.add_argument("--extensions", default=",".join(EXTENSIONS))
        c.add_argument("--no-cache", action="store_true")
        c.add_argument("--rebuild-cache", action="store_true")
        for f in flags:
            c.add_argument(f, action="store_true")
        if limit:
            c.add_argument("--limit", type=int)
        return c

    add("stats")
    add("map").add_argument("--level", type=int, choices=(1, 2, 3), default=1)
    q = add("query", "symbol", flags=("--exact", "--show-body", "--fast", "--full", "--exports-only"), limit=True)
    q.add_argument("--type")
    q.add_argument("--context", choices=("minimal", "full"), default="minimal")
    add("inspect", "file", flags=("--show-body", "--full", "--exports-only"))
    add("deps", "target").add_argument("--direction", choices=("imports", "used-by"), default="imports")
    add("index")
    add("diff", "commit", flags=("--full",))
    add("since", "commit", flags=("--breaking",))
    add("callers", "symbol", flags=("--fuzzy",), limit=True)
    add("callees", "symbol", flags=("--fuzzy",), limit=True)
    add("tests", "symbol", flags=("--fuzzy",))
    add("untested")
    add("entrypoints")
    add("trace", "source", "target", flags=("--fuzzy",))
    add("impact", "symbol", flags=("--exact", "--include-docs", "--all"), limit=True)
    add("test-deps", "test_file")
    add("blame", "symbol", "file")
    add("history", "symbol", "file")
    add("implements", "interface", flags=("--fuzzy", "--trait-only"))
    add("types", "symbol", flags=("--fuzzy",))
    add("schema", "symbol", flags=("--fuzzy",))
    add("snapshot", "name?", flags=("--list",)).add_argument("--delete")
    add("compare", "snapshot")
    return p


def _index(spark, a) -> CodeIndex:
    root, ext = os.path.abspath(a.path), a.extensions.split(",")
    if not os.path.isdir(root):
        raise ValueError(f"{root} is no folder")
    if a.cache_dir is None or a.no_cache:
        return CodeIndex.of_tree(spark, root, tuple(ext))
    folder = os.path.join(a.cache_dir, maintain.cache_key(root, ext))
    if not a.rebuild_cache:
        return CodeIndex.refreshed(spark, folder, root, tuple(ext))
    index = CodeIndex.of_tree(spark, root, tuple(ext))
    index.save(folder)
    return CodeIndex.load(spark, folder, root, tuple(ext))


def run(argv: list[str], spark=None) -> str:
    a = parser().parse_args(argv)
    spark = spark or build_session(master=os.environ.get("SPARK_MASTER", "local[*]"))
    show = lambda kind, rows, **about: render(kind, rows, a.format, **about)
    snapshots = os.path.join(a.cache_dir or os.path.join(os.path.abspath(a.path), ".codeloom"), "snapshots")
    if a.command == "query" and not a.show_body and (a.fast or a.no_cache and a.cache_dir is None):
        return show("query", search_tree(spark, os.path.abspath(a.path), a.symbol, a.fast, a.exact, symbol_type=a.type, full=a.full, exports_only=a.exports_only, limit=a.limit), context=a.context == "full")
    if a.command == "snapshot" and a.list:
        return show("snapshots", maintain.list_snapshots(spark, snapshots))
    if a.command == "snapshot" and a.delete:
        return "deleted" if maintain.delete_snapshot(spark, snapshots, a.delete) else "no such snapshot"
    x = _index(spark, a)
    match a.command:
        case "stats":
            return show("stats", x.stats())
        case "map":
            rows = [] if a.level == 1 else x.map(a.level).collect()
            return show("map", rows if a.level > 1 or a.format == "ai" else x.stats(), level=a.level, stats=x.stats().collect())
        case "query":
            rows = x.query(a.symbol, exact=a.exact, symbol_type=a.type, full=a.full, exports_only=a.exports_only, limit=a.limit)
            return show("query", with_bodies(rows, x.files) if a.show_body else rows, context=a.context == "full", body=a.show_body)
        case "inspect":
            rows = x.inspect(a.file, full=a.full, exports_only=a.exports_only)
            file = x.files.filter(F.col("path") == a.file).select("language", "size").first()
            return show("inspect", with_bodies(rows, x.files).orderBy("ordinal") if a.show_body else rows, file=a.file, language=file["language"], size=file["size"], body=a.show_body)
        case "deps":
            return show("deps", x.imports_of(a.target) if a.direction == "imports" else x.used_by(a.target), target=a.target, direction=a.direction)
        case "index":
            return f"{x.files.count()} files, {x.symbols.count()} symbols"
        case "diff":
            return show("diff", x.diff(a.commit, a.full), commit=a.commit)
        case "since":
            return show("breaking" if a.breaking else "diff", x.since(a.commit, a.breaking), commit=a.commit)
        case "callers":
            return show("callers", x.callers(a.symbol, a.fuzzy, a.limit), query=a.symbol, **({} if a.limit is None else {"total": x.callers(a.symbol, a.fuzzy).count()}))
        case "callees":
            return show("callees", x.callees(a.symbol, a.fuzzy, a.limit), query=a.symbol, **({} if a.limit is None else {"total": x.callees(a.symbol, a.fuzzy).count()}))
        case "tests":
            return show("tests", x.tests(a.symbol, a.fuzzy), query=a.symbol)
        case "untested":
            return show("untested", x.untested(), total=x.symbols.count())
        case "entrypoints":
            return show("entrypoints", x.entrypoints())
        case "trace":
            return show("trace", x.trace(a.source, a.target, a.fuzzy), source=a.source, target=a.target)
        case "impact":
            parts = x.impact(a.symbol, exact=a.exact, include_docs=a.include_docs, limit=None if a.all else a.limit or 10)
            if "callers" not in parts:
                return f"no symbol {a.symbol}"
            return "\n\n".join([show("query", parts["target"]), show("callers", parts["callers"], query=a.symbol), show("tests", parts["tests"], query=a.symbol)])
        case "test-deps":
            return show("test_deps", x.test_deps(a.test_file), file=a.test_file)
        case "blame" | "history":
            rows = (x.blame if a.command == "blame" else x.history)(a.symbol, a.file)
            return show(a.command, rows, name=a.symbol)
        case "implements":
            return show("implements", x.implements(a.interface, a.fuzzy, a.trait_only), query=a.interface)
        case "types":
            return show("types", x.types(a.symbol, a.fuzzy))
        case "schema":
            return show("schema", x.schema(a.symbol, a.fuzzy))
        case "snapshot":
            name = a.name or "unnamed"
            x.snapshot(snapshots, name)
            return show("snapshot_saved", maintain.list_snapshots(spark, snapshots).filter(F.col("snapshot") == name))
        case "compare":
            rows = x.compare(snapshots, a.snapshot)
            return show("diff", rows, commit=maintain.list_snapshots(spark, snapshots).filter(F.col("snapshot") == a.snapshot).first()["commit"] or a.snapshot)
    raise AssertionError(a.command)


if __name__ == "__main__":
    try:
        print(run(sys.argv[1:]))
    except ValueError as e:
        sys.exit(f"codeloom: {e}")
