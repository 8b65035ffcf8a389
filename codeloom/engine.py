"""One object over a source tree: its relations and every query of the library."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import callgraph, deps, diff, history, implements, search, types
from codeloom.operators.relations import file_lines
from codeloom.plans import maintain
from codeloom.session import cut
from codeloom.sources import git
from codeloom.sources.extract import parse_files, relations
from codeloom.sources.files import EXTENSIONS, listing, read_files, scan_tree, scoped

#: From so many files on a search looks at text before it parses.
FAST_FILES = 1000


class CodeIndex:
    """files, symbols, imports, calls and fields of a tree.

    The relations are parsed once and written to the shared folder; every query is a plan over them.
    """

    def __init__(self, files: DataFrame, tables: dict[str, DataFrame], root: str | None = None, extensions: tuple[str, ...] = EXTENSIONS):
        self.files, self.root, self.extensions = files, root, extensions
        self.symbols, self.imports, self.calls, self.fields = (tables[k] for k in ("symbols", "imports", "calls", "fields"))
        self.lines = file_lines(files)

    @classmethod
    def of_files(cls, files: DataFrame, root: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> CodeIndex:
        return cls(files, relations(cut(parse_files(files))), root, extensions)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> CodeIndex:
        return cls.of_files(cut(scan_tree(spark, root, extensions)), root, extensions)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, root: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> CodeIndex:
        t = maintain.load_index(spark, folder)
        return cls(t.pop("files"), t, root, extensions)

    def save(self, folder: str) -> None:
        """Write the index as a new generation, its manifest last; a manifest that disagrees with the files is an error."""
        spark = self.files.sparkSession
        facts = self.files.select("path", "hash")
        if self.root is None:
            manifest = self.files.select("path", "hash", "size", F.lit(None).cast("timestamp").alias("mtime"))
        else:  # the hash of what was read with the listed size and time
            manifest = listing(spark, self.root, self.extensions).join(facts, "path")
        manifest = cut(manifest)
        maintain.save_index({"files": self.files, "symbols": self.symbols, "imports": self.imports, "calls": self.calls, "fields": self.fields}, folder, manifest)

    @classmethod
    def refreshed(cls, spark: SparkSession, folder: str, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> CodeIndex:
        """The saved index brought up to date with the tree and saved again.

        Sizes and times come from a listing; only files where these differ are read, and only those whose
        hash differs are parsed. Without a usable index, or after many changes, the tree is read whole.
        """
        old = maintain.load_manifest(spark, folder)
        if old is None:
            out = cls.of_tree(spark, root, extensions)
            out.save(folder)
            return out
        now = cut(listing(spark, root, extensions))
        some = maintain.touched(old, now).filter("state <> 'same'").select("path").limit(maintain.FULL_AT_LEAST + 1).collect()
        gone = old.join(now, "path", "left_anti").select("path", F.lit("deleted").alias("kind"))
        n = len(some) + gone.count()
        saved = cls.load(spark, folder, root, extensions)
        if n == 0:
            return saved
        if maintain.needs_full_rebuild(n, now.count()):
            out = cls.of_tree(spark, root, extensions)
        else:
            texts = cut(read_files(spark, root, [r["path"] for r in some], extensions)) if some else saved.files.limit(0)
            known = old.select("path", F.col("hash").alias("was"))
            kind = F.when(F.col("was").isNull(), "added").when(F.col("was") != F.col("hash"), "modified")
            # a file that was text and no longer is counts as deleted
            lost = known.select("path").join(spark.createDataFrame([(r["path"],) for r in some], "path string"), "path", "left_semi").join(texts, "path", "left_anti").select("path", F.lit("deleted").alias("kind"))
            changes = cut(texts.join(known, "path", "left").select("path", kind.alias("kind")).filter("kind is not null").unionByName(gone).unionByName(lost))
            new = texts.join(changes, "path", "left_semi")
            fresh = relations(cut(parse_files(new)))
            tables = {k: maintain.merge(getattr(saved, k), fresh[k], changes) for k in ("symbols", "imports", "calls", "fields")}
            out = cls(maintain.merge(saved.files, new, changes), tables, root, extensions)
        out.save(folder)
        return cls.load(spark, folder, root, extensions)

    def updated(self, files: DataFrame) -> CodeIndex:
        """The index of a newer state of the files; only changed files are parsed again."""
        stamp = lambda f: f.select("path", "hash", "size", F.lit(None).cast("timestamp").alias("mtime"))
        changes = cut(maintain.manifest_changes(stamp(self.files), stamp(files).withColumn("mtime", F.current_timestamp())))
        if maintain.needs_full_rebuild(changes.count(), files.count()):
            return CodeIndex.of_files(files, self.root, self.extensions)
        fresh = relations(cut(parse_files(files.join(changes, "path", "left_semi"))))
        old = {"symbols": self.symbols, "imports": self.imports, "calls": self.calls, "fields": self.fields}
        return CodeIndex(files, {k: maintain.merge(old[k], fresh[k], changes) for k in old}, self.root, self.extensions)

    # discovery
    def stats(self) -> DataFrame:
        return search.stats(self.files, self.symbols)

    def map(self, level: int = 1) -> DataFrame:
        return search.file_map(self.files, self.symbols, level)

    def query(self, wanted: str, **options) -> DataFrame:
        return search.query(self.symbols, wanted, **options)

    def inspect(self, path: str, **options) -> DataFrame:
        return search.inspect(self.symbols, path, files=self.files, **options)

    def imports_of(self, path: str) -> DataFrame:
        return deps.imports_of(self.imports, path)

    def used_by(self, target: str) -> DataFrame:
        if "/" in target or not self.files.filter(F.col("path") == target).isEmpty():
            return deps.imported_by(self.imports, target)
        return deps.uses_of(self.lines, self.symbols, target)

    # call graph
    def callers(self, wanted: str, fuzzy: bool = False, limit: int | None = None) -> DataFrame:
        return callgraph.callers(self.symbols, self.calls, wanted, fuzzy, limit)

    def callees(self, wanted: str, fuzzy: bool = False, limit: int | None = None) -> DataFrame:
        return callgraph.callees(self.symbols, self.calls, wanted, fuzzy, limit)

    def tests(self, wanted: str, fuzzy: bool = False) -> DataFrame:
        return callgraph.tests_of(self.symbols, self.calls, self.files, wanted, fuzzy)

    def untested(self) -> DataFrame:
        return callgraph.untested(self.symbols, self.calls, self.files).orderBy("path", "line")

    def entrypoints(self) -> DataFrame:
        return callgraph.in_order(callgraph.entrypoints(self.symbols, self.calls, self.files))

    def test_deps(self, path: str) -> DataFrame:
        known = self.files.filter((F.col("path") == path) & X.is_test_file(F.col("path")))
        if known.isEmpty():
            raise ValueError(f"{path} is not a test file")
        return callgraph.test_deps(self.symbols, self.calls, self.files, path).orderBy("path", "line")

    def trace(self, source: str, target: str, fuzzy: bool = False) -> DataFrame:
        return callgraph.trace(self.symbols, self.calls, source, target, fuzzy)

    def impact(self, wanted: str, **options) -> dict[str, DataFrame]:
        return callgraph.impact(self.symbols, self.calls, self.files, wanted, **options)

    # types
    def implements(self, wanted: str, fuzzy: bool = False, trait_only: bool = False) -> DataFrame:
        return implements.implements(self.lines, wanted, fuzzy, trait_only)

    def types(self, wanted: str, fuzzy: bool = False) -> DataFrame:
        return types.types_of(self.symbols, wanted, fuzzy)

    def schema(self, wanted: str, fuzzy: bool = False) -> DataFrame:
        return types.schema_of(self.symbols, self.fields, wanted, fuzzy)

    # history
    def _old_symbols(self, commit: str) -> tuple[DataFrame, DataFrame]:
        """Symbols at a commit and now, of the files that differ between it and HEAD."""
        spark, repo = self.files.sparkSession, git.root_of(self.root)
        at, within = git.resolve(repo, commit), os.path.relpath(os.path.realpath(self.root), os.path.realpath(repo))
        within = "" if within == "." else within + "/"

        def own(kind: str) -> DataFrame:
            """Rows of this tree's files, by the index's paths, extensions and ignored folders."""
            rows = git.read_git(spark, repo, kind, commit=at, within=within).filter(F.col("path").startswith(within))
            return scoped(rows.withColumn("path", F.substring("path", len(within) + 1, 1 << 30)), self.extensions)

        before = own("before").withColumn("language", X.language(F.col("path")))
        paths = own("changes").select("path").distinct()
        return relations(cut(parse_files(before)))["symbols"], self.symbols.join(paths, "path", "left_semi")

    def diff(self, commit: str, full: bool = False) -> DataFrame:
        return diff.diff(*self._old_symbols(commit), full=full)

    def since(self, commit: str, breaking: bool = False) -> DataFrame:
        changes = diff.compare_symbols(*self._old_symbols(commit))
        return diff.breaking(changes) if breaking else changes

    def _states(self, name: str, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        spark, repo = self.files.sparkSession, git.root_of(self.root)
        options = {"limit": limit} if limit else {}
        log = cut(git.read_git(spark, repo, "log", paths=path, **options))
        revisions = git.read_git(spark, repo, "revisions", paths=path, **options).withColumn("language", X.language(F.col("path")))
        # parsed under a path that holds the commit, so that each revision is a file of its own
        keyed = revisions.withColumn("path", F.concat_ws(":", "hash", "path"))
        at = relations(cut(parse_files(keyed)))["symbols"]
        at = at.withColumn("hash", F.substring_index("path", ":", 1)).withColumn("path", F.lit(path))
        return log, history.symbol_states(log, at, name)

    def blame(self, name: str, path: str) -> DataFrame:
        log, states = self._states(name, path, history.COMMITS)
        return history.blame(states).join(log.drop("seq"), ["path", "hash"])

    def history(self, name: str, path: str) -> DataFrame:
        log, states = self._states(name, path)
        return history.history(states).join(log.drop("seq"), ["path", "hash"]).orderBy("seq")

    # snapshots
    def snapshot(self, folder: str, name: str = "unnamed") -> None:
        here = self.root is not None and git.is_repository(self.root)
        maintain.save_snapshot(self.symbols, folder, name, git.resolve(git.root_of(self.root), "HEAD")[:8] if here else None, self.files)

    def compare(self, folder: str, name: str) -> DataFrame:
        old = maintain.load_snapshot(self.files.sparkSession, folder, name)
        return diff.compare_symbols(old, self.symbols, ("path", "name", "symbol_type"))


def search_tree(spark: SparkSession, root: str, wanted: str, fast: bool = False, exact: bool = False, **options) -> DataFrame:
    """Search without an index. In fast mode, or from FAST_FILES files on, only files whose text
    holds the name are parsed; with no such file the whole tree is."""
    files = scan_tree(spark, root)
    if wanted.lower() not in X.PLURALS and (fast or files.count() >= FAST_FILES):
        some = cut(search.candidate_files(files, wanted, not exact))
        if not some.isEmpty():
            files = some
    return search.query(relations(cut(parse_files(files)))["symbols"], wanted, exact=exact, **options)
