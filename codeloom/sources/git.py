"""Version history as tables, read by a Python data source on top of the git command.

``kind``: log (commits of files), changes (paths changed since a commit), before (their contents at
that commit), revisions (contents at commits). ``within`` keeps changes to a sub-folder. One input partition a path, so the history of a tree is read in parallel; every executor
must see the repository folder.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG = "path string, seq int, hash string, short_hash string, author string, date string, message string"
CHANGES = "path string, status string"
REVISIONS = "path string, hash string, content string"
BEFORE = "path string, content string"


def _git(repo: str, *args: str) -> str | None:
    run = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True)
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def is_repository(folder: str) -> bool:
    return _git(folder, "rev-parse", "--git-dir") is not None


def root_of(folder: str) -> str:
    out = _git(folder, "rev-parse", "--show-toplevel")
    if out is None:
        raise ValueError(f"{folder} is in no git repository")
    return out.strip()


def resolve(repo: str, commit: str) -> str:
    out = _git(repo, "rev-parse", "--verify", f"{commit}^{{commit}}")
    if out is None:
        raise ValueError(f"no commit {commit}")
    return out.strip()


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeloom_git"

    def schema(self) -> str:
        return {"log": LOG, "changes": CHANGES, "revisions": REVISIONS, "before": BEFORE}[self.options.get("kind", "log")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.kind = options["repo"], options.get("kind", "log")
        self.commit, self.limit = options.get("commit", "HEAD"), options.get("limit")
        self.within = options.get("within", "")
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        if self.kind == "changes":
            return [InputPartition("")]
        if self.kind == "before":
            changed = sorted({p for p, _ in self.changed()})
            return [InputPartition("\n".join(changed[k : k + 32])) for k in range(0, len(changed), 32)]
        paths = self.paths or (_git(self.repo, "ls-files") or "").splitlines()
        return [InputPartition(p) for p in paths]

    def changed(self):
        more = ["--", self.within] if self.within else []
        for line in (_git(self.repo, "-c", "core.quotePath=false", "diff", "--name-status", self.commit, "HEAD", *more) or "").splitlines():
            status, *names = line.split("\t")
            if status[:1] == "R" and len(names) == 2:  # a rename is a deletion and an addition
                yield names[0], "D"
                yield names[1], "A"
            elif status[:1] in "ADM" and names:
                yield names[0], status[:1]

    def read(self, partition):
        path = partition.value
        if self.kind == "changes":
            yield from self.changed()
            return
        if self.kind == "before":
            for path in partition.value.split("\n"):
                content = _git(self.repo, "show", f"{self.commit}:{path}")
                if content is not None:
                    yield path, content
            return
        more = ["-n", str(self.limit)] if self.limit else []
        log = (_git(self.repo, "log", "--format=%H|%h|%an|%ai|%s", "--follow", *more, "--", path) or "").splitlines()
        for seq, line in enumerate(log):
            commit, short, author, date, message = line.split("|", 4)
            if self.kind == "log":
                yield path, seq, commit, short, author, date, message
            else:
                content = _git(self.repo, "show", f"{commit}:{path}")
                if content is not None:
                    yield path, commit, content


def read_git(spark: SparkSession, repo: str, kind: str = "log", **options: str) -> DataFrame:
    """Options: paths (newline separated; all tracked files else), commit, limit, within."""
    spark.dataSource.register(GitSource)
    r = spark.read.format("codeloom_git").option("repo", repo).option("kind", kind)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


def at_commit(repo: str, commit: str, path: str) -> str | None:
    return _git(repo, "show", f"{commit}:{path}")
