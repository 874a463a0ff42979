"""Git repositories as a batch data source (``spark.read.format("git_tree")``), with commit and branch lookups.

The tree is listed once when the plan is made; blobs are read by the tasks, in groups, from the object store that all
executors reach under the given path.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernel.schema import CHANGE, COMMIT

GROUP = 200
GROUP_BYTES = 16 << 20  # of blobs that a task reads at once
MAX_BLOB = 1 << 20
_STATUS = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Copied", "T": "Modified"}


def git(repo: str, *args: str, text: bool = True, data: bytes | None = None):
    run = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, input=data, check=True)
    return run.stdout.decode("utf-8", "replace") if text else run.stdout


def read_blobs(repo: str, ids: list[str]) -> Iterator[bytes]:
    """Contents of blobs, in order."""
    raw, at = git(repo, "cat-file", "--batch", text=False, data="".join(f"{x}\n" for x in ids).encode()), 0
    for _ in ids:
        end = raw.index(b"\n", at)
        size = int(raw[at:end].split()[2])
        yield bytes(raw[end + 1 : end + 1 + size])
        at = end + 2 + size


def groups(entries: list[tuple], size_at: int) -> list[list[tuple]]:
    """Entries in groups of bounded number and bytes; blobs that are not read count as nothing."""
    out: list[list[tuple]] = [[]]
    held = 0
    for e in entries:
        size = e[size_at] if e[size_at] <= MAX_BLOB else 0
        if out[-1] and (len(out[-1]) >= GROUP or held + size > GROUP_BYTES):
            out.append([])
            held = 0
        out[-1].append(e)
        held += size
    return out


class _Blobs(InputPartition):
    def __init__(self, entries: list[tuple[str, str, int, int]]):
        self.entries = entries


class GitTreeReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.rev = options["path"], options.get("rev", "HEAD")
        self.content = options.get("content", "true").lower() != "false"
        ext = options.get("extensions", "")
        self.extensions = {x.strip().lstrip(".") for x in ext.split(",") if x.strip()}

    def _wanted(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return not self.extensions or ("." in name[1:] and name.rsplit(".", 1)[-1] in self.extensions)

    def partitions(self):
        entries = []
        for line in git(self.repo, "ls-tree", "-r", "-l", "-z", self.rev).split("\0"):
            if line:
                head, path = line.split("\t", 1)
                mode, kind, oid, size = head.split()
                if kind == "blob" and self._wanted(path):
                    entries.append((path, oid, int(mode, 8), int(size)))
        return [_Blobs(g) for g in groups(entries, 3)]

    def read(self, partition) -> Iterator[tuple]:
        small = [oid for _, oid, _, size in partition.entries if size <= MAX_BLOB and self.content]
        bodies = read_blobs(self.repo, small) if small else iter(())
        for path, oid, mode, size in partition.entries:
            yield (path, oid, mode, next(bodies) if size <= MAX_BLOB and self.content else None, size)


class GitTree(DataSource):
    """Options: path, rev (HEAD), extensions (a comma list; files without extension are then left out), content (true;
    with false the tree is only listed and content is null)."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, blob_id string, file_mode int, content binary, size_bytes bigint"

    def reader(self, schema) -> GitTreeReader:
        return GitTreeReader(self.options)


def read_tree(spark: SparkSession, repo: str, rev: str = "HEAD", extensions: list[str] | None = None, content: bool = True) -> DataFrame:
    """Files of a tree; blobs above 1 MiB have null content and are not read, and none is without ``content``."""
    spark.dataSource.register(GitTree)
    r = spark.read.format("git_tree").option("rev", rev).option("content", str(content).lower())
    return (r.option("extensions", ",".join(extensions)) if extensions else r).load(repo)


def with_content(files: DataFrame, repo: str) -> DataFrame:
    """The rows of a listed tree with their contents, read by the tasks."""

    def run(batches):
        for p in batches:
            rows = list(p.itertuples(index=False, name=None))
            cols = list(p.columns)
            oid, size, at = cols.index("blob_id"), cols.index("size_bytes"), cols.index("content")
            for g in groups(rows, size):
                small = [r[oid] for r in g if r[size] <= MAX_BLOB] if g else []
                bodies = read_blobs(repo, small) if small else iter(())
                yield pd.DataFrame([(*r[:at], next(bodies) if r[size] <= MAX_BLOB else None, *r[at + 1 :]) for r in g], columns=cols)

    return files.mapInPandas(run, files.schema)


def read_directory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a plain folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (r.option("pathGlobFilter", glob) if glob else r).load(path).where(F.col("length") <= MAX_BLOB)
    return rows.select("path", F.sha1("content").alias("blob_id"), F.lit(0o100644).alias("file_mode"), "content")


def read_commits(spark: SparkSession, repo: str, rev: str = "HEAD", limit: int | None = None) -> DataFrame:
    """Commits with their summary line; the author's name falls back to ``unknown``, the address to an empty text."""
    args = ["log", "--format=%H%x1f%s%x1f%an%x1f%ae%x1f%ct", rev] + ([f"-{limit}"] if limit else [])
    rows = [line.split("\x1f") for line in git(repo, *args).split("\n") if line]
    return spark.createDataFrame([(a, b, c or "unknown", d, int(e)) for a, b, c, d, e in rows], COMMIT)


def find_commit(repo: str, rev: str = "HEAD") -> str:
    return git(repo, "rev-parse", "--verify", f"{rev}^{{commit}}").strip()


def branches(repo: str) -> list[str]:
    return [x for x in git(repo, "for-each-ref", "--format=%(refname:short)", "refs/heads").split("\n") if x]


def default_branch(repo: str) -> str:
    """main, else master, else what HEAD points to."""
    have = branches(repo)
    return next((b for b in ("main", "master") if b in have), current_branch(repo))


def current_branch(repo: str) -> str:
    return git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()


def store_path(repo: str, folder: str = "embed") -> str:
    """Where a repository keeps its point store: below ``.git``, or below the folder itself for a bare one."""
    bare = git(repo, "rev-parse", "--is-bare-repository").strip() == "true"
    return f"{repo}/{folder}" if bare else f"{repo}/.git/{folder}"


def diff_commits(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """Changes between two commits with counts of lines; a rename shows as a deletion and an addition."""
    counts = {}
    for line in git(repo, "diff", "--numstat", "--no-renames", "-z", old, new).split("\0"):
        if line:
            added, gone, path = line.split("\t", 2)
            counts[path] = (0 if added == "-" else int(added), 0 if gone == "-" else int(gone))
    rows = []
    parts = git(repo, "diff", "--raw", "--no-renames", "--abbrev=40", "-z", old, new).split("\0")
    for head, path in zip(parts[::2], parts[1::2]):
        _, _, a, b, s = head.split()
        none = lambda x: None if set(x) == {"0"} else x
        rows.append((path, _STATUS.get(s[0], "Modified"), none(a), none(b), *counts.get(path, (0, 0))))
    return spark.createDataFrame(rows, f"{CHANGE}, insertions int, deletions int")
