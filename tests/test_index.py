import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quernel.api import Config, Engine
from quernel.operators import diff, index
from quernel.operators.store import PointStore
from quernel.sources import git
from quernel.sources.state import StateStore
from quernel.streaming import index_stream


@pytest.fixture
def repo(tmp_path):
    at = str(tmp_path / "repo")
    os.makedirs(at)
    run = lambda *a: subprocess.run(["git", "-C", at, "-c", "user.name=T", "-c", "user.email=t@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    files = {"a.py": "def f(x):\n    '''Sums.'''\n    return x\n", "d/b.rs": "fn g() -> u8 { 1 }\n", "README.md": "# Title\n\nText of it.\n", "bin.dat": "\0\1"}
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{at}/{name}") or at, exist_ok=True)
        open(f"{at}/{name}", "w").write(text)
    run("add", "-A")
    run("commit", "-qm", "first")
    open(f"{at}/a.py", "w").write("def f(x):\n    return x + 1\n\ndef h():\n    pass\n")
    os.remove(f"{at}/d/b.rs")
    open(f"{at}/new.go", "w").write("package a\n\nfunc N() {}\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    return at


def test_git_source(spark, repo):
    assert {r.path for r in git.read_tree(spark, repo).collect()} == {"a.py", "README.md", "bin.dat", "new.go"}
    assert {r.path for r in git.read_tree(spark, repo, "HEAD~1", ["py", "rs"]).collect()} == {"a.py", "d/b.rs"}
    row = git.read_tree(spark, repo).where("path = 'new.go'").first()
    assert row.content == b"package a\n\nfunc N() {}\n" and row.file_mode == 0o100644
    assert [r.message for r in git.read_commits(spark, repo).collect()] == ["second", "first"]
    assert git.branches(repo) == ["main"] and git.default_branch(repo) == "main" and git.store_path(repo).endswith(".git/embed")
    changes = git.diff_commits(spark, repo, "HEAD~1", "HEAD")
    assert {(r.path, r.status) for r in changes.collect()} == {("a.py", "Modified"), ("d/b.rs", "Deleted"), ("new.go", "Added")}
    s = diff.diff_stats(changes).first()
    assert (s.added, s.modified, s.deleted, s.insertions > 0) == (1, 1, 1, True)
    same = diff.diff_snapshots(git.read_tree(spark, repo, "HEAD~1"), git.read_tree(spark, repo))
    assert {(r.path, r.status) for r in same.collect()} == {(r.path, r.status) for r in changes.collect()}
    assert git.read_directory(spark, repo, "*.py").count() == 1


def test_full_and_incremental(spark, repo, tmp_path):
    e = Engine(spark, Config(store=f"file://{tmp_path}/store", state=str(tmp_path / "x/state.json"), dim=64))
    tree = lambda rev: git.read_tree(spark, repo, rev).withColumns({"repo": F.lit("r"), "branch": F.lit("main"), "commit": F.lit(rev)})
    indexer = index.Indexer(e.store, e.state, index.IndexConfig(dim=64))
    first = indexer.incremental(tree("HEAD"), tree("HEAD~1"), "r", "c1")
    assert first.chunks_created == e.store.count() == 4 and e.state.get("r") == "c1"
    assert {r.symbol for r in e.store.load().collect()} == {"f", "g", ""}
    second = indexer.incremental(tree("HEAD~1"), tree("HEAD"), "r", "c2")
    assert {r.symbol for r in e.store.load().collect()} == {"f", "h", "N", ""} and second.files_processed == 2
    assert {r.commit for r in e.store.load().where("file = 'new.go'").collect()} == {"c2"}
    indexer.full(tree("HEAD"), "r", "c2")
    assert e.store.count() == 4
    assert index.Indexer(e.store, e.state).extract_only(tree("HEAD")).count() == 3


def test_engine(spark, repo, tmp_path):
    e = Engine(spark, Config(store=f"file://{tmp_path}/store", state=str(tmp_path / "state.json"), dim=64, score_threshold=0.0))
    assert e.index(repo, "r").chunks_created == 4
    assert e.search("def h", limit=2).count() == 2
    nodes, links = e.search_graph("def h")
    assert nodes.count() == 4 and links.count() >= 1
    assert "### 1." in e.search_markdown("def h", limit=1)
    assert e.repo_tree(repo, 2) == (["README.md", "a.py"], 2)
    assert e.repo_info(repo)["branch"] == "main" and e.health() and e.languages().count() == 20
    assert e.index_status()["points"] == 4
    assert {r.language for r in e.evaluate(language="go").collect()} == {"go", "all"}
    e.running = True
    with pytest.raises(RuntimeError):
        e.index(repo)


def test_state_and_config(tmp_path, monkeypatch):
    s = StateStore(str(tmp_path / "deep/s.json"))
    assert s.get("r") is None
    s.set("r", "abc")
    s.set("q", "def")
    assert s.get("r") == "abc"
    s.clear("r")
    assert s.get("r") is None and s.get("q") == "def"
    s.clear()
    assert s.get("q") is None
    (tmp_path / "c.json").write_text('{"dim": 8, "limit": 3, "model": "j"}')
    (tmp_path / ".env").write_text("QUERNEL_LIMIT=4\nQUERNEL_MODEL='e'\n")
    monkeypatch.setenv("QUERNEL_MODEL", "v")
    c = Config.load(str(tmp_path / "c.json"), str(tmp_path / ".env"))
    assert (c.dim, c.limit, c.model) == (8, 4, "v") and '"dim": 8' in c.show()


def test_changes(spark):
    rows = [("r", "a", "added", None, "1", "2025-01-01"), ("r", "a", "Modified", "1", "2", "2025-01-03"), ("r", "a", "Modified", "1", "2", "2025-01-03"), ("r", "b", "Added", None, "3", "2025-01-01"), ("r", "b", " DELETED ", "3", None, "2025-01-02"), ("r", "c", "odd", None, None, "2025-01-01")]
    df = spark.createDataFrame(rows, "repo string, path string, status string, old_blob_id string, new_blob_id string, changed_at string")
    assert diff.clean_changes(df).count() == 4
    assert [(r.path, r.blob_id) for r in diff.latest_snapshot(df).collect()] == [("a", "2")]
    assert diff.diff_stats(diff.clean_changes(df)).first().asDict() == {"added": 2, "modified": 1, "deleted": 1, "renamed": 0, "copied": 0}
    assert diff.with_status(diff.clean_changes(df), "Added").count() == 2
    assert diff.diff_snapshots(df.limit(0).withColumn("blob_id", F.lit("")), df.limit(0).withColumn("blob_id", F.lit(""))).count() == 0


def test_stream(spark, tmp_path):
    schema = "repo string, branch string, commit string, path string, content string, committed_at timestamp"
    src = str(tmp_path / "src")
    rows = lambda xs: spark.createDataFrame([("r", "b", c, p, t) for p, t, c in xs], "repo string, branch string, commit string, path string, content string").withColumn("committed_at", F.to_timestamp(F.concat(F.lit("2025-01-0"), "commit")))
    rows([("a.md", "one", "1"), ("a.md", "two", "2"), ("b.md", "bee", "1")]).coalesce(1).write.parquet(src)
    s = PointStore(spark, f"file://{tmp_path}/store")
    go = lambda: index_stream.start(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / "cp"), index.IndexConfig(dim=8)).awaitTermination(120)
    go()
    assert {(r.file, r.code) for r in s.load().collect()} == {("a.md", "two"), ("b.md", "bee")}
    rows([("b.md", None, "3")]).coalesce(1).write.mode("append").parquet(src)
    go()
    assert {r.file for r in s.load().collect()} == {"a.md"}


def test_windowed_changes(spark):
    df = spark.createDataFrame([("r", "ADDED", "2025-01-01 10:00:00"), ("r", "added", "2025-01-01 12:00:00"), ("r", "Deleted", "2025-01-02 01:00:00")], "repo string, status string, t string").withColumn("changed_at", F.to_timestamp("t"))
    got = {(str(r.window_start)[:10], r.status, r.n) for r in index_stream.windowed_changes(df).collect()}
    assert got == {("2025-01-01", "Added", 2), ("2025-01-02", "Deleted", 1)}
