import json

import pytest
from pyspark.sql import functions as F

from quernel.functions import embedding, vectors
from quernel.operators import evaluate, graph, report, search, store
from quernel.schema import CHUNK_COLUMNS


def points(spark, rows):
    """rows: (id, vector, language, file, kind)."""
    out = []
    for seq, (i, v, language, file, kind) in enumerate(rows):
        base = dict.fromkeys(CHUNK_COLUMNS, "") | {"id": i, "language": language, "file": file, "kind": kind, "repo": "r", "symbol": i, "signature": i, "code": f"{i}()\nx", "doc": None, "start_line": 1, "end_line": 2}
        out.append(tuple(base[c] for c in CHUNK_COLUMNS) + (v, seq))
    return spark.createDataFrame(out, store.POINT)


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_cosine(spark):
    rows = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "a array<float>, b array<float>, want double")
    for r in df.withColumn("got", vectors.cosine("a", "b")).collect():
        assert r.got == pytest.approx(r.want)


def test_numpy_scores_equal_the_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([3.0],), (None,)], "v array<float>")
    q = F.array(F.lit(0.5), F.lit(-1.0))
    for r in df.select(vectors.cosine("v", q).alias("a"), vectors.cosine_to([0.5, -1.0])("v").alias("b")).collect():
        assert r.a == pytest.approx(r.b)


def test_order_filter_threshold_page_and_ties(spark):
    p = points(spark, [("a", [1.0, 0.0, 0.0], "rust", "src/a.rs", "function"), ("b", [0.9, 0.1, 0.0], "python", "src/b.py", "function_doc"), ("c", [0.0, 1.0, 0.0], "rust", "lib/c.rs", "function"), ("d", [2.0, 0.0, 0.0], "rust", "src/d.rs", "method"), ("e", [1.0], "rust", "e", "function"), ("n", [float("nan"), 0.0, 0.0], "rust", "n", "function")])
    q = [1.0, 0.0, 0.0]
    assert ids(search.search(p, q, search.SearchOptions(3))) == ["a", "d", "b"]
    assert ids(search.search(p, q, search.SearchOptions(2, 1))) == ["d", "b"]
    assert ids(search.search(p, q, search.SearchOptions(9, 0, None, search.SearchFilter(language="rust")))) == ["a", "d", "c", "n"]
    assert ids(search.search(p, q, search.SearchOptions(9, 0, None, search.SearchFilter(kind="function", file="src/")))) == ["a"]
    assert ids(search.search(p, q, search.SearchOptions(9, 0, 0.8))) == ["a", "d", "b"]
    assert search.search(p, q, search.SearchOptions(0)).count() == 5
    assert search.search(p.limit(0), q).count() == 0


def test_batch_equals_single(spark):
    rows = [(f"p{i}", [float((i * 7) % 11), float((i * 5) % 13), 1.0], ["rust", "Go", None][i % 3], "f", "function") for i in range(40)]
    p = points(spark, rows)
    q = spark.createDataFrame([("x", [1.0, 2.0, 3.0], "go"), ("y", [3.0, 0.0, 1.0], "rust"), ("z", [1.0], "rust"), ("w", None, None)], "query_id string, vector array<float>, language string")
    got = search.batch_search(p, q, 4, by_language=True).collect()
    for name, vector, language in (("x", [1.0, 2.0, 3.0], "Go"), ("y", [3.0, 0.0, 1.0], "rust")):
        one = search.search(p, vector, search.SearchOptions(4, 0, None, search.SearchFilter(language=language)))
        assert [r.id for r in sorted((r for r in got if r.query_id == name), key=lambda r: r.rank)] == ids(one)
    assert not [r for r in got if r.query_id in ("z", "w")]


def test_graph_and_reports(spark):
    p = points(spark, [("a", [1.0, 0.0], "rust", "f", "function"), ("b", [0.9, 0.1], "rust", "g", "function"), ("c", [0.8, 0.2], "rust", "f", "method"), ("d", [0.0, 1.0], "rust", "", "method")])
    ranked = search.search(p, [1.0, 0.0], search.SearchOptions(10)).cache()
    assert [(r.source, r.target, r.relation) for r in graph.links(ranked).collect()] == [("a", "c", "same_file")]
    assert {r.id: r.val for r in graph.nodes(ranked).collect()} == {"a": 20, "b": 19, "c": 19, "d": 3}
    data = json.loads(report.graph_json(ranked, 10).first().json)
    assert len(data["nodes"]) == 4 and len(data["links"]) == 1
    assert report.text_list(ranked).count() == 4
    assert "### 1. `a` [function]" in report.markdown(ranked).where("rank = 1").first().markdown


def test_upsert_delete_stats(spark):
    old = points(spark, [("a", [1.0, 0.0], "rust", "f", "function"), ("b", [0.0, 1.0], "python", "g", "function")])
    batch = points(spark, [("b", [2.0, 2.0], "python", "g", "function"), ("c", [1.0, 1.0], "rust", "h", "function"), ("b", [3.0, 3.0], "python", "g", "function")])
    new = {r.id: (list(r.vector), r.seq) for r in store.upsert(old, batch).collect()}
    assert new == {"a": ([1.0, 0.0], 0), "b": ([3.0, 3.0], 1), "c": ([1.0, 1.0], 3)}
    assert store.delete_matching(old, search.SearchFilter(language="python")).count() == 1
    assert store.delete_matching(old, search.SearchFilter()).count() == 0
    assert store.delete_where(old.withColumn("language", F.lit(None).cast("string")), F.col("language") == "rust").count() == 2
    assert store.stats(old).first().asDict() == {"points": 2, "dimension": 2}
    assert store.stats(old.limit(0)).first().asDict() == {"points": 0, "dimension": 0}


def test_store_versions(spark, tmp_path):
    s = store.PointStore(spark, f"file://{tmp_path}/points", dim=2)
    assert s.count() == 0
    s.upsert(points(spark, [("a", [1.0, 0.0], "rust", "f", "function"), ("b", [0.0, 1.0], "go", "g/f", "function"), ("k", [1.0, 1.0], "go", "k", "function")]))
    assert s.contains("a") and not s.contains("z") and s.stats()["bytes"] > 0
    s.delete_by_file("f")
    assert {r.id for r in s.load().collect()} == {"b", "k"}
    s.delete("k")
    s.upsert(points(spark, [("b", [1.0, 1.0], "go", "g", "function")]))
    assert [list(r.vector) for r in store.PointStore(spark, f"file://{tmp_path}/points").load().collect()] == [[1.0, 1.0]]
    with pytest.raises(ValueError):
        s.upsert(points(spark, [("q", [1.0], "go", "g", "function")]))
    s.delete_by_language("go")
    s.clear()
    assert s.count() == 0
    s.drop()
    assert s.count() == 0


def test_latest_points(spark):
    t = "id string, vector array<float>, payload struct<" + ",".join(f"{c}:string" if not c.endswith("line") else f"{c}:bigint" for c in CHUNK_COLUMNS) + ">, upserted_at timestamp"
    pay = tuple("x" if not c.endswith("line") else 1 for c in CHUNK_COLUMNS)
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, n)
    rows = [("a", [2.0], pay, day(2)), ("a", [1.0], pay, day(1)), ("a", [2.0], pay, day(2)), ("b", None, pay, None), (None, [1.0], pay, day(1))]
    got = {r.id: r.vector for r in store.latest_points(spark.createDataFrame(rows, t)).collect()}
    assert got == {"a": [2.0], "b": None}


def test_fallback_and_embedder(spark):
    df = spark.createDataFrame([("one",), ("two",), ("",)], "t string")
    v = embedding.embed(df, "t", None, 128).collect()
    assert all(len(r.vector) == 128 and list(r.vector[:64]) == list(r.vector[64:]) for r in v) and v[0].model == "default-fallback"
    assert all(embedding.fallback_values(r.t, 128) == list(r.vector) for r in v)
    ok = embedding.embed(df, "t", lambda texts: [[float(len(t)), 1.0] for t in texts], 2, "m").collect()
    assert [list(r.vector) for r in ok] == [[3.0, 1.0], [3.0, 1.0], [0.0, 1.0]] and ok[0].model == "m"

    def broken(texts):
        raise OSError("no service")

    assert {r.model for r in embedding.embed(df, "t", broken, 2, "m").collect()} == {"m-fallback"}


def test_metrics(spark):
    q = spark.createDataFrame([("1", "Rust", ["add"]), ("2", "rust", ["Point"]), ("3", "go", ["Store"]), ("4", "go", [])], "query_id string, language string, expected_symbols array<string>")
    hits = spark.createDataFrame([("1", 1, "add_one"), ("2", 1, "x"), ("2", 3, "Point2D"), ("3", 1, ""), ("3", 6, "Store")], "query_id string, rank int, symbol string")
    got = {r.language: (r.top1, r.top5, round(r.mrr, 4), r.n_queries) for r in evaluate.metrics(evaluate.judge(q, hits)).collect()}
    assert got == {"rust": (0.5, 1.0, 0.6667, 2), "go": (0.0, 0.0, 0.0, 2), "all": (0.25, 0.5, 0.3333, 4)}
    assert evaluate.judge(q, hits, compat_empty=True).where("query_id = '3'").first().first_hit == 1
    assert evaluate.metrics(evaluate.judge(q.limit(0), hits)).collect()[0].asDict() == {"language": "all", "top1": 0.0, "top5": 0.0, "mrr": 0.0, "n_queries": 0}
    assert evaluate.built_in_queries(spark).count() == 12
    assert evaluate.of_language(q, "RUST").count() == 2


def test_store_rewrites_only_what_it_touches(spark, tmp_path):
    from quernel.operators.store import PointStore

    s = PointStore(spark, f"file://{tmp_path}/p", buckets=8)
    rows = points(spark, [(f"i{k}", [1.0, float(k)], "rust", f"f{k}", "function") for k in range(40)])
    s.save(rows)
    before = s._manifest()
    s.upsert(points(spark, [("i3", [5.0, 5.0], "rust", "f3", "function"), ("new", [0.0, 1.0], "go", "f3", "function")]))
    after = s._manifest()
    changed = [b for b in after["parts"] if after["parts"][b] != before["parts"].get(b)]
    assert len(changed) == 1 and s.count() == 41 and s.load().where("id = 'i3'").first().vector == [5.0, 5.0]
    old = {r.id: r.seq for r in s._read(before).collect()}
    assert s.load().where("id = 'i3'").first().seq == old["i3"] and s.load().where("id = 'new'").first().seq > max(old.values())
    assert s._read(before).count() == 40  # readers of the older version still find it
    assert s.vacuum(hours=-1) > 0 and s.count() == 41
    s.delete("i3")
    s.delete("absent")
    s.delete_by_language("go")
    assert {r.id for r in s.load().collect()} == {f"i{k}" for k in range(40) if k != 3}
    seen = s._manifest()
    s.delete("i4")
    with pytest.raises(RuntimeError):
        s._switch(seen, seen | {"version": "x"})
    assert s.count() == 38
    s.clear()
    assert s.count() == 0 and s.stats()["points"] == 0


def test_stages_need_a_shared_folder(spark):
    from quernel import session

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)
    a = session.stage(spark.range(3), "x")
    assert a.count() == 3
    session.drop_stages(spark, a)
    with pytest.raises(Exception):  # noqa: B017 - the files are gone
        spark.read.parquet(a._stage)


def test_command_line(spark, tmp_path, capsys):
    import subprocess

    from quernel import __main__ as cli

    at = tmp_path / "repo"
    at.mkdir()
    (at / "a.py").write_text("def load_rows(path):\n    \"\"\"Reads the rows.\"\"\"\n    return path\n")
    for args in (["init", "-q", "-b", "main"], ["add", "-A"], ["-c", "user.name=T", "-c", "user.email=t@x", "commit", "-qm", "m"]):
        subprocess.run(["git", "-C", str(at), *args], check=True)
    settings = tmp_path / "s.json"
    settings.write_text(f'{{"store": "file://{tmp_path}/store", "state": "{tmp_path}/state.json", "dim": 16, "score_threshold": 0.0}}')
    run = lambda *a: (cli.main(["--settings", str(settings), *a]), capsys.readouterr().out)[1]
    assert '"dim": 16' in run("config") and '"chunks_created": 2' in run("index", str(at))
    assert "[function]" in run("search", "load rows", "--kind", "function") and "### 1." in run("search", "load", "--format", "markdown")
    assert '"nodes"' in run("search", "load", "--format", "graph") and "main" in run("info", str(at)) and "(.rs)" in run("languages")
    assert "top1" in run("eval", "--language", "python")
