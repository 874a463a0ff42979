import itertools
import random
import re

import numpy as np

from quernel.llm import near_dup, vector_knn

SCHEMA = "id string, code string, kind string, cls string, pair string"


def triples(code):
    w = re.findall(r"[A-Za-z0-9_]+", code)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else None


def brute(rows):
    have = {}
    for i, code, kind, *_ in rows:
        if i is not None and code is not None and kind in ("function", "method") and (t := triples(code)):
            have.setdefault((i, code), t)
    out = set()
    for (a, x), (b, y) in itertools.combinations(have.items(), 2):
        if a[0] != b[0] and len(x & y) / len(x | y) >= 0.6:
            out.add(tuple(sorted((a[0], b[0]))))
    return out


def corpus(seed=5, families=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.randrange(28, 120))]
        for v in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(text))
                rng.choice([lambda: text.__setitem__(k, word()), lambda: text.insert(k, word()), lambda: text.pop(k)])()
            rows.append((f"{f}-{v}", " ".join(text), rng.choice(["function", "method", "class"]), "x", "y"))
    rows += [("dup1", rows[0][1], "function", "", ""), ("dup2", rows[0][1], "function", "", ""), rows[0], ("n", None, "function", "", ""), (None, rows[1][1], "function", "", ""), ("e", "", "method", "", ""), ("k", rows[2][1], None, None, None)]
    rows += [("long", " ".join(f"t{i}" for i in range(30_000)), "function", "", ""), ("long2", " ".join(f"t{i}" for i in range(100, 30_000)), "function", "", "")]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.chunk_a, r.chunk_b) for r in near_dup.similar_pairs(df).collect()}
    want = brute(rows)
    assert ("dup1", "dup2") in got and ("long", "long2") in got
    assert got == want
    groups = {r.chunk_id: r for r in near_dup.similar_groups(df).collect()}
    for a, b in want:
        assert groups[a].class_id == groups[b].class_id
    assert groups["dup1"].n_copies >= 2


def test_hot_values_lose_no_pair(spark):
    """Many functions share a long common part: its coordinate values are hot, and rare ones must still join."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((f"a{i}", " ".join(common + own), "function", "", ""))
        if i % 3 == 0:
            rows.append((f"b{i}", " ".join(common + own[:-2] + ["z", "y"]), "method", "", ""))
    got = {(r.chunk_a, r.chunk_b) for r in near_dup.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(got) >= 40


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_dup.similar_pairs(df).count() == 0 and near_dup.similar_groups(df).count() == 0


def test_components(spark):
    links = [(b"\x01", b"\x02"), (b"\x02", b"\x03"), (b"\x05", b"\x04"), *[(bytes([k]), bytes([k + 1])) for k in range(10, 40)]]
    nodes = spark.createDataFrame([(bytes([k]),) for k in range(45)], "node binary")
    got = {bytes(r.node): bytes(r.label) for r in near_dup.components(nodes, spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got[b"\x03"] == b"\x01" and got[b"\x05"] == b"\x04" and got[bytes([40])] == bytes([10]) and got[b"\x07"] == b"\x07"


POINTS = "id string, vector array<float>, upserted_at timestamp, payload string, cls string, sim double"


def vectors(n=1500, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dim))
    return np.concatenate([c + 0.4 * rng.standard_normal((8, dim)) for c in centres] + [rng.standard_normal((n - 8 * (n // 12), dim))]).astype(np.float32)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_knn, "CELL_ROWS", 100)
    v = vectors()
    ids = [f"p{i:05}" for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist(), None, "", "", 0.0) for i, x in zip(ids, v)], POINTS)
    u = v.astype(np.float64) / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(v)) for j in top[i] if s[i, j] >= 0.85}
    got = {(r.point_a, r.point_b) for r in vector_knn.similar_vectors(df).collect()}
    assert len(want) > 500 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    table = vector_knn.neighbour_table(df).collect()
    found = {(r.point, r.neighbour) for r in table}
    assert sum((ids[i], ids[j]) in found for i in range(len(v)) for j in top[i]) >= 0.9 * 5 * len(v)


def test_copies_outdated_and_invalid_rows(spark):
    import datetime as dt

    rng = np.random.default_rng(1)
    base = rng.standard_normal(64).tolist()
    day = lambda n: dt.datetime(2025, 1, n)
    rows = [(f"c{i}", base, day(1), "", "", 0.0) for i in range(9)]  # equal vectors: ties go to the smaller id
    rows += [("old", base, day(1), "", "", 0.0), ("old", [-x for x in base], day(2), "", "", 0.0), ("old", base, None, "", "", 0.0)]
    rows += [("null", None, day(1), "", "", 0.0), ("short", [1.0], day(1), "", "", 0.0), ("zero", [0.0] * 64, day(1), "", "", 0.0), ("nan", [float("nan")] * 64, day(1), "", "", 0.0), ("inf", [float("inf")] * 64, day(1), "", "", 0.0), (None, base, day(1), "", "", 0.0), ("hole", [None] + base[1:], day(1), "", "", 0.0)]
    df = spark.createDataFrame(rows + rows[:2], POINTS)
    got = {}
    for r in vector_knn.neighbour_table(df, least=0.85).collect():
        got.setdefault(r.point, []).append((r.rank, r.neighbour))
    assert set(got) == {f"c{i}" for i in range(9)}
    assert [n for _, n in sorted(got["c8"])] == ["c0", "c1", "c2", "c3", "c4"] and [n for _, n in sorted(got["c0"])] == ["c1", "c2", "c3", "c4", "c5"]
    assert vector_knn.similar_vectors(df.limit(0)).count() == 0


def test_two_levels_of_cells_keep_recall(spark, monkeypatch):
    """More cells than one level of centroids holds: a second level parts them, and the probes still meet the target."""
    monkeypatch.setattr(vector_knn, "CELL_ROWS", 25)
    monkeypatch.setattr(vector_knn, "CENTRES", 8)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((40, 64))[rng.integers(0, 40, 1500)] + 0.5 * rng.standard_normal((1500, 64))).astype(np.float32)
    cells = vector_knn.Cells(vector_knn._unit(list(x)), 60)
    assert len(cells.first) == 8 and len(cells) >= 60
    near = cells.nearest(vector_knn._unit(list(x)), 5)
    assert near.shape == (1500, 5) and (near[:, 0] == cells.nearest(vector_knn._unit(list(x)), 1)[:, 0]).mean() > 0.9
    df = spark.createDataFrame([(f"{i:04}", v.tolist(), None) for i, v in enumerate(x)], "id string, vector array<float>, upserted_at timestamp")
    u = vector_knn._unit(list(x))
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    true = {(f"{i:04}", f"{j:04}") for i in range(1500) for j in np.argsort(-sims[i])[:5]}
    got = {(r.point, r.neighbour) for r in vector_knn.neighbour_table(df).collect()}
    assert len(true & got) >= 0.95 * len(true)
