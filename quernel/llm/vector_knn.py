"""Problem 7: the most similar vectors of every vector, by collision-counting hashing.

Rows are first spread over cells of about ``CELL_ROWS``: around centroids, and where those would be more than ``CENTRES``,
around a second level of centroids of what the first leaves over, so that the number of cells follows the number of rows
and the centroids stay few. All are fitted on a bounded sample; every row lies in one cell and asks in its nearest ones,
as many as hold a ``TARGET`` share of the nearest neighbours inside the sample. Within a cell every random projection is a
sorted array. A query opens a window around its own value in each of them, a row collides where it falls inside, and
rows with at least ``THRESHOLD`` collisions are verified by their cosine. The windows widen from radius to radius (virtual
rehashing) until the query has k verified rows within the radius. Equal vectors form one class and are searched once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import stage

DIM = 64
K = 5
SAMPLE = 20_000  # rows on which the centroids are fitted
CELL_ROWS = 1000  # rows aimed at in a cell
CENTRES = 1024  # centroids of each level at most; with both there are cells for 10^9 rows
TARGET = 0.97  # share of the sample's neighbours that the probed cells must hold
NEAR_TARGET = 0.998  # the same where only neighbours from a least cosine on are asked for
ENOUGH = 200  # neighbours in the sample that are enough to measure it; with fewer of that cosine, all are taken
ASKED = 1000  # rows of the sample that measure it
MOST_PROBES = 256
BLOCK = 4096  # rows of a cell that one task holds on either side
PROJECTIONS = 16
THRESHOLD = 8
RADII = (0.2, 0.4, 0.56, 0.8, 1.1)  # Euclidean distances of unit vectors: cosine 0.98, 0.92, 0.84, 0.68, 0.4
WINDOW = 1.1  # half a window's width as a multiple of the radius


def valid_points(points: DataFrame, dim: int = DIM) -> DataFrame:
    """id and vector of each id's latest row, where that vector has ``dim`` finite numbers that are not all zero.

    Rows with a null id are left out. A null upserted_at is older than any time; of rows with equal times the larger
    vector holds.
    """
    last = points.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.struct("upserted_at", F.col("vector").cast("array<float>").alias("vector"))).alias("last")
    )
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return last.select("id", "last.vector").where((F.size(v) == dim) & finite & some)


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def collision_knn(q: np.ndarray, d: np.ndarray, k: int, least: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of up to k + 1 verified rows for each query, cosine at least ``least``."""
    keep = k + 1  # the query itself may be among the rows
    axes = np.random.default_rng(seed).standard_normal((d.shape[1], PROJECTIONS))
    pq, pd_ = q @ axes, d @ axes
    order = np.argsort(pd_, axis=0)
    arrays = np.take_along_axis(pd_, order, axis=0)
    ranks = np.empty_like(order, dtype=np.uint16)
    np.put_along_axis(ranks, order, np.arange(len(d), dtype=np.uint16)[:, None], axis=0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(q))
    floor = np.sqrt(max(0.0, 2 - 2 * least))

    def settle(rows, cols, sims):
        """The best ``keep`` of each query among verified rows."""
        by = np.lexsort((-sims, rows))
        rows, cols, sims = rows[by], cols[by], sims[by]
        first = np.searchsorted(rows, rows, "left")
        top = np.arange(len(rows)) - first < keep
        found.append((rows[top], cols[top], sims[top]))

    for radius in RADII:
        if not len(active):
            break
        half = WINDOW * radius
        undone = []
        for part in np.array_split(active, max(1, len(active) // 512)):
            counts = np.zeros((len(part), len(d)), dtype=np.uint8)
            for i in range(PROJECTIONS):
                lo = np.searchsorted(arrays[:, i], pq[part, i] - half, "left").astype(np.uint16)
                hi = np.searchsorted(arrays[:, i], pq[part, i] + half, "right").astype(np.uint16)
                counts += (ranks[None, :, i] - lo[:, None]) < (hi - lo)[:, None]  # unsigned: inside [lo, hi)
            r, c = np.nonzero(counts >= THRESHOLD)
            sims = np.einsum("ij,ij->i", q[part[r]], d[c]) if len(r) else np.zeros(0)
            near = sims >= 1 - radius * radius / 2
            full = np.bincount(r[near], minlength=len(part)) >= keep
            last = radius >= floor
            done = full | last
            use = done[r] & (sims >= least)
            settle(part[r[use]], c[use], sims[use])
            undone.append(part[~done])
        active = np.concatenate(undone)
    for part in np.array_split(active, max(1, -(-len(active) // 512))):  # beyond the last radius all rows are verified
        if len(part):
            sims = q[part] @ d.T
            c = np.argpartition(-sims, min(keep, len(d)) - 1, axis=1)[:, :keep] if len(d) > keep else np.tile(np.arange(len(d)), (len(part), 1))
            r = np.repeat(np.arange(len(part)), c.shape[1])
            s = sims[r, c.ravel()]
            use = s >= least
            settle(part[r[use]], c.ravel()[use], s[use])
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


class Cells:
    """Cells around centroids on one level or two."""

    def __init__(self, sample: np.ndarray, cells: int):
        first = max(1, min(cells, CENTRES, len(sample)))
        self.first = fit_centroids(sample, first).astype(np.float32)
        self.second = np.zeros((1, sample.shape[1]), np.float32)
        if cells > first:
            own = (sample.astype(np.float32) @ self.first.T).argmax(axis=1)
            rest = sample - self.first[own]
            self.second = fit_means(rest, min(CENTRES, -(-cells // first))).astype(np.float32)
        self.probes = 1

    def __len__(self) -> int:
        return len(self.first) * len(self.second)

    def nearest(self, u: np.ndarray, most: int) -> np.ndarray:
        """The nearest cells of every row, the own one first."""
        u = u.astype(np.float32)
        wide = min(most, len(self.first))
        sims = u @ self.first.T
        top = np.argsort(-sims, axis=1, kind="stable")[:, :wide]
        if len(self.second) == 1:
            return top.astype(np.int64)
        out = np.empty((len(u), min(most, wide * len(self.second))), np.int64)
        square = (self.second * self.second).sum(axis=1)
        for i in range(len(u)):
            rest = u[i] - self.first[top[i]]
            far = (rest * rest).sum(axis=1)[:, None] - 2 * rest @ self.second.T + square
            best = np.argsort(far.ravel(), kind="stable")[: out.shape[1]]
            out[i] = top[i][best // len(self.second)] * len(self.second) + best % len(self.second)
        return out

    def measure(self, sample: np.ndarray, k: int, least: float) -> int:
        """The fewest probes that hold the target share of the neighbours inside the sample."""
        asked = sample[: min(ASKED, len(sample))]
        sims = asked @ sample.T
        sims[np.arange(len(asked)), np.arange(len(asked))] = -2
        near = np.argpartition(-sims, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(asked), 0), np.int64)
        close = np.take_along_axis(sims, near, axis=1) >= least
        target = NEAR_TARGET
        if least <= -1 or close.sum() < ENOUGH:
            close, target = np.ones_like(close), TARGET
        most = min(MOST_PROBES, len(self))
        order, own = self.nearest(asked, most), self.nearest(sample, 1)[:, 0]
        row, col = np.nonzero(close)
        same = order[row] == own[near[row, col]][:, None]
        share = same.sum(axis=0).cumsum() / max(1, len(row)) if len(row) else np.ones(most)
        self.probes = int(np.argmax(share >= target)) + 1 if (share >= target).any() else most
        return self.probes


def fit_means(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Plain k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
        sums, count = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def _class_neighbours(classes: DataFrame, k: int, least: float) -> DataFrame:
    """a, b, sim: up to k other classes of every class."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("vector").toPandas()["vector"]
    unit = _unit(sample) if n else np.zeros((1, DIM))
    cells = Cells(unit, max(1, n // CELL_ROWS))
    probes = cells.measure(unit, k, least)

    def place(batches):
        for p in batches:
            u = _unit(p["vector"]) if len(p) else np.zeros((0, cells.first.shape[1]))
            yield pd.DataFrame({"cls": p["cls"], "unit": [x.tobytes() for x in u.astype(np.float32)], "near": list(cells.nearest(u, probes))})

    placed = stage(classes.mapInPandas(place, "cls string, unit binary, near array<bigint>"), "knn-placed")
    # blocks and lanes of every cell: a query goes to every block of its cells; a cell's queries are dealt over lanes of
    # bounded size, and its blocks to every lane, so a task holds a bounded number of either
    size = placed.groupBy(F.col("near")[0].alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = placed.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("lanes"))
    parts = stage(size.join(asks, "cell"), "knn-cells")
    salt = F.xxhash64("cls")
    data = placed.select("cls", "unit", F.col("near")[0].alias("cell")).join(parts, "cell")
    data = data.select("cls", "unit", "cell", F.pmod(salt, "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    asked = placed.select("cls", "unit", F.explode("near").alias("cell")).join(parts, "cell").withColumn("lane", F.pmod(F.xxhash64("cls", F.lit(1)), "lanes").cast("int"))
    asked = asked.select("cls", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "lane")
    both = asked.unionByName(data)

    def search(p: pd.DataFrame) -> pd.DataFrame:
        asks = p["asks"].to_numpy()
        read = lambda s: np.frombuffer(b"".join(s), dtype=np.float32).reshape(len(s), -1).astype(np.float64)
        q, d = p[asks], p[~asks]
        if not len(q) or not len(d):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        r, c, s = collision_knn(read(q["unit"]), read(d["unit"]), k, least)
        out = pd.DataFrame({"a": q["cls"].to_numpy()[r], "b": d["cls"].to_numpy()[c], "sim": s})
        return out[out.a != out.b]

    hits = both.groupBy("cell", "block", "lane").applyInPandas(search, "a string, b string, sim double")
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def neighbour_table(points: DataFrame, k: int = K, least: float = -1.0, dim: int = DIM) -> DataFrame:
    """point, neighbour, rank, sim: the k most similar other points of every valid point with cosine >= ``least``.

    Ties go to the smaller id. Points with equal vectors are each other's neighbours with cosine 1. Invalid, null and
    outdated rows are left out; a table without valid points gives no rows.
    """
    valid = valid_points(points, dim).withColumn("h", F.xxhash64("vector")).withColumn("g", F.xxhash64(F.lit(17), "vector"))
    valid = stage(valid, "knn-valid")
    classes = stage(valid.groupBy("h", "g").agg(F.min("id").alias("cls"), F.first("vector").alias("vector")), "knn-classes")
    near = stage(_class_neighbours(classes.select("cls", "vector"), k, least), "knn-near")
    members = valid.select("id", "h", "g").join(classes.select("h", "g", "cls"), ["h", "g"]).select("id", "cls")
    # of equal vectors only the first k + 1 ids can be among anyone's k nearest
    first = Window.partitionBy("cls").orderBy("id")
    heads = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select(F.col("cls").alias("b"), F.col("id").alias("neighbour"))
    own = classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("sim"))
    reach = near.unionByName(own).join(heads, "b").select(F.col("a").alias("cls"), "neighbour", "sim")
    pairs = members.join(reach, "cls").where(F.col("id") != F.col("neighbour"))
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("point"), "neighbour", "rank", F.round("sim", 6).alias("sim"))


def similar_vectors(points: DataFrame, k: int = K, least: float = 0.85, dim: int = DIM) -> DataFrame:
    """point_a, point_b: pairs with cosine >= ``least`` of which one is among the k nearest of the other."""
    near = neighbour_table(points, k, least, dim)
    return near.select(
        F.least("point", "neighbour").alias("point_a"), F.greatest("point", "neighbour").alias("point_b")
    ).distinct()
