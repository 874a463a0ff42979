"""Problem 3: near-duplicate functions by a signature-coordinate inverted join.

A function is the set of its word triples. Its signature has ``COORDS`` minima under different hash functions, and it
is posted under each coordinate-value pair. Functions at similarity 0.6 agree in 12 of 20 coordinates on average and in
fewer than ``MATCHES`` three times in ten thousand. Lists are not merged in full: the pairs are put in one global order,
rare ones first, and only the first COORDS - MATCHES + MET of each signature are joined; two signatures that agree in
MATCHES places agree in at least MET of those. The long lists at the end are skipped and only looked up in the
candidate's signature. Candidates with enough collisions are verified by their exact triples.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.tokens import strings
from quernel.session import drop_stages, spread, stage

COORDS = 20
MATCHES = 5
MET = 2  # collisions in the joined prefixes
MIN_WORDS = 30
THRESHOLD = 0.6
SLOTS = 1 << 18  # counters of coordinate-value pairs; fixed, they only order the pairs
_WORD = re.compile(r"[A-Za-z0-9_]+")
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, size=(2, COORDS), dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode())
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def triple_sets(texts: list[str], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first position, hashes): the distinct word-triple hashes of every text with enough words; those of
    text index[i] are hashes[first[i]:first[i + 1]], sorted."""
    hashes, sizes, index = [], [], []
    for i, t in enumerate(texts):
        w = _WORD.findall(t)
        if len(w) >= max(3, min_words):
            hashes += [_words[x] for x in w]
            sizes.append(len(w))
            index.append(i)
    if not index:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    h, n = np.array(hashes, np.uint64), np.array(sizes)
    doc = np.repeat(np.arange(len(n)), n)
    t = h[:-2] * np.uint64(0xD6E8FEB86659FD93) + _mix(h[1:-1]) * np.uint64(3) + _mix(h[2:] * np.uint64(0xA0761D6478BD642F))
    t, d = _mix(t)[doc[:-2] == doc[2:]], doc[:-2][doc[:-2] == doc[2:]]
    by = np.lexsort((t, d))
    t, d = t[by], d[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    t, d = t[new], d[new]
    return np.array(index), np.searchsorted(d, np.arange(len(n) + 1)), t


def signatures(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The 64-bit value of every coordinate, one row for each text: minima of large collections lie close together, so that
    fewer bits would let strangers collide."""
    out = np.empty((len(first) - 1, COORDS), np.uint64)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(_mix(hashes * _SEEDS[0, k] + _SEEDS[1, k]), first[:-1])
    return out.view(np.int64)


def _signed(chunks: DataFrame, min_words: int) -> DataFrame:
    """id, cls (128 bits of the triple set), key (the first 64 of them), sig and triples (32 bits each) of every function
    and method row."""

    def run(batches):
        for batch in batches:
            index, first, t = triple_sets(strings(batch.column(1)), min_words)
            sig = signatures(first, t) if len(index) else np.zeros((0, COORDS), np.int64)
            raw = t.tobytes()
            cls = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(index, pa.int64())),
                    pa.array(cls, pa.binary()),
                    pa.array([int.from_bytes(c[:8], "little", signed=True) for c in cls], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1) * COORDS, pa.int32()), pa.array(sig.ravel())),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array((t >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                ],
                ["id", "cls", "key", "sig", "triples"],
            )

    rows = chunks.where(F.col("kind").isin("function", "method") & F.col("code").isNotNull() & F.col("id").isNotNull())
    return spread(rows.select("id", "code"), "id").mapInArrow(run, "id string, cls binary, key bigint, sig array<bigint>, triples array<int>")


def _prefixes(classes: DataFrame) -> DataFrame:
    """key and its rarest COORDS - MATCHES + MET coordinate-value pairs, each as one 64-bit hash of both."""
    pairs = classes.select(F.posexplode("sig").alias("k", "v"))
    counted = pairs.groupBy(F.pmod(F.xxhash64("k", "v"), F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    # Only counters clearly above the mean tell long lists; at most 1 in 4 can be, and no row of the corpus is left out.
    mean = max(1.0, classes.count() * COORDS / SLOTS)
    long = {r.slot: r.n for r in counted.where(F.col("n") > 4 * mean + 8).collect()}
    weights = classes.sparkSession.sparkContext.broadcast(long)  # fewer than SLOTS / 4 entries whatever the corpus
    width = COORDS - MATCHES + MET

    def run(batches):
        import pandas as pd

        for p in batches:
            sig = np.array(list(p["sig"]), np.int64).reshape(len(p), COORDS).view(np.uint64)
            slots = np.array(list(p["slots"]), np.int64).reshape(len(p), COORDS)
            known = weights.value
            n = np.zeros(slots.shape, np.int64)
            if known:
                keys, counts = np.array(sorted(known)), np.array([known[x] for x in sorted(known)])
                at = np.minimum(np.searchsorted(keys, slots), len(keys) - 1)
                n = np.where(keys[at] == slots, counts[at], 0)
            sig = _mix(sig ^ _SEEDS[1]).view(np.int64)
            order = np.lexsort((sig, n), axis=1)[:, :width]
            yield pd.DataFrame({"key": p["key"], "prefix": list(np.take_along_axis(sig, order, axis=1))})

    slots = F.transform("sig", lambda v, k: F.pmod(F.xxhash64(k, v), F.lit(SLOTS)).cast("int"))
    return classes.select("key", "sig", slots.alias("slots")).mapInPandas(run, "key bigint, prefix array<bigint>")


def class_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b and sim: classes whose triple sets have at least this similarity. Two classes with the same 64-bit key are
    both looked at wherever the key was met, and the exact check parts them."""
    posted = _prefixes(classes).select("key", F.explode("prefix").alias("pair"))
    a, b = posted.select(F.col("key").alias("x"), "pair"), posted.select(F.col("key").alias("y"), "pair")
    met = a.join(b, "pair").where(F.col("x") < F.col("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") >= MET).select("x", "y")
    # the signatures decide first; only what they let through meets its triples
    left = classes.select(F.col("key").alias("x"), F.col("cls").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("key").alias("y"), F.col("cls").alias("b"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda n, z: n + z)
    rows = met.join(left, "x").join(right, "y").where(agree >= MATCHES).select("a", "b")
    rows = rows.join(classes.select(F.col("cls").alias("a"), F.col("triples").alias("ta")), "a").join(classes.select(F.col("cls").alias("b"), F.col("triples").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    rows = rows.select("a", "b", both.alias("both"), (F.size("ta") + F.size("tb")).alias("sizes"))
    sim = F.col("both") / (F.col("sizes") - F.col("both"))
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), sim.alias("sim")).where(F.col("sim") >= threshold)


def _classes(chunks: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    rows = stage(_signed(chunks, min_words), "dup-signed")
    classes = stage(rows.select("cls", "key", "sig", "triples").dropDuplicates(["cls"]), "dup-classes")
    return rows.select("id", "cls").distinct(), classes


def similar_pairs(chunks: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """chunk_a < chunk_b: ids of functions and methods whose word triples are alike, those with equal code included.

    Rows with null id or code and rows with fewer than ``min_words`` words form no pair; copies of a row count once;
    an empty table gives no pairs.
    """
    members, classes = _classes(chunks, min_words)
    pairs = class_pairs(classes, threshold).select("a", "b")
    members = stage(members, "dup-members")
    left, right = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right, left.a == right.b).where(F.col("x") < F.col("y")).select("x", "y")
    out = across.unionByName(within).where(F.col("x") != F.col("y"))
    return out.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and label: the least node of its component, by label spreading with pointer jumping.

    Every round is written to the shared folder; labels never gather on the driver.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    held = stage(nodes.select("node", F.col("node").alias("label")), "cc-0")
    labels = held
    for turn in range(1, 64):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        new = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", "least").alias("next"))
        half = stage(new, f"cc-{turn}a")
        up = half.select(F.col("node").alias("at"), F.col("next").alias("up"))
        new = stage(
            half.join(up, half.next == up.at, "left").select("node", F.col("label").alias("old"), F.least("next", "up").alias("label")), f"cc-{turn}b"
        )
        drop_stages(nodes.sparkSession, held, half)
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        held, labels = new, new.select("node", "label")
    raise RuntimeError("labels did not settle")


def similar_groups(chunks: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each function id: its class (the least id of the group), the distinct texts of that group that it is
    directly linked to, and the number of rows with its own text."""
    members, classes = _classes(chunks, min_words)
    members = stage(members, "dup-members")
    pairs = stage(class_pairs(classes, threshold), "dup-pairs")
    label = components(classes.select(F.col("cls").alias("node")), pairs)
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    links = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    heads = members.groupBy("cls").agg(F.min("id").alias("head"), F.count("*").alias("n_copies"))
    info = heads.join(label, heads.cls == label.node).join(links, "cls", "left").select("cls", "label", "head", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    name = info.groupBy("label").agg(F.min("head").alias("class_id"))
    info = info.join(name, "label").select("cls", "class_id", "n_links", "n_copies")
    return members.join(info, "cls").select(F.col("id").alias("chunk_id"), "class_id", "n_links", "n_copies")
