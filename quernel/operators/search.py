"""Exact, filtered cosine top-k over a table of points.

A point has ``id``, ``seq`` (its insertion order), ``vector`` and the chunk columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import embedding, vectors
from quernel.functions.chunking import embedding_text

RESULT_COLUMNS = ["rank", "id", "score", "file", "symbol", "kind", "language", "signature", "doc", "code", "start_line", "end_line"]
MAX_QUERIES = 10_000


@dataclass(frozen=True)
class SearchFilter:
    """A conjunction: language, kind and repo are equal, file contains. Unset fields and empty texts do not filter."""

    language: str | None = None
    file: str | None = None
    kind: str | None = None
    repo: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        for name in ("language", "kind", "repo"):
            if (value := getattr(self, name)) is not None:
                out = out & (F.col(name) == value)
        if self.file is not None:
            out = out & F.col("file").contains(self.file)
        return out

    def is_empty(self) -> bool:
        return self == SearchFilter()


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10  # 0 for all
    offset: int = 0
    score_threshold: float | None = None
    filter: SearchFilter = SearchFilter()


def scored(points: DataFrame, query: list[float], options: SearchOptions = SearchOptions()) -> DataFrame:
    """Points of the query's dimension that pass the filter, with their score. Filters come before scoring, and the
    threshold, which cannot change the order, before sorting; a NaN score ranks as the lowest."""
    rows = points.where(options.filter.condition() & (F.size("vector") == len(query)))
    rows = rows.withColumn("score", F.nanvl(vectors.cosine_to(query)("vector"), F.lit(-2.0)))
    return rows if options.score_threshold is None else rows.where(F.col("score") >= options.score_threshold)


def search(points: DataFrame, query: list[float], options: SearchOptions = SearchOptions()) -> DataFrame:
    """The ranked results. Ties keep the order of insertion, then that of the ids. Narrow columns are ranked, and the payload of the few
    results is fetched afterwards."""
    narrow = scored(points, query, options).select("seq", "id", "score")
    ranked = narrow.orderBy(F.desc("score"), "seq", "id")
    if options.offset:
        ranked = ranked.offset(options.offset)
    if options.limit:
        ranked = ranked.limit(options.limit)
        order = Window.orderBy(F.desc("score"), "seq", "id")  # limit rows at most
        ranked = ranked.withColumn("rank", F.row_number().over(order) + F.lit(options.offset))
        return ranked.join(points.drop("vector", "seq"), "id").orderBy("rank")
    return ranked.join(points.drop("vector", "seq"), "id").orderBy(F.desc("score"), "seq", "id")


def query_text(text: str, language: str | None = None) -> str:
    """A query is embedded like a chunk whose signature and code are the query itself."""
    return f"[{language or ''}] \n{text}\n{text}"


def query_rows(queries: DataFrame, dim: int = embedding.DIM) -> DataFrame:
    """Adds the (fallback) vector of every query's text."""
    text = embedding_text(F.coalesce("language", F.lit("")), F.col("query_text"), F.lit(""), F.col("query_text"))
    return queries.withColumn("vector", embedding.fallback_vector(text, dim))


def batch_search(points: DataFrame, queries: DataFrame, k: int, by_language: bool = False) -> DataFrame:
    """query_id, rank, id, score: the top k of every query of a small table (query_id, vector[, language]).

    The queries are a stated set that is sent to every partition once (their number is checked); each partition keeps its
    own k best of every query, so only queries * k * partitions rows are shuffled.
    """
    import numpy as np
    import pandas as pd

    cols = ["query_id", "vector"] + (["language"] if by_language else [])
    rows = queries.select(*cols).limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries")
    sets: dict[int, tuple[list, np.ndarray]] = {}
    for dim in {len(r.vector or []) for r in rows if r.vector}:
        own = [r for r in rows if r.vector and len(r.vector) == dim]
        m = np.array([r.vector for r in own], dtype=np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        sets[dim] = (own, np.divide(m, n, out=np.zeros_like(m), where=n > 0))

    names = np.array([r.query_id for _, (own, _) in sets.items() for r in own], dtype=object)
    wanted = np.array([(r.language or "").lower() if by_language else "" for _, (own, _) in sets.items() for r in own], dtype=object)

    def run(batches):
        # of every query the k best so far: scores, places and ids, kept as arrays
        best: dict[int, tuple] = {}
        for p in batches:
            sizes = p["vector"].map(lambda v: -1 if v is None else len(v)).to_numpy()
            ids, seqs = p["id"].to_numpy(), p["seq"].to_numpy()
            tongue = p["language"].fillna("").str.lower().to_numpy() if by_language else None
            first = 0
            for dim, (own, m) in sets.items():
                here, first = first, first + len(own)
                fit = np.flatnonzero(sizes == dim)
                if not len(fit):
                    continue
                v = np.stack([p["vector"].iat[i] for i in fit]).astype(np.float64)
                n = np.sqrt((v * v).sum(axis=1, keepdims=True))
                sims = np.nan_to_num(m @ np.divide(v, n, out=np.zeros_like(v), where=n > 0).T, nan=-2.0)
                groups = {}
                for i in range(len(own)):
                    lang = wanted[here + i]
                    at = groups.get(lang)
                    if at is None:
                        at = groups[lang] = np.flatnonzero(tongue[fit] == lang) if lang else np.arange(len(fit))
                    if not len(at):
                        continue
                    s = sims[i, at]
                    if len(s) > k:  # all that reach the k-th score stay: ties are settled below
                        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
                        s = sims[i, at]
                    part = (s, seqs[fit[at]], ids[fit[at]])
                    if here + i in best:
                        part = tuple(np.concatenate(x) for x in zip(best[here + i], part))
                    order = np.lexsort((part[2], part[1], -part[0]))[:k]
                    best[here + i] = tuple(x[order] for x in part)
        if best:
            parts = [pd.DataFrame({"query_id": [names[i]] * len(s), "id": d, "seq": q, "score": s}) for i, (s, q, d) in best.items()]
            yield pd.concat(parts)

    kind = dict(queries.dtypes)["query_id"]
    some = points.select("id", "seq", "vector", *(["language"] if by_language else []))
    hits = some.mapInPandas(run, f"query_id {kind}, id string, seq bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seq")


def results(found: DataFrame) -> DataFrame:
    """The columns of a result list."""
    return found.select(*[c for c in RESULT_COLUMNS if c in found.columns])
