"""A search result as a graph: nodes with a size, links between results of one file or module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_size(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.floor(F.least(F.greatest(s * 20, F.lit(3.0)), F.lit(20.0))).cast("int")


def nodes(ranked: DataFrame, brief: bool = False) -> DataFrame:
    """Nodes of a ranked result, named by their symbols and with their code; ``brief`` leaves out module, size and lines."""
    name = [F.col("symbol").alias("name")] if "symbol" in ranked.columns else []
    cols = [c for c in ("id", "rank", "kind", "language", "file", "score", "code") if c in ranked.columns]
    if brief:
        return ranked.select(*cols, *name)
    more = [c for c in ("module", "doc", "signature", "start_line", "end_line") if c in ranked.columns]
    return ranked.select(*cols, *name, *more, node_size("score").alias("val"))


def links(ranked: DataFrame) -> DataFrame:
    """source, target, relation for every pair of a ranked result in one file or module; the better rank is the source.
    The input is a top-k, so the pairs are bounded by its limit."""

    def within(column: str, relation: str) -> DataFrame:
        keyed = ranked.where(F.col(column).isNotNull() & (F.col(column) != "")).select("id", "rank", F.col(column).alias("key"))
        a = keyed.select(F.col("id").alias("source"), F.col("rank").alias("ra"), "key")
        b = keyed.select(F.col("id").alias("target"), F.col("rank").alias("rb"), "key")
        return a.join(b, "key").where(F.col("ra") < F.col("rb")).select("source", "target", F.lit(relation).alias("relation"), "ra", "rb")

    both = within("file", "same_file")
    if "module" in ranked.columns:
        both = both.unionByName(within("module", "same_module"))
    return both.orderBy("ra", "rb", "relation").select("source", "target", "relation")
