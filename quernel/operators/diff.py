"""Snapshot differences: which paths were added, modified or deleted between two file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.schema import CHANGE_KINDS


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, status, old_blob_id, new_blob_id of every path whose blob differs; modes are ignored."""
    keys = keys or ["path"]
    a = old.select(*keys, F.col("blob_id").alias("old_blob_id"), F.lit(True).alias("was")).dropDuplicates(keys)
    b = new.select(*keys, F.col("blob_id").alias("new_blob_id"), F.lit(True).alias("now")).dropDuplicates(keys)
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("was").isNull(), "Added").when(F.col("now").isNull(), "Deleted").when(~F.col("old_blob_id").eqNullSafe(F.col("new_blob_id")), "Modified")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(*keys, "status", "old_blob_id", "new_blob_id")


def clean_changes(changes: DataFrame) -> DataFrame:
    """Copies dropped and the status written as in ``CHANGE_KINDS``; rows with another status are left out."""
    status = F.initcap(F.trim("status"))
    return changes.withColumn("status", status).where(status.isin(*CHANGE_KINDS)).distinct()


def latest_snapshot(changes: DataFrame) -> DataFrame:
    """repo, path, blob_id after all changes: the latest change of each path decides; deleted paths are gone."""
    last = clean_changes(changes).groupBy("repo", "path").agg(F.max(F.struct("changed_at", "new_blob_id", "status")).alias("last"))
    return last.where(F.col("last.status") != "Deleted").select("repo", "path", F.col("last.new_blob_id").alias("blob_id"))


def with_status(changes: DataFrame, status: str) -> DataFrame:
    return changes.where(F.col("status") == status)


def affected_paths(changes: DataFrame) -> DataFrame:
    return changes.select("path").distinct()


def filter_changes(changes: DataFrame, condition: Column) -> DataFrame:
    """A caller's own predicate over path and status."""
    return changes.where(F.coalesce(condition, F.lit(False)))


def diff_stats(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, in all or by columns. Insertions and deletions of lines are summed where the table has them."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("insertions", "deletions") if c in changes.columns]
    aggs = [*map(count, CHANGE_KINDS), *sums]
    return changes.groupBy(*by).agg(*aggs) if by else changes.agg(*aggs)
