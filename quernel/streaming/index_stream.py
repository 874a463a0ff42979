"""Indexing as a stream: each micro-batch of changed files is chunked, embedded and upserted into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators import index
from quernel.operators.store import PointStore
from quernel.session import stage


def start(files: DataFrame, store: PointStore, checkpoint: str, config: index.IndexConfig = index.IndexConfig(), **trigger):
    """A running query over a stream (repo, branch, commit, path, content, committed_at). Of several versions of a path in
    a batch the last committed holds; null content deletes. Ids are stable, so a batch that runs twice leaves the same
    store."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        last = Window.partitionBy("repo", "path").orderBy(F.desc("committed_at"), F.desc("commit"))
        rows = stage(batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n"), f"stream-{batch_id}")
        made = stage(index.points(index.chunks(rows.where(F.col("content").isNotNull()), config), config), f"stream-points-{batch_id}")
        gone = rows.select("repo", F.col("path").alias("file")).distinct()
        store.apply(made, gone_files=gone)

    writer = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_changes(changes: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts of changes by repository, status and time window; late rows count within the delay."""
    rows = changes.withWatermark("changed_at", delay)
    return rows.groupBy(F.window("changed_at", width).alias("w"), "repo", F.initcap("status").alias("status")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "repo", "status", "n"
    )
