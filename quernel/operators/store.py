"""A vector table on Parquet with upserts and deletes.

Rows lie in buckets by repository and file. A write makes new folders for the buckets that it touches and then replaces
one small manifest in a single step, so readers see whole versions only and an interrupted write leaves the old one in
place. Folders that no manifest needs any more stay for a retention time, for readers that began before.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.operators.search import SearchFilter, SearchOptions, search
from quernel.schema import CHUNK, CHUNK_COLUMNS

POINT = f"{CHUNK}, vector array<float>, seq bigint"


def latest_points(points: DataFrame) -> DataFrame:
    """The row that holds of each id of a table (id, vector, payload, upserted_at): the one written last. Flat columns;
    ``seq`` numbers the ids by their first writing, without gathering rows in one task."""
    rows = points.where(F.col("id").isNotNull())
    # the payload takes part in the order only where times are equal, which makes the choice the same in every run
    last = rows.groupBy("id").agg(
        F.max_by(F.struct("vector", "payload"), F.struct("upserted_at", F.xxhash64("vector"))).alias("v"), F.min("upserted_at").alias("first")
    )
    payload = [F.col(f"v.payload.{c}").alias(c) for c in CHUNK_COLUMNS if c != "id"]
    seq = F.coalesce(F.unix_micros(F.col("first").cast("timestamp")), F.lit(0)) * 1
    return last.select("id", *payload, F.col("v.vector").alias("vector"), seq.alias("seq"))


def upsert(old: DataFrame, batch: DataFrame, top: int | None = None) -> DataFrame:
    """``batch`` (id, vector, payload columns, ``seq`` its order) over ``old``: the last row of an id in the batch wins, an
    existing row keeps its place, new ones follow after the old, from ``top`` on where it is given."""
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    news = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    if top is None:
        top = old.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    place = old.select("id", F.col("seq").alias("__old"))
    news = news.join(place, "id", "left").withColumn("seq", F.coalesce("__old", F.lit(top) + F.col("seq"))).drop("__old")
    return old.join(news.select("id"), "id", "left_anti").unionByName(news.select(*old.columns))


def delete_where(points: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold; one that is null does not delete."""
    return points.where(~F.coalesce(condition, F.lit(False)))


def delete_matching(points: DataFrame, filter: SearchFilter) -> DataFrame:
    """Without the rows that match all set fields; an empty filter matches all."""
    return delete_where(points, filter.condition())


def stats(points: DataFrame) -> DataFrame:
    """One row: count of points and dimension of the first vector, 0 without any."""
    first = F.min_by(F.size("vector"), "seq")
    return points.agg(F.count("*").alias("points"), F.coalesce(first, F.lit(0)).alias("dimension"))


@dataclass
class PointStore:
    """``buckets`` holds for a new store; more of them make a write of few files touch less. ``retain_hours`` is how long
    folders stay that the current version does not need."""

    spark: SparkSession
    path: str
    dim: int | None = None
    buckets: int = 64
    retain_hours: float = 24.0

    # files

    @property
    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path

    def _manifest(self) -> dict:
        """``parts`` (folder of each bucket), ``buckets``, ``next`` (the first free place) and ``version``."""
        fs, path = self._fs
        at = path(f"{self.path}/CURRENT")
        if not fs.exists(at):
            return {"version": None, "buckets": self.buckets, "next": 0, "parts": {}}
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, seen: dict, new: dict) -> None:
        """Replace the manifest in one step; refuses when another writer was faster."""
        fs, path = self._fs
        jvm = self.spark._jvm
        root = fs.makeQualified(path(self.path))
        temp = path(root, f".CURRENT-{new['version']}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._manifest()["version"] != seen["version"]:
            fs.delete(temp, False)
            raise RuntimeError(f"{self.path} was written by another job; read it again and repeat")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        files.rename(temp, path(root, "CURRENT"), how)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("repo", "file"), F.lit(n)).cast("int")

    def _read(self, m: dict, only: set[int] | None = None) -> DataFrame:
        at = [f"{self.path}/{folder}" for b, folder in m["parts"].items() if only is None or int(b) in only]
        return self.spark.read.schema(POINT).parquet(*at) if at else self.spark.createDataFrame([], POINT)

    def _replace(self, m: dict, touched: set[int] | None, rows: DataFrame) -> None:
        """Write ``rows`` as the new content of the touched buckets (all for None)."""
        v = uuid.uuid4().hex
        cols = [f.split()[0] for f in POINT.split(", ")]
        out = rows.select(*cols, self._bucket(m["buckets"]).alias("bucket"))
        # rebalancing splits large buckets and keeps small ones in one file
        out.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/v-{v}")
        fs, path = self._fs
        made = {s.getPath().getName().split("=")[1]: f"v-{v}/{s.getPath().getName()}" for s in fs.listStatus(path(f"{self.path}/v-{v}")) if "=" in s.getPath().getName()}
        kept = {} if touched is None else {b: f for b, f in m["parts"].items() if int(b) not in touched}
        top = self.spark.read.schema(POINT).parquet(*[f"{self.path}/{f}" for f in made.values()]).agg(F.max("seq")).first()[0] if made else None
        self._switch(m, {"version": v, "buckets": m["buckets"], "next": max(m["next"], -1 if top is None else top + 1), "parts": kept | made})
        self.vacuum()

    def vacuum(self, hours: float | None = None) -> int:
        """Delete bucket folders that the current version does not need and that are older than the retention time."""
        fs, path = self._fs
        if not fs.exists(path(self.path)):
            return 0
        need = set(self._manifest()["parts"].values())
        before, n = (time.time() - 3600 * (self.retain_hours if hours is None else hours)) * 1000, 0
        for version in fs.listStatus(path(self.path)):
            name = version.getPath().getName()
            if not name.startswith("v-") or version.getModificationTime() > before:
                continue
            parts = [s.getPath() for s in fs.listStatus(version.getPath()) if "=" in s.getPath().getName()]
            old = [p for p in parts if f"{name}/{p.getName()}" not in need]
            for p in [version.getPath()] if len(old) == len(parts) else old:
                fs.delete(p, True)
                n += 1
        return n

    # rows

    def load(self) -> DataFrame:
        """The points; an absent table is an empty one."""
        return self._read(self._manifest())

    def save(self, points: DataFrame) -> None:
        """Replace all points."""
        self._replace(self._manifest(), None, points)

    def apply(self, batch: DataFrame | None = None, gone: Column | None = None, gone_files: DataFrame | None = None) -> None:
        """In one new version: without the rows that fulfil ``gone`` or belong to ``gone_files`` (repo, file), and with
        ``batch`` over the rest. Only buckets with such rows are rewritten; the others are looked at by id and file alone."""
        m = self._manifest()
        n, old = m["buckets"], self._read(m)
        at = self._bucket(n).alias("bucket")
        marks = []
        if gone is not None:
            marks.append(old.where(F.coalesce(gone, F.lit(False))).select(at))
        if gone_files is not None:
            marks.append(gone_files.select(at))
        if batch is not None:
            if self.dim is not None and not batch.where(F.size("vector") != self.dim).isEmpty():
                raise ValueError(f"vectors are not of dimension {self.dim}")
            marks += [batch.select(at), old.join(batch.select("id"), "id", "left_semi").select(at)]
        touched: set[int] = set()
        for x in marks:
            touched |= {r.bucket for r in x.distinct().collect()}  # at most ``buckets`` rows
        if not touched:
            return
        rows = self._read(m, touched)
        if gone is not None:
            rows = delete_where(rows, gone)
        if gone_files is not None:
            rows = rows.join(gone_files.select("repo", "file").distinct(), ["repo", "file"], "left_anti")
        self._replace(m, touched, rows if batch is None else upsert(rows, batch, m["next"]))

    def upsert(self, batch: DataFrame) -> None:
        self.apply(batch)

    def delete(self, id: str) -> None:
        self.apply(gone=F.col("id") == id)

    def delete_by_filter(self, filter: SearchFilter) -> None:
        """Rows that match all set fields; an empty filter matches all."""
        self.apply(gone=filter.condition())

    def delete_by_language(self, language: str) -> None:
        self.delete_by_filter(SearchFilter(language=language))

    def delete_by_file(self, file: str) -> None:
        """Rows of exactly this file; the search filter's substring match would take others with it."""
        self.apply(gone=F.col("file") == file)

    def clear(self) -> None:
        self.save(self.spark.createDataFrame([], POINT))

    def drop(self) -> None:
        fs, path = self._fs
        fs.delete(path(self.path), True)

    def contains(self, id: str) -> bool:
        return not self.load().where(F.col("id") == id).isEmpty()

    def count(self) -> int:
        return self.load().count()

    def stats(self) -> dict:
        """Points, dimension and bytes of the current version."""
        m = self._manifest()
        row = stats(self._read(m)).first()
        fs, path = self._fs
        size = sum(fs.getContentSummary(path(f"{self.path}/{f}")).getLength() for f in m["parts"].values())
        return {"points": row.points, "dimension": row.dimension, "bytes": size}

    def search(self, query: list[float], options: SearchOptions = SearchOptions()) -> DataFrame:
        return search(self.load(), query, options)
