"""Full and incremental indexing: files to symbols and documents, to chunks, to vectors, to the point store."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import chunking, detect, embedding, symbols
from quernel.operators import diff
from quernel.operators.store import PointStore
from quernel.session import stage
from quernel.sources.state import StateStore


@dataclass(frozen=True)
class IndexConfig:
    dim: int = embedding.DIM
    max_chunk_size: int = chunking.MAX_SIZE
    overlap: int = chunking.OVERLAP
    include_docs: bool = True
    include_signatures: bool = True
    strip_markdown: bool = True
    compat_language: bool = False
    random_ids: bool = False  # a new UUID for each chunk, so that a repeated run makes other rows
    tracked_languages: list[str] | None = None
    model: str = "default"
    embedder: embedding.Embedder | None = field(default=None, compare=False)


@dataclass
class IndexStats:
    files_processed: int = 0
    symbols_extracted: int = 0
    chunks_created: int = 0
    embeddings_generated: int = 0
    fallbacks: int = 0  # of them, vectors that do not come from the embedder
    duration: float = 0.0


def text_files(files: DataFrame) -> DataFrame:
    """Files up to 1 MiB whose bytes are UTF-8, with ``content`` as text; binary content is checked, text stays."""
    rows = files.where(F.octet_length("content") <= symbols.MAX_FILE)
    if dict(files.dtypes)["content"] == "binary":
        text = F.try_validate_utf8(F.col("content").cast("string"))
        rows = rows.withColumn("content", text).where(F.col("content").isNotNull())
    return rows


def chunks(files: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Chunk rows of a table (repo, branch, commit, path, content). A file whose path tells a language is code and gives
    chunks of its symbols only, whatever document format its name has; the others are read as documents."""
    rows = text_files(files)
    found = symbols.symbols(rows, config.compat_language, config.tracked_languages)
    code = chunking.symbol_chunks(found, config.include_docs, config.include_signatures, config.compat_language, config.random_ids)
    rows = rows.where(detect.language_by_path("path").isNull())
    return code.unionByName(chunking.document_chunks(rows, config.max_chunk_size, config.overlap, config.strip_markdown, config.random_ids))


def points(chunk_rows: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Chunks with vectors and the model that made each. ``seq`` orders them by file and line within their batch."""
    text = chunking.embedding_text("language", "signature", "doc", "code")
    rows = embedding.embed(chunk_rows.withColumn("__text", text), "__text", config.embedder, config.dim, config.model)
    return rows.drop("__text").withColumn("seq", F.monotonically_increasing_id())


class Indexer:
    def __init__(self, store: PointStore, state: StateStore, config: IndexConfig = IndexConfig()):
        self.store, self.state, self.config = store, state, config

    def _stats(self, files: DataFrame, made: DataFrame, began: float) -> IndexStats:
        row = made.agg(F.count("*").alias("chunks"), F.count_if((F.col("kind") != "document") & ~F.col("kind").endswith("_doc")).alias("symbols"), F.count_distinct("file").alias("files"), F.count_if(F.col("model").endswith("-fallback")).alias("fallbacks")).first()
        return IndexStats(row.files, row.symbols, row.chunks, row.chunks, row.fallbacks, time.time() - began)

    def full(self, files: DataFrame, repo: str, commit: str) -> IndexStats:
        """Index a whole snapshot; the repository's earlier rows are replaced."""
        began = time.time()
        made = stage(points(chunks(files, self.config), self.config), "index-full")
        self.store.apply(made, gone=F.col("repo") == repo)
        self.state.set(repo, commit)
        return self._stats(files, made, began)

    def incremental(self, old: DataFrame, new: DataFrame, repo: str, commit: str, fetch: Callable[[DataFrame], DataFrame] | None = None) -> IndexStats:
        """Index what differs between two snapshots; the first run indexes all. Rows of changed and deleted files go by
        exact path; the state moves last. Where the snapshots are only listed, ``fetch`` reads the contents of the files
        that are indexed."""
        fetch = fetch or (lambda rows: rows)
        if self.state.get(repo) is None:
            return self.full(fetch(new), repo, commit)
        began = time.time()
        changes = stage(diff.diff_snapshots(old, new), "index-changes")
        fresh = fetch(new.join(changes.where(F.col("status") != "Deleted").select("path"), "path", "left_semi")).withColumn("commit", F.lit(commit))
        made = stage(points(chunks(fresh, self.config), self.config), "index-fresh")
        gone = changes.where(F.col("status") != "Added").select(F.lit(repo).alias("repo"), F.col("path").alias("file"))
        self.store.apply(made, gone_files=gone)
        self.state.set(repo, commit)
        return self._stats(fresh, made, began)

    def extract_only(self, files: DataFrame) -> DataFrame:
        """Code chunks without vectors."""
        rows = text_files(files)
        found = symbols.symbols(rows, self.config.compat_language, self.config.tracked_languages)
        return chunking.symbol_chunks(found, self.config.include_docs, self.config.include_signatures, self.config.compat_language, self.config.random_ids)


def surviving(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the rows that an incremental run leaves in place: those of files that did not change."""
    changes = diff.diff_snapshots(old, new, keys).where(F.col("status") != "Added")
    return old.join(changes.select(*keys), keys, "left_anti")
