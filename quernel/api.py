"""The service's verbs as methods: index, search, graph, evaluation and repository information."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import detect, embedding
from quernel.functions.chunking import embedding_text
from quernel.operators import evaluate, graph, report, search
from quernel.operators.index import IndexConfig, Indexer, IndexStats
from quernel.operators.store import PointStore
from quernel.session import stage
from quernel.sources import git
from quernel.sources.state import StateStore


@dataclass(frozen=True)
class Config:
    """Settings; environment variables come before a ``.env`` file, that before a JSON file."""

    store: str = "embed"
    state: str = "state.json"
    dim: int = embedding.DIM
    model: str = "default"
    limit: int = 10
    score_threshold: float = 0.5

    @classmethod
    def load(cls, json_file: str | None = None, env_file: str | None = None, prefix: str = "QUERNEL_") -> Config:
        values: dict = {}
        if json_file and os.path.exists(json_file):
            with open(json_file, encoding="utf-8") as f:
                values |= json.load(f)
        lines = []
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                lines = [x.strip().split("=", 1) for x in f if "=" in x and not x.lstrip().startswith("#")]
        env = {k.strip(): v.strip().strip("\"'") for k, v in lines} | dict(os.environ)
        for f in fields(cls):
            if (v := env.get(prefix + f.name.upper())) is not None:
                values[f.name] = v
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in values.items() if k in kinds})

    def show(self) -> str:
        return json.dumps(asdict(self), indent=1)


@dataclass
class Engine:
    spark: SparkSession
    config: Config = field(default_factory=Config)
    embedder: embedding.Embedder | None = None

    def __post_init__(self):
        self.store = PointStore(self.spark, self.config.store)
        self.state = StateStore(self.config.state)
        self.running = False

    def index(self, repo_path: str, repo: str | None = None, branch: str | None = None, full: bool = False) -> IndexStats:
        """Index a git repository's branch, only what changed since the last run unless ``full``."""
        if self.running:
            raise RuntimeError("an index run is under way")
        self.running = True
        try:
            repo = repo or os.path.basename(os.path.abspath(repo_path))
            branch = branch or git.default_branch(repo_path)
            commit, last = git.find_commit(repo_path, branch), self.state.get(repo)
            tree = lambda rev, content: git.read_tree(self.spark, repo_path, rev, content=content).withColumns({"repo": F.lit(repo), "branch": F.lit(branch), "commit": F.lit(rev)})
            indexer = Indexer(self.store, self.state, IndexConfig(dim=self.config.dim, model=self.config.model, embedder=self.embedder))
            if full or last is None:
                return indexer.full(tree(commit, True), repo, commit)
            return indexer.incremental(tree(last, False), tree(commit, False), repo, commit, lambda rows: git.with_content(rows, repo_path))
        finally:
            self.running = False

    def vector(self, text: str, language: str | None = None) -> list[float]:
        if self.embedder is None:
            return embedding.fallback_values(search.query_text(text, language), self.config.dim)
        row = self.spark.createDataFrame([(language or "", text)], "language string, q string")
        row = row.withColumn("t", embedding_text("language", "q", F.lit(""), "q"))
        return list(embedding.embed(row, "t", self.embedder, self.config.dim, self.config.model).first().vector)

    def search(self, text: str, limit: int | None = None, threshold: float | None = None, offset: int = 0, **filters) -> DataFrame:
        options = search.SearchOptions(self.config.limit if limit is None else limit, offset, self.config.score_threshold if threshold is None else threshold, search.SearchFilter(**filters))
        return self.store.search(self.vector(text, filters.get("language")), options)

    def search_graph(self, text: str, **kw) -> tuple[DataFrame, DataFrame]:
        """Nodes and links of a result; its links are pairs, so a limit is asked for."""
        if (self.config.limit if kw.get("limit") is None else kw["limit"]) <= 0:
            raise ValueError("a graph needs a limit above 0")
        ranked = stage(self.search(text, **kw), "graph")
        return graph.nodes(ranked), graph.links(ranked)

    def search_text(self, text: str, **kw) -> str:
        return "\n\n".join(r.text for r in report.text_list(self.search(text, **kw)).orderBy("rank").collect())

    def search_markdown(self, text: str, **kw) -> str:
        return "\n\n".join(r.markdown for r in report.markdown(self.search(text, **kw)).orderBy("rank").collect())

    def evaluate(self, queries: DataFrame | None = None, language: str | None = None) -> DataFrame:
        rows = evaluate.of_language(queries if queries is not None else evaluate.built_in_queries(self.spark), language)
        rows = search.query_rows(rows.withColumn("query_id", F.xxhash64("language", "query_text")), self.config.dim)
        points = self.store.load()
        hits = search.batch_search(points, rows, evaluate.TOP, by_language=True).join(points.select("id", "symbol"), "id")
        return evaluate.metrics(evaluate.judge(rows, hits))

    def index_status(self) -> dict:
        return {"running": self.running, **self.store.stats()}

    def repo_info(self, repo_path: str) -> dict:
        return {"head": git.find_commit(repo_path), "branch": git.current_branch(repo_path), "branches": git.branches(repo_path)}

    def repo_tree(self, repo_path: str, limit: int = 50) -> tuple[list[str], int]:
        """The first paths and how many more there are."""
        rows = git.read_tree(self.spark, repo_path).select("path").orderBy("path")
        shown = [r.path for r in rows.limit(limit).collect()]
        return shown, rows.count() - len(shown)

    def languages(self) -> DataFrame:
        return detect.capabilities(self.spark)

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
