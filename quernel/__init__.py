"""Quernel: a Spark-first engine for semantic retrieval over source code and documents."""

from quernel.api import Config, Engine
from quernel.operators.index import IndexConfig, Indexer, IndexStats
from quernel.operators.search import SearchFilter, SearchOptions
from quernel.operators.store import PointStore
from quernel.session import build_session
from quernel.sources.state import StateStore

__version__ = "0.2.0"
__all__ = ["Config", "Engine", "IndexConfig", "IndexStats", "Indexer", "PointStore", "SearchFilter", "SearchOptions", "StateStore", "build_session"]
