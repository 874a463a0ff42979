"""Retrieval quality: top-1 and top-5 accuracy and mean reciprocal rank, in all and by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.vectors import contains_any
from quernel.schema import EVAL_QUERY

TOP = 5
#: The built-in queries: language, text, expected symbols. Fixed values.
BUILT_IN = [
    ("rust", "function that takes two integers and returns their sum", ["add"]),
    ("rust", "a struct representing a 2D point with coordinates", ["Point", "Point2D"]),
    ("rust", "trait for sorting algorithm implementations", ["Sort", "Sorter", "Sortable"]),
    ("python", "class representing a HTTP request handler", ["RequestHandler", "HttpHandler"]),
    ("python", "function that validates email addresses using regex", ["validate_email", "is_valid_email"]),
    ("python", "decorator for logging function calls", ["log_calls", "logged"]),
    ("javascript", "function that fetches data from an API endpoint", ["fetchData", "getData", "fetch"]),
    ("javascript", "React component for rendering a user profile card", ["UserProfile", "ProfileCard"]),
    ("java", "interface for database CRUD operations", ["Repository", "CrudRepository"]),
    ("java", "singleton configuration manager class", ["ConfigManager", "Configuration"]),
    ("go", "struct representing an HTTP request with headers and body", ["Request", "HttpRequest"]),
    ("go", "interface for data persistence layer", ["Store", "Repository", "Storage"]),
]


def built_in_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c, []) for a, b, c in BUILT_IN], EVAL_QUERY)


def of_language(queries: DataFrame, language: str | None) -> DataFrame:
    return queries if language is None else queries.where(F.lower("language") == language.lower())


def judge(queries: DataFrame, hits: DataFrame, compat_empty: bool = False) -> DataFrame:
    """query_id, language, first_hit, reciprocal_rank of every query (query_id, language, expected_symbols).

    ``hits`` has query_id, rank and symbol. A hit counts up to rank 5. ``compat_empty`` lets an empty symbol match, as any
    name contains it; by default it does not.
    """
    match = contains_any("symbol", "expected_symbols")
    if not compat_empty:
        match = match & (F.col("symbol") != "")
    found = hits.where(F.col("rank") <= TOP).join(queries.select("query_id", "expected_symbols"), "query_id")
    first = found.where(match).groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    out = queries.select("query_id", F.lower("language").alias("language")).join(first, "query_id", "left")
    return out.withColumn("reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)))


def metrics(judged: DataFrame) -> DataFrame:
    """One row for each language and one, language "all", for all queries; zeros where there are no queries."""
    share = lambda top: F.coalesce(F.avg((F.coalesce("first_hit", F.lit(99)) <= top).cast("double")), F.lit(0.0))
    aggs = [share(1).alias("top1"), share(TOP).alias("top5"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"), F.count("query_id").alias("n_queries")]
    each = judged.groupBy("language").agg(*aggs)
    return each.unionByName(judged.agg(*aggs).withColumn("language", F.lit("all")))
