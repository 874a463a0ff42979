"""Search results as text lines, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.chunking import _utf8_prefix
from quernel.operators import graph

DOC_BYTES = 100


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _signature() -> Column:
    """Whether a result has a signature that says more than its name."""
    return _given("signature") & (F.col("signature") != F.coalesce("symbol", F.lit("")))


def text_list(ranked: DataFrame) -> DataFrame:
    """rank and the text block of each result: place, kind and score; symbol, file, the first 100 bytes of documentation,
    a signature that differs from the symbol, and the first line of code."""
    line = lambda label, value: F.concat(F.lit(f"   {label}: "), F.coalesce(value, F.lit("")))
    head = F.format_string("%d. [%s] %.2f", F.col("rank").cast("int"), F.coalesce("kind", F.lit("")), F.col("score"))
    code = F.regexp_replace(F.substring_index(F.coalesce("code", F.lit("")), "\n", 1), r"\r$", "")
    parts = [
        head, line("Symbol", F.col("symbol")), line("File", F.col("file")), F.when(_given("doc"), line("Doc", _utf8_prefix(F.col("doc"), DOC_BYTES))),
        F.when(_signature(), line("Signature", F.col("signature"))), line("Code", code),
    ]
    return ranked.select("rank", F.concat_ws("\n", *parts).alias("text"))


def graph_json(ranked: DataFrame, limit: int) -> DataFrame:
    """One row with the graph of a result of at most ``limit`` rows as JSON: nodes, links and the number of nodes."""
    ranked = ranked.where(F.col("rank") <= limit)
    parts = [
        df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("json"), F.count("*").alias("n")).select(F.lit(name).alias("part"), "json", "n")
        for name, df in (("nodes", graph.nodes(ranked)), ("links", graph.links(ranked)))
    ]
    part = lambda name, c="json": F.max(F.when(F.col("part") == name, F.col(c)))
    both = parts[0].unionByName(parts[1])
    return both.agg(F.concat(F.lit('{"nodes":'), part("nodes"), F.lit(',"links":'), part("links"), F.lit(',"total":'), part("nodes", "n").cast("string"), F.lit("}")).alias("json"))


def markdown(ranked: DataFrame) -> DataFrame:
    """rank and the Markdown section of each result."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    parts = [
        F.format_string("### %d. `%s` [%s]\n\n", F.col("rank").cast("int"), c("symbol"), c("kind")),
        F.format_string("**File:** `%s` (%s)\n**Score:** %.3f\n", c("file"), c("language"), F.col("score")),
        F.when(F.col("start_line") > 0, F.format_string("**Lines:** %d–%d\n", "start_line", "end_line")),
        F.when(_given("doc"), F.concat(F.lit("\n**Doc:** "), "doc", F.lit("\n"))),
        F.when(_signature(), F.concat(F.lit("\n**Signature:** `"), "signature", F.lit("`\n"))),
        F.concat(F.lit("\n```"), c("language"), F.lit("\n"), c("code"), F.lit("\n```\n")),
    ]
    return ranked.select("rank", F.concat_ws("", *parts).alias("markdown"))
