"""Queries of the ten training-data problems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.llm import docpairs, mixing, near_dup, origin, residue, secrets, splitting, syntax, tokens, vector_knn
from quernel.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


P3_SQL = """
WITH w AS (SELECT DISTINCT id, regexp_extract_all(code, '[A-Za-z0-9_]+') AS ws FROM chunks
           WHERE kind IN ('function', 'method') AND code IS NOT NULL),
k AS (SELECT id, ws FROM w WHERE len(ws) >= 30),
t AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
      FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM k)),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT p.a AS chunk_a, p.b AS chunk_b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b
WHERE c >= 0.6 * (x.n + y.n - c)
"""

P7_SQL = """
WITH l AS (SELECT id, vector, row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC NULLS LAST) AS r FROM vector_points),
v AS (SELECT id, vector::DOUBLE[] AS v FROM l WHERE r = 1 AND len(vector) = 64
      AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT a, b, s FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM k WHERE s >= 0.85
"""


@query()
def p1_found(spark, sf_dir):
    return origin.unwritten_files(table(spark, sf_dir, "chunks"))


@query(P3_SQL)
def p3_found(spark, sf_dir):
    return near_dup.similar_pairs(table(spark, sf_dir, "chunks"))


@query()
def p3_groups(spark, sf_dir):
    return near_dup.similar_groups(table(spark, sf_dir, "chunks"))


@query(
    "SELECT DISTINCT c.config_id, k.id AS chunk_id FROM chunks k JOIN chunk_config c "
    "ON strlen(k.code) > c.max_chunk_size"
)
def p5_found(spark, sf_dir):
    pieces = splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_config"))
    return pieces.select("config_id", "chunk_id").distinct()


@query()
def p5_pieces(spark, sf_dir):
    return splitting.split_oversized(
        table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_config"), with_text=True
    ).distinct()


@query(
    "SELECT DISTINCT c.config_id, k.id AS chunk_id, sha256(k.code) AS hash, true AS fits, true AS overlaps FROM chunks k JOIN chunk_config c ON strlen(k.code) > c.max_chunk_size"
)
def p5_joined(spark, sf_dir):
    """The pieces of every text put together again without their overlaps; whether all fit the size, and whether each shares
    with the one before what the row of ``chunk_config`` asks for, or up to three bytes less to keep a character whole."""
    config = table(spark, sf_dir, "chunk_config")
    pieces = splitting.split_oversized(table(spark, sf_dir, "chunks"), config, with_text=True).distinct()
    # the pieces of one text; a text is one row, so its pieces fit where it did
    rows = pieces.groupBy("config_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start_byte", "end_byte", "piece"))).alias("p"))
    rows = rows.join(config.select("config_id", "max_chunk_size", "overlap").distinct(), "config_id")
    end = lambda i: F.when(i > 0, F.col("p")[i - 1]["end_byte"]).otherwise(F.lit(0))
    fresh = F.transform("p", lambda x, i: F.substring(x["piece"].cast("binary"), end(i) - x["start_byte"] + 1, F.octet_length(x["piece"])).cast("string"))
    shared = F.transform("p", lambda x, i: end(i) - x["start_byte"])
    least = F.least(F.coalesce("overlap", F.lit(0)), F.col("max_chunk_size") - 4)
    return rows.select(
        "config_id", "chunk_id", F.sha2(F.array_join(fresh, ""), 256).alias("hash"), F.forall("p", lambda x: F.octet_length(x["piece"]) <= F.col("max_chunk_size")).alias("fits"),
        F.forall(F.slice(shared, 2, F.greatest(F.size(shared) - 1, F.lit(1))), lambda n: (n <= least) & (n >= least - 3)).alias("overlaps"),
    )


@query(P7_SQL)
def p7_found(spark, sf_dir):
    return vector_knn.similar_vectors(table(spark, sf_dir, "vector_points"))


@query()
def p7_neighbours(spark, sf_dir):
    return vector_knn.neighbour_table(table(spark, sf_dir, "vector_points"))


@query()
def p8_ids(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "ids")


@query()
def p8_offsets(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True)


@query("SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark, sf_dir):
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query()
def p9_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query()
def p9_report(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query(
    "WITH h AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE text <> ''), t AS (SELECT DISTINCT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets), "
    "o AS (SELECT source, target_share, CASE WHEN max_repeats > 0 AND source IN (SELECT source FROM h) THEN target_share ELSE 0 END AS here FROM t) "
    "SELECT source, round(target_share, 6) AS target_share, here > 0 AS present, true AS met FROM o"
)
def p9_shares(spark, sf_dir):
    """Whether every listed source has its share of the mixture that exists, within a hundredth."""
    rows = mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    present = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0)
    whole = F.sum(F.when(present, F.col("target_share"))).over(Window.partitionBy(F.lit(1)))  # one row a listed source
    wanted = F.when(present, F.col("target_share") / whole).otherwise(F.lit(0.0))
    met = F.abs(F.col("actual_share") - wanted) < 0.01
    return rows.select("source", F.round("target_share", 6).alias("target_share"), present.alias("present"), met.alias("met"))


@query()
def p10_found(spark, sf_dir):
    return residue.residue_documents(table(spark, sf_dir, "documents"))


@query()
def p4_found(spark, sf_dir):
    return secrets.secret_records(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "symbols"))


@query()
def p4_redacted(spark, sf_dir):
    return secrets.secret_records(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "symbols"), redacted=True)


@query()
def p6_found(spark, sf_dir):
    return syntax.broken_files(table(spark, sf_dir, "file_entries"))


@query()
def p6_rates(spark, sf_dir):
    return syntax.rates(table(spark, sf_dir, "file_entries"))


@query()
def p2_found(spark, sf_dir):
    return docpairs.pairs(table(spark, sf_dir, "symbols")).select("symbol_id").distinct()


@query()
def p2_pairs(spark, sf_dir):
    return docpairs.pairs(table(spark, sf_dir, "symbols")).distinct()


@query()
def p2_files(spark, sf_dir):
    return docpairs.file_functions(table(spark, sf_dir, "file_entries"))
