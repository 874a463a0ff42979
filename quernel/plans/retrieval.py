"""Queries of the retrieval engine over the standard tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import chunking, detect, embedding, markup, symbols, vectors
from quernel.operators import diff, evaluate, graph, index, report, search, store
from quernel.plans.catalogue import query
from quernel.session import stage, table
from quernel.streaming import index_stream  # noqa: F401 - part of the engine's surface

DIM = 64
QUESTION = "how to merge the index of a repository"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), "label")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _top(spark: SparkSession, d: str, options: search.SearchOptions, **where) -> DataFrame:
    rows = _embeddings(spark, d)
    for column, value in where.items():
        rows = rows.where(F.col(column) == value)
    found = search.search(rows, _first_vector(spark, d), options)
    return found.select(F.col("id").cast("bigint").alias("vec_id"), "label", F.round("score", 6).alias("score"), *(["rank"] if options.limit else []))


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_TOP = f"SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, label, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, vec_id))::INT AS rank FROM ({_TOP}) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    """Cosine top 10 of one query vector."""
    return _top(spark, d, search.SearchOptions(10))


@query(f"SELECT vec_id, label, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, vec_id))::INT AS rank FROM ({_TOP} WHERE e.label = 2) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    """The filter comes before scoring."""
    return _top(spark, d, search.SearchOptions(10), label=2)


@query(f"SELECT vec_id, label, round(s, 6) AS score FROM ({_TOP}) WHERE s >= 0.1")
def vector_threshold(spark, d):
    """All vectors at or above a score: limit 0 means no limit."""
    return _top(spark, d, search.SearchOptions(0, 0, 0.1))


@query(f"SELECT vec_id, label, round(s, 6) AS score, rank FROM (SELECT *, (row_number() OVER (ORDER BY s DESC, vec_id))::INT AS rank FROM ({_TOP})) WHERE rank > 10 AND rank <= 20")
def vector_page(spark, d):
    """The second page of ten."""
    return _top(spark, d, search.SearchOptions(10, 10))


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0), "
    f"s AS (SELECT q.query_id, e.vec_id, {_COS} AS s FROM embeddings e, q) "
    "SELECT query_id, vec_id, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INT AS rank FROM s "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5"
)
def vector_batch_topk(spark, d):
    """Every vector whose id is divisible by 20 against all vectors, top 5 each."""
    points = _embeddings(spark, d)
    asked = points.where("seq % 20 = 0").select(F.col("seq").alias("query_id"), "vector")
    found = search.batch_search(points, asked, 5)
    return found.select("query_id", F.col("id").cast("bigint").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_TOP} WHERE len(e.embedding) = 64 AND e.vec_id % 3 <> 0)")
def vector_dim_guard(spark, d):
    """Vectors of another dimension are dropped, not scored 0."""
    rows = _embeddings(spark, d).withColumn("vector", F.when(F.col("seq") % 3 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    found = search.search(rows, _first_vector(spark, d), search.SearchOptions(0))
    return found.select(F.col("id").cast("bigint").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS cosine, round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def vector_cosine(spark, d):
    """The cosine as a native expression."""
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine("embedding", q), 6).alias("cosine"), F.round(vectors.norm("embedding"), 6).alias("norm"))


_NODES = f"SELECT vec_id, label, s, (row_number() OVER (ORDER BY s DESC, vec_id))::INT AS rank FROM ({_TOP}) ORDER BY s DESC, vec_id LIMIT 50"


def _ranked(spark, d):
    found = search.search(_embeddings(spark, d), _first_vector(spark, d), search.SearchOptions(50))
    return found.withColumn("file", F.concat(F.lit("file-"), F.col("label").cast("string")))


@query(f"SELECT vec_id::VARCHAR AS id, rank, 'file-' || label AS file, round(s, 6) AS score, floor(least(greatest(s * 20, 3), 20))::INT AS val FROM ({_NODES})")
def graph_nodes(spark, d):
    """Nodes of the top 50, sized by score."""
    return graph.nodes(_ranked(spark, d)).select("id", "rank", "file", F.round("score", 6).alias("score"), "val")


@query(f"WITH n AS ({_NODES}) SELECT a.vec_id::VARCHAR AS source, b.vec_id::VARCHAR AS target, 'same_file' AS relation FROM n a JOIN n b ON a.label = b.label AND a.rank < b.rank")
def graph_links(spark, d):
    """Links between results of one file, from the better rank to the worse."""
    return graph.links(_ranked(spark, d))


_LATEST = (
    "SELECT id, vector, payload, first FROM (SELECT id, vector, payload, upserted_at, min(upserted_at) OVER (PARTITION BY id) AS first, "
    "row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC NULLS LAST) AS r FROM vector_points WHERE id IS NOT NULL) WHERE r = 1"
)


@query(f"SELECT id, payload.file AS file, payload.kind AS kind, payload.language AS language, len(vector)::INT AS size FROM ({_LATEST})")
def latest_points(spark, d):
    """The row that holds of every id."""
    rows = store.latest_points(table(spark, d, "vector_points"))
    return rows.select("id", "file", "kind", "language", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("size"))


def _point_query() -> list[float]:
    return embedding.fallback_values(search.query_text(QUESTION, "python"), DIM)


_QVEC = (
    "SELECT list_transform(range(0, 64), lambda i: (((('0x' || left(sha256('[python] ' || chr(10) || '{0}' || chr(10) || '{0}'), 16))::UBIGINT >> i) & 255)::DOUBLE / 255)::FLOAT::DOUBLE) AS v"
).format(QUESTION)
_SCORED = (
    f"SELECT p.*, CASE WHEN len(list_filter(p.vector, lambda x: isnan(x))) > 0 THEN -2 WHEN len(list_filter(p.vector, lambda x: x <> 0)) = 0 THEN 0 ELSE list_cosine_similarity(p.vector::DOUBLE[], q.v) END AS s "
    f"FROM ({_LATEST}) p, ({_QVEC}) q WHERE len(p.vector) = 64"
)


@query(f"SELECT id, payload.file AS file, payload.symbol AS symbol, round(s, 6) AS score FROM ({_SCORED}) WHERE payload.language = 'python' AND payload.kind = 'function' AND contains(payload.file, 'src') ORDER BY s DESC, first, id LIMIT 10")
def point_search(spark, d):
    """Top 10 of the point table under a conjunction of language, kind and part of the file name."""
    points = store.latest_points(table(spark, d, "vector_points"))
    options = search.SearchOptions(10, 0, None, search.SearchFilter(language="python", kind="function", file="src"))
    return search.results(search.search(points, _point_query(), options)).select("id", "file", "symbol", F.round("score", 6).alias("score"))


@query(f"SELECT id, payload.repo AS repo, round(s, 6) AS score FROM ({_SCORED}) WHERE s >= 0.2")
def point_threshold(spark, d):
    """Every point at or above a score."""
    points = store.latest_points(table(spark, d, "vector_points"))
    found = search.scored(points, _point_query(), search.SearchOptions(0, 0, 0.2))
    return found.select("id", "repo", F.round("score", 6).alias("score"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang").distinct()


_DOCS = "(SELECT DISTINCT doc_id, text, lang FROM documents)"


@query(
    f"SELECT doc_id, nullif(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script[^>]*>', '', 'g'), '(?is)<style[^>]*>.*?</style[^>]*>', '', 'g'), '(?i)<(br|p|div|h[1-6]|li|tr)(\\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '[ \\t\\r]+\\n', chr(10), 'g'), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), '') AS text FROM {_DOCS}"
)
def html_text(spark, d):
    """Plain text of every document read as HTML."""
    return _docs(spark, d).select("doc_id", markup.html_text("text").alias("text"))


@query(f"SELECT doc_id, replace(regexp_replace(text, '(?s)<[^>]*(>|$)', '', 'g'), '>', '') AS text FROM {_DOCS}")
def xml_text(spark, d):
    """Plain text of every document read as XML."""
    return _docs(spark, d).select("doc_id", markup.strip_xml("text").alias("text"))


_SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# in SQL, parentheses are followed three levels deep
_TARGET = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*"
_MD_LINE = (
    f"regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(l, '\\r$', ''), '^#+{_SPACE}*', ''), '*', ''), '_', ''), "
    f"'\\[([^\\]]*)(?:\\](?:\\({_TARGET}\\)|\\(.*)?|$)', '\\1', 'g'), '!\\[(?:[^\\[\\]]|\\[[^\\[\\]]*\\])*(?:\\](?:\\({_TARGET}\\)|\\(.*)?|$)', '', 'g')"
)


@query(
    f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_MD_LINE}), lambda l: NOT (starts_with(l, '```') OR starts_with(l, '~~~'))), lambda l: regexp_replace(l, '^{_SPACE}*[-+] ', '')), lambda l: l <> ''), chr(10)) END AS text FROM {_DOCS}"
)
def markdown_text(spark, d):
    """Markdown stripped from every document."""
    return _docs(spark, d).select("doc_id", markup.strip_markdown("text").alias("text"))


def _chunk_sql(rows: str, key: str, text: str = "text", limit: int = 2000, overlap: int = 200) -> str:
    """SQL of ``chunk_text`` over a relation: key, n (from 0), code, start_line, end_line. A recursion whose steps take one
    paragraph, cut one piece off a paragraph above the limit, or hand out what is held at the end."""
    trim = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    lines = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE len({x}) - len(replace({x}, chr(10), '')) + CASE WHEN ends_with({x}, chr(10)) THEN 0 ELSE 1 END END)"
    prefix = f"left(rest, list_max(list_filter(range({limit // 4}, {limit + 1}), lambda n: strlen(left(rest, n)) <= {limit})))"
    head = f"CASE WHEN strlen(regexp_extract({prefix}, '^((?s:.*)){_SPACE}', 1)) > 10 THEN regexp_extract({prefix}, '^((?s:.*)){_SPACE}', 1) ELSE {prefix} END"
    last = f"right(held, list_max(list_filter(range({overlap // 4}, {overlap + 1}), lambda n: strlen(right(held, n)) <= {overlap})))"
    tail = trim(f"CASE WHEN strlen(held) <= {overlap} THEN held WHEN regexp_matches({last}, '{_SPACE}') THEN regexp_extract({last}, '{_SPACE}(?s:.*)$') ELSE {last} END")
    return f"""WITH RECURSIVE t AS (SELECT {key} AS k, {trim(text)} AS t FROM {rows} WHERE {text} IS NOT NULL),
big AS (SELECT k, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {trim("p")}), lambda p: p <> '') AS ps FROM t WHERE strlen(t) > {limit}),
r AS (SELECT k, ps, 1 AS i, NULL::VARCHAR AS rest, '' AS held, 1 AS b, 1 AS e, 1 AS line, NULL::VARCHAR AS ot, 0 AS os, 0 AS oe, 0 AS step FROM big
UNION ALL
SELECT k, ps, CASE WHEN act IN ('last', 'pack', 'put') THEN i + 1 ELSE i END,
  CASE WHEN act = 'cut' THEN {trim("substr(rest, len(hd) + 1)")} WHEN act = 'long' THEN para END,
  CASE act WHEN 'cut' THEN held WHEN 'last' THEN rest WHEN 'long' THEN '' WHEN 'pack' THEN CASE WHEN tl <> '' THEN tl || chr(10) || chr(10) || para ELSE para END WHEN 'put' THEN CASE WHEN held <> '' THEN held || chr(10) || chr(10) || para ELSE para END ELSE '' END,
  CASE act WHEN 'cut' THEN b + {lines("hd")} WHEN 'long' THEN line WHEN 'pack' THEN greatest(1, line - {lines("tl")}) WHEN 'put' THEN CASE WHEN held = '' THEN line ELSE b END ELSE b END,
  CASE act WHEN 'last' THEN b + greatest(1, {lines("rest")}) - 1 WHEN 'pack' THEN line + {lines("para")} - 1 WHEN 'put' THEN greatest(CASE WHEN held = '' THEN line ELSE b END, line + {lines("para")} - 1) ELSE e END,
  CASE WHEN act IN ('last', 'pack', 'put') THEN line + {lines("para")} ELSE line END,
  CASE WHEN act = 'cut' THEN {trim("hd")} WHEN act IN ('long', 'pack', 'end') THEN held END, b, CASE WHEN act = 'cut' THEN b + {lines("hd")} ELSE e END, step + 1
FROM (SELECT *, CASE WHEN act = 'cut' THEN {head} END AS hd, CASE WHEN act = 'pack' THEN {tail} END AS tl FROM (
  SELECT *, ps[i] AS para, CASE WHEN rest IS NOT NULL THEN CASE WHEN strlen(rest) > {limit} THEN 'cut' ELSE 'last' END WHEN i > len(ps) THEN 'end' WHEN strlen(ps[i]) > {limit} THEN 'long'
    WHEN held <> '' AND strlen(held) + strlen(ps[i]) + 2 > {limit} THEN 'pack' ELSE 'put' END AS act FROM r WHERE i <= len(ps) OR rest IS NOT NULL OR held <> ''))),
o AS (SELECT k, ot AS code, os AS start_line, oe AS end_line, step FROM r WHERE ot <> '' UNION ALL SELECT k, t, 1, 1, 0 FROM t WHERE t <> '' AND strlen(t) <= {limit})
SELECT k AS {key}, (row_number() OVER (PARTITION BY k ORDER BY step) - 1)::INT AS n, code, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM o"""


@query(f"SELECT doc_id, n AS ordinal, sha256(code) AS hash, start_line, end_line FROM ({_chunk_sql(_DOCS, 'doc_id')})")
def doc_chunks(spark, d):
    """Every document cut into chunks with hashes and lines."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(chunking.chunk_text("text")).alias("ordinal", "c"))
    return rows.select("doc_id", "ordinal", F.sha2("c.text", 256).alias("hash"), "c.start_line", "c.end_line")


_LINE = f"regexp_replace(regexp_extract(text, '^{_SPACE}*([^\\n]+)', 1), '{_SPACE}+$', '')"


@query(
    f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN l = '' THEN '(empty)' WHEN strlen(l) > 80 THEN left(l, list_max(list_filter(range(0, 81), lambda n: strlen(left(l, n)) <= 80))) || '...' ELSE l END AS signature FROM (SELECT doc_id, text, {_LINE} AS l FROM {_DOCS})"
)
def chunk_signature(spark, d):
    """The first line with more than white space, cut at 80 bytes."""
    return _docs(spark, d).select("doc_id", chunking.signature("text").alias("signature"))


@query(f"SELECT doc_id, sha256(text) AS hash FROM {_DOCS}")
def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@query(f"SELECT doc_id, '[' || coalesce(lang, '') || '] ' || chr(10) || coalesce(text, '') AS embedding_text FROM {_DOCS}")
def embedding_text(spark, d):
    return _docs(spark, d).select("doc_id", chunking.embedding_text(F.coalesce("lang", F.lit("")), F.lit(""), F.lit(None), F.coalesce("text", F.lit(""))).alias("embedding_text"))


@query(
    "SELECT DISTINCT id, sha256(coalesce(code, '') || coalesce(signature, '') || coalesce(file, '') || coalesce(module, '') || coalesce(language, '')) AS hash, "
    "'[' || coalesce(language, '') || '] ' || CASE WHEN coalesce(signature, '') <> '' THEN chr(10) || signature ELSE '' END || CASE WHEN coalesce(doc, '') <> '' THEN chr(10) || doc ELSE '' END || chr(10) || coalesce(code, '') AS embedding_text FROM chunks"
)
def chunk_embedding_text(spark, d):
    """Hash and embedding text of every chunk."""
    c = lambda x: F.coalesce(x, F.lit(""))
    h = chunking.content_hash(c("code"), c("signature"), c("file"), c("module"), c("language"))
    return table(spark, d, "chunks").select("id", h.alias("hash"), chunking.embedding_text(c("language"), c("signature"), c("doc"), c("code")).alias("embedding_text")).distinct()


@query(
    f"SELECT doc_id, i::INT AS i, round((((('0x' || left(sha256(text), 16))::UBIGINT >> i) & 255)::DOUBLE / 255)::FLOAT::DOUBLE, 6) AS value FROM (SELECT doc_id, text, unnest(range(0, 64)) AS i FROM {_DOCS} WHERE text IS NOT NULL)"
)
def fallback_vector(spark, d):
    """The components of every document's fallback vector."""
    rows = _docs(spark, d).where(F.col("text").isNotNull())
    rows = rows.select("doc_id", F.posexplode(embedding.fallback_vector("text", DIM)).alias("i", "v"))
    return rows.select("doc_id", "i", F.round(F.col("v").cast("double"), 6).alias("value"))


@query(
    f"WITH q AS ({_QVEC}), e AS (SELECT doc_id, lower(trim(lang)) AS lang, list_transform(range(0, 64), lambda i: (((('0x' || left(sha256('[' || coalesce(lang, '') || '] ' || chr(10) || text), 16))::UBIGINT >> i) & 255)::DOUBLE / 255)::FLOAT::DOUBLE) AS v FROM {_DOCS} WHERE text IS NOT NULL AND lower(trim(lang)) = 'en') "
    "SELECT doc_id, lang, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, q ORDER BY list_cosine_similarity(e.v, q.v) DESC, doc_id LIMIT 10"
)
def semantic_doc_search(spark, d):
    """Documents are embedded and the ten nearest to a question found."""
    rows = _docs(spark, d).where(F.col("text").isNotNull() & (F.lower(F.trim("lang")) == "en"))
    text = chunking.embedding_text(F.coalesce("lang", F.lit("")), F.lit(""), F.lit(None), F.col("text"))
    points = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.lower(F.trim("lang")).alias("lang"), embedding.fallback_vector(text, DIM).alias("vector"))
    found = search.search(points, _point_query(), search.SearchOptions(10))
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "lang", F.round("score", 6).alias("score"))


def _old_and_batch(spark, d):
    points = _embeddings(spark, d)
    old = points.where("seq % 5 <> 0")
    batch = points.where("seq % 3 = 0").withColumn("label", F.col("label") + 100)
    again = points.where("seq % 9 = 0").withColumns({"label": F.col("label") + 200, "seq": F.col("seq") + 1_000_000_000})
    return old, batch.unionByName(again)


@query(
    "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 9 = 0 THEN label + 200 WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END::INT AS label FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 3 = 0"
)
def upsert_points(spark, d):
    """A batch over a table; the last row of an id in the batch wins."""
    return store.upsert(*_old_and_batch(spark, d)).select("id", F.col("label").cast("int").alias("label"))


@query("SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE label <> 3")
def delete_points(spark, d):
    """A table after deleting by a predicate."""
    return store.delete_where(_embeddings(spark, d), F.col("label") == 3).select("id", "label")


@query(f"SELECT id, payload.language AS language FROM ({_LATEST}) WHERE NOT coalesce(payload.language = 'python' AND payload.kind = 'function', false)")
def delete_points_by_filter(spark, d):
    """A table after deleting what matches all fields of a filter."""
    rows = store.latest_points(table(spark, d, "vector_points"))
    return store.delete_matching(rows, search.SearchFilter(language="python", kind="function")).select("id", "language")


@query("SELECT count(*) AS points, 64::INT AS dimension FROM embeddings")
def store_stats(spark, d):
    return store.stats(_embeddings(spark, d)).select("points", F.col("dimension").cast("int").alias("dimension"))


def _snapshots(spark, d):
    rows = table(spark, d, "file_entries").where("path IS NOT NULL").select("file_id", "repo", "path", F.coalesce("content", F.lit("")).alias("content")).distinct()
    old = rows.where("file_id % 7 <> 0").select("repo", "path", F.sha2("content", 256).alias("blob_id"))
    edited = F.when(F.col("file_id") % 5 == 0, F.concat("content", F.lit("\n# edited"))).otherwise(F.col("content"))
    new = rows.where("file_id % 11 <> 0").select("repo", "path", F.sha2(edited, 256).alias("blob_id"))
    return old, new


_SNAP = (
    "WITH r AS (SELECT DISTINCT file_id, repo, path, coalesce(content, '') AS content FROM file_entries WHERE path IS NOT NULL), "
    "o AS (SELECT repo, path, sha256(content) AS b FROM r WHERE file_id % 7 <> 0), "
    "n AS (SELECT repo, path, sha256(CASE WHEN file_id % 5 = 0 THEN content || chr(10) || '# edited' ELSE content END) AS b FROM r WHERE file_id % 11 <> 0), "
    "c AS (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, CASE WHEN o.b IS NULL THEN 'Added' WHEN n.b IS NULL THEN 'Deleted' WHEN o.b <> n.b THEN 'Modified' END AS status, o.b AS old_blob_id, n.b AS new_blob_id "
    "FROM o FULL JOIN n ON o.repo = n.repo AND o.path = n.path) "
)


@query(_SNAP + "SELECT * FROM c WHERE status IS NOT NULL")
def snapshot_diff(spark, d):
    """What differs between two snapshots of all files."""
    return diff.diff_snapshots(*_snapshots(spark, d), ["repo", "path"])


@query(_SNAP + "SELECT o.repo, o.path FROM o LEFT JOIN c ON c.repo = o.repo AND c.path = o.path AND c.status <> 'Added' WHERE c.status IS NULL")
def incremental_index(spark, d):
    """Files whose rows an incremental run leaves in place."""
    return index.surviving(*_snapshots(spark, d), ["repo", "path"]).select("repo", "path")


_CHANGES = "(SELECT DISTINCT repo, commit, path, upper(left(trim(status), 1)) || lower(substr(trim(status), 2)) AS status, old_blob_id, new_blob_id, changed_at FROM file_changes)"


@query(f"SELECT repo, count(*) FILTER (status = 'Added') AS added, count(*) FILTER (status = 'Modified') AS modified, count(*) FILTER (status = 'Deleted') AS deleted, count(*) FILTER (status = 'Renamed') AS renamed, count(*) FILTER (status = 'Copied') AS copied FROM {_CHANGES} GROUP BY repo")
def diff_stats(spark, d):
    """Changes of every repository by status."""
    return diff.diff_stats(diff.clean_changes(table(spark, d, "file_changes")), ["repo"])


@query(f"SELECT DISTINCT path FROM {_CHANGES} WHERE status IN ('Added', 'Modified') AND contains(path, 'src/')")
def changed_paths(spark, d):
    """Paths of changes under a caller's predicate."""
    rows = diff.filter_changes(diff.clean_changes(table(spark, d, "file_changes")), F.col("status").isin("Added", "Modified") & F.col("path").contains("src/"))
    return diff.affected_paths(rows)


@query(
    f"SELECT repo, path, new_blob_id AS blob_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY changed_at DESC, new_blob_id DESC NULLS LAST, status DESC) AS r FROM {_CHANGES}) WHERE r = 1 AND status <> 'Deleted'"
)
def latest_snapshot(spark, d):
    """The files that are there after all changes."""
    return diff.latest_snapshot(table(spark, d, "file_changes"))


_EVAL = (
    "WITH q AS (SELECT DISTINCT lower(language) || '|' || query_text AS query_id, lower(language) AS language, expected_symbols, list_transform(range(0, 64), lambda i: (((('0x' || left(sha256('[' || coalesce(language, '') || '] ' || chr(10) || query_text || chr(10) || query_text), 16))::UBIGINT >> i) & 255)::DOUBLE / 255)::FLOAT::DOUBLE) AS v FROM eval_queries), "
    f"p AS (SELECT id, first, payload, vector FROM ({_LATEST}) WHERE len(vector) = 64), "
    "s AS (SELECT q.query_id, p.id, p.payload.symbol AS symbol, p.first, CASE WHEN len(list_filter(p.vector, lambda x: isnan(x))) > 0 THEN -2 WHEN len(list_filter(p.vector, lambda x: x <> 0)) = 0 THEN 0 ELSE list_cosine_similarity(p.vector::DOUBLE[], q.v) END AS s FROM q JOIN p ON lower(p.payload.language) = q.language), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, id) AS rank FROM s), "
    "h AS (SELECT k.query_id, min(rank) AS first_hit FROM k JOIN q USING (query_id) WHERE rank <= 5 AND symbol <> '' AND len(list_filter(q.expected_symbols, lambda e: contains(symbol, e) OR contains(e, symbol))) > 0 GROUP BY 1), "
    "j AS (SELECT q.query_id, q.language, first_hit FROM q LEFT JOIN h USING (query_id)) "
)
_METRIC = "round(avg(CASE WHEN first_hit <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr, count(*) AS n_queries"


@query(_EVAL + f"SELECT language, {_METRIC} FROM j GROUP BY language UNION ALL SELECT 'all', {_METRIC} FROM j")
def eval_metrics(spark, d):
    """Top-1, top-5 and reciprocal rank of the evaluation queries over all points, in all and by language."""
    rows = table(spark, d, "eval_queries").withColumn("query_id", F.concat_ws("|", F.lower("language"), "query_text")).dropDuplicates(["query_id"])
    rows = search.query_rows(rows, DIM)
    points = stage(store.latest_points(table(spark, d, "vector_points")), "eval-points")
    hits = search.batch_search(points, rows, evaluate.TOP, by_language=True).join(points.select("id", "symbol"), "id")
    out = evaluate.metrics(evaluate.judge(rows, hits))
    return out.select("language", *[F.round(c, 6).alias(c) for c in ("top1", "top5", "mrr")], "n_queries")


def _case(value: str, table_: dict[str, list[str]]) -> str:
    return " ".join(f"WHEN {value} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in table_.items())


_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = f"CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]*$') THEN regexp_extract({_NAME}, '\\.([^.]*)$', 1) END"
_LANG = f"CASE WHEN {_NAME} IN ('Makefile', 'makefile', 'CMakeLists.txt') THEN 'c' WHEN {_NAME} IN ('BUILD', 'BUILD.bazel') THEN 'python' ELSE CASE {_case('ext', detect.LANGUAGE_EXTENSIONS)} END END"
_FMT = f"coalesce(CASE WHEN ext IS NOT NULL THEN CASE {_case('lower(ext)', detect.FORMAT_EXTENSIONS)} END WHEN {_NAME} IN ({', '.join(repr(x) for x in detect.TEXT_FILES)}) THEN 'text' END, 'unknown')"


@query(f"SELECT path, {_LANG} AS language, {_FMT} AS format FROM (SELECT DISTINCT path, {_EXT} AS ext FROM file_entries UNION SELECT DISTINCT path, {_EXT} AS ext FROM documents)")
def detect_path(spark, d):
    """Language and document format of every path."""
    paths = table(spark, d, "file_entries").select("path").union(table(spark, d, "documents").select("path")).distinct()
    return paths.select("path", detect.language_by_path("path").alias("language"), detect.document_format("path").alias("format"))


@query(
    "SELECT DISTINCT file_id, CASE WHEN starts_with(content, '#!') AND b IS NOT NULL THEN b ELSE h END AS language FROM (SELECT file_id, content, "
    "CASE WHEN contains(l, 'python') THEN 'python' WHEN contains(l, 'node') THEN 'javascript' WHEN contains(l, 'rust') THEN 'rust' WHEN contains(l, 'go') THEN 'go' WHEN contains(l, 'ruby') THEN 'ruby' WHEN contains(l, 'perl') THEN 'perl' WHEN contains(l, 'bash') THEN 'bash' END AS b, "
    "CASE WHEN (contains(content, 'def ') AND contains(content, ':')) OR (contains(content, 'import ') AND contains(content, 'from ')) THEN 'python' WHEN (contains(content, 'fn ') AND contains(content, '->')) OR contains(content, 'impl ') OR contains(content, 'let mut') THEN 'rust' "
    "WHEN contains(content, 'package ') AND contains(content, 'func ') AND contains(content, 'import \"') THEN 'go' WHEN contains(content, 'public class ') OR contains(content, 'public static void main') THEN 'java' END AS h FROM (SELECT file_id, content, split_part(content, chr(10), 1) AS l FROM file_entries))"
)
def detect_content(spark, d):
    """Language of every file by its content alone."""
    return table(spark, d, "file_entries").select("file_id", detect.language_by_content("content").alias("language")).distinct()


def _files(spark, d):
    rows = table(spark, d, "file_entries").where(F.col("content").isNotNull())
    return rows.select("file_id", "repo", "branch", "commit", "path", "content").dropDuplicates(["file_id"])


@query()
def symbols_extracted(spark, d):
    """Symbols of every source file."""
    return symbols.symbols(_files(spark, d)).select("repo", "file_path", "ordinal", "kind", "name", "signature", "line_start", "line_end", "is_async", "is_public", "language")


@query()
def file_chunks(spark, d):
    """Chunk rows of every file, code and documents."""
    return index.chunks(_files(spark, d)).select("id", "content_hash", "repo", "file", "language", "kind", "symbol", "start_line", "end_line")


@query(
    "SELECT id, name, kind || s AS kind, sha256(c || sg || coalesce(file_path, '') || coalesce(module_path, '') || lg) AS content_hash, line_start AS start_line, CASE WHEN s = '' THEN line_end ELSE line_start END AS end_line FROM ("
    "SELECT DISTINCT id, name, kind, file_path, module_path, line_start, line_end, coalesce(language, 'unknown') AS lg, coalesce(signature, '') AS sg, '' AS s, code AS c FROM symbols WHERE code IS NOT NULL AND file_path IS NOT NULL "
    "UNION ALL SELECT DISTINCT id, name, kind, file_path, module_path, line_start, line_end, coalesce(language, 'unknown'), coalesce(signature, ''), '_doc', coalesce(signature, '') || chr(10) || doc FROM symbols WHERE code IS NOT NULL AND file_path IS NOT NULL AND doc <> '')"
)
def symbol_chunks(spark, d):
    """A code chunk of every symbol and a documentation chunk of every documented one."""
    rows = table(spark, d, "symbols").where("code IS NOT NULL AND file_path IS NOT NULL").drop("extracted_at").distinct()
    rows = rows.withColumns({"branch": F.lit(""), "commit": F.lit(""), "sid": F.col("id")})
    # the symbol's own id travels in ``repo``, which takes no part in the hash
    made = chunking.symbol_chunks(rows.withColumn("repo", F.col("id")))
    return made.select(F.col("repo").alias("id"), F.col("symbol").alias("name"), "kind", "content_hash", "start_line", "end_line")


@query("SELECT DISTINCT oid, repo, coalesce(nullif(author_name, ''), 'unknown') AS author_name, to_timestamp(time)::TIMESTAMP AS commit_time FROM commit_info")
def commits(spark, d):
    """Commits with their time as a timestamp."""
    rows = table(spark, d, "commit_info").select("oid", "repo", F.coalesce(F.nullif("author_name", F.lit("")), F.lit("unknown")).alias("author_name"), F.timestamp_seconds("time").cast("timestamp_ntz").alias("commit_time"))
    return rows.distinct()


def _found(n: int) -> str:
    return f"SELECT id, first, payload.*, s, (row_number() OVER (ORDER BY s DESC, first, id))::INT AS rank FROM (SELECT id, first, s, struct_pack(symbol := payload.symbol, kind := payload.kind, file := payload.file, module := payload.module, language := payload.language, doc := payload.doc, signature := payload.signature, code := payload.code, start_line := payload.start_line, end_line := payload.end_line) AS payload FROM ({_SCORED})) ORDER BY s DESC, first, id LIMIT {n}"


_SIG = "CASE WHEN signature <> '' AND signature <> coalesce(symbol, '') THEN {0} END"
#: The first 100 bytes of a documentation, whole characters only.
_DOC100 = "left(doc, list_max(list_filter(range(0, 101), lambda n: strlen(left(doc, n)) <= 100)))"


def _results(spark, d, n: int, **where) -> DataFrame:
    points = store.latest_points(table(spark, d, "vector_points"))
    return search.search(points, _point_query(), search.SearchOptions(n, 0, None, search.SearchFilter(**where)))


@query(
    "SELECT rank, concat_ws(chr(10), printf('%d. [%s] %.2f', rank, coalesce(kind, ''), s), '   Symbol: ' || coalesce(symbol, ''), '   File: ' || coalesce(file, ''), "
    f"CASE WHEN doc <> '' THEN '   Doc: ' || {_DOC100} END, {_SIG.format("'   Signature: ' || signature")}, '   Code: ' || regexp_replace(split_part(coalesce(code, ''), chr(10), 1), '\\r$', '')) AS text FROM ({_found(10)})"
)
def result_text(spark, d):
    """A search result as a text list."""
    return report.text_list(_results(spark, d, 10))


@query(
    "SELECT rank, printf('### %d. `%s` [%s]' || chr(10) || chr(10), rank, coalesce(symbol, ''), coalesce(kind, '')) || printf('**File:** `%s` (%s)' || chr(10) || '**Score:** %.3f' || chr(10), coalesce(file, ''), coalesce(language, ''), s) "
    "|| coalesce(CASE WHEN start_line > 0 THEN printf('**Lines:** %d–%d' || chr(10), start_line, end_line) END, '') || coalesce(CASE WHEN doc <> '' THEN chr(10) || '**Doc:** ' || doc || chr(10) END, '') "
    f"|| coalesce({_SIG.format("chr(10) || '**Signature:** `' || signature || '`' || chr(10)")}, '') || chr(10) || '```' || coalesce(language, '') || chr(10) || coalesce(code, '') || chr(10) || '```' || chr(10) AS markdown FROM ({_found(10)})"
)
def result_markdown(spark, d):
    """A search result as Markdown."""
    return report.markdown(_results(spark, d, 10))


@query(
    f"WITH n AS ({_found(20)}) SELECT (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM n a JOIN n b ON a.rank < b.rank AND a.file = b.file AND a.file <> '') + (SELECT count(*) FROM n a JOIN n b ON a.rank < b.rank AND a.module = b.module AND a.module <> '') AS links, (SELECT string_agg(id || coalesce(symbol, ''), ' ' ORDER BY id) FROM n) AS names"
)
def result_graph(spark, d):
    """A search result as a graph in JSON, read back: its total, the number of its links, and its nodes' ids and names."""
    made = report.graph_json(stage(_results(spark, d, 20), "graph"), 20)
    kind = "struct<nodes:array<struct<id:string,name:string,code:string>>,links:array<struct<source:string,target:string,relation:string>>,total:bigint>"
    g = made.select(F.from_json("json", kind).alias("g"))
    names = F.array_sort(F.transform("g.nodes", lambda x: F.concat(x["id"], F.coalesce(x["name"], F.lit("")))))
    return g.select(F.col("g.total").alias("total"), F.size("g.links").cast("bigint").alias("links"), F.array_join(names, " ").alias("names"))
