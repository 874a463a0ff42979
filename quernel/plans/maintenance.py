"""Queries of sources, stores, detection and archives, each with its SQL counterpart."""

from __future__ import annotations

import io
import os
import subprocess
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import archives, chunking, detect, embedding, symbols
from quernel.operators import evaluate, index, search, store
from quernel.plans.catalogue import query
from quernel.plans.retrieval import _DOCS, _EXT, _FMT, _LANG, _LATEST, _MD_LINE, _SPACE, _chunk_sql, _docs, _files, _point_query, _SCORED
from quernel.session import shared_dir, stage, table
from quernel.sources import git
from quernel.sources.state import StateStore
from quernel.streaming import index_stream

MIB = 1 << 20


def _values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


# sources


@query(
    f"SELECT file_id, strlen(content) * n AS size FROM (SELECT DISTINCT file_id, coalesce(content, '') AS content, CASE WHEN file_id % 9 = 0 THEN 700 ELSE 1 END AS n FROM file_entries) WHERE file_id % 4 <> 0 AND strlen(content) * n <= {MIB}"
)
def files_readable(spark, d):
    """Files up to 1 MiB whose bytes are UTF-8: every fourth gets a broken byte, every ninth is repeated 700 times."""
    rows = table(spark, d, "file_entries").select("file_id", F.coalesce("content", F.lit("")).alias("content")).distinct()
    raw = F.repeat("content", F.when(F.col("file_id") % 9 == 0, 700).otherwise(1)).cast("binary")
    raw = F.when(F.col("file_id") % 4 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return index.text_files(rows.withColumn("content", raw)).select("file_id", F.octet_length("content").cast("bigint").alias("size"))


_REPO_FILES = {"a.py": "def f(x):\n    return x\n", "src/b.rs": "fn g() {}\n", "docs/c.md": "# C\n", "Makefile": "all:\n", "big.bin": "z" * (MIB + 1)}
_SECOND = {"a.py": "def f(x):\n    return x + 1\n", "src/b.rs": None, "new.go": "package a\n"}


def _git_repo(spark: SparkSession) -> str:
    """A small repository with two commits in the shared folder."""
    at = f"{shared_dir(spark).removeprefix('file://')}/git-{uuid.uuid4().hex}"
    os.makedirs(at)
    env = os.environ | {k: v for who in ("AUTHOR", "COMMITTER") for k, v in ((f"GIT_{who}_NAME", "T"), (f"GIT_{who}_EMAIL", "t@x"), (f"GIT_{who}_DATE", "2024-01-02T03:04:05+0000"))}
    run = lambda *a: subprocess.run(["git", "-c", "safe.directory=*", "-C", at, *a], check=True, capture_output=True, env=env)
    run("init", "-q", "-b", "main")
    for message, files in (("first", _REPO_FILES), ("second", _SECOND)):
        for name, text in files.items():
            os.makedirs(os.path.dirname(f"{at}/{name}"), exist_ok=True)
            if text is None:
                os.remove(f"{at}/{name}")
            else:
                with open(f"{at}/{name}", "w") as f:
                    f.write(text)
        run("add", "-A")
        run("commit", "-qm", message)
        run("branch", f"b-{message}")
    return at


_NOW = {k: v for k, v in (_REPO_FILES | _SECOND).items() if v is not None}


@query(f"SELECT path, size, CASE WHEN size <= {MIB} THEN text END AS text FROM ({_values([(k, len(v), v if len(v) < 99 else '') for k, v in sorted(_NOW.items())], 'path, size, text')})")
def git_tree(spark, d):
    """The files of a tree; blobs above 1 MiB have no content."""
    rows = git.read_tree(spark, _git_repo(spark))
    return stage(rows.select("path", F.col("size_bytes").cast("int").alias("size"), F.col("content").cast("string").alias("text")), "git-tree")


@query(_values([(k, len(v)) for k, v in sorted(_NOW.items()) if k.endswith((".py", ".go"))], "path, size"))
def git_tree_extensions(spark, d):
    """Only files with some extensions; those without one are left out."""
    rows = git.read_tree(spark, _git_repo(spark), extensions=["py", ".go"], content=False)
    return stage(rows.select("path", F.col("size_bytes").cast("int").alias("size")), "git-tree")


@query(_values([("second", "T", "t@x", 1704164645, "commit"), ("first", "T", "t@x", 1704164645, "commit"), ("b-first", "", "", 0, "branch"), ("b-second", "", "", 0, "branch"), ("main", "", "", 0, "branch"), ("main", "", "", 0, "default")], "name, author, email, time, kind"))
def git_history(spark, d):
    """Commits and branches of a repository."""
    at = _git_repo(spark)
    log = [(r.message, r.author_name, r.author_email, r.time, "commit") for r in git.read_commits(spark, at).collect()]
    rows = log + [(b, "", "", 0, "branch") for b in git.branches(at)] + [(git.default_branch(at), "", "", 0, "default")]
    return spark.createDataFrame(rows, "name string, author string, email string, time int, kind string")


@query(_values([("a.py", "Modified", 1, 1), ("src/b.rs", "Deleted", 0, 1), ("new.go", "Added", 1, 0)], "path, status, insertions, deletions"))
def git_commit_diff(spark, d):
    """What a commit changed, with counts of lines."""
    at = _git_repo(spark)
    return git.diff_commits(spark, at, git.find_commit(at, "b-first"), git.find_commit(at, "b-second")).select("path", "status", "insertions", "deletions")


@query("SELECT repo, oid AS last_commit FROM (SELECT repo, oid, row_number() OVER (PARTITION BY repo ORDER BY time DESC, oid DESC) AS r FROM (SELECT DISTINCT repo, oid, time FROM commit_info WHERE time IS NOT NULL)) WHERE r = 1")
def index_state(spark, d):
    """The last commit of every repository, put into the state store and read from it."""
    rows = table(spark, d, "commit_info").where("time IS NOT NULL").groupBy("repo").agg(F.max(F.struct("time", "oid")).alias("m"))
    state = StateStore(f"{shared_dir(spark)}/state-{uuid.uuid4().hex}.json")
    state.set("gone", "x")
    state.clear("gone")
    for r in rows.select("repo", "m.oid").collect():  # one row a repository, as the store itself holds
        state.set(r.repo, r.oid)
    return spark.createDataFrame([(k, v["last_commit"]) for k, v in state._read().items()], "repo string, last_commit string")


# the gate between code and documents

_BODY = f"CASE WHEN format = 'markdown' THEN array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda l: {_MD_LINE}), lambda l: NOT (starts_with(l, '```') OR starts_with(l, '~~~'))), lambda l: regexp_replace(l, '^{_SPACE}*[-+] ', '')), lambda l: l <> ''), chr(10)) WHEN format = 'xml' THEN replace(regexp_replace(content, '(?s)<[^>]*(>|$)', '', 'g'), '>', '') ELSE content END"
_TIERS = f"SELECT *, {_LANG} AS code_language, {_FMT} AS format FROM (SELECT DISTINCT file_id, repo, path, content, {_EXT} AS ext FROM file_entries WHERE content IS NOT NULL)"
_TEXTS = f"(SELECT file_id, {_BODY} AS text FROM ({_TIERS}) WHERE code_language IS NULL AND format IN ({', '.join(repr(x) for x in detect.TEXT_FORMATS)}) AND strlen(content) <= {MIB})"


@query(f"SELECT repo, file, n_chunks, hash FROM (SELECT f.repo, f.path AS file, count(*) AS n_chunks, sha256(string_agg(c.code, '' ORDER BY c.n)) AS hash FROM ({_chunk_sql(_TEXTS, 'file_id')}) c JOIN (SELECT DISTINCT file_id, repo, path FROM file_entries WHERE content IS NOT NULL) f USING (file_id) GROUP BY f.repo, f.path)")
def file_documents(spark, d):
    """Document chunks of all files: only files whose path tells no language are documents. Chunks are counted and put
    together for each file."""
    rows = index.chunks(_files(spark, d)).where("kind = 'document'")
    parts = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "code")))  # the chunks of one file of at most 1 MiB
    out = rows.groupBy("repo", "file").agg(F.count("*").alias("n_chunks"), parts.alias("p"))
    return out.select("repo", "file", "n_chunks", F.sha2(F.array_join(F.col("p.code"), ""), 256).alias("hash"))


@query(
    f"SELECT file_id, format, CASE WHEN format IN ({', '.join(repr(x) for x in detect.TEXT_FORMATS)}) THEN 'text' WHEN format IN ({', '.join(repr(x) for x in detect.BINARY_FORMATS)}) THEN 'binary' WHEN format IN ({', '.join(repr(x) for x in detect.ARCHIVE_FORMATS)}) THEN 'archive' ELSE 'none' END AS tier FROM ({_TIERS})"
)
def format_tiers(spark, d):
    """Format and tier of every file."""
    rows = table(spark, d, "file_entries").where("content IS NOT NULL").select("file_id", detect.document_format("path").alias("format")).distinct()
    return rows.withColumn("tier", detect.format_tier("format"))


@query(
    "SELECT DISTINCT file_id, CASE WHEN contains(l, 'python') THEN 'python' WHEN contains(l, 'node') THEN 'javascript' WHEN contains(l, 'rust') THEN 'rust' WHEN contains(l, 'go') THEN 'go' WHEN contains(l, 'ruby') THEN 'ruby' WHEN contains(l, 'perl') THEN 'perl' WHEN contains(l, 'bash') THEN 'bash' END AS language "
    "FROM (SELECT file_id, '#!/usr/bin/env ' || split_part(path, '/', -1) AS l FROM file_entries)"
)
def shebang_language(spark, d):
    """Languages told by first lines that name an interpreter."""
    rows = table(spark, d, "file_entries").select("file_id", F.concat(F.lit("#!/usr/bin/env "), detect.file_name("path"), F.lit("\nrest")).alias("text"))
    return rows.select("file_id", detect.language_by_shebang("text").alias("language")).distinct()


@query(_values([(k, ", ".join(v)) for k, v in detect.LANGUAGE_EXTENSIONS.items() if k in ("rust", "go", "cpp")], "language, extensions"))
def language_registry(spark, d):
    """A registry of some languages."""
    return detect.languages(spark, ["rust", "go", "cpp"]).select("language", F.array_join("extensions", ", ").alias("extensions"))


# archives and Office files


@query(f"SELECT 'a-' || (doc_id % 50) || '.zip' AS archive, 'd/' || doc_id || '.txt' AS path, sha256(text) AS hash FROM {_DOCS} WHERE text IS NOT NULL")
def archive_members(spark, d):
    """All documents put into zip archives and read from them."""
    return archives.archive_members(_archives(spark, d)).select("archive", "path", F.sha2("content", 256).alias("hash"))


def _archives(spark, d) -> DataFrame:
    def pack(p: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, text in zip(p["doc_id"], p["text"]):
                z.writestr(f"d/{i}.txt", text)
            z.writestr("skipped.bin", b"\0")
        return pd.DataFrame({"path": [f"a-{p['doc_id'].iat[0] % 50}.zip"], "content": [out.getvalue()]})

    rows = _docs(spark, d).where("text IS NOT NULL")
    return rows.groupBy((F.col("doc_id") % 50).alias("g")).applyInPandas(pack, "path string, content binary")


@query(f"SELECT 'd/' || doc_id || '.txt' AS file, n AS ordinal, sha256(code) AS content_hash, 'text' AS language, 'document' AS kind, start_line, end_line FROM ({_chunk_sql(_DOCS, 'doc_id')})")
def archive_chunks(spark, d):
    """Chunks of the members of archives, under the members' paths."""
    files = _archives(spark, d).withColumns({c: F.lit("x") for c in ("repo", "branch", "commit")})
    rows = archives.archive_members(files).select("path", F.posexplode(chunking.chunk_text("content")).alias("ordinal", "c"))
    made = archives.archive_chunks(files).select("file", "content_hash", "language", "kind", "start_line", "end_line").distinct()
    rows = rows.select(F.col("path").alias("file"), "ordinal", F.sha2("c.text", 256).alias("content_hash"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"))
    return rows.join(made, ["file", "content_hash", "start_line", "end_line"]).select("file", "ordinal", "content_hash", "language", "kind", "start_line", "end_line")


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("--", "."), text)
    return out.getvalue()


def _office() -> list[tuple[str, bytearray]]:
    w, s = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r, t = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    docx = _zip(**{"word__document--xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'})
    xlsx = _zip(
        **{
            "xl__workbook--xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl___rels__workbook--xml--rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl__sharedStrings--xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>',
            "xl__worksheets__sheet1--xml": f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c/></row></sheetData></worksheet>',
        }
    )
    odt = _zip(**{"content--xml": f'<o:document-content xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:t="{t}"><o:body><o:text><t:h t:outline-level="1">Title</t:h><t:p>Line</t:p></o:text></o:body></o:document-content>'})
    return [("a.docx", bytearray(docx)), ("b.xlsx", bytearray(xlsx)), ("c.odt", bytearray(odt)), ("d.docx", bytearray(b"broken")), ("e.html", bytearray(b"<p>Page &amp; text</p>"))]


@query("SELECT * FROM (VALUES ('a.docx', '## Head' || chr(10) || 'Some text'), ('b.xlsx', 'name' || chr(9) || '7'), ('c.odt', '# Title' || chr(10) || 'Line'), ('e.html', 'Page & text')) AS t(path, text)")
def office_text(spark, d):
    """Texts of Office files and pages; a broken file has none."""
    return archives.binary_text(spark.createDataFrame(_office(), "path string, content binary"))


# symbols

#: Small sources and the kinds that must be found in each; X rows of the inventory.
_SNIPPETS = {
    "rust": ("mod m;\npub struct P { x: u8 }\nimpl P { fn get(&self) -> u8 { self.x } }\ntrait T { fn t(&self); }\nenum E { A }\nconst C: u8 = 1;\ntype A = u8;\nfn main() {}\n", "constant enum function method module struct trait type_alias"),
    "python": ("def f(x):\n    return x\nclass A:\n    def m(self):\n        pass\n", "class function method"),
    "javascript": ("function f(a) { return a; }\nclass A { m() { return 1; } }\n", "class function method"),
    "typescript": ("interface I { a: string }\nclass A { m(): number { return 1; } }\nfunction f(): void {}\n", "class function interface method"),
    "java": ("public class A { int m() { return 1; } }\ninterface I {}\nenum E { X }\n", "class enum interface method"),
    "go": ("package a\ntype S struct { x int }\ntype I interface { M() }\nfunc (s S) M() {}\nfunc F() {}\nconst c = 1\n", "constant function interface method struct"),
    "c": ("struct s { int a; };\nenum e { X };\nint f(int a) { return a; }\n#define N 1\n", "constant enum function struct"),
    "cpp": ("namespace n {\nclass A { int x; };\nstruct S { int y; };\nint f(int a) { return a; }\n}\n", "class function module struct"),
    "csharp": ("namespace N { interface I {} class A { int M() { return 1; } } struct S {} enum E { X } }\n", "class enum interface method module struct"),
    "swift": ("protocol P {}\nenum E { case a }\nfunc f() {}\n", "enum function interface"),
    "php": ("<?php\nfunction f() {}\nclass A {}\ninterface I {}\ntrait T {}\n", "class function interface trait"),
    "ruby": ("module M\nclass A\n  def m\n  end\nend\nend\n", "class method module"),
    "bash": ("function f() { echo; }\ng() { echo; }\n", "function"),
    "scala": ("class A { def f(x: Int): Int = { x } }\ntrait T\nobject O\n", "class function trait"),
    "dart": ("class A {\n  int m() { return 1; }\n}\nenum E { a }\nmixin M {}\n", "class enum method trait"),
    "lua": ("function f(a)\n  return a\nend\n", "function"),
    "r": ("f <- function(x) { x }\n", "function"),
    "perl": ("package P;\nsub f { 1 }\n", "function module"),
    "kotlin": ("class A { fun m() = 1 }\nobject O\nfun f() {}\n", "class function"),
    "sql": ("create table t (a int);\ncreate function f() returns int as $$ select 1 $$ language sql;\ncreate view v as select 1;\n", "class function struct"),
    "python, broken": ("def f(x):\n    return (x\n\nclass A:\n    def m(self):\n        return 1\n", "class function method"),
}


@query(_values([(k, kind) for k, (_, kinds) in sorted(_SNIPPETS.items()) for kind in kinds.split()], "language, kind"))
def symbol_kinds(spark, d):
    """Kinds of symbols in a small source of every language, and in a Python source that does not parse."""
    ext = {k: v[0] for k, v in detect.LANGUAGE_EXTENSIONS.items()}
    files = [("r", "b", "c", f"{k}.{ext[k.split(',')[0]]}", text) for k, (text, _) in _SNIPPETS.items()]
    found = symbols.symbols(spark.createDataFrame(files, "repo string, branch string, commit string, path string, content string"))
    return found.select(F.regexp_replace("file_path", r"\.\w+$", "").alias("language"), "kind").distinct()


# embedding and evaluation


@query(
    "SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 'm-fallback' ELSE 'm' END AS model, round(CASE WHEN length(text) % 3 = 0 THEN (((('0x' || left(sha256(text), 16))::UBIGINT) & 255)::DOUBLE / 255)::FLOAT::DOUBLE ELSE (length(text) / 1000.0)::FLOAT::DOUBLE END, 5) AS first, 4 AS size "
    f"FROM {_DOCS} WHERE text IS NOT NULL"
)
def embedded(spark, d):
    """Vectors of an embedder that fails for some texts, which get fallback vectors."""
    rows = _docs(spark, d).where("text IS NOT NULL").select("doc_id", "text")
    model = lambda texts: [None if len(t) % 3 == 0 else [len(t) / 1000.0] * 4 for t in texts]
    out = embedding.embed(rows, "text", model, 4, "m")
    return out.select("doc_id", "model", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.size("vector").alias("size"))


@query("SELECT DISTINCT query_text, lower(language) AS language, len(expected_symbols)::INT AS n FROM eval_queries WHERE lower(language) = 'python'")
def eval_of_language(spark, d):
    """The evaluation queries of one language, in any case."""
    return evaluate.of_language(table(spark, d, "eval_queries"), "Python").select("query_text", F.lower("language").alias("language"), F.size("expected_symbols").alias("n")).distinct()


@query(_values([(a, b, c[0], len(c)) for a, b, c in evaluate.BUILT_IN], "language, query_text, first, n"))
def eval_built_in(spark, d):
    """The built-in evaluation queries."""
    return evaluate.built_in_queries(spark).select("language", "query_text", F.col("expected_symbols")[0].alias("first"), F.size("expected_symbols").alias("n"))


# the store


@query(f"SELECT id, repo, round(s, 6) AS score FROM (SELECT id, payload.repo AS repo, s, first FROM ({_SCORED}) WHERE payload.repo = (SELECT min(payload.repo) FROM vector_points) ORDER BY s DESC, first, id LIMIT 10)")
def search_repo(spark, d):
    """The ten nearest points of one repository."""
    rows = table(spark, d, "vector_points")
    repo = rows.select(F.min("payload.repo")).first()[0]
    found = search.search(store.latest_points(rows), _point_query(), search.SearchOptions(10, 0, None, search.SearchFilter(repo=repo)))
    return found.select("id", "repo", F.round("score", 6).alias("score"))


def _store(spark, d) -> store.PointStore:
    at = store.PointStore(spark, f"{shared_dir(spark)}/points-{uuid.uuid4().hex}", buckets=8)
    at.save(store.latest_points(table(spark, d, "vector_points")))
    return at


_NEW = "substr(sha256(id), 1, 1) IN ('0', '1')"


@query(
    f"SELECT id, CASE WHEN {_NEW} THEN 'changed' ELSE payload.symbol END AS symbol, payload.file AS file FROM ({_LATEST}) WHERE coalesce(payload.language, '') <> 'rust' UNION ALL SELECT 'added', 'changed', 'x/new.py'"
)
def store_round(spark, d):
    """A store after an upsert of changed and new points and a deletion by language; only touched buckets are rewritten."""
    s = _store(spark, d)
    some = s.load().where(F.substring(F.sha2("id", 256), 1, 1).isin("0", "1")).withColumn("symbol", F.lit("changed"))
    new = some.limit(1).withColumns({"id": F.lit("added"), "file": F.lit("x/new.py"), "language": F.lit("python")})
    s.upsert(stage(some.unionByName(new), "batch"))
    s.delete_by_language("rust")
    return s.load().select("id", "symbol", "file")


@query(f"SELECT id FROM ({_LATEST}) WHERE coalesce(payload.file, '') <> (SELECT min(payload.file) FROM vector_points) AND id <> (SELECT min(id) FROM vector_points)")
def store_deleted(spark, d):
    """A store without one id and without the rows of one file."""
    s = _store(spark, d)
    low = s.load().agg(F.min("id"), F.min("file")).first()
    s.delete(low[0])
    s.delete_by_file(table(spark, d, "vector_points").select(F.min("payload.file")).first()[0])
    return s.load().select("id")


@query(f"SELECT (SELECT count(*) FROM ({_LATEST})) AS points, true AS has_first, false AS has_other, 0::BIGINT AS after_clear")
def store_verbs(spark, d):
    """Count, membership and clearing of a store."""
    s = _store(spark, d)
    n, first = s.count(), s.load().agg(F.min("id")).first()[0]
    has, other = s.contains(first), s.contains("no such id")
    s.clear()
    return spark.createDataFrame([(n, has, other, s.count())], "points bigint, has_first boolean, has_other boolean, after_clear bigint")


@query("SELECT date_trunc('day', changed_at)::TIMESTAMP AS window_start, repo, upper(left(status, 1)) || lower(substr(status, 2)) AS status, count(*) AS n FROM file_changes WHERE changed_at IS NOT NULL GROUP BY ALL")
def change_windows(spark, d):
    """Changes by day, repository and status, as the stream counts them."""
    rows = index_stream.windowed_changes(table(spark, d, "file_changes").withColumn("changed_at", F.col("changed_at").cast("timestamp")))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
