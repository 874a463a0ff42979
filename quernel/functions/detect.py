"""Language and document-format detection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each language; case counts. Fixed values.
LANGUAGE_EXTENSIONS = {
    "rust": ["rs"],
    "python": ["py", "pyw"],
    "javascript": ["js", "jsx", "mjs"],
    "typescript": ["ts", "tsx", "mts"],
    "java": ["java"],
    "go": ["go"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hh"],
    "csharp": ["cs"],
    "swift": ["swift"],
    "php": ["php"],
    "ruby": ["rb"],
    "bash": ["sh", "bash"],
    "scala": ["scala"],
    "dart": ["dart"],
    "lua": ["lua"],
    "r": ["r", "R"],
    "perl": ["pl", "pm"],
    "kotlin": ["kt", "kts"],
    "sql": ["sql"],
}
#: File names with a language of their own. Fixed values.
SPECIAL_FILES = {"Makefile": "c", "makefile": "c", "CMakeLists.txt": "c", "BUILD": "python", "BUILD.bazel": "python"}
#: Words of a shebang line, tried in this order. Fixed values.
SHEBANGS = {"python": "python", "node": "javascript", "rust": "rust", "go": "go", "ruby": "ruby", "perl": "perl", "bash": "bash"}
#: Extensions of each document format, in any case. Fixed values.
FORMAT_EXTENSIONS = {
    "markdown": ["md", "markdown", "mdx"],
    "text": ["txt", "text"],
    "xml": ["xml"],
    "json": ["json", "jsonl", "ndjson"],
    "toml": ["toml"],
    "ini": ["ini", "cfg", "conf", "properties"],
    "csv": ["csv", "tsv"],
    "log": ["log"],
    "html": ["html", "htm"],
    "xlsx": ["xlsx"],
    "xls": ["xls"],
    "ods": ["ods"],
    "docx": ["docx"],
    "odt": ["odt"],
    "pdf": ["pdf"],
    "zip": ["zip"],
    "tar": ["tar"],
    "gz": ["gz", "gzip", "tgz"],
}
#: Files without extension that are text. Fixed values.
TEXT_FILES = [
    "LICENSE", "LICENSE-MIT", "LICENSE-APACHE", "COPYING", "README", "CHANGELOG", "CHANGES", "AUTHORS", "Makefile", "makefile", "Dockerfile", "Containerfile", "Vagrantfile", "Jenkinsfile",
]
TEXT_FORMATS = ["markdown", "text", "xml", "json", "toml", "ini", "csv", "log"]
BINARY_FORMATS = ["html", "xlsx", "xls", "ods", "docx", "odt", "pdf"]
ARCHIVE_FORMATS = ["zip", "tar", "gz"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """What follows the last dot of the file name; null without one, or where the only dot comes first."""
    name = file_name(path)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), ext)


def _lookup(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[F.lit(x) for label, exts in table.items() for ext in exts for x in (ext, label)])


def language_by_extension(ext: Column | str) -> Column:
    return _lookup(LANGUAGE_EXTENSIONS)[_col(ext)]


def language_by_path(path: Column | str) -> Column:
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_FILES.items() for x in kv])
    return F.coalesce(special[file_name(path)], language_by_extension(extension(path)))


def language_by_shebang(content: Column | str) -> Column:
    first = F.substring_index(_col(content), "\n", 1)
    out = F.lit(None).cast("string")
    for word, language in reversed(SHEBANGS.items()):
        out = F.when(first.contains(word), F.lit(language)).otherwise(out)
    return F.when(_col(content).startswith("#!"), out)


def language_by_heuristics(content: Column | str) -> Column:
    has = _col(content).contains
    return (
        F.when((has("def ") & has(":")) | (has("import ") & has("from ")), "python")
        .when((has("fn ") & has("->")) | has("impl ") | has("let mut"), "rust")
        .when(has("package ") & has("func ") & has('import "'), "go")
        .when(has("public class ") | has("public static void main"), "java")
    )


def language_by_content(content: Column | str) -> Column:
    return F.coalesce(language_by_shebang(content), language_by_heuristics(content))


def language(path: Column | str, content: Column | str) -> Column:
    """By path, else by content; null where neither tells."""
    return F.coalesce(language_by_path(path), language_by_content(content))


def document_format(path: Column | str) -> Column:
    ext = extension(path)
    by_name = F.when(file_name(path).isin(TEXT_FILES), "text")
    return F.coalesce(F.when(ext.isNotNull(), _lookup(FORMAT_EXTENSIONS)[F.lower(ext)]).otherwise(by_name), F.lit("unknown"))


def format_tier(fmt: Column | str) -> Column:
    f = _col(fmt)
    return F.when(f.isin(TEXT_FORMATS), "text").when(f.isin(BINARY_FORMATS), "binary").when(f.isin(ARCHIVE_FORMATS), "archive").otherwise("none")


def languages(spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """The supported languages and their extensions; ``only`` makes a smaller registry and rejects unknown names."""
    unknown = set(only or ()) - set(LANGUAGE_EXTENSIONS)
    if unknown:
        raise ValueError(f"no such languages: {sorted(unknown)}")
    rows = [(k, v) for k, v in LANGUAGE_EXTENSIONS.items() if only is None or k in only]
    return spark.createDataFrame(rows, "language string, extensions array<string>")


#: Names of the languages as they are shown. Fixed values.
LABELS = {"javascript": "JavaScript", "typescript": "TypeScript", "cpp": "C++", "csharp": "C#", "php": "PHP", "bash": "Shell/Bash", "sql": "SQL"}


def capabilities(spark: SparkSession) -> DataFrame:
    """language, label, extensions and kinds of symbols of each supported language, and the line that shows them."""
    from quernel.functions import symbols

    rows = [(k, LABELS.get(k, k.capitalize()), [f".{e}" for e in v], symbols.kinds_of(k)) for k, v in LANGUAGE_EXTENSIONS.items()]
    out = spark.createDataFrame(rows, "language string, label string, extensions array<string>, kinds array<string>")
    ext = F.concat(F.lit("("), F.concat_ws(", ", "extensions"), F.lit(")"))
    return out.withColumn("text", F.concat(F.rpad("label", 15, " "), F.rpad(ext, 19, " "), F.lit("- "), F.concat_ws(", ", "kinds")))
