"""Chunk rows from documents and symbols, their hashes and embedding texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import detect, markup
from quernel.functions.markup import WHITE
from quernel.schema import CHUNK_COLUMNS

MAX_SIZE, OVERLAP = 2000, 200
NEAR_START = 10  # a cut at white space this close to the start is no cut
MAX_SIGNATURE = 80
_WHITE_RE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PIECES = "array<struct<text:string,start_line:bigint,end_line:bigint>>"


def _lines(text: str) -> int:
    """Lines of a text; a break at the end begins no further one."""
    return text.count("\n") + (not text.endswith("\n")) if text else 0


def _head(text: str, limit: int) -> tuple[str, str]:
    """A text cut near ``limit`` bytes: at the last white space if that is not too close to the start, else at the limit,
    moved back to a character's boundary."""
    head = text.encode()[:limit].decode("utf-8", "ignore")
    at = max(head.rfind(c) for c in WHITE)
    if at >= 0 and len(head[:at].encode()) > NEAR_START:
        head = head[:at]
    head = head or text[:1]
    return head, text[len(head) :]


def _tail(text: str, limit: int) -> str:
    """The last ``limit`` bytes, from the next white space on."""
    raw = text.encode()
    if len(raw) <= limit:
        return text.strip(WHITE)
    tail = raw[len(raw) - limit :].decode("utf-8", "ignore") if limit > 0 else ""
    for i, c in enumerate(tail):
        if c in WHITE:
            return tail[i:].strip(WHITE)
    return tail.strip(WHITE)


def chunk_text_pieces(text: str, limit: int = MAX_SIZE, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of the chunks of a text; sizes are UTF-8 bytes.

    Paragraphs are packed up to the limit and carry an overlap over; a paragraph above the limit is cut by itself,
    without overlap. Line numbers count the paragraphs' own lines only.
    """
    text = text.strip(WHITE)
    size = lambda t: len(t.encode())
    if not text:
        return []
    if size(text) <= limit:
        return [(text, 1, 1)]
    out: list[tuple[str, int, int]] = []
    held, begin, end, line = "", 1, 1, 1
    for para in text.split("\n\n"):
        para = para.strip(WHITE)
        if not para:
            continue
        n = _lines(para)
        if size(para) > limit:
            if held:
                out.append((held, begin, end))
            rest, begin = para, line
            while size(rest) > limit:
                head, rest = _head(rest, limit)
                part = head.strip(WHITE)
                if part:
                    out.append((part, begin, begin + _lines(head)))
                begin += _lines(head)
                rest = rest.strip(WHITE)
            held, end = rest, begin + max(1, _lines(rest)) - 1
        elif held and size(held) + size(para) + 2 > limit:
            out.append((held, begin, end))
            carried = _tail(held, overlap)
            begin = max(1, line - _lines(carried))
            held, end = f"{carried}\n\n{para}" if carried else para, line + n - 1
        else:
            if not held:
                begin = line
            held, end = f"{held}\n\n{para}" if held else para, max(begin, line + n - 1)
        line += n
    if held:
        out.append((held, begin, end))
    return out


def chunk_text(text: Column | str, limit: int = MAX_SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a text column as an array; null for a null text."""

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series) -> pd.Series:
        names = ("text", "start_line", "end_line")
        return texts.map(lambda t: None if t is None else [dict(zip(names, p)) for p in chunk_text_pieces(t, limit, overlap)])

    return run(text)


def _utf8_prefix(text: Column, n: int) -> Column:
    """The first ``n`` bytes, without a character that they would cut."""
    raw = F.substring(text.cast("binary"), 1, n)
    back = [F.when(F.is_valid_utf8(F.substring(raw, 1, n - k).cast("string")), F.substring(raw, 1, n - k).cast("string")) for k in range(4)]
    return F.coalesce(*back)


def signature(text: Column | str) -> Column:
    """The first line with more than white space, trimmed; above 80 bytes cut and marked with dots."""
    t = F.col(text) if isinstance(text, str) else text
    line = F.regexp_replace(F.regexp_extract(t, rf"^{_WHITE_RE}*([^\n]+)", 1), rf"{_WHITE_RE}+$", "")
    return F.when(line == "", "(empty)").when(F.octet_length(line) > MAX_SIGNATURE, F.concat(_utf8_prefix(line, MAX_SIGNATURE), F.lit("..."))).otherwise(line)


def content_hash(code: Column, sig: Column, file: Column, module: Column, language: Column) -> Column:
    """SHA-256 over the five fields put together without separators."""
    return F.sha2(F.concat(code, sig, file, module, language), 256)


def chunk_id(*parts: Column, random: bool = False) -> Column:
    """A stable id from what makes a chunk itself; the same input gives the same id in every run. ``random`` gives a new
    UUID instead, other in every run."""
    if random:
        return F.uuid()
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def embedding_text(language: Column | str, sig: Column | str, doc: Column | str, code: Column | str) -> Column:
    """``[language] ``, then signature, documentation and code, each on a line of its own where it is not empty."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat_ws("\n", F.concat(F.lit("["), c(language), F.lit("] ")), F.nullif(c(sig), F.lit("")), F.nullif(c(doc), F.lit("")), c(code))


def document_text(path: Column | str, content: Column | str, strip: bool = True) -> Column:
    """The text of a document by its format: Markdown and XML stripped, other text formats as they are, else null."""
    fmt = detect.document_format(path)
    c = F.col(content) if isinstance(content, str) else content
    plain = markup.strip_markdown(c) if strip else c
    return F.when(fmt == "markdown", plain).when(fmt == "xml", markup.strip_xml(c)).when(fmt.isin(detect.TEXT_FORMATS), c)


def document_chunks(files: DataFrame, limit: int = MAX_SIZE, overlap: int = OVERLAP, strip: bool = True, random_ids: bool = False) -> DataFrame:
    """Chunk rows of all text documents of a table (repo, branch, commit, path, content)."""
    rows = files.where(detect.format_tier(detect.document_format("path")) == "text")
    rows = rows.withColumn("body", document_text("path", "content", strip))
    rows = rows.select("repo", "branch", "commit", "path", F.posexplode(chunk_text("body", limit, overlap)).alias("ordinal", "c"))
    text, empty = F.col("c.text"), F.lit("")
    return rows.select(
        chunk_id(F.col("repo"), F.col("path"), F.lit("document"), F.col("ordinal").cast("string"), F.sha2(text, 256), random=random_ids).alias("id"),
        F.sha2(text, 256).alias("content_hash"), "repo", "branch", "commit", detect.document_format("path").alias("language"), F.col("path").alias("file"),
        empty.alias("module"), empty.alias("symbol"), F.lit("document").alias("kind"), signature(text).alias("signature"), F.lit(None).cast("string").alias("doc"),
        text.alias("code"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"),
    )


def symbol_chunks(symbols: DataFrame, include_docs: bool = True, include_signatures: bool = True, compat_language: bool = False, random_ids: bool = False) -> DataFrame:
    """A code chunk of every symbol and, where it is documented, a documentation chunk.

    ``symbols`` has the symbol columns and repo, branch and commit. ``compat_language`` keeps the language "unknown". The
    hash takes in the signature even where ``include_signatures`` leaves it out of the row.
    """
    language = F.lit("unknown") if compat_language else F.coalesce("language", F.lit("unknown"))
    sig, doc = F.coalesce("signature", F.lit("")), F.coalesce("doc", F.lit(""))
    shown = sig if include_signatures else F.lit("")
    file, module = F.col("file_path"), F.coalesce("module_path", F.lit(""))

    def row(kind: Column, code: Column, s: Column, end: Column, text: Column) -> Column:
        h = content_hash(code, sig, file, module, language)
        key = chunk_id(F.col("repo"), file, F.col("line_start").cast("string"), F.col("name"), kind, h, random=random_ids)
        values = [key, h, F.col("repo"), F.col("branch"), F.col("commit"), language, file, module, F.col("name"), kind, s, text, code, F.col("line_start"), end]
        return F.struct(*[v.alias(n) for v, n in zip(values, CHUNK_COLUMNS)])

    code = row(F.col("kind"), F.col("code"), shown, F.col("line_end"), F.col("doc") if include_docs else F.lit(None).cast("string"))
    about = row(F.concat("kind", F.lit("_doc")), F.concat(sig, F.lit("\n"), doc), sig, F.col("line_start"), F.col("doc"))
    rows = F.array(code, F.when(doc != "", about)) if include_docs else F.array(code)
    return symbols.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
