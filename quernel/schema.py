"""Row types shared by all operators."""

from __future__ import annotations

CHUNK_COLUMNS = [
    "id", "content_hash", "repo", "branch", "commit", "language", "file", "module", "symbol", "kind", "signature", "doc", "code", "start_line", "end_line",
]
CHUNK = (
    "id string, content_hash string, repo string, branch string, commit string, language string, file string, module string, symbol string, "
    "kind string, signature string, doc string, code string, start_line bigint, end_line bigint"
)
SYMBOL = (
    "id string, name string, kind string, module_path string, file_path string, signature string, code string, language string, doc string, parent string, "
    "line_start bigint, line_end bigint, column_start bigint, column_end bigint, is_public boolean, is_static boolean, is_async boolean"
)
FILE = "path string, blob_id string, file_mode int, content binary"
COMMIT = "oid string, message string, author_name string, author_email string, time bigint"
CHANGE = "path string, status string, old_blob_id string, new_blob_id string"
EVAL_QUERY = "language string, query_text string, expected_symbols array<string>, expected_files array<string>"

SYMBOL_KINDS = (
    "function", "method", "class", "struct", "interface", "trait", "enum", "module", "constant", "variable", "type_alias", "field", "property", "parameter", "import", "unknown",
)
CHANGE_KINDS = ("Added", "Modified", "Deleted", "Renamed", "Copied")
