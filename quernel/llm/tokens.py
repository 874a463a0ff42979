"""Problem 8: encoding with a public tokenizer, its offsets, and the way back.

Texts go through the ``tokenizers`` library in Arrow batches; special-token strings are ordinary text and no
special tokens are added. The vocabulary file's place is a parameter (``DEFAULT_FILE``).
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest is shifted up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    """Bytes of every token id."""
    t, alphabet = _tokenizer(path), byte_alphabet()
    out = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        try:
            out[i] = bytes(alphabet[c] for c in token)
        except KeyError:
            out[i] = token.encode()
    return out


@lru_cache(maxsize=4)
def _token_sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in _token_bytes(path)], dtype=np.int64)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text and broken UTF-8 gets replacement characters."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        raw = column.cast(pa.binary()).to_pylist()
        return [(x or b"").decode("utf-8", "replace") for x in raw]


def encode_texts(texts: list[str], path: str = DEFAULT_FILE) -> list[list[int]]:
    return [e.ids for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def char_spans(text: str, ids: list[int], path: str = DEFAULT_FILE) -> tuple[list[int], list[int]]:
    """Character offsets [start, end) of every token, from byte lengths; a token that holds only part of a
    character covers the whole character, so the spans of its parts coincide."""
    ends = np.cumsum(_token_sizes(path)[np.asarray(ids, dtype=np.int64)]) if ids else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(lead)])  # characters begun before each byte
    at = lambda b: np.where(b < len(lead), upto[b] - ~lead[np.minimum(b, len(lead) - 1)], upto[b])
    return (at(starts).tolist(), upto[ends].tolist()) if len(ends) else ([], [])


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_FILE, offsets: bool = False) -> DataFrame:
    """Token ids of every distinct row (key, text).

    Null and empty texts give the empty list. Copies of a row give one row; a null key is kept as null. With
    ``offsets``, ``starts`` and ``ends`` hold each token's character span. Other columns are not read.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(1))
            ids = encode_texts(texts, path)
            cols = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                spans = [char_spans(t, i, path) for t, i in zip(texts, ids)]
                cols += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, [key, "ids", "starts", "ends"][: len(cols)])

    return df.select(key, text).distinct().mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str = DEFAULT_FILE) -> str:
    """Text of a token list. Bytes are joined before decoding, so characters split over tokens come back whole; a
    list that begins or ends inside a character gives a replacement character there."""
    table = _token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode(df: DataFrame, key: str, path: str = DEFAULT_FILE) -> DataFrame:
    """The texts of an encoded table with columns ``key`` and ``ids``; null ids give the empty text."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            texts = [decode_ids(x or [], path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(df: DataFrame, columns: list[str], text: str, path: str = DEFAULT_FILE) -> DataFrame:
    """``columns`` of every row and the size of ``text`` in tokens as ``n_tokens``."""
    fields = [f for c in columns for f in df.schema.fields if f.name == c]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def run(batches):
        for batch in batches:
            n = [len(x) for x in encode_texts(strings(batch.column(len(columns))), path)]
            arrays = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64())], [*columns, "n_tokens"])

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema)
