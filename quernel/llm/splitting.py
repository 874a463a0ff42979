"""Problem 5: cutting oversized texts at natural boundaries by lexical cohesion.

Lines are the units. At every line end the words of the block before are compared with those of the block after; the
similarity's valleys, measured by how far it rises on both sides, mark topic boundaries. Each piece is cut at the
deepest valley of the window that its size allows; a line longer than the limit is cut at white space, or else
between characters.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import bounded_rows, spread

BLOCK = 4  # lines on either side of a gap
DIMS = 64  # hashed word counts of a line
MAX_CONFIGS = 1000
_WORD = re.compile(rb"[A-Za-z_]\w+")
_ASIAN = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
#: Words of texts beyond ASCII; of scripts without spaces every character is one.
_WIDE = re.compile(rf"[{_ASIAN}]|(?:(?![{_ASIAN}])[^\W\d])(?:(?![{_ASIAN}])\w)+")
_SPACE = b" \t\n\r\f\v"


def line_words(line: bytes) -> list[bytes]:
    if line.isascii():
        return _WORD.findall(line)
    return [w.encode() for w in _WIDE.findall(line.decode("utf-8", "ignore"))]


def gap_depths(lines: list[bytes]) -> np.ndarray:
    """Depth of the valley at the end of every line but the last; 0 where there is none."""
    n = len(lines)
    if n < 2:
        return np.zeros(0)
    where, what = [], []
    for i, line in enumerate(lines):
        for w in line_words(line):
            where.append(i)
            what.append(zlib.crc32(w) % DIMS)
    counts = np.bincount(np.array(where, np.int64) * DIMS + np.array(what, np.int64), minlength=n * DIMS) if where else np.zeros(n * DIMS)
    upto = np.vstack([np.zeros(DIMS), np.cumsum(counts.reshape(n, DIMS), axis=0)])
    gap = np.arange(1, n)
    left = upto[gap] - upto[np.maximum(gap - BLOCK, 0)]
    right = upto[np.minimum(gap + BLOCK, n)] - upto[gap]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    sim = np.divide((left * right).sum(axis=1), norm, out=np.zeros(n - 1), where=norm > 0)
    # the highest similarity reached by climbing from the gap, without a dip, to either side
    climb_l, climb_r = sim.copy(), sim.copy()
    s = sim.tolist()
    for i in range(1, n - 1):
        if s[i - 1] > s[i]:
            climb_l[i] = climb_l[i - 1]
    for i in range(n - 3, -1, -1):
        if s[i + 1] > s[i]:
            climb_r[i] = climb_r[i + 1]
    return climb_l + climb_r - 2 * sim


@lru_cache(maxsize=2)
def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lines of a text and the depths of the valleys there; they are the same for every size limit."""
    lines = data.splitlines(keepends=True) if b"\r" in data else [x + b"\n" for x in data.split(b"\n")]
    if b"\r" not in data:
        lines[-1] = lines[-1][:-1]
        if not lines[-1]:
            lines.pop()
    depth = np.append(gap_depths(lines), 0.0)
    depth[np.array([not x.strip() for x in lines])] += 0.25  # a blank line is a boundary of its own
    return np.cumsum([len(x) for x in lines]), depth


def cut_spans(data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte spans of the pieces: ordered, at most ``limit`` long, covering all, each beginning ``overlap`` bytes
    before the end of the one before (later only to keep a character whole)."""
    size = len(data)
    if limit < 4:
        raise ValueError("a piece must hold a whole character: max_chunk_size is below 4")
    if size <= limit:
        return [(0, size)]
    overlap = max(0, min(overlap, limit - 4))
    ends, depth = boundaries(data)

    def whole(at: int, low: int) -> int:
        """The last character boundary at or before ``at``."""
        while at > low and at < size and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    spans, start, done = [], 0, 0
    while True:
        most = start + limit
        if most >= size:
            return [*spans, (start, size)]
        cut = 0
        low = max(done, start + overlap)  # a piece is longer than what it shares with the next
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, most, "right")
        if b > a:  # the deepest valley of the whole window, of equal ones the last
            best = depth[a:b]
            cut = int(ends[a + len(best) - 1 - int(np.argmax(best[::-1]))])
        else:
            k = most
            while k > low + 1 and data[k - 1] not in _SPACE:
                k -= 1
            cut = k if k > max(low + 1, start + limit // 4) else whole(most, low)
            if cut <= low:  # no character ends here: not valid UTF-8
                cut = most
        spans.append((start, cut))
        done = cut
        start = cut - overlap
        while start < cut and data[start] & 0xC0 == 0x80:
            start += 1


def split_oversized(chunks: DataFrame, config: DataFrame, with_text: bool = False) -> DataFrame:
    """Pieces of every ``code`` larger than ``max_chunk_size``, for each row of ``config``.

    Columns config_id, chunk_id, ordinal (from 0), start_byte, end_byte and, if asked for, piece. Null code, null
    config_id or null max_chunk_size give no pieces; a null or negative overlap counts as 0, and one that leaves less
    than four bytes of a piece is cut down to that. Copies of a row give equal rows. Empty tables give no rows.
    """
    rows = bounded_rows(config.select("config_id", "max_chunk_size", "overlap").distinct(), MAX_CONFIGS, "chunk_config")
    setups = [(r[0], int(r[1]), int(r[2] or 0)) for r in rows if r[0] is not None and r[1] is not None]
    least = min((m for _, m, _ in setups), default=1 << 62)
    schema = "config_id bigint, chunk_id string, ordinal int, start_byte int, end_byte int" + (", piece string" if with_text else "")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_text)]
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for config_id, limit, overlap in setups:
                    if len(data) > limit:
                        spans = cut_spans(data, limit, overlap)
                        for n, (a, b) in enumerate(spans):
                            for column, value in zip(out, (config_id, key, n, a, b)):
                                column.append(value)
                            if with_text:
                                out[5].append(data[a:b].decode("utf-8", "replace"))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = ["config_id", "chunk_id", "ordinal", "start_byte", "end_byte", "piece"]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    big = chunks.where(F.octet_length("code") > F.lit(least))
    return spread(big.select(F.col("id").cast("string").alias("id"), F.col("code").cast("binary").alias("code")), "id").mapInArrow(run, schema)
