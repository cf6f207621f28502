"""Quality rules: compression bands.

The zstandard ratio of a whole text, and of its fixed chunks, tells repetitive texts (high) and incompressible ones
(low). What ratio is usual depends on the length, so the limits are given by bands of length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, fresh

#: (bytes below, least ratio, largest ratio), for whole texts and for chunks. Texts below 128 bytes hardly compress,
#: whatever they say. The least ratios lie above base64 of random bytes from 128 bytes on and above hex from 2048 bytes
#: on; shorter hex compresses as well as prose.
BANDS = ((128, 0.0, 1e9), (256, 1.12, 2.4), (512, 1.24, 2.6), (1024, 1.4, 2.7), (1536, 1.65, 2.8), (2048, 1.8, 2.8), (4096, 1.92, 3.0), (16384, 1.97, 3.4), (float("inf"), 2.0, 4.0))
#: Bytes in a chunk, and the share of a text's bytes in chunks outside their band that is still accepted.
CHUNK, CHUNK_SHARE = 4096, 0.02
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of width words found twice or more in the text, the first place included.

    Windows are numbered by doubling: windows of 2k words are pairs of windows of k words, so numbers are exact.
    """
    n = len(words)
    numbers: dict[str, int] = {}
    k = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if n <= width or len(numbers) == n:
        return 0
    size = 1
    while size < width:
        step = min(size, width - size)
        key = k[: len(k) - step] * n + k[step:]
        _, k = np.unique(key, return_inverse=True)
        size += step
    twice = np.bincount(k)[k] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = WORD_RE.findall(text)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    if len(set(lines)) < len(lines):
        for line in lines:
            if line in seen:
                dup += 1
            elif WORD_RE.search(line):
                seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def outside(n_bytes: int, ratio: float) -> bool:
    """Whether the ratio lies outside the band of its length."""
    low, high = next((a, b) for below, a, b in BANDS if n_bytes < below)
    return not low <= ratio <= high


def verdict(data: bytes, pack) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks (the shorter last one too) outside the band of their
    length, and whether the text keeps within all limits."""
    if not data:
        return 0.0, 0.0, True
    ratio = len(data) / len(pack(data))
    if len(data) <= CHUNK:
        odd = float(outside(len(data), ratio))
    else:
        chunks = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        odd = sum(len(c) for c in chunks if outside(len(c), len(c) / len(pack(c)))) / len(data)
    return ratio, odd, not outside(len(data), ratio) and odd <= CHUNK_SHARE


def compression_bands(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, level: int = 3) -> DataFrame:
    """The base counts and the verdict of each whole text; no shuffle.

    Returns the columns named in keep (by default all), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed (fewer than 20 words, or over 30 % of them repeated), ratio, chunks_odd (double), kept boolean.
    A null text counts as empty: no words, so it fails. Input columns with the names of results give way.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [*counts, "base_failed", "ratio", "chunks_odd", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(fresh("text", keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level).compress
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                rows = []
                for t in batch.column(len(keep)).to_pylist():
                    b = base(t)
                    failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
                    ratio, odd, good = verdict(t.encode(), pack)
                    rows.append((*b, failed, ratio, odd, good and not failed))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
                arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + arrays, [*keep, *own])

    schema = type(docs.schema)([docs.schema[c] for c in keep])
    for c, kind in zip(own, ["long"] * 5 + ["boolean", "double", "double", "boolean"], strict=True):
        schema = schema.add(c, kind)
    return source.mapInArrow(run, schema)
