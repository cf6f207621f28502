"""Importance resampling towards a target distribution, by prefix-CRC substrings.

A document's words joined by one space are scanned once; the running CRC-32 behind every word is stored. The CRC of any
run of words then follows from two prefixes: the earlier one, moved over the run's bytes as a polynomial over GF(2),
cancels out of the later one. So n-grams of all orders are counted from one table of prefixes, without building a string.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

BUCKETS = 10_000
ORDERS = (1, 2, 3)
#: Words in a block of prefixes, and bytes of text split at a time.
BLOCK, PIECE = 1 << 20, 4 << 20
#: Lower case of A-Z; every byte that ends words becomes a space. Bytes from 0x80 on are parts of words, as their characters are.
NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _over_zero(crc: np.ndarray) -> np.ndarray:
    """A CRC register moved over one zero byte."""
    return BYTE[crc & 255] ^ crc >> 8


def _byte_table() -> np.ndarray:
    """One step of CRC-32 (reflected polynomial EDB88320) for every byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _near_tables() -> np.ndarray:
    """For lengths up to 256: what each value of each of a register's bytes becomes, moved over so many zero bytes."""
    step = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [step]
    for _ in range(256):
        out.append(step := _over_zero(step))
    return np.stack(out)


BYTE = _byte_table()
NEAR = _near_tables()
_near = np.ascontiguousarray(NEAR[:256]).reshape(-1)
_far = [NEAR[256]]


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved over n bytes each: the part that a prefix has in a CRC n bytes further on. Lengths from 256 bytes on
    take a step for each of their bits."""
    at = (n & 255) << 10
    out = _near[at + (crc & 255)] ^ _near[at + 256 + (crc >> 8 & 255)] ^ _near[at + 512 + (crc >> 16 & 255)] ^ _near[at + 768 + (crc >> 24)]
    high, bit = n >> 8, 0
    while len(high) and (high >> bit).any():
        if bit == len(_far):
            _far.append(_moved(_far[-1], _far[-1]))
        rows = np.flatnonzero(high >> bit & 1)
        out[rows] = _moved(_far[bit], out[rows])
        bit += 1
    return out


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in runs of about PIECE bytes that end between words."""
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE) if len(data) - lo > PIECE else len(data)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi]
        lo = hi


def prefixes(text: str) -> tuple[int, bytes, bytes]:
    """Number of words, the running CRC-32 behind every word, and the words' lengths in bytes (of 1 or 4 bytes each)."""
    crcs: list[int] = []
    lengths: list[int] = []
    add, crc = crcs.append, 0
    for piece in _pieces(text.encode().translate(NORMAL)):
        words = piece.split()
        if not words:
            continue
        lengths += map(len, words)
        spaced = b" ".join(words).replace(b" ", b"\n ").split(b"\n")
        if crcs:
            spaced[0] = b" " + spaced[0]
        for word in spaced:
            crc = crc32(word, crc)
            add(crc)
    width = np.uint8 if max(lengths, default=0) < 256 else np.uint32
    return len(crcs), np.array(crcs, np.uint32).tobytes(), np.array(lengths, width).tobytes()


def prefix_table(docs: DataFrame, text: str, keep: list[str], names: list[str]) -> DataFrame:
    """The columns in keep, and the number of words, CRCs and lengths under the three names. No shuffle."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(fresh("text", keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n, crcs, lengths = zip(*(prefixes(t.as_py()) for t in batch.column(len(keep))), strict=True)
                own = [pa.array(n, pa.int64()), pa.array(crcs, pa.binary()), pa.array(lengths, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + own, [*keep, *names])

    schema = type(docs.schema)([docs.schema[c] for c in keep])
    for name, kind in zip(names, ("long", "binary", "binary"), strict=True):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def features(n: np.ndarray, crcs: list[bytes], lengths: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every n-gram of some documents, a block of words and an order at a time."""
    crc = np.frombuffer(b"".join(crcs), np.uint32)
    length = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == k else np.uint32).astype(np.int64) for x, k in zip(lengths, n.tolist(), strict=True)]) if len(n) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(crc), BLOCK):
        hi = min(len(crc), lo + BLOCK + ORDERS[-1] - 1)
        own, end = row[lo:hi], np.cumsum(length[lo:hi] + 1)
        begin, last = end - length[lo:hi], crc[lo:hi]
        before = np.concatenate([crc[lo - 1 : lo] if lo else np.zeros(1, np.uint32), last[:-1]])
        first = np.concatenate([row[lo - 1 : lo] if lo else np.full(1, -1), own[:-1]]) != own
        before = np.where(first, np.uint32(0), ~(BYTE[(~before ^ np.uint32(0x20)) & 255] ^ ~before >> 8))  # the space counts
        for order in ORDERS:
            m = min(len(own) - order + 1, BLOCK)
            if m > 0:
                grams = last[order - 1 : order - 1 + m] ^ shift(before[:m], end[order - 1 : order - 1 + m] - begin[:m])
                inside = own[:m] == own[order - 1 : order - 1 + m]
                yield own[:m][inside], (grams % np.uint32(BUCKETS))[inside]


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Iterator]]:
    """Runs of rows of the prefix table with about BLOCK words, and their features."""
    for batch in batches:
        n = batch.column(names[0]).to_numpy(zero_copy_only=False)
        total, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, n[lo:hi], features(n[lo:hi], part.column(names[1]).to_pylist(), part.column(names[2]).to_pylist())
            lo = hi


def bucket_counts(table: DataFrame, names: list[str]) -> np.ndarray:
    """How many features of the table lie in each bucket. A task sends one row for each of the fixed number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, _, found in _blocks(batches, names):
            for _, bucket in found:
                total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in table.select(*names).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A bucket's gain, 1000 times the logarithm of its share in the target over its share in the corpus, each with one added."""
    ratio = (t + 1.0) * (float(s.sum()) + BUCKETS) / ((s + 1.0) * (float(t.sum()) + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(table: DataFrame, keep: list[str], names: list[str], gain: np.ndarray) -> DataFrame:
    """The columns in keep, n_words, n_features and weight of every row. No shuffle; the gains are of fixed size."""
    own = ["n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, found in _blocks(batches, names):
            weight = np.zeros(len(n), np.int64)
            for row, bucket in found:
                weight += np.bincount(row, gain[bucket], minlength=len(n)).astype(np.int64)  # whole numbers below 2^53
            many = sum(np.maximum(n - k + 1, 0) for k in ORDERS)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x) for x in (n, many, weight)], [*keep, *own])

    schema = type(table.schema)([table.schema[c] for c in keep])
    for name in own:
        schema = schema.add(name, "long")
    return table.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list, n: int, name: str) -> DataFrame:
    """rows with their place (from 1) in an order over all of them under the given name, null beyond the first n. Ranges
    of the order are sorted by themselves; the driver only adds up how many rows each range has."""
    at, tie = fresh("at", rows.columns), fresh("tie", rows.columns)
    rows = rows.withColumn(tie, F.monotonically_increasing_id())
    placed = stored(rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).withColumn(at, F.monotonically_increasing_id()).drop(tie), "ranked")
    part = F.shiftright(F.col(at), 33)  # the number above which monotonically_increasing_id() has the partition
    counts, before, offset = placed.groupBy(part.alias("part")).count().orderBy("part").collect(), 0, []
    for r in counts:
        offset += [F.lit(r.part), F.lit(before)]
        before += r["count"]
    rank = F.create_map(*offset)[part] + F.col(at).bitwiseAND((1 << 33) - 1) + 1 if offset else F.lit(None).cast("long")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns if c != tie], F.when(rank <= n, rank).cast("long").alias(name))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", keep: list[str] | None = None, percent: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """Draws documents without replacement by the importance of their n-grams for the target's distribution.

    Returns the columns named in keep (by default all but the text), n_words, n_features, weight, score and rank, all
    long. weight: the sum of the gains of a text's n-grams of 1 to 3 words, repeats counted. score: weight and Gumbel
    noise from a hash of seed and id. Of the N rows with at least least_words words the floor(percent * N / 100) highest
    scores are drawn and ranked from 1, ties to smaller ids; others have no rank.

    A null or empty text has no words, so weight 0; a null id counts as an empty one. Repeated rows are rows of their
    own. Very long texts are split and counted in blocks. Input columns with the names of results give way. Words: runs
    of digits, letters a-z (A-Z lowered) and all characters beyond ASCII.

    Each text is read and scanned once, into a stored table of about five bytes a word; counts and weights come from
    that table. Only counts of the fixed number of buckets are sent to the driver and to the tasks.
    """
    own = ["n_words", "n_features", "weight", "score", "rank"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text]
    carried = [*keep, *([] if doc_id in keep else [doc_id])]
    names = [fresh(c, carried) for c in ("prefix_n", "prefix_crc", "prefix_length")]
    table = stored(prefix_table(docs, text, carried, names), "prefixes")
    gain = gains(bucket_counts(table, names), bucket_counts(prefix_table(target, target_text, [], names), names))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighted(table, carried, names, gain).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(able, [F.desc("score"), F.col(f"`{doc_id}`"), "weight", "n_features"], able.count() * percent // 100, "rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*[F.col(f"`{c}`") for c in keep], *own)
