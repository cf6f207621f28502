"""Exchanges of packed records: what a chunk of rows has for a bucket of keys travels as one row of bytes.

A key's bucket is taken from its upper bits, so the buckets are of even size whatever the number of keys; what stands in
one row are NumPy records of one kind. Rows of a bucket meet in one task and are read in the order of their kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "bucket int, kind int, data binary"
Rows = Iterator[tuple[int, int, bytes]]
#: Bytes of rows after which a batch goes to Spark.
BYTES = 4 << 20


def buckets_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spread(kind: int, key: np.ndarray, records: np.ndarray, buckets: int, head: bytes = b"") -> Rows:
    """A row for every bucket that has records; head goes before each row's records."""
    if not len(key):
        return
    bucket = buckets_of(key, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # short ones by radix
    bucket, records = bucket[order], records[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        yield int(bucket[a]), kind, head + records[a:b].tobytes()


def batches_of(rows: Rows, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most size rows, which end once they hold BYTES."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += len(row[2])
        if len(held) == size or total >= BYTES:
            yield _batch(held)
            held, total = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "data"])


def exchange(packed: DataFrame, buckets: int, use: Callable[[Rows], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the rows of each bucket together; use() gets them, by kind, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Rows:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()

        rows, nxt = each(), None
        nxt = next(rows, None)
        while nxt is not None:
            bucket = nxt[0]

            def own() -> Rows:
                nonlocal nxt
                while nxt is not None and nxt[0] == bucket:  # noqa: B023
                    yield nxt
                    nxt = next(rows, None)

            mine = own()
            yield from use(mine)
            for _ in mine:  # what use() left
                pass

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def by_kind(rows: Rows, kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All records of a bucket by kind; for buckets whose size is bounded."""
    parts: dict[int, list[bytes]] = {k: [] for k in kinds}
    for _, kind, data in rows:
        parts[kind].append(data)
    return joined(parts, kinds)


def joined(parts: dict[int, list[bytes]], kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """The records of each kind; its parts are let go as soon as they are one."""
    return {k: np.frombuffer(b"".join(parts.pop(k)), kinds[k]) for k in kinds}


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of the first of each key, and the sums of the values by key (in the keys' order)."""
    order = np.argsort(key)
    new = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    return order[new], *[np.add.reduceat(v[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64) for v in values]
