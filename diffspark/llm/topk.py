"""Exact top-k search by pivot-table elimination.

The index keeps, with every vector, its distances to many pivots. For a query q and a vector v the largest
|d(q,p) - d(v,p)| over the pivots p is a lower bound of d(q,v), hence (|q|^2 + |v|^2 - bound^2) / 2 an upper bound of
their inner product. Candidates are evaluated in the order of that bound, until no bound left reaches the k-th best
score: results are exact.

Vectors are whole numbers, floor(256 * x), kept in units of 1/256, so that none is too large for a double. Scores are
exact; one beyond a long's range counts as the long nearest to it, in the order too. Vectors that are null or hold null or non-finite components take no part;
only vectors of the same dimension are compared; empty vectors take none. Repeated rows are candidates each; queries
that agree in id and vector are one query; a query's own rows (same id) are not its candidates. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows in a packed block, of vectors and of queries: what is in memory at a time.
BLOCK = 4096
#: Bytes of query blocks that one pass sends to every executor.
PASS_BYTES = 64 << 20
STEP = 512
#: Relative error of a distance, against the norms of both ends.
SLACK = 1e-6
#: Whole numbers to 1 of an index's vectors.
UNIT = 256


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id long, v array<double> of multiples of 1/256, of the rows that take part."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c) < 2.0**52, _floor(c * UNIT) / UNIT).otherwise(c)).alias("v"))


def _floor(c):
    """Floor that stays a double (values may lie beyond a long)."""
    part = c % 1
    return F.when(part < 0, c - part - 1).otherwise(c - part)


def choose_pivots(rows: DataFrame, n_pivots: int, sample: int) -> dict[int, np.ndarray]:
    """For each dimension found, pivots far from each other, from a bounded sample of rows (the first by hash)."""
    picked = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).collect()
    out: dict[int, np.ndarray] = {}
    for dim in {len(r.v) for r in picked}:
        x = np.array([r.v for r in picked if len(r.v) == dim])
        chosen, d = [0], np.full(len(x), np.inf)
        while len(chosen) < min(n_pivots, len(x)):
            d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
            chosen.append(int(d.argmax()))
        out[dim] = x[chosen]
    return out


PACKED = "dim int, n int, ids binary, v binary, pivot_d binary"


def pack(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The index: blocks of vectors of one dimension with their distances to the pivots. No shuffle."""
    names = ["dim", "n", "ids", "v", "pivot_d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(dims).tolist():
                member = np.flatnonzero(dims == dim)
                for lo in range(0, len(member), BLOCK):
                    at = member[lo : lo + BLOCK]
                    v = flat[starts[at][:, None] + np.arange(dim)]
                    p = pivots.get(dim, v[:1] * 0)
                    with np.errstate(over="ignore", invalid="ignore"):  # distances beyond doubles bound nothing
                        d = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (p * p).sum(1) - 2 * v @ p.T, 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x]) for x in (np.int32(dim), np.int32(len(at)), vec_id[at].tobytes(), v.tobytes(), d.tobytes())], names
                    )

    return rows.mapInArrow(run, PACKED)


def _whole(x: float, unit: int) -> int:
    """unit * x, a whole number."""
    return int(x) * unit if abs(x) >= 2.0**53 else int(x * unit)


def _scores(v: np.ndarray, q: np.ndarray, unit: int = 1) -> np.ndarray:
    """Exact inner products of unit * v and unit * q; of rows beyond what doubles hold exactly by Python's integers, held to
    a long's range."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain = np.abs(v).max(1, initial=0) * np.abs(q).max(initial=0) < 2.0**53 / (unit * unit * len(q))
    out = np.zeros(len(v), np.int64)
    out[plain] = (v[plain] @ q * (unit * unit)).astype(np.int64)
    if not plain.all():
        whole = [_whole(b, unit) for b in q.tolist()]
        for k in np.flatnonzero(~plain).tolist():
            score = sum(_whole(a, unit) * b for a, b in zip(v[k].tolist(), whole, strict=True))
            out[k] = max(-(2**63), min(2**63 - 1, score))
    return out


class Best:
    """The k best (score, id) of each query of a block so far, and the search of one more block of vectors."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, d: np.ndarray, k: int, unit: int = 1):
        self.ids, self.q, self.d, self.k, self.unit = ids, q, d, k, unit
        with np.errstate(over="ignore"):
            self.norm = (q * q).sum(1)
        self.top: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.seen = self.evaluated = 0  # candidates met, and those whose score was worked out

    def search(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            norm = (v * v).sum(1)
            least, most = d * (1 - SLACK), d * (1 + SLACK)
        for n, (qid, q) in enumerate(zip(self.ids.tolist(), self.q, strict=True)):
            with np.errstate(over="ignore", invalid="ignore"):
                low = np.maximum((least - self.d[n] * (1 + SLACK)).max(1), (self.d[n] * (1 - SLACK) - most).max(1))
                low = np.maximum(low - 2 * SLACK * (np.sqrt(norm) + np.sqrt(self.norm[n])), 0)
                high = ((norm + self.norm[n] - low * low) / 2 + SLACK * (norm + self.norm[n])) * self.unit**2 + 1
            high[~np.isfinite(high)] = np.inf
            top = self.top[n]
            floor = top[-1][0] if len(top) == self.k else None
            self.seen += len(ids)
            left = np.flatnonzero((ids != qid) if floor is None else (ids != qid) & (high >= floor))
            order = left[np.argsort(-high[left], kind="stable")]
            for lo in range(0, len(order), STEP):
                at = order[lo : lo + STEP]
                if len(top) == self.k and high[at[0]] < top[-1][0]:
                    break
                score = _scores(v[at], q, self.unit)
                self.evaluated += len(at)
                if len(at) > self.k:  # what can't be among the k best of this step, ties kept
                    keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                    at, score = at[keep], score[keep]
                new = [(s, i) for s, i in zip(score.tolist(), ids[at].tolist(), strict=True) if len(top) < self.k or s >= top[-1][0]]
                if new:
                    top[:] = sorted([*top, *new], key=lambda x: (-x[0], x[1]))[: self.k]


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, *, vec_id: str = "vec_id", embedding: str = "embedding", n_pivots: int = 16, sample: int = 2048
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to smaller ids.

    vectors and queries have the same columns. The pivots come from a sample of at most `sample` rows; every row is
    indexed. Query blocks are sent to the executors in passes of at most PASS_BYTES, each pass reads the index once and
    shuffles only each task's k best per query.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, embedding)
    pivots = choose_pivots(rows, n_pivots, sample)
    index = pack(rows, pivots)
    asked = pack(quantised(queries, vec_id, embedding).dropDuplicates(), pivots)
    asked = stored(asked.withColumn("qb", F.monotonically_increasing_id()), "query-blocks")
    blocks = asked.select("qb", "dim", (F.length("v") + F.length("pivot_d")).alias("bytes")).collect()  # one small row per block
    passes: list[list] = [[]]
    for b in blocks:
        if sum(x.bytes for x in passes[-1]) + b.bytes > PASS_BYTES:
            passes.append([])
        passes[-1].append(b)
    if len(passes) > 1:
        index = stored(index, "index")
    found = [_one_pass(index, asked, p, k) for p in passes if p]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    place = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(index: DataFrame, asked: DataFrame, blocks: list, k: int) -> DataFrame:
    """The k best of each task for each query of the blocks; query_no tells apart queries that share an id."""
    ids = [b.qb for b in blocks]
    right = asked.where(F.col("qb").isin(ids)).select("qb", *[F.col(c).alias(f"q_{c}") for c in ("ids", "v", "pivot_d")])
    by_dim = F.create_map(*[x for d in {b.dim for b in blocks} for x in (F.lit(d), F.array(*[F.lit(b.qb) for b in blocks if b.dim == d]))])
    pairs = index.withColumn("qb", F.explode(F.try_element_at(by_dim, F.col("dim")))).join(F.broadcast(right), "qb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["qb"] not in best:
                    q = np.frombuffer(r["q_v"]).reshape(-1, r["dim"])
                    best[r["qb"]] = Best(np.frombuffer(r["q_ids"], np.int64), q, np.frombuffer(r["q_pivot_d"]).reshape(len(q), -1), k, UNIT)
                v = np.frombuffer(r["v"]).reshape(-1, r["dim"])
                best[r["qb"]].search(np.frombuffer(r["ids"], np.int64), v, np.frombuffer(r["pivot_d"]).reshape(len(v), -1))
        for qb, b in best.items():
            out = [(f"{qb}/{n}", int(q), i, s) for n, (q, top) in enumerate(zip(b.ids, b.top, strict=True)) for s, i in top]
            if out:
                no, q, i, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"query_no": list(no), "query_id": list(q), "vec_id": list(i), "score": list(s)})

    return pairs.select("qb", "dim", "ids", "v", "pivot_d", "q_ids", "q_v", "q_pivot_d").mapInArrow(run, "query_no string, query_id long, vec_id long, score long")
