"""An interpolated modified Kneser-Ney model of word n-grams (order 3) of trusted text, held out by folds.

Every document belongs to a fold, by its text. Documents of a fold are scored by that fold's model, trained on the trusted
documents of the other one, so no text is scored by a model that has seen it. Words are hashed to 64 bits together with
their model's number, n-grams are hashes of hashes.

Trigrams are counted after their contexts; lower orders count different words before. N-grams of two and three words with
counts below `least_count` are cut off: their whole count goes to the lower order (a discount of 1), which keeps the model
a proper one; 1 cuts nothing, 2 those with a count of one. Unknown words share what the lowest order spares, uniformly over the vocabulary and one more.

As a text's n-gram without a count has the probability (what its context spares) * (that of the shorter n-gram), the
logarithms of a text's words add up from values that hang on one n-gram each: of a word, log P(word) and what it spares as
a context; of two words what their count adds to that, and what they spare; of three what their count adds. So scoring is
one join of all texts' n-grams, of all orders, with one table, summed up by text.

All n-grams of all texts are joined, in waves of texts, each a job of its own, so that a text is read and hashed once: its
n-grams travel packed, those of a run of texts sorted, each different one once with the texts that hold it, to the bucket of
their key, where the model's part of the bucket waits; only sums by text come back. Keys in a bucket are compared whole. An
n-gram that is in all texts comes once a run; no task holds more than a row of a bucket and the model's part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored
from .packed import PACKED, Rows, batches_of, buckets_of, by_kind, exchange, joined, spread, summed
from .shingle_sets import M1, P, finish, pieces, word_hashes

FOLDS = 2
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: N-grams of a bucket in training and of the model, and n-grams of texts in a wave's bucket, about.
KEYS, MODEL_KEYS, QUERIES = 1_000_000, 1_000_000, 1_000_000
#: Waves in which trusted text is counted, by keys, and in which texts are scored, by texts.
TRAIN_WAVES, SCORE_WAVES = 5, 7
#: Marks the first text of a key; rows of a run stay below it.
FIRST = np.uint16(1 << 15)
#: Records that a task gathers before it deals them out.
GATHER = 500_000
TRI = np.dtype([("a", "u8"), ("b", "u8"), ("c", "u8"), ("n", "u4")])
CONTEXT = np.dtype([("key", "u8"), ("total", "u8"), ("n1", "u4"), ("n2", "u4"), ("n3", "u4")])
PAIR = np.dtype([("b", "u8"), ("c", "u8"), ("n", "u4")])
WORD = np.dtype([("w", "u8"), ("types", "u4")])
COUNTS = np.dtype([("n", "u4"), ("of", "u8")])
COUNTED = "kind int, key long, low long, b long, c long, n long, total long, n1 long, n2 long, n3 long"
COUNTED_ROWS = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in COUNTED.split(", ")])
#: Kind of packed rows that hold finished rows of COUNTED.
DONE = 9


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    return finish(a * P + b)


def wave_of(key: np.ndarray, waves: int) -> np.ndarray:
    return (key & np.uint64(255)) * np.uint64(waves) >> np.uint64(8)


def sequences(column: pa.Array, model: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, words, text: of runs of rows all words in order, with two start marks and an end mark about each
    text, hashed with the text's model number, which is a hash's lowest bits too, and the place of each one's text in the run."""
    for lo, hi, data, offsets in pieces(column):
        w, n = word_hashes(data, offsets)
        end = np.cumsum(n + 3)
        x = np.full(int(end[-1]), START)
        x[end - 1] = END
        word = np.ones(len(x), bool)
        word[end - 1] = word[end - n - 3] = word[end - n - 2] = False
        x[word] = w
        text = np.repeat(np.arange(hi - lo), n + 3)
        m = model[lo:hi][text].astype(np.uint64)
        x = finish(x + M1 * (m + np.uint64(1)))
        yield lo, hi, (x - x % np.uint64(FOLDS)) + m, text


def chained(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all pairs and of all triples of words next to each other."""
    two = pair(x[:-1], x[1:])
    return two, pair(two[:-1], x[2:])


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _bucket_of(rows: Rows) -> tuple[int, Rows]:
    """The bucket that rows belong to, and the rows."""
    head = next(rows)
    return head[0], chain([head], rows)


def _distinct_tri(batches: Iterator[pa.RecordBatch], wave: int, waves: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and records of the different trigrams of each run of trusted texts, with their counts, whose middle word
    is in the wave."""
    for batch in _runs(batches):
        m = 1 - batch.column("fold").to_numpy()
        for _, _, x, text in sequences(batch.column("__text"), m):
            _, three = chained(x)
            own = np.flatnonzero((text[2:] == text[:-2]) & (wave_of(x[1:-1], waves) == wave))
            at, n = summed(three[own], np.ones(len(own), np.int64))
            at = own[at]
            out = np.empty(len(at), TRI)
            out["a"], out["b"], out["c"], out["n"] = x[at], x[at + 1], x[at + 2], n
            yield three[at], out


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], kind: int, buckets: int) -> Rows:
    """Deals out keys and their records, GATHER at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for key, records in parts:
        held.append((key, records))
        total += len(key)
        if total >= GATHER:
            yield from spread(kind, *map(np.concatenate, zip(*held, strict=True)), buckets)
            held, total = [], 0
    if held:
        yield from spread(kind, *map(np.concatenate, zip(*held, strict=True)), buckets)


def _merged(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different trigrams with their counts, and the hashes of their first two words and of all."""
    ab = pair(tri["a"], tri["b"])
    abc = pair(ab, tri["c"])
    at, n = summed(abc, tri["n"])
    out = tri[at]
    out["n"] = n
    return out, ab[at], abc[at]


def _stats(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Total and numbers of ones, twos and more, by context."""
    at, *sums = summed(key, n, n == 1, n == 2, n > 2)
    out = np.empty(len(at), CONTEXT)
    out["key"] = key[at]
    for name, v in zip(CONTEXT.names[1:], sums, strict=True):
        out[name] = v
    return out


def _total(parts: np.ndarray) -> np.ndarray:
    at, *sums = summed(parts["key"], *[parts[k] for k in CONTEXT.names[1:]])
    out = parts[at]
    for name, v in zip(CONTEXT.names[1:], sums, strict=True):
        out[name] = v
    return out


def _how_many(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    out = np.zeros(4, COUNTS)
    out["n"], out["of"] = np.arange(1, 5), np.bincount(np.minimum(n, 5), minlength=6)[1:5]
    return out


def _rows(kind: int, of: np.ndarray | None = None, contexts: np.ndarray | None = None, **columns) -> pa.RecordBatch:
    """Rows of COUNTED; contexts, sorted by key, are looked up by `of`."""
    size = len(next(iter(columns.values())))
    columns["kind"] = np.full(size, kind)
    if of is not None:
        found = contexts[np.searchsorted(contexts["key"], of)]
        columns |= {k: found[k] for k in CONTEXT.names[1:]}
    blank = np.zeros(size, np.int64)
    signed = lambda v: v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(columns.get(f.name, blank))).astype(f.type.to_pandas_dtype())) for f in COUNTED_ROWS], schema=COUNTED_ROWS)


def count_ngrams(trusted: DataFrame, wave: int, waves: int, buckets: int, least: int = 2) -> DataFrame:
    """Counts of the trigrams whose middle word is in the wave, and of the pairs that begin with it, from one exchange of texts'
    trigrams. Kind 1: trigrams found `least` times or more (key, low = bc, b, c, n) with their context's stats; kind 3: the
    contexts (key = ab) of those; kind 2: how many trigrams have count n. Pairs bc are counted by the different words before
    them. Kind 11: pairs with a count of `least` or more (key = bc, b, c, n) with b's stats; kind 13: the stats of every b; kind
    14: for every c how many different b go before it (total), in this wave; kind 12: how many pairs have count n."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(_gathered(_distinct_tri(batches, wave, waves), 0, buckets))

    def merge(rows: Rows) -> Iterator[pa.RecordBatch]:
        t, ab, _ = _merged(by_kind(rows, {0: TRI})[0])
        kept, c = np.flatnonzero(t["n"] >= least), _stats(ab, t["n"])
        bc = pair(t["b"], t["c"])
        at, n = summed(bc, np.ones(len(bc), np.int64))
        p = np.empty(len(at), PAIR)
        p["b"], p["c"], p["n"] = t["b"][at], t["c"][at], n

        def out() -> Rows:
            yield from spread(0, c["key"], c, buckets)
            yield from spread(1, ab[kept], t[kept], buckets)
            yield 0, 2, _how_many(t["n"]).tobytes()
            yield from spread(3, bc[at], p, buckets)

        yield from batches_of(out())

    def contexts_and_pairs(rows: Rows) -> Iterator[pa.RecordBatch]:
        bucket, rows = _bucket_of(rows)
        got = by_kind(rows, {0: CONTEXT, 1: TRI, 2: COUNTS, 3: PAIR})
        at, n = summed(pair(got[3]["b"], got[3]["c"]), got[3]["n"])
        p = got[3][at]
        p["n"] = n
        pairs, stats = p[n >= least], _stats(p["b"], n)
        at, types = summed(p["c"], np.ones(len(p), np.int64))
        words = np.empty(len(at), WORD)
        words["w"], words["types"] = p["c"][at], types

        def out() -> Rows:
            yield from spread(0, stats["key"], stats, buckets)
            yield from spread(1, pairs["b"], pairs, buckets)
            yield 0, 2, _how_many(n).tobytes()
            yield from spread(3, words["w"], words, buckets)
            if len(got[2]):
                yield bucket, DONE, _rows(2, n=got[2]["n"], total=got[2]["of"]).serialize().to_pybytes()
            if len(t := got[1]):
                contexts, ab = _total(got[0]), pair(t["a"], t["b"])
                yield bucket, DONE, _rows(1, ab, contexts, key=pair(ab, t["c"]), low=pair(t["b"], t["c"]), b=t["b"], c=t["c"], n=t["n"]).serialize().to_pybytes()
                ab = np.unique(ab)
                yield bucket, DONE, _rows(3, ab, contexts, key=ab).serialize().to_pybytes()

        yield from batches_of(out(), 64)

    def finish_(rows: Rows) -> Iterator[pa.RecordBatch]:
        kinds = {0: CONTEXT, 1: PAIR, 2: COUNTS, 3: WORD}
        parts: dict[int, list[bytes]] = {k: [] for k in kinds}
        for _, kind, data in rows:
            if kind == DONE:
                yield pa.ipc.read_record_batch(pa.py_buffer(data), COUNTED_ROWS)
            else:
                parts[kind].append(data)
        got = joined(parts, kinds)
        if len(got[2]):
            yield _rows(12, n=got[2]["n"], total=got[2]["of"])
        contexts = _total(got[0])
        if len(contexts):
            yield _rows(13, contexts["key"], contexts, key=contexts["key"])
        if len(k := got[1]):
            yield _rows(11, k["b"], contexts, key=pair(k["b"], k["c"]), b=k["b"], c=k["c"], n=k["n"])
        if len(got[3]):
            at, types = summed(got[3]["w"], got[3]["types"])
            yield _rows(14, key=got[3]["w"][at], total=types)

    packed = exchange(trusted.mapInArrow(first, PACKED), buckets, merge, PACKED)
    return exchange(exchange(packed, buckets, contexts_and_pairs, PACKED), buckets, finish_, COUNTED)


def discounts(counts: dict[int, int], cut: bool) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts, in their usual ranges if those are few; with a
    cut-off the first is 1."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    d1, d2, d3 = (min(max(d, 0.05 * k), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))
    return 1.0 if cut else d1, d2, d3


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _discounts(table: DataFrame, cut: bool) -> tuple[float, float, float]:
    return discounts({r.n: r.of for r in table.where("kind = 2").groupBy("n").agg(F.sum("total").alias("of")).collect()}, cut)


def _alpha(d: tuple[float, float, float], n: str = "n", total: str = "total"):
    return (F.col(n) - F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])) / F.col(total)


def _spare(d: tuple[float, float, float], p: str = ""):
    return (d[0] * F.col(f"{p}n1") + d[1] * F.col(f"{p}n2") + d[2] * F.col(f"{p}n3")) / F.col(f"{p}total")


def train(trusted: DataFrame, n_tokens: int, least_count: int = 2) -> tuple[DataFrame, list[float]]:
    """trusted: fold, __text. Returns the model (key, value: what a text's n-gram adds) and each model's logarithm of an
    unknown word's probability, which every word and end mark starts from."""
    if least_count not in (1, 2):
        raise ValueError("least_count is 1 or 2")
    buckets = max(1, -(-n_tokens // (KEYS * TRAIN_WAVES)))
    waves = [stored(count_ngrams(trusted, k, TRAIN_WAVES, buckets, least_count), f"kn-counts-{k}") for k in range(TRAIN_WAVES)]
    three, two = _union(waves).where("kind < 10"), _union(waves).where("kind > 10").withColumn("kind", F.col("kind") - 10)
    d3, d2 = _discounts(three, least_count > 1), _discounts(two, least_count > 1)

    types = stored(two.where("kind = 4").groupBy("key").agg(F.sum("total").alias("n")).withColumn("m", F.pmod("key", F.lit(FOLDS)).cast("int")), "kn-1")
    d1 = discounts({r.n: r.of for r in types.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("of")).collect()}, False)
    whole = types.groupBy("m").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("words"), *[F.count_if(F.col("n") == k if k < 3 else F.col("n") > 2).alias(f"n{k}") for k in (1, 2, 3)])
    unknown = [0.0] * FOLDS
    spared = {r.m: (r.p, r.total) for r in whole.select("m", "total", (_spare(d1) / (F.col("words") + 1)).alias("p")).collect()}
    for m, (p, _) in spared.items():
        unknown[m] = float(np.log(p))
    base = F.element_at(F.lit([float(spared.get(m, (1.0, 1))[0]) for m in range(FOLDS)]), F.col("m") + 1)
    total = F.element_at(F.lit([int(spared.get(m, (1.0, 1))[1]) for m in range(FOLDS)]), F.col("m") + 1)
    p1 = types.withColumn("total", total).select("key", (_alpha(d1) + base).alias("p1"), F.log((_alpha(d1) + base) / base).alias("l1"))
    g2 = two.where("kind = 3").select("key", _spare(d2).alias("g2"))
    words = stored(p1.join(g2, "key", "full"), "kn-words")
    p1, g2 = words.where("p1 is not null").select(F.col("key").alias("c"), "p1"), words.where("g2 is not null").select(F.col("key").alias("b"), "g2")

    pairs = two.where("kind = 1").select(F.col("key").alias("low"), "c", _alpha(d2).alias("a2"), _spare(d2).alias("g2")).join(p1, "c")
    kept = stored(pairs.select("low", "a2", (F.col("g2") * F.col("p1")).alias("less")), "kn-pairs")
    longer = three.where("kind = 1").select("key", "low", "b", "c", _alpha(d3).alias("a3"), _spare(d3).alias("g3"))
    longer = longer.join(kept, "low", "left").join(p1, "c").join(g2, "b")
    p2 = F.coalesce(F.col("a2") + F.col("less"), F.col("g2") * F.col("p1"))
    longer = stored(longer.select("key", F.log1p(F.col("a3") / (F.col("g3") * p2)).alias("value")), "kn-longer")
    model = _union([
        words.select("key", (F.coalesce("l1", F.lit(0.0)) + F.coalesce(F.log("g2"), F.lit(0.0))).alias("value")),
        kept.select(F.col("low").alias("key"), F.log1p(F.col("a2") / F.col("less")).alias("value")),
        three.where("kind = 3").select("key", F.log(_spare(d3)).alias("value")),
        longer,
    ])
    model = stored(model.where("value <> 0").groupBy("key").agg(F.sum("value").cast("float").alias("value")), "kn-model")
    release(*waves, types, words, kept, longer)
    return model, unknown


def _packed_queries(number: int, key: np.ndarray, row: np.ndarray, buckets: int) -> Rows:
    """A row for every bucket: the chunk's number, how many keys, each different key once, in order, and the text rows of each
    key one after another, the first of a key marked by its highest bit."""
    if not len(key):
        return
    order = np.argsort(key)
    key, row = key[order], row[order].astype(np.uint16)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    row[new] |= FIRST
    key = key[new]
    bucket = buckets_of(key, buckets)  # they rise with the keys
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
        rows = row[new[a] : new[b] if b < len(key) else len(row)]
        yield int(bucket[a]), 2, np.int64(number).tobytes() + np.int64(b - a).tobytes() + key[a:b].tobytes() + rows.tobytes()


def score_texts(texts: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """texts: th, fold, __text; model: key, value. Returns of every row th, value (the sum of its n-grams' values), n_tokens
    (words and the end mark) and n_different (trigrams)."""
    known = np.dtype([("key", "u8"), ("value", "f4")])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                key = batch.column("key").to_numpy().view(np.uint64)
                out = np.empty(len(key), known)
                out["key"], out["value"] = key, batch.column("value").to_numpy()
                yield key, out

        yield from batches_of(_gathered(parts(), 0, buckets))

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Rows:
            number = TaskContext.get().partitionId() << 32
            for batch in _runs(batches):
                fold, th = batch.column("fold").to_numpy(), batch.column("th").to_numpy()
                for lo, hi, x, text in sequences(batch.column("__text"), fold):
                    two, three = chained(x)
                    # a word with its text's first mark before it, pairs and triples within a text; they end in the same place
                    inside = np.flatnonzero(text[1:] == text[:-1])
                    whole = np.flatnonzero(text[2:] == text[:-2])
                    three, of = three[whole], text[2:][whole]
                    at, _ = summed(pair(three, of.astype(np.uint64)), of)
                    row = text[1:][inside]
                    yield from _packed_queries(number, np.concatenate([x[1:][inside], two[inside], three]), np.concatenate([row, row, of]), buckets)
                    about = [th[lo:hi], np.bincount(of, minlength=hi - lo), np.bincount(of[at], minlength=hi - lo)]
                    yield number % buckets, 1, np.int64(number).tobytes() + np.concatenate(about).astype(np.int64).tobytes()
                    number += 1

        yield from batches_of(rows(), 64)

    def look_up(rows: Rows) -> Iterator[pa.RecordBatch]:
        def out() -> Rows:
            parts: list[bytes] | None = []
            key = value = np.zeros(0)
            for _, kind, data in rows:
                if kind == 0:
                    parts.append(data)
                elif kind == 1:
                    yield 0, 0, data
                else:
                    if parts is not None:
                        mine = np.frombuffer(b"".join(parts), known)
                        order = np.argsort(mine["key"], kind="stable")
                        key, value, parts = mine["key"][order], mine["value"][order], None
                    if len(key):
                        n = int(np.frombuffer(data, np.int64, 1, 8)[0])
                        mine, row = np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.uint16, offset=16 + 8 * n)
                        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                        hit = key[at] == mine
                        of = np.cumsum(row >= FIRST) - 1
                        own = np.flatnonzero(hit[of])
                        yield 0, 1, data[:8] + np.bincount(row[own] & ~FIRST, value[at[of[own]]]).astype("f4").tobytes()

        for batch in batches_of(out()):
            chunk = [x.as_py()[:8] for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(chunk), np.int64)), batch.column("kind"), batch.column("data")], ["chunk", "kind", "data"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, total = np.zeros((3, 0), np.int64), np.zeros(0)

        def done() -> Iterator[pa.RecordBatch]:
            if len(total):
                yield pa.RecordBatch.from_arrays([pa.array(about[0]), pa.array(total), pa.array(about[1]), pa.array(about[2])], ["th", "value", "n_tokens", "n_different"])

        for batch in batches:  # sorted by chunk, its texts first
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                if kind == 0:
                    yield from done()
                    about = np.frombuffer(data.as_py(), np.int64, offset=8).reshape(3, -1)
                    total = np.zeros(about.shape[1])
                else:
                    part = np.frombuffer(data.as_py(), "f4", offset=8)
                    total[: len(part)] += part
        yield from done()

    packed = model.mapInArrow(table, PACKED).unionByName(texts.select("th", "fold", "__text").mapInArrow(queries, PACKED))
    sums = exchange(packed, buckets, look_up, "chunk long, kind int, data binary")
    return sums.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(add_up, "th long, value double, n_tokens long, n_different long")


def about_tokens(texts: DataFrame) -> int:
    """About how many words and end marks all texts hold, six bytes each; it only sets how many buckets there are."""
    return int(texts.agg(F.sum(F.octet_length("__text") / 6 + 2)).first()[0] or 0)


def word_log_likelihood(texts: DataFrame, trusted: DataFrame, least_count: int = 2) -> DataFrame:
    """texts: deal (any whole number, by which texts are dealt out to waves), th (hash of the text), fold, __text; trusted:
    fold, __text. Per th: n_tokens, n_different (trigrams) and log_p (natural). The same text in several rows has one row."""
    n_tokens = about_tokens(texts)
    model, unknown = train(trusted, n_tokens, least_count)
    buckets = max(1, -(-3 * n_tokens // (QUERIES * SCORE_WAVES)), -(-model.count() // MODEL_KEYS))
    own = F.pmod("deal", F.lit(SCORE_WAVES))
    same = ["n_tokens", "n_different", "value"]  # in all rows of a text
    waves = [stored(score_texts(texts.where(own == k), model, buckets).groupBy("th").agg(*[F.max(c).alias(c) for c in same]), f"kn-score-{k}") for k in range(SCORE_WAVES)]
    scores = _union(waves).groupBy("th").agg(*[F.max(c).alias(c) for c in same])
    start = F.element_at(F.lit(unknown), (F.pmod("th", F.lit(FOLDS)) + 1).cast("int"))
    return scores.select("th", "n_tokens", "n_different", (F.col("n_tokens") * start + F.col("value")).alias("log_p"))
