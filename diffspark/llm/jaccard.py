"""N-gram Jaccard join as a join in metric space: pivots, Voronoi regions, triangle windows, recursion; exact.

Jaccard distance is a metric, but texts without a common shingle all lie at distance 1, and no pivot's window separates
them. So texts are first brought to their neighbourhoods by what they share, and metric space begins there:

1. A text can have a partner only if most of its lowest shingles, by hash, are found in other texts too: at most
   A = n - ceil(n * percent / 100) of them may be missing from the partner, so of the first 2A + 1 at least A + 1 are
   shared. Texts without are done (nearly all, unless copies abound). Counts are exact, over all texts.
2. Of the others, rarest shingles first, each of the first A + 1 is a neighbourhood that any partner is part of.
   Neighbourhoods with the same texts are one.
3. A neighbourhood of bounded size is joined in one task (regions.py): pivots from its texts, balls of one class, Voronoi
   cells with all texts in the window of twice the reach about their borders, recursively; where windows leave no cell
   smaller, pairs are compared that the pivots' distances don't rule out. Larger ones are split in the same way by
   Spark first, over all executors; those that windows don't split go on in pairs of blocks.
4. Links join classes by rounds of joins.

Shingles are 64-bit hashes of five words (of the whole sequence where there are fewer); texts with equal sets are one
class under a 128-bit digest. A null or empty text has no shingles and no links. Null ids are carried along; repeated
ids are told apart by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, small, stored
from .components import components
from .regions import SLACK, Region
from .shingle_sets import digests, shingle_sets

#: Shingles of texts that are looked at together before the shuffle, and of a bucket after it.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: Shingles of all texts of a region that one task joins; larger regions are split, by so many pivots each time.
BOUND, PIVOTS = 2_000_000, 16


def _spare(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's n shingles a partner may lack."""
    return n + (-n * percent // 100)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def describe(texts: DataFrame, width: int) -> DataFrame:
    """texts: doc_id, th, __text. Returns doc_id, th, c, the digest of the text's set, key, its first half (null if the set
    is empty), and n, its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = shingle_sets(batch.column("__text"), width)
            c = digests(flat, n)
            key = np.zeros(len(n), np.int64)
            key[n > 0] = _key(c)
            columns = [batch.column(0), batch.column(1), pa.array(c, pa.binary()), pa.array(key, mask=n == 0), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "c", "key", "n"])

    return texts.select("doc_id", "th", "__text").mapInArrow(run, "doc_id long, th long, c binary, key long, n long")


def _key(digest: list[bytes | None]) -> np.ndarray:
    """The first half of each digest."""
    return np.frombuffer(b"".join([x[:8] for x in digest if x is not None]), np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, n, shingles of runs of different sets that hold about CHUNK shingles."""
    held: dict[int, np.ndarray] = {}
    total = 0
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            flat, n = shingle_sets(whole.column("__text").slice(lo, 512), width)
            some = n[n > 0]
            for k, a, b in zip(_key(digests(flat, some)).tolist(), _starts(some).tolist(), np.cumsum(some).tolist(), strict=True):
                if k not in held:
                    held[k] = flat[a:b]
                    total += b - a
            if total >= CHUNK or len(held) > 50_000:
                yield np.array(list(held), np.int64), np.array([len(x) for x in held.values()]), np.concatenate(list(held.values()))
                held, total = {}, 0
    if held:
        yield np.array(list(held), np.int64), np.array([len(x) for x in held.values()]), np.concatenate(list(held.values()))


def shared_counts(texts: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """key, k: how many of a set's first 2A + 1 shingles other sets have among theirs, or more where a set is found in
    several chunks. Sets without any have no row.

    In a chunk, sets that share a shingle know; one of them goes on for all. The others meet in buckets of the hash, a
    chunk's part of a bucket in one row: the low halves of the shingles, the place of each one's set among the keys.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, flat in _chunks(batches, width):
            owner = np.repeat(np.arange(len(n)), n)
            first = np.arange(len(flat)) - np.repeat(_starts(n), n) < np.repeat(2 * _spare(n, percent) + 1, n)
            s, owner = flat[first], owner[first]
            order = np.argsort(s)
            s, owner = s[order], owner[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            known = np.bincount(owner[several], minlength=len(n))
            s, owner, several = s[new], owner[new], several[new]
            bucket = ((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(s)], strict=True):
                present, place = np.unique(owner[a:b], return_inverse=True)
                yield _row(int(bucket[a]), key[present], s[a:b].astype(np.uint32), place.astype(np.uint16), np.packbits(several[a:b]), np.zeros(0, np.int32))
            at = np.flatnonzero(known)
            yield _row(int(at[0]) % buckets if len(at) else 0, key[at], np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.uint8), known[at].astype(np.int32))

    names = ["bucket", "keys", "s", "place", "several", "known"]

    def _row(bucket: int, *arrays: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names)

    def meet(rows: list[dict]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(r["keys"], np.int64)[np.frombuffer(r["place"], np.uint16)] for r in rows])
        s = np.concatenate([np.frombuffer(r["s"], np.uint32) for r in rows])
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(r["s"]) // 4) for r in rows]).astype(bool)
        order = np.argsort(s, kind="stable")
        key, s, several = key[order], s[order], several[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        shared = np.zeros(int(new.sum()), bool)
        shared[group[several | (key != key[new][group])]] = True
        keys, k = np.unique(key[shared[group] & ~several], return_counts=True)
        told = [np.frombuffer(r["keys"], np.int64) for r in rows if r["known"]]
        known = [np.frombuffer(r["known"], np.int32) for r in rows if r["known"]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, *told])), pa.array(np.concatenate([k.astype(np.int64), *known]))], ["key", "k"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["bucket"] != rows[0]["bucket"]:
                    yield meet(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield meet(rows)

    dealt = texts.select("__text").mapInArrow(scatter, "bucket int, keys binary, s binary, place binary, several binary, known binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "key long, k long").groupBy("key").agg(F.sum("k").alias("k"))


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """texts: c, __text. Returns v, a number, c, n and the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                flat, n = shingle_sets(batch.column("__text"), width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(n), lists], ["c", "n", "shingles"])

    return texts.select("c", "__text").mapInArrow(run, "c binary, n long, shingles array<long>").select(F.monotonically_increasing_id().alias("v"), "*")


def neighbourhoods(sets: DataFrame, percent: int) -> DataFrame:
    """s, v, size, pos: the sets that meet at shingle s, of all s with two sets at least; of several s with the same sets
    the first in order. A set goes to its A + 1 rarest shingles, of which s is number pos, from 0; those that no other set
    has come first, without a row.
    """
    each = sets.select("v", "n", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    n = F.col("n")
    places = n + F.floor(-n * percent / 100).cast("long") + 1 - (n - F.size("near"))
    rows = each.join(counts, "s").groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("near")).where(places > 0)
    rows = rows.select("v", (n - F.size("near")).alias("alone"), F.posexplode(F.slice("near", F.lit(1), places.cast("int"))).alias("at", "x"))
    members = stored(rows.select("v", F.col("x.s").alias("s"), F.col("x.k").alias("k"), (F.col("alone") + F.col("at")).alias("pos")), "jaccard-members")
    alike = members.groupBy("s").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64(F.lit(k), "v")).alias(f"x{k}") for k in (0, 1)])
    one = alike.where("size > 1").groupBy("size", "x0", "x1").agg(F.min(F.struct("k", "s")).alias("first")).select(F.col("first.s").alias("s"), "size")
    return members.join(small(stored(one, "jaccard-unlike")), "s").select("s", "v", "size", "pos")


def join_regions(rows: DataFrame, percent: int) -> DataFrame:
    """rows: s, v, label, shingles, regions of bounded size. Returns a, b: links that join all linked classes of a region."""

    def region(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len({r[1] for r in rows}) > 1:
            ids = [r[0] for r in rows]
            for i, j in Region([r[2] for r in rows], [r[1] for r in rows], percent).links():
                yield ids[i], ids[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, {}, []
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                s, v, label = (batch.column(k).to_pylist() for k in range(3))
                lists = batch.column("shingles")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for k in range(len(s)):
                    if s[k] != at:
                        out += region(list(held.values()))
                        at, held = s[k], {}
                    held[v[k]] = v[k], label[k], flat[ends[k] : ends[k + 1]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                    out = []
        out += region(list(held.values()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return rows.select("s", "v", "label", "shingles").repartition("s").sortWithinPartitions("s").mapInArrow(run, "a long, b long")


def split_regions(members: DataFrame, sets: DataFrame, level: int, percent: int) -> DataFrame:
    """members: s, v, of regions too large for a task. Returns s (of the cell), parent, v, p (the cell's pivot), linked:
    a row for every cell that a set lies in or whose border it may be linked across. Pivots are told to a region's rows."""
    salt = F.pmod(F.xxhash64("v", F.lit(level)), F.lit(PIVOTS))
    chosen = members.groupBy("s", salt.alias("salt")).agg(F.min("v").alias("v")).join(sets.select("v", "shingles"), "v")
    chosen = stored(chosen.groupBy("s").agg(F.collect_list(F.struct(F.col("v").alias("p"), F.col("shingles").alias("set"))).alias("pivots")), "jaccard-pivots")
    rows = members.join(sets.select("v", "shingles"), "v").join(small(chosen, 1000), "s")
    reach = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                out = []
                for r in whole.slice(lo, 64).to_pylist():
                    x = np.array(r["shingles"])
                    both = np.array([np.isin(x, p["set"], assume_unique=True).sum() for p in r["pivots"]])
                    union = len(x) + np.array([len(p["set"]) for p in r["pivots"]]) - both
                    d = 1 - both / union
                    for k in np.flatnonzero(d <= d.min() + 2 * reach + SLACK).tolist():
                        out.append((r["s"], r["v"], r["pivots"][k]["p"], bool(100 * both[k] >= percent * union[k])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["parent", "v", "p", "linked"])

    cells = rows.select("s", "v", "shingles", "pivots").mapInArrow(run, "parent long, v long, p long, linked boolean")
    return cells.select(F.xxhash64("parent", "p").alias("s"), "*")


def size_windows(rows: DataFrame, percent: int) -> DataFrame:
    """rows: s, v, label, n. Cells of each region by size, which is a distance from the empty text's side: partners' sizes
    differ by a factor of 100 / percent at most, so they lie in the same band of that width or in two next to each other.
    Returns s (of the cell), v, label, home: every set in its own band's cell, and in the window of the next one."""
    band = F.floor(F.log("n") / F.lit(np.log(100 / percent) * (1 + 1e-6)))
    each = rows.select("s", "v", "label", band.alias("band"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    return each.select(F.xxhash64("s", F.col("band") + F.col("up")).alias("s"), "v", "label", (F.col("up") == 0).alias("home"))


def _may_link(rows: DataFrame, percent: int) -> DataFrame:
    """rows: s, v, label, n, pos. Without those that can't be linked to a set of another class whose first shingle in common
    s is: with pos shingles before s each, none in common, the union has at least n plus the other's pos, the intersection
    n less the own pos at most. Pairs with an earlier one in common meet there."""
    low = stored(rows.groupBy("s", "label").agg(F.min("pos").alias("p")), "jaccard-first-places")
    best = low.groupBy("s").agg(F.min(F.struct("p", "label")).alias("best"))
    other = low.join(small(best), "s").where(F.col("label") != F.col("best.label")).groupBy("s", "best").agg(F.min("p").alias("p2"))
    both = rows.join(small(stored(other, "jaccard-others")), "s")
    least = F.when(F.col("label") == F.col("best.label"), F.col("p2")).otherwise(F.col("best.p"))
    return both.where(100 * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + least)).select(*rows.columns)


def find_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: s, v, size, pos. Returns a, b: links of all regions that join whatever is linked.

    Regions overlap, so those come first that are the largest one of any of their sets; of the others only those that
    still hold several classes are joined.
    """
    sizes = sets.select("v", "n")
    members = stored(members.join(sizes, "v"), "jaccard-regions")
    total = stored(members.groupBy("s").agg(F.sum("n").alias("total")).where(F.col("total") > BOUND), "jaccard-large")
    fits = members.join(small(total), "s", "left_anti")
    first = stored(fits.groupBy("v").agg(F.max(F.struct("size", "s")).alias("k")).select(F.col("k.s").alias("s")).distinct(), "jaccard-first")
    links = stored(join_regions(fits.join(small(first), "s", "left_semi").select("s", "v", F.col("v").alias("label")).join(sets.select("v", "shingles"), "v"), percent), "jaccard-links")
    fits, level = fits.join(small(first), "s", "left_anti").select("s", "v", F.col("v").alias("label"), "pos"), 0
    large = members.join(small(total), "s") if not total.isEmpty() else None
    while large is not None:
        cells = stored(split_regions(large.select("s", "v"), sets, level, percent), "jaccard-cells")
        new = cells.where("linked and v <> p").select(F.col("v").alias("a"), F.col("p").alias("b"))
        links = links.unionByName(new)
        labels = stored(components(links).select("v", F.col("c").alias("known")), "jaccard-labels")
        rows = cells.join(labels, "v", "left").join(sizes, "v").select("s", "parent", "v", "n", F.coalesce("known", "v").alias("label"))
        of = rows.groupBy("s", "parent").agg(F.sum("n").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        of = stored(of.join(large.groupBy(F.col("s").alias("parent")).agg(F.max("total").alias("total")), "parent"), "jaccard-cell-sizes").drop("parent", "l0", "l1")
        rows = stored(rows.select("s", "v", "n", "label").join(small(of), "s"), "jaccard-cells")
        fits = fits.unionByName(rows.where(F.col("size") <= BOUND).select("s", "v", "label", F.lit(0).cast("long").alias("pos")))
        # what windows leave nearly whole is compared by pairs of blocks, each of bounded size
        blocks = F.ceil(2 * F.col("size") / BOUND).cast("int")
        own = F.pmod(F.xxhash64("v"), blocks).cast("int")
        whole = rows.where((F.col("size") > BOUND) & (F.col("size") > 0.8 * F.col("total"))).select("s", "v", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        fits = fits.unionByName(whole.select(F.xxhash64("s", F.least("own", "other"), F.greatest("own", "other")).alias("s"), "v", "label", F.lit(0).cast("long").alias("pos")))
        rest = rows.where((F.col("size") > BOUND) & (F.col("size") <= 0.8 * F.col("total")))
        large = None if rest.isEmpty() else rest.select("s", "v", "n", F.col("size").alias("total"))
        level += 1
    labels = stored(components(links).select("v", F.col("c").alias("known")), "jaccard-labels")
    fits = fits.join(small(labels), "v", "left").join(sizes, "v").select("s", "v", F.coalesce("known", "label").alias("label"), "n", "pos")
    fits = stored(size_windows(_may_link(stored(fits, "jaccard-regions"), percent), percent), "jaccard-regions")
    several = fits.groupBy("s").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("home").alias("home")).where("l0 <> l1 and home").select("s")
    left = fits.join(small(stored(several, "jaccard-several")), "s").join(sets.select("v", "shingles"), "v")
    return links.unionByName(stored(join_regions(left, percent), "jaccard-links"))


def jaccard_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, th (hash of its text), n_shingles, component (a key of its class, null without shingles)
    and component_id, the smallest doc_id reachable by links of Jaccard similarity >= percent / 100."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    source = source.select("doc_id", F.xxhash64("__text").alias("th"), "__text")
    rows = stored(describe(source, width), "jaccard-sets")
    different = rows.where(F.col("c").isNotNull()).groupBy("c").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.min("th").alias("th"))
    spare = F.col("n") + F.floor(-F.col("n") * percent / 100).cast("long")
    total = different.agg(F.sum(2 * spare + 1)).first()[0] or 0
    counts = stored(shared_counts(source, max(1, -(-total // BUCKET)), width, percent), "jaccard-counts")
    involved = stored(different.join(counts, "key").where(F.col("k") > spare).select("th", "c"), "jaccard-near")
    texts = source.select("th", "__text").join(small(involved), "th").groupBy("c").agg(F.first("__text").alias("__text"))
    sets = stored(sets_of(texts, width), "jaccard-involved")
    labels = components(find_links(neighbourhoods(sets, percent), sets, percent)).join(sets.select("v", "c").withColumnRenamed("c", "digest"), "v")
    own = rows.join(labels.select(F.col("digest").alias("c"), F.col("c").alias("label")), "c", "left")
    own = own.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce(F.col("label").cast("string"), F.hex("c")).alias("component"))
    smallest = own.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return own.join(smallest, "component", "left").select("doc_id", "th", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def link_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id per row."""
    return jaccard_groups(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without all but one of each group of linked texts: that with the smallest id stays (null ids
    last; of equal ids that with the smallest text hash; of rows equal in both one). Rows without a word all stay."""
    groups = stored(jaccard_groups(docs, text=text, doc_id=doc_id, **options).where("component is not null"), "jaccard-groups")
    own_id, own_th = (fresh(c, docs.columns) for c in ("__jaccard_id", "__jaccard_th"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    kept = stored(groups.groupBy("component").agg(first.alias("k")).select(F.col("k.doc_id").alias(own_id), F.col("k.th").alias(own_th)), "jaccard-kept")
    words = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(WORD)
    th = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(own_id)) & (th == F.col(own_th))
    stay = docs.where(words).join(kept, same, "left_semi")
    if not groups.groupBy("doc_id", "th").count().where("count > 1").isEmpty():  # repeated rows: one of each
        stay = stay.withColumn(own_th, th).dropDuplicates([doc_id, own_th]).drop(own_th)
    return stay.unionByName(docs.where(~words))
