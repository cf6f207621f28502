"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

A source's documents are permuted by a hash and cut into blocks of about equal size. From the targets follows how many
whole passes over its blocks the mix makes and which blocks the last, partial pass adds: the source's exact quota. The
quotas of all sources are split over the output shards by a tree: each node deals half of its blocks to its left child
by a draw without replacement (multivariate hypergeometric), so every shard gets a true sample of the mix and all
shards together exactly the quotas. A shard's share of a source is a run of the source's permuted blocks, disjoint from
all others; documents are then shuffled within their shard.

A null source is a source of its own, last in order. A null or empty text has size 0: it is carried along with its
block and adds nothing. Rows that agree in id and text are treated alike. Reruns give the same mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, stored

#: Most rows of a table that is sent to all executors (some tens of bytes each).
BROADCAST_ROWS = 200_000


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """A draw of the number of good items among `draws` out of `pop` items, for a uniform number u in [0, 1).

    By inversion: outcomes are walked from the most likely one upwards, then downwards, with weights relative to it;
    beyond 12 standard deviations a weight is below the rounding of doubles.
    """
    low, high = F.greatest(F.lit(0).cast("long"), draws - (pop - good)), F.least(draws, good)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1) / (pop + 2))))
    p = good / F.greatest(pop, F.lit(1))
    width = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), draws * p * (1 - p)))) + 12
    up = lambda x: (good - x) * (draws - x) / ((x + 1) * (pop - good - draws + x + 1))
    down = lambda x: x * (pop - good - draws + x) / ((good - x + 1) * (draws - x + 1))

    def total(xs: Column, ratio, first: Column) -> Column:
        start = F.struct(first.alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"]).alias("sum")))["sum"]

    def find(xs: Column, ratio, first: Column, level: Column) -> Column:
        start = F.struct(first.alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("x"))
        step = lambda s, x: F.struct(
            (s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"]).alias("sum"), F.coalesce(s["x"], F.when(s["sum"] + s["w"] > level, x)).alias("x")
        )
        return F.aggregate(xs, start, step)["x"]

    one = F.lit(1.0)

    def walk(m: Column) -> Column:
        above = F.sequence(m, F.least(high, m + width))
        below = F.when(m > low, F.sequence(m - 1, F.greatest(low, m - width), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        first = F.when(m > low, down(m)).otherwise(F.lit(0.0))
        sums = F.struct(total(above, up, one).alias("up"), total(below, down, first).alias("down"))
        return bind(sums, lambda s: bind(u * (s["up"] + s["down"]), lambda t: F.coalesce(F.when(t < s["up"], find(above, up, one, t)).otherwise(find(below, down, first, t - s["up"])), m)))

    return bind(mode, walk)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: rank int (from 1, dense), quota long, one row per source. Returns rank, shard, n for 2**levels shards.

    A node is a row with its array of quotas; only counts are split, so the tree is small: shards times sources.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(0).alias("node"), F.transform("q", lambda x: x["quota"]).alias("q"))
    for level in range(levels):

        def left(q: Column, level=level) -> Column:
            size = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
            start = F.struct(size.alias("pop"), F.floor((size + F.col("node") % 2) / 2).alias("need"), F.array().cast("array<long>").alias("out"))

            def deal(s: Column, k: Column) -> Column:
                u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(s["out"]))
                return bind(hypergeometric(s["pop"], k, s["need"], u), lambda x: F.struct((s["pop"] - k).alias("pop"), (s["need"] - x).alias("need"), F.array_append(s["out"], x).alias("out")))

            return F.aggregate(q, start, deal)["out"]

        halves = bind(left(F.col("q")), lambda a: F.array(F.struct((F.col("node") * 2).alias("node"), a.alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", a, lambda x, y: x - y).alias("q"))))
        node = node.select(F.explode(halves).alias("x")).select("x.node", "x.q")
    return node.select(F.col("node").alias("shard"), F.posexplode("q").alias("rank", "n")).select((F.col("rank") + 1).alias("rank"), "shard", F.col("n").cast("long").alias("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: source, source_size. Adds rank (code-point order, null last) and target.

    Targets share `share` times all sizes by weight (repeating in rank order); none exceeds `most` times its size, the
    excess goes to the others by weight. With sources in the order of cap / weight, the full ones come first, and the
    level that the others share is known at the first one that isn't full.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    rows = ranked.withColumn("w", w).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - given) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    open_level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "rank", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.coalesce(F.least(F.col("cap"), open_level * F.col("w")), F.col("cap"))).select("source", "rank", "source_size", "target")


def _small(df: DataFrame) -> DataFrame:
    """df, to be sent to all executors if it has few rows; its size is counted first."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plan_mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    levels: int = 7, blocks: int = 4096, seed: int = 42, loose: int = 4096,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The mix of docs over 2**levels shards: docs with __source, __size, __key, and the tables of decisions (sources,
    blocks and documents of partial blocks, with their shards) that assigned() applies.

    Sizes are counted once and kept (id-sized rows, not texts). The last, partial block of each source is cut into
    finer blocks by further bits of the hash until at most `loose` documents are undecided; of those, documents are
    taken in permuted order where they still fit.
    """
    own = {"__source": F.col(f"`{source}`"), "__size": n_words(text), "__key": F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))}
    sized = docs.withColumns(own)
    slim = stored(sized.select(F.col("__source").alias("source"), F.col("__key").alias("key"), F.col("__size").alias("size")), "mix-sizes")
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total = F.sum("source_size").over(Window.partitionBy())
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") * blocks / F.greatest(total, F.lit(1)))).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("n_blocks", n_blocks).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = stored(plan, "mix-plan")
    per_source = _small(plan)
    u = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53)) * F.col("n_blocks")
    placed = slim.join(per_source, slim["source"].eqNullSafe(plan["source"])).select("rank", "key", "size", "rest", F.floor(u).alias("block"), (u - F.floor(u)).alias("within"))
    table = stored(_cut(placed, seed), "mix-blocks")
    loose_blocks = table.where("part or spare").select("rank", "block", F.col("need").alias("rest"))
    inner = placed.drop("rest").join(_small(loose_blocks), ["rank", "block"]).drop("block")
    chosen = _fill(inner, loose, seed)

    # units: one for each block and pass; the partial block is one too
    units = table.join(_small(plan.select("rank", "passes")), "rank").select("rank", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"), "passes", "full", "part")
    units = units.where((F.col("pass") < F.col("passes")) | F.col("full") | F.col("part"))
    spot = F.row_number().over(Window.partitionBy("rank").orderBy("pass", F.xxhash64(F.lit(seed), "rank", "pass", "block")))
    units = stored(units.withColumn("spot", spot), "mix-units")
    quotas = plan.select("rank").join(units.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), "rank", "left").select("rank", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
    dealt = split_tree(quotas, levels, seed).where("n > 0")
    end = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    spots = dealt.withColumn("end", end).select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("spot"))
    units = units.join(spots, ["rank", "spot"])
    sure = units.where((F.col("pass") < F.col("passes")) | F.col("full"))
    by_block = sure.groupBy("rank", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    extra = units.where((F.col("pass") == F.col("passes")) & F.col("part")).select("rank", F.col("shard").alias("part_shard"))
    decisions = {"plan": plan, "blocks": stored(by_block, "mix-shards"), "extra": stored(extra, "mix-extra"), "chosen": stored(chosen.distinct(), "mix-chosen")}
    return sized, decisions


#: Documents among which the last words of a source are looked for, at least.
SPARE = 256


def _cut(placed: DataFrame, seed: int) -> DataFrame:
    """Words of each block, in permuted order, against what is to be taken of the source: rank, block, full (all of it
    is taken), part (some of it), spare (a block after that one, where it has few documents), need (how much)."""
    sums = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.first("rest").alias("rest"))
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit("cut"), "rank", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("rest") - F.coalesce(F.sum("words").over(order), F.lit(0))
    rows = sums.withColumn("need", need).withColumn("docs_before", F.coalesce(F.sum("docs").over(order), F.lit(0)))
    part = (F.col("need") > 0) & (F.col("need") < F.col("words"))
    at = F.max(F.when(part, F.col("docs_before"))).over(Window.partitionBy("rank"))
    spare = (F.col("need") <= 0) & (F.col("docs_before") < F.col("at") + SPARE)
    full = (F.col("words") > 0) & (F.col("need") >= F.col("words"))
    return rows.withColumn("at", at).select("rank", "block", full.alias("full"), part.alias("part"), F.coalesce(spare, F.lit(False)).alias("spare"), "need")


def _fill(inner: DataFrame, loose: int, seed: int) -> DataFrame:
    """inner: the documents of partial and spare blocks (rank, key, size, within, rest: what is to be taken before their
    block; not positive in spare ones). Returns rank, key of those taken: in permuted order, as long as they fit."""
    whole = []
    for depth in range(4):  # digits of the hash are used up then, and what is left agrees in id and text
        if depth == 3 or (inner.groupBy("rank").count().agg(F.max("count")).first()[0] or 0) <= loose:
            break
        inner = inner.where("rest > 0")  # a partial block of so many documents needs no spare ones
        fine = F.col("within") * 1024
        inner = inner.select("rank", "key", "size", "rest", F.floor(fine).alias("block"), (fine - F.floor(fine)).alias("within"))
        table = stored(_cut(inner, seed + depth + 1).where("full or part"), "mix-blocks")
        inner = stored(inner.drop("rest").join(_small(table.select("rank", "block", "full", "part", "need")), ["rank", "block"]), "mix-inner")
        whole.append(inner.where("full").select("rank", "key"))
        inner = inner.where("part").select("rank", "key", "size", "within", F.col("need").alias("rest"))
    items = inner.where("size > 0").groupBy("rank", "key").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"))
    fit = items.groupBy("rank").agg(F.max("rest").alias("need"), F.array_sort(F.collect_list(F.struct((F.col("rest") <= 0).alias("spare"), "key", "size"))).alias("items"))
    start = F.struct(F.col("need").alias("rest"), F.array().cast("array<bigint>").alias("keys"), F.lit(None).cast("struct<size:bigint,key:bigint>").alias("over"))

    def step(s: Column, x: Column) -> Column:
        item = F.struct(x["size"].alias("size"), x["key"].alias("key"))
        fits = F.struct((s["rest"] - x["size"]).alias("rest"), F.array_append(s["keys"], x["key"]).alias("keys"), s["over"].alias("over"))
        return F.when(x["size"] <= s["rest"], fits).otherwise(F.struct(s["rest"].alias("rest"), s["keys"].alias("keys"), F.least(s["over"], item).alias("over")))

    # what is left over is nearer with the smallest document that didn't fit, if that goes over by less
    nearer = lambda s: F.when(s["over"]["size"] < 2 * s["rest"], F.array_append(s["keys"], s["over"]["key"])).otherwise(s["keys"])
    chosen = fit.select("rank", F.explode(F.aggregate("items", start, step, nearer)).alias("key"))
    for more in whole:
        chosen = chosen.unionByName(more)
    return chosen


def assigned(sized: DataFrame, decisions: dict[str, DataFrame]) -> DataFrame:
    """sized with __source_size, __target and __shards (one entry for each copy that the mix takes)."""
    plan = decisions["plan"].select(F.col("source").alias("__s"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("n_blocks").alias("__n"))
    extra = decisions["extra"].select(F.col("rank").alias("__rank"), F.col("part_shard").alias("__part_shard"))
    rows = sized.join(_small(plan.join(extra, "__rank", "left")), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__block", F.floor(F.shiftrightunsigned("__key", 11) / F.lit(float(1 << 53)) * F.col("__n")))
    blocks = decisions["blocks"].select(F.col("rank").alias("__rank"), F.col("block").alias("__block"), F.col("shards").alias("__sure"))
    chosen = decisions["chosen"].select(F.col("rank").alias("__rank"), F.col("key").alias("__key"), F.lit(True).alias("__chosen"))
    rows = rows.join(_small(blocks), ["__rank", "__block"], "left").join(_small(chosen), ["__rank", "__key"], "left")
    none = F.array().cast("array<int>")
    more = F.when(F.col("__chosen"), F.array("__part_shard")).otherwise(none)
    return rows.withColumn("__shards", F.concat(F.coalesce("__sure", none), F.coalesce(more, none)))


def _shielded(docs: DataFrame, options: dict) -> tuple[DataFrame, dict, dict[str, str]]:
    """docs with other names for columns that might clash with the ones used here, the options that name columns likewise,
    and the new names by the old ones."""
    names: dict[str, str] = {}
    for c in docs.columns:
        names[c] = fresh(f"own{c}", [*docs.columns, *names.values()]) if c.startswith("__") else c
    for option in ("text", "source", "doc_id"):
        at = {c.lower(): n for c, n in names.items()}
        if option in options:
            options = options | {option: at.get(options[option].lower(), options[option])}
    return docs.toDF(*names.values()), options, names


def mix_report(docs: DataFrame, *, keep: list[str], **options) -> DataFrame:
    """Per row of docs: the columns in keep, size, source_size, target, taken (words the mix takes), shards. Columns in keep
    with the names of results give way."""
    keep = [c for c in keep if c not in ("size", "source_size", "target", "taken", "shards")]
    docs, options, names = _shielded(docs, options)
    rows = assigned(*plan_mix(docs, **options))
    taken = F.col("__size") * F.size("__shards")
    return rows.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in keep], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), F.col("__shards").alias("shards"))


def mix(docs: DataFrame, *, seed: int = 42, levels: int = 7, **options) -> DataFrame:
    """The mix itself: a row for each copy taken, with the columns of docs, in shards shuffled locally.

    Rows are dealt by ranges of (shard, hash), which are of even size, and sorted by the hash within each shard.
    """
    docs, options, names = _shielded(docs, options)
    rows = assigned(*plan_mix(docs, seed=seed, levels=levels, **options))
    copies = rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__key", F.posexplode("__shards").alias("__copy", "__shard"))
    order = ["__shard", F.xxhash64(F.lit(seed), "__key", "__copy")]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
