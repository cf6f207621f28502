"""Training pairs, splits, losses, error statistics and the choice of epochs and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .pixels import min_max_nonzero, normalize_by_max, upscale


def training_pair(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Patches of two stores, met by patch_id: x, y."""
    return inputs.select("patch_id", F.col("px").alias("x")).join(targets.select("patch_id", F.col("px").alias("y")), "patch_id")


def training_cells(inputs: DataFrame, targets: DataFrame, f: int, channels: tuple[str, ...] = ()) -> DataFrame:
    """Pixel rows of training pairs: x, the input raised by f and divided by its maximum, y, the target's intensity, and
    the wanted ones of the channels r and eta, taken from the target's grid, 0 where x is, scaled between their extremes.
    inputs: patch_id, row, col, v; targets: also r, eta."""
    x = normalize_by_max(upscale(inputs, f)).withColumnRenamed("v", "x")
    rows = x.join(targets.withColumnRenamed("v", "y"), ["patch_id", "row", "col"])
    for c in channels:
        rows = min_max_nonzero(rows, c, "x", absolute=c == "eta")
    return rows


def train_test_split(rows: DataFrame, fraction: float, order: str, total: int | None = None, bucket: int = 1 << 16) -> DataFrame:
    """Adds position (dense from 0 in the order of an integer column) and train: the first int(fraction * N) positions.
    Rows are ranked within buckets of the column's values, and only the buckets' sizes are summed up in order."""
    n = rows.count() if total is None else total
    ranged = rows.withColumn("__b", F.floor(F.col(order) / bucket))
    within = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(order)))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select("__b", before.alias("__before"))
    placed = within.join(starts, "__b").withColumn("position", F.col("__before") + F.col("__k") - 1)
    return placed.withColumn("train", F.col("position") < int(fraction * n)).drop("__b", "__k", "__before")


#: The percentiles of the validation log.
PERCENTILES = [0.5, 0.75, 0.95, 0.995]


#: Groups (by columns and a few numbers each) that are sent to every task; more are joined. Values that are sorted in one
#: row.
GROUPS_TOLD, SORTED = 100_000, 100_000


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of which both sides may hold nulls, which match each other."""
    own = {k: f"__{k}" for k in keys}
    same = F.lit(True)
    for k, other in own.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """by, q: the exact percentiles (linear between neighbours) of a column of doubles that aren't negative, for each group.

    Each wanted rank is known to lie in an interval of values, at first its group's whole range. A pass counts the rows of
    each interval in bins, by powers where the interval is wide, evenly where not, with the least and the greatest value of
    each bin; the bin that holds a rank is its next interval. An interval of at most SORTED rows is sorted, so one pass
    does for groups of some 400 million rows, two for any. No pass gathers a larger group's rows: what is shuffled are
    counts of bins, one for each task, and sums over bins take at most `bins` rows.
    Nulls are left out; a group without values has no row; null is a group of
    its own; NaN counts as greatest.
    """
    shown = by if by else ["__all"]
    data = rows.select(*by, F.col(value).cast("double").alias("__d"), *([] if by else [F.lit(1).alias("__all")])).where("__d is not null")
    size = data.groupBy(*shown).agg(F.count(F.lit(1)).alias("n"), F.min("__d").alias("lo"), F.max("__d").alias("hi"))
    at = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in shares])
    first = F.array_distinct(F.flatten(F.array(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x)))))
    size = staged(size, "percentile-sizes")
    open_, found = size.select(*shown, "lo", "hi", "n", F.lit(0).cast("long").alias("before"), F.explode(first).alias("rank")), None
    same = F.col("lo").eqNullSafe(F.col("hi"))

    def met(ranges: DataFrame, told: bool) -> DataFrame:
        """The values within intervals."""
        return joined_by(data, F.broadcast(ranges) if told else ranges, shown).where(F.col("__d").between(F.col("lo"), F.col("hi")))

    while True:
        left, large = open_.agg(F.count_if(~same), F.count_if(~same & (F.col("n") > SORTED))).first()
        ranges = open_.where(~same).groupBy(*shown, "lo", "hi", "before", "n").agg(F.collect_list("rank").alias("ranks"))
        done = open_.where(same).select(*shown, "rank", F.col("lo").alias("v"))
        if left > large:
            lists = met(ranges.where(F.col("n") <= SORTED), left <= GROUPS_TOLD).groupBy(*shown, "lo", "hi", "before", "ranks").agg(F.sort_array(F.collect_list("__d")).alias("vs"))
            done = done.unionByName(lists.select(*shown, "before", "vs", F.explode("ranks").alias("rank")).select(*shown, "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("v")))
        found = done if found is None else found.unionByName(done)
        if not large:
            break
        inside = met(ranges.where(F.col("n") > SORTED).drop("n"), left <= GROUPS_TOLD)
        low = F.greatest("lo", F.lit(5e-324))
        width = F.log2("hi") - F.log2(low)
        power = (F.log2("__d") - F.log2(low)) / width
        even = (F.col("__d") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        wide = width > 2
        share = F.when(F.isnan("__d") | (F.col("__d") == float("inf")), F.lit(1.0)).when(F.col("__d") <= low, F.lit(0.0)).when(wide, power).otherwise(even)
        endless = F.isnan("hi") | (F.col("hi") == float("inf"))  # what isn't finite is set apart first
        bin_ = F.when(F.isnan("__d"), bins + 2).when(F.col("__d") == float("inf"), bins + 1).when(endless, 0).otherwise(F.least(F.floor(share * (bins - 1)) + F.when(F.col("__d") > F.col("lo"), 1).otherwise(0), F.lit(bins)))
        counts = inside.withColumn("bin", bin_).groupBy(*shown, "lo", "hi", "before", "ranks", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("__d").alias("bl"), F.max("__d").alias("bh"))
        order = Window.partitionBy(*shown, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        hit = placed.select(*shown, F.col("bl").alias("lo"), F.col("bh").alias("hi"), F.col("start").alias("before"), "n", F.explode("ranks").alias("rank"))
        open_ = staged(hit.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))), "percentile-ranks")
    listed = found.groupBy(*shown).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("__v"))
    listed = joined_by(listed, size.select(*shown, "n"), shown)

    def between(x):
        low, high = F.element_at("__v", F.floor(x)), F.element_at("__v", F.ceil(x))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return listed.select(*by, F.transform(at, between).alias("q"))


def error_stats(pairs: DataFrame, by: list[str], accuracy: int | None = 10_000) -> DataFrame:
    """pairs: truth, pred. Mean and percentiles of the absolute differences, from mergeable summaries of bounded size;
    with accuracy None exact ones, by exact_percentiles()."""
    d = F.abs(F.col("truth") - F.col("pred"))
    if accuracy is None:
        data = staged(pairs.select(*by, d.alias("d")), "errors")
        means = data.groupBy(*by).agg(F.avg("d").alias("mean_error"))
        rows = joined_by(means, exact_percentiles(data, by, "d", PERCENTILES), by, "left")
    else:
        rows = pairs.groupBy(*by).agg(F.avg(d).alias("mean_error"), F.percentile_approx(d, PERCENTILES, accuracy).alias("q"))
    return rows.select(*by, "mean_error", *[F.col("q")[k].alias(f"p{str(100 * p).replace('.0', '').replace('.', '_')}") for k, p in enumerate(PERCENTILES)])


def epoch_loss(pairs: DataFrame, loss: str) -> DataFrame:
    """Mean over batches of the batches' mean squared (mse) or absolute (mae) differences. pairs: epoch, batch, truth, pred."""
    d = F.col("truth") - F.col("pred")
    if loss not in ("mse", "mae"):
        raise ValueError(loss)
    batches = pairs.groupBy("epoch", "batch").agg(F.avg(d * d if loss == "mse" else F.abs(d)).alias("loss"))
    return batches.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Per trial: number of epochs, the least validation loss and its first epoch."""
    return history.groupBy("trial").agg(F.count(F.lit(1)).alias("n_epochs"), F.min("val_loss").alias("best_loss"), F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"))


def best_trial(history: DataFrame) -> DataFrame:
    """The trial of the least validation loss; ties to the smaller trial."""
    return best_epoch(history).orderBy("best_loss", "trial").limit(1)


def early_stop_epoch(history: DataFrame, patience: int) -> DataFrame:
    """Per trial the epoch at which `patience` epochs in a row have brought no strictly smaller loss; null if never."""
    order = Window.partitionBy("trial").orderBy("epoch")
    best_before = F.min("val_loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumns({"k": F.row_number().over(order), "better": F.coalesce(F.col("val_loss") < best_before, F.lit(True))})
    last = F.max(F.when(F.col("better"), F.col("k"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stale", F.col("k") - last).groupBy("trial").agg(F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).alias("stop_epoch"))


def errors_from_log(lines: DataFrame) -> DataFrame:
    """split, epoch, error of the log's training and validation lines."""
    v = F.col("value")
    rows = lines.where(v.rlike(r"^INFO:root:\[(Train|Valid)\] @ ")).select(
        F.regexp_extract(v, r"\[(Train|Valid)\]", 1).alias("split"), F.regexp_extract(v, r"\] @ \D*(\d+)", 1).cast("long").alias("epoch"), F.regexp_extract(v, r"Avg\.: *([^,]+)", 1).alias("e")
    )
    return rows.select("split", "epoch", F.expr("try_cast(e as double)").alias("error"))
