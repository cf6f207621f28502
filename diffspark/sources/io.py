"""Readers and writers, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 29 columns of peak files, in order.
PEAK_COLUMNS = [
    "SpotID", "IntegratedIntensity", "Omega(degrees)", "YCen(px)", "ZCen(px)", "IMax", "Radius(px)", "Eta(degrees)", "SigmaR", "SigmaEta", "NrPixels",
    "TotalNrPixelsInPeakRegion", "nPeaks", "maxY", "maxZ", "diffY", "diffZ", "rawIMax", "returnCode", "retVal", "BG", "SigmaGR", "SigmaLR", "SigmaGEta",
    "SigmaLEta", "MU", "RawSumIntensity", "maskTouched", "FitRMSE",
]
#: Frames (some 50 bytes each) that are sent to every task; more are joined.
FRAMES_TOLD = 1_000_000
PEAKS = T.StructType([T.StructField(c, T.DoubleType()) for c in PEAK_COLUMNS])
#: The names used within jobs.
SNAKE = [
    "spot_id", "integrated_intensity", "omega", "ycen", "zcen", "imax", "radius", "eta", "sigma_r", "sigma_eta", "nr_pixels", "total_nr_pixels", "n_peaks", "max_y", "max_z",
    "diff_y", "diff_z", "raw_imax", "return_code", "ret_val", "bg", "sigma_gr", "sigma_lr", "sigma_geta", "sigma_leta", "mu", "raw_sum_intensity", "mask_touched", "fit_rmse",
]


def to_file_names(peaks: DataFrame) -> DataFrame:
    return peaks.select(*[F.col(a).cast("double").alias(b) for a, b in zip(SNAKE, PEAK_COLUMNS, strict=True)])


def read_peaks(spark: SparkSession, path: str | list[str], scan_id: str | None = None) -> DataFrame:
    """Peak files of one or more scans: tab-separated with header, one a frame, named {number}_PS.csv with numbers from 1,
    as write_peaks() makes them, or in folders frame_id=N. Adds frame_id (from 0) and scan_id: the name given, else that of the folder that holds
    a scan's files, or of the one above if that is named peaks."""
    rows = spark.read.schema(PEAKS).option("recursiveFileLookup", True).csv(path, sep="\t", header=True)
    name = F.col("_metadata.file_path")
    numbered, folder = F.regexp_extract(name, r"(\d+)_PS\.csv$", 1), F.regexp_extract(name, r"frame_id=(\d+)/", 1)
    frame = F.when(numbered != "", numbered.try_cast("long") - 1).when(folder != "", folder.try_cast("long"))
    holder = F.when(numbered != "", F.regexp_extract(name, r"([^/]+)/(?:peaks/)?[^/]*$", 1)).otherwise(F.regexp_extract(name, r"([^/]+)/peaks/frame_id=", 1))
    scan = holder if scan_id is None else F.lit(scan_id)
    return rows.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(PEAK_COLUMNS, SNAKE, strict=True)], frame.alias("frame_id"), scan.alias("scan_id"))


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated ring list with header; RingNr and Radius are used. line keeps the file's order: the file, the place
    of the split that a row was read with, and the row's place in it."""
    rows = spark.read.option("header", True).option("sep", " ").csv(path)
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("RingNr").cast("int"), F.col("Radius").cast("double"), line.alias("line"))


FRAMES = {
    "pixels": "frame_id long, z int, y int, intensity double, scan_id string",
    "dark_frames": "dark_no int, z int, y int, value double, scan_id string",
    "correction": "z int, y int, dark double, flood double, mask double, scan_id string",
}


def read_frames(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables pixels, dark_frames and correction of a folder, partitioned by scan_id."""
    return {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in FRAMES.items()}


def write_frames(tables: dict[str, DataFrame], path: str) -> None:
    for name, t in tables.items():
        t.write.partitionBy("scan_id").parquet(f"{path}/{name}")


def write_frame_buckets(pixels: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """A catalog table of pixels whose files hold whole frames: bucketed by (scan_id, frame_id), sorted by them and place.
    Labelling what is read from it needs no exchange, so a scan that is worked on more than once is shuffled once.
    buckets: some 128 MB each is a good size; pixels are dealt out by the same hash first, so a bucket is one file."""
    rows = pixels.select(*[F.col(c).cast(k).alias(c) for c, k in (f.split() for f in FRAMES["pixels"].split(", "))])
    keys = ["scan_id", "frame_id"]
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, "z", "y").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return pixels.sparkSession.table(table)


def write_peaks(peaks: DataFrame, frames: DataFrame, path: str, stem: str = "", padding: int = 6) -> None:
    """Under path/peaks a tab-separated file with header for every frame in frames, {stem}{number}_PS.csv with numbers from
    1, rows by spot_id; a frame without peaks has the header alone. Where both tables have scan_id, a scan has a folder of its own. And
    frame_status (frame_id, n_peaks) with a row for every frame. Files appear once all are written."""
    from .peakfiles import PeakFiles

    keys = [c for c in ("scan_id", "frame_id") if c in peaks.columns and c in frames.columns]
    every = frames.select(*keys).distinct()
    named = peaks.join(F.broadcast(every) if every.count() <= FRAMES_TOLD else every, keys, "left_semi").select(*keys, F.lit(1).alias("kind"), *[F.col(c).cast("double").alias(c) for c in SNAKE])
    heads = every.select(*keys, F.lit(0).alias("kind"), *[F.lit(None).cast("double").alias(c) for c in SNAKE])
    rows = heads.unionByName(named).repartition(*keys).sortWithinPartitions(*keys, "kind", "spot_id")
    peaks.sparkSession.dataSource.register(PeakFiles)
    rows.write.format(PeakFiles.name()).mode("append").option("stem", stem).option("padding", padding).save(f"{path}/peaks")
    counts = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peaks"))
    every.join(counts, keys, "left").select(*keys, F.coalesce("n_peaks", F.lit(0)).alias("n_peaks")).write.parquet(f"{path}/frame_status")


STORE = ("patches", "info", "locations", "parameters")


def write_patchstore(tables: dict[str, DataFrame], path: str, args: dict[str, object] | None = None) -> None:
    """patches (px as float, partitioned by srfac), info, locations, parameters; args as a table of key and value."""
    patches = tables["patches"].withColumn("px", F.col("px").cast("array<float>"))
    patches.write.partitionBy("srfac").parquet(f"{path}/patches")
    for name in STORE[1:]:
        if name in tables:
            tables[name].write.parquet(f"{path}/{name}")
    if args is not None:
        spark = patches.sparkSession
        spark.createDataFrame([(k, str(v)) for k, v in args.items()], "key string, value string").coalesce(1).write.parquet(f"{path}/args")


def read_patchstore(spark: SparkSession, path: str, only_patch_arrays: bool = False) -> dict[str, DataFrame]:
    """The tables of a store that are there; with only_patch_arrays the patches alone are looked at."""
    from pyspark.errors import AnalysisException

    out = {"patches": spark.read.parquet(f"{path}/patches")}
    for name in () if only_patch_arrays else (*STORE[1:], "args"):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def write_peakbank(bank: DataFrame, path: str, csv: bool = False) -> None:
    """A bank with its explicit peak_id, as Parquet or as CSV with header and the id first."""
    ordered = bank.select("peak_id", *[c for c in bank.columns if c != "peak_id"])
    ordered.write.csv(path, header=True) if csv else ordered.write.parquet(path)


def read_peakbank(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema: CSV as write_peakbank() makes it; else Parquet."""
    return spark.read.schema(schema).csv(path, header=True) if schema else spark.read.parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predicted patches in a folder for each factor."""
    predictions.withColumn("px", F.col("px").cast("array<float>")).write.partitionBy("srfac").parquet(path)


def patches_info(cells: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per patch: y00, z00, nr_pixels_in_patch (non-zero ones), patches_isum, n_peaks_in_patches. cells: patch_id, z00, y00,
    v; peaks: patch_id, a row for each."""
    sums = cells.groupBy("patch_id", "y00", "z00").agg(F.count_if(F.col("v") != 0).alias("nr_pixels_in_patch"), F.sum("v").alias("patches_isum"))
    found = peaks.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(found, "patch_id", "left").withColumn("n_peaks_in_patches", F.coalesce("n", F.lit(0))).drop("n")


def write_outputs(tables: dict[str, DataFrame], path: str, wanted: tuple[str, ...] = ()) -> None:
    """Optional intermediate tables: good_pixels, patches_info, sr_patches, drawn_frames."""
    for name in wanted:
        tables[name].write.parquet(f"{path}/{name}")
