"""Peak files by frame, frames in buckets, and labelling by bands."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.operators import frames, spots
from diffspark.plans import workloads
from diffspark.sources import fixtures, io
from diffspark.sources.peakfiles import PeakFileWriter


def peak_rows(spark, *rows):
    schema = "scan_id string, frame_id long, " + ", ".join(f"{c} double" for c in io.SNAKE)
    return spark.createDataFrame([(s, f, float(k), *[v] * 28) for s, f, k, v in rows], schema)


def files_under(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if not n.endswith(".crc"))


def test_a_file_for_every_frame_and_back(spark, tmp_path):
    rows = peak_rows(spark, ("a", 0, 2, 0.1), ("a", 0, 1, 1e-300), ("a", 11, 1, float("nan")), ("b", 0, 1, 1 / 3), ("c", 5, 1, 9.0)).withColumn("bg", F.when(F.col("scan_id") == "b", F.col("bg")))
    every = spark.createDataFrame([("a", 0), ("a", 4), ("a", 11), ("b", 0), ("b", 1), ("b", 1)], "scan_id string, frame_id long")
    io.write_peaks(rows.repartition(3), every.repartition(2), str(tmp_path / "out"), stem="exp_")
    assert files_under(tmp_path / "out/peaks") == ["a/exp_000001_PS.csv", "a/exp_000005_PS.csv", "a/exp_000012_PS.csv", "b/exp_000001_PS.csv", "b/exp_000002_PS.csv"]
    header = "\t".join(io.PEAK_COLUMNS) + "\n"
    assert (tmp_path / "out/peaks/a/exp_000005_PS.csv").read_text() == header == (tmp_path / "out/peaks/b/exp_000002_PS.csv").read_text()
    text = (tmp_path / "out/peaks/a/exp_000001_PS.csv").read_text().splitlines()
    assert text[0] + "\n" == header and [line.split("\t")[0] for line in text[1:]] == ["1.0", "2.0"]
    key = lambda r: str(tuple(r))
    columns = ["scan_id", "frame_id", *io.SNAKE]
    back = io.read_peaks(spark, str(tmp_path / "out/peaks")).select(*columns).collect()
    assert sorted(back, key=key) == sorted(rows.where("scan_id <> 'c'").select(*columns).collect(), key=key) or sorted(map(key, back)) == sorted(map(key, rows.where("scan_id <> 'c'").select(*columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/frame_status")).collect())) == [("a", 0, 2), ("a", 4, 0), ("a", 11, 1), ("b", 0, 1), ("b", 1, 0)]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = peak_rows(spark, *[("a", f, 1, 1.0) for f in range(20)])
    bad = rows.withColumn("imax", F.when(F.col("frame_id") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        io.write_peaks(bad, rows.select("scan_id", "frame_id"), str(tmp_path / "out"))
    assert files_under(tmp_path / "out") == []
    io.write_peaks(rows, rows.select("scan_id", "frame_id"), str(tmp_path / "out"))
    assert len([f for f in files_under(tmp_path / "out/peaks")]) == 20


def test_attempts_that_are_not_accepted_never_appear(tmp_path):
    path = str(tmp_path / "out")
    writer = PeakFileWriter(["frame_id", "kind", *io.SNAKE], path, "", 3)
    head, peak = lambda f: (f, 0, *[None] * 29), lambda f, v: (f, 1, *[v] * 29)

    def killed():
        yield head(0)
        yield peak(0, 1.0)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    doubled = writer.write(iter([head(1), peak(1, 5.0)]))
    accepted = [writer.write(iter([head(0), peak(0, 2.0), head(2)])), writer.write(iter([head(1), peak(1, 5.0)])), writer.write(iter([]))]
    assert files_under(path) and not [f for f in files_under(path) if not f.startswith("_temporary")] and doubled.folder != accepted[1].folder
    other = PeakFileWriter(["frame_id", "kind", *io.SNAKE], path, "", 3)
    still = other.write(iter([head(7)]))
    writer.commit([*accepted, None])
    assert [f for f in files_under(path) if not f.startswith("_temporary")] == ["001_PS.csv", "002_PS.csv", "003_PS.csv"]
    assert (tmp_path / "out/001_PS.csv").read_text().splitlines()[1].startswith("2.0\t")
    other.commit([still])
    assert files_under(path) == ["001_PS.csv", "002_PS.csv", "003_PS.csv", "008_PS.csv"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_in_buckets_are_labelled_without_an_exchange(spark, data):
    pixels = fixtures.pixels(spark, data)
    spark.sql("drop table if exists frame_buckets")
    table = io.write_frame_buckets(pixels, "frame_buckets", 4)
    args = (fixtures.PARAMS, fixtures.RINGS, fixtures.THRESH)
    for more in ({}, {"correction": fixtures.correction(spark), "bc": 1.5, "bad": 30.0}, {"skip": 2}, {"skip": 2, "transform": (1, 3), "correction": fixtures.correction(spark)}):
        got, want = workloads.frames_to_spots(table, *args, **more), workloads.frames_to_spots(pixels, *args, **more)
        by_frame = [[x for x in plan_of(df).splitlines() if "Exchange hashpartitioning" in x and "frame_id" in x] for df in (got, want)]  # a turned correction meets its mask by place
        assert by_frame[0] == [] != by_frame[1] and "FlatMapGroupsInPandas" in plan_of(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    spark.sql("drop table frame_buckets")


def test_skipped_frames_are_numbered_as_before(spark, data):
    pixels = fixtures.pixels(spark, data)
    args = (fixtures.PARAMS, fixtures.RINGS, fixtures.THRESH)
    want = spots.label_spots(frames.good_pixels(frames.skip_frames(pixels, 2), *args))
    assert sorted(map(tuple, workloads.frames_to_spots(pixels, *args, skip=2).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("connectivity", "rows", "told"), [(8, 1, 0), (8, 3, 10**6), (8, 16, 10**6), (4, 2, 0), (4, 5, 10**6), (8, 1000, 10**6)])
def test_bands_give_the_same_spots_and_numbers(spark, monkeypatch, connectivity, rows, told):
    monkeypatch.setattr(spots, "LINKS_TOLD", told)
    rng, out = np.random.default_rng(rows + connectivity), []
    for f, share in enumerate((0.05, 0.3, 0.45, 0.6)):  # up to spots that wind through all bands
        z, y = np.nonzero(rng.uniform(size=(40, 30)) < share)
        out += [("s", f, int(a), int(b), 1.0 + int(a)) for a, b in zip(z, y, strict=True)]
    spiral = [("t", 0, a, b, 1.0) for a in range(40) for b in range(30) if a in (0, 39) or b in (0, 29) or (b == 15 and a > 5)]
    good = spark.createDataFrame([*out, *spiral, ("t", 1, 3, 3, 0.0), ("t", 2, 7, 0, 5.0)], "scan_id string, frame_id long, z int, y int, intensity double").repartition(5)
    want = sorted(map(tuple, spots.label_spots(good, connectivity).collect()))
    assert sorted(map(tuple, spots.label_spots(good, connectivity, tile_rows=rows).collect())) == want


def test_a_frame_takes_many_tasks(spark):
    good = spark.range(4000).selectExpr("'s' as scan_id", "0L as frame_id", "cast(id div 20 as int) as z", "cast(id % 20 * 2 as int) as y", "1.0D as intensity")
    out = spots.label_spots(good, tile_rows=10)
    assert out.select("spot_id").distinct().count() == 20
    text = plan_of(spots.label_spots(good, tile_rows=10))
    assert "hashpartitioning(scan_id" in text and "SinglePartition" not in text


def test_residual_map_moves_pixels_on_and_off_rings(spark, data, monkeypatch):
    pixels = fixtures.pixels(spark, data)
    args = (fixtures.PARAMS, fixtures.RINGS, fixtures.THRESH)
    zero = spark.createDataFrame([(0, 0, 0.0)], "z int, y int, residual double")
    plain = sorted(map(tuple, frames.good_pixels(pixels, *args).collect()))
    assert sorted(map(tuple, frames.good_pixels(pixels, *args, zero).select(*frames.good_pixels(pixels, *args).columns).collect())) == plain
    places = spark.range(96 * 96).selectExpr("cast(id div 96 as int) as z", "cast(id % 96 as int) as y", "(id % 13 - 6) * 0.5D as residual")
    moved = frames.with_ring(pixels, args[0], args[1], places).join(places, ["z", "y"]).join(frames.with_ring(pixels, args[0], args[1]).select("frame_id", "z", "y", F.col("radius_px").alias("was")), ["frame_id", "z", "y"])
    assert moved.where("abs(radius_px - was - residual) > 1e-9").count() == 0 and moved.count() == pixels.count()
    assert frames.ring_map(spark, args[0], args[1], places).count() != frames.ring_map(spark, args[0], args[1]).count()
    got = [workloads.frames_to_spots(pixels, *args, residual=places, **more) for more in ({}, {"correction": fixtures.correction(spark)})]
    monkeypatch.setattr(frames, "RESIDUAL_ROWS", 0)
    joined = [workloads.frames_to_spots(pixels, *args, residual=places, **more) for more in ({}, {"correction": fixtures.correction(spark)})]
    for a, b in zip(got, joined, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
