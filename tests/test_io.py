"""Readers and writers, resuming, ring lists and model lookup."""

import pytest
from pyspark.sql import functions as F

from diffspark.operators import frames, superres
from diffspark.plans import workloads
from diffspark.sources import fixtures, io, layout


def peak_rows(spark, *pairs):
    """Peaks of (frame_id, value) pairs, every column filled from value."""
    schema = "frame_id long, " + ", ".join(f"{c} double" for c in io.SNAKE)
    return spark.createDataFrame([(f, *[float(v + k) for k in range(29)]) for f, v in pairs], schema)


def test_peaks_of_several_scans_come_back(spark, tmp_path):
    for scan, value in (("left", 0), ("right", 100)):
        io.write_peaks(peak_rows(spark, (0, value), (0, value + 1), (2, value)), spark.range(4).toDF("frame_id"), str(tmp_path / scan))
    status = spark.read.parquet(str(tmp_path / "left/frame_status"))
    assert sorted(map(tuple, status.collect())) == [(0, 2), (1, 0), (2, 1), (3, 0)]
    got = io.read_peaks(spark, [str(tmp_path / s / "peaks") for s in ("left", "right")])
    assert sorted((r.scan_id, r.frame_id, r.spot_id, r.fit_rmse) for r in got.collect()) == sorted((s, f, v + x, v + x + 28.0) for s, x in (("left", 0), ("right", 100)) for f, v in ((0, 0), (0, 1), (2, 0)))


def test_numbered_peak_files(spark, tmp_path):
    (tmp_path / "scan7").mkdir()
    for number, rows in ((1, 2), (12, 0)):
        lines = ["\t".join(io.PEAK_COLUMNS)] + ["\t".join(str(k) for k in range(29))] * rows
        (tmp_path / f"scan7/{number:06d}_PS.csv").write_text("\n".join(lines) + "\n")
    got = io.read_peaks(spark, str(tmp_path / "scan7"))
    assert [(r.scan_id, r.frame_id, r.omega) for r in got.collect()] == [("scan7", 0, 2.0)] * 2
    assert io.read_peaks(spark, str(tmp_path / "scan7"), "s").first().scan_id == "s"


def test_resume_keeps_peaks_with_all_columns(spark):
    new, done = peak_rows(spark, (5, 1)), peak_rows(spark, (1, 2))
    assert sorted(r.frame_id for r in layout.resume(new, done.withColumn("more", F.lit(1))).collect()) == [1, 5]
    with pytest.warns(UserWarning, match="bg"):
        assert [r.frame_id for r in layout.resume(new, done.drop("bg")).collect()] == [5]
    left = layout.pending_frames(spark.createDataFrame([("a", 1), ("b", 1)], "scan_id string, frame_id long"), spark.createDataFrame([("a", 1)], "scan_id string, frame_id long"))
    assert [tuple(r) for r in left.collect()] == [("b", 1)]


def test_first_line_of_a_ring_wins(spark, tmp_path):
    (tmp_path / "hkls.csv").write_text("h RingNr Radius\n1 1 900\n2 2 500\n3 2 400\n4 3 100\n5 1 800\n")
    table = frames.ring_table(io.read_rings(spark, str(tmp_path / "hkls.csv")), [2, 1], [30.0, 20.0], 100.0)
    assert frames.ring_lists(table) == ([5.0, 9.0], [30.0, 20.0])


def test_frames_store_bank_and_outputs(spark, tmp_path):
    pixels = spark.createDataFrame([(0, 1, 2, 3.0, "a"), (1, 1, 2, 4.0, "b")], "frame_id long, z int, y int, intensity double, scan_id string")
    dark, corr = pixels.selectExpr("cast(frame_id as int) dark_no", "z", "y", "intensity as value", "scan_id"), pixels.selectExpr("z", "y", "0D dark", "1D flood", "0D mask", "scan_id")
    io.write_frames({"pixels": pixels, "dark_frames": dark, "correction": corr}, str(tmp_path / "frames"))
    back = io.read_frames(spark, str(tmp_path / "frames"))
    assert sorted(map(tuple, back["pixels"].collect())) == sorted(map(tuple, pixels.collect())) and back["correction"].count() == back["dark_frames"].count() == 2

    patches = spark.createDataFrame([(1, 2, [1.0, 0.5]), (1, 4, [0.25, 1.0])], "patch_id long, srfac int, px array<double>")
    io.write_patchstore({"patches": patches, "info": patches.select("patch_id")}, str(tmp_path / "store"), {"seed": 7})
    store = io.read_patchstore(spark, str(tmp_path / "store"))
    assert set(store) == {"patches", "info", "args"} and dict(store["patches"].dtypes)["px"] == "array<float>"
    assert set(io.read_patchstore(spark, str(tmp_path / "store"), only_patch_arrays=True)) == {"patches"}
    assert [tuple(r) for r in store["args"].collect()] == [("seed", "7")]
    io.write_predictions(patches, str(tmp_path / "pred"))
    assert sorted(p.name for p in (tmp_path / "pred").glob("srfac=*")) == ["srfac=2", "srfac=4"]

    bank = peak_rows(spark, (0, 1)).withColumn("peak_id", F.lit(9))
    io.write_peakbank(bank, str(tmp_path / "bank"))
    io.write_peakbank(bank, str(tmp_path / "bank_csv"), csv=True)
    assert io.read_peakbank(spark, str(tmp_path / "bank")).columns[0] == "peak_id"
    schema = "peak_id long, frame_id long, " + ", ".join(f"{c} double" for c in io.SNAKE)
    assert tuple(io.read_peakbank(spark, str(tmp_path / "bank_csv"), schema).first())[:3] == (9, 0, 1.0)

    cells = spark.createDataFrame([(1, 5, 6, 2.0), (1, 5, 6, 0.0), (2, 1, 1, 3.0)], "patch_id long, y00 int, z00 int, v double")
    info = io.patches_info(cells, spark.createDataFrame([(1,), (1,)], "patch_id long"))
    io.write_outputs({"patches_info": info}, str(tmp_path / "out"), ("patches_info",))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/patches_info")).select("patch_id", "nr_pixels_in_patch", "patches_isum", "n_peaks_in_patches").collect()) == [(1, 1, 2.0, 2), (2, 1, 3.0, 0)]


def test_unknown_model_is_an_error(spark):
    models = spark.createDataFrame([("x2", "dir", 10)], "model string, folder string, iteration int")
    assert superres.model_lookup(spark.createDataFrame([("x2",)], "model string"), models).first().folder == "dir"
    with pytest.raises(Exception, match="unknown model: x3"):
        superres.model_lookup(spark.createDataFrame([("x3",)], "model string"), models).collect()


def test_no_shuffle_before_labelling(spark, data):
    """Frames with corrections told to all tasks: one exchange, that by frame; drawing frames: one, by place."""
    from diffspark.operators import bank

    pixels = spark.createDataFrame([("s0", 0, 10, 10, 50.0)], "scan_id string, frame_id long, z int, y int, intensity double")
    plan = workloads.frames_to_spots(pixels, fixtures.PARAMS, fixtures.RINGS, fixtures.THRESH, fixtures.correction(spark), 1.5, 30.0, skip=0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text
    drawn = bank.draw_frame(fixtures.peaks(spark, data), 48.25, 47.75, 96, 96)
    assert drawn._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_flood_of_zero_and_turned_params(spark):
    pixels = spark.createDataFrame([("s", 0, 0, y, i) for y, i in enumerate((5.0, 0.0, 1.0))], "scan_id string, frame_id int, z int, y int, intensity double")
    corr = spark.createDataFrame([("s", 0, y, 1.0, 0.0, 0.0) for y in (0, 1, 2)], "scan_id string, z int, y int, dark double, flood double, mask double")
    for told in (10, 0):
        got = {r.y: r.intensity for r in frames.correct_pixels(pixels, corr, told_rows=told).collect()}
        assert got == {0: float("inf"), 1: float("-inf"), 2: None}
    assert workloads.turned({"height": 2, "width": 3}, (3, 1)) == {"height": 3, "width": 2}
    mask = spark.createDataFrame([("s", 0, 1, 9.0, 2.0, 1.0)], "scan_id string, z int, y int, dark double, flood double, mask double")
    assert sorted((r.z, r.y, r.dark, r.mask) for r in frames.turn_correction(mask, [3], 2, 3).fillna(-1).collect()) == [(0, 1, -1.0, 1.0), (1, 0, 9.0, -1.0)]
