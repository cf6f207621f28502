"""Hand-made inputs for helpers and properties."""

import numpy as np

from diffspark.functions.shapes import pseudo_voigt_np
from diffspark.operators import peaks, spots, superres, synth
from diffspark.sources import layout


def test_labels_of_sparse_pixels():
    z, y = np.array([0, 1, 5, 5, 7]), np.array([0, 1, 4, 5, 0])
    assert spots.label_pixels(z, y).tolist() == [1, 1, 2, 2, 3]
    assert spots.label_pixels(z, y, 4).tolist() == [1, 2, 3, 3, 4]


def test_flood_splits_between_markers():
    px = np.array([[9.0, 3, 1, 4, 8]])
    assert peaks.flood(px, np.array([[1, 0, 0, 0, 2]]), px > 0).tolist() == [[1, 1, 2, 2, 2]]


def test_fit_recovers_a_peak():
    y, z = np.meshgrid(100 + np.arange(20), 200 + np.arange(20))
    r, e = np.hypot(y, z), np.degrees(np.arctan2(y, z)) * 4
    true = np.array([[r[10, 10], e[10, 10], 0.9, 0.5, 0.8, 0.6, 0.4, 900.0]])
    target = pseudo_voigt_np(r, e, true).sum(0)
    p, cost = peaks.fit_patch(target, r, e, np.array([[r[10, 10], e[10, 10], 880.0]]), 1, 0.0, steps=400)
    assert cost < 0.01 * (target**2).mean() and abs(p[0, 0] - true[0, 0]) < 0.1


def test_identity_model_raises_resolution(spark):
    model = spark.createDataFrame([("i", 0, 1, 1, 3, "n", [0.0] * 4 + [1.0] + [0.0] * 4, [0.0])], "model string, layer int, in_ch int, out_ch int, ksize int, act string, w array<double>, b array<double>")
    patch = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "patch_id long, px array<double>")
    out = superres.super_resolve(patch, model, [("i", 2)], rescale_at=(2,)).first()
    assert np.allclose(np.array(out.px).reshape(4, 4), np.kron(np.array([[1, 2], [3, 4]]) / 4, np.ones((2, 2))), atol=1e-5)


def test_placed_peaks_keep_their_limits(spark):
    patches = spark.range(20).selectExpr("id as patch_id", "20.0D as ring_r", "3 as n_peaks")
    out = synth.place_peaks(patches, 2.0, 2.0, 12.0, 48.25, 47.75, 7).toPandas()
    assert len(out) == 60 and out["ok"].all() and (abs(out["r"] - 20) < 2).all()


def test_index_of_frames_with_and_without_peaks(spark):
    frames, found = spark.range(3).toDF("frame_id"), spark.createDataFrame([(0,), (0,), (2,)], "frame_id long")
    assert [(r.n_peaks, r.offset) for r in layout.consolidated_index(frames, found).orderBy("frame_id").collect()] == [(2, 40), (0, 504), (1, 504)]


def test_entry_without_llm(spark):
    import __spark_entry__

    assert "ring_summary" in __spark_entry__.queries()


def test_synthetic_patches_cover_the_bank_and_no_crop_leaves_the_canvas(spark, data, monkeypatch):
    from pyspark.sql import functions as F

    from diffspark.operators import bank
    from diffspark.plans import queries
    from diffspark.sources import fixtures

    asked, seen, render, sample = [], [], synth.render_patches, synth.sample_ring_peaks
    monkeypatch.setattr(synth, "sample_ring_peaks", lambda spark, n, *rest: asked.append(n) or sample(spark, n, *rest))
    monkeypatch.setattr(synth, "render_patches", lambda patches, **kw: seen.append((patches, kw)) or render(patches, **kw))
    queries.QUERIES["synthetic_patches"](spark, data)
    assert asked == [bank.quality_filter(fixtures.peaks(spark, data), 0.8, 20).count()]
    # far above the cut, so that a patch can only be blank because its crop leaves the canvas
    patches, kw = seen[0]
    bright = patches.withColumn("isum", F.col("isum") * 1000).persist()
    blanks = lambda cvsz: render(bright, **{**kw, "cvsz": cvsz}).where("blank").count()
    assert blanks(kw["cvsz"]) == 0 < blanks(40)
