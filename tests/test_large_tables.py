"""What only shows on tables larger than those of the other tests."""

import duckdb
import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from diffspark.functions.geometry import patch_grid
from diffspark.functions.shapes import pseudo_voigt, pseudo_voigt_np
from diffspark.operators import peaks, synth
from diffspark.plans.queries import QUERIES, SQL, rounded
from diffspark.sources.staging import staged


def test_log_lines_hold_long_epochs(spark, tmp_path):
    keys = [0, 7, 99_999, 100_000, 149_999, 8_999_999, 10**12 + 3]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["log_errors"](spark, str(tmp_path)).select("split", "epoch", "error").collect())
    assert got == sorted(con.execute(SQL["log_errors"]).fetchall()) and sorted(x[1] for x in got) == keys


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_are_not_sent_through_the_driver_by_the_size_of_their_files(spark):
    """20,000 patches take 64 MB and some 100 KB of files; Spark sends files of up to 10 MB to all tasks."""
    patches = staged(spark.range(20000).selectExpr("id as patch_id", "array_repeat(0.0D, 400) as px"), "patches")
    marks = staged(spark.range(20000).selectExpr("id as patch_id", "1 as peak_no"), "marks")
    listed = marks.groupBy("patch_id").count()
    for df in (patches.join(listed, "patch_id"), patches.join(marks, "patch_id", "left"), patches.join(spark.range(20000).withColumnRenamed("id", "patch_id"), "patch_id")):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert "BroadcastHashJoin" in plan(patches.join(marks.hint("broadcast"), "patch_id"))


def test_fits_take_patches_of_as_many_peaks_together_in_small_blocks(monkeypatch):
    """Padding a batch to its largest number of peaks cost most of its time and memory."""
    seen, fit = [], peaks.fit_batch
    monkeypatch.setattr(peaks, "fit_batch", lambda x, r, e, guess, real, *rest: seen.append((real.all(), real.size * x[0].size)) or fit(x, r, e, guess, real, *rest))
    rng = np.random.default_rng(3)
    marked = [[{"peak_no": k + 1, "row": 4 + 3 * k, "col": 5 + 3 * k} for k in range(1 + n % 5)] for n in range(200)]
    px = list(rng.uniform(0, 100, (200, 400)))
    pdf = pd.DataFrame({"patch_id": range(200), "z00": 10, "y00": 20, "px": px, "native": px, "peaks": marked})

    class Batches:
        def mapInPandas(self, run, schema):
            return pd.concat(run(iter([pdf])))

    out = peaks.fit_pseudo_voigt(Batches(), 1, 48.25, 47.75, 60.0)
    assert len(out) == 600 and (out.groupby("patch_id").size() == [1 + n % 5 for n in range(200)]).all()
    assert all(full for full, _ in seen) and max(cells for _, cells in seen) <= 50_000


def test_rounding_by_whole_numbers_gives_the_same_doubles(spark):
    rng = np.random.default_rng(5)
    ties = [k / 10**p for p in (1, 2, 3, 4, 5, 6, 7) for k in range(-60, 61)] + [123.00005, 0.00015, 1.00005, 99999.99995, 2.5e-7, 5e-7]
    around = [float(np.nextafter(x, x + s)) for x in ties for s in (-1, 1)]
    ends = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), None, 5e-324, 1e300, -1e300, 2.0**53 + 2, 1e9, 123456789012.34567]
    rows = [(v,) for v in [*ties, *around, *ends, *rng.normal(0, 1e3, 3000).tolist(), *rng.uniform(0, 1e5, 3000).tolist(), *(10 ** rng.uniform(-9, 17, 2000)).tolist()]]
    df = spark.createDataFrame(rows, "v double")
    for places in (4, 6):
        got, asked = (x.toPandas()["v"].to_numpy(float) for x in (rounded(df, places), df.select(F.round("v", places).alias("v"))))
        assert ((got == asked) | (np.isnan(got) & np.isnan(asked))).all()
    assert rounded(df.where("v is null")).first().v is None


def test_points_of_windows_are_neither_shuffled_nor_sorted_and_drawn_as_by_columns(spark, monkeypatch):
    monkeypatch.setattr(synth, "DRAW_CELLS", 200)  # three windows at a time
    centres = [(n, 48.25 + 7.3 * n - 20, 30.0 + 5.1 * n) for n in range(7)] + [(7, 50.25, 50.0)]  # that of 7 has a point in the beam's centre
    windows = spark.createDataFrame(centres, "patch_id long, y double, z double")
    made = [(n, k, 1.0 * (n + k), 3.0 * n - 5, *(0.3 + 0.2 * ((n + j) % 4) for j in range(4)), (n + k) % 3 / 2, 4.0 + 30 * (n % 3), 0.5 * k) for n, _, _ in centres for k in range(1, 1 + n % 4)]
    made.append((4, 9, None, *made[0][3:]))  # adds nothing, and is all that patch 4 has
    fields = ["radius", "eta", "sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta", "mu", "imax", "bg"]
    found = spark.createDataFrame(made, "patch_id long, k int, " + ", ".join(f"{c} double" for c in fields)).withColumn("radius", F.col("radius") * 4)
    grid = patch_grid(windows, "y", "z", 4, 2, 50.0, 49.0).join(found, "patch_id")
    for two in (True, False):
        low = (F.col("sigma_lr"), F.col("sigma_leta")) if two else None
        v = pseudo_voigt(F.col("grid_r"), F.col("grid_eta"), F.col("radius"), F.col("eta"), (F.col("sigma_gr"), F.col("sigma_geta")), F.col("mu"), F.col("imax"), low)
        sums = grid.withColumn("v", v).groupBy("patch_id", "row", "col").agg(F.sum(F.when(F.col("v") > 0, F.col("v") + F.col("bg")).otherwise(F.col("v"))).alias("v")).toPandas()
        top = sums.groupby("patch_id")["v"].transform("max")
        sums.loc[(top > 3) & (sums["v"] <= 3), "v"] = 0
        out = synth.draw_peaks(windows, found, 4, 2, 50.0, 49.0, 3.0, two)
        both = sums.merge(out.toPandas(), on=["patch_id", "row", "col"], how="outer", indicator=True)
        assert (both["_merge"] == "both").all() and len(both) == 7 * 64  # patch 0 has no peak
        assert np.allclose(both["v_x"], both["v_y"], rtol=1e-12, atol=1e-12, equal_nan=True) and both["v_y"].isna().sum() == 64 and (both["v_y"] == 0).any()
    drawn = plan(QUERIES["drawn_patches"](spark, "/root/testdata/sf0.001"))
    above = drawn[: drawn.index("MapInArrow")]
    assert "Exchange" not in above and "Sort" not in above and "Window" not in above and "Broadcast" not in drawn


def test_canvases_are_those_of_the_plain_formula(monkeypatch):
    rng, n, src, ybc, zbc = np.random.default_rng(9), 64, 4, 48.25, 47.75
    room = [np.empty((n, n)) for _ in range(2)]
    for case in range(60):
        many, y, z = 1 + case % 3, *rng.integers(20, 70, 2)
        r, e = synth.polar(y + np.arange(n) / src, z + np.arange(n) / src, ybc, zbc)
        at = tuple(rng.integers(0, n, (2, many)))
        p = np.column_stack([r[at], e[at], *rng.uniform(0.2, 2, (4, many)), rng.choice([0.0, 0.1, 0.5, 0.9, 1.0], many), rng.uniform(1, 60, many)])
        if case % 10 == 9:  # odd ones
            p[0, [2, 6, 7][case // 10 % 3]] = [0.0, 1.5, -3.0][case // 10 % 3]
        bg = rng.choice([0.0, 0.2, 3.0], many)
        with np.errstate(all="ignore"):
            each = pseudo_voigt_np(r, e, p)
        expected, x = np.where(each > 0, each + bg[:, None, None], each).sum(0), np.empty((n, n))
        wide, odd = synth.kinds(p, 100.0)
        assert odd.any() == (case % 10 == 9) and (wide == ~odd & (p[:, 6] > 0)).all()
        monkeypatch.setattr(synth, "BAND_CELLS", 500 + 100 * case)
        with np.errstate(all="ignore"):
            synth.add_peaks(x, r, e, p, bg, wide, odd, (y - ybc, z - zbc), src, room)
        assert np.allclose(x, expected, rtol=1e-11, atol=1e-15, equal_nan=True), case


def test_patches_are_drawn_once_and_blank_ones_are_the_same(spark, data, monkeypatch):
    """The store's patches and information were each drawn for themselves, and joined with all their pixels."""
    whole, asked, render = {}, [], synth.render_patches
    monkeypatch.setattr(synth, "render_patches", lambda patches, **kw: asked.append((patches, kw)) or render(patches, **kw))
    out = QUERIES["synthetic_patches"](spark, data)
    drawn = plan(out)
    assert drawn.count("MapInArrow") == 1 and "Join" not in drawn[: drawn.index("MapInArrow")]
    patches, kw = asked[0]
    patches = patches.persist()
    for far in (False, True):  # True: places of no patch come from a grid of several, and no background tells a blank one
        if far:
            monkeypatch.setattr(synth, "LATTICE_CELLS", 0)
            monkeypatch.setattr(synth, "kinds", lambda p, far: (np.zeros(len(p), bool), np.ones(len(p), bool)))
        batch = patches.toArrow().combine_chunks().to_batches()

        class Batches:
            def select(self, *columns):
                return self

            def mapInArrow(self, run, schema):
                return pd.concat([x.to_pandas() for x in run(iter(batch))], ignore_index=True)

        whole[far] = render(Batches(), **kw).sort_values(["patch_id", "srfac"], ignore_index=True)
    a, b = whole[False], whole[True]
    assert (a["blank"] == b["blank"]).all() and a["blank"].any() and (a["patch_id"] == b["patch_id"]).all()
    some = ~a["blank"].astype(bool)
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(a["px"][some], b["px"][some], strict=True)) and np.allclose(a["total"][some], b["total"][some])
    got = {(r.patch_id, r.srfac): r.total for r in out.collect()}
    assert got == {(p, f): t for p, f, t in zip(a["patch_id"][some], a["srfac"][some], a["total"][some], strict=True)}
    store = dict(a[some].groupby("patch_id").size())
    assert set(store.values()) == {3}
