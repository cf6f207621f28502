"""Registered queries: operators over the driver's tables, and SQL that gives the same rows.

Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import beamcenter_from, omega, patch_grid, patch_pixel_to_detector, rotation, yz_from_reta
from ..functions.shapes import gaussian2d, lorentzian2d, pseudo_voigt
from ..operators import bank, frames, peaks, pixels, spots, superres, synth, training
from ..sources import fixtures as fx
from ..sources import layout
from . import workloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
P = fx.PARAMS


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """F.round() goes by way of decimal text, which for large results took longer than all else. Values that are far from a
    tie, and from the end of a double's whole numbers, are rounded as whole numbers, to the same doubles."""

    def to(c: str) -> Column:
        v, scale = F.col(c), float(10**places)
        up = F.abs(v) * scale + 0.5
        away = up - F.floor(up)
        quick = (up < 1e9) & (away > 1e-6) & (away < 1 - 1e-6)
        return F.when(quick, F.floor(up) / scale * F.when(v < 0, -1.0).otherwise(1.0)).otherwise(F.round(v, places)).alias(c)

    return df.select(*[to(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


_m = rotation(P["tx"], P["ty"], P["tz"])
_lab = ", ".join(f"({_m[i][1]!r})::DOUBLE*(48.25-y)*200.0 + ({_m[i][2]!r})::DOUBLE*(z-47.75)*200.0 AS {n}l" for i, n in enumerate("xyz"))
_p = P["p"]
_term = lambda a, n, k, ph: f"({_p[a]!r})::DOUBLE*pow(n,{n})" + (f"*cos({k}*t+radians(({_p[ph]!r})::DOUBLE))" if k else "")
_dist = " + ".join(["1.0", _term(0, 2, 2, 6), _term(1, 4, 4, 3), _term(2, 2, 0, 0), _term(4, 6, 0, 0), _term(5, 4, 0, 0), _term(7, 4, 1, 8), _term(9, 3, 3, 10), _term(11, 5, 5, 12), _term(13, 6, 6, 14)])
_ring = "CASE " + " ".join(f"WHEN abs(radius_px-{r})<=3.0 THEN {k}" for k, r in reversed(list(enumerate(fx.RINGS)))) + " ELSE -1 END"
_thresh = " OR ".join(f"(ring_idx={k} AND intensity>={t})" for k, t in enumerate(fx.THRESH))


def ringed(source: str) -> str:
    """CTEs that add radius_px and ring_idx to a relation with z, y."""
    return f"""lab AS (SELECT *, {_lab} FROM {source}), polar AS (SELECT *, 1000000.0/(1000000.0+xl)*sqrt(yl*yl+zl*zl) AS r0,
  (CASE WHEN yl>0 THEN -1 ELSE 1 END)*degrees(acos(zl/sqrt(yl*yl+zl*zl))) AS e0 FROM lab),
  turned AS (SELECT *, r0/19200.0 AS n, radians(90-e0) AS t FROM polar), ring AS (SELECT *, r0*({_dist})/200.0 AS radius_px FROM turned),
  ringed AS (SELECT *, {_ring} AS ring_idx FROM ring)"""


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.good_pixels(fx.pixels(spark, sf_dir), P, fx.RINGS, fx.THRESH)


GOOD = (fx.PIXELS, ringed("pixels"), f"good AS (SELECT * FROM ringed WHERE {_thresh})")


@query("SELECT frame_id, ring_idx, count(*) AS n_pixels, sum(intensity) AS isum, max(intensity) AS imax, CAST((arg_min(z*1000+y, (-intensity, z, y))) // 1000 AS BIGINT) AS z_max, CAST((arg_min(z*1000+y, (-intensity, z, y))) % 1000 AS BIGINT) AS y_max FROM good GROUP BY 1, 2", *GOOD)
def ring_summary(spark, sf_dir):
    return rounded(frames.ring_summary(good(spark, sf_dir)))


@query("SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(ring_idx AS BIGINT) AS ring_idx, frames, isum FROM (SELECT z, y, ring_idx, count(DISTINCT frame_id) AS frames, sum(intensity) AS isum FROM ringed WHERE ring_idx >= 0 GROUP BY 1, 2, 3)", fx.PIXELS, ringed("pixels"))
def ring_map_coverage(spark, sf_dir):
    """Frames and intensity on each pixel of the ring map."""
    sums = fx.pixels(spark, sf_dir).groupBy("z", "y").agg(F.count_distinct("frame_id").alias("frames"), F.sum("intensity").alias("isum"))
    return rounded(frames.ring_map(spark, P, fx.RINGS).join(sums, ["z", "y"]))


_SHIFTED = (fx.PIXELS, ringed("pixels").replace(")/200.0 AS radius_px", ")/200.0 + CASE WHEN (z+y) % 5 = 0 THEN 0.0 ELSE ((z*7+y*3) % 9 - 4) * 0.75 END AS radius_px"), GOOD[-1])


@query("SELECT frame_id, ring_idx, count(*) AS n_pixels, sum(intensity) AS isum, round(sum(radius_px), 4) AS radii FROM good GROUP BY 1, 2", *_SHIFTED)
def residual_rings(spark, sf_dir):
    """Pixels on rings where a residual map moves radii by up to three pixels; a fifth of all places isn't in the map."""
    places = spark.range(fx.SIDE**2).selectExpr("cast(id div 96 as int) as z", "cast(id % 96 as int) as y").where("(z + y) % 5 <> 0")
    rows = frames.good_pixels(fx.pixels(spark, sf_dir), P, fx.RINGS, fx.THRESH, places.selectExpr("z", "y", "((z*7 + y*3) % 9 - 4) * 0.75D as residual"))
    return rounded(rows.groupBy("frame_id", "ring_idx").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("intensity").alias("isum"), F.sum("radius_px").alias("radii")), 4)


@query("SELECT frame_id - 2 AS frame_id, frame_id AS frame_orig, CAST(95 - y AS BIGINT) AS z, CAST(z AS BIGINT) AS y, intensity FROM pixels WHERE frame_id >= 2", fx.PIXELS)
def skipped_and_turned(spark, sf_dir):
    """Mirrored columns, then transposed."""
    rows = frames.image_transform(frames.skip_frames(fx.pixels(spark, sf_dir), 2), [1, 3], fx.SIDE, fx.SIDE)
    return rounded(rows.select("frame_id", "frame_orig", "z", "y", "intensity"))


@query("""SELECT frame_id, CAST(p.z AS BIGINT) AS z, CAST(p.y AS BIGINT) AS y, round(CASE WHEN mask > 0 THEN 0.0 WHEN (intensity-dark)/flood*1.5 = 30.0 THEN 0.0 ELSE (intensity-dark)/flood*1.5 END, 6) AS intensity
  FROM pixels p JOIN correction c ON p.z = c.z AND p.y = c.y""", fx.PIXELS, fx.CORRECTION)
def corrected_pixels(spark, sf_dir):
    return rounded(frames.correct_pixels(fx.pixels(spark, sf_dir), fx.correction(spark), 1.5, 30.0).drop("scan_id"))


@query("SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, round(avg(intensity), 6) AS dark FROM pixels GROUP BY 1, 2", fx.PIXELS)
def dark_means(spark, sf_dir):
    return rounded(frames.dark_mean(fx.pixels(spark, sf_dir).withColumnRenamed("intensity", "value")).drop("scan_id"))


@query("SELECT frame_id, count(*) AS n, sum(CASE WHEN intensity < 25 THEN 0 ELSE intensity END) AS isum FROM pixels GROUP BY 1", fx.PIXELS)
def thresholded_frames(spark, sf_dir):
    return rounded(frames.threshold_frames(fx.pixels(spark, sf_dir), 25).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("isum")))


_COMPONENT = """bright AS (SELECT frame_id, z, y, intensity, z*96+y AS id FROM good WHERE intensity > 0),
  near AS (SELECT a.frame_id, a.id AS a, b.id AS b FROM bright a JOIN bright b ON a.frame_id=b.frame_id AND b.z BETWEEN a.z-1 AND a.z+1 AND b.y BETWEEN a.y-1 AND a.y+1 AND a.id<>b.id),
  walk AS (SELECT frame_id, id, id AS root FROM bright UNION SELECT n.frame_id, n.b, w.root FROM walk w JOIN near n ON n.frame_id=w.frame_id AND n.a=w.id WHERE w.root < n.b),
  spot AS (SELECT b.*, r.root FROM bright b JOIN (SELECT frame_id, id, min(root) AS root FROM walk GROUP BY 1, 2) r ON r.frame_id=b.frame_id AND r.id=b.id)"""
_STATS = """stats AS (SELECT frame_id, root, count(*) AS n_pixels, sum(intensity) AS isum, max(intensity) AS imax, arg_min(z, (-intensity, z, y)) AS z_peak, arg_min(y, (-intensity, z, y)) AS y_peak,
  min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y FROM spot GROUP BY 1, 2)"""
SPOTS = tuple(x if k else "RECURSIVE " + x for k, x in enumerate((*GOOD, _COMPONENT, _STATS)))


def labelled(spark, sf_dir):
    return workloads.frames_to_spots(fx.pixels(spark, sf_dir), P, fx.RINGS, fx.THRESH)


@query("SELECT frame_id, n_pixels, isum, imax, CAST(z_peak AS BIGINT) AS z_peak, CAST(y_peak AS BIGINT) AS y_peak, CAST(min_z AS BIGINT) AS min_z, CAST(max_z AS BIGINT) AS max_z, CAST(min_y AS BIGINT) AS min_y, CAST(max_y AS BIGINT) AS max_y FROM stats", *SPOTS)
def spot_statistics(spark, sf_dir):
    return rounded(spots.spot_stats(labelled(spark, sf_dir)).drop("scan_id", "spot_id"))


@query("SELECT s.frame_id, s.spot_id, CAST(b.z AS BIGINT) AS z, CAST(b.y AS BIGINT) AS y FROM spot b JOIN (SELECT frame_id, root, row_number() OVER (PARTITION BY frame_id ORDER BY root) AS spot_id FROM stats) s ON s.frame_id=b.frame_id AND s.root=b.root", *SPOTS)
def tiled_spots(spark, sf_dir):
    """Every pixel's spot, labelled in bands of 16 rows."""
    rows = workloads.frames_to_spots(fx.pixels(spark, sf_dir), P, fx.RINGS, fx.THRESH, tile_rows=16)
    return rounded(rows.select("frame_id", "spot_id", "z", "y"))


_MOVED = """moved AS (SELECT p.frame_id-2 AS frame_id, 95-p.y AS z, p.z AS y, (intensity-dark)/flood*1.5 AS v FROM pixels p JOIN correction c ON p.z=c.z AND p.y=c.y WHERE frame_id >= 2),
  fixed AS (SELECT m.frame_id, m.z, m.y, CASE WHEN mask > 0 OR v = 30.0 THEN 0.0 ELSE v END AS intensity FROM moved m JOIN correction c ON m.z=c.z AND m.y=c.y)"""
ORIENTED = tuple(x if k else "RECURSIVE " + x for k, x in enumerate((fx.PIXELS, fx.CORRECTION, _MOVED, ringed("fixed"), GOOD[-1], _COMPONENT, _STATS)))


@query("""SELECT frame_id, round(CASE WHEN (frame_id+2) % 2 = 0 THEN (frame_id+2)*1.5 ELSE -180 + 0.25*(frame_id+2) END, 6) AS omega, n_pixels, round(isum, 4) AS isum, round(imax, 4) AS imax,
  CAST(z_peak AS BIGINT) AS z_peak, CAST(y_peak AS BIGINT) AS y_peak FROM stats""", *ORIENTED)
def oriented_spots(spark, sf_dir):
    """Spots of frames skipped, corrected and turned; dark and flood turn, the mask doesn't; omega by the original frame."""
    rows = fx.pixels(spark, sf_dir)
    found = spots.spot_stats(workloads.frames_to_spots(rows, P, fx.RINGS, fx.THRESH, fx.correction(spark), 1.5, 30.0, skip=2, transform=(1, 3)))
    known = rows.where("frame_id % 2 = 0").selectExpr("frame_id as frame_idx", "frame_id*1.5D as omega").distinct()
    found = omega(found.withColumn("frame_orig", F.col("frame_id") + 2), "frame_orig", -180, 0.25, known)
    return rounded(found.select("frame_id", "omega", "n_pixels", "isum", "imax", "z_peak", "y_peak"), 4)


@query("""SELECT s.frame_id, CAST(z_peak-10 AS BIGINT) AS z00, CAST(y_peak-10 AS BIGINT) AS y00, CAST(s.z-z_peak+10 AS BIGINT) AS row, CAST(s.y-y_peak+10 AS BIGINT) AS col, s.intensity AS v FROM spot s JOIN stats t ON s.frame_id=t.frame_id AND s.root=t.root
  WHERE n_pixels >= 3 AND z_peak-10 >= 0 AND z_peak-10 < 76 AND y_peak-10 >= 0 AND y_peak-10 < 76 AND s.z BETWEEN z_peak-10 AND z_peak+9 AND s.y BETWEEN y_peak-10 AND y_peak+9""", *SPOTS)
def spot_patches(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(spots.extract_patches(rows, spots.patch_origins(spots.spot_stats(rows), 20, fx.SIDE, fx.SIDE, 3), 20).drop("scan_id", "spot_id"))


@query("""SELECT s.frame_id, CAST(z_peak AS BIGINT) AS z_peak, CAST(y_peak AS BIGINT) AS y_peak, sum(s.intensity) AS patch_isum, max(s.intensity) AS raw_imax FROM spot s JOIN stats t ON s.frame_id=t.frame_id AND s.root=t.root
  WHERE s.z BETWEEN z_peak-10 AND z_peak+9 AND s.y BETWEEN y_peak-10 AND y_peak+9 AND z_peak BETWEEN 10 AND 85 AND y_peak BETWEEN 10 AND 85 GROUP BY 1, 2, 3, s.root""", *SPOTS)
def patch_arrays(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    cut = spots.extract_patches(rows, spots.patch_origins(spots.spot_stats(rows), 20, fx.SIDE, fx.SIDE), 20)
    arrays = spots.to_arrays(cut, [*spots.SPOT, "z00", "y00"], 20)
    return rounded(arrays.select("frame_id", (F.col("z00") + 10).alias("z_peak"), (F.col("y00") + 10).alias("y_peak"), spots.patch_sum(F.col("px")).alias("patch_isum"), spots.patch_max(F.col("px")).alias("raw_imax")))


@query()
def frames_to_peaks_com(spark, sf_dir):
    """The whole first workload by centres of mass."""
    return workloads.frames_to_peaks(labelled(spark, sf_dir), P, method="com", omega_start=-180, omega_step=0.25).drop("patch_id")


@query()
def frames_to_peaks_fit(spark, sf_dir):
    """The same by fitted shapes."""
    return workloads.frames_to_peaks(labelled(spark, sf_dir), P, method="pv", omega_start=-180, omega_step=0.25).drop("patch_id")


@query()
def frames_to_peaks_bounded(spark, sf_dir):
    """The same by bounded least-squares fits, single peaks by centres of mass."""
    return workloads.frames_to_peaks(labelled(spark, sf_dir), P, method="auto", omega_start=-180, omega_step=0.25).drop("patch_id")


@query("SELECT patch_id, CAST(row//2 AS BIGINT) AS row, CAST(col//2 AS BIGINT) AS col, sum(v) AS v FROM cells GROUP BY ALL", fx.CELLS)
def downscaled(spark, sf_dir):
    return rounded(pixels.downscale(fx.cells(spark, sf_dir), 2, 8))


@query("SELECT patch_id, CAST(row*2+i//2 AS BIGINT) AS row, CAST(col*2+i%2 AS BIGINT) AS col, round(v/4.0, 6) AS v FROM cells, range(4) t(i)", fx.CELLS)
def upscaled(spark, sf_dir):
    return rounded(pixels.upscale(fx.cells(spark, sf_dir), 2))


@query("SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v/(CASE WHEN m=0 THEN 1 ELSE m END), 6) AS v FROM (SELECT *, max(v) OVER (PARTITION BY patch_id) AS m FROM cells)", fx.CELLS)
def normalized(spark, sf_dir):
    return rounded(pixels.normalize_by_max(fx.cells(spark, sf_dir)))


@query("SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v*100.0/nullif(s, 0), 6) AS v FROM (SELECT *, sum(v) OVER (PARTITION BY patch_id) AS s FROM cells)", fx.CELLS)
def rescaled(spark, sf_dir):
    return rounded(pixels.rescale_to_sum(fx.cells(spark, sf_dir).withColumn("to", F.lit(100.0)), "to").drop("to"))


@query("""SELECT patch_id, round(CASE WHEN m=0 THEN 4.0 ELSE mr/nullif(m, 0) END, 6) AS row, round(CASE WHEN m=0 THEN 4.0 ELSE mc/nullif(m, 0) END, 6) AS col FROM (SELECT patch_id, sum(w) AS m, sum(w*row) AS mr, sum(w*col) AS mc
  FROM (SELECT *, CASE WHEN v < 0.7*max(v) OVER (PARTITION BY patch_id) THEN 0.0 ELSE v END AS w FROM cells) GROUP BY 1)""", fx.CELLS)
def centroids(spark, sf_dir):
    return rounded(pixels.centroid(fx.cells(spark, sf_dir), 0.7, 8, 8))


@query("SELECT patch_id, CAST(arg_min(row, (-v, row, col)) AS BIGINT) AS row, CAST(arg_min(col, (-v, row, col)) AS BIGINT) AS col, max(v) AS v FROM cells GROUP BY 1", fx.CELLS)
def brightest_pixels(spark, sf_dir):
    return rounded(pixels.max_px_loc(fx.cells(spark, sf_dir)))


@query("""SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(CASE WHEN x=0 THEN 0.0 ELSE (x-lo)/nullif(hi-lo, 0) END, 6) AS r FROM (
  SELECT *, min(CASE WHEN x<>0 THEN x END) OVER (PARTITION BY patch_id) AS lo, max(CASE WHEN x<>0 THEN x END) OVER (PARTITION BY patch_id) AS hi FROM (SELECT *, CASE WHEN v=0 THEN 0.0 ELSE sqrt((row+1)*(row+1)+(col+2)*(col+2)) END AS x FROM cells))""", fx.CELLS)
def scaled_channel(spark, sf_dir):
    rows = fx.cells(spark, sf_dir).withColumn("r", F.sqrt((F.col("row") + 1) * (F.col("row") + 1) + (F.col("col") + 2) * (F.col("col") + 2)))
    return rounded(pixels.min_max_nonzero(rows, "r").drop("v"))


_MAXIMA = """maxima AS (SELECT patch_id, row, col, v FROM (SELECT c.*, max(c.v) OVER (PARTITION BY c.patch_id) AS top FROM cells c) c WHERE v > 0 AND v > 0.3*top
  AND v = (SELECT max(v) FROM cells n WHERE n.patch_id=c.patch_id AND n.row BETWEEN c.row-1 AND c.row+1 AND n.col BETWEEN c.col-1 AND c.col+1)),
  found AS (SELECT * FROM maxima m WHERE row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM maxima n WHERE n.patch_id=m.patch_id AND n.v=m.v
  AND ((n.row=m.row AND n.col=m.col-1) OR (n.row=m.row-1 AND n.col BETWEEN m.col-1 AND m.col+1))))"""
_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY v DESC, row, col) AS peak_no FROM found),
  tops AS (SELECT * FROM ranked WHERE peak_no <= 5 UNION ALL SELECT patch_id, arg_min(row, (-v, row, col)), arg_min(col, (-v, row, col)), max(v), 1 FROM cells WHERE patch_id NOT IN (SELECT patch_id FROM found) GROUP BY 1)"""


def maxima(spark, sf_dir):
    return peaks.local_maxima(fx.patches(spark, sf_dir), 1, 0.3)


@query("SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v FROM found", fx.CELLS, _MAXIMA)
def local_maxima(spark, sf_dir):
    return rounded(maxima(spark, sf_dir))


_SPACED = """coarse AS (SELECT patch_id, row, col, floor(v/64)*64 AS v FROM cells), near AS (SELECT *, max(v) OVER (PARTITION BY patch_id) AS top, min(v) OVER (PARTITION BY patch_id) AS least, (SELECT max(v) FROM coarse n WHERE n.patch_id=c.patch_id AND n.row BETWEEN c.row-2 AND c.row+2 AND n.col BETWEEN c.col-2 AND c.col+2) AS around FROM coarse c),
  best AS (SELECT patch_id, row, col, v FROM near WHERE v = around AND v > greatest(least, 0.3*top) AND row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5),
  kept AS (SELECT patch_id, unnest(list_reduce(list([[CAST(row AS BIGINT), CAST(col AS BIGINT)]] ORDER BY v DESC, row, col),
    lambda a, x: CASE WHEN len(list_filter(a, lambda k: greatest(abs(k[1]-x[1][1]), abs(k[2]-x[1][2])) < 2)) = 0 THEN list_concat(a, x) ELSE a END)) AS k FROM best GROUP BY 1)"""


@query("SELECT k.patch_id, k[1] AS row, k[2] AS col, c.v FROM kept k JOIN coarse c ON c.patch_id=k.patch_id AND c.row=k[1] AND c.col=k[2]", fx.CELLS, _SPACED)
def spaced_maxima(spark, sf_dir):
    """The rule of the unbatched path, on patches in steps of 64, so that plateaus occur."""
    coarse = fx.patches(spark, sf_dir).withColumn("px", F.transform("px", lambda v: F.floor(v / 64) * 64.0))
    return rounded(peaks.local_maxima(coarse, 2, 0.3, rule="spaced"))


@query("SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v, peak_no FROM tops", fx.CELLS, _MAXIMA, _TOP)
def top_peaks(spark, sf_dir):
    return rounded(peaks.top_peaks(maxima(spark, sf_dir), fx.cells(spark, sf_dir)))


@query("SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v FROM found WHERE row BETWEEN 2.5 AND 5.5 AND col BETWEEN 2.5 AND 5.5", fx.CELLS, _MAXIMA)
def edge_filtered(spark, sf_dir):
    return rounded(peaks.edge_filter(maxima(spark, sf_dir), 8, 1))


_COM = """com AS (SELECT patch_id, peak_no, r0 + CASE WHEN m=0 THEN (h+1)/2 ELSE mr/nullif(m, 0) END AS row, c0 + CASE WHEN m=0 THEN (l+1)/2 ELSE mc/nullif(m, 0) END AS col FROM (
  SELECT patch_id, peak_no, r0, c0, sum(w) AS m, sum(w*rt) AS mr, sum(w*ct) AS mc, max(rt) AS h, max(ct) AS l FROM (SELECT *, CASE WHEN v < 0.7*max(v) OVER (PARTITION BY patch_id, peak_no) THEN 0.0 ELSE v END AS w FROM (
  SELECT t.patch_id, t.peak_no, t.row-2 AS r0, t.col-2 AS c0, c.v, c.row-greatest(t.row-2, 0) AS rt, c.col-greatest(t.col-2, 0) AS ct FROM tops t JOIN cells c ON c.patch_id=t.patch_id AND c.row BETWEEN t.row-2 AND t.row+1 AND c.col BETWEEN t.col-2 AND t.col+1))
  GROUP BY 1, 2, 3, 4))"""


@query("SELECT patch_id, peak_no, round(row, 6) AS row, round(col, 6) AS col FROM com", fx.CELLS, _MAXIMA, _TOP, _COM)
def centres_of_mass(spark, sf_dir):
    found = peaks.top_peaks(maxima(spark, sf_dir), fx.cells(spark, sf_dir))
    return rounded(peaks.com_peaks(fx.patches(spark, sf_dir).join(peaks.listed(found), "patch_id"), 4))


_HALF = "half AS (SELECT patch_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, v, CAST(1 + col // 4 AS INT) AS peak_no FROM cells WHERE v > 0)"


def halves(spark, sf_dir):
    """Stands in for watershed regions where SQL has to follow: the left and right half of a patch."""
    return fx.cells(spark, sf_dir).where("v > 0").withColumn("peak_no", F.expr("cast(1 + col div 4 as int)"))


@query("SELECT patch_id, CAST(peak_no AS BIGINT) AS peak_no, sum(v) AS isum, count(*) AS n_pixels FROM half GROUP BY 1, 2", fx.CELLS, _HALF)
def region_statistics(spark, sf_dir):
    return rounded(peaks.watershed_stats(halves(spark, sf_dir)))


@query("""SELECT patch_id, CAST(peak_no AS BIGINT) AS peak_no, integrated_intensity, nr_pixels, imax, round(ycen, 6) AS ycen, round(zcen, 6) AS zcen, CAST(y00+pc AS BIGINT) AS max_y, CAST(z00+pr AS BIGINT) AS max_z,
  round(sqrt((ycen-48.25)*(ycen-48.25)+(zcen-47.75)*(zcen-47.75)), 6) AS radius, round((CASE WHEN ycen<48.25 THEN -1 ELSE 1 END)*degrees(acos((zcen-47.75)/sqrt((ycen-48.25)*(ycen-48.25)+(zcen-47.75)*(zcen-47.75)))), 6) AS eta FROM (
  SELECT p.*, t.row/2.0+z00-0.25 AS zcen, t.col/2.0+y00-0.25 AS ycen FROM (SELECT patch_id, peak_no, patch_id % 80 AS z00, patch_id % 70 AS y00, sum(v) AS integrated_intensity, count(*) FILTER (v > 0.01) AS nr_pixels, max(v) AS imax, arg_min(pr, (-v, pr, pc)) AS pr, arg_min(pc, (-v, pr, pc)) AS pc
  FROM (SELECT patch_id, peak_no, row//2 AS pr, col//2 AS pc, sum(v) AS v FROM half GROUP BY ALL) GROUP BY 1, 2) p JOIN (SELECT patch_id, peak_no, avg(row) AS row, avg(col) AS col FROM half GROUP BY 1, 2) t ON p.patch_id=t.patch_id AND p.peak_no=t.peak_no)""", fx.CELLS, _HALF)
def peak_summaries(spark, sf_dir):
    rows = halves(spark, sf_dir)
    centres = rows.groupBy("patch_id", "peak_no").agg(F.avg("row").alias("row"), F.avg("col").alias("col"))
    info = rows.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.max("v").alias("raw_imax"), F.sum("v").alias("isum")).withColumns({"z00": F.col("patch_id") % 80, "y00": F.col("patch_id") % 70, "n_peaks": F.lit(2)})
    out = peaks.peak_summary(rows, centres, info, 2, fx.YBC, fx.ZBC)
    return rounded(out.select("patch_id", "peak_no", "integrated_intensity", "nr_pixels", "imax", "ycen", "zcen", "max_y", "max_z", "radius", "eta"))


@query("SELECT patch_id, round(sqrt(avg((c.v-e.v)*(c.v-e.v))), 6) AS fit_rmse FROM cells c JOIN (SELECT patch_id-1 AS patch_id, row, col, v FROM cells) e USING (patch_id, row, col) GROUP BY 1", fx.CELLS)
def fit_errors(spark, sf_dir):
    shifted = fx.cells(spark, sf_dir).withColumn("patch_id", F.col("patch_id") - 1)
    return rounded(peaks.fit_rmse(fx.cells(spark, sf_dir), shifted))


@query("SELECT peak_id, round(48.25+radius*sin(radians(eta)), 6) AS y, round(47.75+radius*cos(radians(eta)), 6) AS z, round(ycen-radius*sin(radians(eta)), 6) AS ybc, round(zcen-radius*cos(radians(eta)), 6) AS zbc, round(radius, 6) AS radius, round(eta, 6) AS eta FROM peaks", fx.PEAKS)
def coordinates(spark, sf_dir):
    rows = fx.peaks(spark, sf_dir)
    y, z = yz_from_reta(F.col("radius"), F.col("eta"), fx.YBC, fx.ZBC)
    yb, zb = beamcenter_from(F.col("ycen"), F.col("zcen"), F.col("radius"), F.col("eta"))
    return rounded(rows.select("peak_id", y.alias("y"), z.alias("z"), yb.alias("ybc"), zb.alias("zbc"), "radius", "eta"))


_g = "exp(-0.5*((y-20)*{c}-(z-30)*{s})*((y-20)*{c}-(z-30)*{s})/25-0.5*((y-20)*{s}+(z-30)*{c})*((y-20)*{s}+(z-30)*{c})/49)"
_rot = {"c": "0.8660254037844387::DOUBLE", "s": "0.49999999999999994::DOUBLE"}


@query(f"""SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, round(s*exp(-0.5*((y-20)/5.0)*((y-20)/5.0)-0.5*((z-30)/7.0)*((z-30)/7.0)), 6) AS gauss, round(s/((1+((y-20)/5.0)*((y-20)/5.0))*(1+((z-30)/7.0)*((z-30)/7.0))), 6) AS lorentz,
  round(0.3*s/((1+((y-20)/6.0)*((y-20)/6.0))*(1+((z-30)/4.0)*((z-30)/4.0)))+0.7*s*exp(-0.5*((y-20)/5.0)*((y-20)/5.0)-0.5*((z-30)/7.0)*((z-30)/7.0)), 6) AS voigt, round({_g.format(**_rot)}, 6) AS turned FROM (SELECT z, y, sum(intensity) AS s FROM pixels GROUP BY 1, 2)""", fx.PIXELS)
def peak_shapes(spark, sf_dir):
    rows = fx.pixels(spark, sf_dir).groupBy("z", "y").agg(F.sum("intensity").alias("s"))
    a = (F.col("y"), F.col("z"), 20.0, 30.0)
    return rounded(rows.select("z", "y", gaussian2d(*a, 5.0, 7.0, F.col("s")).alias("gauss"), lorentzian2d(*a, 5.0, 7.0, F.col("s")).alias("lorentz"), pseudo_voigt(*a, (5.0, 7.0), 0.3, F.col("s"), (6.0, 4.0)).alias("voigt"), gaussian2d(*a, 5.0, 7.0, 1.0, 30.0).alias("turned")))


_GRID = """grid AS (SELECT p.*, CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, trunc(trunc(ycen)-2)+c.i/2.0::DOUBLE AS gy, trunc(trunc(zcen)-2)+r.i/2.0::DOUBLE AS gz FROM peaks p, range(8) r(i), range(8) c(i))"""
_POLAR = "sqrt((gy-48.25)*(gy-48.25)+(gz-47.75)*(gz-47.75))"


@query(f"SELECT peak_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, gy, gz, round({_POLAR}, 6) AS grid_r, round((CASE WHEN gy<48.25 THEN -1 ELSE 1 END)*degrees(acos((gz-47.75)/{_POLAR})), 6) AS grid_eta FROM grid", fx.PEAKS, _GRID)
def patch_grids(spark, sf_dir):
    return rounded(patch_grid(fx.peaks(spark, sf_dir), "ycen", "zcen", 4, 2, fx.YBC, fx.ZBC).select("peak_id", "row", "col", "gy", "gz", "grid_r", "grid_eta"))


@query("SELECT frame_id, peak_id, row_number() OVER (PARTITION BY frame_id ORDER BY peak_id) AS spot_id, round(coalesce(l.omega, -180 + 0.25*frame_id), 6) AS omega, round(ycen/2.0 + 7 - 0.25, 6) AS y_det FROM peaks LEFT JOIN (SELECT DISTINCT frame_id AS f, frame_id*1.5 AS omega FROM peaks WHERE frame_id % 2 = 0) l ON f = frame_id", fx.PEAKS)
def numbered_peaks(spark, sf_dir):
    rows = fx.peaks(spark, sf_dir)
    listed = rows.where("frame_id % 2 = 0").selectExpr("frame_id as frame_idx", "frame_id*1.5D as omega").distinct()
    rows = omega(peaks.spot_number(rows, order=("peak_id",)), "frame_id", -180, 0.25, listed)
    return rounded(rows.select("frame_id", "peak_id", "spot_id", "omega", patch_pixel_to_detector(F.lit(7), F.col("ycen"), 2).alias("y_det")))


@query("SELECT peak_id, round(eta, 6) AS eta FROM peaks WHERE n_peaks <= 1 AND abs(eta) > 3 AND abs(eta) < 177 AND error_reconstruction < 0.5", fx.PEAKS)
def single_peaks(spark, sf_dir):
    return rounded(bank.recon_error_filter(bank.single_peak_filter(fx.peaks(spark, sf_dir)), 0.5).select("peak_id", "eta"))


_within = lambda c, a, b: f"{c} > {a} AND {c} < {b}"


@query(f"SELECT peak_id, imax FROM peaks WHERE error_reconstruction < 0.8 AND integrated_intensity > 20 AND {_within('sigma_gr/sigma_geta', 0.1, 10)} AND {_within('sigma_lr/sigma_leta', 0.1, 10)} AND " + " AND ".join(_within(c, 0.1, 2) for c in ("sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta")), fx.PEAKS)
def quality_peaks(spark, sf_dir):
    return bank.quality_filter(fx.peaks(spark, sf_dir), 0.8, 20).select("peak_id", "imax")


_DRAWN = f"""win AS (SELECT p.*, CAST(trunc(ycen)-5+c.i AS INT) AS y, CAST(trunc(zcen)-5+r.i AS INT) AS z FROM peaks p, range(10) r(i), range(10) c(i)),
  polar AS (SELECT *, sqrt((y-48.25)*(y-48.25)+(z-47.75)*(z-47.75)) AS gr, (CASE WHEN y<48.25 THEN -1 ELSE 1 END)*degrees(acos((z-47.75)/sqrt((y-48.25)*(y-48.25)+(z-47.75)*(z-47.75)))) AS ge FROM win),
  shape AS (SELECT *, mu*imax/((1+((gr-radius)/sigma_lr)*((gr-radius)/sigma_lr))*(1+((ge-eta)/sigma_leta)*((ge-eta)/sigma_leta)))+(1-mu)*imax*exp(-0.5*((gr-radius)/sigma_gr)*((gr-radius)/sigma_gr)-0.5*((ge-eta)/sigma_geta)*((ge-eta)/sigma_geta)) AS v FROM polar),
  lifted AS (SELECT frame_id, z, y, CASE WHEN v > 0.05*max(v) OVER (PARTITION BY peak_id) THEN v+bg ELSE v END AS v FROM shape),
  drawn AS (SELECT frame_id, z, y, CASE WHEN sum(v) < 2 THEN 0.0 ELSE sum(v) END AS g FROM lifted WHERE z BETWEEN 0 AND 95 AND y BETWEEN 0 AND 95 GROUP BY 1, 2, 3)"""


@query("SELECT frame_id, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, round(g, 4) AS intensity FROM drawn", fx.PEAKS, _DRAWN)
def drawn_frames(spark, sf_dir):
    return rounded(bank.draw_frame(fx.peaks(spark, sf_dir), fx.YBC, fx.ZBC, fx.SIDE, fx.SIDE, 2.0).drop("scan_id"), 4)


@query("""SELECT p.peak_id, round(sum(abs(coalesce(d.g, 0)-coalesce(e.intensity, 0)))/nullif(sum(coalesce(e.intensity, 0)), 0), 4) AS error_reconstruction FROM peaks p, range(6) r(i), range(6) c(i)
  LEFT JOIN drawn d ON d.frame_id=p.frame_id AND d.z=CAST(trunc(p.zcen)-3+r.i AS INT) AND d.y=CAST(trunc(p.ycen)-3+c.i AS INT) LEFT JOIN pixels e ON e.frame_id=p.frame_id AND e.z=CAST(trunc(p.zcen)-3+r.i AS INT) AND e.y=CAST(trunc(p.ycen)-3+c.i AS INT) GROUP BY 1""", fx.PIXELS, fx.PEAKS, _DRAWN)
def reconstruction_errors(spark, sf_dir):
    found = fx.peaks(spark, sf_dir)
    drawn = bank.draw_frame(found, fx.YBC, fx.ZBC, fx.SIDE, fx.SIDE, 2.0)
    return rounded(bank.reconstruction_error(found, drawn, fx.pixels(spark, sf_dir), 6).drop("scan_id"), 4)


@query()
def peakbank(spark, sf_dir):
    """The second workload."""
    return workloads.peakbank(fx.peaks(spark, sf_dir), fx.pixels(spark, sf_dir), P, size=10, i_thresh=2.0, error_below=5.0)


_WINDOWS = """windows AS (SELECT p.peak_id, p.imax, p.integrated_intensity, r.no AS ring_no, row_number() OVER (PARTITION BY r.no ORDER BY peak_id)-1 AS rank, count(*) OVER (PARTITION BY r.no) AS ring_size
  FROM peaks p JOIN (VALUES (0, 12.0), (1, 20.0), (2, 28.0)) r(no, rr) ON radius > rr-2 AND radius < rr+2)"""
_h = lambda *x: "cast('0x'||substr(md5(concat_ws('|','7'," + ",".join(x) + ")),1,13) as bigint)"
_SAMPLE = f"""patch AS (SELECT i AS patch_id, 1 + {_h('i', "'n'")} % 3 AS n_peaks, {_h('i', "'ring'")} % 3 AS ring_no FROM range((SELECT count(*) FROM peaks)) t(i)),
  draws AS (SELECT p.*, s.ring_size - p.n_peaks AS rest, {_h('p.patch_id', '0')} AS a, {_h('p.patch_id', '1')} AS b, {_h('p.patch_id', '2')} AS c FROM patch p JOIN (SELECT DISTINCT ring_no, ring_size FROM windows) s USING (ring_no) WHERE s.ring_size >= p.n_peaks),
  one AS (SELECT *, a % (rest+1) AS r0 FROM draws), two AS (SELECT *, CASE WHEN b % (rest+2) = r0 THEN rest+1 ELSE b % (rest+2) END AS r1 FROM one),
  three AS (SELECT *, CASE WHEN c % (rest+3) IN (r0, r1) THEN rest+2 ELSE c % (rest+3) END AS r2 FROM two), ks AS (SELECT patch_id, ring_no, unnest([r0, r1, r2][1:n_peaks]) AS rank FROM three),
  sampled AS (SELECT ks.patch_id, ks.ring_no, w.peak_id, w.imax, w.integrated_intensity, row_number() OVER (PARTITION BY patch_id ORDER BY w.imax DESC, w.peak_id) AS k FROM ks JOIN windows w USING (ring_no, rank))"""


@query("SELECT ring_no, count(*) AS n, sum(peak_id) AS ids, sum(rank) AS ranks FROM windows GROUP BY 1", fx.PEAKS, _WINDOWS)
def ring_windows(spark, sf_dir):
    rows = synth.ring_windows(fx.peaks(spark, sf_dir), [12.0, 20.0, 28.0], 2.0)
    return rounded(rows.groupBy("ring_no").agg(F.count(F.lit(1)).alias("n"), F.sum("peak_id").alias("ids"), F.sum("rank").alias("ranks")))


def sampled(spark, sf_dir):
    """As many patches as there are peaks."""
    found = fx.peaks(spark, sf_dir)
    windows = synth.ring_windows(found, [12.0, 20.0, 28.0], 2.0)
    return synth.order_by_imax(synth.sample_ring_peaks(spark, found.count(), [1, 2, 3], windows, 3, 7))


@query("SELECT patch_id, ring_no, k, peak_id, round(greatest(least(imax, 60.0), 5.0), 6) AS imax FROM sampled", fx.PEAKS, _WINDOWS, _SAMPLE)
def sampled_peaks(spark, sf_dir):
    return rounded(sampled(spark, sf_dir).select("patch_id", "ring_no", "k", "peak_id", synth.clamp_imax(F.col("imax"), 5, 60).alias("imax")))


@query("SELECT patch_id, round(sum(integrated_intensity), 4) AS isum FROM sampled GROUP BY 1", fx.PEAKS, _WINDOWS, _SAMPLE)
def sampled_sums(spark, sf_dir):
    return rounded(synth.sampled_isum(sampled(spark, sf_dir)), 4)


@query("SELECT frame_id AS patch_id, g AS attempt, round(min(d), 6) AS least, round(max(d), 6) AS most, coalesce(min(d) > 3 AND max(d) < 60, true) AS ok FROM (SELECT a.frame_id, a.peak_id % 200 // 4 AS g, CASE WHEN a.peak_id < b.peak_id THEN sqrt((a.ycen-b.ycen)*(a.ycen-b.ycen)+(a.zcen-b.zcen)*(a.zcen-b.zcen)) END AS d FROM peaks a JOIN peaks b ON a.peak_id//4 = b.peak_id//4) GROUP BY 1, 2", fx.PEAKS)
def peak_separations(spark, sf_dir):
    rows = fx.peaks(spark, sf_dir).selectExpr("frame_id as patch_id", "(peak_id % 200) div 4 as attempt", "peak_id as k", "ycen as y", "zcen as z")
    return rounded(synth.separations(rows, 3, 60).select("patch_id", "attempt", "least", "most", "ok"))


@query("SELECT CAST(frame_id AS BIGINT) AS ring, count(*) AS n FROM peaks WHERE n_peaks = 1 GROUP BY 1 HAVING count(*) >= 60", fx.PEAKS)
def large_clusters(spark, sf_dir):
    return rounded(synth.cluster_counts(fx.peaks(spark, sf_dir).where("n_peaks = 1").withColumnRenamed("frame_id", "ring"), "ring", 60))


@query("SELECT patch_id, CAST(f AS BIGINT) AS srfac, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v/nullif(max(v) OVER (PARTITION BY patch_id, f), 0), 6) AS v FROM (SELECT *, CASE WHEN max(v) OVER (PARTITION BY patch_id, f) > 400.0/(f*f) AND v < 400.0/(f*f) THEN 0.0 ELSE v END AS v2 FROM (SELECT patch_id, f, row//(4//f) AS row, col//(4//f) AS col, sum(v) AS v FROM cells, (VALUES (1), (2), (4)) t(f) GROUP BY ALL)) t(patch_id, f, row, col, v0, v)", fx.CELLS)
def multires_cells(spark, sf_dir):
    return rounded(synth.multires_cells(fx.cells(spark, sf_dir), 4, [1, 2, 4], 8, 400.0))


@query("SELECT patch_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v FROM cells WHERE patch_id IN (SELECT patch_id FROM cells GROUP BY 1 HAVING max(v) > 300)", fx.CELLS)
def without_blank_patches(spark, sf_dir):
    rows = fx.cells(spark, sf_dir)
    return rounded(synth.drop_blank_patches({"cells": rows}, rows, 300.0)["cells"])


@query("SELECT p.patch_id, p.peak_no AS k, coalesce(sum(c.v), 0) AS around FROM tops p LEFT JOIN cells c ON c.patch_id=p.patch_id AND c.row BETWEEN p.row-2 AND p.row+1 AND c.col BETWEEN p.col-2 AND p.col+1 GROUP BY 1, 2 HAVING coalesce(sum(c.v), 0) < 900", fx.CELLS, _MAXIMA, _TOP)
def undrawn_peaks(spark, sf_dir):
    found = peaks.top_peaks(maxima(spark, sf_dir), fx.cells(spark, sf_dir)).withColumnRenamed("peak_no", "k")
    return rounded(synth.drawn_check(fx.cells(spark, sf_dir), found, 2, 900.0))


@query(f"SELECT peak_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(CASE WHEN max(v) OVER (PARTITION BY peak_id) > 3 AND v <= 3 THEN 0.0 ELSE v END, 4) AS v FROM (SELECT peak_id, row, col, CASE WHEN v > 0 THEN v+bg ELSE v END AS v FROM (SELECT *, mu*imax/((1+((gr-radius)/sigma_lr)*((gr-radius)/sigma_lr))*(1+((ge-eta)/sigma_leta)*((ge-eta)/sigma_leta)))+(1-mu)*imax*exp(-0.5*((gr-radius)/sigma_gr)*((gr-radius)/sigma_gr)-0.5*((ge-eta)/sigma_geta)*((ge-eta)/sigma_geta)) AS v FROM (SELECT *, {_POLAR} AS gr, (CASE WHEN gy<48.25 THEN -1 ELSE 1 END)*degrees(acos((gz-47.75)/{_POLAR})) AS ge FROM grid)))", fx.PEAKS, _GRID)
def drawn_patches(spark, sf_dir):
    found = fx.peaks(spark, sf_dir).withColumn("patch_id", F.col("peak_id"))
    windows = found.select("patch_id", F.col("ycen").alias("y"), F.col("zcen").alias("z"))
    return rounded(synth.draw_peaks(windows, found, 4, 2, fx.YBC, fx.ZBC, 3.0).withColumnRenamed("patch_id", "peak_id"), 4)


@query("SELECT patch_id, CAST(a.row AS BIGINT) AS row, CAST(a.col AS BIGINT) AS col, round(x, 6) AS x, b.v AS y FROM (SELECT patch_id, row//2 AS r2, col//2 AS c2, row, col, v/nullif(max(v) OVER (PARTITION BY patch_id), 0) AS x FROM (SELECT patch_id, row*2+i//2 AS row, col*2+i%2 AS col, v/4 AS v FROM (SELECT patch_id, row//2 AS row, col//2 AS col, sum(v) AS v FROM cells GROUP BY ALL), range(4) t(i))) a JOIN cells b USING (patch_id) WHERE a.row=b.row AND a.col=b.col", fx.CELLS)
def training_cells(spark, sf_dir):
    rows = fx.cells(spark, sf_dir)
    return rounded(training.training_cells(pixels.downscale(rows, 2, 8), rows, 2))


@query("SELECT patch_id, position, position < CAST(floor(0.8*n) AS BIGINT) AS train FROM (SELECT vec_id AS patch_id, row_number() OVER (ORDER BY vec_id) - 1 AS position, count(*) OVER () AS n FROM embeddings)")
def split_patches(spark, sf_dir):
    return rounded(training.train_test_split(fx.patches(spark, sf_dir).select("patch_id"), 0.8, "patch_id", bucket=128))


_PAIRS = "pairs AS (SELECT a.patch_id, a.patch_id % 4 AS epoch, a.patch_id % 12 AS batch, a.v AS truth, b.v AS pred FROM cells a JOIN (SELECT patch_id-1 AS patch_id, row, col, v FROM cells) b USING (patch_id, row, col))"


def pairs(spark, sf_dir):
    rows = fx.patches(spark, sf_dir)
    both = training.training_pair(rows, rows.withColumn("patch_id", F.col("patch_id") - 1))
    return both.select("patch_id", (F.col("patch_id") % 4).alias("epoch"), (F.col("patch_id") % 12).alias("batch"), F.explode(F.arrays_zip(F.col("x").alias("t"), F.col("y").alias("p"))).alias("c")).select("patch_id", "epoch", "batch", F.col("c.t").alias("truth"), F.col("c.p").alias("pred"))


@query("SELECT epoch, round(avg(abs(truth-pred)), 6) AS mean_error, round(quantile_cont(abs(truth-pred), 0.5), 6) AS p50, round(quantile_cont(abs(truth-pred), 0.75), 6) AS p75, round(quantile_cont(abs(truth-pred), 0.95), 6) AS p95, round(quantile_cont(abs(truth-pred), 0.995), 6) AS p99_5 FROM pairs GROUP BY 1", fx.CELLS, _PAIRS)
def error_statistics(spark, sf_dir):
    return rounded(training.error_stats(pairs(spark, sf_dir), ["epoch"], accuracy=None))


@query("SELECT epoch, round(avg(m), 4) AS mse, round(avg(a), 4) AS mae FROM (SELECT epoch, batch, avg((truth-pred)*(truth-pred)) AS m, avg(abs(truth-pred)) AS a FROM pairs GROUP BY 1, 2) GROUP BY 1", fx.CELLS, _PAIRS)
def epoch_losses(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return rounded(training.epoch_loss(rows, "mse").withColumnRenamed("loss", "mse").join(training.epoch_loss(rows, "mae").withColumnRenamed("loss", "mae"), "epoch"), 4)


@query("SELECT trial, count(*) AS n_epochs, min(val_loss) AS best_loss, arg_min(epoch, (val_loss, epoch)) AS best_epoch FROM history GROUP BY 1", fx.HISTORY)
def best_epochs(spark, sf_dir):
    return rounded(training.best_epoch(fx.history(spark, sf_dir)))


@query("SELECT trial, count(*) AS n_epochs, min(val_loss) AS best_loss, arg_min(epoch, (val_loss, epoch)) AS best_epoch FROM history GROUP BY 1 ORDER BY 3, 1 LIMIT 1", fx.HISTORY)
def best_trial(spark, sf_dir):
    return rounded(training.best_trial(fx.history(spark, sf_dir)))


@query("""SELECT trial, min(CASE WHEN k - last >= 4 THEN epoch END) AS stop_epoch FROM (SELECT *, max(CASE WHEN better THEN k END) OVER (PARTITION BY trial ORDER BY epoch) AS last FROM (
  SELECT *, row_number() OVER (PARTITION BY trial ORDER BY epoch) AS k, coalesce(val_loss < min(val_loss) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM history)) GROUP BY 1""", fx.HISTORY)
def early_stops(spark, sf_dir):
    return rounded(training.early_stop_epoch(fx.history(spark, sf_dir), 4))


@query("SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'Valid' ELSE 'Train' END AS split, o_orderkey AS epoch, (o_orderkey % 10000)/10000.0::DOUBLE AS error FROM orders")
def log_errors(spark, sf_dir):
    return training.errors_from_log(fx.log_lines(spark, sf_dir))


@query("SELECT p_partkey AS model, l AS layer, CASE WHEN l = 0 THEN 1 ELSE 8 END AS in_ch, CASE WHEN l = 0 THEN 8 ELSE 1 END AS out_ch, CASE WHEN l = 0 THEN 3 + 2*(p_partkey % 3) ELSE 3 END AS ksize, CASE WHEN l = 0 THEN 'r' ELSE 's' END AS act FROM part, range(2) t(l)")
def model_layers(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr("p_partkey as model", "concat('8-', 3 + 2*(p_partkey % 3), '-r_1-3-s') as arch")
    return rounded(superres.arch_parse(rows))


@query("SELECT frame_id, count(*) AS n FROM peaks WHERE frame_id % 3 <> 0 GROUP BY 1", fx.PEAKS)
def pending_frames(spark, sf_dir):
    rows = fx.peaks(spark, sf_dir)
    return layout.pending_frames(rows, rows.where("frame_id % 3 = 0")).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


_FRAMES = "frames AS (SELECT i AS frame_id FROM range((SELECT max(event_id // 200) + 3 FROM events)) t(i))"


def all_frames(spark, sf_dir):
    """Two frames more than have peaks."""
    last = fx.peaks(spark, sf_dir).agg(F.max("frame_id").alias("m"))
    return last.select(F.explode(F.sequence(F.lit(0), F.col("m") + 2)).alias("frame_id"))


@query("SELECT f.frame_id, coalesce(n, 0) AS n_peaks, 4 + 12*count(*) OVER () + coalesce(sum(coalesce(n, 0)*232) OVER (ORDER BY f.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset, coalesce(n, 0)*232 AS bytes FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS n FROM peaks WHERE n_peaks = 1 GROUP BY 1) p ON p.frame_id=f.frame_id", fx.PEAKS, _FRAMES)
def peak_file_index(spark, sf_dir):
    return rounded(layout.consolidated_index(all_frames(spark, sf_dir), fx.peaks(spark, sf_dir).where("n_peaks = 1")))


@query("SELECT f.frame_id, coalesce(n, 0) AS n_peaks, coalesce(b, 0) AS bytes, 8 + 12*count(*) OVER () + coalesce(sum(coalesce(b, 0)) OVER (ORDER BY f.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS n, sum(4+4*(1+peak_id%9)) AS b FROM peaks GROUP BY 1) p ON p.frame_id=f.frame_id", fx.PEAKS, _FRAMES)
def pixel_file_index(spark, sf_dir):
    rows = fx.peaks(spark, sf_dir).select("frame_id", (1 + F.col("peak_id") % 9).alias("n_pixels"))
    return rounded(layout.consolidated_pixel_index(all_frames(spark, sf_dir), rows))


@query("SELECT t.patch_id, t.peak_no, count(*) AS n, sum((5+c.row)*100+7+c.col) AS places FROM tops t JOIN cells c ON c.patch_id=t.patch_id WHERE c.v <> 0 GROUP BY 1, 2", fx.CELLS, _MAXIMA, _TOP)
def peak_pixel_lists(spark, sf_dir):
    rows = fx.cells(spark, sf_dir)
    lists = layout.peak_pixel_lists(rows.withColumns({"z00": F.lit(5), "y00": F.lit(7)}), peaks.top_peaks(maxima(spark, sf_dir), rows))
    return rounded(lists.select("patch_id", "peak_no", F.explode("pixels").alias("p")).groupBy("patch_id", "peak_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p.row") * 100 + F.col("p.col")).alias("places")))


@query()
def synthetic_patches(spark, sf_dir):
    """The third workload's store; as many patches as the bank has peaks."""
    found = bank.quality_filter(fx.peaks(spark, sf_dir), 0.8, 20)
    n = found.count()
    store = workloads.patchstore(found, P, n_patches=n, n_peaks=[1, 2, 3], rings=[20.0, 28.0, 36.0], var_r=2.0, sep=(2.0, 12.0), imax=(5, 100), lrsz=20, cvsz=60, src=4, factors=[1, 2, 4], cut=1.0, seed=7)
    return store["rendered"].select("patch_id", "srfac", "side", "n_peaks", "total")


@query()
def watershed_regions(spark, sf_dir):
    found = peaks.top_peaks(maxima(spark, sf_dir), fx.cells(spark, sf_dir))
    return peaks.watershed_stats(peaks.watershed(fx.patches(spark, sf_dir).join(peaks.listed(found), "patch_id"), 0.1))


@query()
def super_resolved(spark, sf_dir):
    """A small fixed model (sharpening, then a rectifier) applied in two stages."""
    w = [0.0, -0.1, 0.0, -0.1, 1.4, -0.1, 0.0, -0.1, 0.0]
    model = spark.createDataFrame([("m", 0, 1, 1, 3, "r", w, [0.0])], "model string, layer int, in_ch int, out_ch int, ksize int, act string, w array<double>, b array<double>")
    out = superres.super_resolve(fx.patches(spark, sf_dir), model, [("m", 2), ("m", 2)], rescale_at=(4,))
    return out.select("patch_id", "srfac", "side", spots.patch_sum(F.col("px")).alias("total"), spots.patch_max(F.col("px")).alias("top"))


@query()
def ring_radii(spark, sf_dir):
    found = synth.find_ring_radii(fx.peaks(spark, sf_dir), 20)
    return found.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))


@query()
def smoothed(spark, sf_dir):
    out = peaks.smooth(fx.patches(spark, sf_dir), 1.0, 3)
    return out.select("patch_id", spots.patch_sum(F.col("px")).alias("total"))
