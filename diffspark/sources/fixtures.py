"""The driver's tables as pixels, peaks, patches, histories and logs; the SQL twins stand beside each mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, YBC, ZBC = 96, 48.25, 47.75
PARAMS = {"width": SIDE, "height": SIDE, "ybc": YBC, "zbc": ZBC, "px": 200.0, "lsd": 1e6, "tx": 0.1, "ty": 0.2, "tz": 0.3, "rho": 19200.0, "ring_width": 600.0, "p": [0.001 * (i % 3) for i in range(15)]}
RINGS, THRESH = [12.0, 20.0, 28.0, 33.0, 44.0], [10.0, 15.0, 20.0, 20.0, 25.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {"scan_id": "'s0'", "frame_id": "l_orderkey div 500", "z": "cast(l_partkey % 96 as int)", "y": "cast((l_suppkey*7 + l_linenumber*13 + l_orderkey*31) % 96 as int)"}
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", *[F.expr(v).alias(k) for k, v in place.items()])
    return rows.groupBy(*place).agg(F.sum("l_quantity").cast("double").alias("intensity"))


PIXELS = """pixels AS (SELECT l_orderkey // 500 AS frame_id, CAST(l_partkey % 96 AS INT) AS z,
  CAST((l_suppkey*7 + l_linenumber*13 + l_orderkey*31) % 96 AS INT) AS y, CAST(sum(l_quantity) AS DOUBLE) AS intensity FROM lineitem GROUP BY ALL)"""


def correction(spark: SparkSession) -> DataFrame:
    cells = spark.range(SIDE * SIDE).selectExpr("'s0' as scan_id", "cast(id div 96 as int) as z", "cast(id % 96 as int) as y")
    return cells.selectExpr("*", "cast((z + y) % 3 as double) as dark", "1 + ((z*y) % 4) / 4.0D as flood", "cast(int((z*96+y) % 97 = 0) as double) as mask")


CORRECTION = """correction AS (SELECT z, y, (z + y) % 3 AS dark, 1 + ((z*y) % 4) / 4.0::DOUBLE AS flood, CAST((z*96+y) % 97 = 0 AS INT) AS mask
  FROM (SELECT CAST(i // 96 AS INT) AS z, CAST(i % 96 AS INT) AS y FROM range(9216) t(i)))"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import reta_from_yz

    rows = table(spark, sf_dir, "events").selectExpr(
        "'s0' as scan_id", "event_id as peak_id", "event_id div 200 as frame_id", "10 + (event_id*37) % 76 + (user_id % 10)/10.0D as ycen", "10 + (event_id*53) % 76 + (user_id % 7)/7.0D as zcen",
        "cast(value + 1 as double) as imax", "cast((value + 1)*6 as double) as integrated_intensity", "0.2D + (event_id % 11)/5.0D as sigma_gr", "0.2D + (event_id % 7)/4.0D as sigma_geta",
        "0.2D + (event_id % 13)/6.0D as sigma_lr", "0.2D + (event_id % 5)/3.0D as sigma_leta", "(event_id % 10)/10.0D as mu", "cast(event_id % 4 as double) as bg", "1 + event_id % 3 as n_peaks",
        "(event_id % 100)/100.0D as error_reconstruction",
    )
    radius, eta = reta_from_yz(F.col("ycen"), F.col("zcen"), YBC, ZBC)
    return rows.withColumns({"radius": radius, "eta": eta})


PEAKS = """peaks AS (SELECT *, sqrt((ycen-48.25)*(ycen-48.25) + (zcen-47.75)*(zcen-47.75)) AS radius,
  (CASE WHEN ycen < 48.25 THEN -1 ELSE 1 END) * degrees(acos((zcen-47.75)/sqrt((ycen-48.25)*(ycen-48.25) + (zcen-47.75)*(zcen-47.75)))) AS eta FROM (
  SELECT event_id AS peak_id, event_id // 200 AS frame_id, 10 + (event_id*37) % 76 + (user_id % 10)/10.0::DOUBLE AS ycen, 10 + (event_id*53) % 76 + (user_id % 7)/7.0::DOUBLE AS zcen,
  CAST(value + 1 AS DOUBLE) AS imax, CAST((value + 1)*6 AS DOUBLE) AS integrated_intensity, 0.2::DOUBLE + (event_id % 11)/5.0::DOUBLE AS sigma_gr, 0.2::DOUBLE + (event_id % 7)/4.0::DOUBLE AS sigma_geta,
  0.2::DOUBLE + (event_id % 13)/6.0::DOUBLE AS sigma_lr, 0.2::DOUBLE + (event_id % 5)/3.0::DOUBLE AS sigma_leta, (event_id % 10)/10.0::DOUBLE AS mu, CAST(event_id % 4 AS DOUBLE) AS bg,
  1 + event_id % 3 AS n_peaks, (event_id % 100)/100.0::DOUBLE AS error_reconstruction FROM events))"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, px: 8 x 8 whole numbers."""
    px = F.transform("embedding", lambda x: F.greatest(F.round(x.cast("double") * 1000), F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), px.alias("px"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.spots import to_pixels

    return to_pixels(patches(spark, sf_dir), 8)


CELLS = """cells AS (SELECT patch_id, CAST((k-1) // 8 AS INT) AS row, CAST((k-1) % 8 AS INT) AS col, greatest(round(CAST(x AS DOUBLE)*1000), 0) AS v
  FROM (SELECT vec_id AS patch_id, unnest(embedding) AS x, unnest(range(1, len(embedding)+1)) AS k FROM embeddings))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as trial", "o_orderkey", "round(cast((cast(o_totalprice as double)*7) % 1000 as double)/1000, 3) as val_loss")
    return rows.selectExpr("trial", "row_number() over (partition by trial order by o_orderkey) - 1 as epoch", "val_loss")


HISTORY = """history AS (SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY o_orderkey) - 1 AS epoch, val_loss FROM (
  SELECT o_custkey AS trial, o_orderkey, round((CAST(o_totalprice AS DOUBLE)*7) % 1000/1000, 3) AS val_loss FROM orders))"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('INFO:root:[', if(o_orderkey % 2 = 1, 'Valid', 'Train'), '] @ ', format_string('%05d', o_orderkey), ' l2-norm of   100 samples: Avg.: ', format_string('%.4f', (o_orderkey % 10000) / 10000.0D), ', 50th: 0.1') as value"
    )
