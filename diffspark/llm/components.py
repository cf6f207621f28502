"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labels, of 16 bytes each, that are sent to every executor; more are joined by shuffles.
BROADCAST_ROWS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns v, c: every linked v with the smallest v of its component.

    Each round a vertex takes the smallest label of its neighbours, then its label's label, so labels travel in jumps.
    Tables are written between rounds; only the number of labels comes to the driver.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).where("v <> w").distinct()
    both = stored(both, "cc-links")
    labels = stored(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("c")), "cc-labels")
    told = F.broadcast if labels.count() <= BROADCAST_ROWS else (lambda df: df)
    while True:
        near = both.join(told(labels.select(F.col("v").alias("w"), F.col("c").alias("cw"))), "w").groupBy("v").agg(F.min("cw").alias("m"))
        lower = near.join(told(labels), "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = stored(lower.join(told(jump), "c", "left").select("v", "old", F.least("c", "cc").alias("c")), "cc-labels")
        if new.where("c <> old").isEmpty():
            return new.select("v", "c")
        labels = new.select("v", "c")
