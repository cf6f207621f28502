"""Tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Python workers get few rows at a time, and few bytes: a row may hold a whole patch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the folder in spark.checkpoint.dir, which all executors share, and reads it back: what is costly
    is made once, and a lost executor loses nothing. Without the setting only a master on this machine alone gets a
    folder of its own.

    Files say little about rows: patches of a few bright pixels take a hundredth of their size in Parquet. So a join doesn't
    send a staged table through the driver to all tasks on the strength of its files' size; F.broadcast() still does."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-staged-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
