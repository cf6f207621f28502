"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and the ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: For tables written between steps: Spark drops the shuffle files of the query at its end; Python workers get few rows
#: at a time, since these may hold whole texts, and few bytes, since rows may be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (the folder may lie in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir, which all executors share. Where the
    setting is missing, only a master on this machine alone gets a folder of its own; a cluster raises an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, mode: str = "error", **options: int) -> None:
    """Writes df as Parquet, with the writer's options; the shuffle files made for it go at once, since nothing reads them again."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.mode(mode).options(**options).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so that a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Empties tables made by stored() that nothing reads any more."""
    for df in tables:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.stored_path)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, to be sent to every executor if it has few rows; they are counted first."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken (names differ without regard to case)."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def n_words(text: str | Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
