"""Token counts from a digest cache.

A text's key is the SHA-256 of its normalised content and the digest of the tokenizer file. Keys found in the stored
table give their counts; of the other texts each distinct one is encoded once and its count appended to the table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import words_of
from .common import fresh
from .memo import Memo

CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
_memos: dict[str, Memo] = {}


def _counter(path: str) -> Memo:
    """Word -> number of tokens. White space ends words for this kind of tokenizer and gives no token itself."""
    if path not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        _memos[path] = Memo(lambda words: [len(e.ids) for e in library.encode_batch_fast(words, add_special_tokens=False)], lambda v: 0)
    return _memos[path]


def cached(spark, cache: str, version: str) -> DataFrame | None:
    """The stored counts of a tokenizer version, one row per digest; None where the table isn't there yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, path: str, cache: str, *, text: str = "text", keep: list[str] | None = None, limit: int = 2048
) -> DataFrame:
    """Token counts of every whole text by the library for the vocabulary file at path.

    Returns the columns named in keep (by default all but the text), n_bytes long (UTF-8), n_tokens long and
    over_limit boolean (more than limit tokens). A null text counts as empty; repeated rows each get their row; input
    columns with the names of results give way.

    cache: folder of the stored table, read by Spark and appended to. Normalising only joins runs of ASCII white
    space, which the tokenizer does itself before all else, so equal keys mean equal counts. The texts of unseen keys
    are shuffled once, after equal ones have been joined on the map side; stored keys never move their texts twice.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    own = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    normal = F.regexp_replace(whole, r"[ \t\n\r]+", " ")
    digest = F.unhex(F.sha2(F.concat(F.lit(version + "|"), normal), 256))
    texts = docs.select(digest.alias("digest"), normal.alias("__text"))
    known = cached(spark, cache, version)
    if known is not None:
        texts = texts.join(known, "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("__text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counter(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n = list(map(sum, memo.values_of([words_of(t) for t in batch.column("__text").to_pylist()])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(n)), batch.column("digest"), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"]
                )

    misses.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    key = fresh("digest", [*keep, *own])
    keyed = docs.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(whole).cast("long").alias("n_bytes"), digest.alias(key))
    counts = cached(spark, cache, version).withColumnRenamed("digest", key)
    return keyed.join(counts, key).select(*[F.col(f"`{c}`") for c in keep], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
