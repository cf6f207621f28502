"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text (word_model.py), with limits by language.

Every row is judged by its whole text; a null or empty text holds the end mark alone. Repeated rows are judged alike, null
ids and languages too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, stored
from .word_model import FOLDS, word_log_likelihood

#: Texts of so many tokens are repetitive if less than this share of their trigrams differ.
REPEAT_TOKENS, REPEAT_SHARE = 20, 0.5


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, trusted, quality, toxic: by every label that a document has."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return stored(good.select("doc_id", F.coalesce((F.col("quality") >= 1) & (F.col("toxic") == 0), F.lit(False)).alias("trusted"), "quality", "toxic"), "kn-trusted")


def perplexities(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", least_count: int = 2) -> DataFrame:
    """Per row: doc_id, th (hash of the text), lang, trusted, quality, toxic, n_chars, n_tokens, n_different (trigrams), log_p, perplexity (by word, the end
    mark included). labels: doc_id, quality, toxic; trusted documents are those labelled as good and not toxic (by every label they have). Pairs and triples of words with counts below least_count are cut off (1: none)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = rows.withColumn("th", F.xxhash64("__text")).withColumn("fold", F.pmod("th", F.lit(FOLDS)).cast("int"))
    labelled = small(trusted_ids(labels))
    trusted = rows.join(labelled.where("trusted").select("doc_id"), "doc_id", "left_semi")
    scores = word_log_likelihood(rows.select(F.xxhash64("doc_id", "th").alias("deal"), "th", "fold", "__text"), trusted.select("fold", "__text"), least_count)
    about = rows.select("doc_id", "lang", "th", (F.length("__text") + 1).cast("long").alias("n_chars")).join(labelled, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    scored = about.join(scores, "th")
    return scored.select("doc_id", "th", "lang", "trusted", "quality", "toxic", "n_chars", "n_tokens", "n_different", "log_p", F.exp(-F.col("log_p") / F.col("n_tokens")).alias("perplexity"))


def classify(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", low_quantile: float = 0.002, grid: tuple[float, ...] = (0.95, 0.98, 0.99, 0.995, 0.998), least_trusted: int = 50, least_count: int = 2
) -> DataFrame:
    """Per row of docs: doc_id, th, lang, n_chars, perplexity, low, high (the language's limits) and kept.

    Trusted documents are scored by models that they were not part of. The lower limit is a quantile of the trusted
    documents' perplexities. The upper one is that quantile of the grid which loses the least share of trusted plus
    keeps the least share of quality-0 documents among the labelled rows of the language, the largest if several do. A
    language with fewer than least_trusted trusted documents takes the limits of all. Quantiles come from mergeable
    summaries, so no language is gathered in one task. Texts that repeat themselves are rejected whatever their
    perplexity: of at least REPEAT_TOKENS tokens, less than REPEAT_SHARE of the trigrams differ. Without any trusted
    document no perplexity is rejected. A null language is one of its own.
    """
    scored = stored(perplexities(docs, labels, text=text, doc_id=doc_id, lang=lang, least_count=least_count), "kn-scores")
    labelled = scored.where(F.col("trusted") | (F.col("quality") == 0)).select("lang", "trusted", "perplexity")

    def limits(rows: DataFrame, by: list[str]) -> DataFrame:
        q = rows.where("trusted").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("perplexity", [low_quantile, *grid], 100_000).alias("q")).where("n > 0")
        told = q.select(*[F.col(k).alias(f"__{k}") for k in by], "n", "q")
        both = rows.join(F.broadcast(told), F.lit(True) if not by else F.col("lang").eqNullSafe(F.col("__lang")))
        wrong = [(F.count_if(F.col("trusted") & (F.col("perplexity") > F.col("q")[k + 1])) / F.count_if("trusted") + F.coalesce(F.try_divide(F.count_if(~F.col("trusted") & (F.col("perplexity") <= F.col("q")[k + 1])), F.count_if(~F.col("trusted"))), F.lit(0.0))) for k in range(len(grid))]
        found = both.groupBy(*[f"__{k}" for k in by], "n", "q").agg(F.array(*wrong).alias("w"))
        best = F.array_min(F.transform("w", lambda x, k: F.struct(x.alias("x"), (-k).alias("k"))))["k"]
        return found.select(*[f"__{k}" for k in by], "n", F.col("q")[0].alias("low"), F.element_at("q", (2 - best).cast("int")).alias("high"))

    every = limits(labelled, []).select(F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    of_lang = limits(labelled, ["lang"]).where(F.col("n") >= least_trusted).drop("n")
    rows = scored.join(F.broadcast(every), F.lit(True), "left").join(F.broadcast(of_lang), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    rows = rows.withColumns({"low": F.coalesce("low", "low_all"), "high": F.coalesce("high", "high_all")})
    kept = (F.col("high").isNull() | F.col("perplexity").between(F.col("low"), F.col("high"))) & ~((F.col("n_tokens") >= REPEAT_TOKENS) & (F.col("n_different") < REPEAT_SHARE * F.col("n_tokens")))
    return rows.select("doc_id", "th", "lang", "n_chars", "perplexity", "low", "high", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that classify() keeps; the rejected ones, which are few, are taken off by id and text hash."""
    rejected = stored(classify(docs, labels, text=text, doc_id=doc_id, **options).where(~F.col("kept")).select("doc_id", "th").distinct(), "kn-rejected")
    own = [fresh(c, docs.columns) for c in ("rejected_id", "rejected_th")]
    rejected = small(rejected.select(F.col("doc_id").alias(own[0]), F.col("th").alias(own[1])))
    th = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.join(rejected, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(own[0])) & (th == F.col(own[1])), "left_anti")
