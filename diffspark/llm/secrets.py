"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). Only blobs that the ledger doesn't hold for the current
rules are scanned; findings are kept by blob and joined back to all paths that carry it. DataFrame functions only.

Positions count code points, ends are exclusive. A null text counts as empty; repeated rows each get their findings.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: (kind, pattern, group that must be long enough, its least length), in order. The first three are the base rules.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE = 3
#: For patterns whose failing matches can't hide others, a pattern that finds the long ones only; it saves time.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "github": r"gh[pousr]_[A-Za-z0-9]{36,}"}
RULE_VERSION = hashlib.sha256(repr((RULES, LONG)).encode()).hexdigest()[:16]
FINDINGS = "rule_version string, blob binary, spans array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"


def _matches(text: Column, k: int) -> Column:
    """Of one rule: for each match in order the length of the text before it (from the match before), its length, and
    whether it is long enough. The text between matches comes from splitting at the same pattern."""
    kind, pattern, group, least = RULES[k]
    pattern = F.lit(LONG.get(kind, pattern))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
    part = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), kept.alias("kept"))
    rows = F.transform(
        F.filter(part, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(F.lit(k).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["kept"]) >= least).alias("good")),
    )
    empty = F.array().cast("array<struct<kind:int,gap:int,size:int,good:boolean>>")
    return F.when(text.rlike(pattern_text(k)), rows).otherwise(empty)


def pattern_text(k: int) -> str:
    return LONG.get(RULES[k][0], RULES[k][1])


def scan(blobs: DataFrame) -> DataFrame:
    """blobs: blob, text. One row per blob that has findings: its spans sorted by start, then kind as listed."""
    text = F.col("text")
    some = blobs.where(reduce(lambda a, b: a | b, [text.rlike(pattern_text(k)) for k in range(len(RULES))]))
    rows = some.select("blob", F.posexplode(F.concat(*[_matches(text, k) for k in range(len(RULES))])).alias("at", "m"))
    so_far = Window.partitionBy("blob", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("blob", "m.kind", "m.size", "m.good", F.sum(F.col("m.gap") + F.col("m.size")).over(so_far).cast("int").alias("end"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end")
    return ends.where("good").groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _read(spark, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("rule_version") == RULE_VERSION)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def blob_of(text: str) -> Column:
    """A text's content address; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def update_ledger(docs: DataFrame, ledger: str, *, text: str = "text") -> DataFrame:
    """Scans the blobs of docs that the ledger doesn't hold for these rules, appends them, and returns the findings by
    blob (blobs without any have no row).

    Equal texts meet by partial aggregation before the one shuffle, so a hot blob costs one row a task. Known blobs are
    taken off before that shuffle while the ledger's addresses can be sent to every executor; a larger ledger meets the
    texts in a shuffle by address, which the aggregation then goes on with.
    """
    spark = docs.sparkSession
    texts = docs.select(blob_of(text).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    seen = _read(spark, f"{ledger}/seen", "rule_version string, blob binary")
    if seen is not None:
        texts = texts.join(seen.select("blob").distinct(), "blob", "left_anti")
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    version = F.lit(RULE_VERSION).alias("rule_version")
    scan(blobs).select(version, "blob", "spans").write.mode("append").parquet(f"{ledger}/findings")
    texts.select(version, "blob").distinct().write.mode("append").parquet(f"{ledger}/seen")
    # a blob scanned by two runs at once has the same spans in both
    return _read(spark, f"{ledger}/findings", FINDINGS).groupBy("blob").agg(F.first("spans").alias("spans"))


def find_secrets(docs: DataFrame, ledger: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (by default all) and spans: array of (start, kind number, end) for every row of docs."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    blob = fresh("blob", keep)
    own = fresh("found", [*keep, blob])
    found = update_ledger(docs, ledger, text=text).select(F.col("blob").alias(blob), F.col("spans").alias(own))
    paths = docs.select(*[F.col(f"`{c}`") for c in keep], blob_of(text).alias(blob))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return paths.join(found, blob, "left").select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{own}`"), none).alias("spans"))


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r[0]) for r in RULES])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def secret_report(docs: DataFrame, ledger: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """find_secrets() as counts by base kind, the digest of the base spans, and all spans as text."""
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    found = find_secrets(docs, ledger, text=text, keep=keep)
    spans = F.col("spans")
    of_kind = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{RULES[k][0]}") for k in range(BASE)]
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    return found.select(*[F.col(f"`{c}`") for c in keep], *counts, F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(spans).alias("spans"))


def redact(docs: DataFrame, ledger: str, *, text: str = "text") -> DataFrame:
    """docs with every found span replaced by a mask (overlapping spans by one); other texts stay as they are.

    Meant for texts with few secrets each: every cut walks the text from its start.
    """
    found = find_secrets(docs, ledger, text=text)
    col = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
        F.struct(
            x["end"].alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], col.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(MASK))).otherwise(s["out"]).alias("out"),
        )
    )
    whole = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], col.substr(s["at"] + 1, F.length(col))))
    return found.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(col)).select(*[F.col(f"`{c}`") for c in docs.columns])
