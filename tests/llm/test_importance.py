"""Importance resampling: CRCs of prefixes against zlib, and whole results against plain loops."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np

from diffspark.llm import importance, queries

rng = random.Random(5)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20, seed=42):
    s, t = (collections.Counter(b for x in texts for b in buckets(x)) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000) / ((s[b] + 1.0) * (big_t + 10000))))
    rows = []
    for d, text in docs:
        found = buckets(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((d, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {r: k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return rows, drawn


def test_crcs_of_runs_are_those_of_zlib(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 50)
    monkeypatch.setattr(importance, "PIECE", 40)
    texts = [None, "", "  ", "One two THREE", "é日本 x y Σς İ", "-a-b--c9", "w" * 300 + " v " + "u" * 70000 + " t", *(" ".join(rng.choice(["a", "bb", "ccc", "x" * 260]) for _ in range(rng.randrange(200))) for _ in range(30))]
    n, crcs, lengths = zip(*(importance.prefixes(t or "") for t in texts), strict=True)
    got = collections.defaultdict(list)
    for row, bucket in importance.features(np.array(n), list(crcs), list(lengths)):
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            got[r].append(b)
    for k, t in enumerate(texts):
        assert sorted(got[k]) == sorted(buckets(t)), k


def test_results_equal_plain_loops(spark):
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "ß9", "日"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(301, None), (302, ""), (303, "A" * 5000 + " b"), (304, docs[0][1]), (None, docs[1][1]), (7, docs[7][1]), (7, docs[7][1])]
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(5)] + [None]
    df = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in docs], "doc_id long, body string, score string, prefix_n string, weight int").repartition(5)
    out = importance.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"), text="body", percent=20)
    assert out.columns == ["doc_id", "prefix_n", "n_words", "n_features", "weight", "score", "rank"]
    rows, drawn = brute(docs, target, percent=20)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(rows, key=key)
    assert {r[5]: tuple(r)[:5] for r in got if r.rank} == {k: r for r, k in drawn.items()} or len(drawn) < sum(1 for r in got if r.rank)
    ranks = sorted(r.rank for r in got if r.rank is not None)
    n = sum(1 for r in rows if r[1] >= 20)
    assert ranks == list(range(1, n * 20 // 100 + 1))
    best = sorted((r[4] for r in rows if r[1] >= 20), reverse=True)[: len(ranks)]
    assert [r.score for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == best


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    row = importance.importance_resample(one, none, percent=100).first()
    assert row.rank == 1 and row.n_features == 87


def test_sql_twin(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_importance_resample"])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES["op11_importance_resample"](spark, data).select(*columns).collect())
