"""Quality rules against counting by hand."""

import random
import re

import zstandard

from diffspark.llm import quality_rules as q

rng = random.Random(8)


def by_hand(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, dup, twice = t.split("\n"), 0, set()
    for k, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            twice |= set(range(k, k + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(twice)


def test_counts_and_verdicts(spark):
    alphabet = ["a", "b", "c", "\n", "\n", " ", "#", "é", "日本", "\x85", "\t", "<|"]
    texts = ["", " ", "a" * 30_000, *["".join(rng.choice(alphabet[:n]) + " " * rng.randrange(2) for _ in range(rng.randrange(150))) for n in (3, 6, 12) for _ in range(60)]]
    texts += ["x y z w v u t s " * 600, " ".join(str(rng.random()) for _ in range(2000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, None)]
    got = {r.doc_id: r for r in q.compression_bands(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    pack = zstandard.ZstdCompressor(level=3).compress
    for k, t in rows:
        r, data = got[k], (t or "").encode()
        n = by_hand(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, t
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        parts = [data[k : k + q.CHUNK] for k in range(0, len(data), q.CHUNK)]
        odd = [p for p in parts if not next((a <= len(p) / len(pack(p)) <= b) for below, a, b in q.BANDS if len(p) < below)]
        low, high = next((a, b) for below, a, b in q.BANDS if len(data) < below)
        fits = not data or low <= len(data) / len(pack(data)) <= high
        assert r.kept == (not r.base_failed and fits and sum(map(len, odd)) <= q.CHUNK_SHARE * len(data)), t
