"""The Jaccard join against all pairs compared outright: chains, thresholds, large groups, regions split by Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from diffspark.llm import jaccard, regions, shingle_sets

rng = random.Random(11)
VOCAB = [f"w{k}" for k in range(3000)]


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id, n_shingles, component_id of rows (doc_id, text) with different ids."""
    sets, top = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def corpus():
    """Chains of edits, near copies of one text, texts that share a passage, short texts, and copies."""
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    out = ["", " \n ", None, "a", "A", "b c", "a b c d e", "A b\tc d e", "a b c d f"]
    for n in (40, 90):
        base = text(n)
        for _ in range(30):  # a chain, each text changed at one more place
            base = list(base)
            base[rng.randrange(n)] = rng.choice(VOCAB)
            out.append(" ".join(base))
    base, passage = text(120), text(40)
    for k in range(80):  # near copies of one text, further and further from it
        near = list(base)
        for _ in range(k % 9):
            near[rng.randrange(120)] = rng.choice(VOCAB)
        out.append(" ".join(near))
    out += [" ".join(text(rng.randrange(5, 60)) + passage + text(rng.randrange(5, 60))) for _ in range(40)]
    out += [out[20], out[20].upper(), out[90]]
    return list(enumerate(out))


ROWS = corpus()


def got(df, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_report(df, **options).collect())


def test_against_all_pairs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    assert got(df) == brute(ROWS)


@pytest.mark.parametrize("bound", [300])
def test_regions_split_by_spark(spark, monkeypatch, bound):
    """Regions beyond the bound go through cells of pivots, and what windows leave whole through pairs of blocks."""
    monkeypatch.setattr(jaccard, "BOUND", bound)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "CHUNK", 500)
    monkeypatch.setattr(jaccard, "BUCKET", 2000)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    assert got(df) == brute(ROWS)


def test_one_region_in_memory():
    sets = [np.array(sorted({hash(x) for x in shingles(t)})) for _, t in ROWS if shingles(t)]
    r = regions.Region(sets, list(range(len(sets))), 80)
    r.links()
    want = {frozenset(k for k, (_, _, c) in enumerate(x for x in brute(ROWS) if x[1]) if c == top) for top in {c for _, n, c in brute(ROWS) if n}}
    assert {frozenset(np.flatnonzero(r.label == k).tolist()) for k in np.unique(r.label)} == want


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "A  b"), (3, "A  b")], "doc_id long, text string")
    assert jaccard.link_report(df.limit(0)).collect() == []
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.link_report(df).collect()) == [(0, 1, 3), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3)]


def test_one_of_each_keeps_wordless_rows_whatever_else_repeats(spark):
    cols = "doc_id long, text string, component string, th int, s string"
    rows = [(1, "  ", "x", 0, ""), (1, "  ", "x", 0, ""), (2, None, "x", 0, ""), (5, "one two", "x", 0, ""), (4, "One  two", "y", 0, "")]
    for more in ([], [(9, "three", "z", 0, "")] * 2):
        df = spark.createDataFrame(rows + more, cols)
        kept = jaccard.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == sorted([(1, "  "), (1, "  "), (4, "One  two")] + [(9, "three")] * bool(more))
        assert kept.where("text is null").count() == 1


def test_shingles_of_long_and_odd_texts(monkeypatch):
    texts = ["", "a", "x" * 50_000 + " y", "é É ü", "a\x85b c\xa0d", " ".join(VOCAB), "A\x0bB\x0cC\rD\tE\nF"] * 3
    whole = shingle_sets.shingle_sets(pa.array(texts))
    monkeypatch.setattr(shingle_sets, "PIECE", 64)
    small = shingle_sets.shingle_sets(pa.array(texts).slice(0))
    assert (whole[0] == small[0]).all() and whole[1].tolist() == small[1].tolist() == [len(shingles(t)) for t in texts]
