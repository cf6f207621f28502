"""What the pivots of the top-k search spare."""

import numpy as np

from diffspark.llm import topk


def searched(x, k=5, pivots=16):
    rng = np.random.default_rng(0)
    p = x[rng.choice(len(x), pivots, replace=False)]
    d = np.linalg.norm(x[:, None] - p, axis=2)
    best = topk.Best(np.arange(20), x[:20], d[:20], k)
    for lo in range(0, len(x), 500):
        best.search(np.arange(lo, min(len(x), lo + 500)), x[lo : lo + 500], d[lo : lo + 500])
    score = x[:20] @ x.T
    for n in range(20):
        want = sorted(((-int(s), i) for i, s in enumerate(score[n]) if i != n))[:k]
        assert [(-s, i) for s, i in best.top[n]] == want
    return best.evaluated / best.seen


def test_clustered_vectors_are_hardly_evaluated_and_even_ones_nearly_all():
    rng = np.random.default_rng(3)
    even = rng.normal(size=(4000, 64))
    even = np.floor(256 * even / np.linalg.norm(even, axis=1)[:, None])
    middle = rng.normal(size=(8, 64))
    close = middle[rng.integers(0, 8, 4000)] + 0.05 * rng.normal(size=(4000, 64))
    close = np.floor(256 * close / np.linalg.norm(close, axis=1)[:, None])
    assert searched(close, pivots=64) < 0.4 < searched(even)


def test_any_finite_vector_takes_part(spark):
    big, huge = 1e301, 1.7e308
    rows = [(50, [big, 1.0]), (1, [1.0, 0.0]), (2, [-1.0, 5.0]), (3, [0.0, 2.0]), (100, [huge, huge]), (4, [2.0, -2.0]), (5, [2.0, -1.0]), (6, [float("inf"), 1.0]), (7, [1e20, 1.0]), (8, None), (150, [0.25, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(c) * 256 if abs(c) > 2**53 else int(np.floor(c * 256)) for c in v] for i, v in rows if v and np.isfinite(v).all()}
    want = []
    for q in (50, 100, 150):
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, whole[q])))), i) for i, v in whole.items() if i != q]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5])]
    got = topk.exact_top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
