"""N-grams of a run of texts travel once each: a word that makes up half of all text takes one key, and no use of it is lost."""

from collections import Counter

import numpy as np

from diffspark.llm import word_model


def test_every_use_once_and_keys_once():
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.5, np.uint64(1 << 63), rng.integers(0, 1 << 63, 4000, np.uint64) & ~np.uint64((1 << 55) - 1))
    row = rng.integers(0, 1024, 4000)
    for buckets in (1, 7):
        got, keys = Counter(), []
        for bucket, kind, data in word_model._packed_queries(5, key, row, buckets):
            number, n = np.frombuffer(data, np.int64, 2)
            own, rows = np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.uint16, offset=16 + 8 * int(n))
            assert (kind, number) == (2, 5) and set(word_model.buckets_of(own, buckets)) == {bucket}
            got.update(zip(own[np.cumsum(rows >= word_model.FIRST) - 1].tolist(), (rows & ~word_model.FIRST).tolist(), strict=True))
            keys += own.tolist()
        assert got == Counter(zip(key.tolist(), row.tolist(), strict=True)) and len(keys) == len(set(keys))


def test_nothing():
    assert list(word_model._packed_queries(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), 3)) == []
