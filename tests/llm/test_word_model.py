"""The word model of op7 against one made of plain dictionaries; word order; waves and buckets change nothing."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from diffspark.llm import kneser_ney, packed, word_model

rng = random.Random(4)
WORDS = ["the", "of", "a", "ab", "\u00e9", *[f"w{k}" for k in range(25)]]


def tokens(t):
    return ["<s>", "<s>", *t.split(), "</s>"]


def tables_of(trained):
    three = Counter(tuple(w[k - 2 : k + 1]) for w in map(tokens, trained) for k in range(2, len(w)))
    two = Counter(g[1:] for g in three)
    return Counter(g[1] for g in two), two, three


def brute(texts, trained, both, least=2):
    """log P of each text by a model of the trained ones: order 3, interpolated, modified; counts below
    `least` of pairs and triples are cut off. Discounts come from the counts of both models."""
    one, two, three = tables_of(trained)
    counts_of = [sum((Counter(t[k].values()) for t in map(tables_of, both)), Counter()) for k in range(3)]

    def level(counts, order):
        d = word_model.discounts(counts_of[order], order > 0 and least > 1)
        total, spare = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            h = g[:-1] if isinstance(g, tuple) else ()
            total[h] += n
            spare[h] += d[min(n, 3) - 1]
        return d, total, spare

    tables = [(counts, *level(counts, k)) for k, counts in enumerate((one, two, three))]

    def p(context, w):
        if context is None:
            return 1 / (len(one) + 1)
        counts, d, total, spare = tables[len(context)]
        lower = p(context[1:] if context else None, w)
        if not total[context]:
            return lower
        n = counts[(*context, w)] if context else counts[w]
        return (max(0, n - d[min(n, 3) - 1] if n else 0) + spare[context] * lower) / total[context]

    known = [w for w in one] + ["never seen"]
    for context in ((), ("the",), ("the", "of"), ("<s>", "<s>")):
        assert abs(sum(p(context, w) for w in known) - 1) < 1e-9
    return [sum(math.log(p(tuple(w[k - 2 : k]), w[k])) for k in range(2, len(w))) for w in map(tokens, texts)]


def corpus():
    rows = []
    for k in range(90):
        text = " ".join(rng.choice(WORDS[: 6 + k % 25]) for _ in range(rng.randrange(0, 30)))
        rows.append((k, text, "en", k % 3 != 2))
    return rows + [(200, rows[3][1], "en", False), (201, "unseen words only", "en", False)]


def test_against_dictionaries(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean").repartition(4)
    labels = spark.createDataFrame([(k, 1, 0) for k, *_, good in rows if good], "doc_id long, quality int, toxic int")
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold")).collect()}
    both = [[t for k, t, _, good in rows if good and fold[k] != m] for m in (0, 1)]
    for small_buckets, least in ((False, 1), (True, 2)):
        want = {}
        for m in (0, 1):
            own = [(k, t) for k, t, *_ in rows if fold[k] == m]
            scores = brute([t for _, t in own], both[m], both, least)
            want |= {k: x for (k, _), x in zip(own, scores, strict=True)}
        if small_buckets:
            for name, value in (("KEYS", 50), ("QUERIES", 300), ("MODEL_KEYS", 20), ("TRAIN_WAVES", 3), ("SCORE_WAVES", 4)):
                monkeypatch.setattr(word_model, name, value)
        got = {r.doc_id: r for r in kneser_ney.perplexities(docs, labels, least_count=least).collect()}
        assert set(got) == set(want) and all(abs(got[k].log_p - want[k]) < 1e-3 for k in want)
    for k, t, *_ in rows:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        assert got[k].n_tokens == len(w) - 2 and got[k].n_different == len({tuple(w[i - 2 : i + 1]) for i in range(2, len(w))})


def test_nothing_trusted_nothing_at_all(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.kept for r in kneser_ney.classify(docs, labels).collect()} == {True} and kneser_ney.classify(docs.limit(0), labels).count() == 0
    assert kneser_ney.keep_good(docs.withColumn("rejected_id", F.lit(1)), labels).count() == 2


def test_word_order_counts(spark):
    words = [f"word{k}" for k in range(40)]
    after = {w: rng.sample(words, 2) for w in words}

    def chain(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    rows = [(k, " ".join(chain(60))) for k in range(80)]
    shuffled = [w.split() for _, w in rows[:20]]
    for w in shuffled:
        rng.shuffle(w)
    docs = spark.createDataFrame(rows + [(100 + k, " ".join(w)) for k, w in enumerate(shuffled)], "doc_id long, text string").selectExpr("*", "'en' as lang")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, labels).collect()}
    assert len(got) == 100 and max(got[k] for k in range(80)) < min(got[100 + k] for k in range(20))


def test_no_table_of_the_model_reaches_the_driver():
    for module in (kneser_ney, word_model, packed):
        assert "toArrow" not in open(module.__file__).read()
