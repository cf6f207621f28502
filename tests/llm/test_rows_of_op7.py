"""Every row of the input gives a row of op7, repeated rows and null ids too."""

from diffspark.llm import kneser_ney


def test_repeated_rows_stay(spark):
    rows = [(1, "a b c", "en")] * 3 + [(None, "a b", None)] * 2 + [(2, None, "en"), (2, "", "en"), (3, "c b a", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((d or 0, len(t or "") + 1) for d, t, _ in rows)
    assert len({r.perplexity for r in got if r.doc_id == 1}) == 1
