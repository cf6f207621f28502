"""What op7 catches and loses among labelled documents of sf0.01."""

from pyspark.sql import functions as F

from diffspark.llm import kneser_ney


def test_junk_and_repetition_go_and_clean_text_stays(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    planted = docs.limit(40).select((F.col("doc_id") + 10**9).alias("doc_id"), F.repeat(F.lit("And "), 300).alias("text"), "lang")
    got = kneser_ney.classify(docs.select("doc_id", "text", "lang").unionByName(planted), labels)
    rows = got.join(labels, "doc_id", "left").groupBy("quality", "toxic", F.expr("doc_id >= 1000000000 as planted")).agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()
    count = {(r.quality, r.toxic, r.planted): (r.gone, r.n) for r in rows}
    print(count)
    assert count[None, None, True] == (40, 40)
    junk = [sum(count[0, t, False][k] for t in (0, 1)) for k in (0, 1)]
    assert junk[1] == 58 and junk[0] >= 56
    assert count[1, 0, False][1] == 299 and count[1, 0, False][0] <= 9
