"""Empty tables, clashing column names, and SQL twins on a small table."""

import duckdb
import public_tokenizers
import pytest

from diffspark.llm import bpe, common, counts, jaccard, mix, quality_rules, queries, secrets, tokenfile, warc

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ["text", "_text", "__text", "blob", "_blob", "__blob", "found", "spans", "digest", "__digest", "size", "n_tokens", "kept", "shards", "th", "component", "c", "key"]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts with every name that the operators use within."""
    rows = [(1, "a b c secret=abcdef1", "x"), (2, None, None), (3, "", "x"), (3, "", "x"), (4, "a b c secret=abcdef1", "y")]
    df = spark.createDataFrame(rows, "doc_id long, body string, source string")
    return df.selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in CLASHES])


def test_clashing_names(spark, odd):
    out = bpe.bpe_encode_decode(odd, WORDS, text="body")
    assert out.count() == 5 and out.where("doc_id = 2").first().n_tokens == 0
    assert quality_rules.compression_bands(odd, text="body").count() == 5
    rows = secrets.find_secrets(odd, common.shared_dir(spark, "ledger"), text="body").collect()
    assert sorted((r.doc_id, len(r.spans)) for r in rows) == [(1, 1), (2, 0), (3, 0), (3, 0), (4, 1)] and {r.blob for r in rows} == {f"blob{k}" for k in (1, 2, 3, 4)}
    assert counts.token_counts(odd, WORDS, common.shared_dir(spark, "counts"), text="body").count() == 5
    assert jaccard.one_of_each(odd, text="body").columns == odd.columns
    assert mix.mix(odd, text="body", levels=2).columns == odd.columns


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert quality_rules.compression_bands(none, text="body").count() == 0
    assert secrets.secret_report(none, common.shared_dir(spark, "ledger"), text="body").count() == 0
    for write, read in ((lambda out: tokenfile.write_token_files(none, BYTES, out, text="body"), tokenfile.read_token_files), (lambda out: warc.write_warc(none.selectExpr("doc_id as page_id", "source as url", "body as html"), out), warc.read_warc)):
        out = common.shared_dir(spark, "none")
        write(out)
        assert read(spark, out).count() == 0
    assert jaccard.one_of_each(none, text="body").count() == 0


@pytest.mark.parametrize("name", ["op6_warc"])
def test_sql_twins(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{data}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, data).select(*columns).collect())


def test_records_refer_to_each_other(spark):
    pages = spark.createDataFrame([(2, "u", "same"), (1, "v", "same"), (3, "w", "other")], "page_id long, url string, html string")
    ids = {}
    for parts in (1, 3):
        out = common.shared_dir(spark, "warc")
        warc.write_warc(pages.repartition(parts), out)
        records = [data for r in spark.read.parquet(out).collect() for _, data in warc.Bundle(bytes(r.file))]
        fields = {f["X-Page-ID"]: f for f, *_ in map(warc.parse, records)}
        assert fields["2"]["WARC-Refers-To"] == fields["1"]["WARC-Record-ID"] and "WARC-Refers-To" not in fields["3"]
        ids[parts] = sorted(f["WARC-Record-ID"] for f in fields.values())
    assert ids[1] == ids[3]


def test_reserved_names_keep_their_values(spark):
    names = ["__size", "__key", "__shards", "__block", "__source", "__copy", "__jaccard_id", "__jaccard_th"]
    rows = [(k, f"{'word ' * (k % 4 + 1)}w{k}", f"s{k % 2}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names])
    mixed, stay = mix.mix(df, levels=2), jaccard.one_of_each(df)
    assert mixed.columns == stay.columns == df.columns and stay.count() == 20
    for r in [*mixed.collect(), *stay.collect()]:
        assert all(r[c] == f"{c}{r.doc_id}" for c in names)
    named = df.select("doc_id", df.text.alias("__size"), df.source.alias("__s"))
    report = mix.mix_report(named, keep=["doc_id", "__size"], text="__size", source="__s", levels=2).collect()
    assert {(r.doc_id, r["__size"]) for r in report} == {(k, t) for k, t, _ in rows} and all(r.size == r.doc_id % 4 + 2 for r in report)
