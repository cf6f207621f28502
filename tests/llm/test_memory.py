"""What Python workers hold beside a full heap: batches bounded in bytes both ways, small running sums, a small memory of words."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from diffspark.llm import bpe, common, packed, shingle_sets, tokenfile


def test_batches_to_spark_are_bounded_in_bytes():
    rows = [(k, k % 3, bytes([k]) * (1 << 20)) for k in range(10)] + [(10, 0, b"x" * (9 << 20)), (11, 1, b"")]
    got = list(packed.batches_of(iter(rows)))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    assert all(b.nbytes <= packed.BYTES + (1 << 20) + 100 for b in got if b.num_rows > 1 and len(b.column("data")[-1].as_py()) <= 1 << 20)
    assert len(got) == 4


def test_batches_to_workers_are_bounded_in_bytes(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(0, 60, 1, 1).selectExpr("cast(repeat('a', 500000) as binary) data")
    got = common.stored(rows.mapInArrow(run, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in got) == 60 and max(r.size for r in got) < 5 << 20


def test_hashing_holds_little_and_is_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bc", "éé", "word", "longer-word"], n)) for n in rng.integers(0, 900, 700)] + ["", " ", "x" * 5000, "\t", " end "]
    data, offsets = "".join(texts).encode(), np.cumsum([0, *[len(t.encode()) for t in texts]])
    assert len(data) > 1 << 20
    monkeypatch.setattr(shingle_sets, "_powers", {k: np.ones(1, np.uint64) for k in ("up", "down")})
    tracemalloc.start()
    hashes, n = shingle_sets.word_hashes(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * len(hashes) + 64 * shingle_sets.BLOCK
    assert n.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(shingle_sets, "BLOCK", 1)
    one, m = shingle_sets.word_hashes(data, offsets)
    assert (one == hashes).all() and (m == n).all()
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(" ".join(texts).split(), hashes.tolist(), strict=True)) and len(set(of.values())) == len(of)


def test_tokens_keep_a_small_memory_of_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    _, memo = bpe._coder(path, corpus_pipeline.TOKEN_MEMORY)
    assert memo.limit == corpus_pipeline.TOKEN_MEMORY < bpe._coder(path)[1].limit
    words = [f"w{k}x{k * 7919}" for k in range(150_000)]
    values = [memo.values_of([words[lo : lo + 5000]])[0] for lo in range(0, len(words), 5000)]
    assert memo.held <= 1.2 * memo.limit and len(memo) + len(memo.old) < len(words)
    assert [v for part in values for v in part][:3] == bpe._coder(path)[1].values_of([words[:3]])[0]


def test_new_words_of_token_files_hold_little():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), np.random.default_rng(4)
    texts = [" ".join(["and", "the"] + ["".join(w) for w in rng.choice(list("abcdefgh"), (500, 9))] + ["é.", "end,"]) + "\nx" for _ in range(400)]
    tokenfile.encode_texts(pa.array(texts[:1]), path)
    tracemalloc.start()
    got = [tokenfile.encode_texts(pa.array(texts[lo : lo + 50]), path)[0].tolist() for lo in range(0, 400, 50)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2 * 4_000_000  # 200,000 words seen
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[::50]]


def test_words_ids_are_remembered_within_bounds_and_right_for_any_bound():
    asked = []

    def compute(words):
        asked.append(words.to_pylist())
        n = np.array([len(w) for w in words.to_pylist()], np.int64)
        return np.frombuffer("".join(words.to_pylist()).encode(), np.uint8), n

    for limit in (0, 20, 60, 1000):
        asked.clear()
        known, rng = tokenfile.WordIds(compute, np.dtype(np.uint8), limit), np.random.default_rng(5)
        for _ in range(60):
            words, uses = np.unique(["abcdefghijkl"[: k + 1] for k in rng.zipf(1.5, 12) % 12], return_counts=True)
            flat, start, size = known.of(pa.array(words.tolist(), pa.string()), uses)
            assert [bytes(flat[a : a + n]).decode() for a, n in zip(start, size, strict=True)] == words.tolist()
            assert known.words.nbytes - 4 * (len(known.words) + 1) + known.flat.nbytes + tokenfile.ENTRY * len(known.words) <= limit
        assert (sum(map(len, asked)) < 100) == (limit == 1000)
    assert known.of(pa.array([], pa.string()), np.empty(0, np.int64))[1].tolist() == []


def test_texts_of_token_files_are_encoded_in_pieces(spark, monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * k, pa.string())], ["text"]) for k in (1, 1, 7, 0, 3, 1)]
    assert [b.num_rows for b in tokenfile.pieces(iter(batches))] == [9, 4] and list(tokenfile.pieces(iter([]))) == []
    rows = spark.range(0, 12, 1, 1).selectExpr("id as doc_id", "repeat('ab ', 500000) as text")
    seen, out = [], common.shared_dir(spark, "files")
    monkeypatch.setattr(tokenfile, "write", lambda df, path, **more: seen.append(path) or common.write(df, path, **more))
    tokenfile.write_token_files(rows, public_tokenizers.path("byte_bpe_50k.json"), out)  # written in small batches
    assert seen == [out] and tokenfile.read_token_files(spark, out).where("n_tokens > 500000").count() == 12
