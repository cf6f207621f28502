"""Encoder and splitter against the library: every code point, long words, files with other parts."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from diffspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.SegmentTreeBPE(PATH)


def ids_of(coder, texts):
    words = [bpe.words_of(t) for t in texts]
    done = iter(coder.encode_words([w for ws in words for w in ws]))
    return [[i for _ in ws for i in next(done)] for ws in words]


def test_all_code_points(coder):
    texts = [f"a{chr(c)}b c" for c in [*range(1, 0xD800), *range(0xE000, 0x20000)]]
    assert ids_of(coder, texts) == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_long_words_by_ranks(coder, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("aabcdefgh") for _ in range(rng.randrange(9, 60))) for _ in range(2000)] + ["a" * k for k in range(9, 60)] + ["ab" * k for k in range(5, 40)]
    want = [e.ids for e in LIB.encode_batch(words, add_special_tokens=False)]
    assert coder.encode_words(words) == want
    monkeypatch.setattr(bpe, "LONG", 8)
    assert coder.encode_words(words) == want
    monkeypatch.setattr(bpe, "LONG", 2048)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    assert coder.encode_words([word])[0] == LIB.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_parts_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="other parts"):
        bpe.SegmentTreeBPE(str(tmp_path / "t.json"))
