"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

A file must name the parts that are built in here, else it is refused. The leaves of a word's tree hold the ranks of its adjacent symbol pairs, every inner node the minimum of its children
(rank first, then position), so the root yields the leftmost pair of lowest rank. A merge changes three leaves, each
updated along its path, and the tree is asked again until no mergeable pair remains. The trees of many words of like
length are held side by side in one array and stepped together.

Null and empty texts give no tokens. Repeated rows, null ids and extra columns are of no effect: every row is encoded
for itself. A pair's rank always comes before those of the pairs that its merge makes, so in very long words all places
of one rank are merged at once, ranks in order, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .memo import Memo

NONE = np.int64(1) << 60
#: The normalizer and the split pattern that the public word tokenizer's file names.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": PRETOKEN}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: ASCII and Latin letters, which every Unicode version takes alike; words with other characters are split by the library.
PLAIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
#: Symbols from which on a word's equal merges are made together.
LONG = 2048
#: Bytes of words already encoded that a worker keeps, in each of two generations.
MEMORY = 80_000_000
#: Characters that Python takes as white space but the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
NOT_SPACE = re.compile(f"[^{SPACE}]+")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else extra))
        extra += b not in keep
    return out


class SegmentTreeBPE:
    """Encoder and decoder for a vocabulary file with words, pair merges and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        unused = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        parts = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        if spec["normalizer"] != NORMAL or spec["pre_tokenizer"] != parts or spec["decoder"] or spec["post_processor"] or any(spec["model"].get(k) for k in unused):
            raise ValueError(f"{path} names other parts than this encoder has")
        made = {x for c in byte_chars() for x in (c, c + suffix)}
        if not made <= vocab.keys():
            raise ValueError(f"{path} lacks bytes")
        for a, b in merges:
            if a not in made or b not in made or a + b in made:
                raise ValueError(f"{path} lists merges out of order")
            made.add(a + b)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.id_text = [str(i) for i in range(size)]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.pair = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pattern = regex.compile(PRETOKEN)
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(chars)}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs; NONE where there is no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sym: a row of symbols per word, padded with -1 to a power of two. Returns all ids and their number per word."""
        n, leaves = sym.shape
        levels = leaves.bit_length() - 1
        tree = np.full((n, 2 * leaves), NONE)
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        rank[(sym[:, 1:] < 0)] = NONE
        tree[:, leaves : 2 * leaves - 1] = np.where(rank < NONE, rank * leaves + np.arange(leaves - 1), NONE)
        for k in range(levels - 1, -1, -1):
            lo = 1 << k
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        after = np.tile(np.arange(1, leaves + 1), (n, 1))
        after[np.arange(n), lens - 1] = leaves
        before = np.tile(np.arange(-1, leaves - 1), (n, 1))
        rows = np.flatnonzero(tree[:, 1] < NONE)

        def put(rows, leaf, value):
            tree[rows, leaves + leaf] = value
            node = (leaves + leaf) >> 1
            for _ in range(levels):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        while len(rows):
            root = tree[rows, 1]
            left = root & (leaves - 1)
            right = after[rows, left]
            new = self.merged[root >> levels]
            sym[rows, left], sym[rows, right] = new, -1
            beyond = after[rows, right]
            after[rows, left] = beyond
            put(rows, right, NONE)
            more = beyond < leaves
            value = np.full(len(rows), NONE)
            r, b, at = rows[more], beyond[more], left[more]
            before[r, b] = at
            rank = self._rank(new[more], sym[r, b])
            value[more] = np.where(rank < NONE, rank * leaves + at, NONE)
            put(rows, left, value)
            prior = before[rows, left]
            has = prior >= 0
            r, p = rows[has], prior[has]
            rank = self._rank(sym[r, p], new[has])
            put(r, p, np.where(rank < NONE, rank * leaves + p, NONE))
            rows = rows[tree[rows, 1] < NONE]
        live = sym >= 0
        return sym[live], live.sum(1)

    def _merge_long(self, word: bytes) -> list[int]:
        """Ids of one word: every rank that occurs is taken once, in order, and merged at all its places."""
        sym = self.inner[np.frombuffer(word, np.uint8)]
        n = len(sym)
        sym[-1] = self.last[word[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self._rank(sym[at], sym[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, places in zip(rank[cut].tolist(), np.split(at, cut[1:]), strict=True) if len(cut) else ():
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(places)

        add(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            left, right = self.pair[r]
            at = at[(sym[at] == left) & (after[at] < n)]
            at = at[sym[after[at]] == right]
            if left == right and len(at):  # of overlapping places the first, third, ... are merged
                new = np.concatenate([[True], after[at[:-1]] != at[1:]])
                run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = self.merged[r], -1
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            add(np.unique(np.concatenate([before[at[before[at] >= 0]], at[inside]])))
        return sym[sym >= 0].tolist()

    def pieces(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, given in UTF-8; the words of one size class are merged together, in blocks."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._merge_long(w)
            elif w:
                classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
        for leaves, members in classes.items():
            step = max(1, 1_000_000 // leaves)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                lens = np.array([len(words[k]) for k in part])
                flat = np.frombuffer(b"".join(words[k] for k in part), np.uint8)
                row = np.repeat(np.arange(len(part)), lens)
                first = np.cumsum(lens) - lens
                sym = np.full((len(part), leaves), -1, np.int64)
                sym[row, np.arange(len(flat)) - first[row]] = self.inner[flat]
                sym[np.arange(len(part)), lens - 1] = self.last[flat[first + lens - 1]]
                ids, count = self._merge(sym, lens)
                flat, end = ids.tolist(), np.cumsum(count).tolist()
                for k, a, b in zip(part, [0, *end], end, strict=False):
                    out[k] = flat[a:b]
        return out

    def split(self, word: str) -> list[bytes | int]:
        """A raw word (no white space) as pre-tokens in UTF-8 and ids of special strings."""
        if not self.special_re.search(word):
            return self._plain(word)
        out: list[bytes | int] = []
        at = 0
        for m in self.special_re.finditer(word):
            out += [*self._plain(word[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._plain(word[at:])

    def _plain(self, part: str) -> list[bytes]:
        if not PLAIN.fullmatch(part):
            return [bytes([self.byte_of[c] for c in piece]) for piece, _ in self.cut(self.normalize(part))]
        part = part.lower()
        return [part.encode()] if part.isalpha() else [x.encode() for x in self.pattern.findall(part)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of raw words."""
        split = [self.split(w) for w in words]
        done = iter(self.pieces([x for parts in split for x in parts if isinstance(x, bytes)]))
        out = []
        for parts in split:
            if len(parts) == 1 and isinstance(parts[0], bytes):
                out.append(next(done))
            else:
                out.append([i for x in parts for i in ([x] if isinstance(x, int) else next(done))])
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens are joined by one space."""
        return " ".join([self.token[i] for i in ids])


def words_of(text: str) -> list[str]:
    """The raw words between white space, as the tokenizer takes white space."""
    return NOT_SPACE.findall(text) if ODD_SPACE.search(text) else text.split()


_memos: dict[tuple[str, int], tuple[SegmentTreeBPE, Memo]] = {}


def _coder(path: str, memory: int = MEMORY) -> tuple[SegmentTreeBPE, Memo]:
    if (path, memory) not in _memos:
        coder = SegmentTreeBPE(path)

        def compute(words: list[str]):
            for ids in coder.encode_words(words):
                yield " ".join([coder.id_text[i] for i in ids]), coder.decode(ids)

        _memos[path, memory] = coder, Memo(compute, lambda v: len(v[0]) + len(v[1]), memory)
    return _memos[path, memory]


def bpe_encode_decode(
    docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, more: tuple[str, ...] = (), memory: int = MEMORY
) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns the columns named in keep (by default all but the text), n_tokens long, ids_sha256 and decoded_sha256
    (lowercase hex of the decimal ids joined by a space, and of the decoded text in UTF-8), and those of ids
    (array<int>) and decoded that `more` names. No shuffle: each input row is handled where it is read.

    path: the vocabulary file, present on every machine. memory: bytes of words that a worker keeps encoded, twice over.
    Result columns win over input columns of the same names.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *more]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(fresh("text", keep)))
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
    spark_kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": T.ArrayType(T.IntegerType()), "decoded": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _coder(path, memory)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                rows: dict[str, list] = {c: [] for c in own}
                for found in memo.values_of([words_of(t) for t in batch.column(len(keep)).to_pylist()]):
                    ids = " ".join([f[0] for f in found if f[0]])
                    decoded = " ".join([f[1] for f in found if f[0]])
                    rows["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                    rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if "ids" in more:
                        rows["ids"].append(np.array(ids.split(), np.int32))
                    if "decoded" in more:
                        rows["decoded"].append(decoded)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in range(len(keep))] + [pa.array(rows[c], kinds[c]) for c in own], [*keep, *own]
                )

    fields = [docs.schema[c] for c in keep]
    schema = type(docs.schema)(fields)
    for c in own:
        schema = schema.add(c, spark_kinds[c])
    return source.mapInArrow(run, schema)
