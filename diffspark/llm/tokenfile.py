"""Token-ID files: one wavelet matrix per shard, with rank and select over succinct bit-planes.

Documents are sorted by id over the cluster and encoded; every shard (a run of at most about shard_tokens tokens) is
one compressed file: a JSON header, the documents' ids and lengths, the bit-planes and their rank directories, each a
zstandard frame. A file answers token access, counts and occurrence lookup by itself. Files are stored as binary cells
of a Parquet table, so that any store Spark can write to will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import write

MAGIC = b"WVLTMX01"
BLOCK = 2048  # bits for each entry of the rank directory


class WaveletMatrix:
    """Bit-planes of a sequence of ids, highest bit first; at each plane zeros move to the front, stably."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.ranks = ranks if ranks is not None else [self._directory(p) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (v & v.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8"))
            low = np.flatnonzero(~one)  # places are faster to gather by than flags
            zeros.append(len(low))
            v = v[np.concatenate([low, np.flatnonzero(one)])]
        return cls(n, bits, planes, zeros)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
        return ones[:: BLOCK // 64].astype("<u4")

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        word, start = i // 64, i // BLOCK * (BLOCK // 64)
        total = int(self.ranks[k][i // BLOCK]) + int(np.bitwise_count(self.planes[k][start:word]).sum())
        if i % 64:
            total += (int(self.planes[k][word]) & ((1 << i % 64) - 1)).bit_count()
        return total

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 64]) >> i % 64 & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit = self._bit(k, i)
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value among the first i positions lie below the last plane."""
        lo, hi = 0, i
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before position i."""
        if value < 0 or value >> self.bits:
            return 0
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of value, by going back up the planes."""
        if value < 0 or value >> self.bits or not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            i = self._select(p, i - self.zeros[p], True) if i >= self.zeros[p] else self._select(p, i, False)
        return i

    def _select(self, k: int, j: int, one: bool) -> int:
        """Position of the j-th one (or zero) of plane k: the last i with at most j of them before it."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            ones = self._ones(k, mid)
            lo, hi = (mid, hi) if (ones if one else mid - ones) <= j else (lo, mid - 1)
        return lo

    def decode(self) -> np.ndarray:
        """All ids, rebuilt plane by plane from the lowest bit."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[k], np.empty_like(v)
            up[np.flatnonzero(~one)] = v[:z]
            up[np.flatnonzero(one)] = v[z:] | v.dtype.type(1 << (self.bits - 1 - k))
            v = up
        return v


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard's file."""
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    frames = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<i8").tobytes()]
    frames += [p.tobytes() for p in matrix.planes] + [r.tobytes() for r in matrix.ranks]
    frames = [pack(x) for x in frames]
    header = json.dumps({"n": matrix.n, "bits": matrix.bits, "zeros": matrix.zeros, "frames": [len(x) for x in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The wavelet matrix, ids and token numbers of a shard's documents."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack_from("<I", data, 8)[0]
    header = json.loads(data[12 : 12 + size])
    unpack, at, parts = zstandard.ZstdDecompressor().decompress, 12 + size, []
    for length in header["frames"]:
        parts.append(unpack(data[at : at + length]))
        at += length
    known = np.frombuffer(parts[1], np.uint8)
    doc_ids = [d if k else None for d, k in zip(np.frombuffer(parts[0], "<i8").tolist(), known, strict=True)]
    planes = [np.frombuffer(x, "<u8") for x in parts[3 : 3 + header["bits"]]]
    ranks = [np.frombuffer(x, "<u4") for x in parts[3 + header["bits"] :]]
    return WaveletMatrix(header["n"], header["bits"], planes, header["zeros"], ranks), doc_ids, np.frombuffer(parts[2], "<i8")


#: What keeps a text from being cut at each blank and line end: two of them in a row, one at the end, other white space
#: (as the byte-level split pattern takes it), and the mark that cuts.
UNCUT = r"[ \n]{2}|[ \n]\z|[\x01\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Latin letters, which every Unicode version takes as such; a blank and these are one pre-token, and a sign after a letter
#: begins the next.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = ".,;:!?"
BARE = f"^ ?[{LETTERS}]+"
#: Bytes of words and their ids that a worker remembers; of texts from which on they are encoded together; new words, words
#: of texts, and texts of other kinds handled at a time.
MEMORY, PIECE, NEW, WORDS, OTHER = 4_000_000, 4 << 20, 20_000, 200_000, 256
#: What an entry takes beside its characters and ids.
ENTRY = 16
_encoders: dict[str, tuple] = {}


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start, one after the other."""
    first = np.cumsum(size) - size
    return flat[np.repeat(start - first, size) + np.arange(size.sum())]


class WordIds:
    """The ids of distinct words, from compute(words), which gives them in one array and their numbers.

    A bounded memory goes before it: words used twice in a batch and remembered ones, those seen last first. All is held
    in arrays, since a worker's objects for words would take ten times as much.
    """

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: np.dtype, limit: int):
        self.compute, self.limit = compute, limit
        self.words, self.flat, self.size = pa.array([], pa.string()), np.empty(0, kind), np.empty(0, np.int64)

    def of(self, words: pa.Array, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and for each word where its ids lie in it and how many they are."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        flat, n = self.compute(words.filter(pa.array(new)))
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[~new], size[~new] = (np.cumsum(self.size) - self.size)[at[~new]], self.size[at[~new]]
        start[new], size[new] = len(self.flat) + np.cumsum(n) - n, n
        flat = np.concatenate([self.flat, flat])
        self._remember(words, ~new | (uses > 1), at[~new], flat, start, size)
        return flat, start, size

    def _remember(self, words: pa.Array, keep: np.ndarray, seen: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        unseen = np.ones(len(self.words), bool)
        unseen[seen] = False
        all_words = pa.concat_arrays([words.filter(pa.array(keep)), self.words.filter(pa.array(unseen))])
        starts = np.concatenate([start[keep], (np.cumsum(self.size) - self.size)[unseen]])
        sizes = np.concatenate([size[keep], self.size[unseen]])
        held = np.cumsum(pc.binary_length(all_words).to_numpy() + sizes * flat.itemsize + ENTRY)
        n = int(np.searchsorted(held, self.limit, side="right"))
        self.words = pa.concat_arrays([all_words.slice(0, n)]).take(pa.array(np.arange(n)))  # a copy, lest the rest stays
        self.flat, self.size = _gather(flat, starts[:n], sizes[:n]), sizes[:n].copy()


def _encoder(path: str):
    """Ids of distinct words; whole texts' ids by the library; the ids' type; ids of signs and where they lie; the pattern
    of texts to go whole."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        kind = np.dtype(np.uint16 if library.get_vocab_size() <= 1 << 16 else np.uint32)
        model, bytes_as_chars = library.model, str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        line_end = byte_chars()[10]

        def whole(texts: list[str]):
            for e in library.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, kind)

        def compute(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """A blank and letters are one pre-token, for the model alone; the rest takes the library's whole way."""
            bare = pc.match_substring_regex(words, BARE + "$").to_numpy(zero_copy_only=False)
            flat, n, tokenize = array(kind.char), array("q"), model.tokenize
            new = words.filter(pa.array(bare))
            for lo in range(0, len(new), NEW):
                part = "\n".join(new.slice(lo, NEW).to_pylist()).encode().decode("latin-1").translate(bytes_as_chars).split(line_end)
                for w in part:  # none holds a line end
                    ids = [t.id for t in tokenize(w)]
                    flat.extend(ids)
                    n.append(len(ids))
            rest = words.filter(pa.array(~bare))
            for lo in range(0, len(rest), OTHER):
                for ids in whole(rest.slice(lo, OTHER).to_pylist()):
                    flat.frombytes(ids.tobytes())
                    n.append(len(ids))
            ids, n = np.frombuffer(flat, kind), np.frombuffer(n, np.int64)
            order = np.argsort(np.concatenate([np.flatnonzero(bare), np.flatnonzero(~bare)]))
            return _gather(ids, (np.cumsum(n) - n)[order], n[order]), n[order]

        special = [re.escape(t.content) for t in library.get_added_tokens_decoder().values()]
        signs = [next(whole([c])) for c in SIGNS]
        sizes = np.array([*map(len, signs), 0])  # the last one: no sign
        sign = np.concatenate(signs), np.cumsum(sizes) - sizes, sizes
        _encoders[path] = WordIds(compute, kind, MEMORY), whole, kind, sign, "|".join([UNCUT, *special])
    return _encoders[path]


def encode_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of the whole texts of a string column.

    Words repeat, so a text is cut where the split pattern always cuts: before a blank that a word follows and around single
    line ends; a sign behind letters is a pre-token of its own. Texts with longer runs of white space or special strings go
    whole.
    """
    known, whole, kind, sign, uncut = _encoder(path)
    out: list[np.ndarray | None] = [None] * len(texts)
    odd = pc.match_substring_regex(texts, uncut)
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    for lo in range(0, len(at), OTHER):
        for k, ids in zip(at[lo : lo + OTHER].tolist(), whole(texts.take(at[lo : lo + OTHER]).to_pylist()), strict=True):
            out[k] = ids
    at = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
    if len(at):
        marked = pc.replace_substring(pc.replace_substring(texts.take(at), " ", "\x01 "), "\n", "\x01\n\x01")
        cut = pc.split_pattern(marked, "\x01")
        words = cut.flatten().dictionary_encode()
        index, found, bounds = words.indices.to_numpy(), words.dictionary, cut.offsets.to_numpy() - cut.offsets[0].as_py()
        del marked, cut
        signed = pc.match_substring_regex(found, f"{BARE}[{SIGNS}]$")
        last = pc.index_in(pc.utf8_slice_codeunits(found.filter(signed), -1), value_set=pa.array(list(SIGNS))).to_numpy()
        signed = signed.to_numpy(zero_copy_only=False)
        after = np.full(len(found), len(SIGNS))
        after[signed] = last
        bare = pc.if_else(pa.array(signed), pc.utf8_rtrim(found, characters=SIGNS), found).dictionary_encode()
        of = bare.indices.to_numpy()
        flat, start, size = known.of(bare.dictionary, np.bincount(of, np.bincount(index, minlength=len(found)), len(bare.dictionary)))
        pairs = np.stack([start[of], len(flat) + sign[1][after]], 1).ravel(), np.stack([size[of], sign[2][after]], 1).ravel()
        flat, size = _gather(np.concatenate([flat, sign[0]]), *pairs), size[of] + sign[2][after]
        start = np.cumsum(size) - size
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + WORDS, side="right")) - 1)
            part = index[bounds[lo] : bounds[hi]]
            n = size[part]
            ids, ends = _gather(flat, start[part], n), np.concatenate([[0], np.cumsum(n)])[bounds[lo : hi + 1] - bounds[lo]].tolist()
            for k, a, b in zip(at[lo:hi].tolist(), ends[:-1], ends[1:], strict=True):
                out[k] = ids[a:b]
            lo = hi
    return out  # type: ignore[return-value]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PIECE bytes: more words are found again in larger ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PIECE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_token_files(
    docs: DataFrame, path: str, out: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int = 2, shard_tokens: int = 1_000_000
) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes token files in ascending doc_id order.

    Rows of columns part, seq, n_docs, n_tokens, file: part and seq number the shards in order. Null ids come first;
    rows with the same id lie by the hash of their text, repeated rows side by side. One shuffle, by ranges of id.
    A document is never cut: a shard ends with the document that fills it.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(parts))
            data = to_bytes(matrix, ids, [len(p) for p in parts])
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [total], "file": [data]}, schema=FILES)

        for batch in pieces(batches):
            for d, found in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text"), path), strict=True):
                ids.append(d)
                parts.append(np.append(found, found.dtype.type(end_id)))
                total += len(parts[-1])
                if total >= shard_tokens:
                    yield shard()
                    ids, parts, total, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    write(rows.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, file binary"), out, **{"parquet.block.size": 16 << 20})


FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])
DOCS = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"


def read_token_files(spark, out: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only numbers of tokens are summed up in order, by part and then of each part's shards; documents join their start.
    """
    files = spark.read.schema("part int, seq int, n_docs long, n_tokens long, file binary").parquet(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix, doc_ids, lengths = from_bytes(batch.column("file")[k].as_py())
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[k].as_py()] * n, pa.int32()) for c in ("part", "seq")]
                    + [pa.array(x, pa.int64()) for x in (doc_ids, ends - lengths, lengths, crc)],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per part in the window over all
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = parts.select("part", before("n", Window.orderBy("part")).alias("first"))
    inside = files.select("part", "seq", before("n_tokens", Window.partitionBy("part").orderBy("seq")).alias("inside"))
    starts = inside.join(F.broadcast(first), "part").select("part", "seq", (F.col("first") + F.col("inside")).alias("before"))
    docs = files.select("part", "seq", "file").mapInArrow(run, DOCS)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
