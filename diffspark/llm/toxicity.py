"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Labels are known for documents only. A sentence's probability is a logistic function of the telling terms it holds, a
document's is the noisy-or of its sentences, 1 - product(1 - p); both are learned together from the documents' labels,
so the model finds which sentences offend. Terms are words and stems (a word's first letters), chosen by how unevenly
documents with and without the label hold them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored

#: A word (letters a-z in either case and all characters beyond ASCII), or what ends a sentence.
TOKEN = re.compile(r"[A-Za-z\x80-\U0010FFFF]+|[.!?\n]+")
#: Bytes of lower-case text with a dot for what ends sentences and a space for all else that isn't part of a word.
NORMAL = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x2E if b in b".!?\n" else 0x20 for b in range(256))
SENTENCE = re.compile(rb"[^ .][^.]*")
#: Letters in a stem.
STEMS = range(3, 9)
#: Entries of a task's counts that are held before they are sent on.
HELD = 400_000
#: Words whose terms a worker remembers.
KNOWN = 500_000


def terms_of(word: str) -> list[str]:
    """The word itself and its stems, which are marked by a hyphen behind."""
    return [word, *[f"{word[:k]}-" for k in STEMS if k < len(word)]]


def normal(text: str) -> bytes:
    return text.lower().encode().translate(NORMAL)


def words_in(text: str) -> set[str]:
    """The different words of a text."""
    return {w.decode() for w in set(normal(text).replace(b".", b" ").split())}


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """start, end and lower-case words of every sentence that holds words."""
    start, end, words = 0, 0, []
    for m in TOKEN.finditer(text):
        if m[0][0] in ".!?\n":
            if words:
                yield start, m.end(), words
            words = []
        else:
            if not words:
                start = m.start()
            words.append(m[0].lower())
            end = m.end()
    if words:
        yield start, end, words


def _is_held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(labels: DataFrame, doc_id: str, label: str, most: int) -> DataFrame:
    """id, toxic of at most `most` labelled documents of each class that aren't held out, the first by a hash of their id.
    A document labelled more than once is toxic if any label says so."""
    rows = labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~_is_held_out(doc_id))
    rows = rows.groupBy(F.col(f"`{doc_id}`").cast("string").alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic"))
    halves = [rows.where("toxic > 0" if x else "toxic <= 0").orderBy(F.xxhash64("id"), "id").limit(most) for x in (0, 1)]
    return halves[0].unionByName(halves[1]).select("id", (F.col("toxic") > 0).cast("int").alias("toxic"))


def _signature(text: str) -> int:
    """The least hash of a text's words: near copies share it more often than not."""
    return min(map(xxhash.xxh64_intdigest, set(normal(text).replace(b".", b" ").split())), default=0) - (1 << 63)


def training_texts(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most: int) -> DataFrame:
    """toxic, text: the sample's documents, of near copies one for each label."""
    sample = labelled_sample(labels, "doc_id", label, most)
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                signature = [_signature(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(signature, pa.int64()), batch.column("text")], ["toxic", "signature", "text"])

    signed = stored(rows.select("toxic", "text").mapInArrow(run, "toxic int, signature long, text string"), "tox-sample")
    first = signed.groupBy("toxic", "signature").agg(F.min(F.xxhash64("text")).alias("h"))  # texts are moved only if they stay
    kept = signed.join(F.broadcast(first), ["toxic", "signature"]).where(F.xxhash64("text") == F.col("h"))
    return stored(kept.dropDuplicates(["toxic", "signature"]).select("toxic", "text"), "tox-train")


def choose_terms(train: DataFrame, n_terms: int, least_docs: int, least_gain: float) -> list[tuple[str, float]]:
    """term, log odds: the terms that toxic documents hold more often than others, the n_terms with the highest
    likelihood-ratio statistic, in the terms' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def sent() -> pa.RecordBatch:
            both = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array([b[k] for b in both], pa.int64()) for k in (0, 1)]], ["term", "clean", "toxic"])

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                for term in {t for w in words_in(text.as_py()) for t in terms_of(w)}:
                    held.setdefault(term, [0, 0])[toxic] += 1
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    size = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    a, b = size.get(1, 0), size.get(0, 0)
    if not a:
        return []
    counts = train.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("toxic") + F.col("clean")) / (a + b)

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    gain = 2 * (part(F.col("toxic"), a * share) + part(F.col("clean"), b * share) + part(a - F.col("toxic"), a * (1 - share)) + part(b - F.col("clean"), b * (1 - share)))
    odds = F.log((F.col("toxic") + 0.5) / (a + 1) / ((F.col("clean") + 0.5) / (b + 1)))
    told = counts.where(F.col("toxic") >= least_docs).withColumns({"gain": gain, "odds": odds}).where((F.col("gain") >= least_gain) & (F.col("odds") > 0))
    best = told.orderBy(F.desc("gain"), "term").limit(n_terms).collect()
    return sorted((r.term, r.odds) for r in best)


class Known(dict):
    """word -> numbers of its terms, none for most; worked out when first asked for."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> tuple[int, ...] | None:
        found = tuple(k for k in map(self.terms.get, terms_of(word.decode())) if k is not None) or None
        self[word] = found
        return found


@dataclass
class Model:
    """bias and the weight of every term."""

    terms: dict[str, int]
    weights: np.ndarray
    bias: float

    def patterns(self, texts: list[str]) -> list[tuple[int, Counter]]:
        """For each text the number of sentences without telling terms, and the sets of terms of the others, counted.
        Texts without any telling term are not taken apart."""
        known = self.__dict__.setdefault("known", Known(self.terms))
        if len(known) > KNOWN:
            known.clear()
        out = []
        for text in texts:
            data = normal(text)
            if not any(map(known.__getitem__, data.replace(b".", b" ").split())):
                out.append((len(SENTENCE.findall(data)), Counter()))
                continue
            plain, sets = 0, Counter()
            for words in map(bytes.split, data.split(b".")):
                if own := {k for v in map(known.__getitem__, words) if v for k in v}:
                    sets[tuple(sorted(own))] += 1
                elif words:
                    plain += 1
            out.append((plain, sets))
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def sentence_score(self, ids) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[list(ids)].sum()))))

    def judged(self, plain: int, sets: Counter) -> tuple[float, float]:
        """Noisy-or of a text's sentences, and the highest score of a sentence with telling terms. A text without
        sentences has none that offends."""
        z = [self.bias, *[self.bias + sum(map(self.weights.__getitem__, s)) for s in sets]]
        total = float(np.logaddexp(0, z) @ [plain, *sets.values()])
        return float(-np.expm1(-total)), float(1 / (1 + np.exp(-max(z[1:]))) if sets else 0.0)

    def score(self, plain: int, sets: Counter) -> float:
        return self.judged(plain, sets)[0]

    def offending(self, text: str, least: float) -> list[tuple[int, int, float]]:
        """start, end and score of the sentences whose own score reaches least."""
        out = []
        for start, end, words in sentences(text):
            ids = {k for w in words for k in map(self.terms.get, terms_of(w)) if k is not None}
            if ids and (p := self.sentence_score(ids)) >= least:
                out.append((start, end, p))
        return out


def learn(rows: list[tuple[int, int, dict]], terms: list[tuple[str, float]], steps: int = 400, rate: float = 0.05, decay: float = 2e-3) -> Model:
    """Weights by Adam steps on the documents' mean log loss with a quadratic penalty.

    rows: toxic, number of plain sentences, sets of terms and their counts. With L = sum of softplus(z) over a
    document's sentences the noisy-or is 1 - exp(-L), so its loss is L for a clean document and -log(1 - exp(-L)) for a toxic one.
    """
    y = np.array([r[0] for r in rows], float)
    doc, count, ids, at = [], [], [], []
    for k, (_, plain, sets) in enumerate(rows):
        if plain:
            doc.append(k)
            count.append(plain)
        for s, c in sets.items():
            at += [len(doc)] * len(s)
            ids += s
            doc.append(k)
            count.append(c)
    doc, count, ids, at = (np.array(v, np.int64) for v in (doc, count, ids, at))
    weight = np.full(len(y), 1 / max(len(y), 1))
    x = np.array([-5.0, *[o for _, o in terms]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = x[0] + np.bincount(at, x[1:][ids], len(doc))
        total = np.bincount(doc, count * np.logaddexp(0, z), len(y))
        slope = weight * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 700)), 1)
        by_sentence = slope[doc] * count / (1 + np.exp(-z))
        gradient = np.concatenate([[by_sentence.sum()], np.bincount(ids, by_sentence[at], len(terms)) + decay * x[1:] / max(len(terms), 1)])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({t: k for k, (t, _) in enumerate(terms)}, x[1:], float(x[0]))


def fit_model(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = 20_000, n_terms: int = 4000, least_docs: int = 3, least_gain: float = 12.0
) -> Model:
    """The model of a bounded sample: at most `most` labelled documents of each class and n_terms terms. Terms are
    counted, and texts turned into sets of terms, in tasks; the driver gets counted sets of term numbers."""
    train = training_texts(docs, labels, text, doc_id, label, most)
    terms = choose_terms(train, n_terms, least_docs, least_gain)
    blank = Model({t: k for k, (t, _) in enumerate(terms)}, np.zeros(len(terms)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = blank.patterns(batch.column("text").to_pylist())
                sets = [[{"ids": list(k), "n": n} for k, n in s.items()] for _, s in found]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([p for p, _ in found], pa.int64()), pa.array(sets, pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("n", pa.int64())])))], ["toxic", "plain", "sets"])

    packed = train.mapInArrow(run, "toxic int, plain long, sets array<struct<ids: array<int>, n: bigint>>").collect()
    rows = sorted((r.toxic, r.plain, tuple(sorted((tuple(s.ids), s.n) for s in r.sets))) for r in packed)
    return learn([(t, p, dict(s)) for t, p, s in rows], terms)


def toxicity(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", keep: list[str] | None = None, limit: float = 0.7, sentence_limit: float = 0.5, **options
) -> DataFrame:
    """Scores every whole text and locates its offending sentences; no shuffle of texts but of the training sample's.

    Returns the columns named in keep (by default all), held_out boolean (crc32 of the id as text leaves 1 over 3),
    score double, predicted int (score >= limit) and offending, an array of start, end (code points, end exclusive) and
    score of the sentences whose own score reaches sentence_limit. labels: doc_id and the label column; labels of
    held-out documents, null labels and null ids are left out. A null or empty text, or one without words, scores 0. Repeated rows
    are scored alike. Without any toxic training document every score comes from the bias alone. Input columns
    with the names of results give way. options: those of fit_model().
    """
    model = fit_model(docs, labels, text=text, doc_id=doc_id, label=label, **options)
    own = ["held_out", "score", "predicted", "offending"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    held, whole = fresh("held", keep), fresh("text", [*keep, "held"])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], _is_held_out(doc_id).alias(held), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                texts = batch.column(len(keep) + 1).to_pylist()
                found = model.patterns(texts)
                judged = [model.judged(*f) for f in found]
                score = np.array([s for s, _ in judged])
                where = [model.offending(t, sentence_limit) if worst >= sentence_limit else [] for t, (_, worst) in zip(texts, judged, strict=True)]
                where = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in w] for w in where]
                arrays = [pa.array(score), pa.array((score >= limit).astype(np.int32)), pa.array(where, spans)]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep) + 1)] + arrays, [*keep, *own])

    more = T.StructType.fromDDL("held_out boolean, score double, predicted int, offending array<struct<start: int, end: int, score: double>>")
    schema = T.StructType([docs.schema[c] for c in keep] + more.fields)
    return source.mapInArrow(run, schema)
