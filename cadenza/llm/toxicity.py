"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels.

A sentence's logit is a bias plus the weights of its words' hashed features (the word and its first 3 to 7
bytes, lower-cased); a document is toxic with probability 1 - prod(1 - p(sentence)). Training sees
only document labels; the noisy-or's gradient decides which sentences carry them, so scoring also tells
where the offending sentences are. Label, language, source and id are never features.

Training uses a bounded sample of labelled rows (``toxic_docs`` and ``clean_docs`` ids, in the order of a hash of the id, texts of at most
``longest`` characters, one text an id, and of each label no more than half of ``sample_bytes`` in that order); scoring
reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from . import _text as T
from ._spark import bounded, give_back_driver

#: Sentence ends.
_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True
_PREFIXES = (3, 4, 5, 6, 7)
#: Words after which a sentence is cut in any case, counted from its own start.
_LONGEST = 32


@dataclass(frozen=True)
class ToxicityFit:
    toxic_docs: int = 1500
    clean_docs: int = 4000
    longest: int = 50_000
    sample_bytes: int = 32 << 20
    bits: int = 18
    evidence: float = 11.0
    scale: float = 2.0
    bias: float = -10.0
    rounds: int = 40
    rate: float = 0.2
    l1: float = 0.01
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    threshold: float = 0.7


def instances(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots (word by word, unused ones at slot 0), each word's sentence, the sentences' documents, and the
    sentences' first bytes."""
    low = T.lowered(buf, latin=True)
    starts, ends, _ = T.spans(T.ALNUM[low], offs)
    first = np.zeros(len(low) + 1, bool)
    first[1:][_STOPS[low]] = True
    first[offs] = True
    first[len(low)] = False
    if len(starts):
        sentence = np.cumsum(first[: len(low)])[starts]
        opens = np.flatnonzero(np.diff(sentence, prepend=-1))
        nth = np.arange(len(starts)) - np.repeat(opens, np.diff(np.append(opens, len(starts))))
        first[starts[(nth > 0) & (nth % _LONGEST == 0)]] = True
    number = np.cumsum(first[: len(low)]) - 1
    begins = np.flatnonzero(first[: len(low)])
    doc = np.searchsorted(offs, begins, "right") - 1
    sums = T.prefix(low)
    slots = np.zeros((len(starts), 1 + len(_PREFIXES)), np.int32)
    size = T.U64((1 << bits) - 2)
    slots[:, 0] = (T.span_hash(sums, starts, ends) % size).astype(np.int32) + 1
    for k, n_bytes in enumerate(_PREFIXES, 1):
        long = ends - starts > n_bytes
        a = starts[long]
        slots[long, k] = (T.span_hash(sums, a, a + n_bytes) * T.U64(2 * n_bytes + 1) % size).astype(np.int32) + 1
    return slots, number[starts], doc, begins


class _Copies:
    """Finds documents that share two of four minimal word hashes with an earlier one of their label: near copies would make their own
    words look like evidence."""

    def __init__(self) -> None:
        self.seen: set[tuple] = set()
        self.first: list[bool] = []

    def add(self, words: np.ndarray, doc: np.ndarray, labels: list[int]) -> None:
        least = np.full((4, len(labels)), np.iinfo(np.uint64).max, np.uint64)
        for k in range(4):
            np.minimum.at(least[k], doc, T.mix(words.astype(np.uint64) ^ T.random_u64(1, 71 + k)[0]))
        pairs = [(a, b) for a in range(4) for b in range(a)]
        for d, label in enumerate(labels):
            keys = [(a, b, int(least[a, d]), int(least[b, d]), label) for a, b in pairs]
            self.first.append(not any(k in self.seen for k in keys))
            self.seen.update(keys)


def sentence_logits(slots: np.ndarray, sentence: np.ndarray, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    """Each feature counts once in a sentence; one without words is never toxic."""
    hot = w[slots] > 0
    once = np.unique(np.repeat(sentence, hot.sum(axis=1)).astype(np.int64) * len(w) + slots[hot])
    z = np.bincount(once // len(w), w[once % len(w)], n) + bias
    z[np.bincount(sentence, minlength=n) == 0] = -np.inf
    return z


def noisy_or(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Documents' scores; those without sentences have 0."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, logits), n))


def fit(texts: list[str] | pa.Array, labels: list[int], op: ToxicityFit = ToxicityFit()) -> ToxicityModel:
    """Projected AdaGrad on the documents' cross entropy, from the features' document odds less one standard error.

    Weights stay non-negative, so that words without evidence neither add to a sentence nor hide what it holds, and the bias is fixed
    low, so that many harmless sentences don't add up to a toxic document. Without texts of either label the model scores
    about 0."""
    size = 1 << op.bits
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(size, np.float32), -30.0, op.threshold)
    y = np.asarray(labels, float)
    column, copies = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), _Copies()
    n1, n0 = np.zeros(size), np.zeros(size)
    # Two passes over the sample: the first counts documents by feature, the second keeps the few features that are evidence.
    for lo, hi, buf, offs in T.chunks(column):
        slots, own, d, _ = instances(buf, offs, op.bits)
        copies.add(slots[:, 0], d[own], labels[lo:hi])
        first = np.array(copies.first[lo:hi])
        pairs = np.unique(slots.T.astype(np.int64) * (hi - lo) + d[own], axis=None)
        slot, its = pairs // (hi - lo), pairs % (hi - lo)
        slot, its = slot[first[its]], y[lo + its[first[its]]]
        n1 += np.bincount(slot, its, size)[:size]
        n0 += np.bincount(slot, 1 - its, size)[:size]
    alone = np.array(copies.first)
    toxic, clean = max(1.0, y[alone].sum()), max(1.0, (1 - y)[alone].sum())
    rate1, rate0 = n1 / toxic, n0 / clean
    odds = np.log((n1 + 1) / (toxic + 2)) - np.log((n0 + 1) / (clean + 2)) - np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1))
    share, n = toxic / (toxic + clean), np.maximum(n1 + n0, 1)
    evidence = n1 * np.log(np.maximum(n1, 1) / (n * share)) + n0 * np.log(np.maximum(n0, 1) / (n * (1 - share)))
    w = np.where((rate1 > rate0) & (evidence >= op.evidence), op.scale * odds.clip(0), 0.0)
    w[0] = 0.0
    kept, docs, blank, n_sentences = [], [], [], 0
    for lo, _, buf, offs in T.chunks(column):
        slots, own, d, _ = instances(buf, offs, op.bits)
        hot = (w[slots] > 0) & alone[lo + d[own]][:, None]
        kept.append(np.unique((np.repeat(own, hot.sum(axis=1)) + n_sentences).astype(np.int64) * size + slots[hot]))
        docs.append(d + lo)
        blank.append(np.bincount(own, minlength=len(d)) == 0)
        n_sentences += len(d)
    once, doc, blank = np.concatenate(kept), np.concatenate(docs), np.concatenate(blank)
    flat, word, part, n_docs, b = once % size, once // size, alone[doc], len(texts), op.bias
    gw = np.full(size, 1e-4)
    for _ in range(op.rounds):
        z = b + np.bincount(word, w[flat], n_sentences)
        z[blank] = -np.inf
        p = noisy_or(z, doc, n_docs).clip(1e-6, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - p) / p, 1.0).clip(-20) / n_docs
        dz = part * pull[doc] / (1 + np.exp(-z.clip(-30, 30)))
        g = np.bincount(flat, dz[word], size) + op.l1 / n_docs * (w > 0)
        gw += g * g
        w = (w - op.rate * g / np.sqrt(gw)).clip(0)
    return ToxicityModel(w.astype(np.float32), float(b), op.threshold)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, op: ToxicityFit = ToxicityFit()) -> ToxicityModel:
    """Fits on the bounded sample of rows that aren't held out. Ids with contradicting or null labels, and null texts, are left out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    chosen = [r for y, n in ((0, op.clean_docs), (1, op.toxic_docs)) for r in marked.where(F.col("lo") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.col("lo").cast("int").alias("y")).collect()]
    if not chosen:
        return fit([], [], op)
    def of(ids: list, value: Column) -> DataFrame:
        """One value an id: rows that repeat an id are to repeat its text."""
        picked = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([r.doc_id for r in ids], pa.int64()), "y": pa.array([r.y for r in ids], pa.int32())}))
        own = docs.where("text is not null").where(F.length("text") <= op.longest).select(F.col("doc_id").cast("long").alias("doc_id"), value.alias("value"))
        return own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("value").alias("value"))

    sizes = {r.doc_id: r.value for r in of(chosen, F.octet_length("text")).collect()}
    held, bounded_ids = [0, 0], []
    for r in chosen:
        if r.doc_id in sizes and held[r.y] + sizes[r.doc_id] <= op.sample_bytes // 2:
            held[r.y] += sizes[r.doc_id]
            bounded_ids.append(r)
    if not bounded_ids:
        return fit([], [], op)
    rows = of(bounded_ids, F.col("text")).orderBy("doc_id").select("value", "y").toArrow()
    model = fit(rows.column("value").combine_chunks(), rows.column("y").to_pylist(), op)
    del rows
    give_back_driver(docs.sparkSession)
    return model


def score(docs: DataFrame, model: ToxicityModel, with_sentences: bool = True) -> DataFrame:
    """Every column of ``docs`` (doc_id and text among them) plus score, and offending: the sentences whose own probability
    is at least a half, as (start, end, score) in UTF-8 bytes. Null, empty and wordless texts have score 0.0. An existing column named score or offending is replaced.
    """
    docs = docs.drop("score", "offending")
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias, at = model.bias, docs.columns.index("text")
    bits = int(len(model.weights)).bit_length() - 1

    def run(batches):
        w = weights.value.astype(np.float64)
        for b in bounded(batches):
            scores, spans = np.zeros(b.num_rows), []
            for lo, hi, buf, offs in T.chunks(b.column(at)):
                slots, sentence, doc, begins = instances(buf, offs, bits)
                z = sentence_logits(slots, sentence, len(doc), w, bias)
                scores[lo:hi] = noisy_or(z, doc, hi - lo)
                if with_sentences:
                    ends = np.append(begins[1:], len(buf))
                    found: list[list[dict]] = [[] for _ in range(hi - lo)]
                    for k in np.flatnonzero(z >= 0):
                        found[doc[k]].append({"start": int(begins[k] - offs[doc[k]]), "end": int(ends[k] - offs[doc[k]]), "score": float(1 / (1 + np.exp(-z[k])))})
                    spans += found
            out = [*b.columns, pa.array(scores)]
            if with_sentences:
                out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names, "score", *["offending"] * with_sentences])

    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    if with_sentences:
        schema = schema.add("offending", ArrayType(StructType().add("start", LongType()).add("end", LongType()).add("score", DoubleType())))
    return docs.mapInArrow(run, schema)


def flag(docs: DataFrame, labels: DataFrame, op: ToxicityFit = ToxicityFit()) -> DataFrame:
    """``score`` with a model trained here, plus held_out and predicted (1 if score >= threshold)."""
    scored = score(docs.drop("held_out", "predicted"), train(docs, labels, op))
    return scored.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("predicted", (F.col("score") >= op.threshold).cast("int"))
