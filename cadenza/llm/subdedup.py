"""Exact substring dedup by super-k-mer partitioning.

A window is ``words`` consecutive words; its minimiser is the smallest hash among its ``gram``-word pieces. Consecutive
windows that share a minimiser are one super-k-mer and travel as one packed string, so a word is sent a few times instead of once
for each of its windows. Equal windows have equal minimisers, hence meet in one bucket.

1. ``_minimisers``: each task finds its super-k-mers. Minimisers that repeat within a batch are known to repeat and are
   announced once with their count; the others go, packed as integers, to buckets that find those occurring in several
   batches. All other super-k-mers can't hold a repeated window and never travel as text.
2. ``_packed``: the remaining ones are cut out of the texts. Equal strings within a batch are resolved at once: all but the first
   are repeats in full. What is left, at most one row a string and batch, goes to its minimiser's bucket. Minimisers
   with more than ``heavy`` super-k-mers are dealt by the whole window instead, one window a string, and a task sends such a
   window once, not once a batch, so that no passage, however common, fills one bucket.
3. ``_resolved``: a bucket sorts its windows by content, then document, then start; all but the first of a run are removed. Hashes only
   bring windows together: their words are numbered by their bytes, and equal content means equal numbers.
4. Removed spans are joined back to the texts, whose shuffle is the one of step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded, parts_for, stored

#: Bytes of the input's size estimate a bucket.
BUCKET_BYTES = 3 << 20
#: Buckets of minimisers whose rows share a file, where that leaves four files a core.
FILE_BUCKETS = 16
#: Heavy minimisers' windows held by a task before they are sent.
COMMON = 50_000


@dataclass(frozen=True)
class SubDedup:
    words: int = 20
    gram: int = 6
    heavy: int = 4000


_ASK = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
_NOTE = np.dtype([("hash", "<u8"), ("count", "<i8")])
_SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])
_FOUND = "doc_id long, hash long, start int, n int, heavy boolean"


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = T.spans(~T.SPACE[buf], offs)
    return T.word_hash(buf, starts, ends), first, starts, ends


def super_kmers(h: np.ndarray, first: np.ndarray, op: SubDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, text, first window (in the text's words) and number of windows of every super-k-mer. One ends with its
    occurrence of the minimiser, so windows that repeat have minimisers that repeat, within one text too."""
    grams = T.gram_hash(h, op.gram)
    low = T.sliding_min(grams, op.words - op.gram + 1)
    n = np.diff(first)
    valid = T.ranges(first[:-1], np.maximum(n - op.words + 1, 0))
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    m = low[valid]
    new = np.ones(len(valid), bool)
    # A minimiser at a window's first word leaves with it: if the next window's is equal, it is another occurrence.
    new[1:] = (valid[1:] != valid[:-1] + 1) | (m[1:] != m[:-1]) | (grams[valid[:-1]] == m[:-1])
    at = np.flatnonzero(new)
    doc = np.searchsorted(first, valid[at], "right") - 1
    return m[at], doc, valid[at] - first[doc], np.diff(np.append(at, len(valid)))


def _minimisers(docs: DataFrame, op: SubDedup, buckets: int) -> DataFrame:
    """Super-k-mers whose minimiser occurs more than once, and a row without doc_id for each heavy minimiser."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 12 << 20):
            ids, found = b.column(0).to_numpy(), []
            for lo, _, buf, offs in T.chunks(b.column(1)):
                h, first, _, _ = word_hashes(buf, offs)
                m, doc, start, n = super_kmers(h, first, op)
                rows = np.empty(len(m), _ASK)
                rows["hash"], rows["doc"], rows["start"], rows["n"] = m, ids[lo + doc], start, n
                found.append(rows)
            rows = np.concatenate(found)
            _, back, count = np.unique(rows["hash"], return_inverse=True, return_counts=True)
            known = count[back] > 1
            notes = np.empty(int((count > 1).sum()), _NOTE)
            notes["hash"], notes["count"] = np.unique(rows["hash"][known]), count[count > 1]
            out = []
            for kind, part, key in ((0, rows[~known], "hash"), (1, notes, "hash"), (2, rows[known], "doc")):
                to = (T.mix(part[key].astype(np.uint64)) % T.U64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                part = part[order]
                out += [(k, kind, part[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

    def meet(rows: pa.Table) -> pa.Table:
        kinds, data = rows.column("kind").to_pylist(), rows.column("payload").to_pylist()
        take = lambda k, t: np.frombuffer(b"".join(x for x, own in zip(data, kinds, strict=True) if own == k), t)
        asks, notes, known = take(0, _ASK), take(1, _NOTE), take(2, _ASK)
        every = np.concatenate([asks["hash"], notes["hash"]])
        weight = np.concatenate([np.ones(len(asks)), notes["count"].astype(float)])
        kinds_of, back = np.unique(every, return_inverse=True)
        times, total = np.bincount(back, minlength=len(kinds_of)), np.bincount(back, weight, len(kinds_of))
        again = asks[times[back[: len(asks)]] > 1]
        found = np.concatenate([again, known])
        heavy = kinds_of[total > op.heavy]
        n = len(found)
        return pa.table({
            "doc_id": pa.array(np.append(found["doc"], np.zeros(len(heavy), np.int64)), pa.int64(), mask=np.arange(n + len(heavy)) >= n), "hash": np.append(found["hash"], heavy).view(np.int64),
            "start": np.append(found["start"], np.zeros(len(heavy), np.int32)), "n": np.append(found["n"], np.zeros(len(heavy), np.int32)), "heavy": np.arange(n + len(heavy)) >= n,
        })

    packed = docs.mapInArrow(scan, "bucket int, kind int, payload binary")
    return packed.groupBy("bucket").applyInArrow(meet, _FOUND)


_ROWS = "bucket int, key long, doc_id long, start int, n int, words binary"


def _packed(rows: DataFrame, op: SubDedup, buckets: int) -> DataFrame:
    """From (doc_id, text, found): strings for the buckets, and spans already known to go (n = -1, end in ``key``)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "key", "doc_id", "start", "n", "words"])

    def sent(strings: dict[tuple[int, bytes], tuple[int, int, int]]) -> list[tuple]:
        return [(key % buckets, key, doc, start, n, text) for (key, text), (doc, start, n) in strings.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[tuple[int, bytes], tuple[int, int, int]] = {}  # heavy minimisers' windows, over all batches of the task
        for b in bounded(batches, 2 << 20):
            least: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            out: list[tuple] = []
            for doc, raw, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = raw.split()
                pieces = []
                for x in found:
                    key, start, n = x["hash"], x["start"], x["n"]
                    if start + n + op.words - 1 > len(words):
                        continue
                    if x["heavy"]:
                        pieces += [(None, k, 1) for k in range(start, start + n)]
                    else:
                        pieces.append((key, start, n))
                for key, start, n in pieces:
                    text, known = b" ".join(words[start : start + n + op.words - 1]), least
                    if key is None:
                        key, known = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True), common
                    old = known.get((key, text))
                    if old is None or (doc, start) < old[:2]:
                        known[key, text] = (doc, start, n)
                        if old is not None:
                            out.append((old[0] % buckets, old[1] + old[2] + op.words - 1, old[0], old[1], -1, b""))
                    elif (doc, start) != old[:2]:
                        out.append((doc % buckets, start + n + op.words - 1, doc, start, -1, b""))
            out += sent(least)
            if len(common) > COMMON:
                out += sent(common)
                common.clear()
            if out:
                yield batch(out)
        if common:
            yield batch(sent(common))

    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "found").mapInArrow(run, _ROWS)


def repeated_windows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the windows of packed strings whose words start earlier elsewhere."""
    buf, offs = T.whole(column)
    starts, ends, first = T.spans(~T.SPACE[buf], offs)
    codes = T.exact_codes(buf, starts, ends)
    h = T.mix(codes.astype(np.uint64))
    row = np.repeat(np.arange(len(n)), n)
    at = T.ranges(first[:-1], n)
    where = T.ranges(start.astype(np.int64), n)
    d = doc[row]
    grams = T.gram_hash(h, words)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((where, d, grams))
    grams, at, where, d = grams[order], at[order], where[order], d[order]
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = grams[1:] != grams[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        differ = np.zeros(len(at), bool)
        for lo in range(0, len(at), 200_000):
            a, b = at[lo : lo + 200_000], at[head[lo : lo + 200_000]]
            same = np.ones(len(a), bool)
            for k in range(words):
                same &= codes[a + k] == codes[b + k]
            differ[lo : lo + 200_000] = ~same
        if not differ.any():
            gone = (d != d[head]) | (where != where[head])
            return d[gone], where[gone]
        grams = grams.copy()  # one hash, several contents: those unlike the first go on as another kind
        grams[differ] = T.mix(grams[differ] + T.U64(1))
        order = np.lexsort((where, d, grams))
        grams, at, where, d = grams[order], at[order], where[order], d[order]
    return d, where


def _resolved(packed: DataFrame, op: SubDedup) -> DataFrame:
    """doc_id and packed spans of words to remove."""

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        doc, start, n, key = (rows.column(c).combine_chunks().to_numpy() for c in ("doc_id", "start", "n", "key"))
        own = np.flatnonzero(n >= 0)
        d, s = repeated_windows(doc[own], start[own], n[own], rows.column("words").combine_chunks().take(pa.array(own)), op.words)
        e = s + op.words
        known = np.flatnonzero(n < 0)
        d, s, e = np.append(d, doc[known]), np.append(s, start[known]), np.append(e, key[known])
        order = np.lexsort((s, d))
        d, s, e = d[order], s[order], e[order]
        if len(d):
            # spans of a document that touch are one
            base = np.cumsum(np.append(0, d[1:] != d[:-1])) * (1 << 40)
            reach = np.maximum.accumulate(e + base) - base
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] > reach[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(d)) - 1
            d, s, e = d[at], s[at], reach[last]
        spans = np.empty(len(d), _SPAN)
        spans["start"], spans["end"] = s, e
        docs, cut = np.unique(d, return_index=True)
        cut = np.append(cut, len(d))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "spans": pa.array([spans[cut[k] : cut[k + 1]].tobytes() for k in range(len(docs))], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, spans binary")


def repeated_spans(docs: DataFrame, op: SubDedup = SubDedup()) -> DataFrame:
    """doc_id, text (binary) and spans (array of packed word spans to remove, or null) of every row of ``docs`` (doc_id, text)."""
    # A column of the right type is taken as it is: an alias would keep Spark from seeing that the texts are dealt twice alike.
    key = F.col("doc_id") if docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(key, F.col("text").cast("string").cast("binary").alias("text"))
    real = docs.where("doc_id is not null and text is not null")
    buckets = parts_for(docs, BUCKET_BYTES, 128)
    files = max(4 * docs.sparkSession.sparkContext.defaultParallelism, buckets // FILE_BUCKETS)
    found = stored(_minimisers(real, op, buckets).coalesce(files), "minimisers")
    heavy = found.where("heavy").select("hash", F.lit(True).alias("is_heavy")).distinct()
    found = found.where("not heavy").select("doc_id", "hash", "start", "n").join(heavy, "hash", "left")
    item = F.struct("hash", "start", "n", F.coalesce("is_heavy", F.lit(False)).alias("heavy"))
    by_doc = found.groupBy("doc_id").agg(F.collect_list(item).alias("found"))
    # Both joins deal the texts alike, so their shuffle is made once.
    spans = _resolved(_packed(real.join(by_doc, "doc_id"), op, buckets), op)
    out = real.join(spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "doc_id", "left")
    return out.unionByName(docs.where("doc_id is null or text is null").withColumn("spans", F.array().cast("array<binary>")))


def _kept(raw: bytes | None, spans: list[bytes] | None) -> tuple[int, int, str]:
    words = (raw or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words).decode()
    s = np.frombuffer(b"".join(spans), _SPAN)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, s["start"], 1)
    np.add.at(gone, np.minimum(s["end"], len(words)), -1)
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([words[k] for k in np.flatnonzero(keep).tolist()]).decode()


def dedup_substrings(docs: DataFrame, op: SubDedup = SubDedup()) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words kept, joined by a blank) of every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word covered by a window whose words also start earlier, in a smaller doc_id or earlier
    in the same document, is removed; windows are judged on the input. Null, empty and short texts have no window and keep all
    words. Rows that repeat a doc_id must repeat its text; they count as one document. Rows with a null doc_id are left alone
    and cause no removal. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 4 << 20):
            rows = [_kept(raw, spans) for raw, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept"])

    return repeated_spans(docs, op).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
