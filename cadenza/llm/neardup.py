"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts makes, per document, the set of hashed word shingles, a digest of the
   set, ``bands`` bucket keys of ``rows`` MinHash values each and one byte of every value as signature.
2. Documents with equal sets form a class; only its smallest id goes on, so exact copies cost nothing.
3. In each bucket every member is paired with the smallest id only. Pairs are compared signature batch
   by signature batch; a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold is below ``miss``. Survivors are verified on their full sets, whose shingles are
   numbered by their words' bytes: no hash decides a link. Only equal sets (step 2) are told by a digest, of 128 bits over 64-bit shingle hashes.
4. Links are contracted to components. Buckets that still hold several components are searched
   once more, now across components, in blocks of bounded size that compare and verify inside: so no link that
   could join two components is left out, and no group is expanded into rows of pairs.

``bands`` is derived from ``rows``, the threshold and ``miss``, the chance that a pair exactly at the threshold
shares no bucket. Nothing is capped: hot buckets, classes and components only ever pass through
combined aggregates, joins that AQE can split, and bounded blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded, shuffle_parts, spread, stored
from .components import components

BLOCK = 256
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class NearDup:
    """``threshold`` as a fraction (numerator, denominator), compared without rounding."""

    words: int = 5
    threshold: tuple[int, int] = (80, 100)
    rows: int = 6
    miss: float = 1e-6
    batch: int = 32

    @property
    def bands(self) -> int:
        t = self.threshold[0] / self.threshold[1]
        return math.ceil(math.log(self.miss) / math.log1p(-(t**self.rows)))

    @property
    def size(self) -> int:
        return self.rows * self.bands


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, and the texts' offsets into them."""
    low = T.lowered(buf)
    starts, ends, first = T.spans(~T.SPACE[low], offs)
    h = T.word_hash(low, starts, ends)
    n = np.diff(first)
    grams = T.gram_hash(h, words)
    out, at = [], np.zeros(len(n) + 1, np.int64)
    for k in range(len(n)):
        a, b = first[k], first[k + 1]
        if n[k] >= words:
            s = np.unique(grams[a : b - words + 1])
        elif n[k]:
            s = T.gram_hash(h[a:b], int(n[k])) + T.U64(int(n[k]))
        else:
            s = h[:0]
        out.append(s)
        at[k + 1] = at[k] + len(s)
    return (np.concatenate(out) if out else h[:0]), at


def exact_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted numbers that are equal if and only if the shingles' words are, over the whole column."""
    raw, offs = T.whole(column)
    low = T.lowered(raw)
    starts, ends, first = T.spans(~T.SPACE[low], offs)
    codes = T.exact_codes(low, starts, ends)
    grams = T.exact_grams(codes, words)
    short: dict[bytes, int] = {}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(np.array([len(grams) + short.setdefault(codes[a:b].tobytes(), len(short))] if b > a else [], np.int64))
    return out


def reach(a: np.ndarray, b: np.ndarray, op: NearDup) -> bool:
    """Whether two full sets reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and op.threshold[1] * both >= op.threshold[0] * (len(a) + len(b) - both)


@lru_cache
def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    r = T.random_u64(2 * size, 11)
    return (r[:size] >> T.U64(32)).astype(np.uint32) | np.uint32(1), (r[size:] >> T.U64(32)).astype(np.uint32)


def min_hashes(s: np.ndarray, size: int) -> np.ndarray:
    mul, add = _permutations(size)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    x = (s >> T.U64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    for at in range(0, len(x), 512):
        v = x[at : at + 512, None] * mul
        v += add
        v ^= v >> np.uint32(15)
        np.minimum(out, v.min(axis=0), out=out)
    return out


def signatures(column: pa.Array, op: NearDup) -> tuple[list, list, np.ndarray, list]:
    """Set sizes, set digests, bucket keys and signatures of a column of texts."""
    sizes, digests, sigs = [], [], []
    buckets = np.zeros((len(column), op.bands), np.int64)
    salt = T.random_u64(op.bands, 13)
    for lo, hi, buf, offs in T.chunks(column):
        s, at = shingle_sets(buf, offs, op.words)
        values = np.zeros((hi - lo, op.size), np.uint32)
        for k in range(hi - lo):
            own = s[at[k] : at[k + 1]]
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            if len(own):
                values[k] = min_hashes(own, op.size)
        wide = values.reshape(hi - lo, op.bands, op.rows).astype(np.uint64)
        key = np.broadcast_to(salt, (hi - lo, op.bands))
        for r in range(op.rows):
            key = T.mix(key * T.U64(0xD6E8FEB86659FD93) + wide[:, :, r])
        buckets[lo:hi] = key.view(np.int64)
        sigs += [x.tobytes() for x in (values ^ (values >> np.uint32(8))).astype(np.uint8)]
    return sizes, digests, buckets, sigs


def features(docs: DataFrame, op: NearDup) -> DataFrame:
    """doc_id, n_shingles, set_key, buckets, sig of every row."""

    def run(batches):
        for b in bounded(batches):
            sizes, digests, buckets, sigs = signatures(b.column(1), op)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * op.bands), pa.array(buckets.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), arr, pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "buckets", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, buckets array<long>, sig binary")


@lru_cache
def fewest_matches(size: int, batch: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest equal bytes for which the posterior still allows the threshold).

    Equal bytes have probability p = J + (1 - J) / 256. With a uniform prior and m of n equal, P(p >= q) is
    the binomial tail P(Bin(n + 1, q) <= m).
    """
    q, out = threshold + (1 - threshold) / 256, []
    for n in [*range(batch, size, batch), size]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(q) + (n + 1 - m) * math.log1p(-q))
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, op: NearDup) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential comparison."""
    alive = np.arange(len(a))
    equal, done = np.zeros(len(a), np.int64), 0
    for n, least in fewest_matches(op.size, op.batch, op.threshold[0] / op.threshold[1], op.miss):
        equal[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, done = alive[equal[alive] >= least], n
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    data, offs = T.buffers(column)
    return data[offs[0] : offs[-1]].reshape(-1, size)


def _pruned(pairs: DataFrame, op: NearDup) -> DataFrame:
    """a, b of the pairs (a, b, sig_a, sig_b) that survive."""

    def run(batches):
        for x in batches:
            if x.num_rows:
                keep = survivors(_matrix(x.column(2), op.size), _matrix(x.column(3), op.size), op)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(keep)), x.column(1).take(pa.array(keep))], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, op: NearDup) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches):
        for x in bounded(batches, 4 << 20):
            sets = exact_sets(pa.concat_arrays([x.column(2), x.column(3)]), op.words)
            keep = pa.array([k for k in range(x.num_rows) if reach(sets[k], sets[x.num_rows + k], op)], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0).take(keep), x.column(1).take(keep)], ["a", "b"])

    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


_KEYS = ["bucket", "p", "t"]


def _blocks(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(shuffle_parts(rows, PART_BYTES), *_KEYS).sortWithinPartitions(*_KEYS, *order)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of a partition sorted by block, one at a time."""
    held = None
    for x in batches:
        if not x.num_rows:
            continue
        x = pa.Table.from_batches([x]) if held is None else pa.concat_tables([held, pa.Table.from_batches([x])]).combine_chunks()
        k = np.stack([x.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in _KEYS])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield x.slice(lo, hi - lo).combine_chunks()
        held = x.slice(edges[-1])
    if held is not None:
        yield held.combine_chunks()


def _suspects(members: DataFrame, op: NearDup) -> DataFrame:
    """Of the members (bucket, id, comp, sig, buckets) of mixed buckets, in blocks, those with a surviving partner in another component. The
    first row of a block lists its pairs, the likeliest first.

    Rows outside a bucket's largest component are probes, all rows are targets; a bucket is cut into blocks of about BLOCK
    probes by BLOCK targets. A pair belongs to the first bucket it shares.
    """
    counts = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    top = counts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all_n"))
    size = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    top = top.select("bucket", F.col("top.comp").alias("main"), size(F.col("all_n")).alias("kt"), size(F.col("all_n") - F.col("top.n")).alias("kp"), spread(F.col("bucket")).alias("h"))
    rows = members.withColumn("h", spread(F.col("bucket"))).join(top, ["bucket", "h"])
    dealt = lambda k: F.pmod(F.xxhash64("id", F.lit(5)), k).cast("int")
    own = ["id", "comp", "sig", "buckets"]
    targets = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("kp") - 1)).alias("p"), dealt(F.col("kt")).alias("t"), F.lit(0).alias("probe"), *own)
    probes = rows.where("comp <> main").select("bucket", dealt(F.col("kp")).alias("p"), F.explode(F.sequence(F.lit(0), F.col("kt") - 1)).alias("t"), F.lit(1).alias("probe"), *own)

    def run(batches):
        for g in _groups(batches):
            ids, comp, probe = (g.column(c).combine_chunks().to_numpy() for c in ("id", "comp", "probe"))
            sig = _matrix(g.column("sig"), op.size)
            bands = g.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, op.bands)
            a, b = np.flatnonzero(probe == 1), np.flatnonzero(probe == 0)
            i, j = np.nonzero(comp[a][:, None] != comp[b][None, :])
            i, j = a[i], b[j]
            keep = survivors(sig[i], sig[j], op) if len(i) else i
            i, j = i[keep], j[keep]
            if len(i):
                band = (bands[i] == bands[j]).argmax(axis=1)
                owner = bands[i, band] == g.column("bucket")[0].as_py()
                i, j = i[owner], j[owner]
            if len(i):
                order = np.argsort(-(sig[i] == sig[j]).sum(axis=1), kind="stable")
                pairs = np.stack([ids[i], ids[j]], 1)[order].astype("<i8").tobytes()
                _, used = np.unique(ids[np.union1d(i, j)], return_index=True)
                g = g.take(pa.array(np.union1d(i, j)[used])).select([*_KEYS, "id", "comp"])
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in g.columns), pa.array([pairs] + [None] * (g.num_rows - 1), pa.binary())], [*_KEYS, "id", "comp", "pairs"])

    block = _blocks(targets.unionByName(probes), "probe", "id")
    return block.select(*_KEYS, "probe", *own).mapInArrow(run, "bucket long, p int, t int, id long, comp long, pairs binary")


def _across(members: DataFrame, texts: DataFrame, op: NearDup) -> DataFrame:
    """Links between components, verified block by block on the full sets; pairs that earlier links of the block connect are skipped."""

    def run(batches):
        for g in _groups(batches):
            ids, comp = g.column("id").to_pylist(), g.column("comp").to_pylist()
            root = {c: c for c in comp}
            sets = dict(zip(ids, exact_sets(g.column("text").combine_chunks(), op.words), strict=True))

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            of, links = dict(zip(ids, comp, strict=True)), []
            pairs = np.frombuffer(b"".join(x for x in g.column("pairs").to_pylist() if x), "<i8").reshape(-1, 2)
            for a, b in pairs.tolist():
                x, y = find(of[a]), find(of[b])
                if x != y and reach(sets[a], sets[b], op):
                    root[x] = y
                    links.append((min(a, b), max(a, b)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    found = _suspects(members, op).join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return _blocks(found, "id").select(*_KEYS, "id", "comp", "pairs", "text").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, op: NearDup = NearDup(), id_col: str | Column = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer words than a shingle has one shingle, its
    whole sequence; null, empty and blank texts have none and are linked with nothing. Documents whose
    sets reach the threshold are linked; component_id is the smallest id reachable. Rows that repeat a
    doc_id must repeat its text too; each row comes back. Rows with a null doc_id come back as components of their own (null id,
    kept). Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("doc_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).cast("string").alias("text"))
    feats = stored(features(docs, op), "shingles")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    real = feats.where("n_shingles > 0 and doc_id is not null")
    classes = stored(real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = real.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = stored(reps.select("doc_id", "buckets", "sig"), "reps")
    sigs = reps.select("doc_id", "sig")
    banded = reps.select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("id"))
    shared = stored(banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    stars = banded.withColumn("h", spread(F.col("bucket"))).join(shared.select("bucket", "leader", spread(F.col("bucket")).alias("h")), ["bucket", "h"])
    stars = stored(stars.select("bucket", "id", "leader"), "members")
    pairs = stars.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    links = stored(_verified(_pruned(pairs, op), texts, op), "links")
    comp = components(links)
    members = stars.select("bucket", "id").join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", spread(F.col("bucket")).alias("h"))
    members = members.withColumn("h", spread(F.col("bucket"))).join(mixed, ["bucket", "h"]).join(reps.withColumnRenamed("doc_id", "id"), "id").select("bucket", "id", "comp", "sig", "buckets")
    late = stored(_across(stored(members, "mixed"), texts, op), "links")
    if not late.isEmpty():
        comp = components(links.unionByName(late))
    by_class = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), spread(F.col("set_key")).alias("h"))
    out = feats.select("doc_id", "n_shingles", "set_key", spread(F.col("set_key")).alias("h")).join(by_class, ["set_key", "h"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
