"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts and benchmark items are sequences of lower-cased words (letters and digits; in scripts without blanks between words each
character is a word). The CGK embedding walks
along a sequence; each step emits the current word and moves on if a random bit of (step, word) says so, so that sequences a
few edits apart soon walk in step again and edit distance turns into Hamming distance. Each of ``repeats``
walks has its own bits and its own ``samples`` sampled steps; the sampled words are the key of a window.
Item windows are entered at anchors every ``stride`` words, so an edit spoils the anchors near it only. The walk
from a position reads the text only ``steps`` ahead, less than the shortest item, so one walk serves
item windows of every length. Walks miss some copies by chance, so items are also cut into one piece more than the edits
allowed: each edit touches at most one piece, hence a copy within the edits holds a whole piece, wherever the edits and the copy
are, and no such copy is missed. Candidates are verified exactly: the word edit distance of the whole item to
the best window of the text, at most ``rate`` times the item's words; words are compared by their bytes, after their hashes agree.

Items with 8 to 15 words take walks of 8 steps. Items with 5 to 7 words must occur exactly: they are one piece. Items with fewer
words, or null, never match. The items are held by every task in blocks of at most ``BLOCK_BYTES``; a larger benchmark takes more passes.
No row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as T
from ._spark import bounded

BLOCK_BYTES = 16 << 20
SHORTEST = 5
HITS = "array<struct<item_id:long,distance:int,start:long,end:long>>"


@dataclass(frozen=True)
class Decontam:
    rate: float = 0.15
    repeats: int = 8
    steps: int = 16
    samples: int = 5
    stride: int = 4

    def most(self, n: int) -> int:
        """Edits allowed for an item of ``n`` words."""
        return int(self.rate * n) if n >= 8 else 0


def _unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and bytes of the characters of scripts without blanks: Thai, Lao, Burmese, Khmer, kana, Han."""
    at = np.flatnonzero(buf >= 0xE0)
    if not len(at):
        return at, at
    a, b, c = (buf[np.minimum(at + k, len(buf) - 1)] for k in range(3))
    three = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b == 0x80) | (b == 0x81) | ((b == 0x82) & (c < 0xA0)) | (b == 0x9E) | (b == 0x9F)))
    three |= ((a == 0xE3) & (b != 0x85) & (b != 0x86)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB))
    four = (a == 0xF0) & (b >= 0xA0)
    return at[three | four], np.where(four, 4, 3)[three | four]


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = T.lowered(buf, latin=True)
    inside = T.ALNUM[low]
    starts, ends, first = T.spans(inside, offs)
    at, size = _unspaced(low)
    if len(at):
        cuts = np.unique(np.concatenate([at, at + size]))
        cuts = cuts[cuts < len(low)]
        cuts = np.setdiff1d(cuts[inside[cuts]], starts, assume_unique=True)
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
        first = np.searchsorted(starts, offs)
    return T.word_hash(low, starts, ends), first, starts, ends


def sampled(op: Decontam, steps: int) -> list[tuple[np.uint64, np.ndarray]]:
    """(seed of the bits, sampled steps) of each walk; a rule, so every task draws the same. Steps are drawn freely: a step that all walks
    sampled would lose a window in all of them."""
    out = []
    for r in range(op.repeats):
        order = np.argsort(T.random_u64(steps, 101 + r), kind="stable")
        out.append((T.random_u64(1, 31 + 7 * r)[0], np.sort(order[: op.samples])))
    return out


def pieces(n: int, edits: int) -> list[tuple[int, int]]:
    """(first word, words) of ``edits`` + 1 pieces of an item of ``n`` words, as equal as can be."""
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a]


def _extended(key: np.ndarray, h: np.ndarray, at: np.ndarray, have: int, want: int) -> np.ndarray:
    """The keys of ``want`` words from each position, from those of ``have``."""
    for k in range(have, want):
        key = key * T.U64(0xD6E8FEB86659FD93) + h[at + k]
    return key


def walk_keys(h: np.ndarray, bits: np.ndarray, at: np.ndarray, seed: np.uint64, steps: np.ndarray, allowed: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``at`` whose walks pass every filter in ``allowed``, and their keys; ``bits`` are the words' random bits of this walk."""
    i, key, done = at.copy(), np.full(len(at), seed), 0
    for k, j in enumerate(steps.tolist()):
        for s in range(done, j):
            i += ((bits[i] >> T.U64(s)) & T.U64(1)).astype(np.int64)
        done = j
        word = h[i]
        if allowed is not None:
            ok = allowed[k][(word & T.U64(0xFFFF)).astype(np.int64)]
            at, i, key, word = at[ok], i[ok], key[ok], word[ok]
        key = T.mix(key * T.U64(0xD6E8FEB86659FD93) + word)
    return at, key


class Index:
    """Items' keys for every walk, and the items' words for verification."""

    def __init__(self, items: list[tuple[int, str]], op: Decontam) -> None:
        self.op, self.ids = op, []
        self.words: list[np.ndarray] = []
        self.texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _, starts, ends = _words(raw, np.array([0, len(raw)]))
            if len(h) >= SHORTEST and item_id is not None:
                self.ids.append(item_id)
                self.words.append(h)
                self.texts.append((T.lowered(raw, latin=True), starts.astype(np.int32), ends.astype(np.int32)))
        self.tables = []
        for steps, lo, hi in ((op.steps, op.steps, 1 << 60), (8, 8, op.steps)):
            own = [k for k, w in enumerate(self.words) if lo <= len(w) < hi]
            for seed, picks in sampled(op, steps) if own else []:
                keys, entries, allowed = [], [], [np.zeros(1 << 16, bool) for _ in picks]
                for k in own:
                    w = self.words[k]
                    anchors = np.unique(np.append(np.arange(0, len(w) - steps + 1, op.stride), len(w) - steps))
                    at, key = walk_keys(w, T.mix(w ^ seed), anchors, seed, picks)
                    keys.append(key)
                    entries += [(k, a) for a in at.tolist()]
                    i = anchors.copy()
                    bits, done = T.mix(w ^ seed), 0
                    for n, j in enumerate(picks.tolist()):
                        for s in range(done, j):
                            i = i + ((bits[i] >> T.U64(s)) & T.U64(1)).astype(np.int64)
                        done = j
                        allowed[n][(w[i] & T.U64(0xFFFF)).astype(np.int64)] = True
                keys = np.concatenate(keys)
                order = np.argsort(keys, kind="stable")
                self.tables.append((steps, seed, picks, allowed, keys[order], np.array(entries, np.int64)[order]))
        cut = [(n, k, a) for k, w in enumerate(self.words) for a, n in pieces(len(w), op.most(len(w)))]
        self.least = min((n for n, _, _ in cut), default=0)
        self.seen = np.zeros(1 << min(24, max(16, (16 * len(cut)).bit_length())), bool)
        self.pieces = []
        for n in sorted({n for n, _, _ in cut}):
            entries = np.array([(k, a) for size, k, a in cut if size == n], np.int64)
            windows = np.concatenate([self.words[k][a : a + n] for k, a in entries.tolist()])
            at = np.arange(0, len(windows), n)
            key = _extended(windows[at], windows, at, 1, self.least)
            self.seen[self._slot(key)] = True
            key = _extended(key, windows, at, self.least, n)
            order = np.argsort(key, kind="stable")
            self.pieces.append((n, key[order], entries[order]))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> T.U64(65 - len(self.seen).bit_length())).astype(np.int64)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, estimated start) of each of one chunk's texts, in this order, and a word of the text each was found at; all
        count from the chunk's first word."""
        found, last, bits = [], None, h
        position = np.arange(len(h))
        left = np.repeat(first[1:], np.diff(first)) - position  # words from here to the text's end
        for steps, seed, picks, allowed, keys, entries in sorted(self.tables, key=lambda x: int(x[1])):
            if seed != last:
                bits, last = T.mix(h ^ seed), seed
            at, key = walk_keys(h, bits, position[left >= steps], seed, picks, allowed)
            found.append(self._rows(keys, key, at, entries))
        if self.pieces and len(h) >= self.least:
            key = h[: len(h) - self.least + 1]
            for k in range(1, self.least):
                key = key * T.U64(0xD6E8FEB86659FD93) + h[k : len(h) - self.least + 1 + k]
            at, have = np.flatnonzero(self.seen[self._slot(key)]), self.least
            key = key[at]
            for n, keys, entries in self.pieces:
                ok = left[at] >= n
                at = at[ok]
                key, have = _extended(key[ok], h, at, have, n), n
                found.append(self._rows(keys, key, at, entries))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        text = np.searchsorted(first, rows[:, 2], "right")
        # One start may belong to several texts: those before it and after it, where the texts between are short.
        at = np.lexsort((text, rows[:, 1], rows[:, 0]))
        rows, text = rows[at], text[at]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (text[1:] != text[:-1])
        return rows[new, :2], rows[new, 2]

    @staticmethod
    def _rows(keys: np.ndarray, key: np.ndarray, at: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """(item, estimated start, position) of every key that is in the table."""
        lo = np.searchsorted(keys, key, "left")
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
        lo, at = lo[hit], at[hit]
        n = np.searchsorted(keys, key[hit], "right") - lo
        own, at = entries[T.ranges(lo, n)], np.repeat(at, n)
        return np.stack([own[:, 0], at - own[:, 1], at], 1)


def best_window(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the window of ``text`` nearest to ``item`` by edits, or None if over ``most``. The first of several equally near."""
    n = len(text)
    if not n:
        return None
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    step, first = np.arange(n + 1), np.zeros(1, np.int64)
    for k, w in enumerate(item.tolist(), 1):
        up, diagonal = row + 1, np.empty(n + 1, np.int64)
        diagonal[0] = k
        diagonal[1:] = row[:-1] + (text != w)
        take = diagonal <= up
        take[0] = False
        best = np.where(take, diagonal, up)
        from_ = np.where(take, np.concatenate([first, begin[:-1]]), begin)
        shifted = (best - step) * (n + 2) + step
        low = np.minimum.accumulate(shifted)
        source = low % (n + 2)
        row, begin = low // (n + 2) + step, from_[source]
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(begin[end]), end) if row[end] <= most else None


def _nearest(item: np.ndarray, at: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> dict[int, tuple[int, int, int]]:
    """(distance, start, end) by text of one item's candidates: ``at`` are estimated starts, lo and hi the borders of their texts (lo names
    the text)."""
    n, out = len(item), {}
    inside = np.flatnonzero((at >= lo) & (at + n <= hi))
    same = inside[(h[at[inside, None] + np.arange(n)] == item).all(axis=1)]
    for k in same[::-1].tolist():
        out[int(lo[k])] = (0, int(at[k]), int(at[k]) + n)
    if not most:
        return out
    rest = np.flatnonzero(~np.isin(lo, lo[same]))
    # A window within the edits allowed shares at least n - most words with the item.
    a, z = np.maximum(lo, at - 2 * most)[rest], np.minimum(hi, at + n + 2 * most)[rest]
    where = a[:, None] + np.arange(n + 4 * most)
    shared = (np.isin(h[np.minimum(where, len(h) - 1)], item) & (where < z[:, None])).sum(axis=1)
    last: dict[int, int] = {}
    for k in np.flatnonzero(shared >= n - most).tolist():
        text, start = int(lo[rest[k]]), int(at[rest[k]])
        if start - last.get(text, -99) <= min(2, most):  # inside the window searched last
            continue
        last[text] = start
        best = best_window(item, h[a[k] : z[k]], most)
        if best is not None and (text not in out or best[0] < out[text][0]):
            out[text] = (best[0], int(a[k]) + best[1], int(a[k]) + best[2])
    return out


def _confirmed(index: Index, item: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: tuple[int, int, int], text: tuple[int, int]) -> tuple[int, int, int] | None:
    """A hit with its distance by the words' bytes. If hashes deceived, the nearest window of the whole text (its first and last word are given)."""
    number: dict[bytes, int] = {}
    code = lambda buf, a, z: np.array([number.setdefault(buf[x:y].tobytes(), len(number)) for x, y in zip(a.tolist(), z.tolist(), strict=True)], np.int64)
    own, most = code(*index.texts[item]), index.op.most(len(index.words[item]))
    distance, a, z = found
    if distance == 0 and np.array_equal(own, code(low, starts[a:z], ends[a:z])):
        return found
    for lo, hi in ((a, z), text):
        best = best_window(own, code(low, starts[lo:hi], ends[lo:hi]), most)
        if best is not None:
            return best[0], lo + best[1], lo + best[2]
    return None


def _hits(index: Index, h: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, offs: np.ndarray, buf: np.ndarray | None = None) -> list[list[dict]]:
    """By text, its hits. Distances are told by hashes; with the texts' bytes ``buf``, every hit is confirmed by them."""
    rows: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
    found, anchor = index.candidates(h, first)
    doc = np.searchsorted(first, anchor, "right") - 1
    cuts = np.searchsorted(found[:, 0], np.arange(len(index.words) + 1))
    texts, low = {int(first[d]): d for d in np.unique(doc).tolist()}, None
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[k], cuts[k + 1])
        item = index.words[k]
        near = _nearest(item, found[own, 1], h, first[doc[own]], first[doc[own] + 1], index.op.most(len(item)))
        for text, hit in near.items():
            d = texts[text]
            if buf is not None:
                low = T.lowered(buf, latin=True) if low is None else low
                hit = _confirmed(index, k, low, starts, ends, hit, (int(first[d]), int(first[d + 1])))
                if hit is None:
                    continue
            distance, a, z = hit
            rows[d].append({"item_id": int(index.ids[k]), "distance": distance, "start": int(starts[a] - offs[d]), "end": int(ends[z - 1] - offs[d])})
    for own in rows:
        own.sort(key=lambda x: (x["item_id"], x["distance"], x["start"]))
    return rows


def _scan(docs: DataFrame, items: list[tuple[int, str]], op: Decontam) -> DataFrame:
    """``docs`` with the hits of ``items`` added to its column hits."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    text, hits = docs.columns.index("text"), docs.columns.index("hits")
    cache: list[Index] = []

    def run(batches):
        if not cache:
            cache.append(Index(held.value, op))
        kind = None
        for b in bounded(batches):
            kind = b.schema.field(hits).type
            rows: list[list[dict]] = []
            for _, _, buf, offs in T.chunks(b.column(text), 2 * T.CHUNK):
                h, first, starts, ends = _words(buf, offs)
                rows += _hits(cache[0], h, first, starts, ends, offs, buf)
            if any(len(x) for x in b.column(hits).to_pylist()):
                rows = [(x or []) + y for x, y in zip(b.column(hits).to_pylist(), rows, strict=True)]
            cols = list(b.columns)
            cols[hits] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def find_leaks(docs: DataFrame, benchmark: DataFrame, op: Decontam = Decontam()) -> DataFrame:
    """Every row and column of ``docs`` (text among them) plus hits: for each benchmark item found in the text its item_id, the word edit
    distance of the nearest window found and that window's start and end in UTF-8 bytes, by item_id. Texts without a hit, empty and null texts have
    an empty array. Rows of the benchmark with null id or text are ignored; repeated items each count. An existing column hits is replaced.
    """
    docs = docs.drop("hits").withColumn("hits", F.array().cast(HITS))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        docs = _scan(docs, [tuple(r) for r in own.orderBy("item_id", "text").collect()], op)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, op: Decontam = Decontam()) -> DataFrame:
    """One row for each document and item found in it."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, op).where(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
