"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, memory-mapped when read.

Format of a store folder
    part-*.tokens  little-endian unsigned integers, 2 bytes each if the vocabulary fits into them, else 4
    part-*.offsets little-endian unsigned 64-bit integers: where each document of the part starts, counted in ids from
                   the start of the whole store, then the end of the part
    docs/          Parquet: part file, position in it, doc_id, n_tokens of every document
    manifest/      Parquet, one row a part: file, offsets file, base, n_docs, n_tokens, width, in ascending order
    parts/, named/ Parquet: what the manifest is joined from
Documents stand in ascending doc_id order over all parts (null ids first, repeated ids in the order of their texts).

Documents are dealt by ranges of doc_id and the text's first characters (so that null or repeated ids don't fill one part) and sorted; each
task encodes its range and writes one part. A part's base is the prefix sum of the parts before it, taken over one row a
part. Names of both kinds of files hold the attempt, and only files named by committed rows belong to the store, so a lost
executor's or a speculative task's files are never read, nor written over. Paths go through Arrow's file systems; local files are memory-mapped.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded, parts_for, scratch

#: Bytes of Catalyst's size estimate a part.
PART_BYTES = 24 << 20
#: Parts whose index rows share a file, where there are more parts than cores. On local disks Hadoop starts a process for every file it makes, and one
#: more for its checksum.
INDEX_PARTS = 16
#: Pieces kept by a worker, bytes of the longest that is kept, and characters of texts that are encoded whole at a time.
_CACHE, _LONGEST, _AT_ONCE = 600_000, 64, 1 << 18
#: Unknown pieces a text that the tokenizer gets; the longer a text, the slower.
_TEXT = 64
#: Characters of a text that deal rows of one id.
_DEALT = 32
#: Blanks that stand beside white space or at a text's border.
_WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_ODD = rf"\A | \z| {_WHITE}|{_WHITE} |\x01"
#: A mark behind a letter starts a pre-token whatever follows; \x01 tells pieces cut there from those led by a blank.
_MARK = r"(\p{L})([.,;:!?])"


class Encoder:
    """The tokenizer behind a cache of blank-led pieces.

    Byte-level pre-tokenization never lets a token cross the border before a single blank that stands between two other
    characters, nor the one between a letter and a punctuation mark. So a column of texts is cut there by Arrow, its distinct
    pieces are looked up, the unknown ones are encoded together (a led piece's first token is the only one that starts with
    the blank's byte symbol), and the texts' ids are gathered from the pieces' by position. Texts with other blanks, and those that
    hold one of the vocabulary's added tokens, which the tokenizer looks for before anything else, are encoded on their own.

    Known pieces and their ids are two Arrow columns, some 40 bytes a piece; of more than ``_CACHE`` the half used in most batches stays.
    """

    def __init__(self, path: str, end: int = 0, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and every further thread an arena of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *map(re.escape, sorted(added))])
        n = self.tokenizer.get_vocab_size()
        self.width = 2 if n <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.leads = np.zeros(n, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.leads[k] = token.startswith("Ġ")
        self.end = np.array([end], self.dtype).tobytes()
        self.pieces, self.ids, self.uses = pa.array([""]), pa.array(self._each([" "]), pa.large_binary()), np.ones(1, np.int32)

    def _each(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= _AT_ONCE):
                size, to = size + len(texts[to]), to + 1
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False)]
            at = to
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of pieces: those behind a blank as they are, those behind a letter with \x01 in front. The latter are encoded behind a letter too, whose
        only token is then left out."""
        width, letter, led = self.width, self._each([" a"])[0], {"": self._each([" "])[0]}
        for bare in (False, True):
            kind = [w for w in words if w and (w[0] == "\x01") == bare]
            joint, odd = (kind, []) if len(letter) == width or not bare else ([], kind)
            for at in range(0, len(joint), 8192):
                some = joint[at : at + 8192]
                texts = [some[k : k + _TEXT] for k in range(0, len(some), _TEXT)]
                texts = [" a" + " a".join([w[1:] for w in x]) if bare else " " + " ".join(x) for x in texts]
                ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
                starts = np.flatnonzero(self.leads[ids])
                if len(starts) != len(some):  # not a byte-level vocabulary of the expected kind
                    odd += some
                    continue
                raw, skip = ids.tobytes(), width * bare
                cuts = [*(starts * width).tolist(), len(raw)]
                led.update((w, raw[a + skip : b]) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
            led.update(zip(odd, self._each([w[1:] if bare else " " + w for w in odd]), strict=True))
        return [led[w] for w in words]

    def _looked_up(self, words: pa.Array, used: np.ndarray) -> pa.Array:
        """The ids of distinct pieces, whatever they are of those not used."""
        found = pc.index_in(words, self.pieces)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().copy()
        self.uses[at[known]] += 1
        unknown = np.flatnonzero(used & ~known)
        new = words.take(pa.array(unknown))
        ids = pa.array(self._learn(new.to_pylist()), pa.large_binary())
        at[unknown] = len(self.pieces) + np.arange(len(unknown))
        out = pa.concat_arrays([self.ids, ids]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(new), _LONGEST)
        self.pieces = pa.concat_arrays([self.pieces, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, ids.filter(short)])
        self.uses = np.append(self.uses, np.ones(len(self.pieces) - len(self.uses), np.int32))
        if len(self.pieces) > _CACHE:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: max(1, _CACHE // 2)])
            self.pieces, self.ids, self.uses = self.pieces.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.uses[kept] // 2
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, the end id behind each text, and the texts' numbers of ids."""
        column = column.fill_null("")
        odd = np.flatnonzero(pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False))
        whole = dict(zip(odd.tolist(), self._each(column.take(pa.array(odd)).to_pylist()), strict=True))
        if whole:
            mask = np.zeros(len(column), bool)
            mask[odd] = True
            column = pc.if_else(pa.array(mask), "", column)
        lists = pc.split_pattern(pc.replace_substring_regex(column, _MARK, "\\1 \x01\\2"), " ")
        offs = lists.offsets.to_numpy().astype(np.int64)
        offs -= offs[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        rest = np.ones(len(codes), bool)
        rest[offs[:-1]] = False
        used = np.zeros(len(words), bool)
        used[codes[rest]] = True
        heads = self._each(lists.flatten().take(pa.array(offs[:-1])).to_pylist())
        own = pa.array([self.end, *(whole.get(k, h) for k, h in enumerate(heads))], pa.large_binary())
        n = len(column)
        piece = np.empty(len(codes) + n, np.int64)
        piece[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offs))] = codes
        piece[offs[:-1] + np.arange(n)] = len(words) + 1 + np.arange(n)
        ends = offs[1:] + np.arange(n)
        piece[ends] = len(words)
        _, cuts, data = pa.concat_arrays([self._looked_up(words, used), own]).take(pa.array(piece)).buffers()
        cuts = np.frombuffer(cuts, np.int64)[: len(piece) + 1] // self.width
        return np.frombuffer(data, self.dtype)[: cuts[-1]], np.diff(np.append(0, cuts[ends + 1]))


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _mapped(folder: str, name: str, dtype: np.dtype) -> np.ndarray:
    """A file's integers: mapped where the file system is local, else read."""
    files, root = _files(folder)
    if isinstance(files, fs.LocalFileSystem):
        path = f"{root}/{name}"
        return np.zeros(0, dtype) if files.get_file_info(path).size == 0 else np.memmap(path, dtype, "r")
    with files.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, part_bytes: int = PART_BYTES, special_as_text: bool = False) -> None:
    """Encodes doc_id and text of every row into a new store. Null and empty texts are the end id alone. Other columns are ignored.
    An empty table gives a store of no parts. A special token's string in a text becomes its id, as the library has it, or with
    ``special_as_text`` the ids of an ordinary text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_parts = parts_for(docs, part_bytes, max(2, spark.sparkContext.defaultParallelism), 50_000)
    rows = rows.repartitionByRange(n_parts, "doc_id", F.substring("text", 1, _DEALT)).sortWithinPartitions("doc_id", "text")
    files, root = _files(folder)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, c = _encoder(tokenizer, end, special_as_text), TaskContext.get()
        name = f"part-{c.partitionId():06d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tokens"
        out, position, local = None, 0, 0
        files, root = _files(folder)
        try:
            for b in bounded(batches, 4 << 20):
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}")
                ids, n = enc.encode(b.column(1))
                out.write(ids.tobytes())
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.partitionId()] * k, pa.int32()), pa.array([name] * k), pa.array([enc.width] * k, pa.int32()), pa.array(np.arange(position, position + k)), b.column(0), pa.array(n), pa.array(local + np.cumsum(n) - n)],
                    ["part", "file", "width", "position", "doc_id", "n_tokens", "local_start"],
                )
                position, local = position + k, local + int(n.sum())
        finally:
            if out is not None:
                out.close()

    written = rows.mapInArrow(write, "part int, file string, width int, position long, doc_id long, n_tokens long, local_start long")
    # All of a part's rows go to one task, hence come from one attempt of the task that wrote the part.
    n_files = min(n_parts, max(spark.sparkContext.defaultParallelism, n_parts // INDEX_PARTS))
    written.repartition(n_files, F.col("part") % n_files).sortWithinPartitions("part", "position").write.parquet(f"{folder}/docs")
    index = spark.read.parquet(f"{folder}/docs")
    parts = index.groupBy("part", "file", "width").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    parts.write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    _write_offsets(index, parts, folder, max(1, n_parts // 4))
    named = spark.read.parquet(f"{folder}/named")
    parts.join(named, "file").select("part", "file", "width", "n_docs", "n_tokens", "base", "offsets").coalesce(1).sortWithinPartitions("part").write.parquet(f"{folder}/manifest")


def _write_offsets(index: DataFrame, parts: DataFrame, folder: str, tasks: int) -> None:
    """Each part's document offsets, counted from the store's start, and in named/ the files that hold them."""
    rows = index.join(parts.select("file", "base", F.col("n_tokens").alias("part_tokens")), "file")
    rows = rows.select("file", "position", (F.col("base") + F.col("local_start")).alias("start"), (F.col("base") + F.col("part_tokens")).alias("stop"))
    rows = rows.repartition(tasks, "file").sortWithinPartitions("file", "position")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        part, out, stop, named = None, None, 0, []
        for b in batches:
            for k in b.column(0).unique().to_pylist():
                own = b.filter(pc.equal(b.column(0), k))
                if k != part:
                    if out is not None:
                        out.write(np.array([stop], "<u8").tobytes())
                        out.close()
                    named.append((k, f"{k.removesuffix('.tokens')}-{attempt}.offsets"))
                    part, out = k, files.open_output_stream(f"{root}/{named[-1][1]}")
                    stop = own.column(3)[0].as_py()
                out.write(own.column(2).to_numpy().astype("<u8").tobytes())
        if out is not None:
            out.write(np.array([stop], "<u8").tobytes())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*named, strict=True)], ["file", "offsets"])

    rows.mapInArrow(write, "file string, offsets string").repartition(1).write.parquet(f"{folder}/named")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every document, from the files:
    offsets from the offsets files, ids from the mapped token files. Each task maps one part."""
    index, parts = spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/manifest")
    rows = index.select("file", "position", "doc_id").join(parts.select("file", "offsets", "base", "width"), "file").select("file", "offsets", "base", "width", "position", "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, offs = None, None, None
        for b in bounded(batches, 1 << 20):
            cols = [b.column(k).to_pylist() for k in range(4)]
            at = b.column(4).to_numpy()
            starts, lengths, crcs = [], [], []
            for k, (file, offsets, base, width) in enumerate(zip(*cols, strict=True)):
                if file != name:
                    name, ids, offs = file, _mapped(folder, file, np.dtype(f"<u{width}")), _mapped(folder, offsets, np.dtype("<u8"))
                a, z = int(offs[at[k]]), int(offs[at[k] + 1])
                starts.append(a)
                lengths.append(z - a)
                crcs.append(zlib.crc32(ids[a - base : z - base].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(5), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, end: int = 0, folder: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes a store (in the shared folder unless one is named) and reads it back."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_store(docs, folder, tokenizer, end, special_as_text=special_as_text)
    return read_store(docs.sparkSession, folder)


def decode(folder: str, file: str, offsets: str, base: int, width: int) -> Iterator[np.ndarray]:
    """Each document's ids of one part, for readers outside Spark."""
    ids, offs = _mapped(folder, file, np.dtype(f"<u{width}")), _mapped(folder, offsets, np.dtype("<u8"))
    for a, z in zip(offs[:-1].astype(np.int64), offs[1:].astype(np.int64), strict=True):
        yield ids[a - base : z - base]
