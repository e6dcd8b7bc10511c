"""Chat formatting: schema fingerprints choose declarative mappings from many layouts to canonical turns.

A layout's nested field paths (``messages[].role``), restricted to the paths that any mapping knows, are sorted and
hashed; the fingerprint selects a mapping. A layout with unknown combinations falls back on the first mapping, in
the order of ``MAPPINGS``, whose required paths it has; one without any gives no turns and is counted as unmapped. Tables and struct
columns are fingerprinted once, by their schema, and mapped by DataFrame expressions; JSON strings row by row.

Formatting writes each turn between the template's marks. Inside texts, a backslash goes behind the first character of
anything that reads like a mark (more of them if some stand there already), so that marks stay unique and texts
come back exactly. The loss mask covers each assistant text and nothing else.

A conversation is formatted as a stream of segments, one a turn, in sorted order: a task holds one batch, not one conversation,
whatever its length. Its digest is a single hash over all of its turns, so its segments stay in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ._spark import bounded, shuffle_parts

#: Bytes of Catalyst's size estimate a part.
PART_BYTES = 16 << 20
#: Other names of the roles in nested layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """kind ``rows``: one turn a row, in the fields conversation, order, role and text. ``list``: an array of turns. ``fields``: one turn a
    named role, its text the non-blank fields joined by blank lines."""

    name: str
    kind: str
    list: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    conversation: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def required(self) -> frozenset[str]:
        if self.kind == "rows":
            return frozenset({self.conversation, self.order, self.role, self.text})
        if self.kind == "list":
            return frozenset({f"{self.list}[].{self.role}", f"{self.list}[].{self.text}"})
        return frozenset(paths[0] for _, paths in self.fields if paths[0] != "system")

    @property
    def known(self) -> frozenset[str]:
        return self.required | {p for _, paths in self.fields for p in paths}


MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn_rows", "rows", conversation="conv_id", order="turn", role="role", text="text"),
    Mapping("messages", "list", list="messages", role="role", text="content"),
    Mapping("messages_text", "list", list="messages", role="role", text="text"),
    Mapping("conversations_from", "list", list="conversations", role="from", text="value"),
    Mapping("conversation_role", "list", list="conversation", role="role", text="content"),
    Mapping("instruction_output", "fields", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_response", "fields", fields=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)))),
    Mapping("prompt_response", "fields", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", "fields", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", "fields", fields=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("data_nested", "list", list="data.messages", role="role", text="content"),
)
VOCABULARY = frozenset(p for m in MAPPINGS for p in m.known)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(VOCABULARY & set(paths))).encode()).hexdigest()[:16]


def _registry() -> dict[str, Mapping]:
    """Fingerprints of every mapping with and without its optional fields."""
    out: dict[str, Mapping] = {}
    for m in reversed(MAPPINGS):
        optional = sorted(m.known - m.required)
        for k in range(1 << len(optional)):
            out[fingerprint(m.required | {p for n, p in enumerate(optional) if k >> n & 1})] = m
    return out


REGISTRY = _registry()


def select(paths: Iterable[str]) -> Mapping | None:
    paths = set(paths)
    return REGISTRY.get(fingerprint(paths)) or next((m for m in MAPPINGS if m.required <= paths), None)


def schema_paths(kind: DataType, at: str = "") -> set[str]:
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return {at}


def value_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, at + "[]")}
    return {at}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _role(value: object) -> str:
    name = _text(value)
    return ROLES.get(name.lower(), name)


def value_turns(value: object) -> list[tuple[str, str]] | None:
    """Turns of one parsed JSON record; None if no mapping fits."""
    m = select(value_paths(value)) if isinstance(value, dict) else None
    if m is None or m.kind == "rows":
        return None
    if m.kind == "list":
        found: object = value
        for key in m.list.split("."):
            found = found.get(key) if isinstance(found, dict) else None
        return [(_role(x.get(m.role)), _text(x.get(m.text))) for x in found or [] if isinstance(x, dict)]
    out = []
    for role, paths in m.fields:
        parts = [_text(value.get(p)) for p in paths]
        parts = [x for k, x in enumerate(parts) if x.strip() or (k == 0 and paths[0] in value and role != "system")]
        if parts:
            out.append((role, "\n\n".join(parts)))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def json_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns of JSON strings; null and unmapped records give none, nor do broken ones: those that don't parse, are nested too deep to be
    walked, or hold half a surrogate pair, which no UTF-8 text can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            out: list[tuple] = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    turns = value_turns(json.loads(raw)) if raw else None
                    "".join(x for turn in turns or [] for x in turn).encode()
                except (ValueError, RecursionError):
                    turns = None
                out += [(key, k, role, text) for k, (role, text) in enumerate(turns or [])]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])

    return records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, TURNS)


def _role_column(c: Column) -> Column:
    name = F.coalesce(c.cast("string"), F.lit(""))
    aliases = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, F.lower(name)), name)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, one row a turn, from a table of any known layout.

    Layouts with one record a row take their conversation's id from ``id_col``. Null texts and roles are empty, null lists give no turns. Columns
    outside the mapping are ignored. A table without a fitting mapping raises ValueError.
    """
    m = select(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.kind == "rows":
        return df.select(F.col(m.conversation).cast("long").alias("conv_id"), F.col(m.order).cast("long").alias("turn"), empty(F.col(m.role)).alias("role"), empty(F.col(m.text)).alias("text"))
    if m.kind == "list":
        turns = F.transform(F.filter(F.col(m.list), lambda x: x.isNotNull()), lambda x: F.struct(_role_column(x[m.role]).alias("role"), empty(x[m.text]).alias("text")))
    else:
        have = schema_paths(df.schema)
        made = []
        for role, paths in m.fields:
            cols = [F.col(p).cast("string") for p in paths if p in have]
            if cols:
                first, rest = cols[0], [F.when(F.trim(c) != "", c) for c in cols[1:]]
                use = F.when(F.trim(first) != "", first) if role == "system" else F.coalesce(first, F.lit(""))
                made.append(F.when(use.isNotNull(), F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", use, *rest).alias("text"))))
        turns = F.filter(F.array(*made), lambda x: x.isNotNull())
    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


#: The template's marks by role; other roles carry their name.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_AFTER = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE |</ROLE>>"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_AFTER})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_AFTER})")
_READ = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|<<SYS>> (?P<system>.*?) <</SYS>>|<<ROLE (?P<name>[^>]*)>> (?P<other>.*?) <</ROLE>>", re.S)


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment and where its escaped text lies in it."""
    before, after = MARKS.get(role) or (f"<<ROLE {quote(role, safe='')}>> ", " <</ROLE>>")
    body = escaped(text)
    return before + body + after, len(before), len(before) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of formatted text."""
    at = 0
    for m in _READ.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        if m["name"] is not None:
            yield unquote(m["name"]), unescaped(m["other"])
        else:
            role = next(r for r in MARKS if m[r] is not None)
            yield role, unescaped(m[role])
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")


SEGMENTS = "conv_id long, position long, segment string, start long, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """The formatted conversations as segments: conv_id, position, segment, start; loss_start and loss_end (null if the mask
    leaves the turn out), all offsets in code points of the whole formatted conversation.

    Turns stand in the order of turn, then role, then text. Rows of one conversation follow each other within a partition. Null ids
    form one conversation. No turns, no segments.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition(shuffle_parts(turns, PART_BYTES), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at = object(), 0, 0
        for b in bounded(batches):
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, position, at = conv, 0, 0
                segment, lo, hi = marked(role or "", text or "")
                loss = (at + lo, at + hi) if role == "assistant" else (None, None)
                out.append((conv, position, segment, at, *loss))
                position, at = position + 1, at + len(segment)
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "position", "segment", "start", "loss_start", "loss_end"])

    return rows.mapInArrow(run, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments (in the order ``format_turns`` gives): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> tuple:
            return (now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        now, begun, n, chars, loss_chars = None, False, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for b in bounded(batches):
            out = []
            for conv, position, segment, start, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or position == 0:
                    if begun:
                        out.append(row())
                    now, begun, n, chars, loss_chars = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read_turns(segment):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if lo is not None:
                    text = unescaped(segment[lo - start : hi - start])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(segment)
            if out:
                yield batch(out)
        if begun:
            yield batch([row()])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(segments: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (array of start, end) as one row a conversation, for conversations that fit into a row."""
    parts = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "segment", "loss_start", "loss_end"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("formatted"), spans.alias("loss"))
