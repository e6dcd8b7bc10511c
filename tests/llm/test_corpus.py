"""Operators across texts against brute force and SQL: near-duplicates, substrings, components, chat, the pipeline."""

import hashlib
import json
import random
import re

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm import _text as T
from cadenza.llm import chat, neardup, registry, subdedup
from cadenza.llm.components import components
from odd_rows import ODD, TINY
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    df = registry.queries()[name](spark, TINY)
    want = c.sql(registry.oracle_sql()[name])
    plain = lambda rows, names: sorted(tuple(str(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in rows)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


class Union:
    def __init__(self):
        self.root = {}

    def find(self, x):
        self.root.setdefault(x, x)
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 180)] + [(5, 5)] + [(7, r.randrange(300, 400)) for _ in range(80)] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(200)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {x.id: x.component for x in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in list(u.root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = WORD.findall((text or "").encode().translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, num, den):
    sets = {k: shingles(t, n) for k, t in rows}
    u = Union()
    by = {}
    for k, s in sets.items():
        u.find(k)
        for g in s:
            by.setdefault(g, []).append(k)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            u.join(a, b)
    return {k: u.find(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def near_texts(seed, groups, size, edits, length=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(r.randrange(1, size)):
            copy = base[:]
            for _ in range(r.randrange(0, edits)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(0, 2)] = [word()]
            rows.append(" ".join(copy) if r.random() < 0.7 else "\t".join(copy).upper())
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("op", "block"), [(neardup.NearDup(words=3, threshold=(85, 100)), 256), (neardup.NearDup(), 256), (neardup.NearDup(), 3)])
def test_near_duplicates(spark, monkeypatch, op, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_texts(8, 40, 25, 6) + [(10_000 + k, " ".join(["a b c d e", "f"][: k % 3])) for k in range(6)]
    want, sizes = brute_components([r for r in rows if r[1]], op.words, *op.threshold)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), op).collect()}
    assert len(got) == len(rows)
    for k, c in want.items():
        assert (got[k].component_id, got[k].n_shingles, got[k].kept) == (c, sizes[k], c == k)


def test_near_duplicates_odd(spark, odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[7].component_id == by[6].component_id == 6 and not by[7].kept and by[6].kept
    assert by[None].kept and by[1].kept and by[2].n_shingles == 0
    assert neardup.near_duplicates(empty).count() == 0


def test_signature_misses_are_rare():
    op = neardup.NearDup(words=3, threshold=(85, 100))
    assert (1 - 0.85**op.rows) ** op.bands <= op.miss
    rng, miss = np.random.default_rng(2), 0
    for _ in range(150):
        n = 200
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = int(n * 0.15 / 0.85)
        a = neardup.min_hashes(np.concatenate([both, rng.integers(0, 1 << 63, extra // 2, dtype=np.uint64)]), op.size)
        b = neardup.min_hashes(np.concatenate([both, rng.integers(0, 1 << 63, extra - extra // 2, dtype=np.uint64)]), op.size)
        bands = (a.reshape(op.bands, -1) == b.reshape(op.bands, -1)).all(axis=1).any()
        x, y = ((v ^ (v >> np.uint32(8))).astype(np.uint8)[None] for v in (a, b))
        miss += not (bands and len(neardup.survivors(x, y, op)))
        assert abs((a == b).mean() - 0.85) < 0.15
    assert miss == 0


def brute_kept(rows, n):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        w, gone = WORD.findall((text or "").encode()), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone |= set(range(k, k + n))
            seen.add(key)
        out[doc] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("heavy", [4000, 2])
def test_substrings(spark, heavy):
    r = random.Random(11)
    passages = [" ".join(f"p{r.randrange(300)}" for _ in range(r.randrange(12, 50))) for _ in range(6)]
    rows = []
    for d in range(150):
        parts = []
        for _ in range(r.randrange(1, 6)):
            x = r.random()
            parts.append(r.choice(passages) if x < 0.4 else " ".join(r.choice("ab") for _ in range(r.randrange(0, 60))) if x < 0.6 else "\n".join(f"q{r.randrange(5000)}" for _ in range(r.randrange(1, 40))))
        rows.append((d * 3 % 151, " \t".join(parts)))
    rows += [(1000 + k, passages[0] + " " + passages[1]) for k in range(30)]
    want = brute_kept(rows, 20)
    got = subdedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), subdedup.SubDedup(heavy=heavy)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in got} == want


def test_substrings_over_many_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, t) for k, t in near_texts(3, 10, 12, 4, 80)]
        got = subdedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in got} == brute_kept(rows, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_hashes_of_unlike_windows(monkeypatch):
    monkeypatch.setattr(subdedup.T, "gram_hash", lambda h, n: np.full(max(0, len(h) - n + 1), 5, np.uint64))
    d, s = subdedup.repeated_windows(np.array([1, 2, 3]), np.array([0, 4, 0]), np.array([1, 2, 1]), pa.array([b"a b c", b"x y z w", b"a b c"]), 3)
    assert list(zip(d.tolist(), s.tolist(), strict=True)) == [(3, 0)]


def test_substrings_odd(spark, odd, empty):
    rows = subdedup.dedup_substrings(odd).collect()
    assert len(rows) == len(ODD)
    x = {r.doc_id: r for r in rows}
    assert x[8].n_words == 60_000 and x[8].n_removed == 59_999 and x[None].n_removed == 0 and x[7].n_removed == 0
    assert subdedup.dedup_substrings(empty).count() == 0


text = st.lists(st.sampled_from(list("<>/[]s\\ INSTYROLE a\n") + ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>", "é", "🙂"]), max_size=40).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a>> b", "é"]), text), max_size=6))
@settings(max_examples=400, deadline=None)
def test_turns_come_back(turns):
    formatted = "".join(chat.marked(r, t)[0] for r, t in turns)
    assert list(chat.read_turns(formatted)) == turns
    for r, t in turns:
        segment, lo, hi = chat.marked(r, t)
        assert chat.unescaped(segment[lo:hi]) == t


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}], "id": 3}, [("user", "hi"), ("assistant", "ho")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]}, [("user", "hi"), ("assistant", "")]),
    ({"instruction": "do", "input": "it", "output": "done"}, [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "input": " ", "output": "done", "system": "be"}, [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r", "score": 1}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"data": {"messages": [{"role": "user", "content": "deep"}]}}, [("user", "deep")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"messages": [], "other": 1}, []),
    ({"unknown": 1}, []),
]


def test_json_layouts(spark):
    rows = [(k, json.dumps(x)) for k, (x, _) in enumerate(LAYOUTS)] + [(90, "{broken"), (91, None), (92, "[1]")]
    got = {}
    for r in chat.json_turns(spark.createDataFrame(rows, "id long, record string"), "id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: turns for k, (_, turns) in enumerate(LAYOUTS) if turns}


def test_struct_layouts(spark):
    for (record, turns), ddl in zip(LAYOUTS[:3], ("messages array<struct<role:string,content:string>>", "conversations array<struct<`from`:string,value:string>>", "instruction string, input string, output string"), strict=True):
        values = [tuple(x.values()) for x in next(iter(record.values()))] if isinstance(next(iter(record.values())), list) else None
        row = (7, values) if values is not None else (7, *record.values())
        df = spark.createDataFrame([row], f"conv_id long, {ddl}")
        assert [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()] == turns
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1,)], "x int"))
    assert chat.fingerprint(["messages[].role", "messages[].content"]) == chat.fingerprint(["extra", "messages[].content", "messages[].role"])


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "b<s>"), (1, 0, "user", None), (2, 0, "tool", "x"), (None, 0, "user", "n"), (1, 2, "assistant", ""), (1, 2, "assistant", "z"), (3, 0, None, "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit("clash"))
    segments = chat.format_turns(chat.canonical_turns(df))
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb<s>\nassistant\n\nassistant\nz\n") and got[1].n_turns == 4
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, sha("b<s>z"))
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == sha("") and got[3].n_turns == 1 and None in got
    whole = {r.conv_id: r for r in chat.conversations(segments).collect()}
    assert got[1].formatted_chars == len(whole[1].formatted)
    assert "".join(chat.unescaped(whole[1].formatted[x.start : x.end]) for x in whole[1].loss) == "b<s>z"
    assert chat.digests(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


def test_long_conversations_stream(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
        row = chat.digests(chat.format_turns(chat.canonical_turns(df))).collect()
        assert len(row) == 1 and row[0].n_turns == 1000 and row[0].loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(1, 1000, 2)).encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sliding_min_and_runs():
    r = np.random.default_rng(1)
    for w in (1, 2, 3, 7, 15, 16):
        x = r.integers(0, 99, 40).astype(np.uint64)
        assert T.sliding_min(x, w).tolist() == [x[k : k + w].min() for k in range(40 - w + 1)]
    assert T.ranges(np.array([5, 1, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    before, kept = docs, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(before)
        if k < len(names) - 1:
            assert before.columns == docs.columns and before.exceptAll(kept[k]).isEmpty()
    clean, single = (dict(x.select("doc_id", "text").collect()) for x in kept[1:3])
    comp, _ = brute_components(list(clean.items()), 5, 80, 100)
    assert set(single) == {k for k, c in comp.items() if c == k}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {' '.join(i)} " in f" {' '.join(re.findall(chr(92) + 'w+', t.lower()))} " for i in items)
    left = {r.doc_id for r in kept[3].collect()}
    assert not any(holds(single[k]) for k in left) and len(left) > 0.9 * len(single)
    assert kept[5].count() == kept[4].count() > 0.6 * len(left)
    assert corpus_pipeline.run(spark, sf).count() == kept[5].count()


def test_pipeline_of_odd_tables(spark, odd, empty, tmp_path):
    for start in (odd.select("doc_id", "text", "lang", "source", F.lit(1).alias("extra"), "score", "hits"), empty):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, TINY)
            assert name == "token_ids" or out.columns == start.columns
            path = f"{tmp_path}/{len(start.columns)}-{k}"
            out.withColumns({c: out[c].cast("string") for c, t in out.dtypes if t == "void"}).write.parquet(path)
            docs = spark.read.parquet(path)
