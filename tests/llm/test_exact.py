"""What is equal is decided by bytes, names of the caller's columns stay, and broken records are survived."""

import random

import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm import _spark, chat, decontam, mixing, neardup, quality, queries, secrets, subdedup, tokenstore
from cadenza.llm import _text as T
from pyspark.sql import functions as F


def alike():
    """Two words of 1024 letters over two letters that polynomial hashes modulo a power of two can't tell apart."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_word_hashes_tell_words_apart():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 40))) for _ in range(4000)} | {"a" * n for n in range(1, 600)} | set(alike()))
    raw = " ".join(words).encode()
    buf = np.frombuffer(raw, np.uint8)
    s, e, _ = T.spans(~T.SPACE[buf], np.array([0, len(buf)]))
    assert len(set(T.word_hash(buf, s, e).tolist())) == len(set(T.exact_codes(buf, s, e).tolist())) == len(words)
    again = T.word_hash(buf[s[7] :], np.array([0]), np.array([e[7] - s[7]]))
    assert again[0] == T.word_hash(buf, s, e)[7]


def test_exact_grams_look_behind_equal_hashes(monkeypatch):
    codes = np.random.default_rng(0).integers(0, 3, 200)
    real, calls = T.gram_hash, []

    def weak(h, n):
        calls.append(1)
        return real(h, n) % T.U64(2) if len(calls) < 3 else real(h, n)

    monkeypatch.setattr(T, "gram_hash", weak)
    got = T.exact_grams(codes, 4)
    tuples = [tuple(codes[k : k + 4]) for k in range(197)]
    assert len(calls) == 3 and all((got[a] == got[b]) == (tuples[a] == tuples[b]) for a in range(197) for b in range(a))


def test_windows_of_words_with_one_polynomial_hash():
    a, b = (" ".join([w, *map(str, range(19))]).encode() for w in alike())
    d, s = subdedup.repeated_windows(np.array([1, 2]), np.array([0, 0]), np.array([1, 1]), pa.array([a, b]), 20)
    assert not len(d)
    assert subdedup.repeated_windows(np.array([1, 2]), np.array([0, 0]), np.array([1, 1]), pa.array([a, a]), 20)[0].tolist() == [2]


def test_texts_of_words_with_one_polynomial_hash(spark, monkeypatch):
    a, b = alike()
    rows = [(1, " ".join([a, "x", a])), (2, " ".join([b, "x", b])), (3, " ".join([a, "x", a, "x", a])), (4, a), (5, b)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(words=3, threshold=(85, 100))).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    kept = subdedup.dedup_substrings(spark.createDataFrame([(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, " ".join([a] * 20))], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in kept.collect()} == {1: 0, 2: 0, 3: 20}


def test_sets_are_exact():
    column = pa.array(["a b c d", "A b  c\td", "a b", "A\nB", "b a", "", None, "c d a b c"])
    sets = [set(x.tolist()) for x in neardup.exact_sets(column, 3)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] == sets[3] and len(sets[2]) == 1 and sets[4] != sets[2] and sets[5] == sets[6] == set()
    assert len(sets[7] & sets[0]) == 1 and len(sets[7]) == 3 and not sets[2] & sets[0]


def test_hits_are_confirmed_by_bytes(monkeypatch):
    """With hashes that see a word's first letter only, what differs in bytes isn't reported."""
    monkeypatch.setattr(T, "word_hash", lambda buf, s, e: T.mix(buf[s].astype(np.uint64) + T.U64(1)))
    item = "alpha bravo charlie delta echo foxtrot golf hotel"
    texts = ["alfa bravo charly delta echo fox golf hotel", "x alpha bravo charlie delta echo foxtrot golf hotel y", "alpha bravo charlie zulu echo foxtrot golf hotel", "axx bxx cxx dxx exx fxx gxx hxx " + item]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    found = decontam._hits(decontam.Index([(1, item)], decontam.Decontam()), *decontam._words(buf, offs), offs, buf)
    assert [[(x["distance"], raw[k][x["start"] : x["end"]].decode()) for x in own] for k, own in enumerate(found)] == [[], [(0, item)], [(1, texts[2])], [(0, item)]]


def test_common_windows_are_sent_once_a_task(spark, monkeypatch):
    """Passages in every text, in many batches, with few windows held at a time."""
    monkeypatch.setattr(subdedup, "COMMON", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        r = random.Random(6)
        passage = " ".join(f"p{k}" for k in range(30))
        rows = [(k * 7 % 101, " ".join([*(f"u{r.randrange(9)}" for _ in range(r.randrange(25))), passage, f"t{k}"])) for k in range(101)]
        got = subdedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), subdedup.SubDedup(heavy=2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, want = set(), {}
    for doc, text in sorted(rows):
        w, gone = text.split(), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        want[doc] = len(gone)
    assert {x.doc_id: x.n_removed for x in got} == want


@pytest.mark.parametrize("special_as_text", [False, True])
def test_special_tokens_as_the_library_has_them(spark, special_as_text):
    import zlib

    from tokenizers import Tokenizer

    path, mark = queries.tokenizer_path(), "<|endoftext|>"
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = special_as_text
    texts = [mark, f"{mark} start", f"a {mark} b", f"end {mark}", f"no{mark}blanks", "<|endof text|>", f"{mark}{mark}", f"two  blanks {mark}\n", "nothing special"]
    assert plain.encode(texts[2], add_special_tokens=False).ids == ([64, 1279, 91, 437, 1659, 5239, 91, 29, 275] if special_as_text else [64, 220, 50256, 275])
    rows = tokenstore.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, special_as_text=special_as_text)
    for r in rows.collect():
        ids = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]


def test_rows_of_one_id_fill_several_parts(spark):
    folder = tokenstore.scratch(spark, "tokens")
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" and more")).alias("text"))
    tokenstore.write_store(rows, folder, queries.tokenizer_path(), part_bytes=4_000)
    parts = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    assert len(parts) > 3 and max(p.n_docs for p in parts) < 2000
    back = [x.tobytes() for p in parts for x in tokenstore.decode(folder, p.file, p.offsets, p.base, p.width)]
    assert len(back) == 4000
    assert all(p.offsets.removesuffix(".offsets").startswith(p.file.removesuffix(".tokens")) and p.offsets.removesuffix(".offsets") != p.file.removesuffix(".tokens") for p in parts)


CLASH = ("_words", "_lines", "_found", "_assign", "_base", "_cell", "_probability", "__x", "_texts", "_width")


def test_callers_underscored_columns_stay(spark):
    rows = [(k, f"password: abcdefghijklmnop{k} a b c d e a b c d e\nx\nx", "s", "en") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in CLASH})
    for out in (quality.ledger(docs), secrets.scan_secrets(docs, [0.0] * secrets.CLASSES**2), mixing.sampled(docs, mixing.Mix(budget=0.9))):
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASH)
        assert set(out.columns) >= set(docs.columns) and not set(c for c in out.columns if c.startswith("_")) - set(CLASH)


def test_broken_records_give_no_turns(spark):
    deep = '{"prompt": ' + "[" * 60_000 + "]" * 60_000 + ', "response": "x"}'
    rows = [(1, '{"prompt": "\\ud800", "response": "x"}'), (2, deep), (3, '{"prompt": "p", "response": "r"}'), (4, '{"prompt": "\\ud83d\\ude42", "response": "r"}'), (5, "{")]
    got = [(r.conv_id, r.role, r.text) for r in chat.json_turns(spark.createDataFrame(rows, "id long, record string"), "id", "record").orderBy("conv_id", "turn").collect()]
    assert got == [(3, "user", "p"), (3, "assistant", "r"), (4, "user", "\U0001f642"), (4, "assistant", "r")]


def test_every_layout():
    turn = {"role": "human", "content": "c", "text": "t", "from": "gpt", "value": "v"}
    pick = lambda *k: {x: turn[x] for x in k}
    assert chat.value_turns({"messages": [pick("role", "text")]}) == [("user", "t")]
    assert chat.value_turns({"conversation": [pick("role", "content"), pick("role", "content")]}) == [("user", "c")] * 2
    assert chat.value_turns({"instruction": "i", "context": "c", "response": "r"}) == [("user", "i\n\nc"), ("assistant", "r")]
    assert chat.value_turns({"instruction": "i", "response": "r", "system": "s"}) == [("system", "s"), ("user", "i"), ("assistant", "r")]
    for m in chat.MAPPINGS:
        assert chat.select(m.required) is m or chat.fingerprint(chat.select(m.required).required) == chat.fingerprint(m.required), m.name


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, other=None: other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _spark.shared_root(Session())
