"""The token encoder's known pieces: learnt once, bounded, and of no effect on the ids."""

import numpy as np
import pyarrow as pa
from cadenza.llm import queries, tokenstore


def column(lo, hi, each=50):
    words = [f"w{k:x}q" for k in range(lo, hi)]
    return pa.array([" ".join(words[k : k + each]) for k in range(0, len(words), each)])


def test_pieces_are_learnt_once(monkeypatch):
    learnt, learn = [], tokenstore.Encoder._learn
    monkeypatch.setattr(tokenstore.Encoder, "_learn", lambda self, words: (learnt.append(len(words)), learn(self, words))[1])
    enc = tokenstore.Encoder(queries.tokenizer_path())
    one, two = column(0, 60_000), column(60_000, 120_000)
    first = enc.encode(one)
    enc.encode(two)
    assert learnt[:2] == [58_800, 58_800]  # all but each text's first word
    again = enc.encode(one)
    assert sum(learnt[2:]) == 0
    assert all((x == y).all() for x, y in zip(first, again, strict=True))


def test_few_pieces_kept(monkeypatch):
    monkeypatch.setattr(tokenstore, "_CACHE", 40)
    enc = tokenstore.Encoder(queries.tokenizer_path(), 7)
    long = "y" * 500
    texts = [f"one {long} two, three;four {k}. and{long} w{k} a{k} b{k}!" for k in range(60)] + ["", None, "x", " lead", "two  blanks", "line.\nnext, x\n\ny"]
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        ids, lengths = enc.encode(pa.array(some))
        want = [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in some]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
        assert ids.dtype == np.dtype("<u2")
        assert 0 < len(enc.pieces) == len(enc.ids) == len(enc.uses) <= 40
        assert long not in enc.pieces.to_pylist()
    assert "two" in enc.pieces.to_pylist()  # of every batch


def test_the_index_is_in_few_files(spark):
    folder = tokenstore.scratch(spark, "tokens")
    docs = spark.range(3000).selectExpr("id doc_id", "concat('text of ', id) text")
    tokenstore.write_store(docs, folder, queries.tokenizer_path(), part_bytes=1_000)
    parts = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    assert len(parts) > 20
    index = spark.read.parquet(f"{folder}/docs")
    assert len(index.inputFiles()) <= max(4, len(parts) // tokenstore.INDEX_PARTS)
    assert len(spark.read.parquet(f"{folder}/named").inputFiles()) == 1
    assert [r.doc_id for r in index.orderBy("part", "position").collect()] == list(range(3000))
    assert [r.n_docs for r in parts] == [r["count"] for r in index.groupBy("part").count().orderBy("part").collect()]
