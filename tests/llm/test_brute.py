"""Operators that SQL can't express, against plain loops: the ring walked row by row, raking, the noisy-or, planted random strings."""

import hashlib
import math
import random
import string

import numpy as np
import pytest
from cadenza.llm import mixing, queries, ring, secrets, toxicity
from cadenza.llm.registry import QUERIES
from odd_rows import TINY
from pyspark.sql import functions as F


@pytest.mark.parametrize("spec", [ring.Ring(), ring.Ring(shards=3, virtual=5, cell_rows=7), ring.Ring(shards=4, virtual=3, slack=0.3, seed=9)])
def test_ring_is_walked_row_by_row(spark, spec):
    """Keys on the ring, each shard's free places, turn after turn: in turn k every key without a place asks the k-th shard clockwise."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("p", ring.position(F.col("doc_id"), spec)).withColumn("cut", F.pmod(F.xxhash64(F.crc32(F.encode("text", "UTF-8")), (F.octet_length("text") + 1).cast("long"), "doc_id"), F.lit(ring.SALTS))).select("doc_id", "p", "cut").collect()
    nodes = sorted((int.from_bytes(hashlib.md5(f"{spec.seed}|{s}|{v}".encode()).digest()[:4], "big"), s) for s in range(spec.shards) for v in range(spec.virtual))
    marks = len(nodes)
    width = max(1, ring.RING // (marks * min(ring.MOST_CUTS, max(1, -(-len(rows) // (spec.cell_rows * marks))))))

    def clockwise(p):
        order = [s for q, s in nodes if q >= p] + [s for q, s in nodes if q < p]
        return list(dict.fromkeys(order))

    room = [math.ceil(len(rows) * (1 + spec.slack) / spec.shards)] * spec.shards if spec.slack else [len(rows) // spec.shards + (s < len(rows) % spec.shards) for s in range(spec.shards)]
    pending = sorted(rows, key=lambda r: (sum(q < r.p for q, _ in nodes), r.p // width, r.cut, r.p, r.doc_id))
    want, slots = {}, [0] * spec.shards
    for turn in range(spec.shards):
        left = []
        for r in pending:
            s = clockwise(r.p)[turn]
            if slots[s] < room[s]:
                want[r.doc_id] = (s, slots[s])
                slots[s] += 1
            else:
                left.append(r)
        pending = left
    assert {r.doc_id: (r.shard, r.slot) for r in ring.shard(docs, spec).collect()} == want


def test_raking_against_a_plain_loop(spark):
    """Proportional fitting over dictionaries, one category after another, by the definition."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    mix = mixing.Mix(budget=0.6, shares={"lang": {"en": 0.5, "nowhere": 0.2}}, temperature={"source": 0.5, "topic": 1.0}, rounds=400, tolerance=1e-12)
    rows = mixing.mixed(docs, mix).collect()
    cells = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    p = {c: min(1.0, mix.budget) for c in cells}
    total = sum(cells.values())
    wanted = []
    for axis in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[axis]] = sums.get(c[axis], 0) + n
        if axis == 1:
            rest = total - sums["en"]
            share = {k: 0.5 if k == "en" else 0.5 * n / rest for k, n in sums.items()}
        else:
            power = (0.5, None, 1.0)[axis]
            share = {k: n**power if n else 0.0 for k, n in sums.items()}
        whole = sum(share.values())
        wanted.append({k: v / whole * mix.budget * total for k, v in share.items()})
    for _ in range(mix.rounds):
        for axis in range(3):
            factor = {}
            for k, want in wanted[axis].items():
                have = sum(p[c] * n for c, n in cells.items() if c[axis] == k)
                factor[k] = want / have if have > 0 else 1.0
            p = {c: min(1.0, x * factor[c[axis]]) for c, x in p.items()}
    assert max(abs(r.probability - p[r.source, r.lang, r.topic]) for r in rows) < 1e-6
    told = {(r.axis, r.category): r for r in mixing.marginals(mixing.mixed(docs, mix), mix).collect()}
    for axis, name in enumerate(mixing.AXES):
        for k, want in wanted[axis].items():
            own = told[name, k]
            assert math.isclose(own.wanted, want, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(own.expected, sum(p[c] * n for c, n in cells.items() if c[axis] == k), rel_tol=1e-5, abs_tol=1e-3)
            assert own.gap is None or math.isclose(own.gap, own.expected / own.wanted - 1, abs_tol=1e-9)


def test_gaps_show_where_probabilities_end(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h", "x" if k < 10 else "y", "en") for k in range(100)], "doc_id long, text string, source string, lang string")
    mix = mixing.Mix(budget=0.9, shares={"source": {"x": 0.9}})
    told = {(r.axis, r.category): r.gap for r in mixing.marginals(mixing.mixed(docs, mix), mix).collect()}
    assert told["source", "x"] < -0.8


def brute_score(text, model):
    """The score by loops over sentences and words; hashes are the operator's."""
    low = text.encode().lower() if text.isascii() else None
    sentences, now = [], bytearray()
    for b in low:
        now.append(b)
        if b in b"\n!.?":
            sentences.append(bytes(now))
            now = bytearray()
    sentences.append(bytes(now))
    weights, size = model.weights, len(model.weights) - 2
    clean = 1.0
    for s in sentences:
        words = "".join(chr(c) if chr(c).isalnum() else " " for c in s).split()
        for at in range(0, len(words), 32):
            found = set()
            for w in words[at : at + 32]:
                raw = np.frombuffer(w.encode(), np.uint8)
                h = toxicity.T.span_hash(toxicity.T.prefix(raw), np.array([0]), np.array([len(raw)]))[0]
                found.add(int(h % np.uint64(size)) + 1)
                for n in (3, 4, 5, 6, 7):
                    if len(raw) > n:
                        with np.errstate(over="ignore"):
                            g = toxicity.T.span_hash(toxicity.T.prefix(raw), np.array([0]), np.array([n]))[0] * np.uint64(2 * n + 1)
                        found.add(int(g % np.uint64(size)) + 1)
            z = model.bias + sum(float(weights[k]) for k in found)
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_noisy_or_against_loops(spark):
    r = random.Random(4)
    words = ["fine", "walk", "idiot", "scum", "river", "moronic", "weather", "trains", "it", "a"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ".", "!", ",", "\n", "?"]) for _ in range(r.randrange(1, 120))) for _ in range(200)]
    draw = np.random.default_rng(2)
    weights = np.where(draw.random(1 << 10) < 0.2, draw.random(1 << 10) * 3, 0.0).astype(np.float32)
    weights[0] = 0.0
    model = toxicity.ToxicityModel(weights, -4.0)
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, with_sentences=False).collect()
    for row in rows:
        assert math.isclose(row.score, brute_score(row.text, model), rel_tol=1e-5, abs_tol=1e-9), row.text


def test_training_sample_is_bounded_in_bytes(spark):
    rows = [(k, f"bad{k % 7} scum word{k} " * (5 + k % 9) if k % 2 else f"good river word{k} " * (5 + k % 9)) for k in range(400)]
    docs = spark.createDataFrame(rows + rows[:50] + [(401, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(402)], "doc_id long, toxic int")
    held = []

    def keep(texts, y, op):
        held.append((texts, y))
        return toxicity.ToxicityModel(np.zeros(4, np.float32), -30.0)

    real, toxicity.fit = toxicity.fit, keep
    try:
        toxicity.train(docs, labels, toxicity.ToxicityFit(sample_bytes=10_000))
        toxicity.train(docs, labels)
    finally:
        toxicity.fit = real
    for (texts, y), most in zip(held, (5000, 1 << 30), strict=True):
        for label in (0, 1):
            assert 0 < sum(len(t) for t, own in zip(texts.to_pylist(), y, strict=True) if own == label) <= most
    assert len(held[1][1]) == len(set(held[1][0].to_pylist())) > 200


IDENTIFIERS = "connection timeout user account get set max retry count default value index parse string builder handler service request response config file path name list map key cache buffer stream reader writer thread pool manager controller factory".split()


def planted(r, k):
    """A text with one secret or one ordinary long identifier, and which."""
    if k % 2:
        alphabet = r.choice([string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits])
        token = "".join(r.choice(alphabet) for _ in range(r.randrange(20, 45)))
    else:
        words = [r.choice(IDENTIFIERS) for _ in range(r.randrange(3, 6))]
        token = r.choice([lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w)])(words)
    return f"we use {token} here and there", token, k % 2


def test_precision_and_recall_of_random_strings(spark):
    r = random.Random(17)
    cases = [planted(r, k) for k in range(1200)]
    cases = [c for c in cases if len(c[1]) >= secrets.Scan().least]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    rows = docs.unionByName(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string"))
    got = {x.doc_id: x.spans for x in secrets.secrets(rows).where("doc_id < 1000000").collect()}
    hit = {k: any(s.startswith("random:") and int(s.split(":")[1]) == 7 for s in got[k].split(",") if s) for k in got}
    true = sum(hit[k] for k, c in enumerate(cases) if c[2])
    recall, precision = true / sum(c[2] for c in cases), true / max(1, sum(hit.values()))
    print(f"random strings: precision {precision:.3f}, recall {recall:.3f}, {len(cases)} cases")
    assert recall >= 0.9 and precision >= 0.9


def test_every_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(QUERIES) <= set(dir(queries))
