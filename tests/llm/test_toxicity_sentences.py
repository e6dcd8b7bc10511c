"""A text's sentences and score depend on the text alone."""

import numpy as np
import pyarrow as pa
from cadenza.llm import _text as T
from cadenza.llm import toxicity


def sentences(texts):
    """The texts' sentences, cut together in one chunk."""
    for _, _, buf, offs in T.chunks(pa.array(texts, pa.string())):
        _, _, doc, begins = toxicity.instances(buf, offs, 18)
        ends = np.append(begins[1:], len(buf))
        return [[buf[a:z].tobytes().decode() for a, z, d in zip(begins, ends, doc, strict=True) if d == k] for k in range(len(texts))]


def test_sentences_do_not_depend_on_neighbours():
    r = np.random.default_rng(4)
    some = lambda n: " ".join(f"w{x}" for x in r.integers(0, 99, n))
    texts = ["", " ", *[". ".join(some(int(m)) for m in r.integers(1, 90, 5)) for _ in range(40)], "?!", some(200)]
    assert sentences(texts) == [sentences([t])[0] if t else [] for t in texts]


def test_only_long_sentences_are_cut():
    short = " ".join(f"a{k}" for k in range(31)) + "."
    assert sentences([short, short + " " + short]) == [[short], [short, " " + short]]
    words = [f"b{k}" for k in range(70)]
    cut = sentences(["one two. " + " ".join(words)])[0]
    assert [x.split() for x in cut] == [["one", "two."], words[:32], words[32:64], words[64:]]
