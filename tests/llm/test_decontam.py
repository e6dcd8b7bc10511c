"""Copies within the edits allowed are found whatever the item's length, the place of the edits and the place in the text."""

import numpy as np
import pytest
from cadenza.llm import decontam

LENGTHS = (8, 9, 10, 11, 13, 14, 16, 17, 18, 19, 20, 23, 27, 40)


def hits(items, texts):
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    found = decontam._hits(decontam.Index(items, decontam.Decontam()), *decontam._words(buf, offs), offs)
    return [{x["item_id"]: x["distance"] for x in own} for own in found]


def edited(words, places, r):
    words = list(words)
    for at in places:
        words[at] = r.choice(["", "changed", words[at] + " added"])
    return [w for w in " ".join(words).split() if w]


def filler(n, r):
    return [f"f{x}" for x in r.integers(0, 500, n)]


@pytest.mark.parametrize("n", LENGTHS)
def test_leaks_edited_at_any_place(n):
    r = np.random.default_rng(n)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k in range(n)]
    most = decontam.Decontam().most(n)
    texts = []
    for k, t in items:
        others = r.permutation([j for j in range(n) if j != k])[: most - 1]
        texts.append(" ".join(filler(20, r) + edited(t.split(), [k, *others], r) + filler(20, r)))
    found = hits(items, texts)
    assert [k for k in range(n) if found[k].get(k, 99) > most] == []


@pytest.mark.parametrize("n", LENGTHS)
def test_leaks_at_the_ends_of_texts(n):
    """Whole texts, and passages at a text's end, that lost as many words as may be lost, at any place."""
    r = np.random.default_rng(n)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k in range(2 * n)]
    most = decontam.Decontam().most(n)
    texts = []
    for k, t in items:
        lost = {k % n, *[j for j in r.permutation(n).tolist() if j != k % n][: most - 1]}
        texts.append(" ".join(filler(20 * (k < n), r) + [w for j, w in enumerate(t.split()) if j not in lost]))
    found = hits(items, texts)
    assert [k for k in range(2 * n) if found[k].get(k, 99) > most] == []


def test_leaks_beside_short_texts():
    """A text's candidate stays beside that of an earlier text with the same start, an empty text between them."""
    words = [f"w{k}" for k in range(107)]
    texts = [" ".join(["some", "other", "words", *words[:16]]), "", " ".join(words[16:])]
    assert hits([(1, " ".join(words))], texts) == [{}, {}, {1: 16}]
    buf, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    h, first, _, _ = decontam._words(buf, offs)
    found, at = decontam.Index([(1, " ".join(words))], decontam.Decontam()).candidates(h, first)
    assert {(start, text) for start, text in zip(found[:, 1].tolist(), (at >= 19).tolist(), strict=True)} >= {(3, False), (3, True)}


def test_leaks_beside_a_false_start():
    assert hits([(1, "a b a b a b c d")], ["a b a b a b a x b c d"]) == [{1: 1}]


@pytest.mark.parametrize("item", ["今日は天気がとても良いので公園まで歩いて行きました", "我们昨天在图书馆里看了很多有意思的书", "วันนี้อากาศดีมากเราจึงเดินไปที่สวนสาธารณะ", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉"])
def test_leaks_in_scripts_without_blanks(item):
    middle = len(item) // 2
    texts = ["前文" + item + "後文abc", "abc " + item, item[:middle] + "x" + item[middle:], item[::-1], "kein Wort davon"]
    assert hits([(1, item)], texts) == [{1: 0}, {1: 0}, {1: 1}, {}, {}]


def test_words_of_mixed_scripts():
    texts = ["ab今日 naïve후보 x日", "本", "", "y ไทยz"]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    _, first, starts, ends = decontam._words(buf, offs)
    words = [buf[a:z].tobytes().decode() for a, z in zip(starts, ends, strict=True)]
    assert words == ["ab", "今", "日", "naïve후보", "x", "日", "本", "y", "ไ", "ท", "ย", "z"]
    assert first.tolist() == [0, 6, 7, 7, 12]
