"""op2, pipeline: pairs whose words can't agree are left before they carry texts, and no link with them."""

import random

import numpy as np

from strandflow.llm import near
from tests.llm.helpers import prose
from tests.llm.test_near_links import linked
from tests.llm.test_near_whole import classes


def crowd(seed, members, words=100, least=10, most=15):
    """Copies of one text with so many hundredths of their words changed: most pairs just aren't similar."""
    r = random.Random(seed)
    base, out = prose(60_000 + seed, words).split(), []
    for m in range(members):
        mine = list(base)
        for at in r.sample(range(words), r.randint(least, most)):
            mine[at] = f"mine{m}x{at}"
        out.append(" ".join(mine))
    return out


def test_pairs_of_a_crowd_below_the_threshold_carry_no_texts(spark, monkeypatch):
    """Before, each pair of texts in different components was joined with the words of both."""
    texts = crowd(1, 120, least=13)
    seen, real = [], near._verified

    def counting(pairs, words):
        seen.append(pairs.count())
        return real(pairs, words)

    monkeypatch.setattr(near, "_verified", counting)
    got = classes(spark, list(enumerate(texts)))
    assert [got[i] for i in range(len(texts))] == linked(texts)
    assert sum(seen[2:]) <= near.MANY * len(texts) < len(texts) * (len(texts) - 1) / 4


def test_classes_through_the_sieve_equal_all_pairs(spark, monkeypatch):
    """All that meet go through it, in many blocks: repeated words, lengths that differ, and texts about the threshold."""
    monkeypatch.setattr(near, "MANY", 0)
    monkeypatch.setattr(near, "HELD", 500)
    r = random.Random(5)
    texts = crowd(2, 90)
    for t in crowd(3, 60, words=40, least=3, most=5):
        words = t.split() + ["again"] * r.randint(0, 9)
        texts.append(" ".join(words[:len(words) - r.randint(0, 4)]))
    got = classes(spark, list(enumerate(texts)))
    assert [got[i] for i in range(len(texts))] == linked(texts)


def test_the_sieve_keeps_what_the_bag_distance_allows(spark, monkeypatch):
    monkeypatch.setattr(near, "HELD", 300)
    r = random.Random(8)
    bags = [np.array([r.randrange(40) for _ in range(r.randint(1, 30))], np.int32) - 20 for _ in range(40)]
    for a in list(bags):
        b = a.copy()
        b[r.sample(range(len(b)), len(b) // r.choice((4, 5, 6)))] = 99
        bags.append(b)
    number = [i * 7 + (1 << 33) * (i % 3) for i in range(len(bags))]
    words = spark.createDataFrame([(number[i], b.tolist()) for i, b in enumerate(bags)], "t long, words array<int>")
    asked = spark.createDataFrame([(number[i], [number[j] for j in range(len(bags)) if j > i and j % 7]) for i in range(len(bags) - 1)], "x long, ys array<long>")
    want = {tuple(sorted((number[i], number[j]))) for i in range(len(bags)) for j in range(i + 1, len(bags)) if j % 7
            and near.bag_distance(bags[i], bags[j]) <= np.floor(0.2 * max(len(bags[i]), len(bags[j])) + 1e-9)}
    got = [(x["a"], x["b"]) for x in near._sieved(asked, words).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
