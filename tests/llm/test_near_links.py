import random

import numpy as np
import pytest

from strandflow.llm import near
from tests.llm.helpers import prose
from tests.llm.test_near_whole import classes


def linked(texts):
    """The least number of each text's class, from all pairs."""
    ids = {}
    words = [np.array([ids.setdefault(w, len(ids)) for w in t.split()]) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if part[i] != part[j] and near.similarity(words[i], words[j]) is not None:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    return part


@pytest.mark.parametrize("seed,least,most", [(1, 12, 20), (2, 14, 18)])
def test_classes_of_texts_about_the_threshold_equal_all_pairs(spark, seed, least, most):
    """Copies of a text with so many hundredths of its words changed: two are similar if both have few, and most pairs of them just aren't."""
    r = random.Random(seed)
    base, texts = prose(40_000 + seed, 100).split(), []
    for m in range(250):
        mine = list(base)
        for at in r.sample(range(100), r.choice((8, *[r.randint(least, most)] * 9))):
            mine[at] = f"own{m}x{at}"
        texts.append(" ".join(mine))
    got = classes(spark, list(enumerate(texts)))
    assert [got[i] for i in range(len(texts))] == linked(texts)


def test_links_without_a_common_sketch(spark):
    """Every fifth word is another one, so no two texts have five words in a row in common."""
    rows = []
    for i in range(40):
        a = prose(50_000 + i, 60).split()
        b = [f"else{i}x{j}" if j % 5 == 2 else w for j, w in enumerate(a)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = classes(spark, rows)
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(40))


def test_similar_texts_share_enough_of_their_rarest_grams():
    r = random.Random(11)
    counts = np.array([r.randrange(3) for _ in range(near.CLASSES)])
    seen = 0
    for _ in range(6000):
        a = [r.randrange(r.choice((3, 30, 10**9))) for _ in range(r.randint(2, 120))]
        b = list(a)
        for _ in range(r.randint(1, 1 + len(a) // 4)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randint(0, 1)] = r.choice(([], [r.randrange(10**9)]))
        if not b or a == b or near.similarity(np.array(a), np.array(b)) is None:
            continue
        seen += 1
        tokens, of = near.rarest(np.array(a + b), np.array([len(a), len(b)]), counts)
        assert len(set(tokens[of == 0]) & set(tokens[of == 1])) >= near.least_shared(min(len(a), len(b))), (a, b)
    assert seen > 1000
