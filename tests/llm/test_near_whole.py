import random

import numpy as np
import pytest

from strandflow.llm import near
from tests.llm.helpers import prose
from tests.llm.test_operators import edit_loop


def classes(spark, rows):
    return {x["doc_id"]: x["class_id"] for x in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def scattered(seed, members, words=200, changed=0.08):
    """Texts of one origin, each with its own changed words."""
    r = random.Random(seed)
    base, out = prose(seed, words).split(), []
    for m in range(members):
        mine = list(base)
        for at in r.sample(range(words), int(words * changed)):
            mine[at] = f"changed{m}x{at}"
        out.append(" ".join(mine))
    return out


def test_truncated_copies_that_share_a_passage_with_many(spark):
    """The part of the passage is on one side of 0.7 or 0.8 in a text and on the other in its truncated copy."""
    passage = prose(500, 170)
    rows = [(1000 + i, prose(600 + i, 120) + " " + passage) for i in range(15)]
    pairs = [(30, 20), (60, 40), (73, 40), (80, 40), (90, 45), (110, 50)]
    for i, (own, cut) in enumerate(pairs):
        words = prose(700 + i, own).split()
        rows += [(2 * i, passage + " " + " ".join(words)), (2 * i + 1, passage + " " + " ".join(words[:own - cut]))]
    got = classes(spark, rows)
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(pairs)))
    assert all(got[1000 + i] == 1000 + i for i in range(15))


def test_large_group_with_scattered_changes(spark):
    """Near copies of a large group are found as those of a small one are."""
    large, small = scattered(1, 40), scattered(2, 5)
    rows = [(i, t) for i, t in enumerate(large + small)] + [(100 + i, prose(1000 + i, 30)) for i in range(300)]
    got = classes(spark, rows)
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 45)} == {40}
    assert all(got[100 + i] == 100 + i for i in range(300))


def test_repeated_rows_of_another_text_change_no_class(spark):
    """What is found depends on the texts alone, not on how often another one is repeated."""
    rows = [(i, t) for i, t in enumerate(scattered(3, 18))] + [(100 + i, prose(1000 + i, 30)) for i in range(300)]
    hot = [(1000 + i, prose(5000, 30)) for i in range(8000)]
    got, more = classes(spark, rows), classes(spark, rows + hot)
    assert got == {d: c for d, c in more.items() if d < 1000}
    assert {got[i] for i in range(18)} == {0}


@pytest.mark.parametrize("words,changed,least", [(100, 18, 0.9), (100, 20, 0.9), (60, 10, 0.9), (300, 55, 0.9), (100, 10, 0.99), (25, 3, 0.9)])
def test_recall_near_the_threshold(spark, words, changed, least):
    """Pairs with words replaced at random places; every one of them is similar enough, as the plain table of edits says."""
    r = random.Random(words + changed)
    rows = []
    for i in range(300):
        a = prose(10_000 * words + i, words).split()
        b = list(a)
        for at in r.sample(range(words), changed):
            b[at] = f"other{i}x{at}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = classes(spark, rows)
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= least * 300
    assert len(set(got.values())) == 600 - sum(got[2 * i + 1] == 2 * i for i in range(300))


def test_links_equal_brute_force(spark):
    """All pairs of a table with every twentieth text against all: replaced, removed, moved and added words."""
    r = random.Random(4)
    rows = []
    for i in range(60):
        base = prose(20_000 + i, r.randint(30, 120)).split()
        rows.append(base)
        for _ in range(3):
            mine, part = list(base), r.choice((0.02, 0.08, 0.15, 0.19, 0.24))
            for _ in range(int(len(base) * part)):
                kind, at = r.randrange(3), r.randrange(len(mine))
                mine[at:at + 1] = [[f"new{r.random()}"], [], [mine[at], f"new{r.random()}"]][kind]
            rows.append(mine)
    got = classes(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])
    wanted = found = 0
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            longer = max(len(a), len(b))
            if i // 4 == j // 4 and edit_loop(a, b) <= 0.2 * longer + 1e-9:
                wanted, found = wanted + 1, found + (got[i] == got[j])
            elif i // 4 != j // 4:
                assert got[i] != got[j]
    assert wanted > 100 and found >= 0.95 * wanted


def test_a_group_across_lengths_stays_whole(spark):
    """Copies that lose a word at a time are one class, whatever cells their lengths are in."""
    words = prose(31, 200).split()
    got = classes(spark, [(i, " ".join(words[:200 - i])) for i in range(120)])
    assert set(got.values()) == {0}


def test_similar_texts_share_one_of_their_rarest_grams():
    """Whatever is edited, and however common n-grams are: texts of any length, with as many edits as the threshold allows."""
    r = random.Random(7)
    counts = np.array([r.randrange(1000) for _ in range(near.CLASSES)])
    for _ in range(4000):
        a = [r.randrange(r.choice((3, 30, 10**9))) for _ in range(r.randint(1, 60))]
        b = list(a)
        for _ in range(r.randint(0, len(a) // 4)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randint(0, 1)] = r.choice(([], [r.randrange(10**9)]))
        if not b or near.similarity(np.array(a), np.array(b)) is None or a == b:
            continue
        tokens, of = near.rarest(np.array(a + b), np.array([len(a), len(b)]), counts)
        assert set(tokens[of == 0]) & set(tokens[of == 1]), (a, b)
