import numpy as np
import pytest

from strandflow.llm import contamination
from tests.llm.helpers import prose

ITEMS = "item_id long, text string"


@pytest.mark.parametrize("length", [64, 65, 128, 300, 500, 2000])
def test_long_items_are_found_wherever_they_begin(spark, length):
    """Items of one sentence, and of a question and an answer, copied word for word into longer documents."""
    one, two = prose(1, length), prose(2, length - 10) + ". " + prose(3, 10)
    items = spark.createDataFrame([(1, one), (2, two), (3, "a short item of seven words only")], ITEMS)
    before = (0, 1, 31, 33, 400)
    rows = [(10 * item + i, f"{prose(10 + n, n)} {text} {prose(20, 300)}") for item, text in ((1, one), (2, two)) for i, n in enumerate(before)]
    rows.append((99, prose(21, 3000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["item_id"]) for x in contamination.leaks(docs, items).collect())
    assert got == [(10 * item + i, item) for item in (1, 2) for i in range(len(before))]
    assert [x["doc_id"] for x in contamination.drop_leaks(docs, items).collect()] == [99]


def test_scores_do_not_depend_on_blocks(spark):
    """Items share words within and across blocks; with any number of items a block, rows and scores are the same."""
    words = prose(30, 12).split()
    texts = [" ".join(words[i % 3:i % 3 + 6]) + " " + prose(40 + i, 3 + 7 * (i % 4)) for i in range(11)]
    items = spark.createDataFrame([(i // 2 or None, t) for i, t in enumerate(texts)], ITEMS)
    docs = spark.createDataFrame([(i, f"{prose(60 + i, 20)} {t} {prose(80 + i, 20)}") for i, t in enumerate(texts)], "doc_id long, text string")

    def rows(max_items):
        got = contamination.leaks(docs, items, max_items=max_items).collect()
        return sorted((x["doc_id"], x["item_id"] or 0, round(x["score"], 9), x["question_overlap"], x["answer_overlap"]) for x in got)

    whole = rows(2000)
    assert len(whole) >= 11 and rows(1) == whole and rows(4) == whole


def test_wand_finds_what_scoring_every_item_finds():
    """Random queries over items of few words, in blocks of several: the same items and scores as without any bounds."""
    rng = np.random.default_rng(9)
    vocabulary = rng.integers(1, 2**63, 300, dtype=np.uint64)
    odds = 1 / np.arange(1, 301) ** 0.8
    draw = lambda n: rng.choice(vocabulary, n, p=odds / odds.sum())
    items = [draw(rng.integers(1, 30)) for _ in range(90)]
    index = contamination.build_index(list(range(90)), items, [len(w) for w in items])
    weight = np.zeros((len(index.terms), 90))
    weight[np.repeat(np.arange(len(index.terms)), np.diff(index.ptr)), index.items] = index.weights
    queries = [np.unique(np.searchsorted(index.terms, w[np.isin(w, index.terms)])) for w in (draw(rng.integers(0, 60)) for _ in range(400))]
    query = np.repeat(np.arange(400), [len(x) for x in queries])
    wanted = rng.random(90) < 0.8
    got = {(int(q), int(i)): s for q, i, s in zip(*contamination.wand(index, query, np.concatenate(queries), wanted))}
    plain = {(q, i): s for q, x in enumerate(queries) for i, s in enumerate(weight[x].sum(axis=0)) if wanted[i] and s >= index.need[i] * (1 - 1e-9) and index.need[i] > 0}
    assert len(plain) > 50 and got == pytest.approx(plain)


def test_long_texts_are_searched_piece_by_piece(monkeypatch):
    """A text of 400,000 words, whatever is searched at once, and in little more memory than its words take."""
    import tracemalloc

    rng = np.random.default_rng(2)
    items = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (20, 60, 150)]
    index = contamination.build_index([7, 8, 9], items, [15, 50, 140])
    text = np.concatenate([rng.choice(np.concatenate(items), 200_000), items[2], rng.choice(np.concatenate(items), 150_000), items[0], rng.integers(1, 2**63, 50_000, dtype=np.uint64), items[1]])
    whole = contamination.search(index, text, np.array([len(text)]))
    assert {7, 8, 9} == {index.item_ids[i] for _, i, *_ in whole}
    monkeypatch.setattr(contamination, "CHUNK", 5000)
    tracemalloc.start()
    assert contamination.search(index, text, np.array([len(text)])) == whole
    assert tracemalloc.get_traced_memory()[1] < 60 * len(text)
    tracemalloc.stop()
