"""op9: what of the n-grams is on disk at once."""

import random

import numpy as np

from strandflow.llm import lm
from tests.llm.test_operators import scores_by_hand


def test_no_table_or_exchange_holds_all_ngrams(spark, monkeypatch):
    """An order's n-grams are dealt out in parts, what is kept of them is a few masks a text, and the scores are those of the whole."""
    monkeypatch.setattr(lm, "PER_SLICE", 1000, raising=False)
    monkeypatch.setattr(lm, "SLICES", 3, raising=False)
    # The table of frequent n-grams has a bound of its own.
    monkeypatch.setattr(lm, "FREQUENT", 2.0)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("a b c d e f g h the of".split()) for _ in range(r.randint(100, 200)))) for i in range(30)] + [(90, None), (91, "one"), (92, "a b " * 70)]
    written = []

    def counting(df, name, real=lm.materialize):
        out = real(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(lm, "materialize", counting)
    got = sorted((x["doc_id"], x["n_words"], x["log_score"]) for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    wanted = sorted(scores_by_hand(rows))
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in wanted], atol=2e-6)
    assert [name for name, _ in written].count("lm-marks") == 2 * 3
    blocks = sum(1 + n // lm.PLACES for _, n, _ in wanted)
    assert all(n <= blocks for _, n in written)
