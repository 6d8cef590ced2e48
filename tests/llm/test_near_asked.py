"""op2, pipeline: numbers of texts that meet are dealt out in steps, from a table, and none is left out."""

from strandflow.llm import near
from tests.llm.test_near_links import linked
from tests.llm.test_near_sieve import crowd
from tests.llm.test_near_whole import classes


def test_numbers_of_texts_that_meet_are_dealt_out_in_steps(spark, monkeypatch):
    """Before, one step dealt out all numbers of all spots, while the words and tokens that made them were still on disk."""
    texts = crowd(7, 40, words=50, least=6, most=8)
    real, read, rows = near.materialize, [], []

    def watching(df, name):
        out = real(df, name)
        if name == "near-asked":
            read.append(df.inputFiles())
            rows.append({x["x"]: sorted(x["ys"]) for x in out.collect()})
        return out

    def run(most):
        monkeypatch.setattr(near, "LISTED", most, raising=False)
        read.clear()
        rows.clear()
        got = classes(spark, list(enumerate(texts)))
        assert [got[i] for i in range(len(texts))] == linked(texts)
        assert all("near-met" in path for paths in read for path in paths)
        return list(rows)

    monkeypatch.setattr(near, "materialize", watching)
    whole, = run(10**9)
    steps = run(1)
    assert sum(map(len, whole.values())) > 200
    assert len(steps) > 2 and max(map(len, steps)) < len(whole)
    assert sum(map(len, steps)) == len(whole)  # no text asks in two steps
    assert sum(len(ys) for step in steps for ys in step.values()) == sum(map(len, whole.values()))
