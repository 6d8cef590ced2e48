"""op2: pairs that carry words are verified in parts."""

import random

from strandflow.llm import near
from tests.llm.helpers import prose


def test_pairs_are_verified_in_parts_and_none_is_left_out(spark, monkeypatch):
    """Texts that share half of their words and are no links make pairs; each is verified once, whatever the parts."""
    r = random.Random(4)
    shared = prose(1, 30).split()
    texts = [" ".join(shared + prose(10 + i, 30).split()) for i in range(12)]
    texts += [" ".join(prose(40, 60).split()[:-r.randint(1, 5)]) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], near._verified

    def counting(pairs, words):
        seen.append([(x["a"], x["b"]) for x in pairs.select("a", "b").collect()])
        return real(pairs, words)

    def run(most):
        monkeypatch.setattr(near, "AT_ONCE", most, raising=False)
        monkeypatch.setattr(near, "_verified", counting)
        seen.clear()
        got = sorted((x["doc_id"], x["class_id"]) for x in near.near_classes(docs).collect())
        return got, seen[2:]

    whole, (pairs,) = run(10**6)
    got, parts = run(10)
    assert len(pairs) > 20 and got == whole
    assert len(parts) == 1 + len(pairs) // 10 and max(map(len, parts)) < len(pairs)
    every = [p for part in parts for p in part]
    assert len(set(every)) == len(every) == len(pairs)
