import pytest

from strandflow.llm import fingerprints


@pytest.mark.parametrize("n", [3276, 4096, 5000])
def test_a_long_word_many_times(spark, n):
    """All words of a chunk vote alike and with the largest weight, so the highest lane gets as much as it can."""
    texts = [f"w{i}ordlong " * n for i in range(8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["fingerprint"] for x in fingerprints.fingerprint_documents(rows).collect()}
    once = {x["doc_id"]: x["fingerprint"] for x in fingerprints.fingerprint_documents(
        spark.createDataFrame([(i, t.split()[0]) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    # A word's own votes outweigh those of its pair with itself four to one.
    assert got == once
