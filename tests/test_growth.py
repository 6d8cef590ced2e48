"""What must not grow with the length of a text or the size of the input."""

import re

import pytest

from strandflow.operators import stats
from strandflow.plans import catalogue
from strandflow.plans import fixtures as fx
from tests.compare import SF_DIR


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["adapter_trim_se", "trim_polyx_bases", "insert_sizes", "align_multiple_adapters", "top_kmers"])
def test_python_function_is_called_once_and_no_text_waits_for_it(spark, name):
    said = plan(catalogue.QUERIES[name](spark, SF_DIR))
    assert said.count("ArrowEvalPython") == 1
    generate = re.findall(r"Generate posexplode\(.*\), \[([^\[\]]*)\], false", said)
    assert generate and all(re.fullmatch(r"doc_id#\d+L", g) for g in generate)


def test_tasks_grow_in_number(spark, monkeypatch):
    few = fx.documents(spark, SF_DIR).rdd.getNumPartitions()
    monkeypatch.setattr(fx, "TASK_BYTES", 10_000)
    many = fx.documents(spark, SF_DIR).rdd.getNumPartitions()
    assert few == 8 and many > 20


@pytest.mark.parametrize("size", [60, 150])
def test_pieces_are_whole(spark, size):
    texts = ["", None, "a" * (size - 1), "b-" * size, ("xy z\n" * 400), "é" + "Q" * (2 * size) + "!", "c" * (3 * size + 1)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wanted = []
    for i, t in enumerate(texts):
        letters = "".join(c for c in t or "" if c.isascii() and c.isalpha()).upper()
        wanted += [(i, k, letters[k * size:(k + 1) * size]) for k in range(len(letters) // size)]
    assert sorted(tuple(r) for r in fx._pieces(docs, size).collect()) == wanted


def test_duplication_counts_all_keys(spark, monkeypatch):
    asked, own = [], stats.duplication
    monkeypatch.setattr(stats, "duplication", lambda df, **options: asked.append(options) or own(df, **options))
    catalogue.QUERIES["duplication"](spark, SF_DIR)
    assert asked == [{"most": None}]


def test_duplication_without_a_bound(spark):
    from collections import Counter

    keys = [k % 7 for k in range(60)] + list(range(100, 140))
    reads = spark.createDataFrame([(i, f"{k:080d}") for i, k in enumerate(k * 10**40 for k in keys)], "read_id long, seq string")
    levels = Counter(Counter(keys).values())
    label = lambda n: str(n) if n <= 9 else ">10"
    wanted = {label(n): round(n * k / len(keys), 6) for n, k in levels.items()}
    got = {r["label"]: r["total_frac"] for r in stats.duplication(reads, most=None).collect()}
    assert got == wanted


def test_mates_are_cut_without_turning_them_back(spark):
    said = plan(catalogue.QUERIES["adapter_trim_pe"](spark, SF_DIR))
    above = said[:said.index("ArrowEvalPython")]
    assert "translate(" not in above and "reverse(" not in above
