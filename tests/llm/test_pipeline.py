"""Every stage of the pipeline against plain Python over a small corpus with planted cases."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from strandflow.llm import queries
from tests.llm.helpers import DOCS, prose
from tests.llm.test_operators import edit_loop, lines_by_hand

LICENSE = "Licensed under the terms that everyone copies."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    path = tmp_path_factory.mktemp("corpus")
    items = [(i, f"{prose(5000 + i, 25)}? {prose(6000 + i, 6)}.") for i in range(4)]
    rows, toxic = [], set()

    def add(text, source=None):
        rows.append((len(rows), text, "en", source or r.choice("abc"), len(text)))
        return len(rows) - 1

    for i in range(110):
        lines = [f"{prose(100 * i + k, r.randint(12, 25))}." for k in range(3)]
        add("\n".join(lines + [LICENSE] * (i % 4 == 0)))
    for i in range(30):
        toxic.add(add(f"{prose(40000 + i, 12)}. {prose(50000 + i, 5)} {('vile', 'rotten', 'filthy')[i % 3]} {prose(60000 + i, 4)}. {prose(70000 + i, 15)}."))
    for i in (1, 2, 3):
        add(rows[i][1])
        words = rows[i + 10][1].replace("\n", " ").split(" ")
        for k in range(0, len(words), 25):
            words[k] = "other"
        add(" ".join(words))
    for i, (_, text) in enumerate(items):
        add(f"{prose(80000 + i, 40)}. {text} {prose(90000 + i, 40)}.")
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows[:140]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, toxic, items


def test_stages_equal_brute_force(spark, corpus):
    path, rows, toxic, items = corpus
    outs, docs = [], spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "test-stage")
        outs.append({(x["doc_id"], x["text"]) for x in docs.collect()})
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    wanted = {(i, t) for i, t, *_ in rows if i not in toxic}
    assert outs[0] == wanted
    by_hand = lines_by_hand([(i, t) for i, t in wanted if t is not None], 16)
    assert {(i, t) for i, t in outs[1] if i != 900} == set(by_hand) and (900, None) in outs[1]
    left = sorted(((i, t or "") for i, t in outs[1]))
    head: dict[int, int] = {}
    for n, (i, t) in enumerate(left):
        head[i] = i
        for j, u in left[:n]:
            a, b = t.lower().split(), u.lower().split()
            near = t == u or (a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and edit_loop(a, b) <= 0.2 * max(len(a), len(b)))
            if near:
                x, y = head[i], head[j]
                head = {k: min(x, y) if v in (x, y) else v for k, v in head.items()}
    assert {i for i, _ in outs[2]} == set(head.values())
    flat = {i: f" {' '.join((t or '').lower().replace('.', '').replace('?', '').split())} " for i, t in outs[2]}
    leaked = {i for i, t in flat.items() for _, q in items if f" {' '.join(q.lower().replace('.', '').replace('?', '').split())} " in t}
    assert len(leaked) == 4 and {i for i, _ in outs[3]} == set(flat) - leaked
    con = duckdb.connect()
    mid = [(i, t, *next(r[3:4] for r in rows if r[0] == i)) for i, t in outs[3]]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", mid)
    times = {i: c + e for i, c, e in con.execute(f"SELECT doc_id, copies, extra FROM ({queries.ORACLES['op8_mixing']})").fetchall() if c + e}
    assert Counter(x["doc_id"] for x in docs.collect()) == times


def test_run(spark, corpus):
    path = corpus[0]
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 50 and got.columns[-1] == "copy_no" and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_clashing_columns_and_string_ids(spark, corpus):
    """Every stage keeps further columns, whatever they are called, and takes ids of any type."""
    from pyspark.sql import functions as F

    from tests.llm.helpers import clashing

    docs = clashing(spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(60))
    for kind in ("long", "string"):
        typed = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, typed, corpus[0])
            assert out.columns == [*docs.columns, *(["copy_no_"] if name == "mixing" else [])]
            assert out.where("copy_no <> 'x' or score <> 'x'").count() == 0


def test_empty_tables(spark, corpus, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
