"""Counting by position, numbering of the first reads, trimming by base: against plain loops."""

from collections import Counter

from pyspark.sql import functions as F

from strandflow.operators import stats, trim
from strandflow.sources import fastq


READS = [(i, k, s, q) for i, (k, s, q) in enumerate([("x", "ACGTN", "!+5?I"), ("x", "AC", "II"), ("y", "", ""), ("y", "NNA", "!!!"), (None, "GGGGGGGG", "IIIIIIII"), ("x", "TN", "5I")])]


def frame(spark):
    return spark.createDataFrame(READS, "read_id long, k string, seq string, qual string").repartition(2)


def test_positions_and_scores(spark):
    wanted, sums, scores = Counter(), Counter(), Counter()
    for _, k, s, q in READS:
        for pos, (b, c) in enumerate(zip(s, q)):
            wanted[k, pos, b] += 1
            sums[k, pos, b] += ord(c) - 33
            scores[k, ord(c) - 33] += 1
    got = stats.position_counts(frame(spark), "k")
    assert got.columns == ["k", "pos", "nuc", "n", "q_sum"]
    assert {tuple(r) for r in got.collect()} == {(*key, n, sums[key]) for key, n in wanted.items()}
    assert {tuple(r) for r in stats.quality_histogram(frame(spark), "k").collect()} == {(*key, n) for key, n in scores.items()}
    whole = stats.position_counts(frame(spark))
    assert sum(r["n"] for r in whole.collect()) == sum(wanted.values())
    assert "Generate" not in whole._jdf.queryExecution().executedPlan().toString()


def test_first_reads_are_numbered_as_all_are(spark):
    reads = spark.createDataFrame([(f, r * 400_000) for f in (0, 1) for r in range(20)], "file_ord int, rec long").repartition(3)
    every = sorted(tuple(r) for r in fastq.concatenated(reads).select("read_idx", "file_ord", "rec").collect())
    for first in (0, 1, 7, 20, 23, 40, 100):
        assert sorted(tuple(r) for r in fastq.concatenated(reads, first=first).select("read_idx", "file_ord", "rec").collect()) == every[:first]
    assert fastq.concatenated(reads.where("rec < 0"), first=5).count() == 0


def test_trimming_by_base(spark):
    for keep in (False, True):
        for r in trim.per_base(frame(spark).withColumn("s", F.col("seq")), 10, preserve5p=keep).join(frame(spark).select("read_id", F.col("qual").alias("q")), "read_id").collect():
            good = [i for i, (b, c) in enumerate(zip(r["s"], r["q"])) if b != "N" and ord(c) - 33 > 10]
            lo, hi = (0 if keep or not good else good[0]), (good[-1] + 1 if good else 0)
            assert (r["seq"], r["qual"], r["quality_5p"], r["quality_3p"]) == (r["s"][lo:hi], r["q"][lo:hi], lo, len(r["s"]) - hi)
