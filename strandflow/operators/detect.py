"""Which adapters reads hold: hits of known adapters in a prefix of the input, and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import align, kernels

MIN_LENGTH = 8
PREFIX_READS = 100_352
MIN_HITS, MIN_SHARE, LOW_SHARE, MAX_MISMATCHES = 10, 0.01, 0.001, 0.05


def candidates(database: list[tuple[str, list[str], list[str]]]) -> list[str]:
    """All distinct adapters of eight bases or more, sorted."""
    return sorted({s for _, a, b in database for s in (*a, *b) if len(s) >= MIN_LENGTH})


def hits(df: DataFrame, adapters: list[str], rate: float = 0.1667, seq: str = "seq") -> DataFrame:
    """Rows (candidate, hits, aligned, mismatches): how often each adapter is the best match of a read.

    A match that runs to the end of its read is a match of all adapters that begin with the matched part, so they
    share it.  Reads are counted by match first; the sharing works on that bounded table.
    """
    spark = df.sparkSession
    found = df.withColumn("aln", kernels.align_single_column(F.col(seq), adapters, 0))
    found = found.where(align.classify("aln", rate, MIN_LENGTH) == "good").withColumn(
        "to_end", (F.col("aln.offset") + F.col("aln.length")) == F.length(seq))
    grouped = found.groupBy("aln.adapter_id", "aln.length", "to_end").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("aln.length") - F.col("aln.n_ambiguous")).alias("aligned"), F.sum("aln.n_mismatches").alias("mismatches"))
    names = spark.createDataFrame(list(enumerate(adapters)), "adapter_id int, own string")
    every = F.broadcast(spark.createDataFrame([(a,) for a in adapters], "candidate string"))
    part = F.substring("own", F.lit(1), F.col("length"))
    shared = F.col("candidate").startswith(part) & (F.length("candidate") >= F.col("length"))
    credited = grouped.join(F.broadcast(names), "adapter_id").join(every, (F.col("candidate") == F.col("own")) | (F.col("to_end") & shared))
    return credited.groupBy("candidate").agg(*[F.sum(c).alias(c) for c in ("hits", "aligned", "mismatches")])


def choose(found: DataFrame, n_reads: int) -> str | None:
    """The adapter with the most hits, then the most matching bases, then the first; None unless there are enough hits."""
    best = found.orderBy(F.desc("hits"), F.desc(F.col("aligned") - F.col("mismatches")), "candidate").limit(1).collect()
    if not best:
        return None
    b = best[0]
    enough = b["hits"] >= MIN_SHARE * n_reads or (b["hits"] >= LOW_SHARE * n_reads and b["mismatches"] <= MAX_MISMATCHES * b["aligned"])
    return b["candidate"] if b["hits"] >= MIN_HITS and enough else None


def name_pair(a1: str | None, a2: str | None, database: list[tuple[str, list[str], list[str]]], user: tuple[str, ...] = ()) -> list[tuple[str, str, bool]]:
    """(source of adapter 1, source of adapter 2, swapped) of an exact pair, best first.

    Known sources go before the user's, the usual order before the swapped, one source before two.
    """
    out = []
    for swapped in (False, True):
        x, y = (a2, a1) if swapped else (a1, a2)
        first = [n for n, a, _ in database if x in a]
        second = [n for n, a, b in database if y in (b or a)]
        out += [((p in user) + (q in user), swapped, p != q, p, q) for p in first for q in second]
    return [(p, q, s) for _, s, _, p, q in sorted(out)]


def closest(sequence: str, database: list[tuple[str, list[str], list[str]]]) -> tuple[str, str] | None:
    """(source, adapter) that agrees with a sequence from the first base on in the most bases less twice the mismatches."""
    best: tuple[int, int] | None = None
    out = None
    for name, a, b in database:
        for known in (*a, *b):
            n = min(len(known), len(sequence))
            wrong = sum(x != y and "N" not in (x, y) for x, y in zip(known, sequence))
            unknown = sum("N" in (x, y) for x, y in zip(known, sequence))
            score = (n - unknown - 2 * wrong, n)
            if score[0] > 0 and (best is None or score > best):
                best, out = score, (name, known)
    return out
