"""Trimming operators: DataFrames with seq and qual columns in, the same columns trimmed and counts of what went out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.bases import truncate
from strandflow.operators import kernels


def keep_span(df: DataFrame, left: Column, right: Column, seq: str = "seq", qual: str = "qual", prefix: str = "trimmed") -> DataFrame:
    """Keeps [left, right) of seq and qual and adds <prefix>_5p and <prefix>_3p, the bases removed at either end."""
    n = F.length(seq)
    kept = F.greatest(right - left, F.lit(0))
    return df.withColumns({
        f"{prefix}_5p": left.cast("int"), f"{prefix}_3p": (n - F.greatest(right, left)).cast("int"),
        seq: truncate(seq, left, kept), qual: truncate(qual, left, kept),
    })


def fixed(df: DataFrame, n5: int | Column = 0, n3: int | Column = 0, seq: str = "seq", qual: str = "qual", prefix: str = "fixed") -> DataFrame:
    """Removes fixed amounts from both ends: first at the 5' end, then from what is left at the 3' end."""
    if isinstance(n5, int) and isinstance(n3, int) and n5 == n3 == 0:
        return df.withColumns({f"{prefix}_5p": F.lit(0), f"{prefix}_3p": F.lit(0)})
    n5, n3 = (x if isinstance(x, Column) else F.lit(x) for x in (n5, n3))
    n = F.length(seq)
    left = F.least(n5, n)
    return keep_span(df, left, left + F.greatest(n - left - n3, F.lit(0)), seq, qual, prefix)


def per_base(df: DataFrame, threshold: int = 2, preserve5p: bool = False, seq: str = "seq", qual: str = "qual", prefix: str = "quality") -> DataFrame:
    """Removes bases of a score up to the threshold and Ns from both ends."""
    df = df.withColumn("_span", kernels.span_column("per-base", F.col(seq), F.col(qual), threshold=threshold))
    left = F.lit(0) if preserve5p else F.col("_span.left")
    return keep_span(df, left, F.col("_span.right"), seq, qual, prefix).drop("_span")


def mott(df: DataFrame, rate: float = 0.05, preserve5p: bool = False, seq: str = "seq", qual: str = "qual", prefix: str = "quality") -> DataFrame:
    """Keeps the segment with the largest sum of rate - error probability."""
    df = df.withColumn("_span", kernels.span_column("mott", F.col(seq), F.col(qual), limit=rate))
    left = F.lit(0) if preserve5p else F.col("_span.left")
    return keep_span(df, left, F.col("_span.right"), seq, qual, prefix).drop("_span")


def window(df: DataFrame, size: float = 0.1, threshold: int = 2, preserve5p: bool = False, seq: str = "seq", qual: str = "qual",
           prefix: str = "quality") -> DataFrame:
    """Keeps what a sliding window of so many bases, or of that share of the read, finds good."""
    df = df.withColumn("_span", kernels.span_column("window", F.col(seq), F.col(qual), size=size, threshold=threshold))
    found = F.col("_span.left") < F.length(seq)
    left = F.when(found, F.lit(0)).otherwise(F.col("_span.left")) if preserve5p else F.col("_span.left")
    return keep_span(df, left, F.col("_span.right"), seq, qual, prefix).drop("_span")


def quality(df: DataFrame, strategy: str, preserve5p: bool = False, rate: float = 0.05, size: float = 0.1, threshold: int = 2, **columns) -> DataFrame:
    """The chosen strategy: none, mott, window or per-base."""
    if strategy == "none":
        return fixed(df, 0, 0, **{"prefix": "quality", **columns})
    if strategy == "mott":
        return mott(df, rate, preserve5p, **columns)
    if strategy == "window":
        return window(df, size, threshold, preserve5p, **columns)
    if strategy == "per-base":
        return per_base(df, threshold, preserve5p, **columns)
    raise ValueError(f"unknown trimming strategy {strategy!r}")


def polyx(df: DataFrame, bases: str, threshold: int = 10, seq: str = "seq", qual: str = "qual", prefix: str = "polyx") -> DataFrame:
    """Removes the longest 3' tail of one of the bases; adds <prefix>_base (N for none) and <prefix>_n."""
    if not bases:
        return df.withColumns({f"{prefix}_base": F.lit("N"), f"{prefix}_n": F.lit(0)})
    df = df.withColumn("_tail", kernels.polyx_column(F.col(seq), bases, threshold))
    kept = F.length(seq) - F.col("_tail.n")
    return df.withColumns({f"{prefix}_base": F.col("_tail.base"), f"{prefix}_n": F.col("_tail.n"),
                           seq: truncate(seq, 0, kept), qual: truncate(qual, 0, kept)}).drop("_tail")


def merged_sources(n5: Column, n3: Column, unique1: Column, unique2: Column) -> dict[str, Column]:
    """For one trim event of a merged read: reads counts 1 or 2 source reads; unique1 and unique2 are the bases of one mate only that remain."""
    left1, left2 = unique1 - n5, unique2 - n3
    both = ((n5 > 0) & (n3 > 0)) | ((n5 > 0) & (left1 < 0)) | ((n3 > 0) & (left2 < 0))
    any_ = (n5 > 0) | (n3 > 0)
    return {"reads": F.when(any_, F.when(both, 2).otherwise(1)).otherwise(0), "unique1": left1, "unique2": left2}
