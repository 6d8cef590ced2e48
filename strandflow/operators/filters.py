"""Read filters: a read is charged to the first that it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.bases import complexity, count_ns, mean_quality

REASONS = ("min_length", "max_length", "max_ns", "min_mean_quality", "min_complexity")


def fail_reason(seq="seq", qual="qual", min_length: int = 15, max_length: int | None = None, max_ns: int | None = None,
                max_ns_fraction: float | None = None, min_mean_quality: float = 0.0, min_complexity: float = 0.0) -> Column:
    """The name of the first filter that fails, or null.  The share of Ns is limited to 0.05 unless either limit is given."""
    if max_ns_fraction is None:
        max_ns_fraction = 0.05 if max_ns is None else 1.0
    n, ns = F.length(seq), count_ns(seq)
    too_many = ns > n * max_ns_fraction
    if max_ns is not None:
        too_many = too_many | (ns > max_ns)
    out = F.when(n < min_length, "min_length")
    if max_length is not None:
        out = out.when(n > max_length, "max_length")
    out = out.when(too_many, "max_ns")
    if min_mean_quality > 0:
        out = out.when((n > 0) & (mean_quality(qual) < min_mean_quality), "min_mean_quality")
    if min_complexity > 0:
        out = out.when(complexity(seq) < min_complexity, "min_complexity")
    return out


def filter_counts(df: DataFrame, reason: str = "fail_reason", seq: str = "seq", weight: Column | int = 1) -> DataFrame:
    """Rows (fail_reason, reads, bases); passing reads are `passed`; a merged read weighs 2."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return df.groupBy(F.coalesce(reason, F.lit("passed")).alias("fail_reason")).agg(
        F.sum(weight).cast("long").alias("reads"), F.sum(F.length(seq)).cast("long").alias("bases"))
