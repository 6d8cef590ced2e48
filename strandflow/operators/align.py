"""Adapter alignment, truncation and merging of mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.bases import reverse_complement, strip_mate, truncate
from strandflow.operators import kernels


def allowed(aligned: Column, rate: float) -> Column:
    """The mismatches allowed in so many aligned bases: none below 6, one below 10."""
    most = F.floor(aligned * F.lit(rate))
    return F.when(aligned < 6, F.lit(0)).when(aligned < 10, F.least(most, F.lit(1))).otherwise(most)


def classify(aln: Column | str, rate: float, min_overlap: int, merge_threshold: int | None = None, mates: Column | None = None) -> Column:
    """bad, good or, for mates that are both non-empty and overlap enough, mergeable."""
    aln = F.col(aln) if isinstance(aln, str) else aln
    aligned = aln["length"] - aln["n_ambiguous"]
    good = (aln["score"] > 0) & (aligned >= min_overlap) & (aln["n_mismatches"] <= allowed(aligned, rate))
    kind = F.when(good, F.lit("good")).otherwise(F.lit("bad"))
    if merge_threshold is None:
        return kind
    return F.when(good & mates & (aligned >= merge_threshold), F.lit("mergeable")).otherwise(kind)


def unique_pairs(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Adapter pairs (first, second as sequenced) without repeats; the second is stored reverse complemented."""
    complement = str.maketrans("ACGT", "TGCA")
    seen: dict[tuple[str, str], None] = {}
    for a, b in pairs:
        seen.setdefault((a, b.translate(complement)[::-1]))
    return list(seen)


def single(df: DataFrame, adapters: list[str], shift: int = 2, rate: float = 0.1667, min_overlap: int = 1, seq: str = "seq", group: Column | None = None,
           by_group: dict[int, list[str]] | None = None) -> DataFrame:
    """Adds aln, the best alignment of any adapter, and aln_type.  by_group: adapters of reads with that number in group."""
    df = df.withColumn("aln", kernels.align_single_column(F.col(seq), adapters, shift, group, by_group))
    return df.withColumn("aln_type", classify("aln", rate, min_overlap))


def truncate_single(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Cuts reads where their adapter begins; adds adapter_bp, the bases that went."""
    n = F.length(seq)
    kept = F.when(F.col("aln_type") == "good", F.least(F.greatest(F.col("aln.offset"), F.lit(0)), n)).otherwise(n)
    return df.withColumn("_kept", kept).withColumns({
        "adapter_bp": (F.length(seq) - F.col("_kept")).cast("int"), seq: truncate(seq, 0, F.col("_kept")), qual: truncate(qual, 0, F.col("_kept")),
    }).drop("_kept")


def paired(df: DataFrame, pairs: list[tuple[str, str]], shift: int = 2, rate: float = 0.1667, min_overlap: int = 1, merge_threshold: int = 11,
           group: Column | None = None, by_group: dict[int, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Adds rc2 and rq2 (mate 2 in the direction of mate 1), aln, aln_type and insert_size (null for bad alignments).

    pairs: adapters as sequenced; without any, mates must overlap end to end.  by_group: adapters of mates with that number in group.
    """
    df = df.withColumns({"rc2": reverse_complement("seq2"), "rq2": F.reverse("qual2")})
    df = df.withColumn("aln", kernels.align_pair_column(F.col("seq1"), F.col("rc2"), unique_pairs(pairs), shift, group,
                                                           {k: unique_pairs(v) for k, v in (by_group or {}).items()}))
    both = (F.length("seq1") > 0) & (F.length("rc2") > 0)
    df = df.withColumn("aln_type", classify("aln", rate, min_overlap, merge_threshold, both))
    size = F.greatest(F.lit(0), F.length("rc2") + F.col("aln.offset"))
    return df.withColumn("insert_size", F.when(F.col("aln_type") != "bad", size).cast("int"))


def truncate_paired(df: DataFrame) -> DataFrame:
    """Cuts mates to the insert; adds adapter_bp and adapter_reads, the bases that went and the mates they went from."""
    good, size = F.col("aln_type") != "bad", F.col("insert_size")
    n1, n2 = F.length("seq1"), F.length("rc2")
    keep1 = F.when(good, F.least(size, n1)).otherwise(n1)
    keep2 = F.when(good & (F.col("aln.offset") < 0), F.least(size, n2)).otherwise(n2)
    df = df.withColumns({"_k1": keep1, "_k2": keep2, "_n1": n1, "_n2": n2})
    df = df.withColumns({
        "seq1": truncate("seq1", 0, F.col("_k1")), "qual1": truncate("qual1", 0, F.col("_k1")),
        "rc2": truncate("rc2", F.col("_n2") - F.col("_k2"), F.col("_k2")), "rq2": truncate("rq2", F.col("_n2") - F.col("_k2"), F.col("_k2")),
        "seq2": truncate("seq2", 0, F.col("_k2")), "qual2": truncate("qual2", 0, F.col("_k2")),
        "adapter_bp": (F.col("_n1") - F.col("_k1") + F.col("_n2") - F.col("_k2")).cast("int"),
        "adapter_reads": (F.when(F.col("_k1") < F.col("_n1"), 1).otherwise(0) + F.when(F.col("_k2") < F.col("_n2"), 1).otherwise(0)),
    })
    return df.drop("_k1", "_k2", "_n1", "_n2")


def fragments(df: DataFrame, most: int = 42) -> DataFrame:
    """What lies beyond the insert in aligned mates: adapter1 and adapter2 of a pair, cut to so many bases."""
    size = F.greatest(F.lit(0), F.length("rc2") + F.col("aln.offset"))
    good = F.col("aln_type") != "bad"
    a1 = F.when(good, truncate("seq1", F.least(size, F.length("seq1")), F.lit(most))).otherwise(F.lit(""))
    a2 = F.when(good, truncate("seq2", F.least(size, F.length("seq2")), F.lit(most))).otherwise(F.lit(""))
    return df.withColumns({"fragment1": a1, "fragment2": a2})


def merge(df: DataFrame, strategy: str = "maximum", max_quality: int = 41, mate_separator: str = "/") -> DataFrame:
    """Mergeable mates, truncated -> one consensus read each: header, seq, qual, mm_resolved, mm_unresolved, ns_resolved."""
    df = df.where(F.col("aln_type") == "mergeable")
    df = df.withColumn("_m", kernels.merge_column(F.col("seq1"), F.col("qual1"), F.col("rc2"), F.col("rq2"), F.col("aln.offset"), strategy, max_quality))
    return df.withColumns({
        "header": strip_mate("header1", mate_separator), "seq": F.col("_m.seq"), "qual": F.col("_m.qual"), "mm_resolved": F.col("_m.resolved"),
        "mm_unresolved": F.col("_m.unresolved"), "ns_resolved": F.col("_m.ns_resolved"),
    }).drop("_m")


def merge_all(df: DataFrame, strategy: str = "maximum", max_quality: int = 41, mate_separator: str = "/") -> DataFrame:
    """All pairs, with header0, seq0, qual0 and the counts of merge(): the consensus of mergeable mates, empty for others."""
    on = F.col("aln_type") == "mergeable"
    inputs = [F.when(on, F.col(c)).otherwise("") for c in ("seq1", "qual1", "rc2", "rq2")]
    df = df.withColumn("_m", kernels.merge_column(*inputs, F.when(on, F.col("aln.offset")).otherwise(0), strategy, max_quality))
    return df.withColumns({
        "header0": strip_mate("header1", mate_separator), "seq0": F.col("_m.seq"), "qual0": F.col("_m.qual"), "mm_resolved": F.col("_m.resolved"),
        "mm_unresolved": F.col("_m.unresolved"), "ns_resolved": F.col("_m.ns_resolved"),
    }).drop("_m")
