"""The runs as plans: reads in, processed reads with the outcome of every step out, statistics from these.

Outcomes of steps are columns of a read, so every counter of a report is a sum over processed reads, and one scan gives
them all.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.config import Config, ConfigError
from strandflow.functions import bases
from strandflow.operators import align, demux, detect, filters, routing, stats, trim
from strandflow.sources import adapters as known
from strandflow.sources import fastq


log = logging.getLogger("strandflow")


def barcoded(reads: DataFrame, config: Config, pairs: list[tuple[str, str]] | None) -> dict:
    """What align takes for demultiplexed reads: a column for sample and barcode, and the adapters behind the barcodes of each."""
    if not config.barcodes or "sample_idx" not in reads.columns or not pairs:
        return {}
    barcodes = demux.oriented(list(config.barcodes), config.barcode_orientation)
    return {"group": demux.group_of(), "by_group": demux.adapters_by_group(barcodes, pairs)}


def written_header(header: str, config: Config, found: str) -> Column:
    """The header as it goes out: as it is, or with the separator before the mate number that the run asks for; strip leaves both out."""
    if config.normalize_mate_separator is None:
        return F.col(header)
    wanted = "" if config.normalize_mate_separator == "strip" else config.normalize_mate_separator
    return routing.output_header(header, "read_type", found, wanted)


def normalized(reads: DataFrame, config: Config, columns: list[tuple[str, str]]) -> DataFrame:
    """Bases and qualities of all mates in the forms that the operators expect."""
    for seq, qual in columns:
        reads = reads.withColumns({seq: bases.normalize_bases(seq, config.mask_degenerate_bases, config.convert_uracils),
                                   qual: bases.decode_quality(qual, config.quality_format)})
    return reads


def polyx_bases(choice: str, reads: DataFrame, header: str) -> str:
    """auto is G for two-colour chemistry, as told by the first read's header, else nothing."""
    if choice != "auto":
        return choice.upper()
    first = reads.agg(F.min_by(header, "read_id").alias("h")).select(bases.is_two_color("h").alias("x")).first()
    return "G" if first["x"] else ""


def select_adapters(reads: DataFrame, config: Config, seqs: list[str]) -> list[tuple[str, str]] | None:
    """Adapter pairs of the run, None for mates that must overlap end to end.

    Automatic selection is a small job of its own over a prefix of the reads; the main plan is made with its result.
    """
    if config.adapter_selection == "manual":
        return list(config.adapters)
    if config.adapter_selection == "undefined":
        return None
    if config.adapter_selection == "none":
        return []
    # read_id is the ordinal of a read in its input, so this is a filter; the prefix is bounded and kept for its several uses.
    prefix = reads.where(F.col("read_id") < detect.PREFIX_READS).select(*seqs).persist()
    try:
        n = prefix.count()
        if not n:
            return []
        names = detect.candidates(known.KNOWN_ADAPTERS)
        found = [detect.choose(detect.hits(prefix, names, config.mismatch_rate, seq), n) for seq in seqs]
    finally:
        prefix.unpersist()
    if all(found):
        pair = found[0], found[-1] if len(found) > 1 else ""
        named = detect.name_pair(*pair, known.KNOWN_ADAPTERS) if len(found) > 1 else []
        if named and named[0][2]:
            log.warning("adapters of %s are swapped between the mates; the input files may be, too", named[0][0])
        return [pair]
    if config.adapter_fallback == "abort":
        raise ConfigError("adapters could not be detected")
    return None if config.adapter_fallback == "undefined" else []


def _total(before: list[str], after: list[str]) -> Column:
    return sum((F.col(b) for b in before), F.lit(0)) - sum((F.length(a) for a in after), F.lit(0))


def process_single(reads: DataFrame, config: Config) -> DataFrame:
    """Reads (read_id, header, seq, qual) through all steps; adds the steps' outcomes, fail_reason, read_type and file."""
    config = config.resolved()
    pairs = select_adapters(reads, config, ["seq"])
    reads = normalized(reads, config, [("seq", "qual")]).withColumn("in_length", F.length("seq"))
    out = trim.fixed(reads, 0, config.pre_trim3p[0], prefix="pre")
    out = trim.polyx(out, polyx_bases(config.pre_trim_polyx, reads, "header"), config.trim_polyx_threshold, prefix="pre_polyx")
    behind = barcoded(reads, config, pairs)
    if behind:
        behind["by_group"] = {k: [a for a, _ in v] for k, v in behind["by_group"].items()}
    out = align.single(out, [a for a, _ in pairs or []], config.shift, config.mismatch_rate, config.min_overlap, **behind)
    out = align.truncate_single(out)
    if config.prefix_read1:
        out = out.withColumn("header", bases.add_prefix("header", config.prefix_read1))
    out = trim.fixed(out, config.post_trim5p[0], config.post_trim3p[0], prefix="post")
    out = trim.polyx(out, config.post_trim_polyx.upper(), config.trim_polyx_threshold, prefix="post_polyx")
    out = trim.quality(out, config.quality_trimming, config.preserve5p, config.trim_mott_rate, config.trim_windows, config.trim_min_quality)
    out = out.withColumn("total_trimmed", F.col("in_length") - F.length("seq")).withColumn("fail_reason", _reason("seq", "qual", config))
    out = out.withColumn("read_type", routing.single_type(F.col("fail_reason").isNull()))
    out = out.withColumn("header", written_header("header", config, config.mate_separator or ""))
    return out.withColumn("file", routing.file_of("read_type"))


def _reason(seq: str, qual: str, config: Config) -> Column:
    return filters.fail_reason(seq, qual, config.min_length, config.max_length, config.max_ns, config.max_ns_fraction, config.min_mean_quality,
                               config.min_complexity)


def process_paired(reads: DataFrame, config: Config) -> DataFrame:
    """Pairs (read_id, header1, seq1, qual1, header2, seq2, qual2) through all steps -> one row a read that goes out.

    Rows: read_id, mate (0 for merged), header, seq, qual, the steps' outcomes, n_sources, fail_reason, read_type, file, and sample and
    orientation of demultiplexed mates.  trimmed_reads and quality_reads are the mates that the last fixed and the quality trimming
    took bases from: of a merged read both where both ends lost some, or one end more than its mate alone had there.
    """
    config = config.resolved()
    pairs = select_adapters(reads, config, ["seq1", "seq2"])
    mates = [("seq1", "qual1"), ("seq2", "qual2")]
    separator = config.mate_separator if config.mate_separator is not None else "/"
    out = normalized(reads, config, mates).withColumns({"in1": F.length("seq1"), "in2": F.length("seq2")})
    tails = polyx_bases(config.pre_trim_polyx, reads, "header1")
    for i, (seq, qual) in enumerate(mates, 1):
        out = trim.fixed(out, 0, config.pre_trim3p[i - 1], seq, qual, prefix=f"pre{i}")
        out = trim.polyx(out, tails, config.trim_polyx_threshold, seq, qual, prefix=f"pre_polyx{i}")
    tried = [] if pairs == [] else pairs or [("", "")]
    out = align.paired(out, tried, config.shift, config.mismatch_rate, config.min_overlap, config.merge_threshold, **barcoded(reads, config, pairs))
    out = align.truncate_paired(out.withColumns({"n1": F.length("seq1"), "n2": F.length("seq2")}))
    common = [*(c for c in ("sample", "orientation") if c in reads.columns), "read_id", "aln", "aln_type", "insert_size", "adapter_bp", "adapter_reads", "in1", "in2",
              *(f"pre{i}_{e}" for i in (1, 2) for e in ("5p", "3p")), *(f"pre_polyx{i}_{e}" for i in (1, 2) for e in ("base", "n"))]
    # Merged reads are a third read beside the mates.  Whichever of them don't apply to a pair are empty, so one scan serves both.
    mergeable = F.lit(config.merge) & (F.col("aln_type") == "mergeable")
    third = [("seq0", "qual0")] if config.merge else []
    if config.merge:
        start = F.greatest(F.lit(0), F.col("aln.offset"))
        out = out.withColumns({"own1": start, "own2": F.length("seq2") - (F.length("seq1") - start)})
        out = align.merge_all(out, config.merge_strategy, config.merge_quality_max, separator)
        out = out.withColumns({c: F.when(F.col("aln_type") == "mergeable", "").otherwise(F.col(c)) for pair in mates for c in pair})
    for i, (seq, qual) in enumerate([*third, *mates], 0 if config.merge else 1):
        prefix = (config.prefix_merged, config.prefix_read1, config.prefix_read2)[i]
        if prefix:
            out = out.withColumn(f"header{i}", bases.add_prefix(f"header{i}", prefix))
        # A merged read ends with the 5' end of mate 2.
        n5, n3 = (config.post_trim5p[0], config.post_trim5p[1]) if i == 0 else (config.post_trim5p[i - 1], config.post_trim3p[i - 1])
        out = trim.fixed(out, n5, n3, seq, qual, prefix=f"post{i}")
        if i:
            out = trim.polyx(out, config.post_trim_polyx.upper(), config.trim_polyx_threshold, seq, qual, prefix=f"post_polyx{i}")
        strategy = "none" if i == 0 and config.preserve5p else config.quality_trimming
        out = trim.quality(out, strategy, config.preserve5p, config.trim_mott_rate, config.trim_windows, config.trim_min_quality, seq=seq, qual=qual, prefix=f"quality{i}")
        events = [(F.col(f"{e}{i}_5p"), F.col(f"{e}{i}_3p")) for e in ("post", "quality")]
        if i:
            touched = [F.when(n5 + n3 > 0, 1).otherwise(0) for n5, n3 in events]
        else:
            fixed = trim.merged_sources(*events[0], F.col("own1"), F.col("own2"))
            touched = [fixed["reads"], trim.merged_sources(*events[1], fixed["unique1"], fixed["unique2"])["reads"]]
        out = out.withColumns({f"trimmed_reads{i}": touched[0], f"quality_reads{i}": touched[1]})
        if i == 0 and config.normalize_orientation and "orientation" in reads.columns:
            out = demux.normalize_orientation(out, seq, qual)
        out = out.withColumn(f"fail{i}", _reason(seq, qual, config))
    t1, t2 = routing.pair_types(F.col("fail1").isNull(), F.col("fail2").isNull())

    def read(i: int, kind: Column, before: Column, sources: int) -> Column:
        counts = [(F.col(c) if i == 0 else F.lit(0)).alias(c) for c in ("mm_resolved", "mm_unresolved", "ns_resolved")]
        return F.struct(
            F.lit(i).alias("mate"), F.col(f"header{i}").alias("header"), F.col(f"seq{i}").alias("seq"), F.col(f"qual{i}").alias("qual"), F.col(f"quality{i}_5p").alias("quality_5p"),
            F.col(f"quality{i}_3p").alias("quality_3p"), F.col(f"fail{i}").alias("fail_reason"), kind.alias("read_type"), (before - F.length(f"seq{i}")).alias("total_trimmed"),
            F.lit(sources).alias("n_sources"), F.col(f"trimmed_reads{i}").alias("trimmed_reads"), F.col(f"quality_reads{i}").alias("quality_reads"), *counts)

    reads_out = F.array(read(1, t1, F.col("in1"), 1), read(2, t2, F.col("in2"), 1))
    if config.merge:
        merged = read(0, routing.merged_type(F.col("fail0").isNull()), F.col("in1") + F.col("in2"), 2)
        reads_out = F.when(mergeable, F.array(merged)).otherwise(reads_out)
    done = out.select(*common, F.explode(reads_out).alias("m")).select(*common, "m.*")
    done = done.withColumn("header", written_header("header", config, separator))
    return done.withColumn("file", routing.file_of("read_type"))


def demultiplexed(reads: DataFrame, config: Config) -> DataFrame:
    """Reads with their sample, barcodes cut off; columns seq or seq1 and seq2."""
    config = config.resolved()
    paired = "seq1" in reads.columns
    barcodes = demux.oriented(list(config.barcodes), config.barcode_orientation)
    demux.validate(barcodes, config.multiple_barcodes or config.barcode_orientation != "unspecified", paired)
    columns = [("seq1", "qual1"), ("seq2", "qual2")] if paired else [("seq", "qual")]
    out = demux.demultiplex(reads, barcodes, columns[0][0], "seq2" if paired and barcodes[0].bc2 else None, config.barcode_mm, config.barcode_mm_r1, config.barcode_mm_r2)
    return demux.remove_barcodes(out, barcodes, columns)


def demultiplex_only(reads: DataFrame, config: Config) -> DataFrame:
    """No trimming and no filters: prefixes, and the barcodes in the header."""
    out = demultiplexed(reads, config)
    barcodes = demux.oriented(list(config.barcodes), config.barcode_orientation)
    for i, header in enumerate(c for c in ("header", "header1", "header2") if c in out.columns):
        prefix = (config.prefix_read1, config.prefix_read2)[min(i, 1)]
        text = bases.add_prefix(header, prefix) if prefix else F.col(header)
        out = out.withColumn(header, demux.barcode_comment(text, barcodes))
    return out


def step_counts(done: DataFrame) -> DataFrame:
    """Rows (step, reads, bases) of a single-end run, all from one aggregation."""
    def one(name: str, n: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), F.sum(F.when(n > 0, 1).otherwise(0)).alias("reads"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("bases"))

    steps = {"terminal_pre": F.col("pre_5p") + F.col("pre_3p"), "polyx_pre": F.col("pre_polyx_n"), "adapters": F.col("adapter_bp"),
             "terminal_post": F.col("post_5p") + F.col("post_3p"), "polyx_post": F.col("post_polyx_n"), "low_quality": F.col("quality_5p") + F.col("quality_3p"),
             "total": F.col("total_trimmed")}
    return done.agg(F.array(*[one(k, v) for k, v in steps.items()]).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def paired_counts(done: DataFrame) -> DataFrame:
    """Rows (step, reads, bases) of a paired-end run: low quality, total, merged, and by mismatch and N."""
    def one(name: str, reads: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), F.coalesce(F.sum(reads), F.lit(0)).cast("long").alias("reads"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("bases"))

    low = F.col("quality_5p") + F.col("quality_3p")
    merged, zero = F.when(F.col("mate") == 0, 2).otherwise(0), F.lit(0)
    one_of = F.when(F.col("mate") != 2, 1).otherwise(0)
    rows = [one("adapters", F.col("adapter_reads") * one_of, F.col("adapter_bp") * one_of), one("low_quality", F.col("quality_reads"), low),
            one("total", F.when(F.col("mate") == 0, 2).when(F.col("total_trimmed") > 0, 1).otherwise(0), F.col("total_trimmed")),
            one("merged", merged, F.when(F.col("mate") == 0, F.length("seq")).otherwise(0)), one("mismatches_resolved", zero, F.col("mm_resolved")),
            one("mismatches_unresolved", zero, F.col("mm_unresolved")), one("ns_resolved", zero, F.col("ns_resolved"))]
    return done.agg(F.array(*rows).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def report_only(reads: DataFrame) -> dict[str, DataFrame]:
    """What is said about mates without changing them: insert sizes, consensus adapters and their k-mers, counts."""
    aligned = align.fragments(align.paired(reads, [("", "")]))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return {
        "insert_sizes": aligned.where("aln_type = 'mergeable'").groupBy("insert_size").agg(F.count(F.lit(1)).alias("n")),
        "consensus1": stats.consensus(aligned, "fragment1"), "consensus2": stats.consensus(aligned, "fragment2"),
        "kmers1": stats.top_kmers(aligned, "fragment1"), "kmers2": stats.top_kmers(aligned, "fragment2"),
        "pairs": aligned.agg(F.count(F.lit(1)).alias("pairs"), one(F.col("aln_type") != "bad").alias("aligned"),
                             one((F.col("fragment1") != "") | (F.col("fragment2") != "")).alias("with_adapters")),
    }


def head(reads: DataFrame, config: Config) -> DataFrame:
    return reads if config.head is None else fastq.head(reads, config.head)
