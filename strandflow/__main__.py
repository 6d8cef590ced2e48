"""python -m strandflow: a run from FASTQ files to trimmed reads and reports.

Options carry the names of the Config fields.  Outputs are folders of part files named prefix[.sample].file.extension.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.config import Config, ConfigError
from strandflow.operators import filters, routing, stats
from strandflow.plans import pipeline
from strandflow.sources import adapters, fastq, writers

log = logging.getLogger("strandflow")

#: Options that are Config fields as they stand, with the type of their value; bool makes a flag.
PLAIN = {
    "quality_format": str, "mate_separator": str, "normalize_mate_separator": str, "mask_degenerate_bases": bool, "convert_uracils": bool, "adapter_selection": str,
    "adapter_fallback": str, "min_overlap": int, "mismatch_rate": float, "shift": int, "merge": bool, "merge_threshold": int, "merge_strategy": str,
    "merge_quality_max": int, "prefix_read1": str, "prefix_read2": str, "prefix_merged": str, "quality_trimming": str, "trim_mott_rate": float, "trim_windows": float,
    "trim_min_quality": int, "pre_trim_polyx": str, "post_trim_polyx": str, "trim_polyx_threshold": int, "preserve5p": bool, "max_ns": int, "max_ns_fraction": float,
    "min_length": int, "max_length": int, "min_mean_quality": float, "min_complexity": float, "multiple_barcodes": bool, "barcode_orientation": str,
    "normalize_orientation": bool, "barcode_mm": int, "barcode_mm_r1": int, "barcode_mm_r2": int, "demultiplex_only": bool, "report_only": bool,
    "report_sample_rate": float, "report_title": str, "out_prefix": str, "out_format": str,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandflow", description="Trim, merge, filter and demultiplex reads on Spark.")
    defaults = {f.name: f.default for f in fields(Config)}
    p.add_argument("--in-file1", nargs="+", required=True, metavar="FILE")
    p.add_argument("--in-file2", nargs="+", metavar="FILE")
    p.add_argument("--interleaved-input", action="store_true")
    p.add_argument("--head", type=fastq.parse_count, help="the first reads or pairs; K, M and G are understood")
    p.add_argument("--adapter1")
    p.add_argument("--adapter2", default="")
    p.add_argument("--adapter-table", metavar="FILE")
    p.add_argument("--adapter-database", choices=("tsv", "json"), help="print the known adapters and stop")
    p.add_argument("--barcode-table", metavar="FILE")
    p.add_argument("--report-duplication", nargs="?", type=fastq.parse_count, const=100_000)
    p.add_argument("--read-group", default="")
    p.add_argument("--out-json", metavar="FILE")
    p.add_argument("--out-html", metavar="FILE")
    p.add_argument("--threads", type=int, default=2)
    for name in ("pre_trim3p", "post_trim5p", "post_trim3p"):
        p.add_argument(f"--{name.replace('_', '-')}", nargs="+", type=int, default=[0], help="one amount, or one for each mate")
    for name, kind in PLAIN.items():
        flag = f"--{name.replace('_', '-')}"
        if kind is bool:
            p.add_argument(flag, action="store_true")
        else:
            p.add_argument(flag, type=kind, default=defaults[name], help=f"default: {defaults[name]}")
    return p


def check_paths(inputs: list[str], outputs: list[str]) -> None:
    """Inputs can be read and occur once; outputs are new and differ by more than case.  Paths with a scheme are left to Spark."""
    for path in inputs:
        if "://" not in path and not os.access(path, os.R_OK):
            raise ConfigError(f"can't read {path}")
    real = [os.path.realpath(p) for p in inputs]
    if len(set(real)) < len(real):
        raise ConfigError("an input file is given twice")
    spelled: dict[str, str] = {}
    for path in outputs:
        if os.path.realpath(path) in real:
            raise ConfigError(f"{path} is an input")
        if spelled.setdefault(path.lower(), path) != path:
            raise ConfigError(f"outputs differ by case only: {path}")


def read_input(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Single reads (read_id, header, seq, qual) or pairs with 1 and 2 at the names."""
    first = fastq.read_fastq(spark, args.in_file1)
    if args.interleaved_input:
        pairs = fastq.deinterleave(first)
    elif args.in_file2:
        if len(args.in_file1) != len(args.in_file2):
            raise ConfigError("as many files of mate 2 as of mate 1 are needed")
        pairs = fastq.pair_files(first, fastq.read_fastq(spark, args.in_file2))
    else:
        reads = first if args.head is None else fastq.head(first, args.head)
        return reads.select(F.col("read_idx").alias("read_id"), "header", "seq", "qual")
    pairs = pairs if args.head is None else fastq.head(pairs, args.head)
    return pairs.select(F.col("read_idx").alias("read_id"), *[F.col(f"r{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("header", "seq", "qual")])


def configure(spark: SparkSession, args: argparse.Namespace) -> Config:
    values = {k: getattr(args, k) for k in PLAIN}
    for name in ("pre_trim3p", "post_trim5p", "post_trim3p"):
        amounts = getattr(args, name)
        if len(amounts) > 2:
            raise ConfigError(f"{name}: one or two amounts")
        values[name] = (amounts[0], amounts[-1])
    paired = bool(args.in_file2) or args.interleaved_input
    if args.adapter_table:
        rows = adapters.adapter_table(adapters.read_lines(spark, args.adapter_table), paired).orderBy("adapter_id").collect()
        values["adapters"] = tuple((r["a1"], r["a2"]) for r in rows)
    elif args.adapter1:
        values["adapters"] = ((args.adapter1.upper(), args.adapter2.upper()),)
    if args.barcode_table:
        values["barcodes"] = tuple(adapters.barcode_table(adapters.read_lines(spark, args.barcode_table)))
    return Config(paired=paired, head=args.head, read_group=writers.read_group(args.read_group) if args.read_group else {}, **values).resolved()


def groups_of(config: Config, samples: list[str]) -> dict[str, dict[str, str]]:
    """The read group of each sample, the whole run's under an empty name."""
    if not config.read_group:
        return {}
    text = "\t".join(f"{k}:{v}" for k, v in config.read_group.items())
    codes = {b.sample: (b.bc1, b.bc2) for b in config.barcodes if sum(x.sample == b.sample for x in config.barcodes) == 1}
    return {"": config.read_group, **{s: writers.read_group(text, s, codes.get(s, ("", ""))) for s in samples}}


def write_output(done: DataFrame, config: Config) -> list[str]:
    """Reads with sample (null for a run without barcodes), read_type and file -> folders prefix[.sample].file.extension.

    The run is written once, in folders by sample and file, which then get their names.  Discarded reads go to SAM and BAM only.
    """
    spark, extension = done.sparkSession, "." + config.out_format
    samples = sorted({b.sample for b in config.barcodes})
    groups = groups_of(config, samples)
    separator = config.mate_separator or "/"
    where = f"{config.out_prefix}.parts"
    sample = F.coalesce("sample", F.lit("")) if "sample" in done.columns else F.lit("")
    if extension.startswith((".bam", ".ubam")):
        out = []
        for name in [*samples, "unidentified"] if config.barcodes else [""]:
            path = routing.output_name(config.out_prefix, name or None, "mate_1", extension)
            group = groups.get(name, {})
            writers.write_bam(done.where(sample == name), path, writers.sam_header([group] if group else [], " ".join(sys.argv)), separator, group.get("ID"))
            out.append(path)
        return out
    alignments = extension.startswith(".sam")
    ids = F.create_map(*[F.lit(x) for k, g in groups.items() for x in (k, g["ID"])])[sample] if groups else None
    text = routing.sam_text(separator=separator, read_group=ids) if alignments else None
    kept = done.withColumn("out_sample", sample).withColumn("out_file", F.lit("mate_1") if alignments else F.col("file"))
    kept = kept if alignments else kept.where("out_file <> 'discarded'")
    writers.write_fastq(kept, where, ["out_sample", "out_file"], extension.endswith(".gz"), "read_id", text)
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(where)
    files, out = top.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for own in files.listStatus(top):
        if own.isDirectory():
            name = own.getPath().getName().partition("=")[2]
            name = "" if name == "__HIVE_DEFAULT_PARTITION__" else name
            for part in files.listStatus(own.getPath()):
                path = routing.output_name(config.out_prefix, name or None, part.getPath().getName().partition("=")[2], extension)
                files.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(path))
                out.append(path)
    files.delete(top, True)
    if alignments:
        # The header is a file of its own, read before the parts of the folder.
        for path in out:
            name = path.removeprefix(config.out_prefix).removesuffix(extension).strip(".")
            header = writers.sam_header([groups[name]] if name in groups else [], " ".join(sys.argv))
            stream = files.create(jvm.org.apache.hadoop.fs.Path(f"{path}/header.sam"))
            stream.write(bytearray(("\n".join(header) + "\n").encode()))
            stream.close()
    return sorted(out)


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The run itself; returns the report."""
    config = configure(spark, args)
    reads = read_input(spark, args)
    paired = config.paired
    if paired and config.mate_separator is None:
        found = fastq.mate_separator(reads.withColumnRenamed("read_id", "read_idx"))
        bad = fastq.pair_violations(reads, found).select("header1", "header2", "reason").head(1)
        if bad:
            raise ConfigError(f"{bad[0]['reason']}: {bad[0]['header1']} and {bad[0]['header2']}")
        config = replace(config, mate_separator=found)
    sides = ("1", "2") if paired else ("",)
    inputs = {f"read{s or 1}": reads.select("read_id", F.col(f"seq{s}").alias("seq"), F.col(f"qual{s}").alias("qual")) for s in sides}
    sampled = {k: stats.sampled(v, config.report_sample_rate) for k, v in inputs.items()}
    duplication = stats.duplication(inputs["read1"], args.report_duplication) if args.report_duplication else None
    if config.report_only:
        sizes = pipeline.report_only(reads)["insert_sizes"] if paired else None
        return writers.json_report(config.report_title, sampled, None, duplication=duplication, insert_sizes=sizes)
    steps = sizes = None
    process = pipeline.process_paired if paired else pipeline.process_single
    if config.barcodes:
        split = pipeline.demultiplex_only(reads, config) if config.demultiplex_only else pipeline.demultiplexed(reads, config)
        loose = split if config.demultiplex_only else split.where("sample is null")
        mates = [loose.select(F.coalesce("sample", F.lit("unidentified")).alias("sample"), "read_id", F.col(f"header{s}").alias("header"), F.col(f"seq{s}").alias("seq"), F.col(f"qual{s}").alias("qual"),
                              F.lit(f"pe_{s}" if s else "se").alias("read_type"), F.lit(f"mate_{s or 1}").alias("file")) for s in sides]
        done = mates[0] if len(mates) == 1 else mates[0].unionByName(mates[1])
        if not config.demultiplex_only:
            # Outputs, counters and reports read what is processed once.
            known = process(split.where("sample is not null"), config).persist()
            steps = pipeline.paired_counts(known) if paired else pipeline.step_counts(known)
            done = known.select(*done.columns).unionByName(done)
    else:
        known = done = process(reads, config).persist()
        steps = pipeline.paired_counts(done) if paired else pipeline.step_counts(done)
    if paired and steps is not None:
        sizes = known.where("aln_type = 'mergeable' and mate <> 2").groupBy("insert_size").agg(F.count(F.lit(1)).alias("n"))
    passed = stats.sampled(done.where("file <> 'discarded'"), config.report_sample_rate)
    names = [*sorted({b.sample for b in config.barcodes}), "unidentified"] if config.barcodes else ["all"]
    outputs = {n: (passed.where(F.col("sample") == n) if config.barcodes else passed).select("read_id", "seq", "qual") for n in names}
    if config.out_prefix:
        for path in write_output(done, config):
            log.info("wrote %s", path)
    details = run_details(known, paired) if steps is not None else None
    report = writers.json_report(config.report_title, sampled, outputs, steps, duplication, sizes, details)
    if steps is not None:
        known.unpersist()
    return report


def run_details(known: DataFrame, paired: bool) -> dict[str, DataFrame]:
    """Filters, adapters by their number, and poly-X tails by base: bounded tables of a run."""
    once = known.where("mate <> 2") if paired else known
    tails = [F.struct(F.lit(when).alias("when"), F.col(f"{when}_polyx{i}_base").alias("base"), F.col(f"{when}_polyx{i}_n").alias("n"))
             for when in ("pre", "post") for i in (("1", "2") if paired else ("",)) if f"{when}_polyx{i}_base" in known.columns]
    polyx = once.select(F.explode(F.array(*tails)).alias("t")).select("t.*").where("n > 0")
    return {
        "filters": filters.filter_counts(known, weight=F.col("n_sources") if paired else 1),
        "adapters": once.where("adapter_bp > 0").groupBy(F.col("aln.adapter_id").alias("adapter_id")).agg(F.count(F.lit(1)).alias("reads"), F.sum("adapter_bp").alias("bases")),
        "polyx": polyx.groupBy("when", "base").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("bases")),
    }


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    argv = sys.argv[1:] if argv is None else argv
    if "--adapter-database" in argv:
        from strandflow.sources.adapters import KNOWN_ADAPTERS

        for name, a, b in sorted(KNOWN_ADAPTERS):
            print(name, ",".join(a), ",".join(b), sep="\t")
        return 0
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.threads}]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        check_paths([*args.in_file1, *(args.in_file2 or [])], [p for p in (args.out_json, args.out_html) if p])
        report = run(spark, args)
    except ConfigError as e:
        log.error("%s", e)
        return 1
    writers.write_report(report, args.out_json, args.out_html)
    return 0


if __name__ == "__main__":
    sys.exit(main())
