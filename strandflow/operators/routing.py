"""Read types, their files, and how records are written in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.bases import normalize_mate, read_name, valid_sam_name

#: Flags of unaligned records by read type.  Fixed values.
SAM_FLAGS = {"se": 4, "merged": 4, "se_fail": 516, "merged_fail": 516, "pe_1": 77, "singleton_1": 77, "pe_1_fail": 589, "pe_2": 141, "singleton_2": 141,
             "pe_2_fail": 653}
FILES = {"se": "mate_1", "pe_1": "mate_1", "pe_2": "mate_2", "merged": "merged", "singleton_1": "singleton", "singleton_2": "singleton",
         "se_fail": "discarded", "pe_1_fail": "discarded", "pe_2_fail": "discarded", "merged_fail": "discarded"}
#: Ends of file names by file.
SUFFIXES = {"mate_1": "r1", "mate_2": "r2", "merged": "merged", "singleton": "singleton", "discarded": "discarded"}


def _by_name(column: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column]


def single_type(passed: Column) -> Column:
    return F.when(passed, "se").otherwise("se_fail")


def merged_type(passed: Column) -> Column:
    return F.when(passed, "merged").otherwise("merged_fail")


def pair_types(passed1: Column, passed2: Column) -> tuple[Column, Column]:
    """Mates that pass alone are singletons; their failed mate keeps the type of its side."""
    first = F.when(passed1 & passed2, "pe_1").when(passed1, "singleton_1").otherwise("pe_1_fail")
    second = F.when(passed1 & passed2, "pe_2").when(passed2, "singleton_2").otherwise("pe_2_fail")
    return first, second


def file_of(read_type: Column | str) -> Column:
    return _by_name(F.col(read_type) if isinstance(read_type, str) else read_type, FILES)


def mate_number(read_type: str) -> str:
    return "" if read_type.startswith("merged") else "2" if "_2" in read_type else "1"


def output_header(header: str, read_type: str, separator_in: str, separator_out: str) -> Column:
    """The header as it is written: unchanged, or with its mate separator normalized."""
    if separator_in == separator_out:
        return F.col(header)
    out = F.col(header)
    for mate in ("1", "2", ""):
        kinds = [t for t in FILES if mate_number(t) == mate]
        text = normalize_mate(header, mate, separator_in, separator_out if mate else "")
        if not mate:
            parts = read_name(header, separator_in)
            kept = normalize_mate(header, "", separator_in, separator_out)
            text = F.when(parts["mate"] != "", kept).otherwise(text)
        out = F.when(F.col(read_type).isin(kinds), text).otherwise(out)
    return out


def fastq_text(header="header", seq="seq", qual="qual") -> Column:
    return F.concat_ws("\n", header, seq, F.lit("+"), qual)


def sam_text(header="header", seq="seq", qual="qual", read_type="read_type", separator: str = "", read_group: Column | None = None) -> Column:
    """One line of an unaligned record; an empty sequence is *; a name that SAM can't hold raises an error."""
    name = read_name(header, separator)["name"]
    name = F.when(valid_sam_name(name), name).otherwise(F.raise_error(F.concat(F.lit("invalid SAM read name: "), name)).cast("string"))
    empty = F.length(seq) == 0
    fields = [name, _by_name(F.col(read_type), SAM_FLAGS).cast("string"), *[F.lit(x) for x in ("*", "0", "0", "*", "*", "0", "0")],
              F.when(empty, "*").otherwise(F.col(seq)), F.when(empty, "*").otherwise(F.col(qual))]
    if read_group is not None:
        fields.append(F.concat(F.lit("RG:Z:"), read_group))
    return F.concat_ws("\t", *fields)


def output_name(prefix: str, sample: str | None, file: str, extension: str = ".fastq.gz") -> str:
    """prefix[.sample][.file]extension; SAM and BAM hold all but the discarded reads in one file."""
    parts = [prefix] + ([sample] if sample else [])
    if not extension.startswith((".sam", ".bam", ".ubam")):
        parts.append(SUFFIXES[file])
    elif file == "discarded":
        parts.append("discarded")
    return ".".join(parts) + extension


def interleaved(frames: list[DataFrame], order: str = "read_idx") -> DataFrame:
    """Several outputs of one file in input order, mate 1 before mate 2."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(order, "mate")
