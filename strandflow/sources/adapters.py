"""The known adapters and the tables of adapters and barcodes that users write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators.demux import Barcode

#: Name, first adapters, second adapters; without second adapters the first are in both mates.  Fixed values.
KNOWN_ADAPTERS = [
    ("Illumina TruSeq", ["AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"], ["AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"]),
    ("Illumina AmpliSeq", ["CTGTCTCTTATACACATCT"], []),
    ("Illumina DNA PCR-Free Prep, Tagmentation", ["CTGTCTCTTATACACATCT", "ATGTGTATAAGAGACA"], []),
    ("Illumina ScriptSeq", ["AGATCGGAAGAGCACACGTCTGAAC"], ["AGATCGGAAGAGCGTCGTGTAGGGA"]),
    ("Illumina TruSeq Small RNA", ["TGGAATTCTCGGGTGCCAAGG"], []),
    ("Illumina Nextera Mate Pair", ["CTGTCTCTTATACACATCT", "AGATGTGTATAAGAGACAG"], []),
    ("Illumina Stranded mRNA", ["ACTGTCTCTTATACACATCT"], []),
    ("Illumina TruSeq Ribo Profile", ["AGATCGGAAGAGCACACGTCT"], []),
    ("Illumina MiSeq", ["TGGAATTCTCGGGTGCCAAGGC"], []),
    ("MGI Tech DNBSEQ", ["AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA"], ["AAGTCGGATCGTAGCCATGTCGTTCTGTGAGCCAAGGAGTTG"]),
    ("QIAGEN QIAseq miRNA", ["AACTGTAGGCACCATCAAT"], []),
    ("Life Technologies SOLiD small RNA", ["CGCCTTGGCCGTACAGCAG"], []),
    ("Diagenode CATS small RNA-seq Kit", ["GATCGGAAGAGCACACGTCTG"], []),
    ("Lexogen Small RNA-Seq", ["TGGAATTCTCGGGTGCCAAGGAACTCCAGTCAC"], []),
]


def known_adapters(spark: SparkSession, user: list[tuple[str, list[str], list[str]]] = ()) -> DataFrame:
    """Rows (name, adapter1, adapter2, user)."""
    rows = [(n, a, b, False) for n, a, b in KNOWN_ADAPTERS] + [(n, a, b, True) for n, a, b in user]
    return spark.createDataFrame(rows, "name string, adapter1 array<string>, adapter2 array<string>, user boolean")


def export_tsv(adapters: DataFrame) -> DataFrame:
    """Lines (name, line) in the order of names: name, first adapters, second adapters."""
    line = F.concat_ws("\t", "name", F.array_join("adapter1", ","), F.array_join("adapter2", ","))
    return adapters.select("name", line.alias("line")).orderBy("name")


def export_json(adapters: DataFrame) -> str:
    rows = adapters.orderBy("name").collect()
    return json.dumps({r["name"]: {"adapter1": r["adapter1"], "adapter2": r["adapter2"] or None} for r in rows}, indent=2)


def table_rows(lines: DataFrame, least: int, most: int) -> DataFrame:
    """Rows (line_no, fields) of white-space separated text with # comments; a wrong or varying width raises an error."""
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "))
    rows = lines.select("line_no", F.split(text, " ").alias("fields")).where("fields[0] <> ''")
    n = F.size("fields")
    checked = F.when((n >= least) & (n <= most), F.col("fields")).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of columns in line "), F.col("line_no").cast("string"))).cast("array<string>"))
    return rows.select("line_no", checked.alias("fields"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def adapter_table(lines: DataFrame, paired: bool = True) -> DataFrame:
    """Rows (adapter_id, a1, a2) of a table of one or two columns, two for mates, upper case."""
    rows = table_rows(lines, 2 if paired else 1, 2)
    first, second = (F.upper(F.get("fields", F.lit(i))) for i in (0, 1))
    return rows.select(F.col("line_no").alias("adapter_id"), first.alias("a1"), F.coalesce(second, F.lit("")).alias("a2"))


def duplicate_adapters(adapters: DataFrame) -> DataFrame:
    """Pairs that occur more than once, with their number."""
    return adapters.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def barcode_table(lines: DataFrame) -> list[Barcode]:
    """The barcodes of a table of two to four columns, by sample; it is a few rows a sample, so the driver holds it."""
    rows = table_rows(lines, 2, 4).orderBy("line_no").collect()
    widths = {len(r["fields"]) for r in rows}
    if len(widths) > 1:
        raise ValueError("rows of a table differ in their number of columns")
    out = []
    for r in rows:
        name, bc1, bc2, way = (*r["fields"], "", "")[:4] if len(r["fields"]) < 4 else r["fields"]
        way = {"+": "forward", "fwd": "forward", "-": "reverse", "rev": "reverse"}.get(way.lower(), way.lower()) or "unspecified"
        if way not in ("forward", "reverse", "unspecified"):
            raise ValueError(f"unknown orientation {way!r}")
        out.append(Barcode(name, bc1.upper(), bc2.upper(), way))
    return sorted(out, key=lambda b: b.sample)
