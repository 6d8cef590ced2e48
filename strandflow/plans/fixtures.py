"""Reads derived from documents, for queries over tables that hold none; each recipe in DataFrame functions and in SQL.

The letters of a text, upper-cased, are cut into pieces.  One translation makes bases of them, another qualities.  A fragment of
a length that depends on document and piece is followed by an adapter and by As.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.bases import reverse_complement
from strandflow.operators.demux import Barcode

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTANGTACGTACGTAC"
QUALITIES = "".join(chr(33 + (7 * i) % 41) for i in range(26)).replace("'", "K")
ADAPTER1, ADAPTER2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
SE_LENGTH, PE_PIECE, PE_LENGTH = 60, 150, 100

BARCODES_SE = [Barcode("alpha", "ACGTAC"), Barcode("beta", "ACGTAA"), Barcode("gamma", "GTACGT"), Barcode("delta", "TTGACA")]
BARCODES_PE = [Barcode("alpha", "ACGTAC", "GTACGT", "forward"), Barcode("alpha", "ACGTAC", "TTGACA", "reverse"), Barcode("beta", "ACGTAA", "CCATGG"),
               Barcode("gamma", "GTACGT", "GTACGT"), Barcode("delta", "TTGACA", "ACGTAC")]


#: Bytes of files that are one task, so that tasks grow in number and not in size.
TASK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large files are dealt out again, so that one file isn't one task, nor a share of all files that grows with them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.select("doc_id", "text").repartition(max(spark.sparkContext.defaultParallelism, 8, -(-size // TASK_BYTES)), "doc_id")


def _pieces(docs: DataFrame, size: int) -> DataFrame:
    """Texts are cut in one pass, and only the pieces go on: with the text beside each of them, a row for every piece holds it whole, and
    so does all that waits for a Python function, which grows with the square of a text's length."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", ""))
    cut = F.posexplode(F.regexp_extract_all(letters, F.lit(f".{{{size}}}"), 0)).alias("piece", "l")
    return docs.select("doc_id", cut).select("doc_id", F.col("piece").cast("long").alias("piece"), "l")


def reads_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(documents(spark, sf_dir), SE_LENGTH).withColumn("flen", (37 * F.col("doc_id") + 53 * F.col("piece")) % 61)
    fragment = F.substr(F.translate("l", LETTERS, BASES), F.lit(1), F.col("flen").cast("int"))
    seq = F.substring(F.concat(fragment, F.lit(ADAPTER1 + "A" * SE_LENGTH)), 1, SE_LENGTH)
    header = F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("_"), F.col("piece").cast("string"), F.lit(" len="), F.col("flen").cast("string"))
    return p.select((F.col("doc_id") * 100000 + F.col("piece")).alias("read_id"), header.alias("header"), seq.alias("seq"),
                    F.translate("l", LETTERS, QUALITIES).alias("qual"))


SQL_PIECES = """
letters AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS letters FROM documents),
pieces AS (SELECT doc_id, unnest(range(0, length(letters) // {size})) AS piece, letters FROM letters WHERE length(letters) >= {size}),
fx_l AS (SELECT doc_id, piece, substr(letters, piece * {size} + 1, {size}) AS l FROM pieces)"""
_B, _Q = f"translate(l, '{LETTERS}', '{BASES}')", f"translate(l, '{LETTERS}', '{QUALITIES}')"
SQL_SE = SQL_PIECES.format(size=SE_LENGTH) + f""",
fx_f AS (SELECT *, (37 * doc_id + 53 * piece) % 61 AS flen FROM fx_l),
reads_se AS (SELECT doc_id * 100000 + piece AS read_id, '@' || doc_id || '_' || piece || ' len=' || flen AS header,
                    substr(substr({_B}, 1, flen) || '{ADAPTER1}' || repeat('A', {SE_LENGTH}), 1, {SE_LENGTH}) AS seq, {_Q} AS qual FROM fx_f)"""


def reads_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates of one fragment; every third pair has a C at one place of mate 2, which makes mismatches."""
    p = _pieces(documents(spark, sf_dir), PE_PIECE).withColumn("flen", 30 + (37 * F.col("doc_id") + 53 * F.col("piece")) % 121)
    fragment = F.substr(F.translate("l", LETTERS, BASES), F.lit(1), F.col("flen").cast("int"))
    p = p.withColumns({"fragment": fragment, "q": F.translate("l", LETTERS, QUALITIES)})
    seq1 = F.substring(F.concat("fragment", F.lit(ADAPTER1 + "A" * PE_LENGTH)), 1, PE_LENGTH)
    seq2 = F.substring(F.concat(reverse_complement("fragment"), F.lit(ADAPTER2 + "A" * PE_LENGTH)), 1, PE_LENGTH)
    p = p.withColumns({"s2": seq2, "at": (7 * F.col("doc_id") + 11 * F.col("piece")) % 20})
    changed = F.concat(F.substr("s2", F.lit(1), F.col("at").cast("int")), F.lit("C"), F.substr("s2", F.col("at").cast("int") + 2))
    seq2 = F.when((F.col("doc_id") + F.col("piece")) % 3 == 0, changed).otherwise(F.col("s2"))
    name = F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("_"), F.col("piece").cast("string"))
    return p.select((F.col("doc_id") * 100000 + F.col("piece")).alias("read_id"), F.col("flen").cast("int").alias("flen"),
                    F.concat(name, F.lit("/1")).alias("header1"), seq1.alias("seq1"), F.substring("q", 1, PE_LENGTH).alias("qual1"),
                    F.concat(name, F.lit("/2 x")).alias("header2"), seq2.alias("seq2"), F.substring(F.reverse("q"), 1, PE_LENGTH).alias("qual2"))


SQL_PE = SQL_PIECES.format(size=PE_PIECE) + f""",
fx_f AS (SELECT *, 30 + (37 * doc_id + 53 * piece) % 121 AS flen, (7 * doc_id + 11 * piece) % 20 AS spot, {_Q} AS q, {_B} AS b FROM fx_l),
fx_g AS (SELECT *, substr(b, 1, flen) AS fragment FROM fx_f),
fx_h AS (SELECT *, substr(reverse(translate(fragment, 'ACGT', 'TGCA')) || '{ADAPTER2}' || repeat('A', {PE_LENGTH}), 1, {PE_LENGTH}) AS s2 FROM fx_g),
reads_pe AS (SELECT doc_id * 100000 + piece AS read_id, flen::INT AS flen, '@' || doc_id || '_' || piece || '/1' AS header1,
                    substr(fragment || '{ADAPTER1}' || repeat('A', {PE_LENGTH}), 1, {PE_LENGTH}) AS seq1, substr(q, 1, {PE_LENGTH}) AS qual1,
                    '@' || doc_id || '_' || piece || '/2 x' AS header2,
                    CASE WHEN (doc_id + piece) % 3 = 0 THEN substr(s2, 1, spot) || 'C' || substr(s2, spot + 2) ELSE s2 END AS seq2,
                    substr(reverse(q), 1, {PE_LENGTH}) AS qual2 FROM fx_h)"""


def _barcode_case(barcodes: list[Barcode], field: str, at: str, sql: bool):
    values = [getattr(b, field) for b in barcodes]
    if sql:
        return "CASE " + " ".join(f"WHEN {at} % {len(values) + 1} = {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE '{'A' * len(values[0])}' END"
    out = F.lit("A" * len(values[0]))
    for i, v in enumerate(values):
        out = F.when(F.expr(at) % (len(values) + 1) == i, v).otherwise(out)
    return out


#: Every seventh read has its third barcode base replaced.
_BREAK = "CASE WHEN {at} % 7 = 0 THEN substr({bc}, 1, 2) || 'T' || substr({bc}, 4) ELSE {bc} END"


def barcoded_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_se(spark, sf_dir).withColumn("bc", _barcode_case(BARCODES_SE, "bc1", "read_id", False))
    reads = reads.withColumn("bc", F.expr(_BREAK.format(at="read_id", bc="bc")))
    return reads.withColumns({"seq": F.concat("bc", "seq"), "qual": F.concat(F.lit("IIIIII"), "qual")}).drop("bc")


SQL_BARCODED_SE = SQL_SE + f""",
bc0 AS (SELECT *, {_barcode_case(BARCODES_SE, 'bc1', 'read_id', True)} AS bc FROM reads_se),
barcoded_se AS (SELECT read_id, header, ({_BREAK.format(at='read_id', bc='bc')}) || seq AS seq, 'IIIIII' || qual AS qual FROM bc0)"""


def barcoded_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_pe(spark, sf_dir).withColumns({"b1": _barcode_case(BARCODES_PE, "bc1", "read_id", False), "b2": _barcode_case(BARCODES_PE, "bc2", "read_id", False)})
    reads = reads.withColumns({"b1": F.expr(_BREAK.format(at="read_id", bc="b1")), "b2": F.expr(_BREAK.format(at="(read_id + 3)", bc="b2"))})
    return reads.withColumns({"seq1": F.concat("b1", "seq1"), "qual1": F.concat(F.lit("IIIIII"), "qual1"), "seq2": F.concat("b2", "seq2"),
                              "qual2": F.concat(F.lit("IIIIII"), "qual2")}).drop("b1", "b2")


SQL_BARCODED_PE = SQL_PE + f""",
bc0 AS (SELECT *, {_barcode_case(BARCODES_PE, 'bc1', 'read_id', True)} AS b1, {_barcode_case(BARCODES_PE, 'bc2', 'read_id', True)} AS b2 FROM reads_pe),
barcoded_pe AS (SELECT read_id, flen, header1, ({_BREAK.format(at='read_id', bc='b1')}) || seq1 AS seq1, 'IIIIII' || qual1 AS qual1, header2,
                       ({_BREAK.format(at='(read_id + 3)', bc='b2')}) || seq2 AS seq2, 'IIIIII' || qual2 AS qual2 FROM bc0)"""


def fastq_lines(spark: SparkSession, sf_dir: str, files: int = 2) -> DataFrame:
    """reads_se as lines (file_ord, line_no, value) of several files; lines of the second end with a carriage return."""
    reads = reads_se(spark, sf_dir).withColumns({"file_ord": (F.col("read_id") % files).cast("int"), "rec": F.col("read_id")})
    four = F.array("header", "seq", F.lit("+"), "qual")
    lines = reads.select("file_ord", "rec", F.posexplode(four).alias("part", "value"))
    return lines.select("file_ord", (F.col("rec") * 4 + F.col("part")).alias("line_no"),
                        F.when(F.col("file_ord") == 1, F.concat("value", F.lit("\r"))).otherwise(F.col("value")).alias("value"))
