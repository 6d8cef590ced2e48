"""FASTQ: records from lines, pairing, and a data source for files."""

from __future__ import annotations

import io
import logging
import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def clean_line(value: Column | str) -> Column:
    """A line without the carriage return that some systems end it with."""
    return F.regexp_replace(value, "\r$", "")


def records(lines: DataFrame, file: str = "file_ord", line: str = "line_no") -> DataFrame:
    """Lines (file_ord, line_no, value), numbers rising by one within a record -> (file_ord, rec, header, seq, qual).

    Four lines are a record: a header that begins with @ and has a name, a sequence, a line that begins with +, and as many
    qualities as bases.  Anything else raises an error that names file and line.
    """
    text = lines.select(F.col(file).alias("file_ord"), F.col(line).alias("line_no"), clean_line("value").alias("value"))
    parts = text.groupBy("file_ord", F.floor(F.col("line_no") / 4).alias("rec")).agg(
        *[F.max(F.when(F.col("line_no") % 4 == i, F.col("value"))).alias(n) for i, n in enumerate(("header", "seq", "plus", "qual"))])
    where = F.concat(F.lit(" in file "), F.col("file_ord").cast("string"), F.lit(", record "), F.col("rec").cast("string"))

    def check(ok: Column, what: str, value: Column) -> Column:
        return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(what), where)).cast("string"))

    header = check(F.coalesce(F.col("header").rlike("^@."), F.lit(False)), "invalid header", F.col("header"))
    seq = check(F.coalesce(F.length("seq") > 0, F.lit(False)), "no nucleotides", F.col("seq"))
    qual = check(F.coalesce(F.col("plus").startswith("+"), F.lit(False)) & F.coalesce(F.length("qual") == F.length("seq"), F.lit(False)),
                 "missing separator, or qualities of another length", F.col("qual"))
    return parts.select("file_ord", "rec", header.alias("header"), seq.alias("seq"), qual.alias("qual"))


def concatenated(reads: DataFrame, order: str = "rec", first: int | None = None) -> DataFrame:
    """Files one after the other: read_idx counts all records in the order of file and record; the first so many of them, or all.

    Records are counted by blocks of a file; only the number of each block's records meets in one window.  Of the first records no more
    than the blocks that hold them are numbered.
    """
    blocks = reads.withColumn("_block", F.floor(F.col(order) / 1_000_000))
    sizes = blocks.groupBy("file_ord", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy().orderBy("file_ord", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_ord", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file_ord", "_block").orderBy(order)
    if first is not None:
        starts = starts.where(F.col("_start") < first)
        last = starts.agg(F.max(F.struct("file_ord", "_block")).alias("last")).first()["last"] or (-1, -1)
        blocks = blocks.where((F.col("file_ord") < last[0]) | (F.col("file_ord") == last[0]) & (F.col("_block") <= last[1]))
    out = blocks.join(starts, ["file_ord", "_block"])
    out = out.withColumn("read_idx", F.col("_start") + F.row_number().over(inside) - 1).drop("_block", "_start")
    return out if first is None else out.where(F.col("read_idx") < first)


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two files by their ordinal; files of different length raise an error."""
    a = first.select("read_idx", F.struct("header", "seq", "qual").alias("r1"))
    b = second.select("read_idx", F.struct("header", "seq", "qual").alias("r2"))
    both = a.join(b, "read_idx", "full")
    uneven = F.raise_error(F.lit("files of mates differ in their number of records")).cast("long")
    return both.select(F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), F.col("read_idx")).otherwise(uneven).alias("read_idx"), "r1", "r2")


def deinterleave(reads: DataFrame) -> DataFrame:
    """Records 2k and 2k + 1 are pair k; an odd number raises an error."""
    mate = F.struct("header", "seq", "qual")
    pairs = reads.groupBy(F.floor(F.col("read_idx") / 2).alias("read_idx")).agg(
        F.max(F.when(F.col("read_idx") % 2 == 0, mate)).alias("r1"), F.max(F.when(F.col("read_idx") % 2 == 1, mate)).alias("r2"))
    odd = F.raise_error(F.lit("interleaved input has an odd number of records")).cast("struct<header:string,seq:string,qual:string>")
    return pairs.select("read_idx", "r1", F.coalesce("r2", odd).alias("r2"))


def interleave(pairs: DataFrame) -> DataFrame:
    """Pairs -> records in the order they are written."""
    mates = pairs.select("read_idx", F.posexplode(F.array("r1", "r2")).alias("mate", "r"))
    return mates.select((F.col("read_idx") * 2 + F.col("mate")).alias("read_idx"), "r.header", "r.seq", "r.qual")


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads or pairs; 0 is a run over none."""
    return reads.where(F.col("read_idx") < n)


def parse_count(text: str) -> int:
    """A number with an optional suffix K, M or G."""
    text = text.strip().upper()
    scale = {"K": 10**3, "M": 10**6, "G": 10**9}.get(text[-1:], 1)
    value = float(text[:-1] if scale > 1 else text) * scale
    if value < 0 or value != int(value):
        raise ValueError(f"not a count: {text!r}")
    return int(value)


def mate_separator(pairs: DataFrame, candidates: str = "/.:", first: int = 1024) -> str:
    """The first separator with which all of the first pairs have mates 1 and 2 (or 2 and 1) and one name; else none."""
    from strandflow.functions.bases import read_name

    tests = []
    for c in candidates:
        a, b = read_name("header1", c), read_name("header2", c)
        fits = (a["name"] == b["name"]) & F.concat(a["mate"], b["mate"]).isin("12", "21")
        tests.append(F.coalesce(F.bool_and(fits), F.lit(False)).alias(f"s{candidates.index(c)}"))
    got = pairs.where(F.col("read_idx") < first).agg(*tests).first()
    return next((c for c, ok in zip(candidates, got) if ok), "")


def mate_separator_single(reads: DataFrame, candidates: str = "/.:", first: int = 1024) -> str:
    """The first separator with which all of the first reads have a mate number; else none."""
    from strandflow.functions.bases import read_name

    got = reads.where(F.col("read_idx") < first).agg(
        *[F.coalesce(F.bool_and(read_name("header", c)["mate"] != ""), F.lit(False)).alias(f"s{i}") for i, c in enumerate(candidates)]).first()
    return next((c for c, ok in zip(candidates, got) if ok), "")


def pair_violations(pairs: DataFrame, separator: str = "/") -> DataFrame:
    """Pairs whose names differ, or whose mates are numbered otherwise than 1 and 2, with the reason."""
    from strandflow.functions.bases import read_name

    a, b = read_name("header1", separator), read_name("header2", separator)
    numbered = (a["mate"] != "") | (b["mate"] != "")
    reason = F.when(a["name"] != b["name"], "names differ").when(numbered & ~((a["mate"] == "1") & (b["mate"] == "2")), "inconsistent mates")
    return pairs.withColumn("reason", reason).where("reason is not null")


# ---- files ------------------------------------------------------------------------------------------------------------

MAGIC = b"\x1f\x8b"


class Members(io.RawIOBase):
    """The content of a gzip file member by member.  What follows the last member and isn't one is left out with a warning;
    a file that ends within a member raises EOFError."""

    def __init__(self, path: str):
        self.file, self.path, self.packed, self.held, self.member = open(path, "rb"), path, b"", b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            self.packed = self.packed or self.file.read(1 << 20)
            if self.member is None:
                if len(self.packed) < 2:
                    self.packed += self.file.read(1 << 20)
                if not self.packed:
                    return 0
                if self.packed[:2] != MAGIC:
                    logging.getLogger(__name__).warning("ignoring what follows the last gzip member of %s", self.path)
                    return 0
                self.member = zlib.decompressobj(31)
            if not self.packed:
                raise EOFError(f"{self.path} ends within a gzip member")
            self.held = self.member.decompress(self.packed, 1 << 20)
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, None
            else:
                self.packed = self.member.unconsumed_tail
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n

    def close(self) -> None:
        self.file.close()
        super().close()


class Split(InputPartition):
    def __init__(self, path: str, file_ord: int, start: int, end: int | None):
        self.path, self.file_ord, self.start, self.end = path, file_ord, start, end


class FastqReader(DataSourceReader):
    """Splits of plain files by bytes, of compressed files none.  A split owns the records that begin in it."""

    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.size = int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[Split]:
        out = []
        for i, path in enumerate(self.paths):
            with open(path, "rb") as f:
                packed = f.read(2) == MAGIC
            if packed:
                out.append(Split(path, i, 0, None))
            else:
                n = os.path.getsize(path)
                out += [Split(path, i, s, min(s + self.size, n)) for s in range(0, n, self.size)] or [Split(path, i, 0, 0)]
        return out

    def read(self, split: Split) -> Iterator[tuple]:
        with io.BufferedReader(Members(split.path)) if split.end is None else open(split.path, "rb") as f:
            place = split.start
            if split.start:
                place = _next_record(f, split.start)
                f.seek(place)
            while split.end is None or place < split.end:
                start, lines = place, []
                while len(lines) < 4:
                    line = f.readline()
                    if not line:
                        break
                    place += len(line)
                    line = line.rstrip(b"\n").removesuffix(b"\r")
                    if lines or line:
                        lines.append(line.decode("ascii"))
                if not lines:
                    return
                problem = ("truncated record" if len(lines) < 4 else "invalid header" if lines[0][:1] != "@" or len(lines[0]) < 2
                           else "no nucleotides" if not lines[1] else "missing separator" if lines[2][:1] != "+"
                           else "qualities of another length" if len(lines[1]) != len(lines[3]) else "")
                if problem:
                    raise ValueError(f"{problem} at byte {start} of {split.path}")
                yield split.file_ord, start, lines[0], lines[1], lines[3]


def _next_record(f, at: int) -> int:
    """The first place from `at` on where a record begins: a line with @ whose next but one begins with +.

    A quality line may begin with @ as well, but the line after its next is then a sequence.
    """
    f.seek(at - 1)
    if f.read(1) != b"\n":
        f.readline()
    places, lines = [], []
    while True:
        places.append(f.tell())
        line = f.readline()
        if not line:
            return places[-1]
        lines.append(line)
        if len(lines) >= 3 and lines[-3][:1] == b"@" and lines[-1][:1] == b"+":
            return places[-3]


class FastqSource(DataSource):
    """spark.read.format("fastq").load("a.fastq,b.fastq.gz"): rows (file_ord, place, header, seq, qual) in input order by (file_ord, place).

    Compression is told by the first bytes, not by the name.  Paths must be ones that all executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file_ord int, place long, header string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def first_bytes(spark: SparkSession, path: str, n: int = 2) -> bytes:
    """The beginning of a file on any file system that Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def _kept(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """(splits, lines) of a batch without blank lines and carriage returns."""
    text = pc.utf8_rtrim(batch.column(1), "\r")
    there = pc.not_equal(text, "")
    return batch.column(0).filter(there).to_numpy(zero_copy_only=False), text.filter(there)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _split_batches(batches):
    """One row a split: its number of lines and the first three of them, which may end a record of the split before."""
    count: dict[int, int] = {}
    first: dict[int, list[str]] = {}
    for batch in batches:
        splits, text = _kept(batch)
        for lo, hi in _runs(splits):
            at = int(splits[lo])
            count[at] = count.get(at, 0) + hi - lo
            mine = first.setdefault(at, [])
            mine += text[lo:min(hi, lo + 3 - len(mine))].to_pylist() if len(mine) < 3 else []
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([first[k] for k in count], pa.list_(pa.string()))],
                                     ["split", "n", "first"])


def _check(header: pa.Array, seq: pa.Array, plus: pa.Array, qual: pa.Array, where: str) -> None:
    problems = {"invalid header": pc.and_(pc.starts_with(header, "@"), pc.greater(pc.binary_length(header), 1)), "missing separator": pc.starts_with(plus, "+"),
                "qualities of another length": pc.equal(pc.binary_length(seq), pc.binary_length(qual))}
    for problem, fine in problems.items():
        if not pc.all(fine, min_count=0).as_py():
            raise ValueError(f"{problem} at {header[pc.index(fine, False).as_py()]} of {where}")


def plain_records(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(rows (rec, header, seq, qual), number of records) of an uncompressed file on any file system.

    Spark's text reader cuts the file into splits.  A first pass counts the lines of every split and takes its first three: one
    small row a split goes to the driver, which then knows where in a record each split begins, and how its last one ends.  The
    second pass makes records of whole batches of lines, and nothing is shuffled.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("split"), "value")
    found = sorted(tuple(r) for r in lines.mapInArrow(_split_batches, "split long, n long, first array<string>").collect())
    total = sum(n for _, n, _ in found)
    if total % 4:
        raise ValueError(f"truncated record at the end of {path}")
    begins, ends, at = {}, {}, 0
    for i, (split, n, _) in enumerate(found):
        begins[split], at = at, at + n
        after = [line for _, _, first in found[i + 1:i + 5] for line in first]
        ends[split] = after[:-at % 4]
    held = spark.sparkContext.broadcast((begins, ends))

    def run(batches):
        begins, ends = held.value
        split, place, left = None, 0, pa.array([], pa.string())

        def records(text: pa.Array, first: int) -> pa.RecordBatch:
            four = [text.take(pa.array(np.arange(k, len(text), 4))) for k in range(4)]
            _check(*four, path)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(four[0])) + first // 4, pa.int64()), four[0], four[1], four[3]], ["rec", "header", "seq", "qual"])

        def close():
            if len(left):
                yield records(pa.concat_arrays([left, pa.array(ends[split], pa.string())]), place)

        for batch in batches:
            splits, text = _kept(batch)
            for lo, hi in _runs(splits):
                own = text.slice(lo, hi - lo)
                if splits[lo] != split:
                    yield from close()
                    split = int(splits[lo])
                    # What ends the record of the split before is that one's.
                    place, left, skip = begins[split] + -begins[split] % 4, own.slice(0, 0), -begins[split] % 4
                else:
                    skip = max(0, skip)
                gone = min(skip, len(own))
                skip, own = skip - gone, pa.concat_arrays([left, own.slice(gone)])
                whole = len(own) // 4 * 4
                if whole:
                    yield records(own.slice(0, whole), place)
                place, left = place + whole, own.slice(whole)
        yield from close()

    return lines.mapInArrow(run, "rec long, header string, seq string, qual string"), total // 4


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (read_idx, file_ord, header, seq, qual) of files one after the other, compressed or not by their content.

    Plain files are numbered from the counts of their splits, without a shuffle.  Compressed files are read by one task each;
    those on other than local file systems have to be named .gz.
    """
    out, at = None, 0
    for i, path in enumerate(paths):
        local = "://" not in path and not path.startswith("file:")
        packed = first_bytes(spark, f"file://{os.path.abspath(path)}" if local else path) == MAGIC
        if packed and local:
            spark.dataSource.register(FastqSource)
            own = concatenated(spark.read.format("fastq").load(path), "place").withColumnRenamed("read_idx", "rec").select("rec", "header", "seq", "qual")
            n = own.count() if i + 1 < len(paths) else 0
        else:
            own, n = plain_records(spark, f"file://{os.path.abspath(path)}" if local else path)
        own = own.select((F.col("rec") + at).alias("read_idx"), F.lit(i).alias("file_ord"), "header", "seq", "qual")
        out, at = own if out is None else out.unionByName(own), at + n
    return out
