"""Sinks: FASTQ and SAM text, BAM files, and reports."""

from __future__ import annotations

import html
import json
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strandflow.operators import routing, stats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Payload of a compressed block, and the empty block that ends a file.  Fixed values of the format.
BLOCK = 65280
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Codes of bases in BAM.
BASE_CODES = "=ACMGRSVTWYHKDBN"


def write_fastq(reads: DataFrame, path: str, by: list[str] | None = None, gzip: bool = True, order: str | None = None, text: Column | None = None) -> None:
    """Text files of records, one folder for each value of the columns in `by`, in the order of a column if one is named.

    Ordered records are dealt out by ranges of (by, order), so that one large sample is written by as many tasks as it needs, and its
    part files follow each other.
    """
    by = by or []
    out = reads.select(*by, *([order] if order else []), (routing.fastq_text() if text is None else text).alias("value"))
    if order:
        out = out.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    writer = out.select(*by, "value").write.option("compression", "gzip" if gzip else "none").mode("error")
    (writer.partitionBy(*by) if by else writer).text(path)


def sam_header(read_groups: list[dict[str, str]], command: str = "") -> list[str]:
    lines = ["@HD\tVN:1.6\tSO:unsorted"]
    lines += ["@RG\t" + "\t".join(f"{k}:{v}" for k, v in g.items()) for g in read_groups]
    return [*lines, f"@PG\tID:strandflow\tPN:strandflow\tCL:{command}"]


def read_group(text: str, sample: str | None = None, barcodes: tuple[str, str] = ("", ""), description: str = "") -> dict[str, str]:
    """Fields of a read group from TAG:value pairs separated by tabs; those of a sample are added: ID, SM, BC, DS."""
    group: dict[str, str] = {}
    for part in filter(None, text.replace("\\t", "\t").removeprefix("@RG").split("\t")):
        tag, _, value = part.partition(":")
        if len(tag) != 2 or not tag.isalnum() or not value:
            raise ValueError(f"invalid field of a read group: {part!r}")
        if tag in group:
            raise ValueError(f"field {tag} occurs twice in a read group")
        group[tag] = value
    group = {"ID": group.pop("ID", "1"), **group}
    if sample:
        group["ID"] = f"{group['ID']}.{sample}" if text else sample
        group["SM"] = sample
    if barcodes[0]:
        group["BC"] = "-".join(b for b in barcodes if b)
    if description:
        group["DS"] = description
    return group


def bgzf(data: bytes, level: int = 4) -> Iterator[bytes]:
    """Blocks of a file that is compressed in pieces; the empty block at the end is the caller's."""
    for i in range(0, len(data), BLOCK):
        piece = data[i:i + BLOCK]
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(piece) + packer.flush()
        yield (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body
               + struct.pack("<II", zlib.crc32(piece), len(piece)))


def bam_header(lines: Iterable[str]) -> bytes:
    text = "".join(f"{line}\n" for line in lines).encode()
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0)


def bam_record(name: str, flag: int, seq: str, qual: str, group: str | None = None) -> bytes:
    """An unaligned record: no reference, no position; bases of four bits, scores without their offset."""
    title = name.encode() + b"\0"
    codes = [BASE_CODES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    tags = b"RGZ" + group.encode() + b"\0" if group else b""
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(title), 0, 4680, 0, flag, len(seq), -1, -1, 0)
    body += title + packed + bytes(ord(c) - 33 for c in qual) + tags
    return struct.pack("<i", len(body)) + body


class BamWriter(DataSourceWriter):
    """One file a task, whole only when its task ends; names in the commit carry the task's number."""

    def __init__(self, options):
        self.path, self.header, self.level = options["path"], options.get("header", "@HD\tVN:1.6\tSO:unsorted"), int(options.get("level", 4))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/part-{task.partitionId():05d}.bam"
        part = f"{name}.{task.taskAttemptId()}.tmp"
        with open(part, "wb") as f:
            held = bytearray(bam_header(self.header.split("\n")))
            for r in rows:
                held += bam_record(r["name"], r["flag"], r["seq"], r["qual"], r["read_group"])
                if len(held) > 16 * BLOCK:
                    whole = len(held) // BLOCK * BLOCK
                    f.writelines(bgzf(bytes(held[:whole]), self.level))
                    del held[:whole]
            f.writelines(bgzf(bytes(held), self.level))
            f.write(END_OF_FILE)
        os.replace(part, name)
        return WriterCommitMessage()


class BamSink(DataSource):
    """df.write.format("ubam").save(path) of rows (name, flag, seq, qual, read_group); the path is one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "ubam"

    def schema(self) -> str:
        return "name string, flag int, seq string, qual string, read_group string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return BamWriter(self.options)


def write_bam(reads: DataFrame, path: str, header: list[str], separator: str = "", group: str | None = None, level: int = 4) -> None:
    from strandflow.functions.bases import read_name

    reads.sparkSession.dataSource.register(BamSink)
    flags = F.create_map(*[F.lit(x) for kv in routing.SAM_FLAGS.items() for x in kv])
    rows = reads.select(read_name("header", separator)["name"].alias("name"), flags[F.col("read_type")].cast("int").alias("flag"), "seq", "qual",
                        F.lit(group).cast("string").alias("read_group"))
    rows.write.format("ubam").option("header", "\n".join(header)).option("level", level).mode("append").save(path)


def _dense(rows: list, key: str, value: str) -> list:
    """Values from 0 to the largest key, 0 where there is none."""
    by = {r[key]: r[value] for r in rows}
    return [by.get(i, 0) for i in range(max(by, default=-1) + 1)]


def stream_report(reads: DataFrame, filenames: list[str] | None = None) -> dict:
    """What a report says of one stream of reads (seq, qual): bounded tables, one entry a length, score, position or bin."""
    summary = stats.summary(reads).first().asDict()
    lengths = _dense(stats.length_histogram(reads).collect(), "length", "n")
    out = {"filenames": filenames or [], "input_reads": summary["reads"], "output_reads": summary["reads"], "reads_sampled": summary["reads"], "lengths": lengths}
    if not summary["bases"]:
        return {**out, "quality_curves": None, "content_curves": None, "quality_scores": None, "gc_content": None}
    counts = stats.position_counts(reads).persist()
    curves = {r["pos"]: r for r in stats.quality_curves(counts).collect()}
    shares = {r["pos"]: r for r in stats.content_curves(counts).collect()}
    counts.unpersist()
    n = max(curves) + 1
    scores = _dense(stats.quality_histogram(reads).collect(), "q", "n")
    gc = {r["bin"]: r["n"] for r in stats.gc_histogram(reads).collect()}
    rounded = lambda x: None if x is None else round(x, 3)
    return {
        **out, "quality_curves": {k: [rounded(curves[i][k]) for i in range(n)] for k in ("a", "c", "g", "t", "mean")},
        "content_curves": {k: [rounded(shares[i][k]) for i in range(n)] for k in "acgtn"}, "quality_scores": scores, "gc_content": [rounded(gc.get(i, 0)) for i in range(101)],
    }


def summary_report(reads: DataFrame) -> dict:
    got = stats.summary(reads).first().asDict()
    rates = {k: None if got[k] is None else round(got[k], 3) for k in ("mean_length", "q20_rate", "q30_rate", "uncalled_rate", "gc_content")}
    return {"reads": got["reads"], "bases": got["bases"], "mean_length": rates.pop("mean_length"), "reads_sampled": got["reads"], **rates}


def json_report(title: str, inputs: dict[str, DataFrame], outputs: dict[str, DataFrame] | None, steps: DataFrame | None = None,
                duplication: DataFrame | None = None, insert_sizes: DataFrame | None = None, details: dict[str, DataFrame] | None = None) -> dict:
    """The report of a run; what wasn't asked for is null.  details: further bounded tables by name."""
    def whole(streams):
        frames = list(streams.values())
        one = frames[0].select("seq", "qual")
        for f in frames[1:]:
            one = one.unionByName(f.select("seq", "qual"))
        return summary_report(one)

    return {
        "meta": {"title": title}, "summary": {"input": whole(inputs), "output": whole(outputs) if outputs else None},
        "input": {k: stream_report(v) for k, v in inputs.items()}, "processing": [r.asDict() for r in steps.collect()] if steps is not None else None,
        "details": {k: sorted((r.asDict() for r in v.collect()), key=str) for k, v in details.items()} if details else None,
        "analyses": {"duplication": [r.asDict() for r in duplication.collect()] if duplication is not None else None,
                     "insert_sizes": _dense(insert_sizes.collect(), "insert_size", "n") if insert_sizes is not None else None},
        "output": {k: stream_report(v) for k, v in outputs.items()} if outputs else None,
    }


def thousands(n: int) -> str:
    return f"{n:,}"


def rough(n: float) -> str:
    """Three significant digits and a letter for the thousands."""
    for scale, letter in ((1e15, "P"), (1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K")):
        if n >= scale:
            x = n / scale
            return f"{x:.{2 if x < 10 else 1 if x < 100 else 0}f} {letter}"
    return f"{n:g}"


def percentage(part: float, whole: float, digits: int = 1) -> str:
    return f"{100 * part / whole:.{digits}f}" if whole else "NA"


def _bars(values: list, width: int = 600, height: int = 120) -> str:
    top = max((v for v in values if v), default=0)
    if not top:
        return "<p>none</p>"
    step = width / len(values)
    bars = "".join(f'<rect x="{i * step:.1f}" y="{height - (v or 0) / top * height:.1f}" width="{max(step - 0.5, 0.5):.1f}" height="{(v or 0) / top * height:.1f}"/>' for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" fill="#4477aa">{bars}</svg>'


#: Colours of bases in curves.
COLOURS = {"a": "#228833", "c": "#4477aa", "g": "#222222", "t": "#ee6677", "n": "#bbbbbb", "mean": "#aa3377"}


def _curves(series: dict[str, list], width: int = 600, height: int = 160) -> str:
    """One line a series by position; places without a value are left out."""
    top = max((v for values in series.values() for v in values if v is not None), default=0) or 1
    lines = []
    for name, values in series.items():
        points = " ".join(f"{i * width / max(len(values) - 1, 1):.1f},{height - v / top * height:.1f}" for i, v in enumerate(values) if v is not None)
        lines.append(f'<polyline fill="none" stroke="{COLOURS.get(name, "#888888")}" points="{points}"><title>{html.escape(name)}</title></polyline>')
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}">{"".join(lines)}</svg>'


def html_report(report: dict) -> str:
    """A page that needs nothing else: tables and bar charts of the report."""
    def table(rows: dict) -> str:
        return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(thousands(v) if isinstance(v, int) else str(v))}</td></tr>" for k, v in rows.items()) + "</table>"

    parts = [f"<h1>{html.escape(report['meta']['title'] or 'Reads')}</h1>"]
    for side in ("input", "output"):
        if report["summary"][side]:
            parts.append(f"<h2>{side.title()}</h2>" + table(report["summary"][side]))
        for name, stream in (report[side] or {}).items():
            parts.append(f"<h3>{html.escape(name)}</h3>")
            for key in ("lengths", "quality_scores", "gc_content"):
                if stream[key]:
                    parts.append(f"<h4>{key.replace('_', ' ')}</h4>{_bars(stream[key])}")
            if stream["quality_curves"]:
                parts.append(f"<h4>quality by position and base</h4>{_curves(stream['quality_curves'])}")
                parts.append(f"<h4>bases by position</h4>{_curves(stream['content_curves'])}")
    if report["processing"]:
        total = report["summary"]["input"]["reads"]
        rows = "".join(f"<tr><td>{html.escape(r['step'])}</td><td>{thousands(r['reads'] or 0)}</td><td>{percentage(r['reads'] or 0, total)}</td><td>{thousands(r['bases'] or 0)}</td></tr>" for r in report["processing"])
        parts.append("<h2>Processing</h2><table><tr><th>step</th><th>reads</th><th>%</th><th>bases</th></tr>" + rows + "</table>")
    if report["analyses"]["insert_sizes"]:
        parts.append("<h2>Insert sizes</h2>" + _bars(report["analyses"]["insert_sizes"]))
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Reads</title><style>body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}</style></head><body>" + "".join(parts) + "</body></html>"


def write_report(report: dict, json_path: str | None = None, html_path: str | None = None) -> None:
    if json_path:
        with open(json_path, "w") as f:
            json.dump(report, f, indent=2)
    if html_path:
        with open(html_path, "w") as f:
            f.write(html_report(report))
