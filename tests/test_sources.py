import gzip
import json

import pytest

from strandflow.config import Config, ConfigError
from strandflow.operators import demux, detect
from strandflow.plans import fixtures as fx
from strandflow.plans import pipeline
from strandflow.sources import adapters, fastq, writers
from strandflow.streaming import reads as streaming
from tests.compare import SF_DIR

RECORDS = [(f"@r{i} x", "ACGT" * (i % 7 + 1), "@+I!" * (i % 7 + 1)) for i in range(500)]
TEXT = "".join(f"{h}\n{s}\n+\n{q}\n" for h, s, q in RECORDS)


def rows(df):
    return [tuple(r) for r in df.orderBy("read_idx").select("header", "seq", "qual").collect()]


@pytest.mark.parametrize("text", [TEXT, TEXT[:-1], TEXT.replace("\n", "\r\n"), "\n\n" + TEXT])
def test_files_in_splits(spark, tmp_path, text):
    (tmp_path / "a.fastq").write_bytes(text.encode())
    spark.dataSource.register(fastq.FastqSource)
    got = spark.read.format("fastq").option("splitBytes", 777).load(str(tmp_path / "a.fastq"))
    assert sorted((r["header"], r["seq"], r["qual"]) for r in got.collect()) == sorted(RECORDS)


def test_compressed_files_are_known_by_content_and_follow_each_other(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(TEXT)
    (tmp_path / "b").write_bytes(gzip.compress(TEXT[:len(TEXT) // 2].encode()[:0]) + gzip.compress(TEXT.encode()))
    assert rows(fastq.read_fastq(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b")])) == RECORDS + RECORDS


@pytest.mark.parametrize("size", [61, 700, 10**6])
@pytest.mark.parametrize("text", [TEXT, TEXT[:-1], TEXT.replace("\n", "\r\n"), "\n\n" + TEXT + "\n\n"])
def test_records_are_numbered_across_splits(spark, tmp_path, size, text):
    """Splits of any size, smaller than a line and larger than the file, of two files; nothing is shuffled."""
    for name in ("a.fastq", "b.fastq"):
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        paths = [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")]
        # Splits of a few bytes are slow, so these have a short file.
        if size < 100:
            whole = [line for line in text[:len(text) // 40].replace("\r", "").split("\n") if line]
            whole = whole[:len(whole) // 4 * 4 - 4]
            for path in paths:
                open(path, "w").write("\n".join(whole) + "\n")
            records = list(zip(whole[::4], whole[1::4], whole[3::4]))
        else:
            records = RECORDS
        got = fastq.read_fastq(spark, paths)
        assert rows(got) == records + records and [r["read_idx"] for r in got.orderBy("read_idx").collect()] == list(range(2 * len(records)))
        assert "Exchange" not in got._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_cut_file_fails(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(TEXT + "@x\nAC\n")
    with pytest.raises(ValueError, match="truncated"):
        fastq.read_fastq(spark, [str(tmp_path / "a.fastq")])


def test_samples_are_written_at_once(spark, tmp_path):
    """A demultiplexed run in FASTQ and SAM: folders by sample and file, adapters behind barcodes, a read group a sample."""
    from strandflow.__main__ import main

    reads = fx.barcoded_pe(spark, SF_DIR).orderBy("read_id").limit(400).collect()
    for i in (1, 2):
        (tmp_path / f"r{i}.fastq").write_text("".join(f"{r[f'header{i}']}\n{r[f'seq{i}']}\n+\n{r[f'qual{i}']}\n" for r in reads))
    table = tmp_path / "barcodes.txt"
    table.write_text("".join(f"{b.sample} {b.bc1} {b.bc2}\n" for b in fx.BARCODES_PE if b.orientation == "unspecified"))
    one, two, out = (str(tmp_path / x) for x in ("r1.fastq", "r2.fastq", "out"))
    common = ["--in-file1", one, "--in-file2", two, "--barcode-table", str(table), "--adapter1", fx.ADAPTER1, "--adapter2", fx.ADAPTER2, "--pre-trim-polyx", "", "--normalize-mate-separator", "."]
    assert main([*common, "--out-prefix", out, "--out-json", f"{out}.json"]) == 0
    names = {p.name for p in tmp_path.iterdir() if p.is_dir()}
    assert {"out.beta.r1.fastq.gz", "out.unidentified.r1.fastq.gz"} <= names and "out.parts" not in names
    heads = [r["value"] for r in spark.read.text(f"{out}.beta.r1.fastq.gz").collect() if r["value"].startswith("@")]
    assert heads and all(h.endswith(".1") for h in heads)
    report = json.loads((tmp_path / "out.json").read_text())
    assert set(report["output"]) == {"beta", "gamma", "delta", "unidentified"} and report["details"]["adapters"] and report["details"]["filters"]
    assert main([*common, "--out-prefix", f"{out}2", "--out-format", "sam", "--read-group", "ID:run\tPL:X"]) == 0
    lines = [r["value"] for r in spark.read.text(f"{out}2.beta.sam").collect()]
    assert any(x.startswith("@RG\tID:run.beta") and "SM:beta" in x for x in lines) and all(x.endswith("RG:Z:run.beta") for x in lines if not x.startswith("@"))


def test_swapped_adapters_are_told(spark, caplog):
    reads = fx.reads_pe(spark, SF_DIR)
    turned = reads.select("read_id", *[reads[f"{c}{3 - i}"].alias(f"{c}{i}") for i in (1, 2) for c in ("header", "seq", "qual")])
    ordinal = fastq.concatenated(turned.selectExpr("*", "0 as file_ord", "read_id as rec")).drop("read_id", "file_ord", "rec").withColumnRenamed("read_idx", "read_id")
    assert pipeline.select_adapters(ordinal, Config(paired=True).resolved(), ["seq1", "seq2"]) == [(fx.ADAPTER2, fx.ADAPTER1)]
    assert any("swapped" in r.message for r in caplog.records)


def test_what_follows_compressed_data_is_left_out(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(TEXT.encode()) + gzip.compress(TEXT.encode()) + b"\0rest")
    assert rows(fastq.read_fastq(spark, [str(tmp_path / "a")])) == RECORDS + RECORDS
    (tmp_path / "b").write_bytes(gzip.compress(TEXT.encode())[:-20])
    with pytest.raises(Exception, match="within a gzip member"):
        fastq.read_fastq(spark, [str(tmp_path / "b")]).collect()


@pytest.mark.parametrize("text", ["@a\nAC\n+\n", "@a\nAC\n+\nI\n", "a\nAC\n+\nII\n", "@\nAC\n+\nII\n", "@a\nAC\n-\nII\n"])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "a.fastq").write_text(text)
    with pytest.raises(Exception):
        fastq.read_fastq(spark, [str(tmp_path / "a.fastq")]).collect()


def test_uneven_mates_fail(spark):
    reads = spark.createDataFrame([(i, "@a", "A", "I") for i in range(3)], "read_idx long, header string, seq string, qual string")
    with pytest.raises(Exception, match="differ in their number"):
        fastq.pair_files(reads, reads.where("read_idx < 2")).collect()
    with pytest.raises(Exception, match="odd number"):
        fastq.deinterleave(reads).collect()


def test_counts():
    assert [fastq.parse_count(t) for t in ("0", "7", "2k", "1.5M", "1G")] == [0, 7, 2000, 1_500_000, 10**9]
    with pytest.raises(ValueError):
        fastq.parse_count("0.5")


def test_tables(spark):
    lines = spark.createDataFrame([(0, "# s b"), (1, "one ACGT TTTT fwd"), (2, "one TTTT ACGT rev"), (3, " two\tCCCC GGGG + # x")], "line_no long, value string")
    got = adapters.barcode_table(lines)
    assert [(b.sample, b.orientation) for b in got] == [("one", "forward"), ("one", "reverse"), ("two", "forward")]
    demux.validate(got)
    with pytest.raises(Exception, match="wrong number of columns"):
        adapters.adapter_table(spark.createDataFrame([(0, "A C G")], "line_no long, value string")).collect()
    assert len(json.loads(adapters.export_json(adapters.known_adapters(spark)))) == 14


@pytest.mark.parametrize("bad", [
    [demux.Barcode("a b", "ACGT")], [demux.Barcode("Unidentified", "ACGT")], [demux.Barcode("a", "ACGN")], [demux.Barcode("a", "ACGT"), demux.Barcode("A", "TTTT")],
    [demux.Barcode("a", "ACGT"), demux.Barcode("b", "ACG")], [demux.Barcode("a", "ACGT"), demux.Barcode("a", "TTTT")], [demux.Barcode("a", "ACGT"), demux.Barcode("b", "ACGT")]])
def test_bad_barcodes(bad):
    with pytest.raises(ValueError):
        demux.validate(bad)


def test_ambiguity():
    two = [demux.Barcode("a", "ACGT"), demux.Barcode("a", "ACGA"), demux.Barcode("b", "TTTT")]
    table = demux.lookup(two, paired=False, total=1)
    assert table["ACGT", ""] == (0, 0) and table["ACGC", ""] == (0, demux.AMBIGUOUS) and table["TTTN", ""] == (1, 0)
    assert demux.limits(1) == (1, 1, 1) and demux.limits(0, 1) == (1, 1, 1) and demux.limits(2, 1, 0) == (1, 1, 0)


def test_choice(spark):
    make = lambda *r: spark.createDataFrame([r], "candidate string, hits long, aligned long, mismatches long")
    assert detect.choose(make("A", 9, 90, 0), 100) is None
    assert detect.choose(make("A", 10, 100, 50), 1000) == "A"
    assert detect.choose(make("A", 10, 100, 5), 10000) == "A"
    assert detect.choose(make("A", 10, 100, 6), 10000) is None
    assert detect.choose(make("A", 10, 100, 0), 10001) is None
    known = adapters.KNOWN_ADAPTERS
    assert detect.name_pair(fx.ADAPTER1, fx.ADAPTER2, known)[0] == ("Illumina TruSeq", "Illumina TruSeq", False)
    assert detect.name_pair(fx.ADAPTER2, fx.ADAPTER1, known)[0] == ("Illumina TruSeq", "Illumina TruSeq", True)
    assert detect.closest("CGCCTTGGCCGTACAGCAC", known)[0] == "Life Technologies SOLiD small RNA"


def test_options():
    assert Config().resolved().adapter_selection == "auto"
    assert Config(mismatch_rate=5.0).resolved().mismatch_rate == 0.2
    assert Config(paired=True).resolved().min_overlap == 11
    for bad in (Config(merge=True), Config(min_length=9, max_length=5), Config(quality_trimming="x"), Config(adapter_selection="manual"), Config(demultiplex_only=True)):
        with pytest.raises(ConfigError):
            bad.resolved()


def test_automatic_run_finds_the_adapters(spark):
    found = pipeline.select_adapters(fx.reads_pe(spark, SF_DIR), Config(paired=True).resolved(), ["seq1", "seq2"])
    assert found == [(fx.ADAPTER1, fx.ADAPTER2)]


def test_written_fastq_reads_back(spark, tmp_path):
    reads = fx.reads_se(spark, SF_DIR).limit(200).persist()
    writers.write_fastq(reads, str(tmp_path / "out"), order="read_id")
    lines = spark.read.text(str(tmp_path / "out")).count()
    assert lines == 800
    reads.unpersist()


def test_bam(spark, tmp_path):
    reads = spark.createDataFrame([("@a x", "ACGTN", "IIIII", "se"), ("@b", "", "", "se_fail")], "header string, seq string, qual string, read_type string").coalesce(1)
    writers.write_bam(reads, str(tmp_path / "b"), writers.sam_header([writers.read_group("ID:x\tSM:y")]), group="x")
    [path] = (tmp_path / "b").glob("*.bam")
    raw = path.read_bytes()
    assert raw.endswith(writers.END_OF_FILE)
    data = gzip.decompress(raw)
    assert data[:4] == b"BAM\1" and b"@RG\tID:x\tSM:y" in data and b"RGZx\0" in data and bytes([0x12, 0x48, 0xF0]) in data


def test_report(spark):
    reads = fx.reads_se(spark, SF_DIR).persist()
    report = writers.json_report("t", {"read1": reads}, None)
    assert report["summary"]["input"]["reads"] == reads.count() == sum(report["input"]["read1"]["lengths"])
    assert len(report["input"]["read1"]["gc_content"]) == 101 and report["output"] is None
    assert "<svg" in writers.html_report(report)
    empty = writers.stream_report(reads.where("false"))
    assert empty["quality_curves"] is None
    assert [writers.rough(x) for x in (999, 1234, 56789, 1234567)] == ["999", "1.23 K", "56.8 K", "1.23 M"]
    reads.unpersist()


def test_stream_equals_batch(spark, tmp_path):
    config = Config(adapters=((fx.ADAPTER1, ""),), pre_trim_polyx="", quality_trimming="per-base")
    reads = fx.reads_se(spark, SF_DIR)
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    done = streaming.running_counts(streaming.processed(streaming.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1), config))
    q = done.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    wanted = {tuple(r) for r in streaming.running_counts(pipeline.process_single(reads, config)).collect()}
    assert {tuple(r) for r in spark.sql("select * from running").collect()} == wanted


def test_command_line(spark, tmp_path):
    from strandflow.__main__ import main

    reads = fx.reads_pe(spark, SF_DIR).orderBy("read_id").limit(150).collect()
    for i in (1, 2):
        (tmp_path / f"r{i}.fastq").write_text("".join(f"{r[f'header{i}']}\n{r[f'seq{i}']}\n+\n{r[f'qual{i}']}\n" for r in reads))
    one, two, out = (str(tmp_path / x) for x in ("r1.fastq", "r2.fastq", "out"))
    assert main(["--in-file1", one, "--in-file2", two, "--merge", "--out-prefix", out, "--out-json", f"{out}.json", "--out-html", f"{out}.html", "--report-sample-rate", "1.0",
                 "--head", "0.1K", "--report-duplication"]) == 0
    report = json.loads((tmp_path / "out.json").read_text())
    assert report["summary"]["input"]["reads"] == 200 and {s["step"] for s in report["processing"]} >= {"merged", "adapters"}
    assert spark.read.text(f"{out}.merged.fastq.gz").count() % 4 == 0 and report["analyses"]["duplication"] and report["analyses"]["insert_sizes"]
    assert main(["--in-file1", one, "--out-prefix", f"{out}2", "--adapter1", fx.ADAPTER1, "--out-format", "sam"]) == 0
    assert spark.read.text(f"{out}2.sam").where("value like '@%'").count() == 2
    table = tmp_path / "barcodes.txt"
    table.write_text("a ACGT\nb TTTT # none\n")
    assert main(["--in-file1", one, "--barcode-table", str(table), "--demultiplex-only", "--out-prefix", f"{out}3"]) == 0
    assert main(["--in-file1", one, "--report-only", "--out-json", f"{out}4.json"]) == 0
    assert main(["--in-file1", one, one]) == 1 and main(["--in-file1", str(tmp_path / "none")]) == 1 and main(["--in-file1", one, "--merge"]) == 1
