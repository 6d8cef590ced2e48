"""Demultiplexing: barcodes and all keys near them become one small table, and reads find theirs by an equi-join."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.bases import reverse_complement, truncate

UNIDENTIFIED, AMBIGUOUS = -1, -2
#: Keys of the lookup table; it is broadcast, so it is refused beyond this.
MAX_KEYS = 2_000_000


@dataclass(frozen=True)
class Barcode:
    sample: str
    bc1: str
    bc2: str = ""
    orientation: str = "unspecified"


def validate(barcodes: list[Barcode], multiple: bool = False, paired: bool = True) -> None:
    """Raises ValueError unless names and sequences are proper, of equal lengths, and no two barcodes are the same."""
    spelled: dict[str, str] = {}
    by_sample: dict[str, list[Barcode]] = defaultdict(list)
    for b in barcodes:
        if not re.fullmatch(r"[A-Za-z0-9_]+", b.sample) or b.sample.lower() == "unidentified":
            raise ValueError(f"invalid sample name {b.sample!r}")
        if spelled.setdefault(b.sample.lower(), b.sample) != b.sample:
            raise ValueError(f"sample names differ by case only: {b.sample!r}")
        if not re.fullmatch("[ACGT]+", b.bc1) or not re.fullmatch("[ACGT]*", b.bc2):
            raise ValueError(f"invalid barcode of sample {b.sample!r}")
        by_sample[b.sample].append(b)
    if len({len(b.bc1) for b in barcodes}) > 1 or len({len(b.bc2) for b in barcodes}) > 1:
        raise ValueError("barcodes of different lengths")
    for sample, own in by_sample.items():
        if len(own) > 1 and not multiple and sorted(b.orientation for b in own) != ["forward", "reverse"]:
            raise ValueError(f"several barcodes for sample {sample!r}")
    keys = [(b.bc1, b.bc2) if paired else b.bc1 for b in barcodes]
    if len(set(keys)) < len(keys):
        raise ValueError("barcodes occur more than once")


def oriented(barcodes: list[Barcode], mode: str) -> list[Barcode]:
    """Barcodes with their reverses: mode unspecified and explicit add none, forward and reverse name the table's orientation."""
    if mode in ("unspecified", "explicit"):
        return list(barcodes)
    other = {"forward": "reverse", "reverse": "forward"}[mode]
    return [x for b in barcodes for x in (Barcode(b.sample, b.bc1, b.bc2, mode), Barcode(b.sample, b.bc2, b.bc1, other))]


def neighbours(barcode: str, most: int) -> dict[str, int]:
    """All sequences over ACGTN up to so many substitutions away, with their distance."""
    out = {barcode: 0}
    for d in range(1, most + 1):
        for places in combinations(range(len(barcode)), d):
            for letters in product(*["".join(c for c in "ACGTN" if c != barcode[p]) for p in places]):
                changed = list(barcode)
                for p, c in zip(places, letters):
                    changed[p] = c
                out.setdefault("".join(changed), d)
    return out


def limits(total: int = 0, r1: int | None = None, r2: int | None = None) -> tuple[int, int, int]:
    """(total, mate 1, mate 2); what isn't given follows from the others."""
    if not total and (r1 or r2):
        total = (r1 or 0) + (r2 or 0)
    r1, r2 = total if r1 is None else min(r1, total), total if r2 is None else min(r2, total)
    return min(total, r1 + r2), r1, r2


def lookup(barcodes: list[Barcode], paired: bool = True, total: int = 0, r1: int | None = None, r2: int | None = None) -> dict[tuple[str, str], tuple[int, int]]:
    """Keys (start of mate 1, start of mate 2) -> (sample index, barcode index), either of them AMBIGUOUS.

    The least number of mismatches decides; an exact match is never ambiguous with others.  Single reads see the first
    barcodes only: several with one first barcode are ambiguous.
    """
    total, r1, r2 = limits(total, r1, r2)
    samples = sorted({b.sample for b in barcodes})
    near: dict[tuple[str, str], dict[tuple[int, int], int]] = defaultdict(dict)
    order = sorted(range(len(barcodes)), key=lambda i: (barcodes[i].sample, i))
    nth: dict[str, int] = defaultdict(int)
    for i in order:
        b = barcodes[i]
        me = (samples.index(b.sample), nth[b.sample])
        nth[b.sample] += 1
        seconds = neighbours(b.bc2, r2 if paired else 0) if paired else {"": 0}
        for x, dx in neighbours(b.bc1, r1).items():
            for y, dy in seconds.items():
                if dx + dy <= (total if paired else r1):
                    near[x, y][me] = min(dx + dy, near[x, y].get(me, 99))
        if len(near) > MAX_KEYS:
            raise ValueError("too many barcodes or mismatches for a broadcast table")
    out = {}
    for key, found in near.items():
        least = min(found.values())
        best = [me for me, d in found.items() if d == least]
        if len(best) == 1:
            out[key] = best[0]
        else:
            out[key] = (best[0][0], AMBIGUOUS) if len({s for s, _ in best}) == 1 else (AMBIGUOUS, AMBIGUOUS)
    return out


def demultiplex(df: DataFrame, barcodes: list[Barcode], seq1: str = "seq", seq2: str | None = None, total: int = 0, r1: int | None = None,
                r2: int | None = None) -> DataFrame:
    """Adds sample_idx, barcode_idx (-1: none found, -2: several), sample (null unless one) and orientation.

    Nothing is shuffled: the lookup table, of a bounded size, is broadcast.
    """
    spark = df.sparkSession
    samples = sorted({b.sample for b in barcodes})
    table = lookup(barcodes, seq2 is not None, total, r1, r2)
    by_sample = {s: [b for b in barcodes if b.sample == s] for s in samples}

    def row(key, found):
        s, b = found
        one = s >= 0 and b >= 0
        return (*key, s, b, samples[s] if one else None, by_sample[samples[s]][b].orientation if one else None)

    rows = spark.createDataFrame([row(k, v) for k, v in table.items()], "k1 string, k2 string, sample_idx int, barcode_idx int, sample string, orientation string")
    n1, n2 = len(barcodes[0].bc1), len(barcodes[0].bc2) if seq2 else 0
    key1 = F.substring(seq1, 1, n1)
    key2 = F.substring(seq2, 1, n2) if seq2 else F.lit("")
    out = df.join(F.broadcast(rows), (key1 == F.col("k1")) & (key2 == F.col("k2")), "left").drop("k1", "k2")
    return out.withColumns({c: F.coalesce(c, F.lit(UNIDENTIFIED)) for c in ("sample_idx", "barcode_idx")})


def remove_barcodes(df: DataFrame, barcodes: list[Barcode], columns: list[tuple[str, str]]) -> DataFrame:
    """Cuts the barcodes off identified reads; columns: (seq, qual) of mate 1 and, if there is one, of mate 2."""
    known = F.col("sample").isNotNull()
    for (seq, qual), n in zip(columns, (len(barcodes[0].bc1), len(barcodes[0].bc2))):
        df = df.withColumns({c: F.when(known, truncate(c, n)).otherwise(F.col(c)) for c in (seq, qual)})
    return df


def counts(df: DataFrame, weight: int = 1) -> DataFrame:
    """Rows (sample, barcode_idx, reads): identified reads by barcode, and `ambiguous` and `unidentified` in all."""
    name = F.when((F.col("sample_idx") == AMBIGUOUS) | (F.col("barcode_idx") == AMBIGUOUS), "ambiguous").otherwise(F.coalesce("sample", F.lit("unidentified")))
    index = F.when(F.col("sample").isNotNull(), F.col("barcode_idx"))
    return df.groupBy(name.alias("sample"), index.alias("barcode_idx")).agg((F.count(F.lit(1)) * weight).alias("reads"))


def barcode_frame(spark: SparkSession, barcodes: list[Barcode]) -> DataFrame:
    return spark.createDataFrame([(b.sample, b.bc1, b.bc2, b.orientation) for b in barcodes], "sample string, bc1 string, bc2 string, orientation string")


def adapters_behind_barcodes(barcodes: DataFrame, adapters: DataFrame) -> DataFrame:
    """What follows the insert in barcoded libraries: rc(bc2) + a1 in mate 1 and, stored, rc(a2) + bc1."""
    return barcodes.crossJoin(adapters).select(
        "sample", "adapter_id", F.concat(reverse_complement("bc2"), "a1").alias("adapter1"), F.concat(reverse_complement("a2"), "bc1").alias("adapter2"))


def group_of(sample_idx="sample_idx", barcode_idx="barcode_idx") -> Column:
    """A number for sample and barcode, null for reads without one of both."""
    s, b = F.col(sample_idx), F.col(barcode_idx)
    return F.when((s >= 0) & (b >= 0), s * 1_000_000 + b).cast("int")


def adapters_by_group(barcodes: list[Barcode], adapters: list[tuple[str, str]]) -> dict[int, list[tuple[str, str]]]:
    """Adapter pairs as sequenced behind the barcodes that follow an insert, by group_of(): the other mate's barcode comes first."""
    complement = str.maketrans("ACGT", "TGCA")
    samples, seen, out = sorted({b.sample for b in barcodes}), defaultdict(int), {}
    for b in sorted(barcodes, key=lambda b: b.sample):
        nth = seen[b.sample]
        seen[b.sample] += 1
        out[samples.index(b.sample) * 1_000_000 + nth] = [(b.bc2.translate(complement)[::-1] + a1, b.bc1.translate(complement)[::-1] + a2) for a1, a2 in adapters]
    return out


def normalize_orientation(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Turns merged reads of reverse barcodes."""
    back = F.col("orientation") == "reverse"
    return df.withColumns({seq: F.when(back, reverse_complement(seq)).otherwise(F.col(seq)), qual: F.when(back, F.reverse(qual)).otherwise(F.col(qual))})


def barcode_comment(header: Column | str, barcodes: list[Barcode]) -> Column:
    """The header with ` BC:` and the barcodes of its sample and barcode index."""
    header = F.col(header) if isinstance(header, str) else header
    samples = sorted({b.sample for b in barcodes})
    out = header
    for s, name in enumerate(samples):
        for i, b in enumerate([b for b in barcodes if b.sample == name]):
            text = f" BC:{b.bc1}" + (f"-{b.bc2}" if b.bc2 else "")
            out = F.when((F.col("sample_idx") == s) & (F.col("barcode_idx") == i), F.concat(header, F.lit(text))).otherwise(out)
    return out
