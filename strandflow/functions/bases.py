"""Column functions on sequences, quality strings and read names.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRED_OFFSET = 33


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_bases(seq, mask_degenerate: bool = False, convert_uracils: bool = False) -> Column:
    """Upper case, dots as N, on request IUPAC codes as N and U as T; anything else but ACGTN raises an error."""
    source, target = "acgtn.", "ACGTNN"
    if mask_degenerate:
        source, target = source + "bdhkmrsvwyBDHKMRSVWY", target + "N" * 20
    if convert_uracils:
        source, target = source + "uU", target + "TT"
    out = F.translate(col(seq), source, target)
    bad = F.concat(F.lit("invalid nucleotides in sequence: "), col(seq))
    # Most reads are as they should be, and a translation goes through a map letter by letter.
    return F.when(col(seq).rlike("^[ACGTN]*$"), col(seq)).when(out.rlike("^[ACGTN]*$"), out).otherwise(F.raise_error(bad).cast("string"))


def _shifted(source: list[int], target: list[int]) -> tuple[str, str]:
    return "".join(map(chr, source)), "".join(map(chr, target))


def decode_quality(qual, encoding: str = "33") -> Column:
    """Phred+33 quality strings from encodings 33 (scores 0 to 45), sam (0 to 93), 64 and solexa; other characters raise an error."""
    q = col(qual)
    if encoding == "33":
        valid, out = "^[!-N]*$", q
    elif encoding == "sam":
        valid, out = "^[!-~]*$", q
    elif encoding == "64":
        codes = list(range(64, 127))
        valid, out = "^[@-~]*$", F.translate(q, *_shifted(codes, [c - 31 for c in codes]))
    elif encoding == "solexa":
        codes = list(range(59, 105))
        valid, out = "^[;-h]*$", F.translate(q, *_shifted(codes, [solexa_to_phred(c - 64) + 33 for c in codes]))
    else:
        raise ValueError(f"unknown quality encoding {encoding!r}")
    return F.when(q.rlike(valid), out).otherwise(F.raise_error(F.concat(F.lit("invalid quality scores: "), q)).cast("string"))


def solexa_to_phred(score: int) -> int:
    """The Phred score of a Solexa score: both are logarithms, of p and of p / (1 - p)."""
    import math

    return int(math.floor(10 * math.log10(1 + 10 ** (score / 10)) + 0.5))


def phred_to_p(score) -> Column:
    return F.pow(F.lit(10.0), col(score) / F.lit(-10.0))


def p_to_phred(p) -> Column:
    return F.log10(col(p)) * F.lit(-10.0)


def p_to_phred_33(p) -> Column:
    """The quality character of an error probability, of 5e-10 at least and capped at ~."""
    score = F.round(p_to_phred(F.greatest(col(p), F.lit(5e-10))))
    return F.chr(F.least(score, F.lit(93.0)).cast("long") + PHRED_OFFSET)


def complement(seq) -> Column:
    return F.translate(col(seq), "ACGT", "TGCA")


def reverse_complement(seq) -> Column:
    return F.reverse(complement(seq))


def truncate(text, start, length=None) -> Column:
    """The part of a sequence or quality string from a 0-based start; less than nothing is nothing."""
    start = start if isinstance(start, Column) else F.lit(start)
    if length is None:
        return F.substring(col(text), start + 1, F.length(col(text)))
    length = length if isinstance(length, Column) else F.lit(length)
    return F.substring(col(text), start + 1, F.greatest(length, F.lit(0)))


def count_char(text, char: str) -> Column:
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit(char), F.lit("")))


def count_ns(seq) -> Column:
    return count_char(seq, "N")


def quality_sum(qual) -> Column:
    """The sum of a quality string's scores: every character's code is its one UTF-8 byte."""
    codes = F.transform(F.split(col(qual), ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x) - F.length(col(qual)) * PHRED_OFFSET


def mean_quality(qual) -> Column:
    """The mean score; null for an empty read."""
    return F.when(F.length(col(qual)) > 0, quality_sum(qual) / F.length(col(qual)))


def complexity(seq) -> Column:
    """Changes between neighbouring called bases over length - 1; 0 for reads shorter than 2."""
    called = F.replace(col(seq), F.lit("N"), F.lit(""))
    for base in "ACGT":
        called = F.regexp_replace(called, f"{base}+", base)
    changes = F.greatest(F.length(called) - 1, F.lit(0))
    return F.when(F.length(col(seq)) < 2, F.lit(0.0)).otherwise(changes / (F.length(col(seq)) - 1))


def read_name(header, separator: str = "") -> Column:
    """struct<name, mate, meta> of a header with its @.  The mate is 1 or 2 after the separator, else empty."""
    body = F.substring(col(header), F.lit(2), F.length(col(header)))
    first = F.substring_index(body, " ", 1)
    meta = F.substring(body, F.length(first) + 2, F.length(body))
    if not separator:
        return F.struct(first.alias("name"), F.lit("").alias("mate"), meta.alias("meta"))
    tail = F.right(first, F.lit(2))
    mate = F.when(tail.isin(f"{separator}1", f"{separator}2") & (F.length(first) >= 2), F.right(first, F.lit(1))).otherwise(F.lit(""))
    name = F.when(mate != "", F.substring(first, F.lit(1), F.length(first) - 2)).otherwise(first)
    return F.struct(name.alias("name"), mate.alias("mate"), meta.alias("meta"))


def add_prefix(header, prefix: str) -> Column:
    return F.concat(F.lit("@" + prefix), F.substring(col(header), F.lit(2), F.length(col(header))))


def normalize_mate(header, mate: str, separator_in: str, separator_out: str) -> Column:
    """Replaces the mate separator, or adds separator and number where the name has none."""
    parts = read_name(header, separator_in)
    ending = F.when(parts["mate"] != "", parts["mate"]).otherwise(F.lit(mate))
    if not separator_out:
        ending = F.lit("")
    meta = F.when(parts["meta"] != "", F.concat(F.lit(" "), parts["meta"])).otherwise(F.lit(""))
    return F.concat(F.lit("@"), parts["name"], F.lit(separator_out), ending, meta)


def strip_mate(header, separator: str) -> Column:
    """The header of a merged read: without separator and mate number."""
    return F.when(F.lit(separator == ""), col(header)).otherwise(normalize_mate(header, "", separator, ""))


def valid_sam_name(name) -> Column:
    return (F.length(col(name)) <= 254) & col(name).rlike("^[!-?A-~]+$")


#: Instrument names of two-colour chemistry: a prefix and how many digits follow before the colon.  Fixed values.
TWO_COLOR = [("A", 5), ("ADX", 5), ("FS", 8), ("LH", 5), ("LL", 5), ("MN", 5), ("NB", 6), ("NDX", 6), ("NL", 6), ("NS", 6), ("SH", 5),
             ("SL", 5), ("VH", 5), ("VL", 5)]


def is_two_color(header) -> Column:
    names = "|".join(f"{p}[0-9]{{{n}}}" for p, n in TWO_COLOR)
    return col(header).rlike(f"^@({names}):")
