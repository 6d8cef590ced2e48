"""NumPy kernels over batches of reads, and the Arrow functions that make column expressions of them.

A batch of strings is a matrix of bytes, one row a read, so that every step works on one position of all reads at once.
Only what built-in functions can't express comes here.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N, A, C, G, T = (ord(c) for c in "NACGT")
QUALITY_OFFSET = 33


def as_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes laid end to end, offsets) of ASCII strings; a null is empty."""
    strings = pa.concat_arrays(strings.chunks) if isinstance(strings, pa.ChunkedArray) else strings
    strings = strings.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]] if len(offsets) else flat, offsets - (offsets[0] if len(offsets) else 0)


def matrix(strings: pa.Array, fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest bytes, lengths), filled up at the right."""
    flat, offsets = as_bytes(strings)
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width), lengths
    out = np.full((len(lengths), width), fill, np.uint8)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = flat
    return out, lengths


def strings(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given part of every row."""
    lengths = np.maximum(lengths, 0)
    columns = np.arange(rows.shape[1])
    inside = (columns >= starts[:, None]) & (columns < (starts + lengths)[:, None])
    data = rows[inside]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def struct(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


# ---- quality trimming -------------------------------------------------------------------------------------------------

SCALE = 2.0**48
#: Reads that are worked on at once, so that what is made of them stays in the processor's cache.
BLOCK = 2048


def mott_spans(seq: np.ndarray, qual: np.ndarray, lengths: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Kept span [left, right) of every read: the segment with the largest sum of limit - error, in integers of 2^-48.

    With prefix sums S the right end is the first place where S exceeds its least value so far by most, the left end the
    first place of that least value.  Scores below 3 and Ns count as 3.  No positive segment keeps nothing: (0, 0).
    """
    errors = np.trunc(10.0 ** (np.maximum(np.arange(256) - QUALITY_OFFSET, 3) / -10.0) * SCALE).astype(np.int64)
    gains = np.int64(np.trunc(limit * SCALE)) - errors
    left, right = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for at in range(0, len(lengths), BLOCK // 4):
        rows = slice(at, at + BLOCK // 4)
        left[rows], right[rows] = _mott_block(seq[rows], qual[rows], lengths[rows], gains)
    return left, right


def _mott_block(seq: np.ndarray, qual: np.ndarray, lengths: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gain = gains[np.where(seq == N, 0, qual)]
    gain[np.arange(seq.shape[1]) >= lengths[:, None]] = 0
    sums = np.zeros((len(lengths), seq.shape[1] + 1), np.int64)
    np.cumsum(gain, axis=1, out=sums[:, 1:])
    least = np.minimum.accumulate(sums, axis=1)
    over = sums - least
    right = over.argmax(axis=1)
    rows = np.arange(len(lengths))
    left = (sums == least[rows, right][:, None]).argmax(axis=1)
    none = over[rows, right] <= 0
    return np.where(none, 0, left), np.where(none, 0, right)


def window_spans(seq: np.ndarray, qual: np.ndarray, lengths: np.ndarray, size: float, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept span of every read by a sliding window; (length, length) where no window is good.

    The left end is the first good base whose window's mean is above the threshold; from there the right end is the
    first window with a mean that isn't, or the last window, extended over good bases.
    """
    n, width = seq.shape
    rows, columns = np.arange(n), np.arange(width)
    wide = np.floor(size * lengths if size < 1 else np.full(n, size)).astype(np.int64)
    wide = np.where((wide == 0) | (wide > lengths), lengths, wide)
    inside = columns < lengths[:, None]
    good = inside & (qual.astype(np.int64) > threshold + QUALITY_OFFSET) & (seq != N)
    sums = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(np.where(inside, qual, 0).astype(np.int64), axis=1)], axis=1)
    end = np.minimum(columns + wide[:, None], width)
    is_window = columns + wide[:, None] <= lengths[:, None]
    means = (np.take_along_axis(sums, end, axis=1) - sums[:, :-1]) // np.maximum(wide, 1)[:, None]
    high = is_window & (means > threshold + QUALITY_OFFSET)
    starts = good & high
    found = starts.any(axis=1) if width else np.zeros(n, bool)
    left = np.where(found, starts.argmax(axis=1) if width else 0, lengths)
    stop = is_window & (columns >= left[:, None]) & (~high | (columns + wide[:, None] == lengths[:, None]))
    right = stop.argmax(axis=1) if width else np.zeros(n, np.int64)
    # The next base that isn't good, from the right end on.
    bad = np.where(good, width, columns)
    after = np.minimum.accumulate(bad[:, ::-1], axis=1)[:, ::-1] if width else bad
    right = np.where(found, np.minimum(after[rows, np.minimum(right, max(width - 1, 0))], lengths), lengths) if width else right
    return left, right


def base_spans(seq: np.ndarray, qual: np.ndarray, lengths: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """From the first to the last base that is called and above the threshold; (0, 0) where there is none."""
    good = (qual > threshold + QUALITY_OFFSET) & (seq != N)
    if not good.shape[1]:
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    found = good.any(axis=1)
    return np.where(found, good.argmax(axis=1), 0), np.where(found, good.shape[1] - good[:, ::-1].argmax(axis=1), 0)


#: A tail holds at most one other base in so many called ones, and the search ends once it has lost more than LOST.
PER_MISMATCH, LOST = 8, 5


def polyx_tails(seq: np.ndarray, lengths: np.ndarray, base: int, least: int) -> np.ndarray:
    """Length of every read's tail of one base, mismatches and Ns in it included, or 0.

    All positions are counted from the 3' end.  S adds one for the base and takes one off for any other called base.  A position of
    the base can end a tail if at most one in PER_MISMATCH called bases up to it differs.  The search ends at the first
    other base where S is more than LOST below the best S of such an end (or 0) so far; of the ends before, the
    farthest with the largest S is the tail's, if that isn't negative.  Ns that follow it within the search belong to it.
    """
    n, width = seq.shape
    if not width:
        return np.zeros(n, np.int64)
    rows, steps = np.arange(n), np.arange(1, width + 1)
    inside = steps <= lengths[:, None]
    back = np.where(inside, seq[rows[:, None], np.maximum(lengths[:, None] - steps, 0)], 0)
    match, unknown = back == base, back == N
    other = inside & ~match & ~unknown
    called = np.cumsum(match | other, axis=1, dtype=np.int32)
    differ = np.cumsum(other, axis=1, dtype=np.int32)
    total = called - 2 * differ
    ends = match & (PER_MISMATCH * differ <= called)
    best = np.maximum(np.maximum.accumulate(np.where(ends, total, 0), axis=1), 0)
    lost = other & (best - total > LOST)
    searched = np.where(lost.any(axis=1), lost.argmax(axis=1) + 1, lengths)
    value = np.where(ends & (steps <= searched[:, None]), total, -1)
    # The last of the largest: the first one seen from the other end.
    tail = width - value[:, ::-1].argmax(axis=1)
    tail = np.where(value[rows, tail - 1] >= 0, tail, 0)
    stays = (steps <= tail[:, None]) | (unknown & (steps <= searched[:, None]))
    whole = np.where(stays.all(axis=1), width, (~stays).argmax(axis=1))
    held = np.where(tail > 0, called[rows, tail - 1], 0)
    pure = np.where(tail > 0, differ[rows, tail - 1], 0) == 0
    # One called base short of the threshold is enough where none differs and more was searched.
    nearly = pure & (held + 1 == least) & (held < searched) & (held + 1 >= PER_MISMATCH)
    return np.where((lengths >= least) & ((held >= least) | nearly), whole, 0)


# ---- alignment --------------------------------------------------------------------------------------------------------


def allowed_mismatches(aligned: np.ndarray, rate: float) -> np.ndarray:
    most = np.floor(rate * aligned).astype(np.int64)
    most = np.where(aligned < 10, np.minimum(most, 1), most)
    return np.where(aligned < 6, 0, most)


class Best:
    """The best alignment so far of every read: by score, then length, then fewer ambiguous columns; the first wins ties.

    What is compared is one number a read: score, length and the columns that aren't ambiguous as its digits, of which base - 1
    stands for no alignment.  Scores below 0 and lengths of 0 never exceed it.
    """

    def __init__(self, n: int, most: int = 0):
        self.score, self.length, self.ambiguous, self.mismatches, self.offset = (np.zeros(n, np.int64) for _ in range(5))
        self.adapter = np.full(n, -1, np.int64)
        self._base = 1 << int(most + 1).bit_length()
        self._type = np.int32 if self._base <= 1 << 9 else np.int64
        self._key, self._which = np.full(n, self._base - 1, self._type), np.full(n, -1, np.int32)
        self._tried: list[tuple[int, int]] = []

    def offer(self, adapter: int, offset: int, length, aligned, mismatches, valid=None) -> None:
        """length: columns, aligned: those without an unknown base; numbers or arrays."""
        m, kind = self._base, self._type
        key = np.multiply(aligned, m * m + 1, dtype=kind)
        key -= np.multiply(mismatches, 2 * m * m, dtype=kind)
        key += (np.asarray(length) * (m - 1) + (m - 1)).astype(kind)
        if valid is not None:
            key[~valid] = -1
        better = key > self._key
        np.copyto(self._which, len(self._tried), where=better)
        np.maximum(self._key, key, out=self._key)
        self._tried.append((adapter, offset))

    def settle(self) -> Best:
        found = np.flatnonzero(self._which >= 0)
        if len(found):
            m, key = self._base, self._key[found].astype(np.int64)
            score, length, ambiguous = key // (m * m), key // m % m, m - 1 - key % m
            tried = np.array(self._tried, np.int64)[self._which[found]]
            for name, value in (("score", score), ("length", length), ("ambiguous", ambiguous), ("mismatches", (length - ambiguous - score) // 2),
                                ("adapter", tried[:, 0]), ("offset", tried[:, 1])):
                getattr(self, name)[found] = value
        return self


FIELDS = ("score", "length", "ambiguous", "mismatches", "offset", "adapter")


def _blocks(n: int, align) -> Best:
    """The alignments that align(rows) gives for blocks of rows, put together again."""
    best = Best(n)
    for at in range(0, n, BLOCK):
        rows = slice(at, at + BLOCK)
        got = align(rows)
        for name in FIELDS:
            getattr(best, name)[rows] = getattr(got, name)
    return best


class Planes:
    """Bases as bits, 64 columns a word: planes of the base's number, and last one of the columns that hold a known base.

    Two rows are compared in all columns with an exclusive or and two ands, and counted by the bits that are left.
    """

    def __init__(self, *texts: np.ndarray):
        self.table = self._of(b"ACGT")
        if any((self.table[t] == 255).any() for t in texts):
            self.table = self._of(bytes(set().union(*(np.unique(t).tolist() for t in texts)) - {0, N}))

    def _of(self, letters: bytes) -> np.ndarray:
        self.bits = max(1, (len(letters) - 1).bit_length())
        table = np.full(256, 255, np.uint16)
        table[[0, N]] = 0
        for i, c in enumerate(letters):
            table[c] = i | 1 << self.bits
        return table

    def rows(self, text: np.ndarray) -> np.ndarray:
        """(planes, words and one that is empty, rows)"""
        n, width = text.shape
        words = -(-width // 64)
        numbers = self.table[text]
        out = np.zeros((self.bits + 1, words + 1, n), np.uint64)
        for i in range(self.bits + 1):
            packed = np.zeros((n, words * 8), np.uint8)
            packed[:, :-(-width // 8)] = np.packbits(numbers & (1 << i) != 0, axis=1, bitorder="little")
            out[i, :words] = packed.view("<u8").T
        return out

    def one(self, text: bytes) -> list[int]:
        """The planes of one text as numbers of any size."""
        numbers = self.table[np.frombuffer(text, np.uint8)]
        return [sum(1 << at for at, v in enumerate(numbers.tolist()) if v >> i & 1) for i in range(self.bits + 1)]


def _total(bits: np.ndarray) -> np.ndarray:
    """Bits that are set in all words of every row; of more than three words the sum may exceed a byte."""
    counts = np.bitwise_count(bits)
    return counts[0] if len(counts) == 1 else counts.sum(axis=0, dtype=np.uint8 if len(counts) <= 3 else np.int32)


def _same(values: np.ndarray):
    """The one value of an array that holds no other, else the array."""
    return int(values[0]) if len(values) and (values == values[0]).all() else values


def align_single(seq: np.ndarray, lengths: np.ndarray, adapters: list[bytes], shift: int) -> Best:
    """Adapters against reads without gaps, from -shift to the last base."""
    adapters = [(k, a) for k, a in enumerate(adapters) if a and a not in adapters[:k]]
    if not adapters:
        return Best(len(lengths))
    planes = Planes(seq, *(np.frombuffer(a, np.uint8) for _, a in adapters))
    coded = [(k, len(a), planes.one(a)) for k, a in adapters]
    return _blocks(len(lengths), lambda rows: _single_block(planes, seq[rows], lengths[rows], coded, shift))


def _single_block(planes: Planes, seq: np.ndarray, lengths: np.ndarray, adapters: list[tuple[int, int, list[int]]], shift: int) -> Best:
    width = seq.shape[1]
    *codes, known = planes.rows(seq)
    best, lengths = Best(len(seq), width), _same(lengths)
    word = (1 << 64) - 1
    for k, size, own in adapters:
        for offset in range(-min(shift, size - 1), width):
            lo, skip = max(offset, 0), max(-offset, 0)
            if min(width - lo, size - skip) <= 0:
                continue
            # The adapter is moved, not the reads: its words are numbers.
            there = [b >> skip << lo for b in own]
            aligned, wrong = 0, 0
            for w in range(lo // 64, -(-min(width, lo + size - skip) // 64)):
                *mine, inside = (np.uint64(b >> 64 * w & word) for b in there)
                both = known[w] & inside
                differ = codes[0][w] ^ mine[0]
                for c, m in zip(codes[1:], mine[1:]):
                    differ |= c[w] ^ m
                differ &= both
                aligned, wrong = aligned + np.bitwise_count(both).astype(np.int32), wrong + np.bitwise_count(differ).astype(np.int32)
            best.offer(k, offset, np.clip(lengths - lo, 0, size - skip), aligned, wrong)
    return best.settle()


def align_pair(seq1: np.ndarray, n1: np.ndarray, rc2: np.ndarray, n2: np.ndarray, pairs: list[tuple[bytes, bytes]], shift: int) -> Best:
    """Mates against each other, adapters at their far ends: a2 + r1 against rc(r2) + a1, pairs (a1, stored a2).

    Offsets of -length(r2) and more are of rc(r2) against r1.  Offsets beyond the start of r1 are tried with the first
    pair only, as adapters have no part in them.  Without adapters the reads must overlap end to end.
    """
    planes = Planes(seq1, rc2, *(np.frombuffer(a, np.uint8) for pair in pairs for a in pair))
    return _blocks(len(n1), lambda rows: _pair_block(planes, seq1[rows], n1[rows], rc2[rows], n2[rows], pairs, shift))


def _pair_block(planes: Planes, seq1: np.ndarray, n1: np.ndarray, rc2: np.ndarray, n2: np.ndarray, pairs: list[tuple[bytes, bytes]], shift: int) -> Best:
    n = len(n1)
    most = max((len(a) for pair in pairs for a in pair), default=0) + max(seq1.shape[1], rc2.shape[1])
    best = Best(n, most)
    for k, (a1, a2) in enumerate(pairs or [(b"", b"")]):
        left, right = np.frombuffer(a2, np.uint8), np.frombuffer(a1, np.uint8)
        s1 = np.concatenate([np.broadcast_to(left, (n, len(left))), seq1], axis=1)
        # rc(r2) + a1 has a1 right behind each read's own end.
        s2 = np.zeros((n, rc2.shape[1] + len(right)), np.uint8)
        s2[:, :rc2.shape[1]] = rc2
        at = n2[:, None] + np.arange(len(right))
        np.put_along_axis(s2, at, np.broadcast_to(right, (n, len(right))), axis=1)
        m1, m2 = n1 + len(left), n2 + len(right)
        low = np.maximum(len(left) - n2 - shift, 1 - m2) if pairs else n1 - np.minimum(n1, n2)
        high = (m1 if k == 0 else np.minimum(m1, len(left))) - 1
        width1, width2 = s1.shape[1], s2.shape[1]
        x, y = planes.rows(s1), planes.rows(s2)
        moved, rest = (np.empty((len(x), max(x.shape[1], y.shape[1]), n), np.uint64) for _ in range(2))
        first, last, sure = int(low.min()), int(high.max()), (int(low.max()), int(high.min()))
        m1, m2 = _same(m1), _same(m2)
        for offset in range(first, last + 1):
            lo, skip = max(offset, 0), max(-offset, 0)
            wide = min(width1 - lo, width2 - skip)
            if wide <= 0:
                continue
            words = -(-wide // 64)
            p, q = _moved(x, lo, words, moved, rest), _moved(y, skip, words, moved, rest)
            both = p[-1] & q[-1]
            differ = p[0] ^ q[0]
            for i in range(1, len(p) - 1):
                differ |= p[i] ^ q[i]
            differ &= both
            valid = None if sure[0] <= offset <= sure[1] else (offset >= low) & (offset <= high)
            best.offer(k, offset - len(left), np.maximum(np.minimum(m1 - lo, m2 - skip), 0), _total(both), _total(differ), valid)
    return best.settle()


def _moved(planes: np.ndarray, by: int, words: int, out: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """So many words of the planes from column `by` on; only one of two that are compared is moved."""
    word, bit = divmod(by, 64)
    if not bit:
        return planes[:, word:word + words]
    # Words end with one that is empty, so there is a next one.
    out, rest = out[:, :words], rest[:, :words]
    np.right_shift(planes[:, word:word + words], np.uint64(bit), out=out)
    np.left_shift(planes[:, word + 1:word + 1 + words], np.uint64(64 - bit), out=rest)
    return np.bitwise_or(out, rest, out=out)


# ---- merging ----------------------------------------------------------------------------------------------------------


def merge(seq1, qual1, n1, rc2, rq2, n2, offset, additive: bool, most: int) -> dict:
    """Consensus of truncated mates: r1, then what rc(r2) has beyond it; in the overlap the better base.

    Returns rows of bases and qualities, lengths, and the counts of resolved and unresolved mismatches and of resolved Ns.
    """
    total = n1 + np.maximum(n2 - (n1 - np.maximum(offset, 0)), 0)
    n, width = len(n1), int(total.max(initial=0))
    out = {"seq": np.zeros((n, width), np.uint8), "qual": np.zeros((n, width), np.uint8), "length": total, **{c: np.zeros(n, np.int64) for c in ("resolved", "unresolved", "ns")}}
    for at in range(0, n, BLOCK // 4):
        rows = slice(at, at + BLOCK // 4)
        got = _merge_block(seq1[rows], qual1[rows], n1[rows], rc2[rows], rq2[rows], n2[rows], np.maximum(offset[rows], 0), total[rows], additive, most)
        for name in ("seq", "qual"):
            out[name][rows, :got[name].shape[1]] = got[name]
        for name in ("resolved", "unresolved", "ns"):
            out[name][rows] = got[name]
    return out


def _merge_block(seq1, qual1, n1, rc2, rq2, n2, start, total, additive: bool, most: int) -> dict:
    width = int(total.max(initial=0))
    columns = np.arange(width, dtype=np.int32)
    held = min(width, seq1.shape[1])
    b1, q1 = np.zeros((len(n1), width), np.uint8), np.zeros((len(n1), width), np.int16)
    b1[:, :held], q1[:, :held] = seq1[:, :held], qual1[:, :held]
    i2 = columns - start[:, None].astype(np.int32)
    in1, in2 = columns < n1[:, None], (i2 >= 0) & (i2 < n2[:, None])
    if rc2.shape[1]:
        np.clip(i2, 0, rc2.shape[1] - 1, out=i2)
        i2 += (np.arange(len(n1), dtype=np.int32) * rc2.shape[1])[:, None]
        b2, q2 = rc2.ravel().take(i2), rq2.ravel().take(i2).astype(np.int16)
    else:
        b2, q2 = np.zeros_like(b1), np.zeros_like(q1)
    q1 -= QUALITY_OFFSET
    q2 -= QUALITY_OFFSET
    both = in1 & in2
    un1, un2 = b1 == N, b2 == N
    base, score = np.where(in1, b1, b2), np.where(in1, q1, q2)
    called = both & ~un1 & ~un2
    differ = called & (b1 != b2)
    np.copyto(score, np.minimum(most, q1 + q2) if additive else np.maximum(q1, q2), where=called & ~differ, casting="unsafe")
    np.copyto(base, b2, where=differ & (q2 > q1))
    np.copyto(score, np.abs(q1 - q2), where=differ)
    tie = differ & (q1 == q2)
    np.copyto(base, N, where=tie)
    one = both & (un1 ^ un2)
    np.copyto(base, b2, where=one & un1)
    np.copyto(score, q2, where=one & un1)
    np.copyto(score, 0, where=tie | both & un1 & un2)
    # Columns beyond a merged read are in neither mate, so there is nothing to count there.
    count = lambda x: np.count_nonzero(x, axis=1)
    return {"seq": base, "qual": (score + QUALITY_OFFSET).astype(np.uint8), "resolved": count(differ & ~tie), "unresolved": count(tie), "ns": count(one)}


COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[[A, C, G, T]] = [T, G, C, A]


def reverse_rows(rows: np.ndarray, lengths: np.ndarray, complement: bool) -> np.ndarray:
    at = np.clip(lengths[:, None] - 1 - np.arange(rows.shape[1]), 0, max(rows.shape[1] - 1, 0))
    out = np.take_along_axis(rows, at, axis=1) if rows.shape[1] else rows.copy()
    out = COMPLEMENT[out] if complement else out
    out[np.arange(rows.shape[1]) >= lengths[:, None]] = 0
    return out


# ---- counting ---------------------------------------------------------------------------------------------------------


def count_positions(batches):
    """Batches of keys, seq and qual -> keys, pos, nuc, n and q_sum, one row for every combination that a batch holds."""
    for batch in batches:
        *keys, seq, qual = batch.columns
        (s, lengths), (q, _) = matrix(seq), matrix(qual)
        n, width = s.shape
        if not s.size:
            continue
        group, first = np.zeros(n, np.int64), np.zeros(1, np.int64)
        if keys:
            codes = np.stack([k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys], axis=1)
            _, first, group = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        letters = np.flatnonzero(np.bincount(s.ravel(), minlength=256)[1:]) + 1
        code = np.zeros(256, np.int64)
        code[letters] = np.arange(len(letters))
        place = (group.reshape(-1, 1) * width + np.arange(width)) * len(letters) + code[s]
        inside = np.arange(width) < lengths[:, None]
        place, scores = place[inside], q[inside].astype(np.float64) - QUALITY_OFFSET
        counts, sums = np.bincount(place), np.bincount(place, scores)
        at = np.flatnonzero(counts)
        owner, pos, nuc = first[at // (width * len(letters))], at // len(letters) % width, letters[at % len(letters)]
        out = [k.take(pa.array(owner)) for k in keys] + [pa.array(pos.astype(np.int32)), pa.array([chr(c) for c in nuc], pa.string()), pa.array(counts[at].astype(np.int64)),
                                                         pa.array(sums[at].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-2], "pos", "nuc", "n", "q_sum"])


# ---- column expressions -----------------------------------------------------------------------------------------------


def once(f):
    """A function whose calls Spark doesn't repeat: it would write the call of a column into every filter and step that reads it."""
    return f.asNondeterministic()


def span_column(kind: str, seq, qual, **options) -> Column:
    """struct<left int, right int>, the kept span of reads by Mott's, the window's or the per-base rule."""
    rule = {"mott": mott_spans, "window": window_spans, "per-base": base_spans}[kind]

    @once
    @F.arrow_udf("left int, right int")
    def spans(seq: pa.Array, qual: pa.Array) -> pa.Array:
        s, n = matrix(seq)
        q, _ = matrix(qual)
        left, right = rule(s, q, n, **options)
        return struct(left=left.astype(np.int32), right=right.astype(np.int32))

    return spans(seq, qual)


def polyx_column(seq, bases: str, threshold: int) -> Column:
    """struct<base string, n int>: the longest tail of one of the bases; the first in the order A, C, G, T wins ties."""
    bases = "".join(b for b in "ACGT" if b in bases)

    @once
    @F.arrow_udf("base string, n int")
    def tails(seq: pa.Array) -> pa.Array:
        s, n = matrix(seq)
        best, which = np.zeros(len(n), np.int64), np.full(len(n), "N", object)
        for b in bases:
            tail = polyx_tails(s, n, ord(b), threshold)
            which[tail > best] = b
            best = np.maximum(best, tail)
        return struct(base=pa.array(which, pa.string()), n=best.astype(np.int32))

    return tails(seq)


ALIGNMENT = "adapter_id int, offset int, length int, n_mismatches int, n_ambiguous int, score int"


def _alignment(best: Best) -> pa.StructArray:
    return struct(adapter_id=best.adapter.astype(np.int32), offset=best.offset.astype(np.int32), length=best.length.astype(np.int32),
                  n_mismatches=best.mismatches.astype(np.int32), n_ambiguous=best.ambiguous.astype(np.int32), score=best.score.astype(np.int32))


def _by_group(groups: np.ndarray, align) -> Best:
    """The alignments that align(group, rows) gives for the rows of every group, put together again."""
    best = Best(len(groups))
    for group in np.unique(groups):
        rows = np.flatnonzero(groups == group)
        got = align(int(group), rows)
        for name in FIELDS:
            getattr(best, name)[rows] = getattr(got, name)
    return best


def align_single_column(seq, adapters: list[str], shift: int, group=None, by_group: dict[int, list[str]] | None = None) -> Column:
    """by_group: the adapters of reads by the number in `group`, for those that have one there."""
    codes = [a.encode() for a in adapters]
    own = {k: [a.encode() for a in v] for k, v in (by_group or {}).items()}

    @once
    @F.arrow_udf(ALIGNMENT)
    def align(seq: pa.Array) -> pa.Array:
        return _alignment(align_single(*matrix(seq), codes, shift))

    @once
    @F.arrow_udf(ALIGNMENT)
    def align_groups(seq: pa.Array, group: pa.Array) -> pa.Array:
        s, n = matrix(seq)
        return _alignment(_by_group(group.fill_null(-1).to_numpy(zero_copy_only=False), lambda g, rows: align_single(s[rows], n[rows], own.get(g, codes), shift)))

    return align(seq) if group is None else align_groups(seq, group)


def align_pair_column(seq1, rc2, pairs: list[tuple[str, str]], shift: int, group=None, by_group: dict[int, list[tuple[str, str]]] | None = None) -> Column:
    codes = [(a.encode(), b.encode()) for a, b in pairs]
    own = {k: [(a.encode(), b.encode()) for a, b in v] for k, v in (by_group or {}).items()}

    @once
    @F.arrow_udf(ALIGNMENT)
    def align(seq1: pa.Array, rc2: pa.Array) -> pa.Array:
        return _alignment(align_pair(*matrix(seq1), *matrix(rc2), codes, shift))

    @once
    @F.arrow_udf(ALIGNMENT)
    def align_groups(seq1: pa.Array, rc2: pa.Array, group: pa.Array) -> pa.Array:
        (s1, n1), (s2, n2) = matrix(seq1), matrix(rc2)
        return _alignment(_by_group(group.fill_null(-1).to_numpy(zero_copy_only=False),
                                    lambda g, rows: align_pair(s1[rows], n1[rows], s2[rows], n2[rows], own.get(g, codes), shift)))

    return align(seq1, rc2) if group is None else align_groups(seq1, rc2, group)


def merge_column(seq1, qual1, rc2, rq2, offset, strategy: str, most: int) -> Column:
    @once
    @F.arrow_udf("seq string, qual string, resolved int, unresolved int, ns_resolved int")
    def consensus(seq1: pa.Array, qual1: pa.Array, rc2: pa.Array, rq2: pa.Array, offset: pa.Array) -> pa.Array:
        (s1, n1), (q1, _), (s2, n2), (q2, _) = matrix(seq1), matrix(qual1), matrix(rc2), matrix(rq2)
        got = merge(s1, q1, n1, s2, q2, n2, offset.to_numpy(zero_copy_only=False).astype(np.int64), strategy == "additive", most)
        zero = np.zeros(len(n1), np.int64)
        return struct(seq=strings(got["seq"], zero, got["length"]), qual=strings(got["qual"], zero, got["length"]),
                      resolved=got["resolved"].astype(np.int32), unresolved=got["unresolved"].astype(np.int32), ns_resolved=got["ns"].astype(np.int32))

    return consensus(seq1, qual1, rc2, rq2, offset)
