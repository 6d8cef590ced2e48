"""Kernels against plain loops that follow the rules step by step."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandflow.operators import kernels as k

R = random.Random(5)


def reads(n=300, most=40, letters="ACGTN"):
    out = [("", "")]
    for _ in range(n):
        size = R.randint(0, most)
        out.append(("".join(R.choice(letters) for _ in range(size)), "".join(chr(33 + R.randint(0, 41)) for _ in range(size))))
    return out


def matrices(rows):
    s, n = k.matrix(pa.array([a for a, _ in rows]))
    q, _ = k.matrix(pa.array([b for _, b in rows]))
    return s, q, n


def mott_loop(seq, qual, limit):
    best, span, total, start = 0, (0, 0), 0, 0
    for i, (b, c) in enumerate(zip(seq, qual)):
        score = max(3, 0 if b == "N" else ord(c) - 33)
        total += int(limit * 2**48) - int(10 ** (score / -10) * 2**48)
        if total < 0:
            total, start = 0, i + 1
        if total > best:
            best, span = total, (start, i + 1)
    return span


@pytest.mark.parametrize("limit", [0.01, 0.05, 0.3])
def test_mott(limit):
    rows = reads()
    left, right = k.mott_spans(*matrices(rows), limit)
    assert [(int(a), int(b)) for a, b in zip(left, right)] == [mott_loop(s, q, limit) for s, q in rows]


def window_loop(seq, qual, size, threshold):
    n = len(seq)
    wide = int(size * n) if size < 1 else int(size)
    wide = n if wide == 0 or wide > n else wide
    good = [ord(c) - 33 > threshold and b != "N" for b, c in zip(seq, qual)]
    left = None
    for at in range(n - wide + 1 if n else 0):
        high = sum(map(ord, qual[at:at + wide])) // wide > threshold + 33
        if left is None and good[at] and high:
            left = at
        if left is not None and (not high or at + wide == n):
            while at < n and good[at]:
                at += 1
            return left, at
    return n, n


@pytest.mark.parametrize("size,threshold", [(0.1, 10), (5, 15), (0.5, 20), (100, 18)])
def test_window(size, threshold):
    rows = reads()
    left, right = k.window_spans(*matrices(rows), size, threshold)
    got = [(int(a), int(b)) for a, b in zip(left, right)]
    wanted = [window_loop(s, q, size, threshold) for s, q in rows]
    assert [(a, max(a, b)) for a, b in got] == [(a, max(a, b)) for a, b in wanted]


def test_polyx_examples():
    # Read, threshold, tail of Ts.
    cases = [("", 10, 0), ("ACGTTTTTTTTTT", 10, 10), ("ACGTTTTTTTTT", 10, 9), ("ACGTTTTTTTT", 10, 0), ("TTTTTTTTTTTTTTTT", 10, 16), ("AAAAAAAAAAAAA", 10, 0),
             ("ACGTTTTTTTTTTN", 10, 11), ("ACGNNTTTTTTTTTT", 10, 12)]
    for seq, least, tail in cases:
        s, n = k.matrix(pa.array([seq]))
        assert int(k.polyx_tails(s, n, ord("T"), least)[0]) == tail, seq


def polyx_rule(seq, base, least):
    """The rule of the tail, every score counted anew from the two places it lies between."""
    back = seq[::-1]

    def score(start, end):
        return sum(1 if b == base else -1 if b != "N" else 0 for b in back[start:end])

    def share_ok(end):
        called = [b for b in back[:end] if b != "N"]
        return 8 * sum(b != base for b in called) <= len(called)

    ends, examined = [0], len(seq)
    for i, b in enumerate(back, 1):
        if b == base and share_ok(i) and score(ends[-1], i) >= 0:
            ends.append(i)
        elif b not in (base, "N") and score(ends[-1], i) < -5:
            examined = i
            break
    tail = ends[-1]
    grown = tail
    while grown < examined and back[grown] == "N":
        grown += 1
    called = [b for b in back[:tail] if b != "N"]
    enough = len(called) >= least or (len(called) + 1 == least and len(called) < examined and set(called) <= {base} and least >= 8)
    return grown if len(seq) >= least and enough else 0


@pytest.mark.parametrize("letters,most", [("AAAAAAAACN", 60), ("AAAAG", 30), ("AANNC", 40), ("AC", 25)])
@pytest.mark.parametrize("least", [1, 5, 10, 20])
def test_polyx_tails_follow_their_rule(letters, most, least):
    rows = [s for s, _ in reads(400, most, letters)] + ["A" * i + "C" * j + "A" * k for i in (0, 9) for j in (1, 6, 7) for k in (0, 8, 9, 40)]
    s, n = k_matrix(rows)
    assert k.polyx_tails(s, n, ord("A"), least).tolist() == [polyx_rule(x, "A", least) for x in rows]


def k_matrix(rows):
    return k.matrix(pa.array(rows))


def test_missed_share_is_the_product_over_the_reads_drawn():
    from fractions import Fraction

    from strandflow.operators.stats import missed_share

    for level, drawn, total in [(1, 5, 10), (3, 5, 10), (6, 5, 10), (5, 5, 10), (40, 300, 1000), (1, 999, 1000)]:
        exact = Fraction(1)
        for i in range(drawn):
            exact *= Fraction(max(total - i - level, 0), total - i)
        assert missed_share(level, drawn, total) == pytest.approx(float(exact), rel=1e-9)
    assert missed_share(200_000, 1_000, 10**9) == pytest.approx((1 - 1e-6) ** 200_000, rel=1e-3)


def align_loop(a, b, low, high):
    best = (0, 0, 0)
    out = (0, 0, 0, 0)
    for offset in range(low, high + 1):
        x, y = a[max(offset, 0):], b[max(-offset, 0):]
        n = min(len(x), len(y))
        amb = sum("N" in (p, q) for p, q in zip(x, y))
        mm = sum(p != q and "N" not in (p, q) for p, q in zip(x, y))
        score = n - amb - 2 * mm
        if n and score >= 0 and (score, n, -amb) > best:
            best, out = (score, n, -amb), (offset, n, mm, amb)
    return out


def test_single_alignment():
    adapter = "ACGTTGCATN"
    rows = [s for s, _ in reads(200, 25)] + ["A", "AC" + adapter, adapter[2:] + "GG"]
    s, n = k.matrix(pa.array(rows))
    best = k.align_single(s, n, [adapter.encode(), b"", adapter.encode()], 2)
    for i, seq in enumerate(rows):
        wanted = align_loop(seq, adapter, -2, len(seq) - 1) if seq else (0, 0, 0, 0)
        assert (best.offset[i], best.length[i], best.mismatches[i], best.ambiguous[i]) == wanted


def test_pair_alignment():
    a1, a2 = "ACGTA", "TTGCA"
    first, second = [s for s, _ in reads(150, 20)], [s for s, _ in reads(150, 20)]
    s1, n1 = k.matrix(pa.array(first))
    s2, n2 = k.matrix(pa.array(second))
    best = k.align_pair(s1, n1, s2, n2, [(a1.encode(), a2.encode())], 2)
    for i, (x, y) in enumerate(zip(first, second)):
        offset, n, mm, amb = align_loop(a2 + x, y + a1, len(a2) - len(y) - 2, len(a2) + len(x) - 1)
        if n:
            assert (best.offset[i], best.length[i], best.mismatches[i], best.ambiguous[i]) == (offset - len(a2), n, mm, amb)


def merge_loop(x, qx, y, qy, offset, additive, most):
    start, out, scores = max(offset, 0), [], []
    counts = [0, 0, 0]
    for i in range(max(len(x), start + len(y))):
        a = (x[i], ord(qx[i]) - 33) if i < len(x) else None
        b = (y[i - start], ord(qy[i - start]) - 33) if 0 <= i - start < len(y) else None
        if not (a and b):
            base, q = a or b
        elif a[0] == "N" and b[0] == "N":
            base, q = "N", 0
        elif "N" in (a[0], b[0]):
            base, q = b if a[0] == "N" else a
            counts[2] += 1
        elif a[0] == b[0]:
            base, q = a[0], min(most, a[1] + b[1]) if additive else max(a[1], b[1])
        elif a[1] == b[1]:
            base, q = "N", 0
            counts[1] += 1
        else:
            base, q = (a if a[1] > b[1] else b)[0], abs(a[1] - b[1])
            counts[0] += 1
        out.append(base)
        scores.append(chr(33 + q))
    return "".join(out), "".join(scores), counts


@pytest.mark.parametrize("additive", [False, True])
def test_merge(additive):
    pairs = []
    for _ in range(200):
        (x, qx), (y, qy) = reads(1, 20)[1], reads(1, 20)[1]
        offset = R.randint(-3, len(x))
        if len(y) >= len(x) - max(offset, 0):
            pairs.append((x, qx, y, qy, offset))
    cols = list(zip(*pairs))
    (s1, n1), (q1, _), (s2, n2), (q2, _) = (k.matrix(pa.array(c)) for c in cols[:4])
    got = k.merge(s1, q1, n1, s2, q2, n2, np.array(cols[4]), additive, 41)
    zero = np.zeros(len(pairs), np.int64)
    seqs, quals = (k.strings(got[c], zero, got["length"]).to_pylist() for c in ("seq", "qual"))
    for i, p in enumerate(pairs):
        assert (seqs[i], quals[i], [got[c][i] for c in ("resolved", "unresolved", "ns")]) == merge_loop(*p, additive, 41)
