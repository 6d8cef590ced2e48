"""Alignment and merging in blocks of reads and words of 64 columns."""

import time

import numpy as np
import pytest

from strandflow.operators import kernels as k

R = np.random.default_rng(3)


def texts(n, width, letters=b"ACGTACGTN"):
    lengths = R.integers(0, width + 1, n)
    out = np.frombuffer(letters, np.uint8)[R.integers(0, len(letters), (n, width))].copy()
    out[np.arange(width) >= lengths[:, None]] = 0
    return out, lengths


def offset_loop(a: bytes, b: bytes, low: int, high: int):
    best = (0, 0, 0, 0, 0)
    for o in range(low, high + 1):
        x, y = a[max(o, 0):], b[max(-o, 0):]
        pairs = list(zip(x, y))
        amb = sum(k.N in p for p in pairs)
        wrong = sum(p != q and k.N not in (p, q) for p, q in pairs)
        score = len(pairs) - amb - 2 * wrong
        if pairs and score >= 0 and (score, len(pairs), -amb) > (best[0], best[1], -best[2]):
            best = (score, len(pairs), amb, wrong, o)
    return best


def row(m, n, i):
    return m[i, :n[i]].tobytes()


@pytest.mark.parametrize("width,letters", [(63, b"ACGTN"), (130, b"ACGTN"), (200, b"ACN"), (70, b"ACGTNRYacgt")])
def test_pairs_of_several_words(monkeypatch, width, letters):
    monkeypatch.setattr(k, "BLOCK", 7)
    (s1, n1), (s2, n2) = texts(30, width, letters), texts(30, width, letters)
    got = k.align_pair(s1, n1, s2, n2, [(b"ACGNAC", b"TTGCA")], 2)
    for i in range(30):
        a, b = b"TTGCA" + row(s1, n1, i), row(s2, n2, i) + b"ACGNAC"
        score, length, amb, wrong, o = offset_loop(a, b, max(5 - n2[i] - 2, 1 - len(b)), len(a) - 1)
        assert (got.score[i], got.length[i], got.ambiguous[i], got.mismatches[i], got.offset[i]) == (score, length, amb, wrong, o - 5 if length else 0)


@pytest.mark.parametrize("width,letters", [(63, b"ACGTN"), (130, b"ACGTN"), (600, b"ACGTN"), (70, b"ACGTNRYacgt")])
def test_adapters_of_several_words(monkeypatch, width, letters):
    monkeypatch.setattr(k, "BLOCK", 7)
    s, n = texts(30, width, letters)
    adapter = letters[:1] * 3 + b"ACGTNACG" * 9
    got = k.align_single(s, n, [adapter], 2)
    for i in range(30):
        wanted = offset_loop(row(s, n, i), adapter, -2, int(n[i]) - 1)
        assert (got.score[i], got.length[i], got.ambiguous[i], got.mismatches[i], got.offset[i]) == wanted


def test_pairs_cost_less_than_a_comparison_by_byte_for_every_offset():
    n, width = 8192, 100
    a, b = (np.frombuffer(b"ACGT", np.uint8)[R.integers(0, 4, (n, width))] for _ in range(2))
    lengths = np.full(n, width)

    def seconds(f):
        began = time.perf_counter()
        f()
        return time.perf_counter() - began

    align = lambda: k.align_pair(a, lengths, b, lengths, [(b"AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", b"TGACTTTCCCTACACGACGCTCTTCCGATCT")], 2)
    by_byte = min(seconds(lambda: (((a == k.N) | (b == k.N)).sum(axis=1), (a != b).sum(axis=1))) for _ in range(5))
    assert min(seconds(align) for _ in range(3)) < 200 * by_byte / 2


def test_merging_in_blocks(monkeypatch):
    (s1, n1), (s2, n2) = texts(300, 90), texts(300, 90)
    q1, q2 = (np.where(s > 0, R.integers(33, 75, s.shape), 0).astype(np.uint8) for s in (s1, s2))
    offset = np.minimum(R.integers(-20, 80, 300), n1)
    whole = k.merge(s1, q1, n1, s2, q2, n2, offset, False, 41)
    monkeypatch.setattr(k, "BLOCK", 28)
    parts = k.merge(s1, q1, n1, s2, q2, n2, offset, False, 41)
    inside = np.arange(whole["seq"].shape[1]) < whole["length"][:, None]
    assert all((whole[c] == parts[c]).all() for c in ("length", "resolved", "unresolved", "ns"))
    assert all((whole[c][inside] == parts[c][inside]).all() for c in ("seq", "qual"))
