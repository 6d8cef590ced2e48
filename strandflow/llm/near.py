"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import configured, connected_components, discard, hash128, materialize, small_batches, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, SIMILARITY = 5, 0.8
#: So many orders of a text's k-mers are drawn, and of each the least PICKS are kept; every two of them, as they follow in the
#: text, are a key.  Of two texts whose k-mers agree in a share J, an order has a common key with a chance of about 7 J^2; at
#: similarity 0.8, with changed words anywhere, J is 0.2, and twelve orders find 97 pairs in 100.
ORDERS, PICKS = 12, 4
#: Texts of up to so many k-mers have each k-mer as a key besides: two of them may share one only.
FEW = 16
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Grams of words are counted in so many classes, which tells common from rare ones.
CLASSES = 1 << 18
#: Texts of up to SHORT words that meet are compared by their word pairs, longer ones by their word triples: with as many edits as are
#: allowed, ten words keep a triple, and fewer need not.
SHORT = 9
#: Similar texts share one more token for each so many words of the shorter.
PER_TOKEN = 16
#: Bits of a token and of the class by which tokens are ordered; what is left of 64 numbers the texts that are sorted at once.
TOKEN_BITS, RANK_BITS = 40, 12
#: Tokens that are held and sorted at once: by a task that deals them out, and of a range of them where they meet.
DEALT, MEET = 1_000_000, 500_000
#: Rows of words or keys that one Arrow batch holds, and its bytes, about: rows of _dealt() are long.
BATCH, BYTES = 1000, 8 << 20
#: Pairs that carry the words of both their texts at once; more are verified in parts, one after the other.
AT_ONCE = 200_000
#: Numbers of texts that meet, dealt out at once to those that ask for them, if the texts have fewer grams; else as many as these.
LISTED = 40_000_000
#: A text that is to be verified against more others than these is sieved first, so pairs that carry words are MANY a text, and those
#: whose words agree.  For fewer, sending the text through the sieve costs as much as its pairs.
MANY = 16
#: Words of the texts that a block of the sieve holds.
HELD = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers, multiplying modulo 2^64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def kmers_of(flat: np.ndarray, lengths: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of documents laid end to end -> (k-mers, their documents, each document's first); fewer than k words are one k-mer."""
    flat = flat.astype(np.uint64, copy=False)
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - k + 1, 1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(lengths)), counts)
    base, stop = (ends - lengths)[doc] + np.arange(counts.sum()) - starts[doc], ends[doc]
    kmer = np.zeros(len(doc), np.uint64)
    for t in range(k):
        at = base + t
        kmer = kmer * np.uint64(0x100000001B3) + np.where(at < stop, _mix(flat[np.minimum(at, len(flat) - 1)]), np.uint64(t))
    return _mix(kmer), doc, starts


def order_sketches(flat: np.ndarray, lengths: np.ndarray, orders: int = ORDERS, picks: int = PICKS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(keys, their documents), by document.  Every document has a word at least.

    A document's k-mers are labelled by their occurrence in it.  Each sketch orders all of them anew, takes the least `picks` and
    puts these as they follow in the text; every two of them are a key, the earlier first.  A document's keys depend on
    that document alone.
    """
    rng = np.random.default_rng(seed)
    kmer, doc, starts = kmers_of(flat, lengths)
    own = kmer ^ _mix(doc.astype(np.uint64))
    by = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[by][1:] != own[by][:-1]])
    run = np.arange(len(by))
    occurrence = np.empty(len(by), np.uint64)
    occurrence[by] = run - np.maximum.accumulate(np.where(new, run, 0))
    labelled = _mix(kmer + occurrence * np.uint64(0xD1B54A32D192ED03))
    del own, by, new, run, occurrence
    every, counts = np.arange(len(lengths)), np.bincount(doc, minlength=len(lengths))
    few = counts[doc] <= FEW
    keys, of = [_mix(labelled[few])], [doc[few]]
    for j in range(orders):
        salt, odd = rng.integers(0, 2**63, 2, dtype=np.uint64)
        value = (labelled ^ salt) * (odd | np.uint64(1))
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
        at = np.full((picks, len(lengths)), len(doc), np.int64)
        for p in range(min(picks, int(counts.max()))):
            least = np.minimum.reduceat(value, starts)
            hits = np.flatnonzero(value == least[doc])
            _, first = np.unique(doc[hits], return_index=True)
            at[p] = np.where(least == MOST, len(doc), hits[first])
            value[hits[first]] = MOST
        at.sort(axis=0)
        for p in range(picks):
            for q in range(p + 1, picks):
                there = at[q] < len(doc)
                x, y = labelled[at[p][there]], labelled[at[q][there]]
                keys.append(_mix(_mix(x + np.uint64(j + 1)) + y))
                of.append(every[there])
    keys, of = np.concatenate(keys), np.concatenate(of)
    by = np.argsort(of, kind="stable")
    return keys[by], of[by]


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance, from the words without their order."""
    both = np.concatenate([a, b])
    _, at = np.unique(both, return_inverse=True)
    size = len(both)
    gap = np.bincount(at[:len(a)], minlength=size) - np.bincount(at[len(a):], minlength=size)
    return int(max(gap[gap > 0].sum(), -gap[gap < 0].sum()))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most `most`, else None.

    The alignment keeps to the band of `most` diagonals to either side.  A column of the band is four integers of
    2 x most + 1 bits, one bit a row, which say where its cells rise and fall (Hyyro's bit-parallel form of the table); from
    one column to the next the band moves down by a row.
    """
    if abs(len(a) - len(b)) > most:
        return None
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return len(a) + len(b)
    if bag_distance(a, b) > most:
        return None
    m, n = len(a), len(b)
    t = min(most, max(m, n))
    if t < 1:
        return None
    if m <= t:
        # So short that the band holds the whole table.
        row = np.arange(n + 1)
        for i, x in enumerate(a.tolist(), 1):
            cost = np.minimum(row[1:] + 1, row[:-1] + (b != x))
            row = np.minimum.accumulate(np.concatenate([[i], cost]) - np.arange(n + 1)) + np.arange(n + 1)
        return int(row[-1]) if row[-1] <= most else None
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist(), 1):
        places[x] = places.get(x, 0) | (1 << (i + t))
    width = 2 * t + 1
    full, bottom = (1 << width) - 1, width - 1
    rise, fall, score = full & ~((1 << t) - 1), 0, t
    slack = 2 * t + n - m
    for j, y in enumerate(b.tolist(), 1):
        equal = (places.get(y, 0) >> j) & full
        flat = ((((equal & rise) + rise) ^ rise) | equal | fall) & full
        up = fall | (full & ~(flat | rise))
        down = flat & rise
        if j <= m - t:
            score += 1 - (flat >> bottom & 1)
        else:
            k = m - j + t
            score += (up >> k & 1) - (down >> k & 1)
        if score > slack:
            return None
        flat >>= 1
        rise, fall = down | (full & ~(flat | up)), flat & up
    return score if score <= most else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """1 - edit distance / the longer length in words, if that is `least` or more."""
    longer = max(len(a), len(b))
    d = edit_distance(a, b, int(np.floor((1 - least) * longer + 1e-9)))
    return None if d is None else 1 - d / longer if longer else 1.0


def _chunks(lengths: np.ndarray, words: int = 400_000):
    """Ranges of documents with about so many words together, one document at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        total += int(n)
        if total >= words:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _words_of_batch(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes laid end to end, words of each row)."""
    tokens = batch.column(column)
    offsets = tokens.offsets.to_numpy()
    return tokens.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], np.diff(offsets).astype(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _sketch_batches(batches):
    for batch in batches:
        flat, lengths = _words_of_batch(batch, 2)
        flat = flat.view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for lo, hi in _chunks(lengths):
            keys, of = order_sketches(flat[ends[lo]:ends[hi]], lengths[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(lengths[lo:hi], pa.int32()),
                 _lists(np.bincount(of, minlength=hi - lo), pa.array(keys.view(np.int64))),
                 _lists(lengths[lo:hi], pa.array(flat[ends[lo]:ends[hi]].astype(np.uint32).view(np.int32)))], ["k1", "k2", "n", "keys", "words"])


def _class_of(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(CLASSES - 1)).astype(np.int64)


def word_grams(flat: np.ndarray, lengths: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 52 bits, documents) of every q neighbouring words."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.flatnonzero(doc[q - 1:] == doc[:max(len(doc) - q + 1, 0)])
    words = flat.astype(np.uint64)
    gram = np.full(len(first), q, np.uint64)
    for t in range(q):
        gram = _mix(gram + words[first + t])
    return gram >> np.uint64(64 - TOKEN_BITS - RANK_BITS), doc[first]


def _kinds(flat: np.ndarray, lengths: np.ndarray):
    """(q, words, lengths) for pairs and triples: those texts that meet others by them, the rest without words.

    A pair of texts whose longer one has SHORT words at most meets by pairs, any other by triples; the texts of the latter have
    0.8 x (SHORT + 1) words at least.
    """
    for q, own in ((2, lengths <= SHORT), (3, lengths >= np.ceil(SIMILARITY * (SHORT + 1) - 1e-9))):
        if own.any():
            yield q, flat[np.repeat(own, lengths)], np.where(own, lengths, 0)


def _count_batches(batches):
    counts = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for q, flat, lengths in _kinds(*_words_of_batch(batch, 0)):
            counts += np.bincount(_class_of(word_grams(flat, lengths, q)[0]), minlength=CLASSES)
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], ["c", "n"])


def least_shared(n: np.ndarray) -> np.ndarray:
    """So many of rarest() two similar texts share at least, if the shorter has n words."""
    return 1 + n // PER_TOKEN


def rarest(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, their documents): so many of each document's rarest grams that any two similar documents share least_shared() of them.

    Grams of q words are labelled by their occurrence.  A document of m words that is e <= 0.2 m edits from one of n <= m words shares
    m - q + 1 - q e of its grams with it, as an edit takes q at most: (1 - 0.2 q) m - q + 1, and not less if n stands for m.  In any order
    that holds for all documents, all but the last o - s of a document's grams hold its first s shared ones, if it shares o.
    The order decides how many documents meet in vain, not which meet.  Tokens that agree by chance make documents meet in vain as well.
    """
    tokens, of = [], []
    for lo in range(0, len(lengths), 1 << (64 - TOKEN_BITS - RANK_BITS)):
        some = lengths[lo:lo + (1 << (64 - TOKEN_BITS - RANK_BITS))]
        at = int(lengths[:lo].sum())
        for q, words, own in _kinds(flat[at:at + int(some.sum())], some):
            gram, doc = word_grams(words, own, q)
            shift, low = np.uint64(TOKEN_BITS + RANK_BITS), np.uint64((1 << (TOKEN_BITS + RANK_BITS)) - 1)
            key = np.sort((doc.astype(np.uint64) << shift) | gram)
            run = np.arange(len(key))
            new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
            occurrence = (run - np.maximum.accumulate(np.where(new, run, 0))).astype(np.uint64)
            gram = key & low
            rank = np.minimum(np.log2(1.0 + counts[_class_of(gram)]) * 100, (1 << RANK_BITS) - 1).astype(np.uint64)
            token = _mix(gram + np.uint64(q) + occurrence * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - TOKEN_BITS)
            key = np.sort((key >> shift << shift) | (rank << np.uint64(TOKEN_BITS)) | token)
            doc = (key >> shift).astype(np.int64)
            sizes = np.maximum(own - q + 1, 0)
            shared = np.ceil((1 - (1 - SIMILARITY) * q) * own - q + 1 - 1e-9).astype(np.int64)
            first = run - (np.cumsum(sizes) - sizes)[doc] < (sizes - shared + least_shared(own))[doc]
            tokens.append(key[first] & np.uint64((1 << TOKEN_BITS) - 1))
            of.append(doc[first] + lo)
    tokens, of = np.concatenate([np.zeros(0, np.uint64), *tokens]), np.concatenate([np.zeros(0, np.int64), *of])
    return tokens, of


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])


def _by_key(batches, made):
    """made(table) for the rows of batches, sorted by their first column, so cut that no value of it is in two calls."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        held = table.slice(cut)
        if cut:
            yield from made(table.slice(0, cut).combine_chunks())
    if held is not None and held.num_rows:
        yield from made(held.combine_chunks())


def _dealt(spot: np.ndarray, t: np.ndarray, n: np.ndarray, part: np.ndarray, size: np.ndarray, bits: int):
    """Tokens and their texts, by text -> a row for each range of tokens: its number, and lists of what is left to say, in few bytes."""
    at = spot >> (TOKEN_BITS - bits)
    by = np.argsort(at, kind="stable")
    starts = _runs(at[by])
    sizes = np.diff(np.append(starts, len(at)))
    step = np.diff(t[by], prepend=0)
    step[starts] = t[by][starts]
    rest = (spot[by] & ((1 << (TOKEN_BITS - bits)) - 1)).astype(np.uint32).view(np.int32)
    lists = [_lists(sizes, pa.array(c)) for c in (rest, step, n[by], (part - t)[by], size[by])]
    return pa.RecordBatch.from_arrays([pa.array(at[by][starts]), *lists], ["range", "spot", "step", "n", "part", "size"])


def _met_batches(batches):
    """Rows of _dealt(), sorted by range -> of every spot that several parts have, its texts in the order of their parts, the largest last, those
    that others stand behind, with the place where these begin, and how many stand behind them together.
    """
    def made(table):
        # One range at a time is sorted, however many the table has.
        number = table.column(0).to_numpy()
        starts = _runs(number)
        for lo, hi in zip(starts, np.append(starts[1:], len(number)), strict=True):
            lists = table.slice(lo, hi - lo).combine_chunks()
            spot, step, n, part, size = (lists.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in range(1, 6))
            sizes = np.diff(lists.column(1).combine_chunks().offsets.to_numpy())
            t, first = np.cumsum(step), np.cumsum(sizes) - sizes
            t -= np.repeat(t[first] - step[first], sizes)
            by = np.argsort(spot, kind="stable")
            yield from meet(spot[by], t[by], n[by], (part + t)[by], size[by])

    def meet(spot, *columns):
        part = columns[2]
        starts = _runs(spot)
        several = np.minimum.reduceat(part, starts) < np.maximum.reduceat(part, starts)
        if not several.any():
            return
        sizes = np.diff(np.append(starts, len(spot)))
        kept = np.repeat(several, sizes)
        t, n, part, size = (c[kept] for c in columns)
        sizes = sizes[several]
        of, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        by = np.lexsort((t, part, size, of))
        t, n, part = t[by], n[by], part[by]
        runs = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])]))
        lengths = np.diff(np.append(runs, len(t)))
        stop = np.repeat(runs + lengths, lengths)
        asks = np.flatnonzero(stop < ends[of])
        met = pa.StructArray.from_arrays([pa.array(t), pa.array(n, pa.int32())], ["t", "n"])
        own = pa.StructArray.from_arrays([pa.array(t[asks]), pa.array(n[asks], pa.int32()), pa.array((stop - (ends - sizes)[of])[asks] + 1, pa.int32())], ["t", "n", "at"])
        behind = np.bincount(of[asks], (ends[of] - stop)[asks], len(sizes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([_lists(sizes, met), _lists(np.bincount(of[asks], minlength=len(sizes)), own), pa.array(behind)], ["met", "own", "behind"])
    yield from _by_key(batches, made)


def _tally_batches(batches):
    """Rows (x, n, ys), sorted by x -> a row for each x, with those of its ys that it has often enough."""
    def made(table):
        x, n, ys = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks()
        sizes = np.diff(ys.offsets.to_numpy())
        starts = _runs(x)
        of = np.repeat(np.cumsum(np.isin(np.arange(len(x)), starts)) - 1, sizes)
        y = ys.flatten().to_numpy(zero_copy_only=False)
        by = np.lexsort((y, of))
        y, of = y[by], of[by]
        first = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (of[1:] != of[:-1])])[:len(y)])
        shared = np.diff(np.append(first, len(y)))
        least = least_shared(np.ceil(SIMILARITY * n[starts] - 1e-9).astype(np.int64))
        enough = first[shared >= least[of[first]]]
        sizes = np.bincount(of[enough], minlength=len(starts))
        yield pa.RecordBatch.from_arrays([pa.array(x[starts][sizes > 0]), _lists(sizes[sizes > 0], pa.array(y[enough]))], ["x", "ys"])
    yield from _by_key(batches, made)


def _named_batches(batches):
    """Rows (x, ys) -> (t), the texts that a batch names on either side."""
    for batch in batches:
        named = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(named)], ["t"])


def labelled_words(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words of documents laid end to end, each with its occurrence in its document: sets of them agree as bags of words do."""
    word, doc = flat.astype(np.uint64), np.repeat(np.arange(len(lengths)), lengths)
    by = np.lexsort((word, doc))
    run, there = np.arange(len(by)), word[by]
    new = np.concatenate([[True], (there[1:] != there[:-1]) | (doc[by][1:] != doc[by][:-1])])[:len(by)]
    occurrence = np.empty(len(by), np.uint64)
    occurrence[by] = run - np.maximum.accumulate(np.where(new, run, 0))
    return _mix(_mix(word) + occurrence * np.uint64(0xD1B54A32D192ED03))


def agreeing(lengths: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """Which documents of these lengths can be similar to one of n words, if they share so many words with it.

    The edit distance is the longer length less the shared words at least, as bag_distance() says.
    """
    longer = np.maximum(lengths, n)
    return longer - shared <= np.floor((1 - SIMILARITY) * longer + 1e-9)


def _sieve_batches(batches):
    """Rows (block, x, words, ys), sorted by block, those without ys first -> the pairs (a, b) of an x and those of its ys whose words agree.

    Rows without ys are the texts of the block, of which ys has only such.
    """
    at, pieces, held = None, [], None
    for batch in batches:
        block, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        flat, lengths = _words_of_batch(batch, 2)
        ends, asked = np.concatenate([[0], np.cumsum(lengths)]), batch.column(3)
        words, token, a, b = flat.view(np.uint32), None, [], []
        for i, sized in enumerate(np.diff(asked.offsets.to_numpy())):
            if block[i] != at:
                at, pieces, held = block[i], [], None
            if not sized:
                pieces.append((x[i], words[ends[i]:ends[i + 1]].copy()))
                continue
            if held is None:
                number = np.array([t for t, _ in pieces])
                by = np.argsort(number)
                pieces = [pieces[j] for j in by]
                sizes = np.array([len(w) for _, w in pieces])
                every, place = np.unique(labelled_words(np.concatenate([w for _, w in pieces]), sizes), return_inverse=True)
                held, pieces = (number[by], sizes, np.cumsum(sizes) - sizes, every, place, np.zeros(len(every), np.int64)), []
            if token is None:
                token = labelled_words(words, lengths)
            number, sizes, firsts, every, place, mark = held
            own = token[ends[i]:ends[i + 1]]
            hit = np.minimum(np.searchsorted(every, own), len(every) - 1)
            hit = hit[every[hit] == own]
            mark[hit] = 1
            ys = asked[i].values.to_numpy()
            y = np.searchsorted(number, ys)
            starts = np.cumsum(sizes[y]) - sizes[y]
            spots = np.repeat(firsts[y] - starts, sizes[y]) + np.arange(sizes[y].sum())
            shared = np.add.reduceat(mark[place[spots]], starts)
            mark[hit] = 0
            near = ys[agreeing(sizes[y], shared, int(lengths[i]))]
            a.append(np.minimum(near, x[i]))
            b.append(np.maximum(near, x[i]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _verify_batches(batches):
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy(zero_copy_only=False), right.values.to_numpy(zero_copy_only=False)
        got = [similarity(lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["a", "b", "similarity"])


def _asked(met: DataFrame, grams: int) -> list[DataFrame]:
    """Rows of _met_batches() -> tables of rows (x, ys), a row for each text that asks, with those of the texts it meets that it meets often enough.

    The texts of a smaller part ask for those of a larger one, under whatever spot, so a large part adds rows of its own number only.  A large
    group under many spots has its square of numbers under each, so they are dealt out for some of the asking texts at a time: no more
    at once than the texts have grams or LISTED, about, and all of them one after the other.
    """
    steps = 1 + (met.agg(F.sum("behind")).first()[0] or 0) // max(LISTED, grams)
    x = F.col("own")
    near = lambda y: F.least(y["n"], x["n"]) >= F.greatest(y["n"], x["n"]) * SIMILARITY - 1e-9
    tables = []
    for step in range(steps):
        mine = F.filter("own", lambda o: F.pmod(F.xxhash64(o["t"]), F.lit(steps)) == step) if steps > 1 else F.col("own")  # noqa: B023
        rows = met.select(F.explode(mine).alias("own"), "met").select(
            x["t"].alias("x"), x["n"].alias("n"), F.filter(F.slice("met", x["at"], F.size("met")), near)["t"].alias("ys")).where(F.size("ys") > 0)
        tables.append(materialize(rows.repartition("x").sortWithinPartitions("x").mapInArrow(_tally_batches, "x long, ys array<long>"), "near-asked"))
    return tables


def _words_for(sketches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, words) of the texts that wanted has, so that joins of pairs deal out no other words."""
    return materialize(sketches.select("t", "words").join(wanted.select("t").distinct(), "t", "left_semi"), "near-words")


def _sieved(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (x, ys) of distinct texts -> the pairs (a, b) of an x and those of its ys that share as many words as similar ones must.

    Texts are dealt out in blocks by their number, once each; an x goes once to each block that has some of its ys.  No pair is left out
    that is similar.
    """
    total = words.agg(F.sum(F.size("words"))).first()[0]
    blocks = 1 + (total or 0) // HELD

    def to_blocks(batches):
        for batch in batches:
            ys = batch.column(2)
            y, of = ys.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(ys.offsets.to_numpy()))
            by = np.lexsort((y, y % blocks, of))
            y, of = y[by], of[by]
            starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (y[1:] % blocks != y[:-1] % blocks)])[:len(y)])
            for lo in range(0, len(starts), BATCH):
                some = starts[lo:lo + BATCH]
                stop = starts[lo + BATCH] if lo + BATCH < len(starts) else len(y)
                row = pa.array(of[some])
                yield pa.RecordBatch.from_arrays([pa.array(y[some] % blocks), batch.column(0).take(row), batch.column(1).take(row),
                                                  _lists(np.diff(np.append(some, stop)), pa.array(y[some[0]:stop]))], ["block", "x", "words", "ys"])

    held = words.select((F.col("t") % blocks).alias("block"), F.col("t").alias("x"), "words", F.expr("cast(array() as array<bigint>)").alias("ys"))
    dealt = asked.join(words.withColumnRenamed("t", "x"), "x").select("x", "words", "ys").mapInArrow(to_blocks, "block long, x long, words array<int>, ys array<long>")
    rows = held.unionByName(dealt).repartition("block").sortWithinPartitions("block", F.size("ys") > 0)
    return rows.mapInArrow(_sieve_batches, "a long, b long")


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct texts -> those whose aligned words are similar enough, with similarity."""
    left = words.select(F.col("t").alias("a"), F.col("words").alias("aw"))
    right = words.select(F.col("t").alias("b"), F.col("words").alias("bw"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "aw", "bw")
    return both.mapInArrow(_verify_batches, "a long, b long, similarity double").where("similarity is not null")


def _with_parts(maps: list[DataFrame], texts: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """texts with the component of each named column of text numbers, as the maps say one after the other; what no map has stays."""
    for column, name in columns:
        texts = texts.withColumn(name, F.col(column))
        for parts in maps:
            own = parts.select(F.col("node").alias("own_node"), F.col("component").alias("own_part"))
            texts = texts.join(own, F.col(name) == F.col("own_node"), "left").withColumn(name, F.coalesce("own_part", name)).drop("own_node", "own_part")
    return texts


def _joined(maps: list[DataFrame], links: DataFrame) -> list[DataFrame]:
    """maps and one more, of the components that links (a, b) make of those so far: each link is followed once only."""
    edges = _with_parts(maps, links.select("a", "b"), ("a", "ap"), ("b", "bp")).where("ap <> bp").select(F.col("ap").alias("a"), F.col("bp").alias("b")).distinct()
    edges = materialize(edges, "near-edges")
    return maps if edges.isEmpty() else [*maps, connected_components(edges)]


def _unplanned(key: Column | str) -> Column:
    """A key as good as the given one that the planner takes for another, so that both sides of a join are exchanged and a hot key can be split."""
    return F.expr(f"{key} ^ 1")


def near_links(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The same as _near_links(), with Arrow batches that fit the length of texts."""
    with small_batches(docs.sparkSession, BATCH), configured(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES)}):
        return _near_links(docs)


def _near_links(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(texts, maps): distinct texts of docs (text) as (t, k1, k2), k1 and k2 their 128-bit hash, and the components of their links.

    A map has rows (node, component) and holds for what the maps before it give.

    Buckets are texts that share a key and whose lengths are in one cell of either of two grids; cells are so wide, and the grids
    so shifted, that lengths as near as the similarity demands are in one cell of one of them.  First all texts are verified
    against the shortest of a bucket and joined into components, which takes a large group of near copies in rows, not
    pairs.  Then no link is left out: every text is dealt out under its rarest() grams, of which similar texts share some, and all texts of
    different components that share as many as similar ones must are verified against each other.  Texts with more than MANY such others are
    _sieved() first, so that only pairs whose words agree carry texts.  That is exact; numbers of texts that meet, and pairs with nearly
    the same words in another order or just under the threshold, can still grow with the square of a group.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash128(text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    sketched = rows.select("k1", "k2", F.transform(words_of(F.lower("text")), lambda w: F.xxhash64(w)).alias("tokens")).where(F.size("tokens") > 0)
    # One row a text from here on, under a number that the written table fixes.
    sketches = materialize(sketched.mapInArrow(_sketch_batches, "k1 long, k2 long, n int, keys array<long>, words array<int>").dropDuplicates(["k1", "k2"])
                           .select(F.monotonically_increasing_id().alias("t"), "*"), "near-sketches")
    keyed = sketches.select("t", "n", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select(_unplanned("key").alias("j"))
    members = materialize(keyed.withColumn("j", _unplanned("key")).join(shared, "j", "left_semi").select("key", "t", "n"), "near-members")
    words = _words_for(sketches, members)

    cell = F.log("n") / (2 * np.log(1 / SIMILARITY) * 1.001)
    groups = F.array(*[F.xxhash64("key", F.lit(grid), F.floor(cell + grid / 2)) for grid in (0, 1)])
    grouped = members.select("t", "n", F.explode(groups).alias("g"))
    firsts = grouped.groupBy("g").agg(F.min(F.struct("n", "t")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    firsts = firsts.select(_unplanned("g").alias("j"), F.col("first.t").alias("a"))
    stars = materialize(grouped.withColumn("j", _unplanned("g")).join(firsts, "j").where("t <> a").groupBy("a", F.col("t").alias("b"))
                        .agg(F.count(F.lit(1)).alias("shared")), "near-stars")
    # Each text against the one bucket head it shares most keys with, then against the other heads it isn't yet joined to.
    best = materialize(stars.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), "near-best")
    found = materialize(_verified(best, words), "near-found")
    maps = _joined([], found)
    others = _with_parts(maps, stars.select("a", "b").join(best, ["a", "b"], "left_anti"), ("a", "ap"), ("b", "bp"))
    others = materialize(others.where("ap <> bp").select("a", "b"), "near-others")
    maps = _joined(maps, materialize(_verified(others, words), "near-found"))
    for table in (members, words, stars):
        discard(table)

    counts = np.zeros(CLASSES, np.int64)
    # One row a class at most; as a table, so that the shuffle, which has a row a class and task, goes.
    classes = materialize(sketches.select("words").mapInArrow(_count_batches, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")), "near-counts")
    got = classes.toArrow()
    discard(classes)
    counts[got["c"].to_numpy()] = got["n"].to_numpy()
    held = spark.sparkContext.broadcast(counts)

    # Of a token 32 bits are left behind its range at most.
    bits = max(TOKEN_BITS - 32, (int(counts.sum()) // MEET).bit_length())

    def rare(batches):
        kept, total = [], 0
        for batch in batches:
            flat, lengths = _words_of_batch(batch, 4)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            own = [batch.column(c).to_numpy() for c in range(4)]
            for lo, hi in _chunks(lengths):
                tokens, of = rarest(flat[ends[lo]:ends[hi]], lengths[lo:hi], held.value)
                kept.append([tokens.view(np.int64), *[c[of + lo] for c in own]])
                total += len(tokens)
                if total >= DEALT:
                    spot, *columns = (np.concatenate(c) for c in zip(*kept, strict=True))
                    kept, total = [], 0
                    yield _dealt(spot, *columns, bits)
        if total:
            spot, *columns = (np.concatenate(c) for c in zip(*kept, strict=True))
            yield _dealt(spot, *columns, bits)

    parts = _with_parts(maps, sketches.select("t", "n"), ("t", "part"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("size")).where("size > 1").select(_unplanned("part").alias("j"), "size")
    parts = parts.withColumn("j", _unplanned("part")).join(sizes, "j", "left").select("t", "n", "part", F.coalesce("size", F.lit(1)).alias("size"))
    parts = materialize(parts, "near-parts")
    spots = (parts.join(sketches.select("t", "words"), "t").select("t", "n", "part", "size", "words")
             .mapInArrow(rare, "range long, spot array<int>, step array<long>, n array<int>, part array<long>, size array<int>"))
    # As a table, so that the words and tokens that made it go before the numbers of texts are dealt out.
    met = materialize(spots.repartition("range").sortWithinPartitions("range")
                      .mapInArrow(_met_batches, "met array<struct<t: long, n: int>>, own array<struct<t: long, n: int, at: int>>, behind long"), "near-met")
    asked = _asked(met, int(counts.sum()))
    discard(met)
    meet = functools.reduce(DataFrame.unionByName, asked)
    few, many = meet.where(F.size("ys") <= MANY), meet.where(F.size("ys") > MANY)
    cross = few.select("x", F.explode("ys").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not many.isEmpty():
        words = _words_for(sketches, many.mapInArrow(_named_batches, "t long"))
        cross = cross.unionByName(materialize(_sieved(many, words), "near-sieved"))
        discard(words)
    tried = best.unionByName(others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = materialize(cross.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    words = _words_for(sketches, cross.select(F.col("a").alias("t")).unionByName(cross.select(F.col("b").alias("t"))))
    # The same pairs, all of them: only the words that they carry through the joins are on disk for one part at a time.
    steps = 1 + cross.count() // AT_ONCE
    found = [materialize(_verified(cross.where(F.pmod(F.xxhash64("a", "b"), F.lit(steps)) == step), words), "near-cross") for step in range(steps)]
    maps = _joined(maps, functools.reduce(DataFrame.unionByName, found))
    for table in (best, others, parts, *asked, cross, words):
        discard(table)
    return sketches.select("t", "k1", "k2"), maps


def near_classes(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, k1, k2 (the text's hash), class_id, class_size, kept.

    Documents with equal texts, and those chained by links of near_links(), are a class; class_id is its least doc_id,
    class_size its number of rows.  kept is true for the row or rows of class_id (with several texts under that id, of
    the one with the least hash).
    Words are lower-cased and separated by white space; similarity is 1 - word edits / words of the longer text, 0.8 or more.
    Null texts are empty; texts without words are near only to equal texts; null ids come last; repeated rows are one
    document that keeps all its rows; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash128(text)
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    texts = rows.groupBy("k1", "k2").agg(F.min(me).alias("head"), F.count(F.lit(1)).alias("copies"))
    numbers, maps = near_links(docs.select("text"))
    if not maps:
        known = texts.withColumnRenamed("copies", "class_size")
    else:
        nodes = functools.reduce(DataFrame.unionByName, [m.select(F.col("node").alias("t")) for m in maps]).distinct()
        parts = _with_parts(maps, nodes.join(numbers, "t"), ("t", "component")).select("k1", "k2", "component")
        texts = materialize(texts.join(parts, ["k1", "k2"], "left"), "near-texts")
        classes = materialize(texts.where("component is not null").groupBy("component").agg(F.min("head").alias("head"), F.sum("copies").alias("class_size")), "near-classes")
        joined = texts.where("component is not null").select("k1", "k2", "component").join(classes, "component").drop("component")
        known = joined.unionByName(texts.where("component is null").select("k1", "k2", "head", F.col("copies").alias("class_size")))
    out = rows.join(materialize(known, "near-known"), ["k1", "k2"])
    return out.select("doc_id", "k1", "k2", F.col("head.doc_id").alias("class_id"), F.col("class_size").cast("long").alias("class_size"),
                      (me == F.col("head")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all their columns, with one document of each class: the first.  Rows that repeat it go as well."""
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash128(text)
    heads = near_classes(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("id"), "k1", "k2").distinct()
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    out = rows.join(heads, ["k1", "k2"]).where(F.col("row.doc_id").eqNullSafe(F.col("id")))
    return out.dropDuplicates(["k1", "k2"]).select("row.*")
