"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND, and overlap verification."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import hash128, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
#: Passages are this many windows of STRIDE words; each overlaps the next by all windows but one.  So an item of up to
#: WINDOWS - 1 windows lies whole in one of them; for longer items windows are twice, four times ... as long.
STRIDE, WINDOWS = 32, 3
#: Items of one index that is sent to the executors; a longer benchmark takes several passes, block by block.
MAX_ITEMS = 2_000
#: Items of one block, for which the largest weight of each term is kept.
BLOCK = 4
#: Part of what an item needs that its frequent terms may add.
SPARE = 0.5
#: Words that are searched at once; a longer text is searched piece by piece.
CHUNK = 200_000
#: Part of its own score that an item must reach in a passage, and of its question's and answer's 3-grams that must occur.
RETRIEVE, VERIFY, GRAM = 0.5, 0.6, 3
MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """Postings of test items by term, all of them and those of essential terms, with block maxima of the latter.

    item_ids in the order of what they need; terms: sorted word hashes; term t has the postings ptr[t] to ptr[t + 1] of items and
    weights, by item.  An item's frequent terms, which can't lift it over what it needs, have no essential posting:
    e_ptr, e_items, e_weights are the others, e_max the largest weight of a term, and of_blocks and block_max, at b_ptr[t] to
    b_ptr[t + 1], the blocks of a term's essential postings with the largest weight there.  need: the score an item must reach;
    least: what essential terms must add to any item from this one on.  questions, answers: word hashes by item; strides: the words
    of a window by item.
    """

    item_ids: np.ndarray
    terms: np.ndarray
    ptr: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    e_ptr: np.ndarray
    e_items: np.ndarray
    e_weights: np.ndarray
    e_max: np.ndarray
    b_ptr: np.ndarray
    of_blocks: np.ndarray
    block_max: np.ndarray
    need: np.ndarray
    least: np.ndarray
    questions: list
    answers: list
    strides: np.ndarray


def stride_of(words: int) -> int:
    """The least doubling of STRIDE for which an item of so many words lies whole in a passage, wherever it begins."""
    stride = STRIDE
    while words > stride * (WINDOWS - 1):
        stride *= 2
    return stride


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the distinct n-grams; of all words together if there are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for t in range(n):
        h = (h ^ words[t:t + len(h)]) * MULT
        h ^= h >> np.uint64(29)
    return np.unique(h)


def build_index(ids: list, words: list[np.ndarray], answer_from: list[int], whole: tuple[int, float, list[np.ndarray]] | None = None) -> Index:
    """BM25 weights with idf over the items; answer_from[i]: the word with which the answer of item i begins.

    whole: if these are not all items, the number of all, their mean length, and for each word of these the number of all
    items that hold it.
    """
    n = len(ids)
    lengths = np.array([len(w) for w in words], float)
    mean = max(whole[1] if whole else lengths.mean(), 1.0) if n else 1.0
    terms, at = np.unique(np.concatenate([np.empty(0, np.uint64), *words]), return_inverse=True)
    item = np.repeat(np.arange(n), lengths.astype(int))
    pair, tf = np.unique(at * max(n, 1) + item, return_counts=True)
    term, item = pair // max(n, 1), pair % max(n, 1)
    held = df = np.bincount(term, minlength=len(terms))
    if whole:
        df = np.zeros(len(terms), int)
        df[at] = np.concatenate([np.empty(0, int), *whole[2]])
    idf = np.log1p(((whole[0] if whole else n) - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
    # Items of like scores are neighbours, so that a block's bounds fit all of it.
    own = np.bincount(item, weight, n)
    order = np.argsort(own, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    by = np.lexsort((rank[item], term))
    term, item, weight = term[by], rank[item][by], weight[by]
    need = RETRIEVE * own[order]
    # From the most frequent terms on, as many of an item's as may be are not essential; what they add at most is counted in advance.
    often = np.lexsort((weight, -df[term], item))
    so_far = np.cumsum(weight[often])
    begins = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n))])
    so_far -= np.repeat(np.concatenate([[0], so_far])[begins[:-1]], np.diff(begins))
    kept = np.ones(len(term), bool)
    kept[often] = so_far > SPARE * need[item[often]]
    rest = np.bincount(item, weight * ~kept, n)
    least = np.minimum.accumulate((need - rest)[::-1])[::-1] * (1 - 1e-9) if n else need
    ptr, e_ptr = (np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))]) for t in (term, term[kept]))
    e_max = np.zeros(len(terms))
    np.maximum.at(e_max, term[kept], weight[kept])
    blocks = n // BLOCK + 1
    cell, at = np.unique(term[kept] * blocks + item[kept] // BLOCK, return_inverse=True)
    block_max = np.zeros(len(cell))
    np.maximum.at(block_max, at, weight[kept])
    b_ptr = np.concatenate([[0], np.cumsum(np.bincount(cell // blocks, minlength=len(terms)))])
    parts = [(w[:a], w[a:]) for w, a in zip(words, answer_from)]
    return Index(np.array(ids, object)[order], terms, ptr, item, weight, e_ptr, item[kept], weight[kept], e_max, b_ptr, cell % blocks, block_max, need, least,
                 [parts[i][0] for i in order], [parts[i][1] for i in order], np.array([stride_of(len(words[i])) for i in order], int))


def overlap(part: np.ndarray, around: np.ndarray) -> float:
    """The share of part's n-grams that occur around; a part shorter than an n-gram is one of its own length."""
    if not len(part):
        return 1.0
    n = min(GRAM, len(part))
    return float(np.isin(grams(part, n), grams(around, n), assume_unique=True).mean())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _seek(keys: np.ndarray, ptr: np.ndarray, span: int, term: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The place of each term's first posting from an item on, the end of its postings if there is none; keys are term x span + item."""
    return np.minimum(np.searchsorted(keys, term * span + item), ptr[term + 1])


def wand(index: Index, query: np.ndarray, term: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of all wanted items that score what they need; (query, term) are the distinct terms of each query, by query.

    Every essential term of a query has a cursor in its postings.  Of a query's cursors by their items, the pivot is the
    first with which the largest weights so far reach what items from there on need; nothing before it can.  If the maxima
    of the pivot's block don't reach it either, all cursors up to it go beyond that block, or to the item of the cursor behind the
    pivot; else the item is scored with all its terms, and they go on by one.  Queries without a pivot are done.  One step is
    taken for all queries at once.
    """
    n = len(index.item_ids)
    span, blocks = n + 1, n // BLOCK + 1
    keys, e_keys, b_keys = (np.repeat(np.arange(len(index.terms)), np.diff(p)) * w + i for p, w, i in (
        (index.ptr, span, index.items), (index.e_ptr, span, index.e_items), (index.b_ptr, blocks, index.of_blocks)))
    least = np.append(index.least, np.inf)
    items = np.append(index.e_items, n)
    first_term = np.searchsorted(query, np.arange((query[-1] if len(query) else 0) + 2))
    own = index.e_ptr[term + 1] > index.e_ptr[term]
    q, t = query[own], term[own]
    at = index.e_ptr[t]
    found: list = []
    while len(q):
        done = at >= index.e_ptr[t + 1]
        q, t, at = q[~done], t[~done], at[~done]
        here = items[at]
        # By query and item; queries stay as they are in order.
        by = np.argsort(q * span + here, kind="stable")
        q, t, at, here = q[by], t[by], at[by], here[by]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, int)
        sizes = np.diff(np.append(starts, len(q)))
        total = np.cumsum(index.e_max[t])
        total -= np.repeat(total[starts] - index.e_max[t[starts]], sizes)
        reached = np.flatnonzero(total * (1 + 1e-9) >= least[here])
        _, first = np.unique(q[reached], return_index=True)
        pivot = reached[first]
        # Only what belongs to queries with a pivot goes on.
        alive = np.zeros(len(starts), bool)
        which = np.searchsorted(starts, pivot, "right") - 1
        alive[which] = True
        stays = np.repeat(alive, sizes)
        place = np.cumsum(stays) - 1
        q, t, at, here, pivot = q[stays], t[stays], at[stays], here[stays], place[pivot]
        if not len(q):
            break
        starts, sizes = place[starts[alive]], sizes[alive]
        group = np.repeat(np.arange(len(starts)), sizes)
        goal = here[pivot]
        upto = here <= goal[group]
        cell = np.minimum(np.searchsorted(b_keys, t * blocks + goal[group] // BLOCK), len(b_keys) - 1)
        there = (b_keys[cell] == t * blocks + goal[group] // BLOCK) & upto
        bound = np.bincount(group, np.where(there, index.block_max[cell], 0), len(starts))
        open_ = bound * (1 + 1e-9) >= least[goal]
        after = np.full(len(starts), n)
        np.minimum.at(after, group[~upto], here[~upto])
        target = np.where(open_, goal + 1, np.minimum((goal // BLOCK + 1) * BLOCK, after))
        who, what = q[starts][open_], goal[open_]
        if len(who):
            counts = first_term[who + 1] - first_term[who]
            pair = np.repeat(np.arange(len(who)), counts)
            terms = term[_ranges(first_term[who], counts)]
            key = terms * span + what[pair]
            post = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            score = np.bincount(pair, np.where(keys[post] == key, index.weights[post], 0), len(who))
            hit = (score >= index.need[what] * (1 - 1e-9)) & (index.need[what] > 0) & wanted[what]
            found.append((who[hit], what[hit], score[hit]))
        behind = upto
        at[behind] = _seek(e_keys, index.e_ptr, span, t[behind], target[group[behind]])
    return tuple(np.concatenate([np.empty(0, kind), *[f[i] for f in found]]) for i, kind in enumerate((int, int, float)))


def search(index: Index, flat: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) of all verified hits, documents laid end to end.

    Every passage is a query for all items of like length, in passages as long as they need.  Memory is bounded by words: texts
    are searched some passages at a time, whatever document they are of.
    """
    hits: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(flat) or not len(index.item_ids):
        return []
    at = np.searchsorted(index.terms, flat)
    at = np.where(index.terms[np.minimum(at, len(index.terms) - 1)] == flat, at, -1)
    starts = np.cumsum(lengths) - lengths
    for stride in np.unique(index.strides).tolist():
        windows = np.maximum(-(-lengths // stride) - WINDOWS + 1, 1) * (lengths > 0)
        doc = np.repeat(np.arange(len(lengths)), windows)
        begin = starts[doc] + (np.arange(windows.sum()) - (np.cumsum(windows) - windows)[doc]) * stride
        end = np.minimum(begin + stride * WINDOWS, (starts + lengths)[doc])
        per = max(1, CHUNK // (stride * WINDOWS))
        for lo in range(0, len(doc), per):
            _search_passages(index, flat, at, starts, lengths, doc[lo:lo + per], begin[lo:lo + per], end[lo:lo + per], stride, hits)
    return sorted((int(d), int(i), *v) for (d, i), v in hits.items())


def _search_passages(index: Index, flat, at, starts, lengths, doc, begin, end, stride: int, hits: dict) -> None:
    """Adds to hits what the given passages hold, the best passage of each document and item."""
    words = at[_ranges(begin, end - begin)]
    query = np.repeat(np.arange(len(doc)), end - begin)[words >= 0]
    pairs = np.unique(query * len(index.terms) + words[words >= 0])
    query, term = pairs // len(index.terms), pairs % len(index.terms)
    for w, i, score in zip(*wand(index, query, term, index.strides == stride)):
        d = doc[w]
        # Verified with a window to either side, so that no item is cut by the passage's ends.
        around = flat[max(starts[d], begin[w] - stride):min(starts[d] + lengths[d], end[w] + stride)]
        q, a = overlap(index.questions[i], around), overlap(index.answers[i], around)
        if q >= VERIFY and a >= VERIFY and score > hits.get((d, i), (0,))[0]:
            hits[d, i] = (float(score), q, a)


def _pieces(lengths: np.ndarray):
    """Ranges of documents of about CHUNK words together, one document at least."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        yield lo, hi
        lo = hi


def _terms(text: Column) -> Column:
    """Hashes of the lower-cased words, runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_counts(items: DataFrame) -> tuple[DataFrame, float]:
    """items with counts, for each word of q and then a the number of items that hold it; and the mean length."""
    rows = materialize(items.withColumn("row", F.monotonically_increasing_id()), "leak-items")
    words = rows.select("row", F.posexplode(F.concat("q", "a")).alias("pos", "word"))
    found = words.groupBy("word").agg(F.count_distinct("row").alias("n"))
    counts = (words.join(found, "word").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("c"))
              .select("row", F.col("c.n").alias("counts")))
    out = materialize(rows.join(counts, "row").drop("row"), "leak-items")
    return out, out.agg(F.avg(F.size("counts"))).first()[0]


def leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap) of documents that hold test items.

    docs: doc_id, text; benchmark: item_id, text.  Words are lower-cased runs of letters and digits.  A document is
    a series of overlapping passages of 96 words, every 32 words, each of them a query; for an item of more than 64 words
    both are doubled until a passage holds it whole wherever it begins; an item is retrieved if its
    BM25 score is half of what it scores against itself, and holds if 0.6 of the 3-grams of its question and of its
    answer (the last sentence) occur there.  The best passage of a document and item is reported.
    Null and empty texts hold nothing and are held by nothing; rows that repeat are reported each; null ids pass
    through; equal items are reported each; an empty benchmark or no documents give no rows.
    The index is sent to the executors in blocks of max_items items, so the benchmark may have any size; scores are over
    all items, whatever the blocks.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    # The answer is an item's last sentence; an item of one sentence has none apart from its question.
    parts = r"(?s)^(.*[.!?])\s+(\S.*)$"
    question, answer = F.regexp_extract("text", parts, 1), F.regexp_extract("text", parts, 2)
    items = benchmark.select("item_id", "text", question.alias("q"), answer.alias("a"))
    items = items.select("item_id", _terms(F.when(F.col("a") == "", F.col("text")).otherwise(F.col("q"))).alias("q"), _terms(F.col("a")).alias("a"))
    items = items.where("size(q) + size(a) > 0")
    n_items, whole = items.count(), None
    if n_items > max_items:
        items, whole = _with_counts(items)
    tokens = docs.select("doc_id", _terms(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    out = spark.createDataFrame([], schema)
    block: list = []

    def one_pass(rows: list) -> DataFrame:
        # As a plain dictionary, so that executors need not have this module.
        held = spark.sparkContext.broadcast(vars(build_index(
            [r["item_id"] for r in rows], [np.array(r["q"] + r["a"], np.int64).view(np.uint64) for r in rows],
            [len(r["q"]) for r in rows], whole and (n_items, whole, [np.array(r["counts"], int) for r in rows]))))

        def run(batches):
            index = Index(**held.value)
            for batch in batches:
                tokens = batch.column(1)
                lengths = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
                flat = tokens.values.to_numpy(zero_copy_only=False)[tokens.offsets[0].as_py():].view(np.uint64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                ids = batch.column(0)
                for lo, hi in _pieces(lengths):
                    got = search(index, flat[ends[lo]:ends[hi]], lengths[lo:hi])
                    if got:
                        d, i, s, q, a = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([lo + x for x in d])), pa.array([index.item_ids[x] for x in i], ITEM),
                             pa.array(s), pa.array(q), pa.array(a)],
                            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        from pyspark.sql.pandas.types import to_arrow_type

        ITEM = to_arrow_type(benchmark.schema["item_id"].dataType)
        return tokens.mapInArrow(run, schema)

    for r in items.orderBy("item_id").toLocalIterator():
        block.append(r)
        if len(block) == max_items:
            out, block = out.unionByName(one_pass(block)), []
    return out.unionByName(one_pass(block)) if block else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all their columns, without the documents that hold a test item.  A row is judged by its text, whatever its id."""
    key = F.concat_ws("-", *[F.hex(h) for h in hash128(F.coalesce("text", F.lit("")))])
    bad = leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(bad, "key", "left_anti").select("row.*")
