"""LM scoring: stupid backoff over a trigram model of all other documents, as joins of exploded n-grams with their counts."""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from strandflow.llm.common import configured, discard, materialize, small_batches, words_of
from strandflow.llm.near import _mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHA = 0.4
#: Documents from which frequent n-grams are guessed, the share of them that makes an n-gram frequent, and the most of these.  They are
#: dealt out by document as well; no score depends on which they are.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 2000, 0.02, 20_000
SALTS = 64
#: The n-grams of one order are dealt out in parts by their hash, one after the other, each with all that documents have of it: no count
#: depends on it, and the disk holds one part at a time.  SLICES parts at most, one for so many words if there are fewer.
SLICES, PER_SLICE = 6, 1_000_000
#: The most frequent words, whose counts are broadcast.
MOST_WORDS = 100_000
#: Places of a text that one mask of bits holds.
PLACES = 62
#: Documents of an Arrow batch.
BATCH = 500


def _own_batches(batches):
    """Rows (rid, doc_id, ws) -> and for every place of a text how often the text itself has the word, pair and triple that end there; 0 without one."""
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        words = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].view(np.uint64)
        lengths = np.diff(offsets)
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        place = np.arange(len(words)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        gram, own = _mix(doc + np.uint64(1)), []
        for q in range(3):
            gram = _mix(gram + (words if not q else np.concatenate([np.zeros(min(q, len(words)), np.uint64), words[:-q]])))
            there = np.flatnonzero(place >= q)
            _, of, counts = np.unique(gram[there], return_inverse=True, return_counts=True)
            n = np.zeros(len(words), np.int32)
            n[there] = counts[of]
            own.append(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(n)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["rid", "doc_id", "ws", "o1", "o2", "o3"])


def _word(back: int) -> Column:
    return F.coalesce(F.get("ws", F.col("p") - back), F.lit(0).cast("long"))


def _grams(words: DataFrame, q: int, more: str = "0") -> DataFrame:
    """Rows (rid, the q words, x): every n-gram of q words; x packs how often its document has it, its place p and two bits of `more`."""
    placed = words.where(F.size("ws") >= q).withColumn("p", F.explode(F.sequence(F.lit(q - 1), F.size("ws") - 1)))
    x = F.expr(f"shiftleft(cast(coalesce(get(o{q}, p), 0) as bigint), 33) | shiftleft(cast(coalesce(p, 0) as bigint), 2) | ({more})")
    return placed.select("rid", *[_word(back).alias(k) for k, back in zip("uvw"[3 - q:], range(q - 1, -1, -1), strict=True)], x.alias("x"))


def frequent(words: DataFrame, n_docs: int) -> DataFrame:
    """The hashes (g) of word pairs and triples that many documents of a bounded sample hold; MOST_FREQUENT at most."""
    sample = words.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0)
    keys = [_grams(sample, q).select("rid", F.xxhash64(*"uvw"[3 - q:]).alias("g")) for q in (2, 3)]
    held = keys[0].unionByName(keys[1]).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("docs"))
    least = max(4, int(FREQUENT * min(n_docs, SAMPLE_DOCS)))
    return held.where(F.col("docs") >= least).orderBy(F.desc("docs"), "g").limit(MOST_FREQUENT).select("g")


def _frequent_counts(words: DataFrame, q: int, hot: DataFrame) -> DataFrame:
    """Rows (the q words, all): the occurrences of frequent n-grams, counted in place over all documents."""
    key = list("uvw"[3 - q:])
    return _grams(words, q).join(F.broadcast(hot), F.xxhash64(*key) == F.col("g")).groupBy(*[F.col(k).alias(f"h_{k}") for k in key]).agg(F.count(F.lit(1)).alias("all"))


def _others(grams: DataFrame, key: list[str], hot: DataFrame) -> DataFrame:
    """Rows of _grams() whose n-gram other documents have, with others: its occurrences there.

    The n-grams of all documents are dealt out by hash, frequent ones by document besides; where they meet they are counted, and every
    row is joined with its count, less what its own document has of it.  Frequent ones bring their counts along, from a broadcast
    table (hot) of no more than MOST_FREQUENT rows.
    """
    rows = grams.join(F.broadcast(hot), [F.col(k) == F.col(f"h_{k}") for k in key], "left").drop(*[f"h_{k}" for k in key])
    rows = rows.withColumn("all", F.coalesce("all", F.lit(0)))
    rows = rows.withColumn("salt", F.coalesce(F.when(F.col("all") > 0, F.pmod("rid", F.lit(SALTS))), F.lit(-1))).repartition(*key, "salt")
    # Every column is asked for and none is null, so that the counts read the same exchange as the rows that they are joined with.
    counted = rows.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("here"), F.max("x").alias("most"), F.max("rid").alias("last"), F.max("all").alias("known"))
    # N-grams that one document alone has are in no count table.
    counted = counted.where((F.col("last") >= 0) & ((F.col("known") > 0) | (F.col("here") > F.shiftright("most", 33))))
    counted = counted.select(*[F.col(k).alias(f"t_{k}") for k in [*key, "salt"]], "here")
    met = rows.join(counted.hint("shuffle_hash"), [F.col(k) == F.col(f"t_{k}") for k in [*key, "salt"]])
    others = F.when(F.col("all") > 0, F.col("all")).otherwise(F.col("here")) - F.shiftright("x", 33)
    return met.select("rid", *key, "x", others.alias("others")).where("others > 0")


def _marked(words: DataFrame, q: int, hot: DataFrame, slices: int, more: str, marks: str, value: str) -> DataFrame:
    """Per document with a word: the places (mask, an array of PLACES bits each) of n-grams of q words that other documents have and
    `marks` asks for, how many these are (seen), and the sum of `value` over all that other documents have.
    """
    key = list("uvw"[3 - q:])
    hot = materialize(_frequent_counts(words, q, hot), "lm-frequent")
    parts = []
    for part in range(slices):
        grams = _grams(words, q, more).where(F.pmod(F.xxhash64(*key), F.lit(slices)) == part)
        p = "(shiftright(x, 2) & 2147483647)"
        bit = F.expr(f"if({marks}, shiftleft(1L, cast({p} % {PLACES} as int)), 0L)")
        met = _others(grams, key, hot).select("rid", F.expr(f"cast({p} div {PLACES} as int)").alias("block"), bit.alias("bit"), F.expr(value).alias("value"))
        parts.append(materialize(met.groupBy("rid", "block").agg(F.bit_or("bit").alias("mask"), F.sum("value").alias("value")), "lm-marks"))
    # Every block of a text is there, so that a place is found by its number.
    blocks = words.where(F.size("ws") > 0).select("rid", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(ws) - 1) div {PLACES} as int)"))).alias("block"),
                                                  F.lit(0).cast("long").alias("mask"), F.lit(0.0).alias("value"))
    blocks = functools.reduce(DataFrame.unionByName, [*parts, blocks]).repartition("rid").groupBy("rid", "block").agg(F.bit_or("mask").alias("mask"), F.sum("value").alias("value"))
    # value is summed in the order of blocks, so that reruns agree.
    lists = blocks.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("block", "mask", "value"))).alias("b"))
    out = lists.select("rid", F.col("b.mask").alias(f"m{q}"), F.aggregate("b", F.lit(0), lambda n, b: n + F.bit_count(b["mask"])).alias(f"seen{q}"),
                       F.aggregate("b", F.lit(0.0), lambda s, b: s + b["value"]).alias(f"s{q}"))
    out = materialize(out, f"lm-marks{q}")
    for table in parts:
        discard(table)
    return out


def _has(mask: str, p: str) -> str:
    """1 if the masks have the bit of place p, else 0, as a bigint."""
    return f"coalesce(shiftright(get({mask}, cast(({p}) div {PLACES} as int)), cast(({p}) % {PLACES} as int)) & 1L, 0L)"


def score(docs: DataFrame) -> DataFrame:
    """The same as _score(), with tables packed well and Arrow batches that fit the length of texts."""
    spark = docs.sparkSession
    with configured(spark, {"spark.sql.parquet.compression.codec": "zstd"}), small_batches(spark, BATCH):
        return _score(docs)


def _score(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, log_score, mean_log_score, by a model of all other rows of docs.

    Words are lower-cased and separated by white space.  Counts are those of all documents without the scored one's own.  A word scores
    count(u v w) / count(u v) where other documents have the trigram, else ALPHA x count(v w) / count(v) where they have that, else
    ALPHA x count(w) / words; a word that no other document has scores ALPHA / words.  The first word of a text has no n-gram
    but itself, the second a bigram.  log_score is the sum of logarithms over the text.

    Trigrams, bigrams and words are exploded and joined with their counts in turn.  What comes back to a text is a bit for each
    place whose n-gram other documents have, and the sum of what is known.  The bigram at a place is divided by if the next place's
    trigram is known, and counts if its own place's is not; words go by bigrams in the same way.
    Null and empty texts have no words, log_score 0 and a null mean; null ids pass through; rows that repeat are documents of their
    own, so each is known to the other; without other documents words / ALPHA is 1; no rows give no rows.
    """
    hashed = F.transform(words_of(F.lower("text")), lambda w: F.xxhash64(w))
    hashed = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", hashed.alias("ws"))
    own = StructType([*hashed.schema.fields, *[StructField(f"o{q}", ArrayType(IntegerType())) for q in (1, 2, 3)]])
    words = materialize(hashed.mapInArrow(_own_batches, own), "lm-words")
    n_docs, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ws").cast("long")), F.lit(0))).first()
    hot = materialize(frequent(words, n_docs), "lm-frequent")
    slices = min(SLICES, 1 + total // PER_SLICE)

    three = _marked(words, 3, hot, slices, "0L", "true", "ln(cast(others as double))")
    # Half of the documents at a time, as their words are dealt out once more.
    halves = [words.where(F.pmod("rid", F.lit(2)) == h).join(three.select("rid", "m3").hint("shuffle_hash"), "rid", "left") for h in (0, 1)]
    halves = [materialize(half, "lm-words") for half in halves]
    discard(words)
    words = halves[0].unionByName(halves[1])
    # Bit 1: the bigram counts, bit 0: it is divided by.
    two = _marked(words, 2, hot, slices, f"shiftleft(1L - {_has('m3', 'p')}, 1) | {_has('m3', 'p + 1')}", "x & 2 = 2",
                  "(shiftright(x, 1) & 1L) * ln(cast(others as double)) - (x & 1L) * ln(cast(others as double))")

    counts = materialize(words.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("total")), "lm-counts")
    most = materialize(counts.orderBy(F.desc("total"), "w").limit(MOST_WORDS), "lm-most")
    sums = []
    for half in halves:
        marked = half.where(F.size("ws") > 0).join(two.select("rid", "m2").hint("shuffle_hash"), "rid").withColumn("p", F.explode(F.sequence(F.lit(0), F.size("ws") - 1)))
        times = F.expr(f"1L - {_has('m3', 'p')} - {_has('m2', 'p')} - {_has('m2', 'p + 1')}")
        asked = marked.select("rid", _word(0).alias("w"), F.get("o1", F.col("p")).alias("own"), times.alias("times")).where("times <> 0")
        common = asked.join(F.broadcast(most), "w")
        rare = asked.join(F.broadcast(most.select("w")), "w", "left_anti").join(counts, "w")
        for known in (common, rare):
            value = F.expr(f"if(total > own, times * ln(cast(total - own as double)), times * {math.log(ALPHA)!r}D)")
            sums.append(materialize(known.groupBy("rid").agg(F.sum(value).alias("s1")), "lm-sums"))
    sums = functools.reduce(DataFrame.unionByName, sums).groupBy("rid").agg(F.sum("s1").alias("s1"))

    scored = words.select("rid", "doc_id", F.size("ws").cast("long").alias("n_words")).join(three.drop("m3"), "rid", "left").join(two.drop("m2"), "rid", "left").join(sums, "rid", "left")
    zero = {name: F.coalesce(name, F.lit(0)) for name in ("seen3", "seen2", "s3", "s2", "s1")}
    by_word = F.col("n_words") - F.col("seen3") - F.col("seen2")
    backs = F.greatest(F.col("n_words") - 2, F.lit(0)) - F.col("seen3") + F.greatest(by_word - 1, F.lit(0))
    others = F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double"))
    scored = scored.withColumns(zero).withColumn("total", F.col("s3") + F.col("s2") + F.col("s1") + backs * F.lit(math.log(ALPHA)) - by_word * others)
    return scored.select("doc_id", "n_words", F.round("total", 6).alias("log_score"),
                         F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words"), 6)).alias("mean_log_score"))
