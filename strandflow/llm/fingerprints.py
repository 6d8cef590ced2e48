"""SimHash document fingerprints and the search of all within a Hamming radius; DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import connected_components, hash128, materialize

#: Four 16-bit lanes of a long; 16 shifts of it cover 64 bits.
LANES = 0x0001000100010001
PAIRS = 0x0000FFFF0000FFFF
#: The largest weight of a position (word and pair) times its words in one chunk stays below 2^15: the highest lane has the sign of the long.
CHUNK, MAX_WORD, PAIR = 2048, 8, 2


def simhash(rows: DataFrame, texts: dict[str, str], keys: list[str]) -> DataFrame:
    """Rows with unique keys -> keys and one 64-bit fingerprint (long) for each {name: text column}.

    Every word votes on the 64 bits of its hash with its length less two, 1 to 8, every pair of neighbouring words on
    those of its own with 2.  A bit is set if the votes for it are more than half.  Votes are summed in 16-bit lanes
    of 16 longs over chunks of 2048 words, before anything is shuffled, then in 32-bit lanes.
    A text without words has fingerprint 0.
    """
    names = list(texts)
    words = rows.select(*keys, *[F.filter(F.split(F.coalesce(F.col(t), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias(f"_w{i}")
                                 for i, t in enumerate(texts.values())])
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"_w{i}").alias("w")) for i in range(len(names))]))
    each = words.select(*keys, one.alias("t")).select(*keys, "t.kind", F.col("t.w").alias("w"))
    after = F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    each = each.select(*keys, "kind", F.posexplode_outer(F.arrays_zip(F.col("w").alias("w"), after.alias("next"))).alias("pos", "p"))
    weight = F.when(F.col("p.w").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(MAX_WORD), F.length("p.w") - 2))).cast("long")
    pair = F.when(F.col("p.next").isNull(), F.lit(0)).otherwise(F.lit(PAIR)).cast("long")
    each = each.select(*keys, "kind", (F.coalesce("pos", F.lit(0)) / CHUNK).cast("int").alias("chunk"),
                       F.xxhash64("p.w").alias("h"), weight.alias("a"), F.xxhash64("p.w", "p.next").alias("g"), pair.alias("b"))
    lane = lambda c, s: F.shiftrightunsigned(F.col(c), s).bitwiseAND(F.lit(LANES))
    sums = each.groupBy(*keys, "kind", "chunk").agg(
        F.sum(F.col("a") + F.col("b")).alias("all"),
        *[F.sum(lane("h", s) * F.col("a") + lane("g", s) * F.col("b")).alias(f"s{s}") for s in range(16)])
    wide = sums.groupBy(*keys, "kind").agg(
        F.sum("all").alias("all"),
        *[F.sum(F.shiftrightunsigned(F.col(f"s{s}"), 16 * k).bitwiseAND(F.lit(PAIRS))).alias(f"s{s}_{k}") for s in range(16) for k in (0, 1)])
    bits = [F.when(F.shiftrightunsigned(F.col(f"s{s}_{k}"), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("all"),
                   F.shiftleft(F.lit(1).cast("long"), s + 16 * k + 32 * half)).otherwise(F.lit(0).cast("long"))
            for s in range(16) for k in (0, 1) for half in (0, 1)]
    # Sixteen at a time, so that no expression is long enough to be left uncompiled.
    parts = [bits[i:i + 16] for i in range(0, 64, 16)]
    for i, part in enumerate(parts):
        got = part[0]
        for b in part[1:]:
            got = got.bitwiseOR(b)
        wide = wide.withColumn(f"f{i}", got)
    prints = wide.select(*keys, "kind", F.col("f0").bitwiseOR(F.col("f1")).bitwiseOR(F.col("f2")).bitwiseOR(F.col("f3")).alias("fp"))
    return prints.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == i, F.col("fp"))).alias(n) for i, n in enumerate(names)])


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in 1 to radius bits.

    64 bits are cut into blocks; whichever `radius` blocks differ, the others agree.  For each choice of
    blocks - radius blocks one table, permuted to have them in front, holds every fingerprint under those bits; only
    fingerprints that share them meet, and only pairs within the radius leave the join.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    table = prints.select("fp").where("fp is not null").distinct().select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    left, right = table.withColumnRenamed("fp", "a"), table.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return left.join(right, ["t", "k"]).where(near).select("a", "b").distinct()


def near_classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Rows (fp, class_fp, n_links) of the fingerprints that have others within the radius."""
    pairs = materialize(within_radius(prints, radius), "fp-pairs")
    links = (pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links")))
    if pairs.isEmpty():
        return links.withColumn("class_fp", F.col("fp")).select("fp", "class_fp", "n_links")
    return links.join(connected_components(pairs).withColumnRenamed("node", "fp"), "fp").select("fp", F.col("component").alias("class_fp"), "n_links")


def _below(value: Column, cuts: list, kind: str, width: int = 100) -> Column:
    """How many of the sorted cuts are less than value: first among every width-th of them, then among those in between."""
    count = lambda among: F.size(F.filter(among, lambda c: c < value))
    array = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
    if len(cuts) <= width:
        return count(array(cuts)) if cuts else F.lit(0)
    rows = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    at = count(array([r[-1] for r in rows]))
    return at * width + F.when(at < len(rows), count(F.element_at(F.array(*[array(r) for r in rows]), F.least(at + 1, F.lit(len(rows)))))).otherwise(0) - F.when(
        at == len(rows), len(rows) * width - len(cuts)).otherwise(0)


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, most: int = 8192, sampled: int = 40) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the next document by descending doc_id, after the last the first.

    Quantiles of doc_id, of any type with an order, from a sample of some rows a bucket, cut the order into buckets of about
    rows_per_bucket rows (of more, with `most` of them); each is sorted on its own, spilling what it can't hold.  The last document of
    every bucket is joined with the first of the bucket behind it: one row a bucket on either side, and no text is broadcast.
    Of rows with one id the order is by a hash of the text, so the many rows without an id are a bucket by that hash; null
    ids come last; a single row is its own next.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = ordered.count()
    n = int(max(1, min(most, rows // rows_per_bucket)))
    kind = ordered.schema["doc_id"].dataType.simpleString()
    cuts: list = []
    if n > 1:
        share = max(1, rows // (n * sampled))
        ids = ordered.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)).select("doc_id").orderBy(F.xxhash64("doc_id")).limit(2 * n * sampled)
        # A bounded number of ids.
        found = sorted(r["doc_id"] for r in ids.collect())
        cuts = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []
    ordered = ordered.withColumn("tie", F.xxhash64("text"))
    # Buckets by descending id: 0 holds the largest ids, the last ones the nulls, dealt by the order of their hash.
    ordered = ordered.withColumn("tie", F.shiftrightunsigned("tie", 1))
    nulls = F.floor(F.col("tie").cast("double") / float(2**63) * n).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), F.least(nulls, F.lit(n - 1)) + len(cuts) + 1).otherwise(F.lit(len(cuts)) - _below(F.col("doc_id"), cuts, kind))
    ordered = ordered.withColumn("bucket", bucket)
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie"))
    led = ordered.withColumn("next_text", F.lead("text").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    there = led.where("first").select("bucket", "text")
    before = F.coalesce(F.lag("bucket").over(Window.partitionBy().orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    # One number a bucket, so one task orders them; the texts follow by a join.
    after = ordered.select("bucket").distinct().withColumn("of", before).select(F.col("bucket").alias("b"), "of")
    heads = there.join(after, F.col("bucket") == F.col("b")).select(F.col("of").alias("b"), F.col("text").alias("head"))
    last = led.where("next_text is null").select("doc_id", "text", "bucket").hint("shuffle_merge")
    ends = last.join(heads.hint("shuffle_merge"), F.col("bucket") == F.col("b")).select("doc_id", "text", F.col("head").alias("next_text"))
    return led.where("next_text is not null").select("doc_id", "text", "next_text").unionByName(ends)


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_links.

    The edited text is the text with its last third, floor(n_chars / 3) code points, replaced by the first as many of the
    next document's.  class_id is the least doc_id of the documents whose fingerprints are chained to this one's within
    the radius; n_links counts the other fingerprints within the radius itself.
    Null texts are empty; texts without words have fingerprint 0; equal texts have equal fingerprints and classes;
    repeated rows are documents of their own, each the next of another; no rows give no rows.
    """
    rows = with_next(docs.select("doc_id", "text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    k1, k2 = hash128(F.col("text"))
    n1, n2 = hash128(F.col("next_text"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
                       k1.alias("k1"), k2.alias("k2"), n1.alias("n1"), n2.alias("n2"), "text", "edited")
    keys = ["rid", "doc_id", "n_chars", "sha", "k1", "k2", "n1", "n2"]
    prints = materialize(simhash(rows, {"fp": "text", "efp": "edited"}, keys).drop("rid"), "fingerprints")
    of_text = materialize(prints.groupBy("k1", "k2").agg(F.first("fp").alias("nfp"), F.min("doc_id").alias("least")), "fp-texts")
    classes = near_classes(of_text.select(F.col("nfp").alias("fp")), radius)
    ids = (of_text.select(F.col("nfp").alias("fp"), "least").groupBy("fp").agg(F.min("least").alias("least"))
           .join(classes, "fp", "left").withColumn("class_fp", F.coalesce("class_fp", "fp")))
    ids = materialize(ids, "fp-ids")
    # Written first, so that both sides of the join are exchanged and a large class can be split.
    named = materialize(ids.groupBy("class_fp").agg(F.min("least").alias("class_id")), "fp-names")
    class_ids = materialize(ids.join(named, "class_fp")
                            .select(F.col("fp").alias("cfp"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "fp-classes")
    nexts = of_text.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "nfp")
    out = prints.join(nexts, ["n1", "n2"]).join(class_ids, F.col("fp") == F.col("cfp"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
                      as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "class_id", F.col("n_links").cast("long").alias("n_links"))
