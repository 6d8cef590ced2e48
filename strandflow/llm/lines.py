"""Line dedup over a corpus by a deletion-neighbourhood join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import hash128, materialize, unused

#: The edit bound is 1 from so many code points on and 0 below, where one edit changes too much of a line.  It is a parameter.
MIN_NEAR = 16
#: Variants that one task makes.
PER_TASK = 500_000
EDGE = " \t\r\x0b\x0c"


def _document_lines(docs: DataFrame) -> DataFrame:
    """Rows (k1, k2, doc_id, pos, line): k1, k2 stand for doc_id and text, so repeated rows are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash128(F.col("doc_id"), text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    return rows.select("k1", "k2", "doc_id", "pos", F.btrim("raw", F.lit(EDGE)).alias("line")).where("line <> ''")


def duplicate_lines(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """Rows (k1, k2, pos) of the lines to remove from docs (doc_id, text).

    A line is removed if an earlier line of the corpus, by (doc_id, position), is the same or, where both have
    min_near code points or more, one edit away (a code point inserted, removed or replaced).  Lines are compared
    without white space at their ends; blank lines are never removed.

    1. Equal lines meet under a 128-bit hash, counted on the map side; the first of each class is kept.
    2. Only lines that share half of themselves with another line can be one edit from it.  Two hashed halves a
       length find them; all other lines need no neighbourhood.
    3. Those lines emit themselves and every variant with one code point removed as a 64-bit key made of positions:
       lines of one length that differ in one place share the variant and the place, a line and its extension share
       the shorter one.  A group holds one line for each code point that can stand in one place.
    4. The edit distance to the earliest line of the group is verified.
    """
    rows = _document_lines(docs)
    h1, h2 = hash128(F.col("line"))
    n = F.length("line")
    lines = rows.select("k1", "k2", "doc_id", "pos", h1.alias("h1"), h2.alias("h2"), n.alias("n"), "line")

    def half(size, kind):
        cut = F.floor(size / 2).cast("int")
        piece = F.substring("line", F.lit(1), cut) if kind == "p" else F.right("line", size - cut)
        return F.xxhash64(F.lit(kind), size, piece)

    near = F.when(F.col("n") >= min_near, F.array(*[half(F.col("n") - d, k) for d in (0, 1) for k in "ps"]))
    firsts = materialize(
        lines.withColumn("halves", near).groupBy("h1", "h2").agg(
            F.min(F.struct("doc_id", "k1", "k2", "pos")).alias("first"), F.count(F.lit(1)).alias("copies"),
            F.first("halves").alias("halves")), "line-classes")

    halves = firsts.where("halves is not null").select("h1", "h2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b"),
                                        F.min("h2").alias("c"), F.max("h2").alias("d")).where("a <> b or c <> d")
    # The key is hidden from the planner, so that both sides are exchanged and a hot key can be split.
    hit = halves.withColumn("j", F.expr("half ^ 1")).join(shared.select(F.expr("half ^ 1").alias("j")), "j", "left_semi")
    wanted = (hit.select("h1", "h2").distinct().join(firsts, ["h1", "h2"])
              .select("h1", "h2", "first").groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("h1", "h2", "first")).alias("w")))
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash128(F.col("doc_id"), text)
    own = (docs.select(k1.alias("k1"), k2.alias("k2"), F.split(text, "\n").alias("all")).join(wanted, ["k1", "k2"])
           .select(F.explode("w").alias("w"), "all")
           .select("w.h1", "w.h2", "w.first", F.btrim(F.get("all", F.col("w.first.pos")), F.lit(EDGE)).alias("line"))
           .dropDuplicates(["h1", "h2"]))
    own = materialize(own, "line-candidates")

    # Tasks by the variants they make, not by the bytes of the lines they get.
    total = own.agg(F.sum(F.length("line"))).first()[0] or 0
    chars = (own.repartition(1 + total // PER_TASK, "h1", "h2").select("h1", "h2", "first", F.posexplode(F.split("line", "")).alias("i", "c"))
             .withColumn("here", F.xxhash64("c", "i")).withColumn("left", F.xxhash64("c", F.col("i") - 1)))
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    chars = (chars.withColumn("before", F.bit_xor("here").over(upto).bitwiseXOR(F.col("here")))
             .withColumn("whole", F.bit_xor("here").over(line))
             .withColumn("after", F.bit_xor("left").over(line).bitwiseXOR(F.bit_xor("left").over(upto))))
    without = F.struct(F.col("before").bitwiseXOR(F.col("after")).alias("v"), F.col("i"))
    itself = F.struct(F.col("whole").alias("v"), F.lit(-1).alias("i"))
    variants = chars.select(F.struct("first", "h1", "h2").alias("me"),
                            F.explode(F.when(F.col("i") == 0, F.array(without, itself)).otherwise(F.array(without))).alias("x")).select("me", "x.v", "x.i")
    # Dealt out once by the variant, which serves the groups by variant and by variant and place.
    variants = variants.repartition(1 + total // PER_TASK, "v")
    group, place = Window.partitionBy("v"), Window.partitionBy("v", "i")
    variants = (variants.withColumn("same_place", F.min("me").over(place))
                .withColumn("shorter", F.min(F.when(F.col("i") < 0, F.col("me"))).over(group))
                .withColumn("longer", F.min(F.when(F.col("i") >= 0, F.col("me"))).over(group)))
    early = F.explode(F.array(F.when(F.col("i") >= 0, F.col("same_place")),
                              F.when(F.col("i") >= 0, F.col("shorter")), F.when(F.col("i") < 0, F.col("longer"))))
    pairs = variants.select("me", early.alias("e")).where("e is not null and e < me").select(
        F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    texts = own.select("h1", "h2", "line")
    there = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    verified = (pairs.join(texts, ["h1", "h2"]).join(there, ["e1", "e2"])
                .where((F.abs(F.length("line") - F.length("other")) <= 1) & (F.levenshtein("line", "other", 1) >= 0))
                .select("h1", "h2").distinct().withColumn("near", F.lit(True)))

    classes = materialize(firsts.select("h1", "h2", "first", "copies").join(verified, ["h1", "h2"], "left")
                          .where("copies > 1 or near"), "line-duplicates")
    drops = lines.select("k1", "k2", "doc_id", "pos", "h1", "h2").join(classes, ["h1", "h2"])
    me = F.struct("doc_id", "k1", "k2", "pos")
    return drops.where(F.col("near").isNotNull() | (me > F.col("first"))).select("k1", "k2", "pos")


def dedup_lines(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """docs with the columns they have; text is without the lines duplicate_lines() names, and n_lines, n_dropped follow.

    Null and empty texts stay as they are; rows that agree in doc_id and text are one document and get one result;
    null ids come first in order; of documents with one id the order is by a hash; columns of the caller that are called n_lines or
    n_dropped stay, and the new ones get an underscore behind their name; no rows give no rows.
    """
    out, counts = _without_lines(docs, min_near)
    return out.select("row.*", *[c.alias(unused(n, docs.columns)) for n, c in counts.items()])


def kept_lines(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """The columns of docs alone, texts as dedup_lines() leaves them, and n_chars, where there is one, that of the text that is left."""
    out, _ = _without_lines(docs, min_near)
    if "n_chars" not in docs.columns:
        return out.select("row.*")
    n = F.coalesce(F.length("row.text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(F.col("row").withField("n_chars", n).alias("row")).select("row.*")


def _without_lines(docs: DataFrame, min_near: int) -> tuple[DataFrame, dict]:
    """Rows as one column `row`, whatever its columns are called, with the new text; and the counts by name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash128(F.col("doc_id"), text)
    drops = (duplicate_lines(docs.select("doc_id", "text"), min_near).groupBy("k1", "k2")
             .agg(F.sort_array(F.collect_set("pos")).alias("drop")))
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    out = rows.join(drops, ["k1", "k2"], "left").withColumn("all", F.split(F.coalesce("row.text", F.lit("")), "\n"))
    # The split is a column of its own, used more than once: inside the lambda it would run for every line.
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("drop"))
    kept = F.transform(places, lambda i: F.get(F.col("all"), i))
    new = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    out = out.select(F.col("row").withField("text", new).alias("row"), "all", "drop")
    return out, {"n_lines": F.size("all"), "n_dropped": F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))}
