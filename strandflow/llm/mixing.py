"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import hash128, materialize, unused

WORD = r"[^\x20\x09-\x0D]+"


def uniform(what: Column, seed: int) -> Column:
    """A number in (0, 1) from what tells a row apart and the seed alone, so that reruns agree on any cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), what))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3.0) -> DataFrame:
    """Rows (source, source_size) -> the same with target.

    Sources in code point order, null last, take the weights in turn.  The targets share the sum of all sizes by
    weight; a target stops at max_repeats times its source's size and the excess is reshared by weight.  That ends
    at one water level: with sources ordered by cap / weight, the first k are capped and the rest share what is left.
    One row per source is all that meets in the window without a partition key.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    t = (sizes.withColumn("w", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1))
         .withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")))
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    t = (t.withColumn("total", F.sum("source_size").over(every).cast("double"))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("w_left", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))))
    # The level if exactly the sources before this one are capped; the levels fall from the
    # first source that stays under its cap, and its level holds for all the rest.
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    t = t.withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    t = t.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    return t.select("source", "source_size", "w",
                    F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("w")), F.col("cap")).alias("target"))


def class_levels(classes: DataFrame, max_repeats: float) -> DataFrame:
    """Rows (source, grade, words, target) -> the same with expected, the copies that each document of a class is to have.

    Documents of a grade weigh 2 ^ (grade / 8).  What a source's target asks for is shared by weight; a class stops at max_repeats
    and the excess goes to the others.  As in source_targets(), that is one level: the classes with the largest weights are
    capped, the rest share what is left.  A source has a bounded number of classes, one row each.
    """
    own = Window.partitionBy("source")
    fall = own.orderBy(F.col("grade").desc_nulls_last())
    w = F.coalesce(F.pow(F.lit(2.0), F.col("grade") / 8), F.lit(0.0))
    t = classes.withColumn("w", w).withColumn("before", F.coalesce(F.sum("words").over(fall.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("left", F.sum(F.col("w") * F.col("words")).over(fall.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.when(F.col("left") > 0, (F.col("target") - max_repeats * F.col("before")) / F.col("left")))
    t = t.withColumn("final", F.max(F.when(F.col("level") * F.col("w") <= max_repeats, F.col("level"))).over(own))
    expected = F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.least(F.coalesce(F.col("final") * F.col("w"), F.lit(float(max_repeats))), F.lit(float(max_repeats))))
    return t.select("source", "grade", expected.alias("expected"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3.0, seed: int = 20,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None, buckets: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, extra, taken.

    The documents of a source share its target by weight.  A document of n words weighs n ^ -0.25, so that each of the many short
    ones is likelier to come than a long one; weight_col gives other weights.  Weights are rounded to eighths of a doubling.
    No document is expected more than max_repeats times; see class_levels().
    The whole part of its expected copies a document gets with certainty (copies).  The fraction is its inclusion probability
    p: documents are ranked by (u / (1 - u)) / (p / (1 - p)) and the lowest are taken once more (extra) until the words taken
    are nearest to the source's target, at most half of one document away.

    No task sees a whole source: ranks fall into `buckets` value ranges, words are summed per range, and only
    within one range are rows ordered.  u comes from id, text, source and, of rows that agree in these, the number of the row,
    so that rows with one id, or without any, are spread as others are.
    Null texts and texts of white space have size 0 and are taken 0 times 0 words; null sources are one source,
    the last; null ids are told apart by text; rows that repeat are documents of their own; weights that are null, not above 0 or
    no numbers count as 0, and nothing is taken from a source that has no others; no rows give no rows.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    base = docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                       F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), *([F.col(weight_col).cast("double").alias("given")] if weight_col else []))
    own = F.col("given") if weight_col else F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(-0.25))
    base = base.withColumn("grade", F.round(F.log2(F.when((own > 0) & (own < float("inf")), own)) * 8).cast("int"))
    same = Window.partitionBy("doc_id", "digest", "source").orderBy(F.lit(1))
    what = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.coalesce("source", F.lit("")), F.row_number().over(same).cast("string"))
    base = materialize(base.withColumn("u", uniform(what, seed)).drop("digest", "given"), "mix-sizes")
    classes = base.groupBy("source", "grade").agg(F.sum("size").alias("words"))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_repeats).drop("w"), "mix-targets")
    levels = class_levels(classes.join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s"), max_repeats)
    goals = (materialize(levels, "mix-levels").withColumnsRenamed({"source": "s2", "grade": "g2"})
             .join(targets.withColumnRenamed("source", "s"), F.expr("s2 <=> s")).drop("s"))
    rows = base.join(goals, F.expr("source <=> s2 and grade <=> g2")).drop("s2", "g2", "grade")
    rows = rows.withColumn("copies", F.floor("expected")).withColumn("p", F.col("expected") - F.col("copies"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, odds)).withColumn(
        "b", F.floor(F.col("q") / (1 + F.col("q")) * buckets))
    per = rows.groupBy("source", "b").agg(
        F.sum(F.when(F.col("q").isNotNull(), F.col("size"))).alias("words"),
        F.sum(F.col("copies") * F.col("size")).alias("sure"), F.first("target").alias("goal"))
    whole = Window.partitionBy("source")
    before = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("rest", F.col("goal") - F.sum("sure").over(whole))
           .withColumn("earlier", F.coalesce(F.sum("words").over(before), F.lit(0)))
           .select(F.col("source").alias("s3"), F.col("b").alias("b3"), "rest", "earlier"))
    rows = rows.join(per, F.expr("source <=> s3 and b <=> b3"))
    inside = Window.partitionBy("source", "b").orderBy("q", "doc_id", "size", "u").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    rows = rows.withColumn("extra", F.when(F.col("q").isNotNull() & (reached <= F.col("rest")), 1).otherwise(0))
    return rows.select(*keep, "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
                       "extra", ((F.col("copies") + F.col("extra")) * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as mix() takes it, copy_no counting from 1.

    Rows that agree in id, text and source share what they take together; the columns are those of one of them.  If docs has a
    column copy_no, the new one gets an underscore behind its name.
    """
    id_col, text_col, source_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    # A hash passes nulls over, so that they are said apart.
    parts = [F.col(c) for c in (id_col, text_col, source_col)]
    k1, k2 = hash128(*parts, *[c.isNull() for c in parts])
    needed = {c for c in (id_col, text_col, source_col, options.get("weight_col")) if c}
    own = docs.select(*[F.col(c).alias(f"in_{c}") for c in sorted(needed)], F.struct(k1.alias("k1"), k2.alias("k2")).alias("row_key"))
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col, **({"weight_col": options["weight_col"]} if options.get("weight_col") else {})}
    taken = mix(own, keep=("row_key",), **{**options, **{k: f"in_{v}" for k, v in names.items()}})
    times = (taken.groupBy("row_key").agg(F.sum(F.col("copies") + F.col("extra")).cast("int").alias("n"))
             .where("n > 0").select("row_key.k1", "row_key.k2", "n"))
    out = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2")).join(times, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias(unused("copy_no", docs.columns)))
