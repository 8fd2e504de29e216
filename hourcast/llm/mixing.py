"""Operator 6: mixing sources to target weights with Pareto order sampling.

A source's target is its weight's share of all words, at most ``cap`` times its
own size; what is above is shared again by weight (a water level over the
sources). A source first takes floor(target / size) whole copies of every
document. The rest is a fixed-size sample with unequal probabilities: a document
of size class m is included with probability min(1, c * m), c solved so that the
expected words are the rest; documents are ranked by their random odds divided by
their inclusion odds and taken in that order until the words are reached; the gap
that is left goes to the one document that fits it best.

Ranks lie in buckets that are summed before anything is sorted, so only the
bucket that holds the end of a source's sample is put in order; a source of any
share never meets in one task. Random numbers are hashes of doc_id: reruns agree.

Cases: a null source is a source of its own (sorted last); null or empty texts
have size 0 and take 0 words; rows that repeat are taken each by its own, equal
rows being interchangeable; sources of size 0 have target 0; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import byte_words, lean, share, stored

#: Buckets of ranks in a source; only one of them is sorted.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lean(texts):
            yield pd.Series([len(byte_words(t)) for t in part], dtype="int64")

    return run(text)


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so the
    unpartitioned windows see the list of sources and never documents."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    s = sources.withColumn("w", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int")))
    s = s.withColumn("most", cap * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    lower, upper = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("all", F.sum("source_size").over(everything).cast("double"))
    # the level at which the remaining sources share what the full ones leave
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(lower), F.lit(0.0))) / F.sum("w").over(upper))
    s = s.withColumn("open", F.col("level") * F.col("w") <= F.col("most"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), "most")).alias("target"))


def size_class(size: Column) -> Column:
    """A size rounded down to one of eight steps a doubling: under 8 * 64 classes."""
    return F.pow(F.lit(2.0), F.floor(8 * F.log2(F.greatest(size, F.lit(1)).cast("double"))) / 8)


def factors(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with ``whole`` copies, ``rest`` words and the factor ``c`` of the inclusion probabilities."""
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    classes = sized.where("size > 0").groupBy("source", size_class(F.col("size")).alias("m")).agg(F.sum("size").cast("double").alias("words"))
    classes = classes.alias("k").join(goals.select("source", "rest").alias("g"), F.col("k.source").eqNullSafe(F.col("g.source"))).select("k.*", "g.rest")
    large = Window.partitionBy("source").orderBy(F.desc("m"))
    above, below = large.rowsBetween(Window.unboundedPreceding, -1), large.rowsBetween(0, Window.unboundedFollowing)
    # c if every larger class is certain and this one and the smaller ones are not; the first that agrees with itself
    c = (F.col("rest") - F.coalesce(F.sum("words").over(above), F.lit(0.0))) / F.sum(F.col("m") * F.col("words")).over(below)
    found = classes.withColumn("c", c).where(F.col("c") * F.col("m") <= 1 + 1e-12).groupBy("source").agg(F.max(F.struct("m", "c"))["c"].alias("c"))
    return goals.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left").select("g.*", F.greatest(F.coalesce("f.c", F.lit(0.0)), F.lit(0.0)).alias("c"))


def mixed(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 6, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row, with the columns
    ``carry`` of ``docs`` as one struct column ``row`` if they are named."""
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    # the row number is stored with the row: it tells equal rows apart from here on
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row_no"), *more), "mix-sizes")
    slim = sized.select("doc_id", "source", "size", "row_no")
    goals = stored(factors(slim, targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, cap)), "mix-goals")

    p = F.least(F.col("c") * size_class(F.col("size")), F.lit(1.0))
    u = share("doc_id", seed)
    # random odds over inclusion odds, as x / (1 + x): 0 for certain documents, under 1 for all
    rank = F.when(p > 0, u * (1 - p) / (u * (1 - p) + p * (1 - u))).otherwise(F.lit(1.0))

    def ranked(rows: DataFrame) -> DataFrame:
        at = rows.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", *(F.col(f"g.{x}") for x in ("source_size", "target", "whole", "rest", "c")))
        return at.withColumn("pos", rank).withColumn("bucket", F.least(F.floor(F.col("pos") * BUCKETS), F.lit(BUCKETS - 1)))

    filled = ranked(slim).where("rest > 0 and c > 0 and size > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = filled.withColumn("upto", upto).where("upto >= rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("e"))
    ends = stored(ends.select("source", F.col("e.bucket").alias("last"), "e.left"), "mix-ends")

    def picked(rows: DataFrame) -> DataFrame:
        """Rows with ``more``: whether the sample has them. It stops before the words would be too many."""
        rows = ranked(rows).alias("r").join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left").select("r.*", "e.last", "e.left")
        open_ = (F.col("rest") > 0) & (F.col("c") > 0) & (F.col("size") > 0)
        border = open_ & F.coalesce(F.col("bucket") == F.col("last"), F.lit(False))
        clear = rows.where(~border).withColumn("more", open_ & (F.col("last").isNull() | (F.col("bucket") < F.col("last"))))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("pos", "doc_id", "size", "row_no"))
        return clear.unionByName(rows.where(border).withColumn("more", upto <= F.col("left")))

    # what is left goes to the document outside the sample that fits it best, if that comes nearer to the target
    slack = picked(slim)
    gaps = slack.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap"))
    fits = slack.where("not more and size > 0").alias("p").join(gaps.where("gap > 0").alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "g.gap")
    fits = fits.where("abs(gap - size) < gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "doc_id", "row_no"))["row_no"].alias("extra"))
    extras = stored(fits, "mix-extras")

    both = picked(sized).alias("b").join(extras.alias("x"), F.col("b.source").eqNullSafe(F.col("x.source")), "left").select("b.*", "x.extra")
    both = both.withColumn("copies", F.col("whole") + (F.col("more") | F.coalesce(F.col("row_no") == F.col("extra"), F.lit(False))).cast("long"))
    kept = [F.col("row")] if carry else []
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)


def copies_of(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 6) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it."""
    rows = mixed(docs, cycle, cap, seed, carry=docs.columns)
    return rows.where("copies > 0 and size > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
