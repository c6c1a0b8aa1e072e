"""Mix sources to target weights: nested hash histograms find each source's threshold without sorting rows.

A document's hash is a fixed function of its id. Tokens are summed by source and the leading bits of the
hash; the bucket in which the running sum crosses the budget is the boundary. Only its rows are summed
again by the next bits, and a third time by the whole hash. What lies below the threshold is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, WORD, materialize

WEIGHTS = (3, 1, 2)
#: Bits of the 60-bit hash that the first two histograms use.
LEVELS = (12, 16)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash60(key: Column) -> Column:
    """60 bits of md5 of the id as text; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) by filling up to the caps.

    Sources in code-point order, null last, weigh weights in turn. Targets share `share` times all sizes by weight;
    none is above `most` times its source's size, and what is cut off goes to the others by weight. With the sources
    in the order of cap / weight, those up to some point are capped and the rest get the same level times weight.
    The one window here is over one row per source, not per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    )
    # The first source that isn't capped sets the level for all behind it.
    ranked = ranked.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything).getField("level"))
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash")), "mix-sizes")


def mix_limits(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Per source: source_size, target, whole (copies of all its rows) and the threshold of the further copy.

    Each level sums the rows that share the hash prefix found so far by the next bits, and finds the bucket in which
    the running sum crosses what is left of the budget. The last level's bucket is a whole hash.
    """
    targets = source_targets(sizes, share, most)
    targets = targets.withColumn("whole", F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(int(most)))).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")
    open_rows, bounds, used = sizes, targets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix")), 0
    for bits in (*LEVELS, 60 - sum(LEVELS)):
        used += bits
        bucket = F.shiftright("hash", 60 - used)
        sums = open_rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
        sums = sums.withColumn("running", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
        edge = sums.join(bounds.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of"))).where(F.col("running") > F.col("left"))
        edge = edge.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("running") + F.col("sum")).alias("left")), "bucket").alias("edge"))
        bounds = materialize(edge.select("source", F.col("edge.bucket").alias("prefix"), F.col("edge.left").alias("left")), "mix-bounds")
        if used < 60:
            at = bounds.select(F.col("source").alias("of"), "prefix")
            open_rows = open_rows.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", 60 - used) == F.col("prefix"))).select("source", "size", "hash")
    # A source without an edge takes all its rows; else those with a hash below that of the first row that doesn't fit.
    limits = targets.join(bounds.select(F.col("source").alias("of"), F.col("prefix").alias("threshold")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # Written, so that its size is known: Spark broadcasts it only below its own threshold.
    return materialize(limits.select(F.col("source").alias(f"{OWN}source"), F.col("source_size").alias(f"{OWN}source_size"), F.col("target").alias(f"{OWN}target"), F.col("whole").alias(f"{OWN}whole"), F.col("threshold").alias(f"{OWN}threshold")), "mix-limits")


def copies(hash_of: Column, most: float) -> Column:
    """How often a row joined with its source's limits is taken."""
    whole, threshold = F.col(f"{OWN}whole"), F.col(f"{OWN}threshold")
    return F.least(whole + F.when(threshold.isNull() | (hash_of < threshold), 1).otherwise(0), F.lit(int(most))).cast("int")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: doc_id, source, size (words), source_size, target (both of its source), copies (0
    to 2) and taken (size * copies). A source whose target is r times its size takes floor(r) whole copies, and one
    more of the documents whose hash is below the threshold at which their sizes come nearest under the rest.
    Rows that repeat an id share its hash, so all or none of them get the further copy. A null text has size 0, a null
    source is a source of its own, null ids share a hash. Other columns are ignored; an empty table gives no rows.
    Reruns agree: nothing depends on the partitioning.
    """
    sizes = sized(docs, id_col, text_col, source_col)
    taken = sizes.join(mix_limits(sizes, share, most), F.col("source").eqNullSafe(F.col(f"{OWN}source"))).withColumn("copies", copies(F.col("hash"), most))
    return taken.select("doc_id", "source", "size", F.col(f"{OWN}source_size").alias("source_size"), F.col(f"{OWN}target").alias("target"), "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the input's columns, a row for each time that a document is taken. See mix_sources."""
    limits = mix_limits(sized(docs, id_col, text_col, source_col), share, most)
    times = f"{OWN}copies"
    joined = docs.join(limits, F.col(source_col).eqNullSafe(F.col(f"{OWN}source")))
    counted = joined.withColumn(times, copies(hash60(F.col(id_col)), most)).where(F.col(times) > 0)
    return counted.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
