"""Operators on ranked rows: one copy of each, caps, fusion, reranking, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; order must end in a unique column."""
    at = "_first_of_each"
    return rows.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(at) == 1).drop(at)


def cap_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most so many rows of each key. Spark drops further rows before the shuffle."""
    at = "_cap_per_group"
    return rows.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(at) <= most).drop(at)


def ranked(rows: DataFrame, order: Sequence[Column], most: int, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """The top rows with their rank from 1, over all rows or within each key of by.

    Without keys a top-k runs first, so that the numbering sees no more than most rows.
    """
    if not by:
        return rows.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= most)


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """All rows with their place from 1 in one order, however many there are.

    Rows are sorted over all tasks and numbered within each; what is added is how many the tasks before hold, a table
    of one row per task. No window runs over the whole table.
    """
    part, at = "_numbered_part", "_numbered_at"
    path = shared_path(rows.sparkSession, "numbered")
    sorted_ = rows.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33) + 1)
    sorted_.write.parquet(path)  # written once: places must not change when a task runs again
    held = rows.sparkSession.read.schema(sorted_.schema).parquet(path)
    sizes = held.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    return held.join(before, part).withColumn(name, F.col("before") + F.col(at)).drop(part, at, "before")


def fuse(lexical: DataFrame, dense: DataFrame, identity: Sequence[str], payload: Sequence[str], k: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of two lists with a rank and a score each.

    Rows of equal identity are one; the lexical list's copy stands for both. Ties keep the order in which the lists,
    one behind the other, first name a passage.
    """
    keys = [*by, *identity]
    left = lexical.select(*keys, *(F.col(p).alias(f"l_{p}") for p in payload), F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    right = dense.select(*keys, *(F.col(p).alias(f"d_{p}") for p in payload), F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    term = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    merged = left.join(right, keys, "full")
    # Behind all lexical rows come the dense ones; a large constant stands for the first list's length.
    seen = F.coalesce(F.col("lexical_rank"), F.col("dense_rank") + (1 << 40))
    return merged.select(*keys, *(F.coalesce(f"l_{p}", f"d_{p}").alias(p) for p in payload), "lexical_rank", "lexical_score", "dense_rank", "dense_score", (term("lexical_rank") + term("dense_rank")).alias("rrf"), seen.alias("seen"))


def rerank_head(rows: DataFrame, position: str, score: str, head: int, by: Sequence[str] = ()) -> DataFrame:
    """New positions: the first rows by score, ties as before; the tail as it was."""
    order = [F.when(F.col(position) <= head, 0).otherwise(1), F.when(F.col(position) <= head, -F.coalesce(F.col(score), F.lit(0.0))), F.col(position)]
    return rows.withColumn("final", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def final_score(rows: DataFrame) -> Column:
    """rerank, else rrf, else the lexical, else the dense score, else 0; columns that aren't there are passed over."""
    known = [F.col(c) for c in ("rerank", "rrf", "lexical_score", "dense_score") if c in rows.columns]
    return F.coalesce(*known, F.lit(0.0))


def channel_of(rows: DataFrame) -> Column:
    """Which channels found a row."""
    both = F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull()
    return F.when(both, "hybrid").when(F.col("dense_rank").isNotNull(), "dense").otherwise("lexical")


def page(rows: DataFrame, position: str, offset: int, size: int) -> DataFrame:
    """A slice of one fixed ranking."""
    return rows.where(F.col(position).between(offset + 1, offset + size))


def neighbours(passages: DataFrame, chosen: DataFrame, around: int) -> DataFrame:
    """The passages at most so many ordinals from the chosen ones, of the same document."""
    c = chosen.select(F.col("doc_id").alias("of_doc"), F.col("ordinal").alias("of_ordinal"), F.col("chunk_id").alias("of_chunk"))
    return passages.join(c, (F.col("doc_id") == F.col("of_doc")) & F.col("ordinal").between(F.col("of_ordinal") - around, F.col("of_ordinal") + around)).drop("of_doc")
