"""Names that are nearly the same: trigram similarity to the best run of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def word_grams(text: Column) -> Column:
    """The trigrams of each word of a text, an array for each."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), T.trigrams)


def best_run(wanted: Column, grams: Column) -> Column:
    """The largest trigram similarity between the trigrams wanted and those of any run of words; 0 without words.

    A run grows word by word, and what it shares with it. Only runs that begin with a word that shares something are
    looked at: without a first word that doesn't, a run shares as much and holds less.
    """

    def grown(i: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(0.0).alias("best"))

        def longer(run: Column, word: Column) -> Column:
            held = F.array_union(run["held"], word)
            shared = F.size(F.array_intersect(wanted, held))
            return F.struct(held.alias("held"), F.greatest(run["best"], shared / (F.size(wanted) + F.size(held) - shared)).alias("best"))

        return F.aggregate(F.slice(grams, i + 1, F.size(grams)), start, longer)["best"]

    begins = F.filter(F.transform(grams, lambda g, i: F.when(F.arrays_overlap(g, wanted), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(F.transform(begins, grown)), F.lit(0.0))


def word_similarity(wanted: Column, text: Column) -> Column:
    return best_run(wanted, word_grams(text))


def similar_names(asked: DataFrame, asked_col: str, held: DataFrame, held_col: str, least: float) -> DataFrame:
    """Pairs whose word similarity is at least `least`, which is above 0, with similarity.

    Equal names are compared once. A run of words has no trigram that its text hasn't, so a pair shares least times the
    asked trigrams at least, and so at least one of any few more than the others: only each asked name's rarest
    trigrams, by the number of held names that have them, are keys of the join, and common ones meet no one. Pairs that
    share enough then have their runs compared, dealt out over as many tasks as the session shuffles to, as little data
    makes much work here.
    """
    # Rows without trigrams go by explode_outer: a filter on trigrams would be moved below distinct, to every row.
    a = asked.select(asked_col).distinct().withColumn("_wanted", T.trigrams(F.col(asked_col)))
    h = held.select(F.col(held_col).alias("_text")).where("_text is not null").distinct().withColumn("_words", word_grams(F.col("_text"))).withColumn("_grams", F.array_distinct(F.flatten("_words")))
    grams = h.select("_text", F.explode("_grams").alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    rare = a.select(asked_col, F.explode_outer("_wanted").alias("_gram")).where("_gram is not null").join(counts, "_gram", "left").groupBy(asked_col).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g")))).alias("_all"))
    needed = F.ceil(F.size("_all") * F.lit(least) - 1e-9).cast("int")
    keys = rare.select(asked_col, F.explode(F.slice("_all", F.lit(1), F.size("_all") - needed + 1)).alias("x")).select(asked_col, F.col("x.g").alias("_gram"))
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = grams.join(keys, "_gram").select(asked_col, "_text").distinct().repartition(tasks, asked_col, "_text")
    pairs = near.join(a, asked_col).join(h, "_text").where(F.size(F.array_intersect("_wanted", "_grams")) >= F.size("_wanted") * F.lit(least) - 1e-9)
    # Exploded as the only item of an array, so that the filter takes the value and doesn't work it out again.
    told = pairs.select(asked_col, "_text", F.explode(F.array(best_run(F.col("_wanted"), F.col("_words")))).alias("similarity")).where(F.col("similarity") >= least)
    return held.join(told, held[held_col] == told["_text"]).drop("_text")
