"""Choosing sources for an answer and checking its claims against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def choose_within_budget(items: Column, most: int, budget: int) -> Column:
    """Of an ordered array of structs with a cost, those that fit; one that doesn't is passed over, later ones may fit."""

    def step(state: Column, item: Column) -> Column:
        fits = (F.size(state["chosen"]) < most) & (state["used"] + item["cost"] <= budget)
        return F.struct(F.when(fits, state["used"] + item["cost"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["chosen"], F.array(item))).otherwise(state["chosen"]).alias("chosen"))

    return F.aggregate(items, F.struct(F.lit(0).alias("used"), F.filter(items, lambda _: F.lit(False)).alias("chosen")), step)["chosen"]


def verify_claims(claims: DataFrame, sources: DataFrame, least_words: int = 4) -> DataFrame:
    """Adds reason to claims(answer_id, claim_id, text, labels, quote); null means that the claim stands.

    sources: (answer_id, label, excerpt, citation). In order: no valid source, a quote that is too short, a quote that
    is in none of the claim's own sources, a reference that they don't support.
    """
    named = claims.select("answer_id", "claim_id", "text", "quote", F.explode_outer(T.labels(F.col("labels"))).alias("label"))
    held = named.join(sources, ["answer_id", "label"], "left")
    found = F.col("excerpt").isNotNull()
    per = held.groupBy("answer_id", "claim_id").agg(
        F.first("text").alias("text"), F.first("quote").alias("quote"), F.count_if(found).alias("n_valid"), F.count_if(~found & F.col("label").isNotNull()).alias("n_unknown"),
        F.max(F.when(found, T.quote_in(F.col("quote"), F.col("excerpt")))).alias("quoted"),
        F.filter(F.collect_list(T.neutral_citation(F.col("citation"))), lambda c: c.isNotNull()).alias("own"), F.concat_ws(" ", F.collect_list("excerpt")).alias("passages"),
    )
    reason = (
        F.when(F.col("n_valid") == 0, "no_valid_source")
        .when(T.quote_words(F.col("quote")) < least_words, "quote_too_short")
        .when(~F.coalesce(F.col("quoted"), F.lit(False)), "quote_not_found")
        .when(~T.references_supported(F.col("text"), F.col("own"), F.col("passages")), "unsupported_reference")
    )
    return per.select("answer_id", "claim_id", "n_valid", "n_unknown", reason.alias("reason"))


def leading_and_closing(items: Column, closing: int = 2) -> Column:
    """Of the passages of a named case, in order: the first and the last ones, each once."""
    n = F.size(items)
    return F.when(n > 0, F.array_distinct(F.concat(F.slice(items, 1, 1), F.slice(items, F.greatest(n - closing + 1, F.lit(1)), F.lit(closing))))).otherwise(items)


def choose_sources(items: Column, per_case: int = 2, most: int = 8, budget: int = 4000) -> Column:
    """Sources of an answer from an ordered array of structs with case and cost: so many of a case, so many in all, within a budget.

    One that doesn't fit is passed over; later ones may fit.
    """

    def step(state: Column, item: Column) -> Column:
        own = F.size(F.filter(state["chosen"], lambda c: c["case"] == item["case"]))
        fits = (F.size(state["chosen"]) < most) & (own < per_case) & (state["used"] + item["cost"] <= budget)
        return F.struct(F.when(fits, state["used"] + item["cost"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["chosen"], F.array(item))).otherwise(state["chosen"]).alias("chosen"))

    return F.aggregate(items, F.struct(F.lit(0).cast("long").alias("used"), F.filter(items, lambda _: F.lit(False)).alias("chosen")), step)["chosen"]


def offered(cases: Column, per_case: int = 2, named: Column | None = None, closing: int = 2) -> Column:
    """The passages that an answer may cite, case by case, from an ordered array of structs with passages, an ordered array.

    The first ones of each case; of the first case, where named says that the question names it, its leading and its
    closing passages instead.
    """
    named = F.lit(False) if named is None else named
    return F.flatten(F.transform(cases, lambda c, i: F.when(named & (i == 0), leading_and_closing(c["passages"], closing)).otherwise(F.slice(c["passages"], 1, per_case))))


def opened(quote: Column, marker: Column, passages: Column) -> Column:
    """Which passage a claim's marker opens, and whether its quote is marked there.

    passages are those of the marker's source, null if there is no such source. Without a marker, and where the source
    holds the quoted passage, it is that one; else the source's first passage, unmarked, if it has any.
    """
    own = marker.isNull() | passages.isNull() | F.coalesce(F.array_contains(passages, quote), F.lit(False)) | (F.size(passages) == 0)
    return F.struct(F.when(own, quote).otherwise(F.get(passages, F.lit(0))).alias("chunk_id"), F.coalesce(own, F.lit(True)).alias("marked"))


def check_support(claims: DataFrame, sources: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(answer_id, claim_id, verdict, score) of claims(answer_id, claim_id, text, label) that cite sources(answer_id, label, excerpt, parts).

    parts are the sentences of an excerpt. A claim that stands in an excerpt word for word is supported with score 1. Else
    each run of one to three sentences is judged: the best share of the claim's longer words that a run holds must
    reach the threshold, and that run must entail it. Else it is contradicted if the whole excerpt says so, or not entailed.
    """
    j = claims.join(sources, ["answer_id", "label"])
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 3))
    told = lambda run: F.struct(T.containment(words(F.col("text")), words(run)).alias("share"), (T.entails(run, F.col("text")) == "entailment").alias("entails"))
    best = F.array_max(F.transform(T.sentence_windows(F.col("parts")), told))
    verbatim = T.plain_text(F.col("excerpt")).contains(T.plain_text(F.col("text")))
    per = j.select("answer_id", "claim_id", verbatim.alias("verbatim"), best.alias("best"), (T.entails(F.col("excerpt"), F.col("text")) == "contradiction").alias("against"))
    g = per.groupBy("answer_id", "claim_id").agg(F.max("verbatim").alias("verbatim"), F.max("best").alias("best"), F.max("against").alias("against"))
    held = F.coalesce((F.col("best.share") >= threshold) & F.col("best.entails"), F.lit(False))
    verdict = F.when(F.col("verbatim"), "verbatim").when(held, "entailed").when(F.col("against"), "contradicted").otherwise("not_entailed")
    return g.select("answer_id", "claim_id", verdict.alias("verdict"), F.when(F.col("verbatim"), 1.0).otherwise(F.coalesce("best.share", F.lit(0.0))).alias("score"))


def abstain_reason(results: Column, readable: Column, abstained: Column, supported: Column) -> Column:
    """Why a question gets no answer: nothing found, a model's output that can't be read, its own wish, or no claim that holds; null if it gets one."""
    return F.when(results == 0, "no_results").when(~readable, "invalid_model_output").when(abstained, "model_abstained").when(supported == 0, "no_supported_claims")
