"""The order of a run's progress events: stages, then sources, then exactly one answer or error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES, FINALS = "sources", ("answer", "error")


def violations(events: DataFrame, run: Sequence[str], order: Sequence[str], kind: str, stages: Sequence[str]) -> DataFrame:
    """The events that break a rule, with violation; each event has the first of the rules below that it breaks.

    unknown_kind: neither a stage nor sources nor a final; second_final: an answer or error behind one; after_final;
    sources_twice; stage_after_sources; stage_back: a stage behind a later one (a stage may repeat). A run whose last
    event comes without any final before or in it has no_final there, unless that event breaks another rule. Events of
    a run are taken in order, whose columns should tell them apart; what is known of those before is running counts and
    a running maximum, so a run is never gathered into one value.
    """
    by = Window.partitionBy(*run).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    stage = F.array_position(F.array(*map(F.lit, stages)), F.col(kind))  # 0 for what is no stage
    final, sources = F.col(kind).isin(*FINALS), F.col(kind) == SOURCES
    earlier = lambda condition: F.coalesce(F.max(F.when(condition, 1)).over(before), F.lit(0)) == 1
    known = F.coalesce((stage > 0) | final | sources, F.lit(False))
    rule: Column = (
        F.when(~known, "unknown_kind")
        .when(final & earlier(final), "second_final")
        .when(earlier(final), "after_final")
        .when(sources & earlier(sources), "sources_twice")
        .when((stage > 0) & earlier(sources), "stage_after_sources")
        .when((stage > 0) & (stage < F.coalesce(F.max(stage).over(before), F.lit(0))), "stage_back")
        .when(F.lead(F.lit(1)).over(by).isNull() & ~final & ~earlier(final), "no_final")
    )
    return events.withColumn("violation", rule).where("violation is not null")
