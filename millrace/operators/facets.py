"""Counts and summaries of a corpus and of its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def tier_summary(rows: DataFrame, tier: str = "source_tier") -> DataFrame:
    first = F.count_if(F.col(tier) == "tier1")
    return rows.agg(first.alias("tier1"), (F.count("*") - first).alias("tier2"))


def health(runs: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """Per source: sums, ok if any run was, and the last error if none was."""
    last = F.max_by(F.when(F.col("error") != "", F.col("error")), F.when(F.col("error") != "", F.col(seq)))
    return runs.groupBy(source).agg(F.sum("jobs_found").alias("jobs_found"), F.sum("duration_ms").alias("duration_ms"), F.bool_or("ok").alias("ok"),
                                    last.alias("error")).withColumn("error", F.when(F.col("ok"), "").otherwise(F.coalesce("error", F.lit(""))))


def health_order(health: DataFrame) -> DataFrame:
    """Failed sources first, then by postings found, most first."""
    return health.orderBy("ok", F.desc("jobs_found"), "source")


def health_state(health: DataFrame) -> DataFrame:
    """One row: healthy and degraded sources, and a light that is green without failures and red from three on."""
    failed = F.count_if(~F.col("ok"))
    return health.agg(F.count_if("ok").alias("healthy"), failed.alias("degraded"), F.when(failed == 0, "green").when(failed < 3, "amber").otherwise("red").alias("light"))


def meta(rows: DataFrame, runs: DataFrame, tier: str = "source_tier") -> DataFrame:
    """One row: totals of postings, and of sources that worked or failed."""
    totals = rows.agg(F.count("*").alias("total"), F.count_if(F.col(tier) == "tier1").alias("tier1"), F.count_if("enriched").alias("enriched"))
    sources = runs.agg(F.count_if("ok").alias("sources_ok"), F.count_if(~F.col("ok")).alias("sources_failed"))
    return totals.crossJoin(sources)  # one row each


def explode_count(rows: DataFrame, places: Column, name: str) -> DataFrame:
    """Rows per value, where a row counts once for each value it names."""
    return rows.select(F.explode(F.array_distinct(places)).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def phrase_facet(rows: DataFrame, text: str, families: dict[str, list[str]]) -> DataFrame:
    """Rows whose text holds any phrase of each family, zeros kept: one pass of conditional counts."""
    tests = {}
    for name, phrases in families.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.col(text).contains(p)
        tests[name] = F.count_if(hit)
    counted = rows.agg(*[v.alias(k) for k, v in tests.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(f"`{k}`").alias("n")) for k in tests])).alias("x")).select("x.*")


def facet_values(rows: DataFrame, col: str) -> DataFrame:
    return rows.where(F.col(col) != "unknown").select(col).distinct().orderBy(col)


def marks_by_kind(tracker: DataFrame, kinds: list[str]) -> DataFrame:
    counted = tracker.agg(*[F.count_if(F.col("mark") == k).alias(k) for k in kinds])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


def audit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows per board, boards without any left out, and a grand total row of nulls."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where(F.col("g").isin(0, 2 ** len(by) - 1)).drop("g")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    from functools import reduce

    one = [df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), one)
