"""The batch plan: resolve what the sources gave, rank it for every saved query, keep the union, upsert and retain.

Each step is a DataFrame transformation; what several of them read is written once to the shared folder. A run's result
is written to a new place, since a path that is being read cannot be overwritten."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators import corpus, rank, resolve, score
from millrace.operators.intent import Intent
from millrace.schema import TIERS
from millrace.scratch import written


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ranked_union(postings: DataFrame, intents: list[Intent], as_of: Column, limit: int = 400) -> DataFrame:
    """Postings that any query ranks among its first, each with its best score. One pass scores all queries."""
    ts = F.coalesce("posted_at", "first_seen_at")
    scores = {str(i): score.relevance(q, as_of, ts=ts) for i, q in enumerate(intents)}
    return postings.join(rank.union_best([rank.top_each(score.prepare(postings), scores, limit)]), "id")


class Counts:
    """What a run counts on its way: rows by stage, by the jobs that it runs anyway."""

    def __init__(self):
        self.found: dict[str, Observation] = {}

    def of(self, rows: DataFrame, stage: str, **more: Column) -> DataFrame:
        self.found[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return rows.observe(self.found[stage], F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in more.items()])

    def values(self) -> dict[str, dict[str, int]]:
        """Counts by stage; waits for the jobs that make them."""
        return {stage: dict(o.get) for stage, o in self.found.items()}


def run(incoming: DataFrame, stored: DataFrame, intents: list[Intent], as_of: Column, ranking: list[str] = resolve.SOURCE_RANK, days: int = 60, limit: int = 400,
        counts: Counts | None = None) -> DataFrame:
    """The corpus after a run. What came in is written once, as is what it resolves to, since several branches read each; the rest is the plan of the result.

    counts gets the rows of the stages raw, resolved, kept and final; the last two once the result has been written, wherever to."""
    counts = counts or Counts()
    raw = written(counts.of(incoming, "raw"), "incoming")
    one = written(counts.of(corpus.latest(resolve.resolve(raw, ranking), ["id"], ["ord"]), "resolved"), "one")
    kept = counts.of(ranked_union(one, intents, as_of, limit).drop("score", "ord"), "kept")
    final = corpus.retained(corpus.upsert(stored, kept, as_of), as_of, days)
    return counts.of(final, "final", **{t: F.count_if(F.col("source_tier") == t) for t in TIERS}) if "source_tier" in final.columns else counts.of(final, "final")


def dry_run(incoming: DataFrame, stored: DataFrame, intents: list[Intent], as_of: Column, **options) -> dict[str, dict[str, int]]:
    """What run() would leave, in numbers by stage; nothing is stored."""
    counts = Counts()
    run(incoming, stored, intents, as_of, counts=counts, **options).write.format("noop").mode("overwrite").save()
    return counts.values()


def run_on_parts(records: DataFrame, ranking: list[str], intents: list[Intent], as_of: Column) -> DataFrame:
    """run() over records that lack what enrichment adds, on an empty store."""
    full = records.withColumns({"skills": F.array(F.lower("source")), "seniority": F.lit("unknown"), "summary": F.lit(""), "enriched": F.lit(False)})
    out = run(full, full.drop("ord").where(F.lit(False)), intents, as_of, ranking)
    return out.select("id", "company", "title", "source", "remote", "location", "posted_at", "first_seen_at")
