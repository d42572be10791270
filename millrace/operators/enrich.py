"""Enrichment: what an outside model says about a posting, and what is said without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import detect_seniority, extract_skills, search_normalise
from millrace.schema import SENIORITY, one_of

ANSWER = "skills array<string>, seniority string, summary string, tags array<string>, location string"


def heuristic(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Skills and seniority where they are missing, from the texts alone."""
    hay = search_normalise(F.concat_ws(" ", "title", "description"))
    return rows.withColumns({"skills": F.when(F.size("skills") == 0, extract_skills(hay, vocabulary)).otherwise(F.col("skills")),
                             "seniority": F.when(F.col("seniority") == "unknown", detect_seniority(F.col("title"), F.col("description"))).otherwise(F.col("seniority"))})


def ask(rows: DataFrame, provider: Callable[[list[dict]], list[str | None]], size: int = 8) -> DataFrame:
    """id, answer (JSON text or null) by a provider that takes batches of rows; a batch that fails is left unanswered."""
    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in found:
            for a in range(0, len(part), size):
                batch = part.iloc[a: a + size]
                try:
                    answers = provider(batch.to_dict("records"))
                except Exception:  # the model is never critical
                    answers = [None] * len(batch)
                yield pd.DataFrame({"id": batch["id"], "answer": answers})

    return rows.select("id", "title", "company", "description").mapInPandas(run, "id string, answer string")


def apply(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers put into their postings: 8 skills, a known level, 220 characters of summary, 4 tags before cross-post marks."""
    fenced = F.regexp_replace(F.col("answer"), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    whole = F.try_variant_get(F.try_parse_json(fenced), "$", "map<string, variant>").isNotNull()
    told = answers.where(whole).select("id", F.from_json(fenced, ANSWER).alias("a"))  # what is no object says nothing
    both = rows.join(told, "id", "left")
    said, marks = F.col("a").isNotNull(), F.filter("tags", lambda t: t.startswith("also:"))
    return both.withColumns({
        "skills": F.when(said & (F.size("a.skills") > 0), F.slice("a.skills", 1, 8)).otherwise(F.col("skills")),
        "seniority": F.when(said, one_of(F.col("a.seniority"), SENIORITY, "unknown")).otherwise(F.col("seniority")),
        "summary": F.when(said, F.substring(F.coalesce("a.summary", F.lit("")), 1, 220)).otherwise(F.col("summary")),
        "tags": F.when(said, F.concat(F.slice(F.coalesce("a.tags", F.array().cast("array<string>")), 1, 4), marks)).otherwise(F.col("tags")),
        "location": F.when(said & (F.col("location") == ""), F.coalesce("a.location", F.lit(""))).otherwise(F.col("location")),
        "enriched": F.col("enriched") | said}).drop("a")
