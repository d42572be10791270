"""Relevance of a posting to an intent, as one expression. The two profiles differ in what they read and weigh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import search_normalise
from millrace.operators.intent import LADDER, Intent

# Tiers, weights and penalties of the score.
EXACT, ALIAS, ALL_TERMS, BODY_TERMS, PARTIAL, BODY = 1.00, 0.82, 0.70, 0.44, 0.34, 0.16
SKILL, TERM, COMPANY, MOST_SUPPORT, FOCUS = 0.030, 0.020, 0.015, 0.18, 0.12
RIVAL, NOISE, STEP, MOST_STEPS = 0.35, 0.15, 0.20, 0.62
WHERE = {"exact": 1.25, "metro": 1.18, "region": 1.00, "remote": 0.78}
ELSEWHERE, NOT_REMOTE, LONG_TEXT, LONG = 0.55, 0.2, 1.04, 400
DECAY_DAYS = 14.0


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _any_in(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        if p:
            out = out | text.contains(p)
    return out


def _count(tests) -> Column:
    return sum((t.cast("int") for t in tests), F.lit(0))


def recency(ts: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0
    return F.exp(-F.greatest(F.lit(0.0), days) / DECAY_DAYS)


def prepare(postings: DataFrame, profile: str = "batch") -> DataFrame:
    """postings with the normalised texts that every query's score reads; keep it when scoring several queries."""
    body = ["title", "skills", "tags", "summary"] + ["description"] * (profile == "batch")
    texts = {"skills": F.array_join("skills", " "), "tags": F.array_join("tags", " "), "description": F.substring("description", 1, 3000)}
    hay = F.concat_ws(" ", *[texts.get(c, F.col(c)) for c in body])
    return postings.withColumns({"title_n": search_normalise(F.col("title")), "hay_n": search_normalise(hay), "company_n": search_normalise(F.col("company"))})


def title_tier(title: Column, intent: Intent) -> Column:
    if not intent.terms:
        return F.lit(ALL_TERMS)
    words = F.split(title, " ")
    present = _count(F.array_contains(words, t) for t in intent.terms)
    n = len(intent.terms)
    return (F.when(title.contains(intent.normalised) if intent.normalised else F.lit(False), EXACT).when(_any_in(title, intent.aliases), ALIAS)
            .when(present == n, ALL_TERMS).otherwise(present * (PARTIAL / n)))


def title_focus(title: Column, intent: Intent) -> Column:
    phrases = [p for p in (intent.normalised, *intent.aliases) if p]
    best = F.greatest(F.lit(0), F.lit(0), *[F.when(title.contains(p), len(p)).otherwise(0) for p in phrases])
    words = F.filter(F.split(title, " "), lambda w: w != "")
    covered = F.size(F.filter(words, lambda w: F.array_contains(_strings(intent.terms), w))) / F.size(words)
    return F.when(title == "", 0.0).when(best == 0, covered).otherwise(F.least(F.lit(1.0), best / F.length(title)))


def support(hay: Column, company: Column, intent: Intent) -> Column:
    words = F.split(hay, " ")
    out = SKILL * _count(hay.contains(s) for s in intent.skills if s) + TERM * _count(F.array_contains(words, t) for t in intent.terms)
    return F.least(F.lit(MOST_SUPPORT), out + COMPANY * _any_in(company, intent.terms).cast("int"))


def seniority_fit(level: Column, wanted: str) -> Column:
    if not wanted:
        return F.lit(1.0)
    rungs = F.array_position(_strings(LADDER), level)
    away = F.abs(rungs - (LADDER.index(wanted) + 1))
    return F.when(rungs == 0, 1.0).otherwise(1.0 - F.least(F.lit(MOST_STEPS), away * STEP))


def text_score(intent: Intent) -> Column:
    """What a prepare()d row's texts alone are worth. Where many postings share texts, compute it once for each before they meet."""
    title, hay, company = F.col("title_n"), F.col("hay_n"), F.col("company_n")
    tier, backing = title_tier(title, intent), support(hay, company, intent)
    words = F.split(hay, " ")
    all_in_body = F.lit(bool(intent.terms))
    for t in intent.terms:
        all_in_body = all_in_body & F.array_contains(words, t)
    base = F.when(tier > 0, tier + backing + FOCUS * title_focus(title, intent)).when(all_in_body, BODY_TERMS + backing).when(backing > TERM, BODY + backing).otherwise(0.0)
    if intent.family and intent.rivals:
        base = base * F.when(_any_in(title, intent.rivals) & ~_any_in(title, intent.aliases), RIVAL).otherwise(1.0)
    return base


def relevance(intent: Intent, as_of: Column, *, ts: Column, level: Column | None = None, noise: Column | None = None, locality: Column | None = None, remote_only: bool = False,
              remote: Column | None = None, description: Column | None = None, profile: str = "batch", digits: int | None = 5, base: Column | None = None) -> Column:
    """Score of a prepare()d row. locality is the kind of place match, where the query names a place; base, text_score() if it is known."""
    base = text_score(intent) if base is None else base
    if noise is not None:
        base = base * F.when(noise, NOISE).otherwise(1.0)
    if level is not None:
        base = base * seniority_fit(level, intent.seniority)
    out = base * (0.70 + 0.30 * recency(ts, as_of))
    if profile == "batch":
        if locality is not None:
            weight = F.lit(ELSEWHERE)
            for kind, w in WHERE.items():
                weight = F.when(locality == kind, w).otherwise(weight)
            out = out * weight
        if remote_only and remote is not None:
            out = out * F.when(remote == "remote", 1.0).otherwise(NOT_REMOTE)
        if description is not None:
            out = out * F.when(F.length(description) > LONG, LONG_TEXT).otherwise(1.0)
    return F.round(out, digits) if digits is not None and profile == "batch" else out
