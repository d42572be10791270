"""A text's score out of a hundred: criteria that a model judged, read from answers nobody vouches for, and one that patterns decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.quality import COST, OTHER_COST, band, language_score

# How much of what a model says is kept.
REASON, SUMMARY, FIXES, KEYWORDS = 300, 600, 5, 12


@dataclass(frozen=True)
class Rubric:
    """Criteria with their weights, which of them the patterns decide, and the bands of totals (least total, name)."""

    weights: dict[str, float]
    own: str
    bands: tuple[tuple[float, str], ...]


def answer_of(text: Column) -> Column:
    """A model's answer as a variant: JSON, in a fence or not; null where it is none."""
    return F.try_parse_json(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def _said(answer: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(answer, path, kind)


def score(texts: DataFrame, answers: DataFrame, found: DataFrame, rubric: Rubric, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row for each text that is not blank: id_col, total, partial, band, scores (array of criterion, score, max, reason, in the rubric's order), fixes (JSON texts),
    keywords, summary.

    answers: (id_col, answer), at most one a text; found: quality.findings() of the texts. A score that is no number counts as none, none as 0; every score is
    held between 0 and its criterion's weight, whatever the model says, so that a total is at most the weights'. Without an answer that holds an object of scores the report
    is partial: it has the own criterion alone, the gravest findings as fixes, and no total or band. Ids are unique; null ids have no answer."""
    weight = rubric.weights[rubric.own]
    own = texts.where(F.coalesce(text_col, F.lit("")).rlike(r"(?U)\S")).where(F.col(id_col).isNotNull())
    cost = F.coalesce(F.create_map(*[F.lit(x) for kv in COST.items() for x in kv])[F.col("severity")], F.lit(OTHER_COST))
    told = found.groupBy(id_col).agg(F.count("*").alias("n_"), F.sum(cost).alias("cost_"), F.slice(F.array_sort(F.collect_list(F.struct("start", "rule", "excerpt"))), 1, FIXES).alias("worst_"))
    read = answers.select(F.col(id_col), answer_of(F.col("answer")).alias("a_"))
    rows = (own.select(id_col).join(told, id_col, "left").join(read, id_col, "left")
            .withColumns({"findings": F.coalesce("n_", F.lit(0)), "points": language_score(F.least(F.coalesce("cost_", F.lit(0.0)), F.lit(float(weight))), weight)}))
    usable = F.coalesce(_said(F.col("a_"), "$.scores", "map<string, variant>").isNotNull(), F.lit(False))

    def judged(name: str) -> Column:
        raw = _said(F.col("a_"), f"$.scores['{name}'].score", "double")
        raw = F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(raw)
        return F.greatest(F.lit(0.0), F.least(raw, F.lit(float(rubric.weights[name]))))

    def row(name: str, points: Column, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("criterion"), F.round(points, 1).alias("score"), F.lit(float(rubric.weights[name])).alias("max"), F.coalesce(reason, F.lit("")).alias("reason"))

    told = F.format_string("%d language issues found by pattern check.", "findings")
    mine = row(rubric.own, F.col("points"), told)
    every = [mine if n == rubric.own else row(n, judged(n), F.substring(_said(F.col("a_"), f"$.scores['{n}'].reason", "string"), 1, REASON)) for n in rubric.weights]
    total = F.round(sum((F.col("points") if n == rubric.own else judged(n) for n in rubric.weights), F.lit(0.0)), 1)
    none = F.array().cast("array<string>")
    said_fixes = F.transform(_said(F.col("a_"), "$.top_fixes", "array<variant>"), lambda v: F.to_json(v))
    own_fixes = F.transform("worst_", lambda w: F.to_json(F.struct(F.lit(rubric.own).alias("criterion"), w["rule"].alias("problem"), w["excerpt"].alias("excerpt"))))
    few = lambda xs, n: F.slice(F.coalesce(xs, none), 1, n)
    partial = F.lit("Only the check by patterns ran: there is no answer to grade the other criteria by, and so no total.")
    return rows.select(
        id_col, F.when(usable, total).alias("total"), (~usable).alias("partial"), F.when(usable, band(total, list(rubric.bands))).alias("band"),
        F.when(usable, F.array(*every)).otherwise(F.array(mine)).alias("scores"), F.when(usable, few(said_fixes, FIXES)).otherwise(few(own_fixes, FIXES)).alias("fixes"),
        F.when(usable, few(_said(F.col("a_"), "$.missing_keywords", "array<string>"), KEYWORDS)).otherwise(none).alias("keywords"),
        F.when(usable, F.substring(F.coalesce(_said(F.col("a_"), "$.summary", "string"), F.lit("")), 1, SUMMARY)).otherwise(partial).alias("summary"))
