"""Filters, top-k, unions of several queries' results, and the relevance floor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import FX_TO_INR, in_rupees


def within_age(ts: Column, as_of: Column, most_days: int) -> Column:
    """Whole days elapsed, at most so many; 0 is no limit."""
    return F.lit(True) if not most_days else F.timestamp_diff("DAY", ts, as_of) <= most_days


def younger_than(ts: Column, as_of: Column, days: float) -> Column:
    """The interactive filter: days with their fraction; an unknown time counts as 999 days."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0
    return F.coalesce(age, F.lit(999.0)) <= days


def min_salary(amount: Column, currency: Column, least: float, fx: dict[str, float] = FX_TO_INR) -> Column:
    return F.coalesce(in_rupees(amount, currency, fx) >= least, F.lit(False))


def has_all(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, t: a & text.contains(t), terms, F.lit(True))


def noise_title(title: Column, listed: tuple[str, ...]) -> Column:
    return (F.length(title) < 3) | title.isin(*listed) if listed else F.length(title) < 3


# What a challenge or refusal says of itself, the statuses of one, and the length below which a page is none.
BLOCK_MARKERS = ("just a moment", "checking your browser", "cf-challenge", "captcha", "recaptcha", "access denied", "unusual traffic", "enable javascript and cookies")
BLOCK_STATUSES, SHORTEST_PAGE = (403, 406, 429, 451), 500


def looks_blocked(html: Column, status: Column, markers: tuple[str, ...] = BLOCK_MARKERS, statuses=BLOCK_STATUSES, shortest: int = SHORTEST_PAGE) -> Column:
    """Whether a page is a refusal: by its status, or as it is missing, too short, or names one of the markers in its first 4000 characters. Never null."""
    head = F.lower(F.substring(html, 1, 4000))
    marked = reduce(lambda a, m: a | head.contains(m), markers, F.lit(False))
    return F.coalesce(status.isin(*statuses), F.lit(False)) | F.coalesce((F.length(html) < shortest) | marked, F.lit(True))


def top(scored: DataFrame, limit: int, least: float = 0.02, score: str = "score", ts: str = "posted_at", key: str = "id") -> DataFrame:
    """Score at least `least`, best first, then newest, then by key; 0 is no limit. Spark plans this as a take, not a sort.

    The floor comes after the take, where the optimiser cannot copy the score into a filter over all rows."""
    ordered = scored.orderBy(F.desc(score), F.desc(ts), key)
    return (ordered.limit(limit) if limit else ordered).where(F.col(score) >= least)


def top_each(rows: DataFrame, scores: dict[str, Column], limit: int, least: float = 0.02, ts: str = "posted_at", key: str = "id") -> DataFrame:
    """(query, key, score): of every query the rows that top() gives, in one pass over rows."""
    each = F.array(*[F.struct(F.lit(q).alias("query"), s.alias("score")) for q, s in scores.items()])
    long = rows.select(F.col(key), F.col(ts).alias("ts_"), F.explode(each).alias("s_")).select(key, "ts_", "s_.query", "s_.score").where(F.col("score") >= least)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("ts_"), key)
    return long.withColumn("n_", F.row_number().over(best)).where(F.col("n_") <= limit).select("query", key, "score")


def union_best(results: list[DataFrame], key: str = "id", score: str = "score") -> DataFrame:
    """Rows in any of the results, each with its best score."""
    return reduce(lambda a, b: a.unionByName(b), [r.select(key, score) for r in results]).groupBy(key).agg(F.max(score).alias(score))


def top_per_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n_") <= most).drop("n_")


# Floors of strong and near results, and when and how many near ones are shown.
FLOOR, NEAR, FEW, MOST_NEAR = 0.35, 0.22, 5, 12


def relevance_floor(scored: DataFrame, score: str = "score", order: tuple = ()) -> DataFrame:
    """Strong rows; with fewer than FEW of them, near misses instead if these are more, MOST_NEAR at most. Adds strong_count, relaxed.

    The near rows are a bounded take; only counts are shared between the branches."""
    counts = scored.agg(F.count_if(F.col(score) >= FLOOR).alias("strong_count"), F.least(F.lit(MOST_NEAR), F.count_if(F.col(score) >= NEAR)).alias("near_"))
    counts = counts.withColumn("relaxed", (F.col("strong_count") < FEW) & (F.col("near_") > F.col("strong_count"))).drop("near_")
    strong = scored.where(F.col(score) >= FLOOR).crossJoin(F.broadcast(counts.where("not relaxed")))  # one row at most
    near = scored.where(F.col(score) >= NEAR).orderBy(F.desc(score), *order).limit(MOST_NEAR).crossJoin(F.broadcast(counts.where("relaxed")))
    return strong.unionByName(near)


def sort_by(mode: str, score: str = "score", ts: str = "posted_at", salary: Column | None = None, key: str = "id") -> list[Column]:
    return {"relevance": [F.desc(score), F.desc(ts)], "newest": [F.desc(ts)], "salary": [F.coalesce(salary, F.lit(-1.0)).desc(), F.desc(score)]
            }[mode] + [F.col(key).asc()] if mode != "salary" or salary is not None else [F.col(key).asc()]


def page(rows: DataFrame, number: int, size: int = 40) -> DataFrame:
    """Of ordered rows, the number-th page from 0."""
    return rows.offset(number * size).limit(size)


def lookup(rows: DataFrame, key: str, wanted: str) -> DataFrame:
    """The row of that id, else of the one id that begins with it; raises where none or several do."""
    found = rows.where(F.col(key) == wanted).limit(1)
    if not found.isEmpty():
        return found
    found = rows.where(F.col(key).startswith(wanted)).limit(2)
    n = found.count()
    if n != 1:
        raise LookupError(f"{'no row' if not n else 'several rows'} with an id like {wanted!r}")
    return found


def find(rows: DataFrame, text: str, limit: int, ts: str = "posted_at", key: str = "id") -> DataFrame:
    hit = F.lower("title").contains(text.lower()) | F.lower("company").contains(text.lower())
    return rows.where(hit).orderBy(F.desc(ts), key).limit(limit)
