"""The interactive search: facets, age, pay and places filter, roles or a query score, the floor keeps what is relevant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.geo import Gazetteer, best_locality, locality
from millrace.functions.text import FX_TO_INR, in_rupees, search_normalise
from millrace.operators import rank, score
from millrace.operators.intent import Intent, Vocabulary, for_family, understand


@dataclass(frozen=True)
class Filters:
    q: str = ""
    cities: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    include_nearby: bool = True
    remote: str = ""
    seniority: str = ""
    source: str = ""
    max_age_days: float = 0
    min_salary: float = 0
    sort: str = "relevance"


# The name of each filter in a link.
PARAMS = {"q": "q", "cities": "cities", "roles": "roles", "include_nearby": "near", "remote": "remote", "seniority": "level", "source": "src",
          "max_age_days": "age", "min_salary": "pay", "sort": "sort"}


def from_url(query: str, g: Gazetteer | None = None) -> Filters:
    """The filters that a link's query string names. An old link's `loc` counts as one city where no cities are named."""
    given = {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
    out = {}
    for f in fields(Filters):
        raw = given.get(PARAMS[f.name])
        if raw is None:
            continue
        if f.name in ("cities", "roles"):
            out[f.name] = tuple(dict.fromkeys(v for part in raw.split(",") if (v := part.strip())))
        elif f.name == "include_nearby":
            out[f.name] = raw != "0"
        else:
            out[f.name] = float(raw or 0) if f.name in ("max_age_days", "min_salary") else raw
    if not out.get("cities") and g and (city := g.city_named(given.get("loc", "").strip())):
        out["cities"] = (city,)
    return Filters(**out)


def to_url(f: Filters) -> str:
    """A link's query string: what differs from the defaults only."""
    text = lambda v: ",".join(v) if isinstance(v, tuple) else str(int(v)) if isinstance(v, (bool, int, float)) and v == int(v) else str(v)
    given = {PARAMS[x.name]: text(v) for x in fields(Filters) if (v := getattr(f, x.name)) != x.default}
    return f"?{urlencode(given)}" if given else ""


def matches_location(location: Column, wanted: str, g: Gazetteer, remote: Column, description: Column) -> Column:
    return locality(location, wanted, g, remote, description) != ""


def matches(as_of: Column, max_age_days: int = 0, remote_only: bool = False, location: str = "", g: Gazetteer | None = None, min_score: float = 0.02) -> Column:
    """The batch filter of a scored posting: whole days of age, remote work only, a place it must satisfy, a least score."""
    keep = rank.within_age(F.coalesce("posted_at", "first_seen_at"), as_of, max_age_days)
    if remote_only:
        keep = keep & (F.col("remote") == "remote")
    if location and g:
        keep = keep & matches_location(F.col("location"), location, g, F.col("remote") == "remote", F.col("description"))
    return keep & (F.col("score") >= min_score)


def filtered(rows: DataFrame, f: Filters, roles: list[Intent], query: Intent | None, g: Gazetteer, as_of: Column, noise_titles: tuple[str, ...] = (),
             base: Callable[[Intent], Column | None] = lambda q: None, fx: dict[str, float] = FX_TO_INR) -> DataFrame:
    """prepare()d rows that pass f, with score, strong_count and relaxed, in the order of f.sort.

    Picked roles are the search: a row has its best role's score, and the query's words only narrow. Without roles the query scores;
    without either every row scores 1 and no floor holds. Nulls: a row without a time counts as 999 days old, one without pay
    has none for min_salary, and an unknown facet equals none. Ties go to the newer row, then to the id. All of it but the counts
    for the floor is one pass; the cheap filters reach the scan."""
    ts, rupees = F.coalesce("posted_at", "first_seen_at"), in_rupees(F.col("salary_max"), F.col("salary_currency"), fx)
    for c in ("remote", "seniority", "source"):
        if getattr(f, c):
            rows = rows.where(F.col(c) == getattr(f, c))
    if f.max_age_days:
        rows = rows.where(rank.younger_than(ts, as_of, f.max_age_days))
    if f.min_salary:
        rows = rows.where(rank.min_salary(F.col("salary_max"), F.col("salary_currency"), f.min_salary, fx))
    weight = F.lit(1.0)
    if f.cities:
        rows = rows.withColumn("where_", best_locality(F.col("location"), list(f.cities), g, F.col("remote") == "remote", F.col("summary"), f.include_nearby)).where("where_ <> ''")
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in score.WHERE.items() for x in kv]), F.col("where_"))
    noise = rank.noise_title(F.col("title_n"), noise_titles) if noise_titles else None
    of = lambda q: score.relevance(q, as_of, ts=ts, level=F.col("seniority"), noise=noise, profile="browser", base=base(q))
    if roles:
        if query and query.terms:
            hay = F.concat_ws(" ", "hay_n", "company_n", search_normalise(F.col("location")))
            rows = rows.where(rank.has_all(hay, list(query.terms)))
        own = F.greatest(F.lit(0.0), F.lit(0.0), *[of(q) for q in roles])
    else:
        own = of(query) if query else F.lit(1.0)
    scored = rows.withColumns({"score": own * weight, "ts_": ts, "rupees_": rupees})
    if roles or query:
        kept = rank.relevance_floor(scored, order=(F.desc("ts_"), "id"))
    else:
        kept = scored.crossJoin(F.broadcast(scored.agg(F.count("*").alias("strong_count")))).withColumn("relaxed", F.lit(False))  # one row
    return kept.orderBy(*rank.sort_by(f.sort, ts="ts_", salary=F.col("rupees_"))).drop("ts_", "rupees_", "where_")


def apply_filters(postings: DataFrame, f: Filters, vocabulary: Vocabulary, g: Gazetteer, as_of: Column) -> DataFrame:
    """filtered() over index rows, with the intents that the vocabulary knows for the picked roles and the query."""
    families = {x.id: x for x in vocabulary.families}
    roles = [for_family(families[r], vocabulary) for r in f.roles if r in families]
    query = understand(f.q, vocabulary) if f.q.strip() else None
    return filtered(score.prepare(postings, "browser"), f, roles, query, g, as_of, vocabulary.noise_titles)
