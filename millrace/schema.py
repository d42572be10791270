"""The posting record, its enums, and the coercion of untrusted rows to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REMOTE = ("onsite", "hybrid", "remote", "unknown")
SENIORITY = ("intern", "entry", "mid", "senior", "lead", "exec", "unknown")
TIERS = ("tier1", "tier2")

POSTING = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "title", "company", "location", "country", "remote", "description", "url", "apply_url")],
    T.StructField("salary_min", T.DoubleType()), T.StructField("salary_max", T.DoubleType()),
    *[T.StructField(c, T.StringType()) for c in ("salary_currency", "salary_period", "salary_text", "source", "source_tier")],
    *[T.StructField(c, T.TimestampType()) for c in ("posted_at", "first_seen_at", "last_seen_at")],
    T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    *[T.StructField(c, T.StringType()) for c in ("seniority", "summary")], T.StructField("enriched", T.BooleanType())])

#: What a posting carries in the light index; the rest stays with its details.
INDEX = ["id", "title", "company", "location", "remote", "url", "salary_min", "salary_max", "salary_currency", "salary_text", "source",
         "source_tier", "posted_at", "first_seen_at", "skills", "seniority", "summary", "tags"]


def clean(text: Column) -> Column:
    """Null to empty, any Unicode white space to one space, no ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def content_id(company: Column, title: Column, location: Column) -> Column:
    """16 hex digits that name a role: company, title and the first part of the location."""
    identity = F.concat_ws("|", squash(company), squash(title), squash(F.substring_index(F.coalesce(location, F.lit("")), ",", 1)))
    return F.substring(F.sha2(identity, 256), 1, 16)


def one_of(value: Column, allowed: tuple[str, ...], other: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))


def conform(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows (any subset of POSTING's columns) with all of them, typed and defaulted; a naive time counts as UTC."""
    have = {c.lower(): c for c in rows.columns}
    col = lambda c, kind: F.col(have[c]).cast(kind) if c in have else F.lit(None).cast(kind)
    out = {f.name: col(f.name, f.dataType) for f in POSTING}
    for c in ("title", "company", "location"):
        out[c] = clean(out[c])
    for c in ("country", "description", "url", "apply_url", "salary_currency", "salary_period", "salary_text", "source", "summary"):
        out[c] = F.coalesce(out[c], F.lit(""))
    for c, allowed, other in (("remote", REMOTE, "unknown"), ("seniority", SENIORITY, "unknown"), ("source_tier", TIERS, "tier1")):
        out[c] = one_of(out[c], allowed, other)
    for c in ("skills", "tags"):
        out[c] = F.coalesce(out[c], F.array().cast("array<string>"))
    out["first_seen_at"], out["last_seen_at"] = (F.coalesce(out[c], as_of) for c in ("first_seen_at", "last_seen_at"))
    out["enriched"] = F.coalesce(out["enriched"], F.lit(False))
    made = content_id(out["company"], out["title"], out["location"])
    out["id"] = F.coalesce(F.nullif(out["id"], F.lit("")), made)
    return rows.select(*[v.alias(c) for c, v in out.items()])


# The most characters of a stored text, and the most entries of a stored list, that are taken.
MOST_CHARS = {"id": 64, "title": 300, "company": 200, "location": 200, "url": 2000, "source": 40, "remote": 20, "tier": 20, "seniority": 20, "salary_currency": 8, "salary_text": 160, "summary": 2000}
MOST_ENTRIES, ENTRY_CHARS = 30, 120


def coerce_stored(rows: DataFrame) -> DataFrame:
    """Stored rows of any quality as index entries that can be shown; `dropped` marks those without a title or a link that may be opened.

    Columns may be missing or of other types; texts are cut and trimmed, links are http(s) only, amounts are finite and above 0, unknown kinds and unreadable times take
    their defaults: company Unknown, source unknown, tier tier1, first_seen_at the epoch, id the link."""
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        if c not in kinds or kinds[c].startswith(("array", "map", "struct", "binary")):
            return F.lit("")
        return F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, MOST_CHARS[c])

    trimmed = lambda c: F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")
    said = lambda c, other: F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit(other))

    def entries(c: str) -> Column:
        if not kinds.get(c, "").startswith("array"):
            return F.array().cast("array<string>")
        cut = F.transform(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), lambda v: F.substring(v, 1, ENTRY_CHARS))
        return F.slice(F.filter(cut, lambda v: F.coalesce(v, F.lit("")) != ""), 1, MOST_ENTRIES)

    def amount(c: str) -> Column:
        n = F.col(c).cast("string").try_cast("double") if c in kinds and kinds[c] != "boolean" else F.lit(None).cast("double")
        return F.when((n > 0) & (n < float("inf")), n)

    def time(c: str) -> Column:
        return F.try_to_timestamp(F.nullif(F.substring(F.col(c).cast("string"), 1, 40), F.lit(""))) if c in kinds else F.lit(None).cast("timestamp")

    url = F.when(trimmed("url").rlike("(?i)^https?://"), trimmed("url")).otherwise("")
    out = {
        "title": trimmed("title"), "company": said("company", "Unknown"), "location": trimmed("location"), "remote": one_of(text("remote"), REMOTE, "unknown"), "url": url,
        "source": F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("unknown")), "tier": one_of(text("tier"), TIERS, "tier1"), "posted_at": time("posted_at"),
        "first_seen_at": F.coalesce(time("first_seen_at"), F.timestamp_seconds(F.lit(0))), "salary_min": amount("salary_min"), "salary_max": amount("salary_max"),
        "salary_currency": text("salary_currency"), "salary_text": text("salary_text"), "skills": entries("skills"), "seniority": one_of(text("seniority"), SENIORITY, "unknown"),
        "summary": text("summary"), "tags": entries("tags")}
    made = rows.select(F.coalesce(F.nullif(text("id"), F.lit("")), url).alias("id"), *[v.alias(c) for c, v in out.items()])
    return made.withColumn("dropped", (F.col("title") == "") | (F.col("url") == ""))


def usable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """coerce_stored() rows without the dropped ones, and one row of how many these are."""
    made = coerce_stored(rows)
    return made.where("not dropped").drop("dropped"), made.agg(F.count_if("dropped").alias("dropped"))
