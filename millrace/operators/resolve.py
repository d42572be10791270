"""Entity resolution: which postings are one role, and the merge of what their sources know."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import normalise_company, normalise_title
from millrace.operators import similar
from millrace.operators.similar import ALIKE, common_length
from millrace.schema import content_id
from millrace.scratch import written

# Sources in order of preference; others come last.
SOURCE_RANK = ["ats:greenhouse", "ats:lever", "ats:ashby", "ats:workable", "ats:smartrecruiters", "ats:recruitee", "adzuna", "linkedin", "remoteok",
               "remotive", "himalayas", "weworkremotely", "arbeitnow", "hn_hiring"]
MOST_TAGS = 16


def source_rank(source: Column, ranking: list[str] = SOURCE_RANK) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in ranking]), source), F.lit(0)) - 1, F.lit(len(ranking))).cast("int")


def prefix_of(tag: Column) -> Column:
    """What a "Prefix: value" tag states a fact about; null for other tags and cross-post marks."""
    return F.when(tag.contains(":") & ~tag.startswith("also:"), F.lower(F.trim(F.substring_index(tag, ":", 1))))


def _same(key: list[str]) -> Column:
    return reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"{c}_k")), key[1:], F.col(key[0]).eqNullSafe(F.col(f"{key[0]}_k")))


def folded_tags(rows: DataFrame, key: list[str], pos: list[str]) -> DataFrame:
    """(the key's columns with _k behind their names, tags_): tags after folding each record of a key, in the order of pos, into those before.

    A fold adds what is new, the first of each prefix only, cuts at MOST_TAGS, then marks the other's source. The first record's own
    tags are folded alike; a key with one record keeps them as they are. Nothing is added to a full list but the mark of the last record, so the first
    few distinct tags and sources of a key and its last record decide: no more of a key than these is collected."""
    most = MOST_TAGS + 1
    order = F.struct(*pos)
    named = [F.col(c).alias(f"{c}_k") for c in key]
    keys = [f"{c}_k" for c in key]
    base = rows.select(*named, order.alias("at"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "source")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "i"))
    tags = base.select(*keys, "at", F.posexplode("tags").alias("i", "value"))
    unit = F.coalesce(F.concat(F.lit("p"), prefix_of(F.col("value"))), F.concat(F.lit("t"), "value"))
    first = F.min_by(F.struct("at", "i", "value"), F.struct("at", "i")).alias("e")
    tags = tags.where("value is not null").groupBy(*keys, unit.alias("unit")).agg(first).select(*keys, "e.*", F.lit(True).alias("tag"))
    last_place = F.lit(2**31 - 1)
    sources = base.groupBy(*keys, F.coalesce("source", F.lit("")).alias("value")).agg(F.min("at").alias("at")).select(*keys, "at", last_place.alias("i"), "value", F.lit(False).alias("tag"))
    few = reduce(DataFrame.unionByName, [d.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth") for d in (tags, sources)])
    few = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "i", "value", "tag"))).alias("few"))
    ends = base.groupBy(*keys).agg(F.count("*").alias("records"), F.min_by(F.struct("tags", F.coalesce("source", F.lit("")).alias("source")), "at").alias("primary"),
                                   F.max(F.struct("at", last_place.alias("i"), F.coalesce("source", F.lit("")).alias("value"), F.lit(False).alias("tag"))).alias("last"))
    mine = few.select(*[F.col(c).alias(f"{c}_f") for c in keys], "few")
    both = ends.join(mine, reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"{c}_f")), keys[1:], F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}_f"))), "left")

    def fold(acc: Column, e: Column) -> Column:
        mark = F.concat(F.lit("also:"), e["value"])
        cut = F.slice(acc, 1, MOST_TAGS)
        added = F.when(F.array_contains(acc, e["value"]), acc).otherwise(F.concat(acc, F.array(e["value"])))
        marked = F.when((e["value"] == F.col("primary.source")) | F.array_contains(cut, mark), cut).otherwise(F.concat(cut, F.array(mark)))
        return F.when(e["tag"], added).otherwise(marked)

    entries = F.concat(F.coalesce("few", F.expr("slice(array(last), 1, 0)")), F.array("last"))
    tags_ = F.when(F.col("records") == 1, F.col("primary.tags")).otherwise(F.aggregate(entries, F.array().cast("array<string>"), fold))
    return both.select(*keys, tags_.alias("tags_"))


SALARY = ["salary_min", "salary_max", "salary_currency", "salary_period", "salary_text"]


def merge(rows: DataFrame, key: list[str], pos: list[str]) -> DataFrame:
    """One row per key. Rows are taken in the order of the columns pos (which must be unique within a key): the first is the primary.

    Longest description (first on ties), salary as a unit from the first row that has one, earliest posted_at and first_seen_at,
    latest last_seen_at, first known remote, location and apply_url, folded tags; everything else is the primary's."""
    order = F.struct(*pos)
    own = lambda c: F.min_by(c, order)
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, order))
    paid = F.coalesce("salary_min", F.lit(0.0)) != 0
    salary = F.struct(*SALARY)
    merged = {c: own(c) for c in rows.columns if c not in key}
    merged |= {
        "description": F.max_by("description", F.struct(F.length("description").alias("l"), *[(-F.col(p)).alias(p) for p in pos])),
        "posted_at": F.min("posted_at"), "first_seen_at": F.min("first_seen_at"), "last_seen_at": F.max("last_seen_at"),
        "remote": F.coalesce(first("remote", F.col("remote") != "unknown"), F.lit("unknown")),
        "location": F.coalesce(first("location", F.col("location") != ""), F.lit("")),
        "apply_url": F.coalesce(first("apply_url", F.col("apply_url") != ""), F.lit("")),
    }
    for c in SALARY:
        merged.pop(c)
    pay = F.coalesce(F.min_by(F.when(paid, salary), F.when(paid, order)), F.min_by(salary, order))
    out = rows.groupBy(*key).agg(pay.alias("pay_"), *[v.alias(c) for c, v in merged.items() if c != "tags"])
    out = out.join(folded_tags(rows, key, pos), _same(key))
    return out.select(*key, *[F.col(c) for c in merged if c != "tags"], *[F.col(f"pay_.{c}").alias(c) for c in SALARY], F.col("tags_").alias("tags")).select(*rows.columns)


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * (longest common subsequence) / (lengths), of the words in sorted order."""
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    return 200.0 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0


def resolve(postings: DataFrame, ranking: list[str] = SOURCE_RANK, least: float = ALIKE, ord_col: str = "ord", include_location: bool = False) -> DataFrame:
    """One row per real-world role. ord_col is a unique order of arrival.

    Pass 1 merges equal (company, title) keys with built-in aggregates and is written once, as a similarity join and its rounds read it. Pass 2 lets the first
    alike title of the same company absorb a later one. A null company or title counts as empty."""
    extra = ["location"] if include_location else []
    empty = lambda c: F.coalesce(c, F.lit(""))
    keyed = postings.withColumns({
        "company_k": empty(normalise_company(F.col("company"))), "title_k": empty(normalise_title(F.col("title"))), "rank_": source_rank(F.col("source"), ranking),
        "len_": -F.length("description"), "ord_": F.col(ord_col)})
    once = written(merge(keyed.drop(ord_col), ["company_k", "title_k", *extra], ["rank_", "len_", "ord_"]), "resolved")
    place = F.format_string("%06d|%012d|%020d", F.col("rank_"), F.lit(10**11) + F.col("len_"), F.col("ord_"))
    titles = once.groupBy("company_k", "title_k").agg(F.min(place).alias("k_"))
    led = once.join(similar.grouped(titles, "company_k", "title_k", "k_", least).select("company_k", "title_k", F.col("leader").alias("leader_k")), ["company_k", "title_k"])
    twice = merge(led, ["company_k", "leader_k", *extra], ["rank_", "len_", "ord_"])
    out = twice.withColumn("id", content_id(F.col("company"), F.col("title"), F.col("location")))
    return out.select(*[c if c != ord_col else F.col("ord_").alias(ord_col) for c in postings.columns])
