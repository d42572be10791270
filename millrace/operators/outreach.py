"""Whom to write to: how a company builds its addresses, told by those on its own pages, and the names that a posting gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.contact import GENERIC, build_email, contact_name, emails, is_person, own_domain, told_pattern

MOST_CONTACTS = 5
# Where a person looks for people, and for whom.
SEARCH = "https://www.linkedin.com/search/results/people/?keywords="
WANTED = ("recruiter", "talent acquisition", "hiring manager")


def addresses(pages: DataFrame, text_col: str, domain_col: str | None = None) -> DataFrame:
    """(domain, address): distinct addresses in texts; with domain_col only those of that domain, as a page of a company's own site tells them."""
    found = pages.select(*([F.col(domain_col).alias("own_")] if domain_col else []), F.explode(emails(F.col(text_col))).alias("address"))
    found = found.withColumn("domain", F.regexp_replace(F.substring_index("address", "@", -1), r"^www\.", ""))
    return (found.where("domain = own_") if domain_col else found).select("domain", "address").distinct()


def patterns(found: DataFrame) -> DataFrame:
    """(domain, address) rows -> domain, pattern, evidence, named (addresses that name somebody).

    The first address, in alphabetical order, whose shape tells a pattern decides; if none does, single names are the pattern. Addresses that name nobody tell
    nothing, and a domain with no others has no row."""
    named = found.select("domain", F.lower(F.substring_index("address", "@", 1)).alias("local")).where(~F.col("local").isin(*GENERIC)).distinct()
    told = told_pattern(F.col("local"))
    best = named.groupBy("domain").agg(F.min_by(F.when(told.isNotNull(), F.struct(told.alias("pattern"), "local")), F.when(told.isNotNull(), F.col("local"))).alias("told"),
                                       F.min("local").alias("first"), F.count("*").alias("named"))
    single = F.concat(F.lit("found "), "first", F.lit("@"), "domain", F.lit(" (single-name pattern)"))
    return best.select("domain", F.coalesce("told.pattern", F.lit("first")).alias("pattern"),
                       F.coalesce(F.concat(F.lit("found "), F.col("told.local"), F.lit("@"), F.col("domain")), single).alias("evidence"), "named")


def people_search(company: Column, name: Column | None = None) -> Column:
    """A link for a person to open."""
    words = F.concat_ws(" ", name, company) if name is not None else F.concat(company, F.lit(f" ({' OR '.join(WANTED)})"))
    return F.concat(F.lit(SEARCH), F.url_encode(words))


def contacts(postings: DataFrame, known: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """id, domain, nth, name, role, email, basis, link: whom to write to about a posting, at most MOST_CONTACTS a posting, the last always a search without a name.

    postings: id, company, apply_url, url, description. known: patterns(). named: (id, nth, name, role) as a model gives them, of which titles and single words are left
    out; a name that the posting's own text publishes comes before them. An address is built where the company's pattern is known; no names, no addresses. Ids are unique."""
    own = postings.select("id", "company", own_domain(F.col("apply_url"), F.col("url"), F.col("description")).alias("domain"), contact_name(F.col("description")).alias("published"))
    told = own.where("published <> ''").select("id", F.lit(-1).alias("at"), F.col("published").alias("name"), F.lit("named in the posting").alias("role"))
    if named is not None:
        told = told.unionByName(named.where(is_person(F.col("name"))).select("id", F.col("nth").cast("int").alias("at"), F.trim("name").alias("name"), F.substring(F.trim(F.coalesce("role", F.lit(""))), 1, 120).alias("role")))
    few = told.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "name", "role"))), 1, MOST_CONTACTS - 1).alias("few"))  # a model's answer is one row
    search = F.struct(F.lit(None).cast("int").alias("at"), F.lit("").alias("name"), F.lit("Recruiter / hiring manager (search manually)").alias("role"))
    rows = own.join(few, "id", "left").select("id", "company", "domain", F.posexplode(F.concat(F.coalesce("few", F.expr("cast(array() as array<struct<at: int, name: string, role: string>>)")), F.array(search))).alias("nth", "c"))
    rows = rows.join(known.select("domain", "pattern", "evidence"), "domain", "left")
    email = build_email(F.col("c.name"), F.col("domain"), F.col("pattern"))
    link = F.when(F.col("c.name") == "", people_search(F.col("company"))).otherwise(people_search(F.col("company"), F.col("c.name")))
    return rows.select("id", "domain", "nth", F.col("c.name").alias("name"), F.col("c.role").alias("role"), email.alias("email"), F.when(email != "", F.col("evidence")).otherwise("").alias("basis"), link.alias("link"))
