"""Addresses, names and domains in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"(\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b)"
# Addresses that name nobody, the ways addresses are built from names (those told from an address, in their order, first), and parts of hosts that list other companies' postings.
GENERIC = ("info", "contact", "hello", "support", "sales", "admin", "help", "team", "press", "media", "legal", "privacy", "security", "billing", "noreply", "no-reply", "donotreply",
           "webmaster", "postmaster", "abuse", "marketing")
TOLD = (("first.last", r"^[a-z]+\.[a-z]+$"), ("f.last", r"^[a-z]\.[a-z]+$"), ("first_last", r"^[a-z]+_[a-z]+$"))
PATTERNS = ("first.last", "firstlast", "first", "f.last", "flast", "first_last", "last.first", "first.l")
SHARED_HOSTS = ("greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com", "recruitee.com", "linkedin.com", "adzuna", "remoteok", "remotive", "weworkremotely", "himalayas",
                "arbeitnow", "ycombinator.com", "indeed.", "naukri.com")
# Phrases around a name, and words that show a title instead of one.
NAMED = (r"(?:contact|reach out to|email|write to|questions to)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)",
         r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s*(?:,|\s-\s)?\s*(?i:(?:our|the)?\s*(?:recruiter|talent|hiring manager))")
NO_NAME = r"(?i)\b(hiring|talent|team|manager|resources)\b"
NO_PERSON = r"(?i)\b(manager|recruiter|team|department|hr)\b"


def emails(text: Column) -> Column:
    """Distinct addresses, lower case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 1), F.lower))


def personal(addresses: Column, generic=GENERIC) -> Column:
    return F.filter(addresses, lambda a: ~F.substring_index(a, "@", 1).isin(*generic))


def told_pattern(local: Column) -> Column:
    """The pattern that the shape of an address's local part tells, or null: one letter before a point is a first name too."""
    return F.coalesce(*[F.when(local.rlike(shape), F.lit(name)) for name, shape in TOLD], F.lit(None).cast("string"))


def address_pattern(local: Column) -> Column:
    """told_pattern(), and for any other name the first name alone; empty for an empty one."""
    return F.when(F.coalesce(local, F.lit("")) == "", "").otherwise(F.coalesce(told_pattern(local), F.lit("first")))


def build_email(name: Column, domain: Column, pattern: Column) -> Column:
    """The address of a full name by a pattern; empty where the name has no two words, or domain or pattern is missing or unknown."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z\s]", "")), r"\s+"), lambda w: w != "")
    first, last = F.get(words, 0), F.element_at(words, -1)
    f, n = F.substring(first, 1, 1), F.substring(last, 1, 1)
    built = {"first.last": (first, ".", last), "firstlast": (first, last), "first": (first,), "f.last": (f, ".", last), "flast": (f, last), "first_last": (first, "_", last), "last.first": (last, ".", first), "first.l": (first, ".", n)}
    local = reduce(lambda out, p: F.when(pattern == p, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in built[p]])).otherwise(out), PATTERNS, F.lit(None).cast("string"))
    fits = (F.size(words) >= 2) & (F.coalesce(domain, F.lit("")) != "") & local.isNotNull()
    return F.when(fits, F.concat(local, F.lit("@"), domain)).otherwise("")


def domain_of(url: Column, shared: tuple[str, ...] = SHARED_HOSTS) -> Column:
    """Host (and port) without www, empty where a part of it is one of the sites that list many companies."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), r"^www\.", "")
    listed = reduce(lambda out, s: out | host.contains(s), shared, F.lit(False))
    return F.when(F.coalesce(listed, F.lit(True)), "").otherwise(host)


def own_domain(apply_url: Column, url: Column, description: Column, shared: tuple[str, ...] = SHARED_HOSTS) -> Column:
    """A company's domain: of the first of its two links, then of the addresses in its text, that lies on no shared site; else empty."""
    told = F.transform(F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"(https?://[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"), 1), lambda u: domain_of(u, shared))
    links = [F.nullif(domain_of(F.coalesce(u, F.lit("")), shared), F.lit("")) for u in (apply_url, url)]
    return F.coalesce(*links, F.get(F.filter(told, lambda h: h != ""), 0), F.lit(""))


def contact_name(text: Column, titles: str = NO_NAME) -> Column:
    """A first and last name after "contact", "write to" and the like, or before "our recruiter" and the like; empty if it is a title."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), p, 1) for p in NAMED]
    return F.coalesce(*[F.when((n != "") & ~n.rlike(titles), n) for n in found], F.lit(""))


def is_person(name: Column) -> Column:
    """Whether a name that a model gives may be one: two words at least, and none of a title or a department."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.size(F.split(n, r"\s+")) >= 2) & ~n.rlike(NO_PERSON)
