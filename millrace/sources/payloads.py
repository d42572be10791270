"""Landed payloads to postings. A feed is a schema, the rows in its payload, and one expression per column.

Landing table: (source, token, company, payload string). Fetching is outside this library: a payload that does not
parse gives no rows, so one dead board never fails a run, and fan_out_health() reports it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import html_to_text
from millrace.functions.salary import parse_salary
from millrace.functions.text import absolute_time, detect_remote, truncate

PAY = ["salary_min", "salary_max", "salary_currency", "salary_period", "salary_text"]


@dataclass(frozen=True)
class Feed:
    """ddl of the payload, SQL of the array of rows in it, and SQL per posting column over one row j (and token, company).

    markup holds the SQL of the description's HTML; plain, that of ready text which is preferred; remote, SQL of texts that tell
    the work mode besides the location; pay, SQL of a label that is preferred over the description, or of a struct of numbers."""

    ddl: str
    rows: str
    columns: dict[str, str]
    markup: str = "''"
    plain: str = "''"
    posted: str = "cast(null as string)"
    remote: tuple[str, ...] = ()
    pay: str = "''"
    pay_from_text: bool = True
    tags: str = "array()"
    keep: str = "true"
    numbers: dict[str, str] = field(default_factory=dict)


def _joined(*parts: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


def _remote_if(flag: str) -> str:
    return f"case when {flag} then 'remote' else '' end"


# The providers' field names.
FEEDS = {
    "ats:greenhouse": Feed("jobs array<struct<title string, location struct<name string>, absolute_url string, content string, first_published string, updated_at string>>", "p.jobs",
                           {"title": "j.title", "location": "j.location.name", "url": "j.absolute_url"}, "j.content", posted="coalesce(j.first_published, j.updated_at)", remote=("j.title", "text")),
    "ats:lever": Feed("array<struct<text string, categories struct<location string, commitment string, salaryRange string>, hostedUrl string, applyUrl string, descriptionPlain string, "
                      "description string, lists array<struct<text string, content string>>, createdAt string>>", "p",
                      {"title": "j.text", "location": "j.categories.location", "url": "j.hostedUrl", "apply_url": "j.applyUrl"},
                      "concat(coalesce(nullif(replace(j.descriptionPlain, '\\n', '<br>'), ''), j.description, ''), coalesce(aggregate(j.lists, '', (a, s) -> concat(a, '<p>', coalesce(s.text, ''), '<br>', coalesce(s.content, ''))), ''))",
                      posted="j.createdAt", remote=("j.categories.commitment", "text"), pay="j.categories.salaryRange"),
    "ats:ashby": Feed("jobs array<struct<title string, location string, jobUrl string, applyUrl string, descriptionHtml string, descriptionPlain string, publishedAt string, isRemote boolean, "
                      "employmentType string, compensation struct<compensationTierSummary string>>>", "p.jobs",
                      {"title": "j.title", "location": "j.location", "url": "j.jobUrl", "apply_url": "j.applyUrl"}, "coalesce(nullif(j.descriptionHtml, ''), j.descriptionPlain)", posted="j.publishedAt",
                      remote=(_remote_if("j.isRemote"), "j.employmentType"), pay="j.compensation.compensationTierSummary"),
    "ats:workable": Feed("jobs array<struct<title string, location struct<city string, region string, country string, telecommuting boolean>, url string, application_url string, description string, "
                         "requirements string, published_on string, created_at string>>", "p.jobs",
                         {"title": "j.title", "location": _joined("j.location.city", "j.location.region", "j.location.country"), "country": "j.location.country", "url": "coalesce(nullif(j.url, ''), j.application_url)"},
                         "concat_ws(' ', j.description, j.requirements)", posted="coalesce(nullif(j.published_on, ''), j.created_at)", remote=(_remote_if("j.location.telecommuting"), "text")),
    "ats:smartrecruiters": Feed("content array<struct<id string, name string, location struct<city string, country string, remote boolean>, releasedDate string>>", "p.content",
                                {"title": "j.name", "location": _joined("j.location.city", "j.location.country"), "country": "j.location.country",
                                 "url": "concat('https://jobs.smartrecruiters.com/', token, '/', coalesce(j.id, ''))"}, posted="j.releasedDate", remote=(_remote_if("j.location.remote"),)),
    "ats:recruitee": Feed("offers array<struct<title string, location string, city string, country_code string, careers_url string, url string, description string, requirements string, "
                          "published_at string, remote boolean>>", "p.offers",
                          {"title": "j.title", "location": f"coalesce(nullif(j.location, ''), {_joined('j.city', 'j.country_code')})", "url": "coalesce(nullif(j.careers_url, ''), j.url)"},
                          "concat_ws(' ', j.description, j.requirements)", posted="j.published_at", remote=(_remote_if("j.remote"), "text")),
    "adzuna": Feed("results array<struct<title string, description string, company struct<display_name string>, location struct<display_name string>, redirect_url string, created string, "
                   "salary_min double, salary_max double>>", "p.results",
                   {"title": "j.title", "company": "coalesce(nullif(j.company.display_name, ''), 'Unknown')", "location": "j.location.display_name", "url": "j.redirect_url"}, "j.description", posted="j.created",
                   remote=("j.title", "text"), pay_from_text=False, numbers={"salary_min": "j.salary_min", "salary_max": "j.salary_max", "salary_currency": "'INR'"}),
    "remoteok": Feed("array<struct<position string, company string, location string, url string, apply_url string, description string, epoch string, date string, tags array<string>, "
                     "salary_min double, salary_max double>>", "slice(p, 2, greatest(size(p) - 1, 0))",
                     {"title": "j.position", "company": "coalesce(j.company, 'Unknown')", "location": "coalesce(nullif(j.location, ''), 'Remote')", "url": "coalesce(nullif(j.url, ''), j.apply_url)"}, "j.description",
                     posted="coalesce(nullif(j.epoch, ''), j.date)", remote=("'remote'",), pay_from_text=False, tags="slice(j.tags, 1, 12)", keep="j.position <> ''",
                     numbers={"salary_min": "nullif(j.salary_min, 0)", "salary_max": "coalesce(nullif(j.salary_max, 0), j.salary_min)", "salary_currency": "'USD'"}),
    "remotive": Feed("jobs array<struct<title string, company_name string, candidate_required_location string, url string, description string, publication_date string, tags array<string>, salary string>>", "p.jobs",
                     {"title": "j.title", "company": "coalesce(j.company_name, 'Unknown')", "location": "coalesce(nullif(j.candidate_required_location, ''), 'Remote')", "url": "j.url"}, "j.description",
                     posted="j.publication_date", remote=("'remote'",), pay="j.salary", pay_from_text=False, tags="slice(j.tags, 1, 12)"),
    "arbeitnow": Feed("data array<struct<title string, company_name string, location string, url string, description string, created_at string, remote boolean, tags array<string>>>", "p.data",
                      {"title": "j.title", "company": "coalesce(j.company_name, 'Unknown')", "location": "j.location", "url": "j.url"}, "j.description", posted="j.created_at",
                      remote=(_remote_if("j.remote"),), tags="slice(j.tags, 1, 12)"),
    "himalayas": Feed("jobs array<struct<title string, companyName string, locationRestrictions array<string>, applicationLink string, guid string, description string, pubDate string, "
                      "minSalary double, maxSalary double, currency string>>", "p.jobs",
                      {"title": "j.title", "company": "coalesce(j.companyName, 'Unknown')", "location": "coalesce(nullif(array_join(j.locationRestrictions, ', '), ''), 'Remote')",
                       "url": "coalesce(nullif(j.applicationLink, ''), j.guid)"}, "j.description", posted="j.pubDate", remote=("'remote'",), pay_from_text=False,
                      numbers={"salary_min": "nullif(j.minSalary, 0)", "salary_max": "coalesce(nullif(j.maxSalary, 0), j.minSalary)", "salary_currency": "coalesce(nullif(j.currency, ''), 'USD')"}),
    "weworkremotely": Feed("item array<struct<title string, link string, description string, region string, pubDate string>>", "p.item",
                           {"title": "trim(case when locate(':', j.title) > 0 then substring(j.title, locate(':', j.title) + 1) else j.title end)",
                            "company": "case when locate(':', j.title) > 1 then trim(substring_index(j.title, ':', 1)) else 'Unknown' end", "location": "coalesce(nullif(trim(j.region), ''), 'Remote')", "url": "trim(j.link)"},
                           "j.description", posted="j.pubDate", remote=("'remote'",), keep="coalesce(trim(j.title), '') <> '' and coalesce(trim(j.link), '') <> ''"),
}


def landed(spark, folder: str, source: str, boards: dict[str, str]) -> DataFrame:
    """The landing table of files folder/<token>.<any ending>, wherever Spark can read: one row per board of boards (token -> company).

    A board without a file has a null payload, which counts as blocked."""
    found = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("token"), F.make_valid_utf8(F.col("content").cast("string")).alias("payload"))
    asked = spark.createDataFrame(list(boards.items()), "token string, company string")
    return asked.join(found, "token", "left").select(F.lit(source).alias("source"), "token", "company", "payload")


def postings_of(landed: DataFrame, source: str, tier: str = "tier1") -> DataFrame:
    """The postings in one source's landed JSON payloads (for weworkremotely: {"item": [...]} as rss_items() lands it)."""
    feed = FEEDS[source]
    own = landed.where(F.col("source") == source).withColumn("p", F.from_json("payload", feed.ddl, {"mode": "PERMISSIVE"}))
    rows = own.select("token", "company", F.explode(F.expr(feed.rows)).alias("j")).where(f"j is not null and ({feed.keep})")
    rows = rows.withColumn("text", html_to_text(F.expr(f"coalesce({feed.markup}, '')")))
    empty = lambda e: F.coalesce(F.expr(e), F.lit(""))
    head = {"text": F.substring("text", 1, 1500)}
    mode = detect_remote(empty(feed.columns["location"]), *[head.get(r, empty(r)) for r in feed.remote])
    label = F.coalesce(F.nullif(empty(feed.pay), F.lit("")), F.col("text") if feed.pay_from_text else F.lit(""))
    rows = rows.withColumn("pay", parse_salary(label))
    pay = {c: F.col(f"pay.{c}") for c in PAY} | {c: F.expr(e) for c, e in feed.numbers.items()}
    if feed.numbers:
        pay["salary_period"] = F.when(pay["salary_min"].isNotNull(), "year")
        pay["salary_currency"] = F.when(pay["salary_min"].isNotNull(), pay["salary_currency"])
    columns = {"title": "''", "company": "company", "location": "''", "country": "''", "url": "''", "apply_url": "''"} | feed.columns
    return rows.select(
        *[empty(e).alias(c) for c, e in columns.items()], truncate(F.col("text")).alias("description"), absolute_time(F.expr(feed.posted)).alias("posted_at"), mode.alias("remote"),
        *[v.alias(c) for c, v in pay.items()], F.coalesce(F.expr(feed.tags).cast("array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.lit(source).alias("source"), F.lit(tier).alias("source_tier"))


def rss_items(spark, path: str) -> DataFrame:
    """Items of RSS files, one row each."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, region string, pubDate string").load(path)


def fan_out_health(landed: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: boards landed, boards blocked, postings, and whether all were blocked with nothing found."""
    boards = landed.groupBy("source").agg(F.count("*").alias("boards"), F.count_if(F.col("payload").isNull()).alias("blocked"))
    counts = found.groupBy("source").agg(F.count("*").alias("jobs_found"))
    out = boards.join(counts, "source", "left").withColumn("jobs_found", F.coalesce("jobs_found", F.lit(0)))
    return out.withColumn("ok", ~((F.col("blocked") == F.col("boards")) & (F.col("jobs_found") == 0)))


def request_plan(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """What to fetch: whole feeds once per run, others once per query, keyword and page. Both sides are configuration."""
    whole = sources.where("query_independent").select("source", F.lit(None).cast("string").alias("keyword"), F.lit(1).alias("page"))
    each = sources.where("not query_independent").crossJoin(F.broadcast(queries.select(F.explode("keywords").alias("keyword")).distinct()))
    return whole.unionByName(each.select("source", "keyword", F.explode(F.sequence(F.lit(1), "pages")).alias("page")))


def cached_listings(pages: DataFrame, listing: str, company: str, order: str | None = None) -> DataFrame:
    """Listings of a page's object cache joined to the companies that they refer to; those without one go.

    pages: (payload) with a JSON map of objects by "Kind:id"; the last object of a reference wins: the one of the page that is
    last by the column order (of several such pages, or without it, the greatest text)."""
    place = F.col(order) if order else F.lit(0)
    objects = pages.select(place.alias("page"), F.explode(F.from_json("payload", "map<string, string>")).alias("ref", "body"))
    side = lambda kind: objects.where(F.col("ref").startswith(kind + ":")).groupBy(F.substring_index("ref", ":", -1).alias("id")).agg(
        F.max_by("body", F.struct("page", "body")).alias("body"))
    companies = side(company).withColumnRenamed("body", "owner")
    owner = F.substring_index(F.get_json_object("body", "$.startup.__ref"), ":", -1)
    return side(listing).withColumn("owner_id", owner).join(companies.withColumnRenamed("id", "owner_id"), "owner_id").select("id", "body", "owner_id", "owner")


def streamed_chunks(pages: DataFrame, key: str, pattern: str, array_name: str, ddl: str) -> DataFrame:
    """The rows of a JSON array that a page sends as string chunks: chunks are joined in order, the array is cut out and parsed."""
    from millrace.sources.embedded import array_objects, streamed_text

    return pages.select(key, F.explode(array_objects(streamed_text(F.col("payload"), pattern), array_name, ddl)).alias("j")).select(key, "j.*")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(value) sitemap texts -> url, lastmod."""
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("e")
    return files.select(entry).select(F.regexp_extract("e", r"<loc>\s*(.*?)\s*</loc>", 1).alias("url"), F.try_to_timestamp(F.regexp_extract("e", r"<lastmod>\s*(.*?)\s*</lastmod>", 1)).alias("lastmod"))


def parse_posting(text: Column) -> Column:
    """See comments.parse_posting."""
    from millrace.sources import comments

    return comments.parse_posting(text)
