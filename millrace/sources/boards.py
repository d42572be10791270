"""Postings from the pages of boards: server-rendered cards, streamed state, object caches. pages: (url, html), with columns of their own kept out.

Every board gives the same columns. A row without a title or a link is no posting; what a board does not say is empty, null or unknown."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import html_to_text
from millrace.functions.salary import parse_salary
from millrace.functions.text import band_seniority, clean_url, detect_remote, join_locations, relative_time, slugify, truncate
from millrace.sources.cards import Field, Record, elements
from millrace.sources.embedded import array_objects, streamed_text
from millrace.sources.payloads import PAY

MOST_SKILLS = 12


def none() -> Column:
    return F.lit("")


def told(c: str | Column) -> Column:
    return F.coalesce(c, none())


def pay_of(label: Column) -> Column:
    """parse_salary of a label with the label itself as its text; "not disclosed" is no pay."""
    pay = parse_salary(label)
    kept = F.when(label.isNotNull() & ~F.lower(label).contains("disclosed"), pay)
    return F.transform(F.array(kept), lambda k: F.when(k.isNotNull(), k.withField("salary_text", F.substring(F.trim(label), 1, 120))))[0]


def posting(rows: DataFrame, source: str, *, title: Column, company: Column, location: Column, url: Column, description: Column | None = None, posted_at: Column | None = None,
            remote: Column | None = None, seniority: Column | None = None, pay: Column | None = None, skills: Column | None = None, tags: tuple[Column, ...] = (), tier: str = "tier2") -> DataFrame:
    """The columns of a board's postings; tags that are null are left out."""
    words = F.array().cast("array<string>")
    amounts = {"salary_min": "double", "salary_max": "double"}
    named = rows.select(
        title.alias("title"), company.alias("company"), told(location).alias("location"), url.alias("url"), (told(description) if description is not None else none()).alias("description"),
        (posted_at if posted_at is not None else F.lit(None).cast("timestamp")).alias("posted_at"), (remote if remote is not None else detect_remote(told(location), title)).alias("remote"),
        (seniority if seniority is not None else F.lit("unknown")).alias("seniority"), (pay if pay is not None else F.lit(None).cast("struct<salary_min double, salary_max double, salary_currency string, salary_period string, salary_text string>")).alias("pay"),
        (F.slice(F.coalesce(skills, words), 1, MOST_SKILLS) if skills is not None else words).alias("skills"), (F.array_compact(F.array(*tags)) if tags else words).alias("tags"))
    read = [F.col(f"pay.{c}").alias(c) if c in amounts else told(f"pay.{c}").alias(c) for c in PAY]
    out = named.select(*[c for c in named.columns if c != "pay"], *read, F.lit(source).alias("source"), F.lit(tier).alias("source_tier"))
    return out.where("coalesce(title, '') <> '' and coalesce(url, '') <> ''")


def _in_country(location: Column, country: str = "India") -> Column:
    """A location, with the country unless it names it."""
    return F.when(F.lower(location).contains(country.lower()), location).otherwise(F.concat_ws(", ", F.nullif(location, none()), F.lit(country)))


def _tag(prefix: str, value: Column) -> Column:
    return F.when(F.coalesce(value, none()) != "", F.concat(F.lit(prefix), value))


def local_time(stamp: Column, offset: str) -> Column:
    """An ISO time; one that names no zone is of that offset."""
    whole = F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(stamp, F.lit("T00:00:00"))).otherwise(stamp)
    return F.try_to_timestamp(F.when(whole.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), whole).otherwise(F.concat(whole, F.lit(offset))))


# Fixed values of the boards follow: selectors, field names, addresses.
GUEST_CARD = Record("li", {"title": Field("h3"), "company": Field("h4 a, .base-search-card__subtitle"), "link": Field("a.base-card__full-link, a[href*='/jobs/view/']", "href"),
                           "location": Field(".job-search-card__location"), "stamp": Field("time", "datetime"), "age": Field("time")})


def linkedin(pages: DataFrame, as_of: Column) -> DataFrame:
    """Guest search pages: cards with a title, a link (kept without its query), a place, a date or an age."""
    rows = elements(pages, "html", GUEST_CARD, ["url"]).withColumnRenamed("url", "page_url")
    posted = F.coalesce(local_time(F.col("stamp"), "Z"), relative_time(F.col("age"), as_of))
    return posting(rows, "linkedin", title=F.col("title"), company=F.coalesce("company", F.lit("Unknown")), location=F.col("location"), url=clean_url(F.col("link")), posted_at=posted, tier="tier1")


SHINE = "https://www.shine.com"
SHINE_ROW = "title string, companyName string, detailUrl string, experienceLabel string, locations array<string>, postedAt string, salaryLabel string, skills array<string>"


def shine(pages: DataFrame) -> DataFrame:
    """Search pages whose state is streamed in chunks: the objects of its jobs array. Times without a zone are Indian ones."""
    rows = pages.select(F.explode(array_objects(streamed_text(F.col("html")), "jobs", SHINE_ROW)).alias("j")).select("j.*")
    rows = rows.where("coalesce(title, '') <> '' and coalesce(companyName, '') <> '' and coalesce(detailUrl, '') <> ''")
    places = F.filter(F.transform(F.coalesce("locations", F.array().cast("array<string>")), lambda p: F.trim(told(p))), lambda p: p != "")
    rows = rows.withColumn("place", join_locations(places))
    return posting(rows, "shine", title=F.col("title"), company=F.col("companyName"), location=_in_country(F.col("place")), url=F.concat(F.lit(SHINE), "detailUrl"), posted_at=local_time(F.col("postedAt"), "+05:30"),
                   remote=detect_remote(F.col("place"), F.col("title")), seniority=band_seniority(F.col("experienceLabel")), pay=pay_of(F.col("salaryLabel")),
                   skills=F.filter("skills", lambda s: s.isNotNull()), tags=(_tag("Experience: ", F.col("experienceLabel")),))


INTERNSHALA = "https://internshala.com"
INTERNSHALA_CARD = Record("div.individual_internship", {
    "title": Field("a.job-title-href"), "link": Field("a.job-title-href", "href"), "company": Field(".company-name"), "places": Field(".locations a", every=True), "labels": Field(".color-labels span", every=True),
    "about": Field(".about_job .text"), "skills": Field(".job_skill", every=True),
    "items": Record(".row-1-item", {"icon": Field("i", "class"), "mobile": Field("span.mobile"), "any": Field("span")})}, own=("employment_type", "data-href"))


def internshala(pages: DataFrame, as_of: Column) -> DataFrame:
    """Cards of jobs (those of internships are left out) with places, pay, experience, skills and a description of their own."""
    rows = elements(pages, "html", INTERNSHALA_CARD, []).where("own_employment_type in ('', 'job') and company is not null and title is not null")
    href = F.coalesce(F.nullif(F.col("link"), none()), F.nullif(F.col("own_data-href"), none()))
    item = lambda word: F.get(F.filter("items", lambda i: told(i["icon"]).contains(word)), 0)
    places = F.filter("places", lambda p: p != "")
    rows = rows.withColumns({"place": join_locations(places), "experience": told(item("briefcase")["any"]), "money": told(F.coalesce(item("money")["mobile"], item("money")["any"]))})
    home = F.exists("places", lambda p: F.lower(p).contains("work from home"))
    age = lambda label: F.when(F.lower(label).rlike("hour|few minutes"), as_of.cast("timestamp")).otherwise(relative_time(label, as_of))
    posted = F.get(F.filter(F.transform("labels", age), lambda t: t.isNotNull()), 0)
    return posting(rows, "internshala", title=F.col("title"), company=F.col("company"), location=_in_country(F.col("place")), url=F.when(href.startswith("/"), F.concat(F.lit(INTERNSHALA), href)).otherwise(href),
                   description=F.col("about"), posted_at=posted, remote=F.when(home, "remote").otherwise(detect_remote(F.col("place"), F.col("title"), F.substring(told("about"), 1, 1500))),
                   seniority=band_seniority(F.col("experience")), pay=pay_of(F.col("money")), skills=F.col("skills"), tags=(_tag("Experience: ", F.col("experience")),))


WELLFOUND = "https://wellfound.com"
WELLFOUND_STARTUP = "__typename string, name string, highlightedJobListings array<struct<__ref string>>"
WELLFOUND_LISTING = ("__typename string, id string, title string, slug string, locationNames array<string>, remote boolean, remoteConfig struct<kind string>, acceptedRemoteLocationNames array<string>, "
                     "liveStartAt string, compensation string, yearsExperienceMin string, yearsExperienceMax string, jobType string, description string")


def wellfound(pages: DataFrame) -> DataFrame:
    """Pages whose state is a cache of objects: listings do not name their company, startups name their listings. A listing of no startup is left out.

    urls of pages tell their caches apart; a listing that several startups of a page name belongs to the last."""
    state = F.get_json_object(F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), "$.props.pageProps.apolloState.data")
    nodes = pages.select(F.col("url").alias("page"), F.posexplode(F.map_values(F.from_json(state, "map<string, string>"))).alias("nth", "body"))
    startups = nodes.select("page", "nth", F.from_json("body", WELLFOUND_STARTUP).alias("s")).where("s.__typename = 'StartupResult'")
    owner = startups.select("page", "nth", "s.name", F.explode("s.highlightedJobListings.__ref").alias("ref")).groupBy("page", F.regexp_replace("ref", "^[^:]*:", "").alias("listing")).agg(F.max_by("name", "nth").alias("company"))
    listings = nodes.select("page", F.from_json("body", WELLFOUND_LISTING).alias("l")).where("l.__typename = 'JobListingSearchResult' and coalesce(l.id, '') <> ''").select("page", "l.*")
    rows = listings.join(owner, (listings["page"] == owner["page"]) & (F.col("id") == F.col("listing"))).drop(owner["page"]).where("coalesce(company, '') <> ''")
    places = F.filter(F.coalesce("locationNames", F.array().cast("array<string>")), lambda p: told(p) != "")
    accepted = F.coalesce(F.array_join("acceptedRemoteLocationNames", ", "), none())
    away = F.coalesce("remote", F.lit(False))
    rows = rows.withColumns({"place": F.when(F.size(places) > 0, join_locations(places)).when(away, F.when(accepted != "", F.concat(F.lit("Remote ("), accepted, F.lit(")"))).otherwise("Remote")).otherwise("")})
    kind = F.upper(told("remoteConfig.kind"))
    mode = F.when((kind == "REMOTE") | (away & (F.size(places) == 0)), "remote").when(kind == "HYBRID", "hybrid").otherwise(detect_remote(F.col("place"), F.col("title")))
    low, high = F.col("yearsExperienceMin"), F.nullif(F.nullif(F.col("yearsExperienceMax"), none()), F.lit("0"))
    years = F.when(low.isNotNull(), F.when(high.isNotNull(), F.format_string("Experience: %s-%s yrs", low, high)).otherwise(F.format_string("Experience: %s+ yrs", low)))
    kind_tag = F.when(told("jobType") != "", F.concat(F.upper(F.substring("jobType", 1, 1)), F.lower(F.replace(F.substr(F.col("jobType"), F.lit(2)), F.lit("-"), F.lit(" ")))))
    slug = F.coalesce(F.nullif(F.col("slug"), none()), slugify(F.col("title")))
    return posting(rows, "wellfound", title=F.col("title"), company=F.col("company"), location=F.col("place"), url=F.concat(F.lit(f"{WELLFOUND}/jobs/"), "id", F.lit("-"), slug), description=html_to_text(F.col("description")),
                   posted_at=F.timestamp_seconds(F.col("liveStartAt").try_cast("long")), remote=mode, seniority=band_seniority(low), pay=pay_of(F.substring_index(F.col("compensation"), "•", 1)), tags=(years, kind_tag))


@dataclass(frozen=True)
class CardBoard:
    """A board of plain cards: its fields are title, link, company, location, description, posted, pay; base stands before links that have no host."""

    card: str
    fields: dict[str, Field] = field(default_factory=dict)
    base: str = ""


def _plain(card: str, base: str = "", **fields: str | Field) -> CardBoard:
    return CardBoard(card, {n: f if isinstance(f, Field) else Field(f) for n, f in fields.items()}, base)


CARD_BOARDS = {
    "naukri": _plain("div.srp-jobtuple-wrapper, article.jobTuple", title="a.title", link=Field("a.title", "href"), company="a.comp-name, a.subTitle", location="span.locWdth, span.location",
                     description="span.job-desc, ul.job-desc", posted="span.job-post-day, span.fleft", pay="span.sal-wrap, span.salary"),
    "indeed_in": _plain("div.job_seen_beacon, div.cardOutline", "https://in.indeed.com", title="h2.jobTitle", link=Field("h2.jobTitle a, a.jcs-JobTitle", "href"), company="span[data-testid='company-name'], span.companyName",
                        location="div[data-testid='text-location'], div.companyLocation", description="div.job-snippet, div[data-testid='belowJobSnippet']", posted="span.date, span[data-testid='myJobsStateDate']",
                        pay="div.salary-snippet-container"),
    "foundit": _plain("div.srpResultCard, div.cardContainer", "https://www.foundit.in", title="div.jobTitle, h3.jobTitle", link=Field("a", "href"), company="div.companyName, span.companyName",
                      location="div.details.location, span.location", description="div.jobDescription, p.jobDesc", posted="span.timeText, div.timeStamp", pay="div.details.salary, span.salary"),
    "timesjobs": _plain("li.clearfix.job-bx", title="h2 a", link=Field("h2 a", "href"), company="h3.joblist-comp-name", facts=Field("ul.top-jd-dtl li", every=True), location="span.loc",
                        description="ul.list-job-dtl li", posted="span.sim-posted span"),
}


def card_postings(pages: DataFrame, board: str, as_of: Column) -> DataFrame:
    """The postings of a board of plain cards. A card without a link has the page's own address."""
    b = CARD_BOARDS[board]
    rows = elements(pages, "html", Record(b.card, b.fields), ["url"]).withColumnRenamed("url", "page_url")
    have = lambda c: told(c) if c in b.fields else none()
    if "facts" in b.fields:  # a list whose first entry is the pay and whose second is the place
        rows = rows.withColumns({"pay": told(F.get("facts", 0)), "location": F.coalesce(F.nullif(told(F.get("facts", 1)), none()), F.col("location"))})
    link = F.nullif(have("link"), none())
    url = F.when(link.isNull(), F.col("page_url")).when(link.startswith("http") | F.lit(b.base == ""), link).otherwise(F.concat(F.lit(b.base), link))
    return posting(rows, board, title=F.col("title"), company=F.coalesce(F.nullif(have("company"), none()), F.lit("Unknown")), location=have("location"), url=url, description=truncate(have("description")),
                   posted_at=relative_time(have("posted"), as_of), remote=detect_remote(have("location"), F.col("title"), have("description")), pay=parse_salary(told("pay") if "pay" in rows.columns else none()))


NAUKRI_ROW = ("jobId string, title string, jobTitle string, companyName string, location string, jdURL string, jobUrl string, jobDescription string, footerPlaceholderLabel string")


def naukri_state(pages: DataFrame, as_of: Column) -> DataFrame:
    """The flat objects with a jobId in the scripts of a page."""
    objects = F.regexp_extract_all("html", F.lit(r'(\{[^{}]*"jobId"\s*:\s*"[^"]+"[^{}]*\})'), 1)
    rows = pages.select(F.col("url").alias("page_url"), F.explode(F.transform(objects, lambda o: F.from_json(o, NAUKRI_ROW))).alias("j")).select("page_url", "j.*")
    title = F.coalesce(F.nullif(F.col("title"), none()), F.col("jobTitle"))
    return posting(rows, "naukri", title=title, company=F.coalesce(F.nullif(F.col("companyName"), none()), F.lit("Unknown")), location=F.col("location"),
                   url=F.coalesce(F.nullif(F.col("jdURL"), none()), F.nullif(F.col("jobUrl"), none()), F.col("page_url")), description=truncate(html_to_text(F.col("jobDescription"))),
                   posted_at=relative_time(F.col("footerPlaceholderLabel"), as_of), remote=F.lit("unknown"))


INSTAHYRE = "https://www.instahyre.com"
INSTAHYRE_ROW = ("objects array<struct<title string, employer struct<company_name string>, locations array<struct<name string>>, description string, job_description string, public_url string, "
                 "min_salary string, max_salary string>>")


def instahyre(pages: DataFrame) -> DataFrame:
    """An answer in JSON, wrapped in markup or not; pay is in lakhs."""
    body = F.regexp_extract("html", r"(?s)(\{.*\})", 1)
    rows = pages.select(F.explode(F.from_json(body, INSTAHYRE_ROW)["objects"]).alias("j")).select("j.*")
    place = F.array_join(F.transform("locations", lambda p: told(p["name"])), ", ")
    text = html_to_text(F.coalesce(F.nullif(F.col("description"), none()), F.col("job_description")))
    rows = rows.withColumns({"place": told(place), "text": text})
    label = F.when(told("min_salary") != "", F.concat_ws(" ", "min_salary", "max_salary", F.lit("LPA"))).otherwise("")
    return posting(rows, "instahyre", title=F.col("title"), company=F.coalesce(F.nullif(F.col("employer.company_name"), none()), F.lit("Unknown")), location=F.col("place"), url=F.concat(F.lit(INSTAHYRE), told("public_url")),
                   description=truncate(F.col("text")), remote=detect_remote(F.col("place"), F.col("title"), F.substring("text", 1, 1500)), pay=parse_salary(label))
