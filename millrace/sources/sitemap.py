"""Postings told by the URLs of a sitemap, where title, employer and places are words of one slug without a mark between them.

The places at the slug's end are stripped and kept, the employer is the longest run of words before them that a
dictionary of employers lists, and what is left is the title. A slug without a listed employer is no posting: a guessed boundary would give wrong ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.functions.text import band_seniority, title_case_slug
from millrace.operators.suffix import longest_suffix, trailing_places

# How listing and employer URLs are built, the place words that end a slug, and words written in capitals.
LISTING = r"/job-listings-(.+?)-(\d+)-to-(\d+)-years?-\d{8,}/?$"
EMPLOYER = r"naukri\.com/(.+?)-jobs-careers-\d+/?$"
PLACES = ("delhi-ncr new-delhi greater-noida navi-mumbai bangalore-rural bangalore-urban hyderabad secunderabad bengaluru bangalore gurugram gurgaon noida ghaziabad faridabad "
          "chennai kolkata mumbai pune ahmedabad jaipur chandigarh mohali kochi coimbatore indore lucknow nagpur surat vadodara bhubaneswar thiruvananthapuram mysuru mysore "
          "visakhapatnam patna bhopal goa guwahati raipur remote india anywhere").split()
ACRONYMS = ("ncr ibm tcs hcl kpmg pwc hdfc icici sbi hsbc hr it ites bpo kpo bfsi nbfc mnc sme msme ai ml sql aws gcp sap crm erp qa ui ux seo llp uae usa uk gst kyc cfa mba bsc msc bca mca").split()
MOST_WORDS = 8


@dataclass(frozen=True)
class SlugForm:
    """How one site writes its listings: a pattern of slug, least and most years; its place words; its country; a tag of every posting."""

    listing: str = LISTING
    places: tuple[str, ...] = tuple(PLACES)
    acronyms: tuple[str, ...] = tuple(ACRONYMS)
    country: str = "India"
    tag: str = "Details on Naukri"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of every entry of sitemap files, plain or gzip. A row is read up to the end of an entry, so a file of
    any length is no row of its own; entries without a loc are left out, one without a lastmod has null."""
    rows = spark.read.option("lineSep", "</url>").text(path)
    found = lambda tag: F.regexp_extract("value", rf"(?s)<{tag}>\s*([^<\s]+)\s*</{tag}>", 1)
    return rows.select(found("loc").alias("url"), F.nullif(found("lastmod"), F.lit("")).alias("lastmod")).where("url <> ''")


def employers(urls: DataFrame, pattern: str = EMPLOYER) -> DataFrame:
    """The distinct slugs of the employers that (url) rows list."""
    return urls.select(F.regexp_extract("url", pattern, 1).alias("employer")).where("employer <> ''").distinct()


def url_postings(listings: DataFrame, known: DataFrame, g: geo.Gazetteer, form: SlugForm = SlugForm()) -> DataFrame:
    """(url, lastmod) rows and (employer) slugs -> url, title, company, location, posted_at, seniority, tags.

    Rows whose URL is no listing, whose words hold no employer of known after a title of three characters at least, and null
    URLs go; repeated rows stay repeated. An unreadable lastmod gives a null posted_at; no places give the country, and places
    outside the gazetteer have it added. Without employers there are no postings."""
    part = lambda k: F.regexp_extract("url", form.listing, k)
    read = listings.select("url", "lastmod", part(1).alias("words"), part(2).alias("low"), part(3).alias("high")).where("words <> ''")
    read = read.withColumn("cut", trailing_places(F.col("words"), form.places))
    read = read.select("url", "lastmod", "low", "high", F.col("cut.rest").alias("slug"), "cut.places")
    found = longest_suffix(read, "slug", known, "employer", MOST_WORDS)
    case = lambda slug: title_case_slug(slug, form.acronyms)
    named = found.withColumn("title", case(F.col("rest"))).where(F.length("title") >= 3)
    named = named.withColumn("location", F.coalesce(F.nullif(F.array_join(F.transform("places", case), ", "), F.lit("")), F.lit(form.country)))
    return named.select(
        "url", "title", case(F.col("matched")).alias("company"), with_country(F.col("location"), form.country, g).alias("location"), F.try_to_timestamp("lastmod").alias("posted_at"),
        band_seniority(F.col("low")).alias("seniority"), F.array(F.format_string("Experience: %s-%s yrs", "low", "high"), F.lit(form.tag)).alias("tags"))


def with_country(location: Column, country: str, g: geo.Gazetteer) -> Column:
    """A location that names no city of the gazetteer and not the country has the country added."""
    told = geo.canonical_city(location, g).isNotNull() | F.lower(location).contains(country.lower())
    return F.when(told, location).otherwise(F.concat_ws(", ", F.nullif(location, F.lit("")), F.lit(country)))
