"""Rows of a tracker's three sheets. The column names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    """"INR 10–20" in whole numbers with thousands separators; one amount where the other is missing, zero or equal; no low amount: empty."""
    whole = lambda x: F.format_number(x, 0)
    both = F.coalesce((high != 0) & (high != low), F.lit(False))
    return F.when(low.isNull(), "").otherwise(F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), F.when(both, F.concat(whole(low), F.lit("–"), whole(high))).otherwise(whole(low)))))


def application_rows(postings: DataFrame, status: str = "Found", notes: str = "") -> DataFrame:
    posted = F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit(""))
    url = F.coalesce(F.nullif(F.col("apply_url"), F.lit("")), F.col("url"))
    return postings.select(
        F.col("id").alias("Job ID"), F.col("title").alias("Title"), F.col("company").alias("Company"), F.col("location").alias("Location"), F.col("remote").alias("Remote"),
        salary_text(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")).alias("Salary"), F.col("source").alias("Source"), posted.alias("Posted"), url.alias("URL"),
        F.lit(status).alias("Status"), F.lit("").alias("Next Action"), F.lit(notes).alias("Notes"))


def outreach_rows(drafts: DataFrame) -> DataFrame:
    """drafts: id, company, and any of the contact's and the letter's columns; what is missing or null is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in drafts.columns else F.lit("")
    return drafts.select(
        F.col("id").alias("Job ID"), F.col("company").alias("Company"), text("name").alias("Contact Name"), text("role").alias("Contact Role"), text("email").alias("Email"),
        text("email_confidence").alias("Email Confidence"), text("linkedin_search_url").alias("LinkedIn"), F.lit("").alias("Channel"), F.lit("No").alias("Sent?"),
        text("linkedin_note").alias("LinkedIn Note"), text("email_subject").alias("Email Subject"), text("email_body").alias("Email Body"), F.lit("").alias("Follow Up On"))


PARTS = {"Impact": "impact", "Keywords": "keyword_alignment", "ATS": "ats_parseability", "Clarity": "clarity", "Structure": "structure", "Evidence": "evidence",
         "Progression": "progression", "Language": "language_quality"}


def cv_rows(reports: DataFrame, target_role: str = "") -> DataFrame:
    """reports: total (null: partial), band, scores (map of part to score and max), top_fixes (array of problem and action)."""
    def part(name: str) -> Column:
        got = F.try_element_at(F.col("scores"), F.lit(name))
        return F.when(got.isNull(), "").otherwise(F.concat(got["score"].cast("string"), F.lit("/"), got["max"].cast("string")))

    fixes = F.transform(F.slice(F.coalesce("top_fixes", F.array()), 1, 3), lambda x: F.concat(F.coalesce(x["problem"], F.lit("")), F.lit(" → "), F.coalesce(x["action"], F.lit(""))))
    return reports.select(
        F.lit("").alias("Job ID"), F.coalesce(F.col("total").cast("string"), F.lit("partial")).alias("Score"), F.coalesce("band", F.lit("")).alias("Band"),
        *[part(v).alias(k) for k, v in PARTS.items()], F.lit(target_role).alias("Target Role"), F.array_join(fixes, " | ").alias("Top Fixes"))
