"""Descriptions of postings whose source lists titles only: which ones to ask for, and what landed detail pages add.

A source has a budget, and the first page of its queue that is a refusal ends the queue: what stands behind it is not taken, whatever its page
holds. The cut is a running maximum over the queue in its order, so it needs no loop over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.html import html_to_text, json_ld
from millrace.functions.salary import salary_from_text
from millrace.functions.text import detect_remote
from millrace.operators.rank import BLOCK_MARKERS, looks_blocked
from millrace.sources.cards import Field, Record, elements

#: A description shorter than that counts as none.
SHORTEST = 80


def queue(rows: DataFrame, stored: DataFrame, sources: list[str], budget: int, order: list, shortest: int = SHORTEST) -> DataFrame:
    """(id, source, url, nth from 1): of each source that can be asked again, at most budget rows in that order whose description is thin
    and which are not stored with a full one. Null descriptions are thin; order has to be unique in a source for equal results in reruns."""
    full = stored.where(F.length("description") >= shortest).select("id")
    thin = rows.where((F.coalesce(F.length("description"), F.lit(0)) < shortest) & F.col("source").isin(*sources)).join(full, "id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return thin.select("id", "source", "url", nth.alias("nth")).where(F.col("nth") <= budget)


def answers(asked: DataFrame, pages: DataFrame, markers: tuple[str, ...] = BLOCK_MARKERS) -> DataFrame:
    """asked with html and stopped: pages (url, status, html; the first by status and text of a url counts) joined to the queue.

    stopped holds from the first refused page of a source on. A url that has no page failed by itself and stops nothing."""
    landed = pages.groupBy("url").agg(F.min(F.struct("status", "html")).alias("page"))
    told = asked.join(landed, "url", "left")
    refused = F.col("page").isNotNull() & looks_blocked(F.col("page.html"), F.col("page.status"), markers)
    so_far = Window.partitionBy("source").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told.withColumn("stopped", F.max(refused).over(so_far)).select("id", "source", "url", "nth", "page.html", "page.status", "stopped")


def details(answered: DataFrame, body: str, criteria: Record | None = None, wanted: tuple[str, ...] = ()) -> DataFrame:
    """(id, description, tags) of the pages that were taken: the text of the first element that the selector body finds, and as tags the
    value of each of the criteria (elements with a label and a value) whose label holds a wanted word. A text of under SHORTEST characters is no description."""
    parts = {"body": Field(body, "html")} | ({"criteria": criteria} if criteria else {})
    taken = answered.where(~F.col("stopped") & F.col("html").isNotNull()).withColumn("html", F.concat(F.lit("<main-page>"), "html", F.lit("</main-page>")))
    found = elements(taken, "html", Record("main-page", parts), ["id"]).where(F.length("body") >= SHORTEST)
    tags = F.array().cast("array<string>")
    if criteria:
        named = F.filter("criteria", lambda c: F.exists(F.array(*map(F.lit, wanted)), lambda w: F.lower(c["label"]).contains(w)) & (c["value"] != ""))
        tags = F.array_distinct(F.transform(named, lambda c: c["value"]))
    return found.select("id", F.col("body").alias("description"), tags.alias("tags"))


# Where one board's public page has its text and its criteria, and which of these become tags.
GUEST_BODY = ".show-more-less-html__markup, .description__text"
GUEST_CRITERIA = Record(".description__job-criteria-item", {"label": Field(".description__job-criteria-subheader"), "value": Field(".description__job-criteria-text")})
GUEST_TAGS = ("employment type", "job function")


def posting_details(answered: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(id, description, tags, posted_at) of the pages that were taken and hold a JSON-LD JobPosting with a description of SHORTEST characters or more."""
    taken = answered.where(~F.col("stopped") & F.col("html").isNotNull()).select("id", json_ld(F.col("html")).alias("posting"))
    text = html_to_text(F.get_json_object("posting", "$.description"))
    found = taken.where("posting is not null").select("id", text.alias("description"), F.try_to_timestamp(F.get_json_object("posting", "$.datePosted")).alias("posted_at"))
    return found.where(F.length("description") >= SHORTEST).select("id", "description", F.array().cast("array<string>").alias("tags"), "posted_at")


def hydrated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the descriptions found, their tags added (once each, at the end), pay told in the text where a row has none, and the work mode read anew."""
    posted = F.col("posted_at") if "posted_at" in found.columns else F.lit(None).cast("timestamp")
    told = rows.join(found.select("id", F.col("description").alias("told_"), F.col("tags").alias("more_"), posted.alias("posted_")), "id", "left")
    has = F.col("told_").isNotNull()
    pay = salary_from_text(F.col("told_"))
    paid = has & F.col("salary_max").isNull() & pay["salary_max"].isNotNull()
    out = {c: F.col(c) for c in rows.columns}
    out["description"] = F.when(has, F.col("told_")).otherwise(F.col("description"))
    out["posted_at"] = F.coalesce("posted_", "posted_at")
    out["tags"] = F.when(has, F.array_union("tags", "more_")).otherwise(F.col("tags"))
    for c in ("salary_min", "salary_max", "salary_currency"):
        out[c] = F.when(paid, pay[c]).otherwise(F.col(c))
    out["remote"] = F.when(has, detect_remote(F.col("location"), F.col("title"), F.substring("told_", 1, 2000))).otherwise(F.col("remote"))
    return told.select(*[v.alias(c) for c, v in out.items()])


def report(answered: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: asked, filled, and the place in the queue of the refusal that ended it (null if none did)."""
    filled = answered.join(found.select("id", F.lit(1).alias("one")), "id", "left")
    return filled.groupBy("source").agg(F.count("*").alias("asked"), F.count("one").alias("filled"), F.min(F.when(F.col("stopped"), F.col("nth"))).alias("stopped_at"))
