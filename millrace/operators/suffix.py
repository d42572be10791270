"""Longest-suffix join: which trailing words of a slug are an entry of a dictionary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_suffix(rows: DataFrame, slug: str, dictionary: DataFrame, name: str, most_words: int = 8) -> DataFrame:
    """rows with matched (the longest run of trailing words, at most most_words, that is in dictionary.name) and rest (one word at least); others go.

    Repeated rows stay repeated, null slugs go. Each distinct slug, and nothing else of its rows, offers its suffixes to an equi-join; the best one
    is joined back by the slug. Spark broadcasts the dictionary if it is small and shuffles otherwise."""
    words = F.split("slug_", "-")
    sizes = F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(words) - 1))
    slugs = rows.select(F.col(slug).alias("slug_")).where("slug_ like '%-%'").distinct()
    offers = slugs.select("slug_", F.explode(F.transform(sizes, lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice(words, F.size(words) - n + 1, n), "-").alias("matched")))).alias("offer_"))
    known = dictionary.select(F.col(name).alias("entry_")).distinct()
    found = offers.join(known, F.col("offer_.matched") == F.col("entry_")).groupBy("slug_").agg(F.max_by("entry_", "offer_.n").alias("matched"))
    rest = F.expr("substring(slug_, 1, length(slug_) - length(matched) - 1)")
    return rows.join(found, F.col(slug) == F.col("slug_")).withColumn("rest", rest).drop("slug_")


def _reversed_places(places: tuple[str, ...] | list[str]) -> str:
    """A pattern of one place read backwards, longer ones first, up to the hyphen before it."""
    return "(" + "|".join(re.escape(p[::-1]).replace("/", r"\/") for p in sorted(places, key=len, reverse=True)) + ")(?:-|$)"


def trailing_places(slug: Column, places: tuple[str, ...] | list[str]) -> Column:
    """struct(rest, places): a slug without the places at its end, and these in order. The longest place is taken first, from the end on."""
    one = _reversed_places(places)
    back = F.reverse(slug)
    ends = F.regexp_extract(back, f"^((?:{one})*+)", 1)
    found = F.reverse(F.transform(F.regexp_extract_all(ends, F.lit(one), 1), F.reverse))
    return F.struct(F.reverse(F.substr(back, F.length(ends) + 1)).alias("rest"), found.alias("places"))


def strip_places(slug: Column, places: list[str]) -> Column:
    """A slug without the places at its end, however many."""
    return trailing_places(slug, places)["rest"]
