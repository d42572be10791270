"""Dictionary matching as a join: which phrases of a large table a text holds, at word boundaries.

A text's pieces are runs of letters and digits and what stands between. Every run of a phrase's number of words is offered to one equi-join by the
text that it is, with what stands between its words; what a phrase has before its first and after its last word is compared afterwards. So ten thousand
phrases are a table, no pattern of a plan, and the texts are cut once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = r"([a-z0-9]+|[^a-z0-9]+)"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), 1)


def phrase_table(phrases: DataFrame, phrase: str) -> DataFrame:
    """phrases with core (from the first to the last word), before and after it, and words. Phrases without a letter or digit are left out, as are nulls."""
    text = F.col(phrase)
    core = F.regexp_extract(text, "(?s)([a-z0-9](?:.*[a-z0-9])?)", 1)
    told = phrases.where(text.rlike("[a-z0-9]")).withColumns({"core_": core, "before_": F.regexp_extract(text, "(?s)^([^a-z0-9]*)", 1), "after_": F.regexp_extract(text, "(?s)([^a-z0-9]*)$", 1)})
    return told.withColumn("words_", F.size(F.regexp_extract_all("core_", F.lit("([a-z0-9]+)"), 1)))


def phrase_hits(rows: DataFrame, key: list[str], text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """key, the columns of phrases, at (which piece of the text it begins in): every place where a text (in lower case) holds a phrase, with no letter or digit right before or after it.

    Null and empty texts hold none; rows and phrases that repeat give a hit each. The longest phrase's number of words is asked of the table first: it bounds how many
    runs each word begins. Spark sends the phrases to the texts if they are small, and shuffles both by the run otherwise."""
    table = phrase_table(phrases, phrase)
    lengths = [r[0] for r in table.select("words_").distinct().orderBy("words_").collect()]  # a number for each length of a phrase
    if not lengths:
        return rows.select(*key).crossJoin(phrases.where(F.lit(False))).withColumn("at", F.lit(0)).where(F.lit(False))
    ps, i, n = F.col("pieces_"), F.col("at_"), F.col("n_")
    cut = rows.where(F.col(text).isNotNull()).select(*key, _pieces(F.col(text)).alias("pieces_"))
    piece = F.col("piece_")
    words = cut.select(*key, "pieces_", F.posexplode_outer("pieces_").alias("at_", "piece_")).where(((piece >= "0") & (piece < ":")) | ((piece >= "a") & (piece < "{")))
    runs = words.select(*key, "pieces_", "at_", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n_")).where(i + 2 * n - 1 <= F.size(ps))
    # Plain expressions over exploded rows are compiled, functions of elements are not. An outer explode, a run that is never null and a table that promises nothing of its
    # cores leave Spark no filter to infer, which would cut each text and put each run together once more.
    offers = runs.select(*key, "at_", F.coalesce(F.array_join(F.slice(ps, i + 1, 2 * n - 1), ""), F.lit("")).alias("run_"), F.get(ps, i - 1).alias("left_"), F.get(ps, i + 2 * n - 1).alias("right_"),
                         (i + 2 * n).alias("next_"), F.size(ps).alias("size_"))
    found = offers.join(table, F.col("run_") == F.col("core_"))
    left, right, empty = F.coalesce("left_", F.lit("")), F.coalesce("right_", F.lit("")), F.lit("")
    # What stands beside the run may be longer than what the phrase has there, or reach the text's end; else a letter or digit follows.
    fits_left = (F.col("before_") == empty) | (left.endswith(F.col("before_")) & ((F.length(left) > F.length("before_")) | (F.col("at_") <= 1)))
    fits_right = (F.col("after_") == empty) | (right.startswith(F.col("after_")) & ((F.length(right) > F.length("after_")) | (F.col("next_") >= F.col("size_"))))
    return found.where(fits_left & fits_right).select(*key, *[F.col(c) for c in phrases.columns], F.col("at_").alias("at"))


def phrases_in(rows: DataFrame, key: list[str], text: str, phrases: DataFrame, phrase: str, limit: int = 10) -> DataFrame:
    """key, found: the first limit phrases of each text, the longest first, then by phrase; texts without any have no row. A key is one text."""
    held = phrase_hits(rows, key, text, phrases.select(phrase).distinct(), phrase).select(*key, phrase).distinct()
    order = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.length(phrase)).alias("n"), F.col(phrase).alias("phrase")))), 1, limit), lambda p: p["phrase"])
    return held.groupBy(*key).agg(order.alias("found"))


def longest_alias(rows: DataFrame, key: list[str], text: str, aliases: DataFrame, alias: str, name: str) -> DataFrame:
    """key, name: what the longest alias in each text stands for, ties to the smaller alias, then name; texts without any have no row."""
    hits = phrase_hits(rows, key, text, aliases.select(alias, name), alias)
    best = F.min_by(name, F.struct((-F.length(alias)).alias("n"), F.col(alias).alias("a"), F.col(name).alias("b")))
    return hits.groupBy(*key).agg(best.alias(name))
