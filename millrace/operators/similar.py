"""Similarity join of titles, and the grouping in which the first title of a kind leads those like it.

Alike means 200 * (longest common subsequence) / (both lengths) >= least, of the words in sorted order. Candidates come from an inverted index:
titles that alike share enough pairs of neighbouring characters, so that their rarest ones, a number known from the length, have
one in common. Nothing is lost by that, and no group of titles meets in one task. A pair is kept at the first such character pair it shares,
its lengths and its Levenshtein distance are bounded in generated code, and what is left is compared exactly.

Leaders are found in rounds: a title that no undecided earlier title is like leads, and absorbs what is like it. That gives what
going through the titles one after another gives, in as many rounds as the longest chain of titles that wait for each other.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import discard, written

ALIKE = 88


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence: one row of the table of lengths is one number's bits."""
    masks: dict[str, int] = {}
    for j, d in enumerate(y):
        masks[d] = masks.get(d, 0) | 1 << j
    row = 0
    for c in x:
        take = row | masks.get(c, 0)
        row = take & ((take - ((row << 1) | 1)) ^ take)
    return row.bit_count()


def alike(x: str, y: str, least: float) -> bool:
    return 200.0 * common_length(x, y) >= least * (len(x) + len(y))


def _kept(least: float) -> tuple[float, float]:
    """Of two alike texts: the least share of one length in the other, and the share of the sum of lengths that bounds common pairs.

    With L in common, n - L characters are deleted and m - L inserted. A text with an edge put on both sides has n + 1 pairs of neighbours; a deletion
    ends two of them, an insertion one, so 1 + 3L - n - m stay, and L >= least * (n + m) / 200."""
    if not 200 / 3 < least <= 100:
        raise ValueError("least must be above 200/3: below it alike texts need not share a pair of characters")
    return least / (200 - least), 3 * least / 200 - 1


def alike_pairs(titles: DataFrame, group: str, key: str, text: str, least: float = ALIKE) -> DataFrame:
    """(early, late): keys of all pairs of rows of one group whose texts are alike, the smaller key first.

    Keys are unique; texts are distinct within a group. Texts of rare pairs meet few others; a pair of characters that a third of a group's titles
    have counts among the rarest of few titles only. Null groups and texts meet nobody."""
    short, shared = _kept(least)
    own = titles.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("x"), F.length(text).alias("n")).where("n > 0 and g is not null")
    edged = F.concat(F.lit("\u0002"), F.col("x"), F.lit("\u0003"))
    grams = own.select("g", "k", "x", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.substr(edged, i, F.lit(2)))).alias("gram"))
    counts = grams.groupBy("g", "k", "x", "n", "gram").agg(F.count("*").alias("times"))
    rare = counts.groupBy("gram").agg(F.count("*").alias("df"))
    each = counts.join(rare, "gram").select("g", "k", "x", "n", "df", "gram", F.explode(F.sequence(F.lit(1), "times")).alias("nth"))
    # The fewest pairs shared with any text of a length that comes into question; the rarest of the others hold one that is shared.
    fewest = F.ceil(1 + shared * (F.col("n") + F.ceil(F.col("n") * short - 1e-9)) - 1e-9)
    place = F.row_number().over(Window.partitionBy("k").orderBy("df", "gram", "nth"))
    kept = each.withColumn("place", place).where(F.col("place") <= F.col("n") + 2 - fewest)
    sign = F.concat("gram", F.col("nth").cast("string"))
    index = kept.select("g", "k", "x", "n", sign.alias("sign"), F.collect_list(sign).over(Window.partitionBy("k")).alias("signs"))
    # Lengths in bands: texts that are alike lie in one band or in neighbouring ones.
    band = F.floor(F.log("n") / -math.log(short - 1e-9) if short < 1 else F.col("n").cast("double")).cast("int")
    index = index.withColumn("band", band)
    asks = index.select("g", "sign", F.explode(F.array("band", F.col("band") + 1) if short < 1 else F.array("band")).alias("band"), F.struct("k", "x", "n", "signs").alias("a"))
    has = index.select("g", "sign", "band", F.struct("k", "x", "n", "signs").alias("b"))
    first = F.array_intersect("a.signs", "b.signs")
    pairs = asks.join(has, ["g", "sign", "band"]).where(
        ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.k") < F.col("b.k")))) & (F.col("a.n") >= F.col("b.n") * short - 1e-9)
        & (F.array_min(first) == F.col("sign")))
    pairs = pairs.select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), F.col("a.x").alias("xa"), F.col("b.x").alias("xb"), (F.col("a.n") + F.col("b.n")).alias("both"))
    near = pairs.where(F.levenshtein("xa", "xb") <= F.col("both") * (1 - least / 100) + 1e-9)  # edits are at most deletions and insertions

    def exact(found):
        for batch in found:
            same = [alike(x, y, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["ka", "kb"]).filter(pa.array(same, pa.bool_()))

    kind = titles.schema[key].dataType.simpleString()
    sure = near.select("ka", "kb", "xa", "xb").mapInArrow(exact, f"ka {kind}, kb {kind}")
    return sure.select(F.least("ka", "kb").alias("early"), F.greatest("ka", "kb").alias("late"))


def leaders(pairs: DataFrame) -> DataFrame:
    """(early, late) pairs -> (late as key, leader): every row that follows another, and the first leader it is like.

    A row leads if no earlier leader is like it. Each round writes what is undecided and reads it back."""
    edges = written(pairs.distinct(), "alike")
    every, found = edges, []
    while not edges.isEmpty():
        free = edges.select("early").distinct().join(edges.select(F.col("late").alias("early")), "early", "left_anti")
        led = written(free, "leaders")
        found.append(led)
        gone = edges.join(led, "early", "left_semi").select("late").distinct()
        rest = edges.join(led, "early", "left_anti").join(gone, "late", "left_anti").join(gone.withColumnRenamed("late", "early"), "early", "left_anti")
        left = written(rest.select("early", "late"), "alike")
        if edges is not every:
            discard(edges)
        edges = left
    if not found:
        return every.select(F.col("late").alias("key"), F.col("early").alias("leader"))
    lead = reduce(DataFrame.union, found)
    return every.join(lead, "early", "left_semi").groupBy("late").agg(F.min("early").alias("leader")).withColumnRenamed("late", "key")


def grouped(titles: DataFrame, group: str, title: str, order: str, least: float = ALIKE) -> DataFrame:
    """Distinct (group, title) rows with a unique order -> with leader: the order of the first title of the group that this one is like, its own for leaders.

    Titles of the same words are like each other, also those without words; null groups count as one row each."""
    rows = written(titles.select(F.col(group).alias("group"), F.col(title).alias("title"), F.col(order).alias("order"), sorted_words(F.col(title)).alias("words_")), "titles")
    kinds = rows.groupBy("group", "words_").agg(F.min("order").alias("key"))
    led = leaders(alike_pairs(kinds, "group", "key", "words_", least))
    mine = rows.join(kinds, ["group", "words_"], "left").withColumn("key", F.coalesce("key", "order")).join(led, "key", "left")
    return mine.select(F.col("group").alias(group), F.col("title").alias(title), F.col("order").alias(order), F.coalesce("leader", "key").alias("leader"))
