"""Line dedup by content-defined chunks, in DataFrame functions alone.

A text is cut into lines; a rolling hash over the hashes of two successive lines ends a chunk after a line where it
is less than at the line before and no more than at the line after. Boundaries thus depend on nearby lines only: a passage
pasted elsewhere is cut alike from its third line to its last but one. No two boundaries are neighbours, so a chunk has two
lines at least (three in the mean), but for texts of one line. Chunks of two or more lines which occur again anywhere are
compared by their bytes, the first occurrence (smallest id, then place) stays, and the others are cut from their texts.
What a passage has outside its whole chunks stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import salt_of, salted, written

MIN_LINES = 2
SALTS = 8


def line_hash(line: Column) -> Column:
    """First 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: Catalyst would otherwise copy it into the lambdas, to run at every element."""
    return F.transform(F.array(value), body)[0]


def _chunks(text: Column) -> Column:
    """Array of (n lines, text); null for null."""
    def cut(lines: Column) -> Column:
        n = F.size(lines)
        # The last two lines end no chunk but the last one, so that it has two lines too.
        rolled = _let(F.transform(lines, line_hash), lambda h: F.zip_with(h, F.concat(F.array(F.lit(0).cast("long")), F.slice(h, 1, n - 1)), lambda this, last: this + last * 31))
        ends = _let(rolled, lambda r: F.transform(r, lambda x, i: (i < n - 2) & F.coalesce((x < F.get(r, i - 1)) & (x <= F.get(r, i + 1)), F.lit(False))))
        starts = _let(ends, lambda e: F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | F.element_at(e, F.greatest(i - 1, F.lit(1)))))
        sizes = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(n + 1)), lambda s, e: F.struct(s.alias("at"), (e - s).alias("n")))
        pieces = lambda cuts: F.transform(cuts, lambda c: F.struct(
            c["n"].alias("n"), F.array_join(F.slice(lines, c["at"], c["n"]), "\n").alias("text")))
        return _let(_let(starts, sizes), pieces)

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), cut))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """docs with cleaned texts, and n_lines, n_removed (lines).

    Removed are chunks of MIN_LINES or more lines that occur anywhere before (a smaller id, or earlier in the text).
    Null texts stay null with no lines, an empty text is one line; texts of any length are cut whole. Rows that
    repeat an id and its text are treated alike and both keep a first occurrence. Rows with a null id come after all
    others and are never a first occurrence, unless a chunk occurs in such rows only. Other columns pass through, whatever
    their names; columns named n_lines or n_removed are replaced. An empty table gives none.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    inside = [f"c{k}" for k in range(len(names))]  # names used inside end in an underscore
    out = _line_dedup(docs.toDF(*inside), inside[names.index(id_col)], inside[names.index(text_col)], salts)
    return out.toDF(*names, "n_lines", "n_removed")


def _line_dedup(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    cut = docs.withColumn("sum_", F.xxhash64(text_col)).withColumn("chunks_", _chunks(F.col(text_col)))
    # The cut texts are written once; what follows reads of them the columns it needs.
    cut = written(cut.select(*[c for c in docs.columns if c != text_col], "sum_", F.col("chunks_.n").alias("sizes_"), F.col("chunks_.text").alias("texts_"),
                             F.transform("chunks_", lambda c: F.when(c["n"] >= MIN_LINES, F.unhex(F.sha2(c["text"], 256)))).alias("digests_")), "line-cut")
    key = F.col(id_col).alias("id_")
    occ = cut.select(F.posexplode_outer(F.arrays_zip("digests_", "texts_")).alias("k_", "c_"), key).where(F.col("c_.digests_").isNotNull())
    texts = (occ.select("id_", F.col("c_.digests_").alias("digest_"), F.col("c_.texts_").alias("chunk_"))
             .groupBy("digest_", "chunk_").agg(F.min("id_").alias("first_"), F.count("*").alias("times_")))
    repeated = written(texts.groupBy("digest_").agg(
        F.count("*").alias("texts_"), F.min("first_").alias("first_"), F.sum("times_").alias("times_")).where("times_ > 1"), "line-chunks")
    if repeated.where("texts_ > 1").isEmpty():
        by = ["digest_"]
        where = cut.select(key, "sum_", F.posexplode_outer("digests_").alias("k_", "digest_")).where("digest_ is not null")
    else:  # different chunks with one digest: chunks are told apart by their bytes here too
        by, repeated = ["digest_", "chunk_"], texts.where("times_ > 1")
        where = cut.select(key, "sum_", F.posexplode_outer(F.arrays_zip("digests_", "texts_")).alias("k_", "c_")).select(
            "id_", "sum_", "k_", F.col("c_.digests_").alias("digest_"), F.col("c_.texts_").alias("chunk_")).where("digest_ is not null")
    met = where.withColumn("salt", salt_of(salts, "id_", "k_")).join(salted(repeated.select(*by, "first_"), salts), [*by, "salt"])
    earlier = Window.partitionBy("id_", "sum_", *by).orderBy("k_")
    later = met.withColumn("nth_", F.dense_rank().over(earlier)).where((F.col("nth_") > 1) | ~F.col("id_").eqNullSafe(F.col("first_")))
    drops = later.groupBy("id_", F.col("sum_").alias("of_")).agg(F.collect_set("k_").alias("drops_"))
    kept = cut.join(drops, F.col(id_col).eqNullSafe(F.col("id_")) & (F.col("sum_") == F.col("of_")), "left")
    left = F.when(F.col("drops_").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("sizes_") - 1), "drops_"))
    kept = kept.withColumn("left_", left)
    stays = lambda c: F.when(F.col("left_").isNull(), F.col(c)).otherwise(F.transform("left_", lambda k: F.get(F.col(c), k)))
    lines = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long"))
    return kept.select(*[F.col(c) if c != text_col else F.array_join(stays("texts_"), "\n").alias(text_col) for c in docs.columns],
                       lines(F.col("sizes_")).alias("n_lines"), (lines(F.col("sizes_")) - lines(stays("sizes_"))).alias("n_removed"))
