"""Exact dedup by skew-safe combining, in DataFrame functions alone.

Rows are first combined locally (map-side partial aggregation), then by (digest, salt, text), so that a text
which a third of all rows share is merged by many tasks, and then the salt winners by (digest, text). The text
itself is among the grouping keys of every stage, so full contents are compared, not digests. The winners are
written without their texts; rows get their group back by digest, and only where two different texts share a
digest (which the written table tells) by the text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import salt_of, salted, written

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, digest=None,
                 salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. normalise(column) makes the text that is compared (default:
    no change); null counts as empty; very long texts are compared whole. Rows that repeat both id and text are
    counted each and share one decision. A null id never wins over another; a group of null ids alone keeps all its
    rows, with a null keep_id. Other columns are left out, so their names cannot clash. An empty table gives none.
    digest(column) may replace SHA-256 as the grouping digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    rows = docs.select(F.col(id_col).alias("id_"), text.alias("text_"))
    rows = rows.withColumn("digest", digest(F.col("text_"))).withColumn("salt", salt_of(salts, "id_"))

    local = rows.groupBy("digest", "salt", "text_").agg(F.max("id_").alias("keep_"), F.count("*").alias("n_"))
    texts = (local.repartition("digest").groupBy("digest", "text_")
             .agg(F.max("keep_").alias("keep_"), F.sum("n_").alias("n_")))
    winners = (texts.groupBy("digest").agg(F.count("*").alias("texts_"), F.max("keep_").alias("keep_"), F.sum("n_").alias("n_"))
               .where(F.col("n_") > 1))
    winners = written(winners, "exact-groups")

    # Groups of one row have no winner's row, so only repeated texts meet a partner here; their side is salted.
    ids = rows.select("id_", "digest", "salt", F.sha2("text_", 256).alias("sha_"))
    out = ids.join(salted(winners, salts), ["digest", "salt"], "left")
    plain = out.where(F.coalesce("texts_", F.lit(1)) == 1)
    result = _decided(plain, id_col, F.when(F.col("n_").isNull(), F.col("id_")).otherwise(F.col("keep_")),
                      F.coalesce("n_", F.lit(1)))
    shared = winners.where("texts_ > 1").select("digest")
    if shared.isEmpty():
        return result
    # Different texts with one digest: these few rows are grouped by their whole texts.
    theirs = rows.join(shared, "digest", "left_semi")
    by_text = theirs.groupBy("digest", "text_").agg(F.max("id_").alias("keep_"), F.count("*").alias("n_"))
    theirs = theirs.join(by_text, ["digest", "text_"]).withColumn("sha_", F.sha2("text_", 256))
    return result.unionByName(_decided(theirs, id_col, F.col("keep_"), F.col("n_")))


def _decided(rows: DataFrame, id_col: str, keep: Column, size: Column) -> DataFrame:
    return rows.select(F.col("id_").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"),
                       F.col("id_").eqNullSafe(keep).alias("kept"), F.col("sha_").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that exact_groups() drops. Rows are found again by id and text digest."""
    gone = exact_groups(docs, id_col, text_col, **options).where(~F.col("kept")).select(
        F.col(id_col).alias("id_"), F.col("text_sha256").alias("sha_")).distinct()
    normalise = options.get("normalise") or (lambda c: c)
    sha = F.sha2(normalise(F.coalesce(docs[text_col], F.lit(""))), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["id_"]) & (sha == gone["sha_"]), "left_anti")
