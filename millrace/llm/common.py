"""What the operators of this package share: written tables that cut lineage, and ranks within classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the query contracts: runs of bytes other than space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a vocabulary: on the driver's disk, or at a URI that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0] if "://" in path else open(path, encoding="utf-8").read()


def salted(right: DataFrame, salts: int) -> DataFrame:
    """One row of right for each salt, so that a hot key of the other side meets it in that many partitions."""
    return right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(salts: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def ranked(table: DataFrame, cls: list[str], order: list[str], rows_a_part: int = 100_000) -> DataFrame:
    """table (a written one, so that both passes see the same rows) with rank, from 0, within each class.

    A class may hold any share of the rows: it is cut into parts by hash, rows are numbered within
    their part, and each part begins where the parts before it end."""
    parts = max(8, table.count() // rows_a_part)
    rows = table.withColumn("part_", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(*cls).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cls, "part_").agg(F.count("*").alias("n_")).select(
        *cls, "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = Window.partitionBy(*cls, "part_").orderBy(*order)
    return (rows.withColumn("row_", F.row_number().over(within)).join(starts, [*cls, "part_"])
            .withColumn("rank", F.col("start_") + F.col("row_") - 1).drop("part_", "row_", "start_"))
