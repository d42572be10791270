"""The corpus kept by a stream: each micro-batch is upserted, retained and becomes a new version.

A version is a folder named after its batch; it counts once Spark's commit has put _SUCCESS into it. A batch reads the
highest version before its own, so one that failed and runs again changes nothing twice, and a crash at any moment
leaves the last whole version in force. The two versions before a new one are kept, older ones deleted."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import corpus

KEPT = 2


def versions(spark, root: str) -> list[int]:
    """The finished versions, ascending."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def current(spark, root: str, schema, before: int | None = None) -> DataFrame:
    """The corpus as the last finished batch (of those before a given one) left it; empty at first."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{root}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def upsert_batch(root: str, schema, order: list, days: int = 60, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """For writeStream.foreachBatch. The time of a batch is its latest last_seen_at, so a rerun gives the same corpus."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = corpus.latest(prepare(batch) if prepare else batch, ["id"], order)
        now = rows.agg(F.max("last_seen_at")).first()[0]
        if now is None:
            return
        merged = corpus.retained(corpus.upsert(current(spark, root, schema, batch_id), rows, F.lit(now)), F.lit(now), days)
        merged.write.mode("overwrite").parquet(f"{root}/v{batch_id}")
        jvm = spark._jvm
        for old in [v for v in versions(spark, root) if v < batch_id][:-KEPT]:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/v{old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return run


def arrivals(stream: DataFrame, ts: str, late: str = "60 days", window: str = "1 day") -> DataFrame:
    """Postings per source and day, closed once the retention window has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), "source").agg(F.count("*").alias("n"))
