"""Connected components by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, salt_of, salted, written

SALTS = 8
#: Edges of a task of a round: the price of a small table's rounds is that of its tasks, whatever spark.sql.shuffle.partitions is.
EDGES_A_TASK = 100_000


def _with_least(edges: DataFrame, least: DataFrame, tasks: int) -> DataFrame:
    """edges with the m of their u; the edges of a hub are dealt to SALTS partitions."""
    return edges.withColumn("salt", salt_of(SALTS, "v")).join(salted(least, SALTS), ["u", "salt"]).drop("salt").coalesce(tasks)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
    return _with_least(both, least, tasks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    hung = _with_least(down, least, tasks).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks)


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(u, v) edges of comparable ids, in any direction -> (id, component): the smallest id reachable, for all but that one.

    known is what this gave for other edges, which count too: their stars are where the rounds begin. Every round is written
    to the shared folder. Rounds grow with the logarithm of the number of nodes, squared at worst.
    """
    if known is not None:
        if edges.isEmpty():
            return known
        edges = edges.select("u", "v").unionByName(known.select(F.col("id").alias("u"), F.col("component").alias("v")))
    state = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, last, tasks = now, state, max(8, now[0] // EDGES_A_TASK)
        state = written(_small_star(_large_star(state, tasks), tasks), "edges")
        discard(last)
