"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted to a bounded sample and linked to a graph of near centroids that tasks hold in memory. Every
vector goes to the list of its nearest centroid, found by a beam search on the graph, and also to those of further
centroids that are hardly more distant (boundary vectors). A query takes the lists whose centroids' distances stay
within a ratio of the nearest one's, up to a number that is measured on the table: a bounded sample of the queries is
compared with every vector, and as many lists are probed, up to all, as hold the share RECALL of what is truly
nearest; the ratio is widened to what hides no more than half of the rest. Lists are balanced: one with many vectors is dealt to parts, one with many
queries to blocks, and each pair of part and block is compared in one task. Scores of what is kept are cosines of the
original vectors in double precision. Equal vectors are one entry with its smallest ids, which is all that can be
among the nearest, so copies make no list longer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

LIST = 256
MOST_LISTS = 16_384
SAMPLE_PER_LIST = 32
REPLICAS, REPLICA_RATIO = 4, 1.1
LEAST_PROBES, PROBES, PROBE_RATIO = 4, 40, 1.5
RECALL, MEASURED_QUERIES = 0.98, 256
PART = 2048
BEAM, LINKS, FAR_LINKS = 48, 16, 4
#: Numbers that a step of the walk holds at once.
WALK_NUMBERS = 8_000_000


@dataclass
class Graph:
    """Unit centroids and, for each, its nearest others; entries are spread over the centroids."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def search(self, unit: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector the beam nearest centroids found, nearest first, and their distances."""
        n, k = len(unit), len(self.centroids)
        beam = min(beam, k)
        found = np.tile(self.entries, (n, 1))
        near = unit @ self.centroids[self.entries].T
        while True:
            more = self.links[found].reshape(n, -1)
            score = np.einsum("nmd,nd->nm", self.centroids[more], unit)
            every, scores = np.concatenate((found, more), 1), np.concatenate((near, score), 1)
            order = np.argsort(every, 1, kind="stable")
            every, scores = np.take_along_axis(every, order, 1), np.take_along_axis(scores, order, 1)
            scores[:, 1:][every[:, 1:] == every[:, :-1]] = -np.inf
            best = np.argsort(-scores, 1, kind="stable")[:, :beam]
            new, near = np.take_along_axis(every, best, 1), np.take_along_axis(scores, best, 1)
            if new.shape == found.shape and (new == found).all():
                return new, np.sqrt(np.maximum(0, 2 - 2 * near))
            found = new


def build(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 10) -> Graph:
    """Spherical k-means on the sample, in which an overfull cluster gives its place to the emptiest one's centroid."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy() if len(sample) else np.ones((1, 1))
    for _ in range(rounds if lists > 1 else 0):
        mine = np.concatenate([np.argmax(sample[a: a + 4096] @ centroids.T, 1) for a in range(0, len(sample), 4096)])
        size = np.bincount(mine, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, sample)
        for full, empty in zip(np.argsort(-size)[: lists // 20], np.argsort(size)[: lists // 20]):
            if size[full] > 3 * max(1, size[empty]) and size[full] > 1:
                sums[empty] = sample[rng.choice(np.flatnonzero(mine == full))]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)
    links = np.zeros((lists, max(1, min(LINKS, lists - 1))), int)
    for a in range(0, lists if lists > 1 else 0, 1024):  # never all lists against all at once
        near = centroids[a: a + 1024] @ centroids.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        links[a: a + 1024] = np.argsort(-near, 1)[:, : links.shape[1]]
    far = rng.integers(0, lists, (lists, FAR_LINKS))  # a few distant links keep the graph connected
    return Graph(centroids, np.concatenate((links, far), 1), rng.choice(lists, min(lists, BEAM), replace=False))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to about 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True, initial=0))[1])


def _rows(column: pa.Array) -> np.ndarray:
    return _scaled(np.asarray(column.flatten(), float).reshape(len(column), -1))


def _unit(column: pa.Array) -> np.ndarray:
    rows = _rows(column)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _reach(wanted: DataFrame, entries: DataFrame, posted: DataFrame, graph: Graph, k: int, probes: int, recall: float) -> tuple[int, float]:
    """Lists to probe, at least probes, and the ratio, with which a sample of the queries finds that share of its true nearest."""
    asked = wanted.orderBy(F.xxhash64("rid"), "rid").limit(MEASURED_QUERIES).toPandas()
    if not len(asked) or len(graph.centroids) <= probes:
        return probes, PROBE_RATIO
    own = asked["rid"].to_numpy()
    unit = _scaled(np.array(asked["v"].tolist(), float))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)

    def best(found):
        top, ids = np.full((len(own), 0), -np.inf), np.zeros((len(own), 0), np.int64)
        for batch in found:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                rid = np.asarray(part.column("rid"))
                score = unit @ _unit(part.column("v")).T
                score[own[:, None] == rid[None]] = -np.inf
                top, ids = np.concatenate((top, score), 1), np.concatenate((ids, np.tile(rid, (len(own), 1))), 1)
                keep = np.argsort(-top, 1, kind="stable")[:, :k] if top.shape[1] <= k else np.argpartition(-top, k - 1, 1)[:, :k]
                top, ids = np.take_along_axis(top, keep, 1), np.take_along_axis(ids, keep, 1)
        row, col = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[row, col]), pa.array(top[row, col])], names=["q", "rid", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "rid")
    true = entries.select("rid", "v").mapInArrow(best, "q long, rid long, score double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    # At most MEASURED_QUERIES * k rows, with REPLICAS lists each.
    held = posted.select("rid", "list").join(F.broadcast(true.select("q", "rid")), "rid").toPandas()
    if not len(held):
        return probes, PROBE_RATIO
    far = np.sqrt(np.maximum(0, 2 - 2 * unit @ graph.centroids.T))
    place = np.argsort(np.argsort(far, 1, kind="stable"), 1)
    q, at = held["q"].to_numpy(), held["list"].to_numpy()
    held["place"] = place[q, at]
    held["ratio"] = far[q, at] / np.maximum(far[q].min(1), 1e-9)
    each = held.groupby(["q", "rid"])[["place", "ratio"]].min()
    ratio = max(PROBE_RATIO, float(np.quantile(each["ratio"], (1 + recall) / 2, method="higher")))
    needed = np.sort(np.where(each["ratio"] <= ratio, each["place"] + 1, len(graph.centroids)))
    return max(probes, int(needed[int(np.ceil(recall * len(needed))) - 1])), ratio


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", list_size: int = LIST,
            probes: int = PROBES, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row for which the column queries holds.

    At most probes lists are read for a query, or more where a sample of the queries needs them to find the share recall.

    Nearness is the cosine, ties go to the smaller id; a row is not its own neighbour; with fewer candidates than k
    all are returned. Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those with
    another length than most (of equally frequent lengths, the smallest) or rows with a null id. Components may be as large or small as doubles
    are. Repeated rows count once. Other columns are left out. An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.where(_usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    # + 0.0 makes -0.0 and 0.0 one number.
    rows = rows.where(F.size("v") == common["d"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).groupBy("id", "v").agg(F.bool_or("asked").alias("asked"))
    rows = written(rows, "vectors")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = written(first.groupBy("v").agg(F.min("id").alias("rid"), F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    lists = max(1, min(MOST_LISTS, -(-n // list_size)))
    share = int(min(1.0, lists * SAMPLE_PER_LIST / n) * (1 << 20))
    taken = entries.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) <= share).select("rid", "v").toArrow().sort_by("rid")
    sample = _rows(taken.column("v").combine_chunks()) if len(taken) else np.ones((1, common["d"]))
    built = build(sample / np.linalg.norm(sample, axis=1, keepdims=True), lists)
    graph = spark.sparkContext.broadcast(built)

    def place(beam: int, least: int, most: int, ratio: float):
        wide = max(beam, most + most // 4)  # the beam grows with the lists that are wanted
        rows_ = max(8, min(1024, WALK_NUMBERS // (wide * (LINKS + FAR_LINKS) * common["d"])))

        def run(found):
            for batch in found:
                for a in range(0, len(batch), rows_):
                    part = batch.slice(a, rows_)
                    unit = _unit(part.column("v"))
                    near, far = graph.value.search(unit, wide)
                    nth = np.arange(near.shape[1])
                    keep = ((far <= ratio * np.maximum(far[:, :1], 1e-9)) & (nth < most)) | (nth < least)
                    row, col = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(near[row, col]), pa.array(col.astype(np.int32)), part.column("rid").take(pa.array(row)), part.column("v").take(pa.array(row))],
                                                     names=["list", "nth", "rid", "v"])
        return run

    kind = "list long, nth int, rid long, v array<double>"
    posted = written(entries.select("rid", "v").mapInArrow(place(12, 1, REPLICAS, REPLICA_RATIO), kind), "postings")
    asked = written(rows.where("asked").join(entries, "v").select("rid", F.col("id").alias("query_id")), "asked")
    wanted = entries.join(asked.select("rid").distinct(), "rid", "left_semi").select("rid", "v")
    probes, ratio = _reach(wanted, entries, posted, built, k, probes, recall)
    probed = written(wanted.mapInArrow(place(BEAM, LEAST_PROBES, probes, ratio), kind), "probes")
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(
        probed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks")), "list")
    # One row per list that is asked: no more than MOST_LISTS.
    deal = lambda side, own, other: side.join(F.broadcast(sizes), "list").select(
        "list", F.pmod(F.xxhash64("rid"), F.col(own)).cast("int").alias(own[:-1]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]), "rid", "v")

    def compare(of: pa.Table, among: pa.Table) -> pa.Table:
        out = {"q": [], "rid": [], "score": []}
        if len(of) and len(among):
            q, v = (_unit(t.column("v").combine_chunks()) for t in (of, among))
            ids = np.asarray(among.column("rid"))
            score = q @ v.T
            top = np.argpartition(-score, min(k, len(ids) - 1), 1)[:, : k + 1]
            # Rounding may differ at the edge between equals: keep all that tie with the last one kept.
            edge = np.take_along_axis(score, top, 1).min(1) - 1e-12
            row, col = np.nonzero(score >= edge[:, None])
            a, b = (_rows(t.column("v").combine_chunks()) for t in (of, among))
            a, b = a[row], b[col]
            out = {"q": np.asarray(of.column("rid"))[row], "rid": ids[col],
                   "score": np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))}
        return pa.table({"q": pa.array(out["q"], pa.int64()), "rid": pa.array(out["rid"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    cell = ["list", "part", "block"]
    hits = (deal(probed, "blocks", "parts").groupBy(*cell).cogroup(deal(posted, "parts", "blocks").groupBy(*cell))
            .applyInArrow(compare, "q long, rid long, score double").groupBy("q", "rid").agg(F.max("score").alias("score")))
    ranking = lambda by: Window.partitionBy(by).orderBy(F.desc("score"), "rid")
    hits = hits.withColumn("n", F.row_number().over(ranking("q"))).where(F.col("n") <= k + 1)
    ids = hits.join(entries.select("rid", "ids"), "rid").select("q", "score", F.explode("ids").alias("rid"))
    ids = ids.withColumn("n", F.row_number().over(ranking("q"))).where(F.col("n") <= k + 1)
    lists_ = ids.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("rid").alias("vec_id"))).alias("found"))  # k + 1 at most
    each = asked.join(lists_, asked["rid"] == lists_["q"]).select("query_id", F.array_sort(F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))).alias("found"))
    return each.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
