"""Lexical retrieval packing: a sharded BM25 index fills each window with unused neighbours of its first document.

Terms are the ids of a byte-level vocabulary, so that the corpus-wide document frequencies are a table bounded by that vocabulary; they
are counted over all documents. Documents are range-sorted by their heaviest terms that another document has too, which
brings related ones together, however many share a term; runs of SHARD_TOKENS tokens along that order are the shards. A shard has an
inverted index over all terms of its documents. The document that begins a window is its seed: the unused documents of the
shard follow in the order of their BM25 score for it, until the window is full; what the last one has left begins the next
window and is its seed. When no unused document shares a term, the next in order follows. A part's last window is cut into sequences of
powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import ranges
from millrace.llm.byte_bpe import byte_bpe
from millrace.llm.common import discard, read_text, written

CAPACITY, END_ID = 1024, 0
#: BM25's two constants: saturation of repeated terms, weight of the length.
K1, B = 1.2, 0.75
#: Tokens and documents of a shard (its index is held by one task), tokens of a part of the sorted corpus; parts are at most MOST_PARTS and then grow.
SHARD_TOKENS, SHARD_ROWS, PART_TOKENS, MOST_PARTS = 1 << 20, 1 << 14, 1 << 21, 20_000
KEY_TERMS = 3
#: Neighbours taken from the scores at first; twice as many each time that they leave room.
PULLED = 16
#: An index is made anew when this share of its documents is placed.
STALE = 0.1
#: A term is common in a shard if one in so many of its documents has it.
COMMON = 16


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, doc_tokens, ids as little-endian numbers), each text's ids followed by END_ID; and a row a task of
    terms and the number of its documents that hold each (dfs), in which ids is null."""
    shared = docs.sparkSession.sparkContext.broadcast(read_text(docs.sparkSession, path))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("dfs", T.ArrayType(T.LongType()))])
    lists = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(found):
        vocab = byte_bpe(shared.value)
        kind, total, id_type = id_kind(vocab.size), np.zeros(vocab.size, np.int64), None
        end = np.array([END_ID], kind)
        for batch in found:
            id_type = batch.column(0).type
            for a, rows in runs(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)), 4_000_000):
                part = batch.slice(a, rows)
                ids = [np.concatenate((vocab.encode(t or "", special=True).astype(kind), end)) for t in part.column(1).to_pylist()]
                size = np.array(list(map(len, ids)))
                total += np.bincount(counted(np.concatenate(ids), size)[1], minlength=vocab.size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *(pa.nulls(rows, k) for k in lists)], names=out.names)
        if id_type is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], lists[0]), pa.array([total[seen]], lists[1])], names=out.names)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def id_kind(size: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if size <= 1 << 16 else "<u4"


def runs(sizes: np.ndarray, limit: int):
    """(first row, rows) of successive runs of at most limit in all, or one row."""
    a = 0
    while a < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[a:]), limit, "right")))
        yield a, n
        a += n


def counted(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms and their numbers of documents given by one flat array, by document, then term."""
    bits = 8 * ids.itemsize
    kind = np.uint32 if len(size) << bits <= 1 << 32 else np.int64
    key, n = np.unique(np.repeat(np.arange(len(size), dtype=kind), size) << kind(bits) | ids, return_counts=True)
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), n


def frequencies(table: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs, summed over what tokenised() counted in each task."""
    each = table.where("terms is not null").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    out = np.zeros(terms, np.int64)
    for row in each.collect():  # a row for each id of the vocabulary at most
        out[row["terms"]] = row["df"]
    return out


def rarity(df: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


def weights(idf: np.ndarray, terms: np.ndarray, n: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25 of terms that occur n times in documents of a length."""
    return idf[terms] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))


def heaviest(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """KEY_TERMS terms of each document, the heaviest first; -1 where it has no more of a weight above 0."""
    out, weight = np.full((KEY_TERMS, docs), -1), weight.copy()
    first = np.searchsorted(doc, np.arange(docs))  # every document has END_ID at least
    for k in range(KEY_TERMS):
        best = np.maximum.reduceat(weight, first)
        at = np.flatnonzero((weight == best[doc]) & (best[doc] > 0))
        at = at[np.concatenate(([True], doc[at][1:] != doc[at][:-1]))] if len(at) else at
        out[k, doc[at]] = term[at]
        weight[at] = 0
    return out


class Filler:
    """Fills windows from shards, one after another; keeps the open window's pieces until it is full."""

    def __init__(self, capacity: int, sequence: int, idf: np.ndarray, mean: float):
        self.capacity, self.sequence, self.idf, self.mean = capacity, sequence, idf, mean
        self.window, self.filled, self.done = [], 0, []

    def _put(self, row: object, ids: np.ndarray, score: float | None) -> bool:
        """Places a whole document; whether a new window was begun with a part of it."""
        start, begun = 0, False
        while start < len(ids):
            begun = self.filled == 0
            part = ids[start: start + self.capacity - self.filled]
            self.window.append((row, start, part, len(ids), score))
            start += len(part)
            self.filled += len(part)
            score = None
            if self.filled == self.capacity:
                self._close(self.window)
                self.window, self.filled = [], 0
        return begun

    def _close(self, pieces: list) -> None:
        offset = 0
        for row, start, part, total, score in pieces:
            self.done.append((row, start, len(part), zlib.crc32(part.astype("<u4")), total, self.sequence, offset, score, part))
            offset += len(part)
        self.sequence += 1

    def shard(self, rows: list, ids: np.ndarray, size: np.ndarray) -> None:
        """Places all documents of a shard: rows are their ids in order, ids the flat tokens."""
        end = np.cumsum(size)
        doc, term, n = counted(ids, size)
        weight = weights(self.idf, term, n, size[doc], self.mean)
        own = np.searchsorted(doc, np.arange(len(size) + 1))
        order = np.argsort(term, kind="stable")
        by_term, by_doc, by_weight = term[order], doc[order], weight[order]
        terms = np.arange(int(by_term[-1]) + 2)
        many = np.diff(np.searchsorted(by_term, terms), append=len(by_term))
        # Terms of many documents as rows of weights, the others as postings.
        dense = np.flatnonzero(many * COMMON > len(size))
        row_of = np.full(len(terms), -1)
        row_of[dense] = np.arange(len(dense))
        common = row_of[by_term] >= 0
        rows_of = np.zeros((len(dense), len(size)))
        rows_of[row_of[by_term[common]], by_doc[common]] = by_weight[common]
        by_term, by_doc, by_weight = by_term[~common], by_doc[~common], by_weight[~common]
        at = np.searchsorted(by_term, terms)
        indexed = unplaced = len(size)
        free, following, seed, scores, pull = np.ones(len(size), bool), 0, None, None, PULLED

        def put(k: int, score: float | None) -> bool:
            nonlocal unplaced
            free[k] = False
            unplaced -= 1
            if scores is not None:
                scores[k] = 0
            return self._put(rows[k], ids[end[k] - size[k]: end[k]], score)

        while True:
            while following < len(size) and not free[following]:
                following += 1
            if following == len(size):
                return
            if not self.filled:
                seed, scores = following, None
                put(seed, None)
                continue
            if seed is None:  # the open window began in the shard before
                if put(following, None):
                    seed, scores = following, None
                continue
            if scores is None:
                pull = PULLED
                if unplaced < indexed * (1 - STALE):  # postings of what is placed go
                    live = free[by_doc]
                    by_term, by_doc, by_weight = by_term[live], by_doc[live], by_weight[live]
                    at, indexed = np.searchsorted(by_term, terms), unplaced
                mine = term[own[seed]: own[seed + 1]]
                read = ranges(at[mine], at[mine + 1] - at[mine])
                heavy = row_of[mine]
                scores = rows_of[heavy[heavy >= 0]].sum(axis=0) + np.bincount(by_doc[read], by_weight[read], len(size))
                scores = np.round(scores, 9) * free  # so that ties are ties in whatever order weights are added
            pull = min(pull, len(scores))
            pulled = np.flatnonzero(scores >= max(np.partition(scores, -pull)[-pull], 1e-9))
            pull *= 2
            pulled = pulled[np.argsort(-scores[pulled], kind="stable")] if len(pulled) else np.array([following])
            for k, score in zip(pulled.tolist(), scores[pulled].tolist()):
                if put(k, score or None):
                    seed, scores = k, None
                if not self.filled or scores is None:
                    break

    def finish(self) -> None:
        """Cuts the open window into sequences of powers of two, the longest first."""
        pieces, part = self.window, 1 << (self.capacity - 1).bit_length()
        while self.filled:
            if self.filled < part:
                part >>= 1
                continue
            taken, room = [], part
            while room:
                row, start, ids, total, score = pieces.pop(0)
                taken.append((row, start, ids[:room], total, score))
                if len(ids) > room:
                    pieces.insert(0, (row, start + room, ids[room:], total, None))
                room -= len(taken[-1][2])
            self._close(taken)
            self.filled -= part
        self.window = []


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
         shard_tokens: int = SHARD_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Every piece of docs: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, score (and ids if asked).

    score is the BM25 score for the window's seed of a document that retrieval has brought, else null. Null text counts as empty: its
    one token is the end token, and so it is for null ids, whose rows are packed each, as are repeated rows, which are each other's
    nearest neighbours. Ties in score go by the sorted order. Other columns are left out. An empty table packs to none.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    table = tokens.where("ids is not null").select("id", "doc_tokens", "ids", "row")
    n, mean, total = table.agg(F.count("*"), F.avg("doc_tokens"), F.sum("doc_tokens")).first()
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                       + [T.StructField("score", T.DoubleType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    if not n:
        return spark.createDataFrame([], out)
    size = byte_bpe(read_text(spark, path)).size
    df, kind = frequencies(tokens, size), id_kind(size)
    shared = spark.sparkContext.broadcast((rarity(df, n), df > 1))

    def keyed(found):
        idf, common = shared.value
        for batch in found:
            for a, rows in runs(np.asarray(pa.compute.binary_length(batch.column(2))), 8_000_000):
                part = batch.slice(a, rows)
                ids = [np.frombuffer(x, kind) for x in part.column(2).to_pylist()]
                size = np.array(list(map(len, ids)))
                doc, term, times = counted(np.concatenate(ids), size)
                keys = heaviest(doc, term, weights(idf, term, times, size[doc], mean) * common[term], rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(k.astype(np.int32)) for k in keys)], names=[*batch.schema.names, *(f"k{k}" for k in range(KEY_TERMS))])

    def fill(found):
        idf, _ = shared.value
        filler = Filler(capacity, TaskContext.get().partitionId() << 40, idf, mean)
        rows, parts, held = [], [], 0

        def made():
            done, filler.done = filler.done, []
            columns = list(zip(*done))
            arrays = [pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:7]] + [pa.array(columns[7], pa.float64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([p.astype(np.int32) for p in columns[8]], pa.list_(pa.int32()))] * keep_ids, names=out.names)

        def flush():
            size = np.array(list(map(len, parts)))
            filler.shard(rows[:], np.concatenate(parts), size)
            rows.clear()
            parts.clear()

        id_type = pa.int64()
        for batch in found:
            id_type = batch.column(0).type
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(x.as_buffer(), kind)
                if rows and (held + len(ids) > shard_tokens or len(rows) == SHARD_ROWS):
                    flush()
                    held = 0
                    if filler.done:
                        yield made()
                rows.append(row)
                parts.append(ids)
                held += len(ids)
        if rows:
            flush()
        filler.finish()
        if filler.done:
            yield made()

    order = [*(f"k{k}" for k in range(KEY_TERMS)), "row"]
    keys = T.StructType(table.schema.fields + [T.StructField(f"k{k}", T.IntegerType()) for k in range(KEY_TERMS)])
    parts = min(MOST_PARTS, max(1, total // part_tokens))
    sorted_ = written(table.mapInArrow(keyed, keys), "keyed")  # so that the ranges are found from the keys alone
    discard(tokens)
    return sorted_.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "ids").mapInArrow(fill, out)
