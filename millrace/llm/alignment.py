"""Cross-tokenizer alignment by a dictionary of groups.

A text is encoded twice, and where tokens of both sides end at one byte a group ends: some ids of A and the ids of B over the same
bytes. Few groups are distinct. Blocks of documents intern their groups, so that a block sends each distinct one once with its
number of occurrences, however often it occurs; the blocks' dictionaries meet in one of the corpus. There each distinct group is expanded into its links once,
and a pair of ids counts the occurrences of all groups that link it. What a group's links add up to goes back by its key to the blocks
that hold it, and each block sums over its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import ranges, same_words, vocabulary_path, word_keys
from millrace.llm.byte_bpe import byte_bpe
from millrace.llm.common import read_text, written
from millrace.llm.retrieval_packing import runs

BLOCK_BYTES = 2_000_000
#: Fixed value: how pieces write a space.
SPACE_SIGN = "▁"


def piece_vocabulary_path() -> str:
    return vocabulary_path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.token_bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
                            for i, p in enumerate(self.model.id_to_piece(list(range(self.model.get_piece_size()))))]


class Bytes:
    """The bytes of a vocabulary's tokens in one array."""

    def __init__(self, tokens: list[bytes]):
        self.data, self.size = np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)))
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> bytes:
        return self.data[ranges(self.start[ids], self.size[ids])].tobytes()


_BUILT: dict[int, tuple] = {}


def _coders(a_text: str, b_model: bytes) -> tuple:
    """This worker's vocabularies: A, the bytes of its tokens, B and the bytes of its pieces."""
    key = hash((a_text, b_model))
    if key not in _BUILT:
        _BUILT.clear()
        a, b = byte_bpe(a_text), Pieces(b_model)
        _BUILT[key] = a, Bytes(a.token_bytes), b, Bytes(b.token_bytes)
    return _BUILT[key]


def intern(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte strings in data (with eight bytes to spare): the number of each among the distinct ones, and where each of those first lies.

    Equal hashes are compared byte by byte."""
    numbers, firsts, todo, key = np.empty(len(start), np.int64), [], np.arange(len(start)), word_keys(data, start, size)
    while len(todo):  # once more only if different strings share a hash
        _, rep, which = np.unique(key[todo], return_index=True, return_inverse=True)
        of = todo[rep][which]
        same = same_words(data, start[todo], size[todo], data, start[of], size[of])
        numbers[todo[same]] = sum(map(len, firsts)) + which[same]
        firsts.append(todo[rep])
        todo = todo[~same]
    return numbers, np.concatenate(firsts) if firsts else todo


def grouped(a_ids: np.ndarray, a_size: np.ndarray, b_ids: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two token sequences over the same bytes: flat (number of A ids, A ids, B ids) a group, its start and size there, its end in bytes."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    mark = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, np.uint8)
    mark[a_end] = 1
    mark[b_end] += 2
    end = np.flatnonzero(mark == 3)
    a_of, b_of = np.searchsorted(end, a_end), np.searchsorted(end, b_end)
    n_a, n_b = np.bincount(a_of, minlength=len(end)), np.bincount(b_of, minlength=len(end))
    size = 1 + n_a + n_b
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int32)
    flat[start] = n_a
    flat[ranges(start + 1, n_a)] = a_ids
    flat[ranges(start + 1 + n_a, n_b)] = b_ids
    return flat, start, size, end


def links(n_a: int, ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A and B ids of each pair of a group's tokens whose bytes overlap: one between any two ends next to each other."""
    a, b = ids[:n_a], ids[n_a:]
    a_end, b_end = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    at = np.union1d(a_end, b_end)
    return a[np.searchsorted(a_end, at)], b[np.searchsorted(b_end, at)]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    groups is `a1,a2|b1;a3|b2,b3`. n_links counts pairs of an A and a B token over common bytes; a pair of ids has as its count the links of
    the whole corpus that hold it; count_sum adds up the counts of the row's links, n_best its links with the highest count of their B id, ties
    included. Null and empty texts, and those that either side does not give back byte by byte after a space put before them, have no tokens: zeros and an empty
    string. Repeated rows and null ids are rows like others and count each. Texts are encoded whole; one that is longer than a block is
    a block. Other columns are left out. An empty table gives none.
    """
    spark = docs.sparkSession
    a_text = spark.sparkContext.broadcast(read_text(spark, a_path))
    b_model = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(b_path).first()["content"]) if "://" in b_path else open(b_path, "rb").read())
    id_type = docs.schema[id_col].dataType
    long = T.LongType()
    both = T.StructType([T.StructField("block", long), T.StructField("id", id_type), T.StructField("n_a", long), T.StructField("n_b", long), T.StructField("sequence", T.BinaryType()),
                         T.StructField("local", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("freq", long)])

    def interned(found):
        """Blocks: a row for each document with the local numbers of its groups, then one for each distinct group."""
        a_coder, a_bytes, b_coder, b_bytes = _coders(a_text.value, b_model.value)
        block = TaskContext.get().partitionId() << 32
        for batch in found:
            for at, rows in runs(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)), block_bytes):
                part = batch.slice(at, rows)
                a_all, b_all, n_a, n_b = [], [], np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for k, t in enumerate(part.column(1).to_pylist()):
                    if not t:
                        continue
                    whole = (" " + t).encode()
                    b = np.array(b_coder.model.encode(t), np.int64)
                    if b_bytes.of(b) != whole:
                        continue
                    a = a_coder.encode(" " + t).astype(np.int64)
                    if a_bytes.of(a) == whole:
                        n_a[k], n_b[k] = len(a), len(b)
                        a_all.append(a)
                        b_all.append(b)
                numbers, made, freq, n_groups = np.zeros(0, np.int64), [], [], np.zeros(rows, np.int64)
                if a_all:
                    a, b = np.concatenate(a_all), np.concatenate(b_all)
                    flat, start, size, end = grouped(a, a_bytes.size[a], b, b_bytes.size[b])
                    numbers, first = intern(np.concatenate((flat, np.zeros(2, np.int32))).view(np.uint8), start * 4, size * 4)
                    freq = np.bincount(numbers)
                    made = [_key(flat[s: s + n]) for s, n in zip(start[first].tolist(), size[first].tolist())]
                    doc_end = np.concatenate(([0], np.cumsum(a_bytes.size[a])))[np.cumsum(n_a)]
                    n_groups = np.diff(np.searchsorted(end, doc_end, "right"), prepend=0)
                cut = np.concatenate(([0], np.cumsum(n_groups)))
                sequence = numbers.astype("<i4")
                none = lambda n, kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([pa.array([block] * rows, pa.int64()), part.column(0), pa.array(n_a), pa.array(n_b),
                                                  pa.array([sequence[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()),
                                                  none(rows, pa.int32()), none(rows, pa.string()), none(rows, pa.int64())], names=both.names)
                if made:
                    n = len(made)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), none(n, part.column(0).type), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()),
                                                      pa.array(np.arange(n, dtype=np.int32)), pa.array(made, pa.string()), pa.array(freq, pa.int64())], names=both.names)
                block += 1

    def expanded(found):
        _, a_bytes, _, b_bytes = _coders(a_text.value, b_model.value)
        for batch in found:
            pairs = []
            for key in batch.column(0).to_pylist():
                a, b = (np.array(side.split(","), np.int64) for side in key.split("|"))
                pairs.append(links(len(a), np.concatenate((a, b)), a_bytes.size, b_bytes.size))
            for at, rows in runs(np.array([len(a) for a, _ in pairs]), 200_000):
                mine = pairs[at: at + rows]
                of = pa.array(np.repeat(np.arange(at, at + rows), [len(a) for a, _ in mine]))
                sides = [pa.array(np.concatenate([p[side] for p in mine]), pa.int32()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *sides], names=["key", "freq", "a", "b"])

    table = written(docs.select(id_col, text_col).mapInArrow(interned, both), "groups")
    held = table.where("local is not null").select("block", "local", "key", "freq")
    expansion = written(held.groupBy("key").agg(F.sum("freq").alias("freq")).mapInArrow(expanded, "key string, freq long, a int, b int"), "links")
    of_b = Window.partitionBy("b")  # no more rows than A has ids
    pairs = expansion.groupBy("a", "b").agg(F.sum("freq").alias("count")).withColumn("most", F.max("count").over(of_b))
    sums = expansion.select("key", "a", "b").join(pairs, ["a", "b"]).groupBy("key").agg(
        F.sum("count").alias("count_sum"), F.sum((F.col("count") == F.col("most")).cast("long")).alias("n_best"))
    back = held.select("block", "local", "key").join(sums, "key")
    rows = table.where("local is null").select(F.col("block").alias("of_block"), "id", "n_a", "n_b", "sequence")
    out = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups", T.StringType())])

    def summed(mine: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(found["local"]))
        best, counts = (np.asarray(found[c])[order] for c in ("n_best", "count_sum"))
        keys = found["key"].take(pa.array(order)).to_pylist()
        columns = {c: [] for c in ("n_groups", "n_best", "count_sum", "groups")}
        for data in mine["sequence"].to_pylist():
            sequence = np.frombuffer(data, "<i4")
            columns["n_groups"].append(len(sequence))
            columns["n_best"].append(int(best[sequence].sum()))
            columns["count_sum"].append(int(counts[sequence].sum()))
            columns["groups"].append(";".join([keys[k] for k in sequence.tolist()]))
        n_groups = np.array(columns["n_groups"], np.int64)
        n_links = np.asarray(mine["n_a"]) + np.asarray(mine["n_b"]) - n_groups  # a group of m and n tokens has m + n - 1
        return pa.table([mine["id"], mine["n_a"], mine["n_b"], pa.array(n_groups), pa.array(n_links), pa.array(columns["n_best"], pa.int64()),
                         pa.array(columns["count_sum"], pa.int64()), pa.array(columns["groups"], pa.string())], names=out.names)

    return rows.groupBy("of_block").cogroup(back.groupBy("block")).applyInArrow(summed, out)


def _key(group: np.ndarray) -> str:
    n, *ids = group.tolist()
    return ",".join(map(str, ids[:n])) + "|" + ",".join(map(str, ids[n:]))
