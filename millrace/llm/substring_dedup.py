"""Substring dedup by level-wise doubling of word windows.

Wanted are all windows of WINDOW words that also start in a document with a smaller id. Lengths double up to WINDOW
(4, 7, 13 for 13 words): only windows all of whose representatives were repeated at one length are looked at in the
next, until the last length; a block without candidates left sends nothing more. Each window of the last length is
represented, at a shorter one, by the smallest hash among the windows of that length inside it: equal windows have equal
representatives, and neighbouring windows mostly share theirs, so a level sends a quarter of the positions or less.

Documents are dealt by hash to blocks of about BLOCK_BYTES. A block sends each distinct hash once, however many of
its documents hold it, in packed arrays by hash range; so a passage that a third of all documents share costs one
entry per block. What comes back is one bit for each hash sent, in the order in which it was sent: the block makes the
same array again. At the last length a window is known by a 128-bit BLAKE2b digest of all its bytes, salted for the
run: that two of n different windows agree has a chance below n * n / 2**129, whatever the texts. The bits then say which windows
have a smaller id elsewhere; repeats inside a block it settles itself.
"""

from __future__ import annotations

import os
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import ranges, word_keys
from millrace.llm.common import SPACE

WINDOW = 13
SHORTEST = 4
BLOCK_BYTES = 500_000
#: Blocks whose hashes of one range meet in a task.
BLOCKS_A_BUCKET = 64
#: Bits of a shorter window's hash that are sent besides its range; a chance match is found out at the last length.
SENT_BITS = 40
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, np.uint64(base)))))


def rolled(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of that many words at each place (the last length - 1 places wrap round and mean nothing)."""
    room = 1 << (len(words) + length).bit_length()
    base = int(MIX)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(base, room)[: len(words)])))
    ends = np.minimum(np.arange(len(words)) + length, len(words))
    out = (sums[ends] - sums[:-1]) * _powers(pow(base, -1, 1 << 64), room)[: len(words)]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each value and the width - 1 after it."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out, np.concatenate((out[step:], np.full(min(step, len(out)), np.iinfo(np.uint64).max, np.uint64)))[: len(out)])
        reach += step
    return out


class Words:
    """The words of a block's documents in flat arrays. Documents with a null id have none here."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, salt: bytes = bytes(16)):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
        self.salt = salt
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
        space = SPACES[self.data[:-8]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.concatenate(([0], edge))
        self.start, ends = edge[::2], edge[1::2]
        self.size = ends[: len(self.start)] - self.start
        offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.bounds))
        self.keys = word_keys(self.data, self.start, self.size, int.from_bytes(salt[:8], "little"))

    def windows(self, length: int) -> np.ndarray:
        """Places where a window of that many words of one document with an id begins."""
        left = self.bounds[1:][self.doc] - np.arange(len(self.doc))
        return np.flatnonzero((left >= length) & ~self.null[self.doc])

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each with one space behind it, and where each begins, with the end of all."""
        ends = np.cumsum(self.size + 1)
        out = self.data[ranges(self.start, self.size + 1)]
        out[ends - 1] = 0x20
        return out.tobytes(), np.concatenate(([0], ends))

    def digests(self, places: np.ndarray, window: int) -> np.ndarray:
        """The digest of each window: two numbers a row."""
        flat, at = self.joined()
        flat, salt = memoryview(flat), self.salt
        found = [blake2b(flat[s:e], digest_size=16, salt=salt).digest() for s, e in zip(at[places].tolist(), at[places + window].tolist())]
        return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def _representatives(words: Words, places: np.ndarray, level: int, window: int) -> np.ndarray:
    return smallest(rolled(words.keys, level), window - level + 1)[places]


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values (or rows) begins."""
    if not len(sorted_):
        return np.zeros(0, np.int64)
    new = sorted_[1:] != sorted_[:-1]
    return np.flatnonzero(np.concatenate(([True], new.any(1) if new.ndim == 2 else new)))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(64 - buckets)).astype(np.int64)


def _told(bucket: np.ndarray, flags: pa.Table, kind: int) -> np.ndarray:
    """The bits that came back for the hashes of one level, of which bucket holds the (ascending) buckets; none came: 0."""
    out = np.zeros(len(bucket), bool)
    for b, k, bits in zip(*(flags.column(c).to_pylist() for c in ("bucket", "kind", "bits"))):
        if k == kind:
            s, e = np.searchsorted(bucket, (b, b + 1))
            out[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
    return out


def _level(words: Words, places: np.ndarray, level: int, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct representatives (bucket and sent bits) of these windows, ascending, and the number of each window's."""
    keys = _representatives(words, places, level, window) >> np.uint64(64 - buckets - SENT_BITS)
    return np.unique(keys, return_inverse=True)


def _candidates(words: Words, window: int, levels: list[int], flags: pa.Table, buckets: int) -> np.ndarray:
    """Places of the windows whose representatives at all these levels are repeated."""
    places = words.windows(window)
    for kind, level in enumerate(levels):
        if not len(places):
            break
        keys, which = _level(words, places, level, window, buckets)
        places = places[_told((keys >> np.uint64(SENT_BITS)).astype(np.int64), flags, kind)[which]]
    return places


def _five(values: np.ndarray) -> bytes:
    """The lower 40 bits of each value, in five bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by_bucket(block: int, bucket: np.ndarray, *columns) -> pa.Table:
    """One row per bucket of arrays that are sorted by bucket; columns are (name, bytes of a slice)."""
    edge = np.append(_starts(bucket), len(bucket))
    pairs = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    return pa.table({"bucket": pa.array(bucket[edge[:-1]]), "block": pa.array([block] * len(pairs), pa.int64()),
                     **{name: pa.array([pack(a, b) for a, b in pairs], pa.binary()) for name, pack in columns}})


SENT = "bucket long, block long, hashes binary, twice binary"
FLAGS = "block long, kind int, bucket long, bits binary"
ASKED = "bucket long, block long, hashes binary, ids binary"


def _send(words: Words, block: int, places: np.ndarray, level: int, window: int, buckets: int) -> pa.Table:
    """The distinct representatives of these windows, and whether two documents of the block have them."""
    keys, which = _level(words, places, level, window, buckets)
    ids = words.ids[words.doc[places]]  # rows that share an id are one document
    least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(least, which, ids)
    np.maximum.at(most, which, ids)
    twice = least != most
    return _by_bucket(block, (keys >> np.uint64(SENT_BITS)).astype(np.int64), ("hashes", lambda a, b: _five(keys[a:b])), ("twice", lambda a, b: np.packbits(twice[a:b]).tobytes()))


def _flags(table: pa.Table, kind: int, parts: list[np.ndarray], bits: np.ndarray) -> pa.Table:
    """The bits, which stand for the entries of all parts in turn, for each block that has one set."""
    out, at = {"block": [], "bits": []}, 0
    for block, part in zip(table.column("block").to_pylist(), parts):
        own = bits[at: at + len(part)]
        at += len(part)
        if own.any():
            out["block"].append(block)
            out["bits"].append(np.packbits(own).tobytes())
    n, bucket = len(out["block"]), table.column("bucket")[0].as_py()
    return pa.table({"block": pa.array(out["block"], pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int64()), "bits": pa.array(out["bits"], pa.binary())})


def _repeated(table: pa.Table, kind: int) -> pa.Table:
    """For each block, which of the hashes it sent are in two documents."""
    parts = [_unfive(h) for h in table.column("hashes").to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)) for t, p in zip(table.column("twice").to_pylist(), parts)])
    _, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    many = (counts > 1) | (np.bincount(which, twice, len(counts)) > 0)
    return _flags(table, kind, parts, many[which])


def _exact(words: Words, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows at places: their distinct digests, ascending, the smallest id of each, and the number of each place's."""
    found = words.digests(places, window)
    order = np.lexsort((found[:, 1], found[:, 0]))
    found, first = found[order], _starts(found[order])
    least = np.minimum.reduceat(words.ids[words.doc[places[order]]], first) if len(first) else np.zeros(0, np.int64)
    group = np.empty(len(places), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(places))))
    return found[first], least, group


def _ask(words: Words, block: int, places: np.ndarray, window: int, buckets: int) -> pa.Table:
    both, least, _ = _exact(words, places, window)
    return _by_bucket(block, _bucket_of(both[:, 0], buckets), ("hashes", lambda s, e: both[s:e].tobytes()), ("ids", lambda s, e: least[s:e].tobytes()))


def _answer(table: pa.Table, kind: int) -> pa.Table:
    """For each block, which of its windows have a smaller id in another one."""
    parts = [np.frombuffer(h, np.uint64).reshape(-1, 2) for h in table.column("hashes").to_pylist()]
    both, ids = np.concatenate(parts), np.concatenate([np.frombuffer(i, np.int64) for i in table.column("ids").to_pylist()])
    order = np.lexsort((both[:, 1], both[:, 0]))
    first = _starts(both[order])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(ids))))
    return _flags(table, kind, parts, least < ids)


def _cut(words: Words, places: np.ndarray, flags: pa.Table, kind: int, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words and removed words of each document, and its kept words joined by one space."""
    both, least, group = _exact(words, places, window)
    elsewhere = _told(_bucket_of(both[:, 0], buckets), flags, kind)
    hit = places[elsewhere[group] | (words.ids[words.doc[places]] > least[group])]
    cover = np.zeros(len(words.start) + window + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    gone = np.cumsum(cover)[: len(words.start)] > 0
    n = len(words.bounds) - 1
    removed = np.bincount(words.doc[gone], minlength=n)
    kept = ~gone
    start, size = words.start[kept], words.size[kept] + 1
    out = words.data[ranges(start, size)].copy()
    ends = np.cumsum(size)
    out[ends - 1] = 0x20
    edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(np.bincount(words.doc[kept], minlength=n))))]
    flat = out.tobytes()
    return np.diff(words.bounds), removed, [flat[s: max(s, e - 1)] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]


def lengths(window: int) -> list[int]:
    """The window length halved, rounded up, while it stays at SHORTEST or above; ascending, without the window itself."""
    out = []
    while (window + 1) // 2 >= SHORTEST:
        window = (window + 1) // 2
        out.insert(0, window)
    return out or [window]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, join_all: bool = False,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the words covered by repeated windows, and n_words, n_removed (long).

    A changed text is its kept words joined by one space; others stay as they are, unless join_all asks for the same
    form (null then gives an empty text). Null and empty texts have no words. Rows that share an id are one document:
    neither is earlier. Rows with a null id take no part and stay whole. Ids are longs. Texts of any length are read
    whole. Other columns pass through, whatever their names; columns named n_words or n_removed are replaced. An empty
    table gives none.
    """
    docs = docs.drop("n_words", "n_removed")
    said = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != "")
    whole = docs.where(F.col(id_col).isNull()).withColumns({"n_words": F.size(said).cast("long"), "n_removed": F.lit(0).cast("long"), **({text_col: F.array_join(said, " ")} if join_all else {})})
    columns, docs = docs.columns, docs.where(F.col(id_col).isNotNull())
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = min(64 - SENT_BITS, max(5, (blocks // BLOCKS_A_BUCKET).bit_length()))
    levels, salt = lengths(window), os.urandom(16)
    block_col = "block_"
    while block_col in docs.columns:
        block_col += "_"
    # An id that many rows share is dealt by its texts: blocks compare by ids, so its rows need not lie together.
    dealt = docs.withColumn(block_col, F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks))).repartition(block_col)
    block_of = lambda t: t.column(block_col)[0].as_py()
    words_of = lambda t: Words(t.column(id_col), t.column(text_col), salt)

    def send(k: int, level: int):
        def of(t: pa.Table, f: pa.Table | None) -> pa.Table:
            words = words_of(t)
            return _send(words, block_of(t), _candidates(words, window, levels[:k], f, buckets), level, window, buckets)

        return of

    def repeated(k: int):
        return lambda t: _repeated(t, k)

    flags = None
    for k, level in enumerate(levels):
        one = send(k, level)
        sent = (dealt.groupBy(block_col).applyInArrow(lambda t: send(0, levels[0])(t, None), SENT) if flags is None else
                dealt.groupBy(block_col).cogroup(flags.groupBy("block")).applyInArrow(one, SENT))
        found = sent.groupBy("bucket").applyInArrow(repeated(k), FLAGS)
        flags = found if flags is None else flags.unionByName(found)

    def ask(t: pa.Table, f: pa.Table) -> pa.Table:
        words = words_of(t)
        return _ask(words, block_of(t), _candidates(words, window, levels, f, buckets), window, buckets)

    asked = dealt.groupBy(block_col).cogroup(flags.groupBy("block")).applyInArrow(ask, ASKED)
    answers = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, len(levels)), FLAGS)
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(t: pa.Table, f: pa.Table) -> pa.Table:
        words = words_of(t)
        n, removed, kept = _cut(words, _candidates(words, window, levels, f, buckets), f, len(levels), window, buckets)
        old = t.column(text_col).to_pylist()
        texts = pa.array([k.decode("utf-8", "surrogatepass") if join_all or r else o for k, r, o in zip(kept, removed, old)], pa.string())
        t = t.drop_columns([block_col]) if block_col in t.column_names else t
        t = t.set_column(t.column_names.index(text_col), text_col, texts)
        return t.append_column("n_words", pa.array(n, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    done = dealt.groupBy(block_col).cogroup(flags.unionByName(answers).groupBy("block")).applyInArrow(cut, out)
    return done.unionByName(whole.select(*columns, "n_words", "n_removed"))
