"""BPE encoding and decoding in batches of numpy merge rounds.

The words of many texts lie in one flat array of code points; equal words are found by hash and compared byte by byte,
and each distinct word is encoded once per batch. Their symbols lie in one flat array too. A round looks up every pair of
neighbours by binary search over the sorted pair keys of the merge list, takes each word's lowest rank and merges
that pair wherever it occurs in the word; words without a known pair are done. Spark deals out the texts; a task
holds one batch at a time, and a batch is at most BATCH_CHARS characters or one text.

The vocabulary file is read on the driver and sent to tasks as a broadcast variable of its fixed size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_CHARS = 100_000
#: Unicode White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 0
#: Endings that stand alone after an apostrophe which begins a run of signs.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER by code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE] = BLANK
    return out


@lru_cache(1)
def _byte_signs() -> str:
    """The printable sign that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in own else next(spare)) for b in range(256))


@dataclass
class Vocabulary:
    """A lower-casing byte-level BPE with word ends, as its JSON text gives it."""

    text: str

    @cached_property
    def _json(self) -> dict:
        return json.loads(self.text)

    @cached_property
    def tokens(self) -> list[str]:
        vocab = {**self._json["model"]["vocab"], **{t["content"]: t["id"] for t in self._json["added_tokens"]}}
        out = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = token
        return out

    @cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self._json["added_tokens"]}

    @cached_property
    def special_pattern(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    @cached_property
    def symbols(self) -> np.ndarray:
        """Ids of the 256 bytes within a word, then of those that end a word."""
        vocab, end = self._json["model"]["vocab"], self._json["model"]["end_of_word_suffix"]
        return np.array([vocab[s + e] for e in ("", end) for s in _byte_signs()], np.int64)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pair keys, their ranks and the ids they merge to."""
        vocab = self._json["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in self._json["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        return keys[order], np.arange(len(keys))[order], made[order]


def normalise(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def merge_rounds(ids: np.ndarray, word: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids of symbols and the word each belongs to (ascending); returns both after all merges."""
    keys, ranks, made = vocab.pairs
    none = len(keys)

    def pair_ranks(at: np.ndarray) -> np.ndarray:
        """Of the pairs that begin at these places: rank, or none. Their merged ids follow from the rank."""
        last = at == len(ids) - 1
        right = np.where(last, at, at + 1)
        key = ids[at] << 32 | ids[right]
        found = np.minimum(np.searchsorted(keys, key), none - 1)
        return np.where((keys[found] == key) & (word[at] == word[right]) & ~last, ranks[found], none)

    by_rank = np.empty(none, np.int64)
    by_rank[ranks] = made
    done_ids, done_word = [], []
    rank = pair_ranks(np.arange(len(ids)))
    while len(ids):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(first, len(ids)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), size)
        gone = lowest == none
        if gone.any():
            done_ids.append(ids[gone])
            done_word.append(word[gone])
        hit = np.flatnonzero((rank == lowest) & ~gone)
        if len(hit):  # in a run of equal symbols pairs overlap: the 1st, 3rd, ... of a run of hits merge
            run = np.concatenate(([True], np.diff(hit) != 1))
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            ids[hit] = by_rank[rank[hit]]
            gone[hit + 1] = True
        keep = ~gone
        hit = (np.cumsum(keep) - 1)[hit]
        ids, word, rank = ids[keep], word[keep], rank[keep]
        if len(hit):
            rank[hit] = pair_ranks(hit)
            left = hit[hit > 0] - 1
            rank[left] = pair_ranks(left)
    ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
    order = np.argsort(word, kind="stable")
    return ids[order], word[order]


def split_words(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in code points: an apostrophe with a known ending, letters, one number, or signs."""
    kind = _classes()[chars]
    start = np.flatnonzero((kind != BLANK) & ((kind == NUMBER) | np.concatenate(([True], kind[1:] != kind[:-1]))))
    quote = start[chars[start] == 0x27]
    if len(quote):
        tail = np.concatenate((chars, np.zeros(3, chars.dtype)))
        length = np.zeros(len(quote), np.int64)
        for e in ENDINGS:
            fits = np.all([tail[quote + 1 + k] == ord(c) for k, c in enumerate(e)], axis=0) & (length == 0)
            length[fits] = len(e)
        quote, length = quote[length > 0], length[length > 0]
        inside = quote + 1 + length  # what follows the ending begins anew
        follows = kind[np.minimum(inside, len(chars) - 1)] == LETTER
        start = np.setdiff1d(start, quote + 1)
        start = np.union1d(start, inside[follows & (inside < len(chars))])
    change = np.concatenate((np.flatnonzero((kind[1:] != kind[:-1])) + 1, [len(chars)]))
    ends = change[np.searchsorted(change, start, "right")]
    ends[:-1] = np.minimum(ends[:-1], start[1:])
    ends = np.where(kind[start] == NUMBER, start + 1, ends)
    if len(quote):
        ends[np.searchsorted(start, quote)] = inside
    return start, ends


_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def word_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of all bytes of each word. data has eight bytes to spare."""
    eights, seed = _eights(data), np.uint64(seed)
    head = (eights[start] & _MASKS[np.minimum(size, 8)]) ^ seed
    key = (head ^ (head >> np.uint64(29))) * _MIX[0] + size.astype(np.uint64)
    todo, done = np.flatnonzero(size > 8), 8
    while len(todo):
        part = eights[start[todo] + done] & _MASKS[np.minimum(size[todo] - done, 8)]
        mixed = ((key[todo] ^ (key[todo] >> np.uint64(31))) * _MIX[2] ^ part ^ seed) * _MIX[1]
        key[todo] = mixed ^ (mixed >> np.uint64(32))
        done += 8
        todo = todo[size[todo] > done]
    key *= _MIX[2]
    return key ^ (key >> np.uint64(33))


def same_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether word k of data equals word k of other, by their bytes. Both have eight bytes to spare."""
    x, y, same, done = _eights(data), _eights(other), size == other_size, 0
    todo = np.flatnonzero(same)
    while len(todo):
        mask = _MASKS[np.minimum(size[todo] - done, 8)]
        equal = ((x[start[todo] + done] ^ y[other_start[todo] + done]) & mask) == 0
        same[todo[~equal]] = False
        done += 8
        todo = todo[equal]
        todo = todo[size[todo] > done]
    return same


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... up to size[0] of them, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """array, or a longer copy with room for n: room doubles, so that what is kept is not copied for every batch."""
    return array if len(array) >= n else np.concatenate((array, np.zeros(max(n - len(array), len(array)), array.dtype)))


class Encoder:
    """Encodes batches. Keeps the bytes and ids of the words it has met; a table of fixed size, in which a new word takes
    the place of another with the same slot, finds the word that may equal one of a batch, and their bytes decide."""

    SLOT_BITS, KEPT_WORDS, KEPT_BYTES = 18, 1_000_000, 1 << 26

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._reset()

    def _reset(self) -> None:
        self.ids, self.start = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.bytes, self.at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64)
        self.count = 0
        self.keys = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self.numbers = np.full(1 << self.SLOT_BITS, -1, np.int32)

    def _encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        own = data[ranges(start, size)]
        flat = own.astype(np.int64)
        flat[np.cumsum(size) - 1] += 256
        ids, word = merge_rounds(self.vocab.symbols[flat], np.repeat(np.arange(len(size)), size), self.vocab)
        first, at, n = self.start[self.count], self.at[self.count], self.count + len(size)
        self.start, self.at = _room(self.start, n + 1), _room(self.at, n + 1)
        self.ids, self.bytes = _room(self.ids, first + len(ids)), _room(self.bytes, at + len(own) + 8)
        self.start[self.count + 1: n + 1] = first + np.cumsum(np.bincount(word, minlength=len(size)))
        self.at[self.count + 1: n + 1] = at + np.cumsum(size)
        self.ids[first: first + len(ids)] = ids
        self.bytes[at: at + len(own)] = own
        self.count = n

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number in this encoder's store of each word of a batch."""
        if self.count > self.KEPT_WORDS or self.at[self.count] > self.KEPT_BYTES:
            self._reset()
        key = word_keys(data, start, size)
        slot = (key >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        numbers = np.where(self.keys[slot] == key, self.numbers[slot], -1)
        known = np.flatnonzero(numbers >= 0)
        held = self.at[numbers[known]]
        same = same_words(data, start[known], size[known], self.bytes, held, self.at[numbers[known] + 1] - held)
        numbers[known[~same]] = -1
        todo = np.flatnonzero(numbers < 0)
        while len(todo):  # once more only if different words share a hash
            _, rep, which = np.unique(key[todo], return_index=True, return_inverse=True)
            rep = todo[rep]
            fresh = self.count + np.arange(len(rep))
            self._encode(data, start[rep], size[rep])
            # Of words of one slot the last one stays; numpy keeps the last of repeated places in both.
            self.keys[slot[rep]], self.numbers[slot[rep]] = key[rep], fresh
            of = rep[which]
            same = same_words(data, start[todo], size[todo], data, start[of], size[of])
            numbers[todo[same]] = fresh[which[same]]
            todo = todo[~same]
        return numbers

    def segments(self, segments: list[str]) -> Encoded:
        lower = list(map(normalise, segments))
        joined = "\n".join(lower)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
        chars = data[:-8] if len(data) == len(joined) + 8 else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, ends = split_words(chars) if len(chars) else (np.zeros(0, np.int64),) * 2
        if not len(start):
            return Encoded(self.ids, self.start, np.zeros(0, np.int64), np.zeros(len(segments) + 1, np.int64))
        length = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
        bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(length))))
        if chars.dtype == np.uint32:  # from characters to bytes
            before = np.concatenate(([0], np.cumsum((chars > 0x7F).view(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF) + np.uint8(1), dtype=np.int64)))
            start, ends = before[start], before[ends]
        numbers = self.words(data, start, ends - start)
        return Encoded(self.ids, self.start, numbers, bounds)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocab: Vocabulary) -> Encoder:
    """This worker's encoder: what it has met stays known to later tasks."""
    if vocab.text not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocab.text] = Encoder(vocab)
    return _ENCODERS[vocab.text]


@dataclass
class Encoded:
    """The encoder's store of words and their ids, and the words of each segment in order."""

    word_ids: np.ndarray
    word_start: np.ndarray
    words: np.ndarray
    segment_start: np.ndarray

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids of segments a to b."""
        words = self.words[self.segment_start[a]: self.segment_start[b]]
        begin = self.word_start[words]
        return self.word_ids[ranges(begin, self.word_start[words + 1] - begin)]


def batches(texts: list[str], limit: int = BATCH_CHARS):
    """Runs of texts of at most limit characters in all, or one text."""
    run, chars = [], 0
    for t in texts:
        if run and chars + len(t) > limit:
            yield run
            run, chars = [], 0
        run.append(t)
        chars += len(t)
    if run:
        yield run


def slices(column: pa.Array, limit: int = BATCH_CHARS):
    """First row and texts (null: empty) of successive runs of a column, each of about limit bytes or one text."""
    sizes, a = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)), 0
    while a < len(column):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), limit)))
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b


def encode_batch(texts: list[str], encoder: Encoder):
    """For each batch of texts: its Encoded words, and per text the parts (first segment, last segment) or special id."""
    vocab = encoder.vocab
    for run in batches(texts):
        segments, parts = [], []
        for t in run:
            mine = []
            for piece in (vocab.special_pattern.split(t) if "<|" in t else (t,)):
                if piece in vocab.special:
                    mine.append(vocab.special[piece])
                else:
                    segments.append(piece)
                    mine.append((len(segments) - 1, len(segments)))
            parts.append(mine)
        yield encoder.segments(segments), parts


def encode(texts: list[str], encoder: Encoder):
    """The ids of each text as an int32 array."""
    for enc, parts in encode_batch(texts, encoder):
        for mine in parts:
            arrays = [enc.ids(*p) if isinstance(p, tuple) else np.array([p], np.int32) for p in mine]
            yield arrays[0] if len(arrays) == 1 else np.concatenate(arrays)


def decode(ids, vocab: Vocabulary) -> str:
    """As a tokenizer without a decoder gives it: the tokens joined by one space."""
    return " ".join([vocab.tokens[i] for i in ids])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(spark, path: str) -> Vocabulary:
    return Vocabulary(spark.read.text(path, wholetext=True).first()[0] if "://" in path else open(path, encoding="utf-8").read())


def decimal_text(ids: np.ndarray) -> bytes:
    """The ids as decimals joined by one space."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    rest, digits, shown = ids.astype(np.int64), np.empty((len(ids), width + 1), np.uint8), np.ones((len(ids), width + 1), bool)
    for k in range(width - 1, -1, -1):
        shown[:, k] = (rest > 0) | (k == width - 1)
        digits[:, k] = rest % 10 + 48
        rest = rest // 10
    digits[:, width] = 32
    return digits[shown].tobytes()[:-1]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """One row per row of docs: id_col, ids (array of int, or as_text: decimals joined by a space), n_tokens, decoded.

    Null counts as empty and has no ids; texts of any length are encoded whole; repeated rows are encoded each; null
    ids pass through. Other columns are left out. An empty table gives none. The result equals that of the
    tokenizers library without special tokens added; a special token's string in a text becomes its id there too.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, path))
    kind = T.StringType() if as_text else T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", kind), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(found):
        encoder = encoder_of(shared.value)
        vocab = encoder.vocab
        for batch in found:
            for a, texts in slices(batch.column(1)):
                ids = list(encode(texts, encoder))
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if as_text:
                    lists = pa.array([decimal_text(x) for x in ids], pa.binary()).cast(pa.string())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(ids)))
                decoded = [decode(x.tolist(), vocab) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), lists, pa.array(sizes), pa.array(decoded, pa.string())], names=out.names)

    return docs.select(id_col, text_col).mapInArrow(run, out)
