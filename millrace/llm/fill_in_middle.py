"""Fill-in-middle: texts are cut in three at unit boundaries and put in another order, in two table-driven scans.

A unit is a run of ASCII letters or one other character. One byte automaton knows UTF-8 continuation bytes, unit
boundaries and the sentinels; its table gives, for each state and byte, the next state and a packed count of what the byte
begins (a character, a unit) or completes (a sentinel). Texts lie in one flat array of bytes, cut into lanes of LANE bytes, and all lanes
step at once. The state depends on the last few bytes only, so a lane is put into its state by the bytes before it. The first scan gives
the counts of every lane; the second walks only the lanes that hold a cut and finds its byte.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import ranges

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
LANE, BATCH_BYTES = 256, 4_000_000
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: No byte of UTF-8: what lies outside a text.
OUTSIDE = 0xFF
CHAR, UNIT, SENTINEL, FIELD = 1, 1 << 10, 1 << 20, (1 << 10) - 1


def check_sentinels(sentinels: tuple[str, ...]) -> None:
    """Raises ValueError for sentinels that could overlap: then an output could be read in two ways."""
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if b[:k] != a):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


@lru_cache(8)
def automaton(sentinels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """By 256 * state + byte: 256 * the next state, and the packed counts.

    A state is how much of a sentinel the last bytes are, and whether the last byte was a letter."""
    marks = [s.encode() for s in sentinels]
    begun = sorted({m[:k] for m in marks for k in range(len(m))}, key=len)
    number = {b: i for i, b in enumerate(begun)}
    follows, counts = np.zeros((len(begun), 2, 256), np.int32), np.zeros((len(begun), 2, 256), np.int32)
    for before, i in number.items():
        for byte in range(256):
            if byte == OUTSIDE:
                continue
            seen = before + bytes([byte])
            reached = max((b for b in begun if seen.endswith(b)), key=len)
            follows[i, :, byte] = 256 * (2 * number[reached] + LETTERS[byte])
            begins = byte & 0xC0 != 0x80
            for inside in (0, 1):
                unit = begins and not (inside and LETTERS[byte])
                counts[i, inside, byte] = begins * CHAR + unit * UNIT + any(map(seen.endswith, marks)) * SENTINEL
    return follows.ravel(), counts.ravel()


def steps(data: np.ndarray, first: np.ndarray, size: np.ndarray, fresh: np.ndarray, sentinels: tuple[str, ...]):
    """Walks lanes, longest first, byte by byte: yields how many lanes go on and the packed counts of their bytes.

    data has LANE bytes to spare before its first lane. fresh lanes begin a text, the others are led in by the bytes before."""
    follows, counts = automaton(sentinels)
    state, known = np.zeros(len(first), np.int64), max(len(s.encode()) for s in sentinels)
    for j in range(-known, 0):
        state = follows[state + np.where(fresh, OUTSIDE, data[first + j])].astype(np.int64)
    many = len(size) - np.searchsorted(size[::-1], np.arange(LANE), "right")
    for j, m in enumerate(many.tolist()):
        if not m:
            return
        at = state[:m] + data[first[:m] + j]
        state[:m] = follows[at]
        yield j, m, counts[at]


def _walked(data, first, size, fresh, sentinels):
    order = np.argsort(-size, kind="stable")
    total = np.zeros(len(first), np.int64)
    for _, m, count in steps(data, first[order], size[order], fresh[order], sentinels):
        total[:m] += count
    out = np.empty_like(total)
    out[order] = total
    return out


def _located(data, first, size, fresh, skip, sentinels):
    """Of each lane the place of the unit after skip units, and the characters before it. The lane holds more units than skip."""
    order = np.argsort(-size, kind="stable")
    left, place, chars = skip[order].copy(), np.full(len(first), -1), np.zeros(len(first), np.int64)
    for j, m, count in steps(data, first[order], size[order], fresh[order], sentinels):
        unit, open_ = (count & UNIT) != 0, place[:m] < 0
        place[:m][open_ & unit & (left[:m] == 0)] = j
        left[:m] -= unit
        chars[:m] += (place[:m] < 0) & ((count & CHAR) != 0)
    out = np.empty((2, len(first)), np.int64)
    out[:, order] = place, chars
    return out


def cuts(data: np.ndarray, start: np.ndarray, size: np.ndarray, draws: np.ndarray, sentinels: tuple[str, ...]):
    """n units, whether a sentinel occurs, and of each of two draws a text its cut in units, bytes and characters (2 x texts).

    A cut lies after draw % (n + 1) units, the smaller one first."""
    lanes = -(-size // LANE)
    text = np.repeat(np.arange(len(size)), lanes)
    nth = ranges(np.zeros_like(lanes), lanes)
    first = start[text] + nth * LANE
    length = np.minimum(LANE, size[text] - nth * LANE)
    packed = _walked(data, first, length, nth == 0, sentinels)
    before = [np.concatenate(([0], np.cumsum((packed >> shift) & FIELD))) for shift in (0, 10, 20)]
    edge = np.concatenate(([0], np.cumsum(lanes)))
    chars, units, marks = (b[edge[1:]] - b[edge[:-1]] for b in before)
    cut = np.sort(draws % (units + 1), axis=0)
    byte, char = np.broadcast_to(size, cut.shape).copy(), np.broadcast_to(chars, cut.shape).copy()
    which, of = np.nonzero(cut < units)
    if len(of):
        target = before[1][edge[of]] + cut[which, of]
        lane = np.searchsorted(before[1], target, "right") - 1
        place, passed = _located(data, first[lane], length[lane], nth[lane] == 0, target - before[1][lane], sentinels)
        byte[which, of] = nth[lane] * LANE + place
        char[which, of] = before[0][lane] - before[0][edge[of]] + passed
    return units, marks > 0, cut, byte, char


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, suffix_first: int = 20, sentinels: tuple[str, ...] = SENTINELS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n units, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Numbers drawn from the SHA-256 of seed and id choose both cuts, whether the text stays plain (100 - percent in a hundred) and whether
    its suffix comes first (suffix_first in a hundred of the rest). A text that is empty or holds a sentinel stays plain, so restore()
    gives every text back. Null text counts as empty, a null id as an empty one; rows with one id are drawn alike; texts of any
    length are cut whole; other columns are left out; an empty table gives none.
    """
    check_sentinels(tuple(sentinels))
    sentinels = tuple(sentinels)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary"), *numbers).toDF("id", "text", "h1", "h2", "h3", "h4")
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    p, s, m = (x.encode() for x in sentinels)

    def run(found):
        for batch in found:
            bytes_of = np.asarray(pa.compute.binary_length(batch.column(1)))
            a = 0
            while a < len(bytes_of):
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(bytes_of[a:]), BATCH_BYTES)))
                part, size = batch.slice(a, b - a), bytes_of[a:b].astype(np.int64)
                texts = part.column(1).to_pylist()
                data = np.frombuffer(bytes(LANE) + b"".join(texts), np.uint8)
                h = np.stack([np.asarray(part.column(k)) for k in range(2, 6)])
                n, marked, _, byte, char = cuts(data, LANE + np.cumsum(size) - size, size, h[:2], sentinels)
                plain = (size == 0) | marked | (h[2] % 100 >= percent)
                first = ~plain & (h[3] % 100 < suffix_first)
                made = []
                for t, stay, spm, x, y in zip(texts, plain.tolist(), first.tolist(), *byte.tolist()):
                    made.append(t if stay else b"".join((s, t[y:], p, t[:x], m, t[x:y]) if spm else (p, t[:x], s, t[y:], m, t[x:y])))
                form = np.where(plain, "plain", np.where(first, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(char[0], pa.int64(), mask=plain),
                     pa.array(char[1] - char[0], pa.int64(), mask=plain), pa.array(made, pa.binary()).cast(pa.string())], names=out.names)
                a = b

    return rows.mapInArrow(run, out)


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", s) for s in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
