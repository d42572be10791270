"""Byte-level BPE from a public vocabulary file, encoded by the tiktoken library inside tasks.

The library takes ranks instead of merges; both agree where the ids of the merges ascend, which is checked. On the test
tables and in the surroundings of every code point the ids equal those of the tokenizers library, at a fifth of its time.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np

from millrace.llm.bpe import _byte_signs, vocabulary_path

#: Fixed value: how byte-level vocabularies of this kind split text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_vocabulary_path() -> str:
    return vocabulary_path("byte_bpe_50k.json")


class ByteBpe:
    """The vocabulary of a JSON text. Special tokens are ids only where encode() is asked for them."""

    def __init__(self, text: str):
        found = json.loads(text)
        code = {sign: b for b, sign in enumerate(_byte_signs())}
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        vocab = {w: i for w, i in found["model"]["vocab"].items() if w not in self.special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in found["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("merges are not in the order of their ids")
        self.ranks = {bytes(code[c] for c in w): i for w, i in vocab.items()}
        self.size = max([*self.ranks.values(), *self.special.values()]) + 1

    @cached_property
    def _encoding(self):
        import tiktoken

        return tiktoken.Encoding("millrace", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens=self.special)

    def encode(self, text: str, special: bool = False) -> np.ndarray:
        """The ids of a text; special: a special token's string is its id, else it is plain text."""
        return self._encoding.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())

    @cached_property
    def token_bytes(self) -> list[bytes]:
        out = [b""] * self.size
        for w, i in [*self.ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            out[i] = w
        return out


_BUILT: dict[str, ByteBpe] = {}


def byte_bpe(text: str) -> ByteBpe:
    """This worker's vocabulary."""
    if text not in _BUILT:
        _BUILT.clear()
        _BUILT[text] = ByteBpe(text)
    return _BUILT[text]
