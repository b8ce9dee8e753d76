"""Ids of a byte-level BPE vocabulary, exactly as the tokenizers library gives them, but faster."""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The pattern that splits text before the merges, as byte-level BPE defines it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Scripts whose character classes have been the same for many versions of Unicode.
UNUSUAL = re.compile("[^\x00-ɏͰ-ϿЀ-ӿ‐-‧€]")
LONG_PIECE = re.compile(r"\S{4096}|\s{4096}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """One per task. Texts in common scripts go through tiktoken, all others through tokenizers.

    Special tokens written out in a text are recognised, as tokenizers does by default; texts that
    hold one, or very long runs without a break, also go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        with open(path, encoding="utf-8") as f:
            self.file = f.read()
        spec = json.loads(self.file)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if self.special.search(text) or UNUSUAL.search(text) or LONG_PIECE.search(text):
            return self.encode_slow(text)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)

    def encode_slow(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.file)
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
