"""Token counts and per-token sums with a public byte-level BPE, exact and quick on repetitive text."""

from __future__ import annotations

import base64
import os

import numpy as np

DEFAULT = os.environ.get("LEDGERLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public vocabulary's split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Chunks(dict):
    """Numbers of the pieces between single spaces; a new piece is encoded once.

    Before a space that follows a non-blank the split pattern always ends a word, so counts
    of such pieces add up to the text's. Others are encoded whole.
    """

    LIMIT = 500_000

    def __init__(self, path: str = DEFAULT, weights: np.ndarray | None = None) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = max(ranks.values()) + 1
        self.weights = weights
        self.n = np.zeros(1024, dtype=np.int64)
        self.sums = np.zeros((1024, weights.shape[1] if weights is not None else 0))

    def __missing__(self, piece: str) -> int:
        k = len(self)
        if k == len(self.n):
            self.n = np.concatenate([self.n, np.zeros(k, np.int64)])
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        ids = self.encoding.encode_ordinary(piece)
        self.n[k] = len(ids)
        if self.weights is not None:
            self.sums[k] = self.weights[ids].sum(axis=0)
        self[piece] = k
        return k

    def measure(self, text: str) -> tuple[int, np.ndarray]:
        """(tokens, sum of the weights of all tokens) of a text."""
        if len(self) > self.LIMIT:
            self.clear()
        if "  " in text or "\n " in text or not text.isprintable() and _odd_blank(text):
            ids = self.encoding.encode_ordinary(text)
            return len(ids), self.weights[ids].sum(axis=0) if self.weights is not None else self.sums[0]
        head, *rest = text.split(" ")
        k = [self[head], *map(self.__getitem__, [" " + p for p in rest])]
        return int(self.n[k].sum()), self.sums[k].sum(axis=0)


def _odd_blank(text: str) -> bool:
    """Whether some blank other than a space or newline stands before a space."""
    return any(p[-1].isspace() and p[-1] != "\n" for p in text.split(" ") if p)
