"""Byte-level BPE over whole texts, by cached pieces between single spaces."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import tiktoken

#: Where the public vocabulary files lie; a parameter of every operator that reads one.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that the vocabulary was made with: fixed, as token ids depend on it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

class BytePieces:
    """Token ids of texts as little-endian uint16 bytes.

    A piece of the pattern holds a space only in front, or as part of a run of white space; so a text in which no
    other white space stands beside a space may be cut before each space, and the parts, which recur, are encoded
    once and kept. New parts of a text are encoded in one call, behind one another, and told apart by the
    bytes of their tokens. Other texts are encoded whole.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.eos = len(ranks)
        self._bytes = np.zeros(len(ranks), np.int64)
        self._bytes[list(ranks.values())] = list(map(len, ranks))
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._keep, self._parts = keep, {}

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts, kept while there is room: what recurs often is met early."""
        ids = np.array(self._encode(" " + " ".join(parts)), "<u2")
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
        cuts = np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1
        raw, at, own = ids.tobytes(), 0, {}
        for p, c in zip(parts, (2 * cuts).tolist()):
            own[p] = raw[at:c]
            at = c
        if len(self._parts) + len(own) <= self._keep:
            self._parts.update(own)
            return self._parts
        return own

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        known = self._parts
        new = set(rest).difference(known)
        if not first or first != first.rstrip() or not all(p and p == p.strip() for p in new):
            return np.array(self._encode(text), "<u2").tobytes()
        own = self._learn(list(new)) if new else known
        ids = map(known.__getitem__, rest) if own is known else [known[p] if p in known else own[p] for p in rest]
        return np.array(self._encode(first), "<u2").tobytes() + b"".join(ids)


@functools.lru_cache(maxsize=2)
def byte_pieces(path: str) -> BytePieces:
    """One for each worker, whose later tasks find the parts that earlier ones met."""
    return BytePieces(path)
