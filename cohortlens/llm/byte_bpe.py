"""Byte-level BPE encoding and decoding (operator 5).

A text is cut by the tokenizer's pattern. Each cut's UTF-8 bytes, mapped one to one to Latin-1 characters, are
run through an Aho-Corasick automaton of the whole vocabulary, which lists for every position the tokens that
start there. The encoder takes the longest one that is compatible with the token before it, falls back to
shorter ones, and steps back where none fits. A position at which no continuation exists is noted and never
tried again, so the work is linear in the bytes. Two adjacent tokens are compatible if merging their
concatenation by rank gives just these two; that test undoes merges from the seam outwards and is memoised.
The result is exactly that of merging by rank.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import map_texts, read

CACHE_ENTRIES = 400_000


class ByteBPE:
    """Encoder and decoder for a rank file; pattern cuts a text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.cut = regex.compile(pattern).findall
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.vocab))]
        for i, token in enumerate(self.vocab):
            if len(token) > 1:
                parts = self._merge_below(token, i)
                if len(parts) == 2:
                    self.pairs[parts[0], parts[1]] = i
                    self.halves[i] = (parts[0], parts[1])
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache = _Cache(self._encode_cut)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """The symbols left when only merges of a rank under limit take place."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[k] + parts[k + 1], limit), k) for k in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves tokens a and b side by side as they are.

        The last merge on either side of the seam is undone, the later one first. At each state a merge across
        the seam that would have come before the merge just undone rules the pair out.
        """
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(a, b)
            if len(self.fits) > CACHE_ENTRIES:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit, pairs, halves = len(self.vocab), self.pairs, self.halves
        while True:
            across = pairs.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = halves[a][1], halves[b][0]
            # Merges happen by rank and, at equal rank, from the left: the right token's merge at the rank of
            # the seam is later than the seam's, the left token's earlier.
            if right == b or (left != a and a > b):
                if left == a:
                    return True
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def _encode_cut(self, cut: str) -> bytes:
        data = cut.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return whole.to_bytes(4, "little")
        starts: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, found in self.automaton.iter(data.decode("latin-1")):
            starts[end + 1 - found[1]].append(found)  # shorter ones first
        n, at, tokens, tries, dead = len(data), 0, [], [len(starts[0])], set()
        while at < n:
            options, k = starts[at], tries[-1] - 1
            while k >= 0:
                token, length = options[k]
                if at + length not in dead and (not tokens or self.compatible(tokens[-1][0], token)):
                    break
                k -= 1
            if k >= 0:
                tries[-1] = k
                tokens.append((token, length))
                at += length
                tries.append(len(starts[at]) if at < n else 0)
            else:
                # The token before this position is the one merging would leave here, so no other way through it exists.
                dead.add(at)
                tries.pop()
                if not tokens:
                    raise ValueError("a byte is missing in the vocabulary")
                at -= tokens.pop()[1]
        return np.array([t for t, _ in tokens], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        cuts = self.cut(text)
        self.cache.room()
        return b"".join(map(self.cache.__getitem__, cuts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Cache(dict):
    """Results by cut, emptied between texts once it is full."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        out = self.fn(key)
        if len(key) < 64:
            self[key] = out
        return out

    def room(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()


_LOADED: dict = {}


def _loaded(path: str, pattern: str) -> ByteBPE:
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE.load(path, pattern)
    return _LOADED[key]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each row's whole text: doc_id, ids, decoded.

    ids (binary) holds the token ids as little-endian unsigned 32-bit integers, decoded (binary) the bytes
    that decoding these ids gives. Special strings are ordinary text. A very long text is encoded whole, match by
    match, in time linear in its length, and is held with its ids in one task's memory. A null or empty text gives empty
    binaries; a null doc_id stays null; repeated rows give repeated rows; other columns of docs are not
    read; an empty table gives an empty one. Each row stands alone, so nothing is shuffled.
    """

    def run(ids, texts):
        bpe = _loaded(path, pattern)
        codes = [bpe.encode(t) for t in texts]
        return {"doc_id": ids, "ids": codes, "decoded": [bpe.decode(c) for c in codes]}

    return map_texts(docs, run, "doc_id bigint, ids binary, decoded binary")


def digests(coded: DataFrame, *also: str) -> DataFrame:
    """The contract's columns, and those named, from what encode_decode() returns."""
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *also,
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
