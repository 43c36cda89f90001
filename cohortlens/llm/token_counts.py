"""Token counts by heap-and-linked-list byte-pair merging (operator 6).

The text's characters are the first symbols, kept in a doubly linked list. A heap holds the adjacent pairs that
the vocabulary can merge; the pair of the lowest rank, the leftmost of equals, is popped and merged and its new
neighbours are pushed, until the heap is empty. The count is the number of symbols at first minus the merges;
no ids are made. A symbol that is left without a piece of its own counts one token for each UTF-8 byte.

No piece of the vocabulary holds a space mark behind another character, so a text may be cut before each
run of spaces without changing a merge; the loader checks this. Counts of short cuts are remembered.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.byte_bpe import _Cache
from cohortlens.llm.common import map_texts, read

SPACE = "▁"


class PieceCounter:
    """Counts pieces; ranks maps a piece to its rank, lower ones merge first."""

    def __init__(self, ranks: dict[str, int], dummy_prefix: bool = True):
        self.ranks, self.prefix = ranks, SPACE if dummy_prefix else ""
        inner = any(SPACE in p.lstrip(SPACE) for p in ranks)
        lines = any("\n" in p for p in ranks)
        cut = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if not lines else rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.cut = (lambda text: [text]) if inner else re.compile(cut).findall
        self.cache = _Cache(self._count)

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank, last, out = -1, None, {}
        for i in order:
            if sp.get_score(i) != last:
                rank, last = rank + 1, sp.get_score(i)
            out[sp.id_to_piece(i)] = rank
        return cls(out)

    def count(self, text: str) -> int:
        if not text:
            return 0
        self.cache.room()
        return sum(map(self.cache.__getitem__, self.cut(self.prefix + text.replace(" ", SPACE))))

    def _count(self, text: str) -> int:
        ranks = self.ranks
        symbols = list(text)
        n = len(symbols)
        heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := symbols[i] + symbols[i + 1])) is not None]
        merges = 0
        if heap:
            heapify(heap)
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            while heap:
                _, i, piece = heappop(heap)
                j = after[i]
                if symbols[i] is None or j < 0 or len(symbols[i]) + len(symbols[j]) != len(piece) or symbols[i] + symbols[j] != piece:
                    continue  # one of the two has been merged meanwhile
                symbols[i], symbols[j] = piece, None
                merges += 1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := ranks.get(p := piece + symbols[k])) is not None:
                        heappush(heap, (r, i, p))
                h = before[i]
                if h >= 0 and (r := ranks.get(p := symbols[h] + piece)) is not None:
                    heappush(heap, (r, h, p))
        return n - merges + sum(len(s.encode("utf-8")) - 1 for s in symbols if s is not None and len(s) == 1 and s not in ranks)


_LOADED: dict[str, PieceCounter] = {}


def _loaded(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter.load(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    No begin, end or special tokens are added and special strings are ordinary text. A null or empty text
    counts 0; a very long one is counted whole, part by part where no merge crosses; a null doc_id stays null; repeated rows give
    repeated rows; other columns are not read; an
    empty table gives an empty one. Nothing is shuffled and nothing but counts leaves the workers.
    """

    def run(ids, texts):
        counter = _loaded(path)
        return {"doc_id": ids, "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": [counter.count(t) for t in texts]}

    return map_texts(docs, run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
