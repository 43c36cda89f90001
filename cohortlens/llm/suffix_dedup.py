"""Suffix-array dedup by distributed prefix doubling (operator 2).

Every byte that a WINDOW-byte string covers which also starts in a document with a smaller doc_id is removed.
Two strings are equal if their suffixes share a rank once the suffixes are sorted by WINDOW bytes. Sorting all
suffixes of a corpus moves many times its size, so suffixes that cannot share a rank are discarded first:

1. Each window has an anchor, the leftmost of its GRAM-byte strings with the least hash. Equal windows have equal
   anchors, about one in (WINDOW - GRAM) / 2 positions is one, and windows whose anchor's string stands in one
   text only are unique. Anchors' hashes are dealt over the cluster, packed; those met in two texts come back.
2. The runs of windows around these anchors are dealt by the anchor's hash, so that all windows that may be
   equal meet in one bucket. There prefix doubling sorts them: ranks of 8 bytes, then pairs of ranks at offsets
   8 and 16 give ranks of 16 and 32 bytes, and the pair at offset WINDOW - 32 the rank of WINDOW bytes. Windows that
   a round leaves unique drop out of the next.
3. A window is marked where a smaller doc_id has its rank; marks go back to their documents.

No bucket grows with a hot string: of runs with equal bytes each task sends the smallest doc_id's only, and
runs of an anchor that stands in more than HOT documents (or HOT / 64 of one task's block) are cut into single
windows, dealt by their own bytes.
Exact copies of a text are found by its digest beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import materialise, read, release

WINDOW, GRAM, HOT = 50, 24, 1000
#: Windows that a mark tells about at most.
MASK = 62
#: Bytes of text that a task packs at once, that numpy looks at at once, and for which there is a bucket.
PACK, PIECE, BUCKET = 8 << 20, 1 << 20, 3 << 20
_A, _B, _C, _M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_LOW48 = np.uint64((1 << 48) - 1)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as an integer."""
    n = max(0, len(data) - 7)
    return np.ndarray((n,), "<u8", data.tobytes() if not data.flags.c_contiguous else data.data, strides=(1,)) if n else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def find_runs(data: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, windows, text (index into starts), hash (48 bits) of the anchor.

    data holds texts end to end; starts has their first bytes and the end. No window crosses a text's end.
    """
    out = []
    ends, at, total = starts[1:], 0, len(data)
    while at < total:  # pieces of window starts; each looks a window further
        upto = min(total, at + PIECE)
        part = data[at : min(total, upto + window - 1)]
        if len(part) >= window:
            w = _words(part)
            n = len(part) - gram + 1
            h = _mixed(w[:n] * _A + w[8 : 8 + n] * _B + w[16 : 16 + n] * _C)
            low, idx, span = h, np.arange(n, dtype=np.int32), 1
            width = window - gram + 1
            while span < width:
                step = min(span, width - span)
                first = low[:-step] <= low[step:]
                idx = np.where(first, idx[:-step], idx[step:])
                low = np.minimum(low[:-step], low[step:])
                span += step
            where = np.arange(at, at + len(idx))
            text = np.searchsorted(ends, where, side="right") if len(starts) > 2 else np.zeros(len(where), np.int64)
            valid = where + window <= ends[text]
            change = np.ones(len(idx), bool)
            change[1:] = (idx[1:] != idx[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(change)
            length = np.diff(np.append(first, len(idx)))
            keep = valid[first]
            first, length = first[keep], length[keep]
            out.append((first + at, length, text[first], h[idx[first]] & _LOW48))
        at = upto
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text_key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class _Block:
    """Texts end to end. Equal texts of a block are looked at once, under their smallest doc_id."""

    def __init__(self):
        self.ids, self.texts, self.size, self.extra = [], [], 0, []

    def add(self, doc_id: int, text: bytes, extra=None) -> None:
        self.ids.append(doc_id)
        self.texts.append(text)
        self.extra.append(extra)
        self.size += len(text)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data, starts, keys."""
        starts = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        return np.frombuffer(b"".join(self.texts), np.uint8), starts, np.array([_text_key(t) for t in self.texts], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], listed: bool = False) -> Iterator[_Block]:
    """Blocks of about PACK bytes from batches of (doc_id, text and, if listed, a list)."""
    block = _Block()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        more = batch.column(2) if listed else None
        for k, doc_id in enumerate(ids):
            block.add(doc_id, texts[k].as_py(), None if more is None else more[k].values.to_numpy(zero_copy_only=False))
            if block.size >= PACK:
                yield block
                block = _Block()
                release()
    if block.ids:
        yield block
    release()


def _packed(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The columns' rows by bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    columns = {k: v[order] for k, v in columns.items()}
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        yield int(bucket[a]), {k: v[a:b] for k, v in columns.items()}


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _few(most: int) -> int:
    """Texts of one block that may have an anchor before it counts as hot."""
    return max(1, most // 64)


_SEEN = "p int, ids binary, keys binary, counts binary, hashes binary, times binary"
_SEEN_ARROW = pa.schema([("p", pa.int32())] + [(k, pa.binary()) for k in ("ids", "keys", "counts", "hashes", "times")])


def _anchors(buckets: int, window: int, gram: int, most: int):
    """Pack each block's anchors by bucket: texts (id, key, anchors), then hash and the texts of the block that have it."""

    few = _few(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            data, starts, keys = block.arrays()
            ids = np.array(block.ids, np.int64)
            order = np.lexsort((ids, keys))
            _, one = np.unique(keys[order], return_index=True)
            lead = np.zeros(len(ids), bool)
            lead[order[one]] = True  # the smallest id of each text
            _, _, text, h = find_runs(data, starts, window, gram)
            h, text = h[lead[text]], text[lead[text]]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[new], text[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            times = np.bincount(group).astype(np.int64) if len(h) else np.zeros(0, np.int64)
            # The first entry of a hash tells its bucket how many texts of the block have it. Where these are more
            # than few, the hash is hot for all; its other entries then go to buckets of their own, and are hot.
            spread = ~first & (times[group] > few)
            bucket = np.where(spread, _mixed(ids[text].view(np.uint64)) % np.uint64(buckets), h % np.uint64(buckets)).astype(np.int64)
            told = np.where(spread, 65_535, np.where(first, np.minimum(times[group], 65_534), 0)).astype("<u2")
            for p, c in _packed(bucket, text=text, h=h, told=told):
                order = np.argsort(c["text"], kind="stable")
                texts, counts = np.unique(c["text"], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32())]
                    + [pa.array([x], pa.binary()) for x in (ids[texts].astype("<i8").tobytes(), keys[texts].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _six(c["h"][order]), c["told"][order].tobytes())],
                    schema=_SEEN_ARROW,
                )

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each value of column p; rows come sorted by it."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["p"] != at and rows:
                yield rows
                rows = []
            at = row["p"]
            rows.append(row)
    if rows:
        yield rows
    release()


def _repeated(most: int):
    """(doc_id, anchor) for the anchors that stand in two different texts; anchor is hash * 2 + hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            yield from _met(rows, most)

    return run


def _met(rows: list[dict], most: int) -> Iterator[pa.RecordBatch]:
    if rows:
        cat = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
        counts = cat("counts", "<u4")
        ids, keys = np.repeat(cat("ids", "<i8"), counts), np.repeat(cat("keys", "<i8"), counts)
        h, told = _from_six(b"".join(r["hashes"] for r in rows)), cat("times", "<u2").astype(np.int64)
        del rows
        sure = told == 65_535
        yield from _pairs(ids[sure], h[sure], sure[sure])
        ids, keys, h, told = ids[~sure], keys[~sure], h[~sure], told[~sure]
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        ids, keys, h, told = ids[order], keys[order], h[order], told[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        texts = np.add.reduceat(told, starts)
        differ = (np.minimum.reduceat(keys, starts) != np.maximum.reduceat(keys, starts)) | (np.maximum.reduceat(told, starts) > 1)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        keep = differ[group]
        yield from _pairs(ids[keep], h[keep], ((texts > most) | (np.maximum.reduceat(told, starts) > _few(most)))[group[keep]])


def _pairs(ids: np.ndarray, h: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    anchors = (h * np.uint64(2) + hot.astype(np.uint64)).view(np.int64)
    for a in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 50_000]), pa.array(anchors[a : a + 50_000])], names=["doc_id", "anchor"])


_RUNS = "p int, ids binary, keys binary, firsts binary, lengths binary, tags binary, bytes binary, masks binary"
_RUNS_ARROW = pa.schema([("p", pa.int32())] + [(k, pa.binary()) for k in ("ids", "keys", "firsts", "lengths", "tags", "bytes", "masks")])


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes first to first + size of each row, end to end."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)
    return data[at]


def _contexts(buckets: int, window: int, gram: int):
    """Pack the runs around repeated anchors by bucket. Rows with masks are marks that are known here, passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, True):
            data, starts, keys = block.arrays()
            ids = np.array(block.ids, np.int64)
            anchors = np.unique(np.concatenate(block.extra).astype(np.int64)).view(np.uint64)
            known, hot = anchors >> np.uint64(1), anchors[anchors & np.uint64(1) == 1] >> np.uint64(1)
            first, length, text, h = find_runs(data, starts, window, gram)
            keep = np.isin(h, known)
            first, length, text, h = first[keep], length[keep], text[keep], h[keep]
            cut = np.isin(h, hot)
            if cut.any():
                size = length[cut]
                singles = _gather(np.arange(len(data)), first[cut], size)
                owner = np.repeat(text[cut], size)
                w = _words(data)
                own = np.zeros(len(singles), np.uint64)
                for k in (*range(0, window - 7, 8), window - 8):
                    own = _mixed(own * _A + w[singles + k])
                first, length = np.concatenate([first[~cut], singles]), np.concatenate([length[~cut], np.ones(len(singles), np.int64)])
                text, h = np.concatenate([text[~cut], owner]), np.concatenate([h[~cut], own & _LOW48])
            # Of equal runs the smallest doc_id's stands for the block; larger ones are marked at once.
            order, later = _fold(data, first, length + window - 1, ids[text])
            first, length, text, h = first[order], length[order], text[order], h[order]
            own, place, mask = _masks(np.repeat(text[later], length[later]), _gather(np.arange(len(data)), first[later], length[later]) - np.repeat(starts[text[later]], length[later]))
            spread = (_mixed(ids[own].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for p, c in _packed(spread, own=own, place=place, mask=mask):
                yield _row(_RUNS_ARROW, p, ids=ids[c["own"]], keys=keys[c["own"]], firsts=c["place"], masks=c["mask"])
            first, length, text, h = first[~later], length[~later], text[~later], h[~later]
            for p, c in _packed((h % np.uint64(buckets)).astype(np.int64), first=first, length=length, text=text, h=h):
                t = c["text"]
                yield _row(
                    _RUNS_ARROW, p, ids=ids[t], keys=keys[t], firsts=c["first"] - starts[t], lengths=c["length"].astype("u1"), tags=(c["h"] >> np.uint64(16)).astype("<u4"), bytes=_gather(data, c["first"], c["length"] + window - 1)
                )

    return run


def _row(schema: pa.Schema, p: int, **columns: np.ndarray) -> pa.RecordBatch:
    """One row of packed columns; those not given are empty."""
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32())] + [pa.array([columns[n].tobytes() if n in columns else b""], pa.binary()) for n in schema.names[1:]], schema=schema)


def _masks(text: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts as (text, first, mask): bit k of a mask is the window first + k; first is a multiple of MASK."""
    code = text.astype(np.int64) << 40 | window // MASK
    order = np.argsort(code, kind="stable")
    code, bits = code[order], np.int64(1) << (window[order] % MASK)
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    mask = np.bitwise_or.reduceat(bits, starts) if len(code) else np.zeros(0, np.int64)
    return code[starts] >> 40, (code[starts] & ((1 << 40) - 1)) * MASK, mask


def _fold(data: np.ndarray, first: np.ndarray, width: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs in which equal ones are neighbours, and which of them a smaller id has too."""
    tag = _fingerprints(data, first, width)
    order = np.lexsort((ids, tag))
    first, width, ids, tag = first[order], width[order], ids[order], tag[order]
    new = np.ones(len(tag), bool)
    new[1:] = tag[1:] != tag[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(tag)), 0)) if len(tag) else np.zeros(0, np.int64)
    later = (ids > ids[lead]) & (width == width[lead])
    rows = np.flatnonzero(later)
    for k in range(0, len(rows), 20_000):
        r = rows[k : k + 20_000]
        later[r[~_equal(data, first[r], first[lead[r]], width[r])]] = False
    return order, later


def _fingerprints(data: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes: of its first and last WINDOW bytes, which overlap or meet, and its width."""
    w = _words(data)
    out = width.astype(np.uint64)
    least = int(width.min()) if len(width) else 0
    for k in range(0, least - 7, 8):
        out = _mixed(out * _A + w[first + k])
    for k in range(8, least + 1, 8):
        out = _mixed(out * _A + w[first + width - k])
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Whether the bytes a to a + width and b to b + width are equal, row by row."""
    differ = _gather(data, a, width) != _gather(data, b, width)
    ends = np.cumsum(width)
    return np.add.reduceat(differ, ends - width, dtype=np.int64) == 0


def _rank(*parts: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of one or two columns, by sorting them; two columns are ranks below 2**32."""
    keys = parts[0] if len(parts) == 1 else parts[0] << np.uint64(32) | parts[1]
    order = np.argsort(keys)
    sorted_ = keys[order]
    rank = np.zeros(len(keys), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]])).astype(np.uint64) if len(keys) else 0
    return rank


def window_ranks(data: np.ndarray, positions: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Prefix doubling: the positions whose first window bytes are not unique, and equal ranks for equal bytes.

    Ranks of 8 bytes come first; a round sorts pairs (rank at i, rank at i + offset) and so doubles the length
    until the last pair overlaps up to window. Positions that a round leaves unique are dropped.
    """
    big = _words(data).byteswap()
    length, rank_at = 8, None
    alive = positions
    while True:
        # What the lengths to come will look up: every place that a chain of offsets reaches from here.
        reach = [0]
        steps, k = [], length
        while k < window:
            steps.append(min(k, window - k))
            k += steps[-1]
        for step in reversed(steps):
            reach = sorted({*reach, *(r + step for r in reach)})
        wanted = np.zeros(len(data), bool)
        for r in reach:
            wanted[alive + r] = True
        needed = np.flatnonzero(wanted)
        if length == 8:
            rank = _rank(big[needed])
        else:
            rank = _rank(rank_at[needed], rank_at[needed + offset])
        if rank_at is None:
            rank_at = np.zeros(len(data), np.uint64)
        rank_at[needed] = rank
        own = rank_at[alive]
        alive = alive[np.bincount(own.astype(np.int64))[own.astype(np.int64)] > 1] if len(alive) else alive
        if length == window or not len(alive):
            return alive, rank_at[alive]
        offset = min(length, window - length)
        length += offset


def _marks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            done, rows = [r for r in rows if r["masks"]], [r for r in rows if not r["masks"]]
            cat = lambda k, kind, of: np.frombuffer(b"".join(r[k] for r in of), kind)
            yield from _mark_rows(*(cat(k, "<i8", done) for k in ("ids", "keys", "firsts", "masks")))
            ids, keys, firsts = (cat(k, "<i8", rows) for k in ("ids", "keys", "firsts"))
            lengths, tags, data = cat("lengths", "u1", rows).astype(np.int64), cat("tags", "<u4", rows), cat("bytes", "u1", rows)
            del rows, done
            if not len(ids):
                continue
            width = lengths + window - 1
            at = np.cumsum(width) - width
            # Runs that are equal as a whole need no ranks, and where an anchor is left with one run nothing is equal to it.
            order, later = _fold(data, at, width, ids)
            ids, keys, firsts, lengths, at, tags = ids[order], keys[order], firsts[order], lengths[order], at[order], tags[order]
            mask = np.where(later, (np.int64(1) << lengths) - 1, 0)
            names, group = np.unique(tags, return_inverse=True)
            rows_left = np.flatnonzero(~later & (np.bincount(group[~later], minlength=len(names))[group] > 1))
            for part in _portions(tags, rows_left):
                own = _gather(np.arange(len(data)), at[part], lengths[part])
                owner = np.repeat(part, lengths[part])
                line = np.argsort(own)
                own, owner = own[line], owner[line]
                alive, rank = window_ranks(data, own, window)
                row = owner[np.searchsorted(own, alive)]
                doc, rank = ids[row], rank.astype(np.int64)
                least = np.full(int(rank.max()) + 1 if len(rank) else 0, np.iinfo(np.int64).max)
                np.minimum.at(least, rank, doc)
                hit = least[rank] < doc
                np.bitwise_or.at(mask, row[hit], np.int64(1) << (alive[hit] - at[row[hit]]))
            some = mask != 0
            yield from _mark_rows(ids[some], keys[some], firsts[some], mask[some])

    return run


def _portions(tags: np.ndarray, rows: np.ndarray, most: int = 20_000) -> Iterator[np.ndarray]:
    """The rows in portions of about most, the rows of one tag together."""
    rows = rows[np.argsort(tags[rows], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], tags[rows][1:] != tags[rows][:-1]])) if len(rows) else np.zeros(0, np.int64)
    start = 0
    for cut in np.append(cuts[1:], len(rows)) if len(rows) else ():
        if cut - start >= most or cut == len(rows):
            yield np.sort(rows[start:cut])
            start = cut


def _mark_rows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000].astype(np.int64)) for c in columns], names=["doc_id", "key", "first", "mask"])


def _cut(window: int):
    """Take the marked bytes out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        for batch in batches:
            step = max(1, int(len(batch) * (4 << 20) / max(1, batch.column(1).nbytes)))
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                texts, marks = part.column(1).cast(pa.binary()), part.column(3)
                out = {n: [] for n in names}
                for k, (doc_id, copy) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    text = texts[k].as_py()
                    removed, spans, kept = 0, 0, text
                    if copy:
                        if len(text) >= window:
                            removed, spans, kept = len(text), 1, b""
                    elif marks[k].is_valid:
                        rows = marks[k].values
                        key, first, mask = (rows.field(n).to_numpy(zero_copy_only=False) for n in ("key", "first", "mask"))
                        own = key == _text_key(text)
                        first, mask = first[own], mask[own]
                        edge = np.zeros(len(text) + 1, np.int64)
                        for bit in range(MASK):
                            hits = first[(mask >> bit) & 1 == 1] + bit
                            np.add.at(edge, hits, 1)
                            np.add.at(edge, hits + window, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed = int(gone.sum())
                        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    for n, v in zip(names, (doc_id, len(text), removed, spans, kept), strict=True):
                        out[n].append(v)
                arrays = [pa.array(out[n], pa.int64() if n != "kept" else pa.binary()) for n in names]
                carried = part.columns[4:]
                yield pa.RecordBatch.from_arrays([*arrays, *carried], names=[*names, *["carried"] * len(carried)])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left) of each row.

    Columns of docs named in carry are handed on in the struct carried.

    A null text is an empty one. A row with a null doc_id takes no part and keeps all its bytes. Rows of the same
    doc_id never count against one another, so repeated rows get equal results. Texts shorter than the window
    keep everything; very long ones are taken whole, cut into pieces that overlap by a window. Other columns are not
    read; an empty table gives an empty result.
    """
    if not 2 * 8 <= gram <= window or gram != 24 or window - gram > 48:
        raise ValueError("windows of 24 to 72 bytes with grams of 24 are supported")
    handed = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    also = ["carried"] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *handed)
    base = rows.where("doc_id is not null")
    texts = base.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("size"))
    digests = materialise(texts, "digests")
    firsts = materialise(digests.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    # By doc_id: the digests of its texts that stand under a smaller doc_id too, and whether these are all it has.
    known = digests.join(firsts, "sha", "left").withColumn("later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    copies = materialise(known.groupBy("doc_id").agg(F.collect_set(F.when(F.col("later"), F.col("sha"))).alias("shas"), F.min("later").alias("all")).where(F.size("shas") > 0), "copies")
    total = digests.agg(F.sum("size")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, int(total / BUCKET))

    packed = base.mapInArrow(_anchors(buckets, window, gram, hot), _SEEN)
    repeated = packed.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_repeated(hot), "doc_id bigint, anchor bigint")
    lists = materialise(repeated.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    wanted = lists.join(copies.where("all"), "doc_id", "left_anti")
    runs = base.join(wanted, "doc_id").select("doc_id", "text", "anchors", *also).mapInArrow(_contexts(buckets, window, gram), _RUNS)
    marks = runs.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_marks(window), "doc_id bigint, key bigint, first bigint, mask bigint")
    by_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "mask")).alias("marks"))
    joined = base.join(by_doc, "doc_id", "left").join(copies, "doc_id", "left")
    schema = T._parse_datatype_string("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    if carry:
        schema = schema.add(rows.schema["carried"])
    copy = F.coalesce(F.array_contains("shas", F.unhex(F.sha2("text", 256))), F.lit(False))
    done = joined.select("doc_id", "text", copy.alias("copy"), "marks", *also).mapInArrow(_cut(window), schema)
    zero = F.lit(0).cast("long")
    none = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"), *also)
    return done.unionByName(none)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
