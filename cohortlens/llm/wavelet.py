"""Token-id files as wavelet matrices (operator 3).

A shard's token ids become bit planes, most significant bit first. Each plane holds one bit for every token,
in an order that the planes above it fix: tokens with a 0 keep their order and come first, those with a 1
follow. Reading one token, counting a token in a range and finding its k-th occurrence then take one rank or
select on each plane, whatever the shard's size.

File layout: magic, header length (u32), zstd-compressed JSON header, then the planes' blocks. A plane is cut
into blocks of BLOCK bits, compressed one by one; the header holds each block's place and the ones before it, and a
block begins with the ones before each of its cells of CELL bits (u32). So a query reads and unpacks one block a plane,
a rank counts the bits of one cell and a select searches the counts and then one cell. The documents' ids and starts
are further blocks of the same file.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import _block, read, shared_dir

MAGIC, BLOCK, CELL = b"WVMX2\n", 1 << 18, 512
SHARD_TOKENS = 4 << 20
#: Cuts remembered; a worker's memory for them is about 200 bytes each.
CACHE_ENTRIES = 1_000_000
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def build(ids: np.ndarray, bits: int, doc_ids: list, starts: np.ndarray) -> bytes:
    """A shard's file: ids are its tokens, starts the first token of each document and the end."""
    body, at, planes = [], 0, []
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        packed = _PACK.compress(data)
        body.append(packed)
        at += len(packed)
        return at - len(packed), len(packed)

    for level in range(bits - 1, -1, -1):
        ones = (x >> level) & 1 != 0
        packed = np.packbits(ones)
        cells = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), CELL // 8), dtype=np.uint32) if len(ones) else np.zeros(0, np.uint32)
        before = [np.concatenate([[0], np.cumsum(cells[k : k + BLOCK // CELL])]).astype("<u4") for k in range(0, len(cells), BLOCK // CELL)]
        counts = np.array([b[-1] for b in before], np.int64)
        planes.append({
            "zeros": int(len(ones) - counts.sum()),
            "rank": np.concatenate([[0], np.cumsum(counts)]).tolist(),
            "blocks": [put(b[:-1].tobytes() + packed[k : k + BLOCK // 8].tobytes()) for b, k in zip(before, range(0, len(packed), BLOCK // 8), strict=True)],
        })
        x = np.concatenate([x[~ones], x[ones]])
    known = np.array([d is not None for d in doc_ids], bool)
    docs = put(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    header = {"n": len(ids), "bits": bits, "docs": len(doc_ids), "ids": docs, "null": put(np.packbits(~known).tobytes()), "starts": put(starts.astype("<i8").tobytes()), "planes": planes}
    head = _PACK.compress(json.dumps(header).encode())
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


class Shard:
    """Reads one file: bytes, or an open file that can seek. Of a file only the header and the blocks asked for are read."""

    def __init__(self, source):
        self.source = source
        start = self._read(0, len(MAGIC) + 4)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack("<I", start[len(MAGIC) :])[0]
        self.body = len(MAGIC) + 4 + size
        self.head = json.loads(_UNPACK.decompress(self._read(len(MAGIC) + 4, size)))
        self.n, self.bits, self.planes = self.head["n"], self.head["bits"], self.head["planes"]
        self.kept: dict[tuple[int, int], tuple[np.ndarray, bytes]] = {}

    def _read(self, at: int, size: int) -> bytes:
        if isinstance(self.source, bytes):
            return self.source[at : at + size]
        self.source.seek(at)
        return self.source.read(size)

    def _get(self, place: list[int]) -> bytes:
        return _UNPACK.decompress(self._read(self.body + place[0], place[1]))

    def documents(self) -> tuple[list, np.ndarray]:
        """The document ids, null included, and where each starts, with the end."""
        n = self.head["docs"]
        null = np.unpackbits(np.frombuffer(self._get(self.head["null"]), np.uint8), count=n) if n else []
        ids = np.frombuffer(self._get(self.head["ids"]), "<i8").tolist()
        return [None if gone else d for d, gone in zip(ids, null, strict=True)], np.frombuffer(self._get(self.head["starts"]), "<i8")

    def _counts(self, block: int) -> int:
        """Bytes of a block's counts of cells."""
        return 4 * -(-min(BLOCK, self.n - block * BLOCK) // CELL)

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, bytes]:
        """The ones before each cell of a block, and its bits."""
        if (plane, block) not in self.kept:
            if len(self.kept) > 256:
                self.kept.clear()
            raw, cut = self._get(self.planes[plane]["blocks"][block]), self._counts(block)
            self.kept[plane, block] = np.frombuffer(raw[:cut], "<u4"), raw[cut:]
        return self.kept[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, BLOCK)
        out = self.planes[plane]["rank"][block]
        if rest:
            cells, data = self._block(plane, block)
            cell, bits = divmod(rest, CELL)
            if bits == 0 and cell == len(cells):  # the end of a plane
                cell, bits = cell - 1, CELL
            start, whole = cell * CELL // 8, -(-bits // 8)
            out += int(cells[cell]) + (int.from_bytes(data[start : start + whole], "big") >> (8 * whole - bits)).bit_count()
        return out

    def _bit(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return self._block(plane, block)[1][rest >> 3] >> (7 - (rest & 7)) & 1

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The position of a plane's k-th (from 0) bit of that value."""
        ranks = np.asarray(self.planes[plane]["rank"])
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before[:-1], k, side="right")) - 1
        k -= int(before[block])
        cells, data = self._block(plane, block)
        inside = cells.astype(np.int64) if bit else np.arange(len(cells)) * CELL - cells.astype(np.int64)
        cell = int(np.searchsorted(inside, k, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(data[cell * CELL // 8 : (cell + 1) * CELL // 8], np.uint8))
        return block * BLOCK + cell * CELL + int(np.flatnonzero(bits == bit)[k - int(inside[cell])])

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            ones = self._rank1(p, i)
            i = self.planes[p]["zeros"] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p in range(self.bits):
            a, b = self._rank1(p, start), self._rank1(p, end)
            bit = token >> (self.bits - 1 - p) & 1
            start, end = (self.planes[p]["zeros"] + a, self.planes[p]["zeros"] + b) if bit else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often token stands in positions start to end (excluded)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def find(self, token: int, k: int) -> int:
        """The position of the token's k-th occurrence (from 0), or -1."""
        if token >> self.bits:
            return -1
        at, end = self._range(token, 0, self.n)
        at += k
        if at >= end:
            return -1
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self._select(p, bit, at - self.planes[p]["zeros"] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in their order: the planes undone from the last one up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            raw = np.frombuffer(b"".join(self._get(place)[self._counts(k) :] for k, place in enumerate(self.planes[p]["blocks"])), np.uint8)
            ones = np.unpackbits(raw, count=self.n).view(bool)
            up, zeros = np.empty_like(out), self.planes[p]["zeros"]
            up[~ones] = out[:zeros]
            up[ones] = out[zeros:] | kind(1 << (self.bits - 1 - p))
            out = up
        return out


#: For Latin-1 bytes: lower case as the tokenizer's, and kinds: letter or digit (a), blank, stop or comma (.), other (#).
_LOWER = bytes(ord(x) if len(x := chr(i).lower()) == 1 and ord(x) < 256 else i for i in range(256))
_KINDS = bytes(46 if i in b".," else 97 if chr(i).isalnum() else 32 if chr(i) in " \t\n\v\f\r\x85\xa0" else 35 for i in range(256))


def _byte_letters() -> list[str]:
    """The printable letter that a byte-level model has for each byte: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for i in range(256):
        out.append(chr(i if i in printable else free))
        free += i not in printable
    return out


class WordTokenizer:
    """Ids of texts by the tokenizers library.

    The tokenizer drops white space, lower-cases, and none of its steps looks across a blank, a line feed, or
    the place before a full stop or comma that follows a letter or digit. So texts are cut there and each
    different cut is encoded once while it is remembered. A Latin-1 text without the mark of special tokens is
    lower-cased first, which leaves fewer different cuts and the same ids; of such texts a cut that is all
    letters is one word to the library's model, which then gets it directly.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.bits = max(1, (max(self.tokenizer.get_vocab().values())).bit_length())
        self.kind = "H" if self.bits <= 16 else "I"
        self.letters = _byte_letters()
        self.cache: dict[str | bytes, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned integers of kind."""
        cuts: list[str | bytes] = []
        ends = [0]
        for text in texts:
            cuts += self._cuts(text)
            ends.append(len(cuts))
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        codes = list(map(self.cache.get, cuts))
        unknown = [i for i, code in enumerate(codes) if code is None]
        for i in unknown:
            cut = cuts[i]
            if cut not in self.cache:
                self.cache[cut] = array(self.kind, self._ids(cut)).tobytes()
            codes[i] = self.cache[cut]
        return [b"".join(codes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _ids(self, cut: str | bytes) -> list[int]:
        if isinstance(cut, bytes):
            cut = cut.decode("latin-1")
            if cut.isalpha():
                word = cut if cut.isascii() else "".join(self.letters[b] for b in cut.encode("utf-8"))
                return [t.id for t in self.model.tokenize(word)]
        return self.tokenizer.encode(cut, add_special_tokens=False).ids

    @staticmethod
    def _cuts(text: str) -> list[str] | list[bytes]:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if b"<|" in data:
            return text.replace("\n", " ").split(" ")
        data = data.translate(_LOWER)
        kinds = data.translate(_KINDS)
        data = data.replace(b"\n", b" ")
        if b"#." not in kinds and b".." not in kinds:  # else a stop may be part of a longer run of marks
            data = data.replace(b".", b" .").replace(b",", b" ,")
        return data.split(b" ")


_LOADED: dict[str, WordTokenizer] = {}


def _loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs and write shard files into folder; returns the files: part, piece, file, n_docs, n_tokens.

    Documents are dealt by ranges of doc_id and sorted, so files in the order of (part, piece) hold them in
    ascending doc_id order, null first; equal ids stand side by side. A file is cut once it holds shard_tokens,
    between documents. Files are written under another name and then moved, so a task that runs twice leaves
    one whole file.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, piece = task.partitionId(), 0
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        coder = _loaded(path)
        end = array(coder.kind, [end_id]).tobytes()
        ids, codes, held = [], [], 0
        rows = {"part": [], "piece": [], "file": [], "n_docs": [], "n_tokens": []}

        def flush():
            nonlocal ids, codes, held, piece
            starts = np.concatenate([[0], np.cumsum([len(c) // len(end) for c in codes])])
            tokens = np.frombuffer(b"".join(codes), coder.kind)
            bits = max(coder.bits, end_id.bit_length())
            name = f"{root}/shard-{part:08d}-{piece:06d}.wvm"
            with files.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(build(tokens, bits, ids, starts))
            files.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            for key, v in zip(rows, (part, piece, name, len(ids), len(tokens)), strict=True):
                rows[key].append(v)
            piece += 1
            ids, codes, held = [], [], 0

        for batch in batches:
            at = 0
            while at < len(batch):
                block = batch.slice(at, _block(batch.column(1), at, 4 << 20, batch.column(1).nbytes / len(batch)))
                at += len(block)
                for doc_id, code in zip(block.column(0).to_pylist(), coder.encode_all(block.column(1).to_pylist()), strict=True):
                    codes.append(code + end)
                    ids.append(doc_id)
                    held += len(code) // len(end) + 1
                    if held >= shard_tokens:
                        flush()
        if ids:
            flush()
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.mapInArrow(run, "part bigint, piece bigint, file string, n_docs bigint, n_tokens bigint")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (in the file), tokens (little-endian unsigned 32-bit integers) of every document in the files.

    shards needs the column file; its columns first (the tokens of earlier files) and part are passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.binary())])
        files, _ = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(row["file"]) as f:
                    shard = Shard(f)
                    ids, starts = shard.documents()
                    tokens = shard.tokens()
                for a in range(0, len(ids), 1000):
                    cuts = starts[a : a + 1001].tolist()
                    data = [tokens[i:j].astype("<u4").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1000], pa.int64()), pa.array([row["first"] + c for c in cuts[: len(data)]], pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return shards.select("file", "first").mapInArrow(run, "doc_id bigint, start bigint, tokens binary")


def write_and_read(docs: DataFrame, path: str, folder: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs as token-id files into folder and read them back: doc_id, start, tokens.

    start counts the tokens of all documents before, in ascending doc_id order (null first, equal ids in any
    order). Every document ends with end_id; a null or empty text is that id alone; a very long one makes its file as
    long as it needs. Columns other than doc_id and text are not read. Repeated rows are stored as often as they stand. An empty table makes no file and gives an empty result. The list of files, one row
    for each shard_tokens tokens or task, is written beside them; only it is ordered as a whole.
    """
    spark = docs.sparkSession
    manifest = f"{folder}/manifest"
    write_shards(docs, path, folder, end_id, shard_tokens).write.parquet(manifest)
    files = spark.read.schema("part bigint, piece bigint, file string, n_docs bigint, n_tokens bigint").parquet(manifest)
    earlier = F.sum("n_tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("first", F.coalesce(earlier, F.lit(0)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_shards(placed.repartition(parts, "file"), folder)


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = write_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "tokens"))
    return out.select("doc_id", "start", (F.length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))
