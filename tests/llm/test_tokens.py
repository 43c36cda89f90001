"""Tokenizers, counts and token files against the public libraries and plain readings."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cohortlens.llm import byte_bpe, token_counts, wavelet  # noqa: E402

ALPHABET = ["a", "B", " ", "  ", "\n", "é", "é", "▁", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "\t", "İ", "Σ", "th", "ing", "'s", "1", "23", "\x00", "ß", "中", "aaaa", "----", "==", "\r\n", " ", "..", ",.", "ª", "µ", "À", "×", "²"]


def texts(n=1500, seed=0):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(chr(rng.randint(97, 122)) for _ in range(200)) for _ in range(20)]
    return [*out, "", " ", "ab" * 20_000, "é" * 5000]


def test_byte_bpe_equals_library():
    import tiktoken

    bpe = byte_bpe.ByteBPE.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for text in texts():
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_byte_bpe_without_cutting_equals_merging():
    """A whole text as one cut, where the encoder has to step back."""
    bpe = byte_bpe.ByteBPE.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"(?s).+")
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice([" the", "re", "at", "on", "ion", "s", " ", "é", "qx", "zz"]) for _ in range(12))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe._merge_below(text.encode(), len(bpe.vocab))


def test_byte_bpe_query_edges(spark):
    df = spark.createDataFrame([(1, "Hello wörld", 5), (1, "Hello wörld", 5), (None, "x", 6), (2, None, 7), (3, "", 8)], "doc_id bigint, text string, n_tokens int")
    got = byte_bpe.digests(byte_bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[1]["decoded_sha256"] == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert byte_bpe.encode_decode(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_counts_equal_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PieceCounter.load(path)
    for text in texts(seed=1):
        assert counter.count(text) == len(library.encode(text)), text[:60]
    df = spark.createDataFrame([(1, "a " * 5000, "x"), (2, None, "y"), (None, "é", "z")], "doc_id bigint, text string, over_limit string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, path).collect()}
    assert got[1]["over_limit"] and (got[2]["n_tokens"], got[2]["n_bytes"]) == (0, 0) and got[None]["n_bytes"] == 2
    assert token_counts.count_tokens(df.limit(0), path).count() == 0
    again = token_counts.count_tokens(df.unionByName(df), path).groupBy("doc_id", "n_bytes", "n_tokens", "over_limit").count().collect()
    assert all(r["count"] % 2 == 0 for r in again)  # repeated rows are rows each


def test_cuts_do_not_change_merges():
    ranks = {p: i for i, p in enumerate(["▁a", "ab", "▁ab", "▁▁", "bb", "▁abb"])}
    counter = token_counts.PieceCounter(ranks)
    for text in ("abb  abb", "  ab\nab a", "b b  b", "aabbabb"):
        whole = counter._count("▁" + text.replace(" ", "▁"))
        assert counter.count(text) == whole


def test_word_tokenizer_equals_library():
    coder = wavelet.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    all_texts = texts(seed=2)
    for text, code in zip(all_texts, coder.encode_all(all_texts), strict=True):
        assert np.frombuffer(code, coder.kind).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("n,top,bits", [(0, 5, 3), (1, 1, 1), (5000, 40000, 16), (3000, 7, 3), (600_000, 300, 20)])
def test_wavelet_matrix_operations(n, top, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    shard = wavelet.Shard(wavelet.build(ids, bits, [3, None], np.array([0, n // 2, n])))
    assert (shard.tokens() == ids).all() and shard.documents()[0] == [3, None]
    for i in rng.integers(0, n, 20) if n else []:
        token = int(ids[i])
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.access(int(i)) == token and shard.count(token, a, b) == (ids[a:b] == token).sum()
        places = np.flatnonzero(ids == token)
        k = int(rng.integers(0, len(places)))
        assert shard.find(token, k) == places[k] and shard.find(token, len(places)) == -1
    assert shard.count(1 << bits) == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = [(9, "one two", "x"), (2, None, "x"), (5, "", "x"), (None, "three", "x"), (5, "a b c", "x"), (7, "w " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = wavelet.write_and_read(df, path, f"file://{tmp_path}/t", shard_tokens=100).collect()
    coder = wavelet.WordTokenizer(path)
    assert sorted(r["start"] for r in got)[0] == 0 and len(got) == 6
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["tokens"]) // 4
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 2, 5, 5, 7, 9]
    for doc_id, text in ((9, "one two"), (7, "w " * 3000)):
        want = np.array([*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert [zlib.crc32(r["tokens"]) for r in got if r["doc_id"] == doc_id] == [zlib.crc32(want)]
    assert wavelet.write_and_read(df.limit(0), path, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4096, 5000])
def test_ranks_at_the_edges_of_cells_and_blocks(monkeypatch, n):
    import io

    monkeypatch.setattr(wavelet, "BLOCK", 1024)
    ids = np.random.default_rng(n).integers(0, 9, n)
    data = wavelet.build(ids, 4, [1], np.array([0, n]))

    class Reads(io.BytesIO):
        most = 0

        def read(self, size=-1):
            self.most = max(self.most, size)
            return super().read(size)

    file = Reads(data)
    for shard in (wavelet.Shard(data), wavelet.Shard(file)):
        for token in range(16):
            at = np.flatnonzero(ids == token)
            assert [shard.find(token, k) for k in range(len(at) + 1)][: len(at)] == at.tolist() and shard.find(token, len(at)) == -1
            for a in (0, 1, 511, 512, 513, 1024, 1025, n):
                assert shard.count(token, min(a, n)) == (at >= a).sum()
        assert [shard.access(i) for i in range(n)] == ids.tolist()
    assert n < 4096 or file.most < len(data) / 2  # read block by block
