"""Quality rules by line sequence labelling (operator 1).

A linear-chain conditional random field labels each line of a text as content or boilerplate: a line's features
give scores for both labels, and weights between neighbouring labels let one line's label speak for the next.
Viterbi decoding finds the best label sequence of the text. A document is kept if its base rules hold and
content lines hold at least CONTENT_SHARE of its words.

Only documents have labels, so the labels of lines are hidden. What a document's label says is a constraint: content
holds at least GOOD_SHARE of a good document's words and at most BAD_SHARE of a bad one's. First a line model is
fitted to tell lines of good documents from those of bad ones; lines that both have, such as prose within a bad
document, come out as content, as good documents have more of them. These are the first guess of the lines' labels.
Then rounds alternate: the field's own probabilities, moved within each document just as far as its constraint asks,
give the expected labels and label pairs, and the field's weights are fitted to them. So the field sees sequences with
both labels, and learns how one follows the other.

Fitting uses at most MAX_DOCS labelled documents, the first by a hash of doc_id among those outside the hold-out, and
all their lines; long documents are sequences of SEGMENT lines that share one constraint.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import map_texts, materialise, read
from cohortlens.llm.textstats import DIGITS, MARKS, STOPS, SYMBOLS, UPPER, base_counts, having, split

#: The fit's bounds on labelled documents and on their lines in all; they say how much is learned from, not what is
#: decoded. SEGMENT cuts no line off.
MAX_DOCS, MAX_LINES, SEGMENT = 3000, 500_000, 16
CONTENT_SHARE, GOOD_SHARE, BAD_SHARE = 0.5, 0.9, 0.1
FEATURES = ("bias", "words", "symbols", "marks", "upper", "digits", "stops", "word_length", "duplicate", "distinct", "single_word")


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES and the number of words for each line; lines hold a word each."""
    seen: set[bytes] = set()
    rows, sizes = [], []
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        rows.append((
            1.0, min(n, 40) / 40, min(1.0, 4 * having(line, SYMBOLS) / size), min(1.0, 4 * having(line, MARKS) / size), having(line, UPPER) / size, having(line, DIGITS) / size,
            min(1.0, 4 * having(line, STOPS) / size), min(1.0, size / n / 20), line in seen, log(1 + len(set(words))) / log(1 + n), n == 1,
        ))
        seen.add(line)
        sizes.append(n)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class LineCRF:
    """emit: a row of feature weights for each label; move: weights from a label (row) to the next one's."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def plain(cls) -> LineCRF:
        """What is used where there is nothing to learn from: every line is content."""
        emit = np.zeros((2, len(FEATURES)))
        emit[1, 0] = 1.0
        return cls(emit, np.zeros((2, 2)))

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, steps: int = 40, penalty: float = 1e-3) -> LineCRF:
        """documents are their lines' features, their lines' numbers of words, and their label (1: good).

        Documents of both labels count alike. Without documents of both labels the field is plain().
        """
        documents = [d for d in documents if len(d[0])]
        if len({label for _, _, label in documents}) < 2:
            return cls.plain()
        y = np.array([label for _, _, label in documents])
        x = np.concatenate([rows for rows, _, _ in documents])
        words = np.concatenate([sizes for _, sizes, _ in documents]).astype(float)
        doc = np.repeat(np.arange(len(documents)), [len(rows) for rows, _, _ in documents])
        share = words / np.bincount(doc, words)[doc]  # a line's share of its document's words
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        lines = _first_guess(x, y[doc], share * weight[doc])
        grid = _Grid([len(rows) for rows, _, _ in documents])
        each = weight[grid.doc] / np.bincount(doc)[grid.doc]  # a document's lines share its weight
        limit = np.where(y == 1, GOOD_SHARE, BAD_SHARE)
        params = np.zeros(2 * len(FEATURES) + 4)
        for turn in range(rounds):
            if turn:
                scores = x @ params[:-4].reshape(2, -1).T
                move = params[-4:].reshape(2, 2)
            else:  # nothing is known but the guess
                scores, move = np.stack([1 - lines, lines], 1) * 4.0, np.zeros((2, 2))
            want_lines, want_pairs = _constrained(scores, move, grid, doc, share, y, limit)
            params = _fit_to(params, x, grid, each, want_lines, want_pairs, steps, penalty)
        return cls(params[:-4].reshape(2, -1), params[-4:].reshape(2, 2))

    def decode(self, features: np.ndarray) -> list[int]:
        """The best label sequence (1: content); at a tie, content."""
        if not len(features):
            return []
        scores = (features @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        bad, good = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            to_bad, to_good = bad + m00 > good + m10, bad + m01 > good + m11
            back.append((0 if to_bad else 1, 0 if to_good else 1))
            bad, good = (bad + m00 if to_bad else good + m10) + e0, (bad + m01 if to_good else good + m11) + e1
        out = [0 if bad > good else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


class _Grid:
    """Lines of documents, one below the other, as sequences of SEGMENT lines at most: places in a grid."""

    def __init__(self, lengths: list[int]):
        counts = [-(-n // SEGMENT) for n in lengths]
        self.doc = np.repeat(np.arange(len(lengths)), counts)  # of each sequence
        sizes = np.array([min(SEGMENT, n - k * SEGMENT) for n, c in zip(lengths, counts, strict=True) for k in range(c)])
        self.real = np.arange(int(sizes.max())) < sizes[:, None]

    def lay(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((*self.real.shape, *rows.shape[1:]))
        out[self.real] = rows
        return out


def _first_guess(x: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 200) -> np.ndarray:
    """1 for lines that a logistic model of single lines, fitted to their documents' labels, takes for content."""
    mean, scale = np.average(x, 0, weight), np.sqrt(np.average((x - np.average(x, 0, weight)) ** 2, 0, weight)) + 1e-9
    z = (x - mean) / scale
    z[:, 0] = 1.0
    w, first, second = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        grad = z.T @ ((1 / (1 + np.exp(-z @ w)) - label) * weight) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return (z @ w >= 0).astype(float)


def _constrained(scores, move, grid: _Grid, doc, share, y, limit) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of lines and label pairs of sequences, where each document's constraint holds.

    A document whose expected share of content words breaks its limit has its lines' content scores moved by one
    number, the least that meets the limit, found by halving.
    """

    def expect(shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        moved = scores.copy()
        moved[:, 1] += shift[doc]
        lines, pairs = _marginals(grid.lay(moved), move, grid.real)
        lines = lines[grid.real]
        return lines, pairs, np.bincount(doc, lines[:, 1] * share, len(y))

    sign = np.where(y == 1, 1.0, -1.0)
    lines, pairs, content = expect(np.zeros(len(y)))
    broken = sign * content < sign * limit
    if not broken.any():
        return lines, pairs
    low, high = np.zeros(len(y)), np.where(broken, 40.0, 0.0)
    for _ in range(14):
        mid = (low + high) / 2
        met = sign * expect(sign * mid)[2] >= sign * limit
        low, high = np.where(met, low, mid), np.where(met, mid, high)
    return expect(sign * high)[:2]


def _fit_to(params, x, grid: _Grid, each, want_lines, want_pairs, steps: int, penalty: float) -> np.ndarray:
    """Weights under which the expected labels and pairs are the wanted ones, by gradient steps from params."""
    by_line = np.repeat(each, grid.real.sum(1))[:, None]
    true_moves = np.tensordot(each, want_pairs, 1)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        lines, pairs = _marginals(grid.lay(x @ params[:-4].reshape(2, -1).T), params[-4:].reshape(2, 2), grid.real)
        grad_emit = ((lines[grid.real] - want_lines) * by_line).T @ x
        grad_move = np.tensordot(each, pairs, 1) - true_moves
        grad = np.concatenate([grad_emit.ravel(), grad_move.ravel()]) + penalty * params
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        params = params - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return params


def _marginals(scores: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each label at each step, and the expected label pairs of each sequence."""
    n, steps, _ = scores.shape
    m, here = np.exp(move), real.T[..., None]
    e = np.ascontiguousarray(np.exp(scores - scores.max(2, keepdims=True)).transpose(1, 0, 2))  # steps first
    ahead, behind = np.empty((steps, n, 2)), np.ones((steps, n, 2))
    ahead[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, steps):  # scaled to sums of 1, which later divisions take out again
        new = ahead[t - 1] @ m * e[t]
        ahead[t] = np.where(here[t], new / (new[:, :1] + new[:, 1:]), ahead[t - 1])
    for t in range(steps - 1, 0, -1):
        new = e[t] * behind[t] @ m.T
        behind[t - 1] = np.where(here[t], new / (new[:, :1] + new[:, 1:]), behind[t])
    joint = ahead[:-1, :, :, None] * m * (e[1:] * behind[1:])[:, :, None, :]
    joint *= (real.T[1:] / joint.sum((2, 3)))[..., None, None]
    both = ahead * behind
    both *= (real.T / both.sum(2))[..., None]
    return both.transpose(1, 0, 2), joint.sum(0)


def fit_line_crf(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> LineCRF:
    """Fit on documents of labels (doc_id, quality) with crc32(doc_id as text) mod 5 other than 0.

    Takes at most max_docs documents with max_lines lines in all, and all lines of each: in a hashed order, a document that
    no longer fits is passed over. An id with two different labels or none is left out. Lines are counted on the
    executors, and only those of the documents taken reach the driver.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
        .toPandas()
    )
    if not len(chosen):
        return LineCRF.plain()
    quality = dict(zip(chosen["doc_id"].tolist(), chosen["quality"].tolist(), strict=True))
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(i,) for i in quality], "doc_id bigint"))  # max_docs rows at most

    def run(ids, texts):
        out: dict[str, list] = {"doc_id": ids, "name": [], "n_lines": [], "features": [], "sizes": []}
        for text in texts:
            features, sizes = line_features(split(text)[2])
            out["name"].append(hashlib.sha256(text.encode("utf-8")).digest())
            out["n_lines"].append(len(features))
            out["features"].append(features.astype("<f4").tobytes())
            out["sizes"].append(sizes.astype("<i8").tobytes())
        return out

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    seen = materialise(map_texts(few, run, "doc_id bigint, name binary, n_lines bigint, features binary, sizes binary"), "lines")
    # Of several texts of an id the one of the least digest counts, so that the field is always the same.
    counts = {r["doc_id"]: r["n"] for r in seen.groupBy("doc_id").agg(F.min(F.struct("name", "n_lines")).alias("r")).select("doc_id", F.col("r.n_lines").alias("n")).collect()}  # max_docs rows at most
    taken, left = [], max_lines
    for i in quality:  # in the hashed order of their choice
        if counts.get(i, max_lines + 1) <= left:
            taken.append((i,))
            left -= counts[i]
    some = seen.join(F.broadcast(spark.createDataFrame(taken, "doc_id bigint")), "doc_id", "left_semi")
    rows = some.groupBy("doc_id").agg(F.min(F.struct("name", "features", "sizes")).alias("r")).select("doc_id", "r.features", "r.sizes").orderBy("doc_id").toPandas()
    data = [
        (np.frombuffer(f, "<f4").astype(float).reshape(-1, len(FEATURES)), np.frombuffer(n, "<i8"), quality[i])
        for i, f, n in zip(rows["doc_id"].tolist(), rows["features"], rows["sizes"], strict=True)
    ]
    return LineCRF.fit(data)


def judge(docs: DataFrame, crf: LineCRF, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts, line labels and verdict of each row's whole text.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_words (words in content lines), n_lines (lines with a word), line_labels (one character for each
    of these lines: c or b). A null or empty text has no words and so fails the base rules. A null doc_id stays
    null, repeated rows give repeated rows, other columns are not read, an empty table gives an empty one. A very long
    text is decoded as a whole; its lines' features take about 100 bytes each. At a tie Viterbi takes content.
    """

    def run(ids, texts):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {k: [] for k in (*names, "base_failed", "kept", "content_words", "n_lines", "line_labels")}
        for text in texts:
            data, words, lines = split(text)
            counts = base_counts(text, data, words, lines)
            for name, v in zip(names, counts, strict=True):
                out[name].append(v)
            failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
            features, sizes = line_features(lines)
            labels = crf.decode(features)
            content = int(sizes[np.array(labels, bool)].sum()) if labels else 0
            out["base_failed"].append(failed)
            out["kept"].append(not failed and content >= content_share * counts[0])
            out["content_words"].append(content)
            out["n_lines"].append(len(lines))
            out["line_labels"].append("".join("c" if x else "b" for x in labels))
        return {"doc_id": ids} | out

    return map_texts(
        docs, run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint, n_lines bigint, line_labels string"
    )


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    crf = fit_line_crf(docs, read(spark, sf_dir, "labels"))
    return judge(docs, crf).drop("line_labels")
