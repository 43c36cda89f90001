"""Quality classifier: a generalised additive model with pairwise interactions (operator 7).

Each feature is cut into bins and has a table with one value for each bin. Boosting goes round the features in
turn: a tree of two splits over the feature's bins is fitted to the present gradients and, shrunk, added to the
feature's table, so that no feature can take what another explains as well. Pairs of features follow in the
same way, those first that leave the most to gain. A score is the logistic function of the intercept plus one
looked-up value for each feature and pair, which whole columns are scored by.

Only the text is looked at. Fitting uses at most MAX_ROWS labelled documents, the first by a hash of doc_id
among those with crc32(doc_id as text) mod 5 other than 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import map_texts, read, release
from cohortlens.llm.textstats import DIGITS, MARKS, STOPS, SYMBOLS, UPPER, base_counts, having, split

MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 200, 100, 0.1
FEATURES = (
    "log_words", "word_length", "symbols", "marked_words", "marks", "upper", "digits", "stops", "pipes", "duplicate_lines", "repeated_words", "distinct_words",
    "line_words", "single_word_lines", "other_bytes", "upper_words",
)


def features(text: str) -> tuple[float, ...]:
    """FEATURES of a text; an empty one has zeros."""
    data, words, lines = split(text)
    n, chars, symbols, duplicates, repeats = base_counts(text, data, words, lines)
    if not n:
        return (0.0,) * len(FEATURES)
    ends = bytes(w[-1] for w in words)
    starts = bytes(w[0] for w in words)
    rows = max(1, len(lines))
    return (
        np.log1p(n), chars / n, symbols / chars, having(ends, SYMBOLS) / n, having(data, MARKS) / chars, having(data, UPPER) / chars, having(data, DIGITS) / chars,
        having(data, STOPS) / chars, data.count(b"|") / n, duplicates / rows, repeats / n, len(set(words)) / n,
        n / rows, sum(b" " not in x for x in lines) / rows, 1 - len(text.encode("ascii", "ignore")) / len(data), having(starts, UPPER) / n,
    )


class GAM:
    """edges, tables: by feature; pairs: (feature, feature, edges, edges, table)."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    @classmethod
    def plain(cls, share: float = 0.5) -> GAM:
        return cls(float(np.log(share / (1 - share))), [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> GAM:
        if not len(y) or y.min() == y.max():
            return cls.plain(0.5 if not len(y) else 0.99 if y[0] else 0.01)
        base = float(np.log(y.mean() / (1 - y.mean())))
        edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
        tables = [np.zeros(len(e) + 1) for e in edges]
        total = np.full(len(y), base)
        for _ in range(ROUNDS):
            for f in range(x.shape[1]):
                step = RATE * _tree(bins[f], *_slopes(total, y), len(tables[f]))
                tables[f] += step
                total += step[bins[f]]
        coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
        cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
        slope, bend = _slopes(total, y)
        gains = []
        for a in range(x.shape[1]):
            for b in range(a + 1, x.shape[1]):
                _, gain = _grid_tree(cells[a], cells[b], slope, bend, len(coarse[a]) + 1, len(coarse[b]) + 1)
                gains.append((-gain, a, b))
        pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, b, _, _, table in pairs:
                step = RATE * _grid_tree(cells[a], cells[b], *_slopes(total, y), *table.shape)[0]
                table += step
                total += step[cells[a], cells[b]]
        return cls(base, edges, tables, pairs)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, ea, eb, table in self.pairs:
            total += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of bins with about as many values each; at most bins - 1."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _slopes(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-total))
    return y - p, np.maximum(p * (1 - p), 1e-6)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins into two; 0 where none gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 1e-9 else (0.0, 0)


def _tree(bins: np.ndarray, slope: np.ndarray, bend: np.ndarray, size: int) -> np.ndarray:
    """A tree of two splits over one feature's bins: a value for each bin."""
    g, h = np.bincount(bins, slope, size), np.bincount(bins, bend, size)
    parts = [(0, size)]
    for _ in range(2):
        gain, cut, part = max((*_best_cut(g[a:b], h[a:b]), (a, b)) for a, b in parts)
        if not cut:
            break
        a, b = part
        parts.remove(part)
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(size)
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _grid_tree(a: np.ndarray, b: np.ndarray, slope: np.ndarray, bend: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, float]:
    """A tree over two features' cells: one cut of a, then one of b on either side; a value for each cell, and the gain."""
    at = a * cols + b
    g, h = np.bincount(at, slope, rows * cols).reshape(rows, cols), np.bincount(at, bend, rows * cols).reshape(rows, cols)
    best, parts = 0.0, [(0, rows, 0)]
    for cut in range(1, rows):
        gain, found = 0.0, []
        for x, y in ((0, cut), (cut, rows)):
            gg, hh = g[x:y].sum(0), h[x:y].sum(0)
            more, k = _best_cut(gg, hh)
            gain += gg.sum() ** 2 / (hh.sum() + 1) + more
            found.append((x, y, k))
        gain -= g.sum() ** 2 / (h.sum() + 1)
        if gain > best:
            best, parts = gain, found
    out = np.zeros((rows, cols))
    for x, y, k in parts:
        for p, q in ((0, k), (k, cols)):
            if q > p:
                out[x:y, p:q] = g[x:y, p:q].sum() / (h[x:y, p:q].sum() + 1)
    return out, best


def fit_gam(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> GAM:
    """Fit on documents of labels (doc_id, quality) with crc32(doc_id as text) mod 5 other than 0.

    Takes at most max_rows documents; an id with two different labels or none is left out. Without rows of
    both labels the model is a constant.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .toPandas()
    )
    if not len(chosen):
        return GAM.plain()
    quality = dict(zip(chosen["doc_id"].tolist(), chosen["quality"].tolist(), strict=True))
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen[["doc_id"]], "doc_id bigint"))  # max_rows rows at most

    def run(ids, texts):
        return {"doc_id": ids, "name": [hashlib.sha256(t.encode("utf-8")).digest() for t in texts], "x": [list(map(float, features(t))) for t in texts]}

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    seen = map_texts(few, run, "doc_id bigint, name binary, x array<double>")
    # Of several texts of an id the one of the least digest counts, so that the model is always the same.
    rows = seen.groupBy("doc_id").agg(F.min(F.struct("name", "x")).alias("r")).select("doc_id", "r.x").orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return GAM.fit(x, np.array([quality[i] for i in rows["doc_id"].tolist()], float))


def score(docs: DataFrame, model: GAM) -> DataFrame:
    """doc_id and score (0 to 1, higher: better quality likelier) of each row's whole text.

    A null or empty text is scored as one without words; a null doc_id stays null; repeated rows give repeated
    rows with equal scores; a very long text is read as a whole, a few at a time; other columns are not read; an empty
    table gives an empty one. Nothing is shuffled.
    """

    def run(ids, texts):
        x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return {"doc_id": ids, "score": model.score(x)}

    return map_texts(docs, run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: GAM, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold. Nothing is shuffled.

    A null or empty text is scored as one without words; a null or repeated doc_id does not matter; columns of any name
    are handed on; a row whose score is just threshold stays; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            step = max(1, int(len(batch) * (4 << 20) / max(1, batch.column(at).nbytes)))
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                x = np.array([features(t or "") for t in part.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.score(x) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def op7_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit_gam(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
