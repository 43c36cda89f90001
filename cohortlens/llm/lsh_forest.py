"""N-gram Jaccard join by a MinHash LSH forest with exact verification (operator 10).

A text's shingles are its runs of five words (ASCII white space between them; the whole text if it has fewer).
Every tree of the forest gives a text a label, a sequence of minima of its shingles under hash functions of that
tree, most significant first, so that sorting labels as bytes gives the tree's trie: a node is a tree, a depth and the
prefix that the labels below it share. Two texts of similarity s share a prefix of depth d in a tree with
probability s^d.

A text starts from its full labels and shortens the prefixes that it matches one tree after the other, in an order of
its own, level by level, until a text at the threshold shares one of its nodes with the target recall. A text that
has company at depth SHORTEST in too few trees to have a near copy (see least_company) stops before it starts, so most
texts ask for no node at all. All texts of a node that one of them asks for are candidates of one another; of nested
nodes the upper one counts. Which trees are shortened may not depend on how many texts their nodes hold: where a text is
alone its near copy is not, so going by sizes would pass by the very nodes that hold it.

Equal texts are one text from the start. Nodes with few texts give pairs; nodes with many are compared block by block
and give the parts that alike texts form, so that no node is expanded into pairs. Alike are texts whose minima agree
nearly as often as the threshold asks (see loss_by_sketch). The parts that hang together then get each text's shingles
once and are verified by exact intersection counts, in blocks of bounded size where a part is large. Blocks count links
and return the parts that the links connect; pairs are never written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import map_texts, materialise, read, release
from cohortlens.llm.components import connected_components

NGRAM, THRESHOLD = 5, (8, 10)
TREES, LABEL, SHORTEST, RECALL = 32, 8, 4, 0.9999
#: Nodes of more texts than this are compared in blocks of NODE_BLOCK texts instead of giving pairs.
FEW, NODE_BLOCK = 24, 256
#: Standard errors below the threshold at which minima still make a candidate.
ERRORS = 5
#: Texts and shingles of a block, on average. Parts have small blocks, so that their work is dealt over many tasks, up to
#: MOST_SMALL of them; larger ones have large blocks, so that a text is not sent too often.
SMALL_BLOCK, MOST_SMALL, BLOCK_TEXTS, BLOCK_SHINGLES = 64, 64, 512, 300_000
CACHE_WORDS = 150_000


def least_company(threshold: float, trees: int, recall: float, shortest: int = SHORTEST) -> tuple[int, float]:
    """In how many trees a text must have company at depth shortest to go on, and the chance that one with a near copy stops.

    That is at most a quarter of what the recall allows.
    """
    from math import comb

    p, sum_, need = threshold**shortest, 0.0, 0
    while True:
        more = sum_ + comb(trees, need) * p**need * (1 - p) ** (trees - need)
        if more > (1 - recall) / 4 or need == trees:
            return need, sum_
        sum_, need = more, need + 1


def shortened(threshold: float, trees: int, label: int, miss: float, shortest: int = SHORTEST) -> tuple[int, int]:
    """Prefixes are shortened from full labels, tree by tree and level by level, until the chance that a pair at the
    threshold shares none is at most miss: the depth of the last level, and how many trees get down to it.

    Where even depth shortest in all trees does not do, that is what is searched.
    """
    from math import log, log1p

    gain = lambda d: -log1p(-(threshold**d))
    held = trees * gain(label)
    for depth in range(label - 1, shortest - 1, -1):
        for tree in range(1, trees + 1):
            held += gain(depth) - gain(depth + 1)
            if held >= -log(miss):
                return depth, tree
    return shortest, trees


def loss_by_sketch(threshold: float, minima: int = TREES * LABEL, errors: float = ERRORS) -> float:
    """The chance that a pair at the threshold is no candidate although it meets in a node."""
    from math import comb

    least = threshold - errors * (threshold * (1 - threshold) / minima) ** 0.5
    return sum(comb(minima, k) * threshold**k * (1 - threshold) ** (minima - k) for k in range(minima) if k / minima < least)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, size: int = NGRAM) -> np.ndarray:
    """64-bit hashes of the text's shingles in their order, repeats included; none without a word."""
    words = text.encode("utf-8").split()
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    ids = np.array([_WORDS[w] for w in words], np.uint64)
    n = len(ids)
    if not n:
        return ids
    odd = _ODD if size <= len(_ODD) else _mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    if n < size:
        return _mixed((ids * odd[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out += ids[k : n - size + 1 + k] * odd[k]
    return _mixed(out)


def minima(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 256):
        np.minimum(out, (x[a : a + 256, None] * factors + offsets).min(0), out=out)
    return out


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def sign(docs: DataFrame, size: int, trees: int, label: int) -> DataFrame:
    """doc_id, key (of the text), n (shingles, repeats included), labels (two bytes of each minimum, tree after tree)."""
    factors, offsets = _functions(trees * label)

    def run(ids, texts):
        out = {"doc_id": ids, "key": [], "n": [], "labels": []}
        for text in texts:
            hashes = shingles(text, size)
            out["key"].append(hashlib.sha256(text.encode("utf-8")).digest())
            out["n"].append(len(hashes))
            out["labels"].append((minima(hashes, factors, offsets) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2").tobytes() if len(hashes) else None)
        return out

    return map_texts(docs, run, "doc_id bigint, key binary, n bigint, labels binary")


def _minima(labels: pa.Array) -> np.ndarray:
    """A byte of each minimum, a row for each label string."""
    return np.frombuffer(b"".join(labels.to_pylist()), np.uint8).reshape(len(labels), -1)[:, 1::2]


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose minima agree in at least this share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                keep = pa.array((_minima(part.column(2)) == _minima(part.column(3))).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "labels_a", "labels_b").mapInArrow(run, "a bigint, b bigint")


def _alike_blocks(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect the alike texts of each block pair (node, i, j) of crowded nodes; rows come sorted."""

    def flush(ids: list, labels: list) -> pa.RecordBatch:
        sketch, own = _minima(pa.array(labels)), np.array(ids, np.int64)
        same = np.zeros((len(own), len(own)), np.uint16)
        for column in np.ascontiguousarray(sketch.T):
            same += column[:, None] == column[None, :]
        root = _parts(same >= least * sketch.shape[1], own)
        return pa.RecordBatch.from_arrays([pa.array(own[root != own]), pa.array(root[root != own])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, labels = None, [], []
        for batch in batches:
            for node, i, j, id_, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, i, j) != key and ids:
                    yield flush(ids, labels)
                    ids, labels = [], []
                key = (node, i, j)
                ids.append(id_)
                labels.append(held)
        if ids:
            yield flush(ids, labels)
        release()

    return rows.select("node", "i", "j", "id", "labels").mapInArrow(run, "a bigint, b bigint")


def candidates(texts: DataFrame, threshold: float, trees: int, label: int, recall: float) -> DataFrame:
    """id and node of each text (id, labels) in the nodes that are asked for; each tree has one node of a text at most."""
    need, lost = least_company(threshold, trees, recall)
    depth, count = shortened(threshold, trees, label, 1 - recall - lost)
    one = F.expr(f"substring(labels, 1 + tree * {2 * label}, {2 * label})").alias("label")
    rows = texts.where("labels is not null").select("id", "labels", F.explode(F.expr(f"sequence(0Y, {trees - 1}Y)")).alias("tree")).select("id", "tree", one)
    node = lambda d: F.xxhash64("tree", F.lit(d), F.expr(f"substring(label, 1, {2 * d})"))
    rows = rows.select("id", "tree", node(SHORTEST).alias("top"), node(depth).alias("upper"), node(depth + 1).alias("lower"))
    crowds = rows.groupBy("top").agg(F.count("*").alias("m")).where("m > 1").select("top")
    # The part of the tries below nodes with company.
    met = materialise(rows.join(crowds, "top").select("id", "tree", "upper", "lower"), "trie")
    asking = met.groupBy("id").agg(F.count("*").alias("trees")).where(F.col("trees") >= need).select("id")
    turn = F.pmod(F.pmod(F.xxhash64("id"), F.lit(trees)) + F.col("tree"), F.lit(trees))
    asked = met.join(asking, "id", "left_semi").select(F.when(turn < count, F.col("upper")).alias("up"), F.when(turn >= count, F.col("lower")).alias("low"))
    up, low = (asked.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(True).alias(f"{c}_asked")) for c in ("up", "low"))
    inside = met.join(up, met["upper"] == up["up"], "left").join(low, met["lower"] == low["low"], "left")
    return materialise(inside.select("id", F.when(F.col("up_asked"), F.col("upper")).when(F.col("low_asked"), F.col("lower")).alias("node")).where("node is not null"), "candidates")


def alike(texts: DataFrame, threshold: float, trees: int, label: int, recall: float) -> DataFrame:
    """Edges (a, b) that connect all candidates whose minima are alike."""
    least = threshold - ERRORS * (threshold * (1 - threshold) / (trees * label)) ** 0.5
    members = candidates(texts, threshold, trees, label, recall)
    groups = members.groupBy("node").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids")).where("m > 1")
    # Nodes of different trees with the same texts are one.
    groups = materialise(groups.groupBy("m", "ids").agg(F.min("node").alias("node")).select("node", "m"), "nodes")
    placed = materialise(members.join(groups, "node"), "members")
    listed = placed.where(F.col("m") <= FEW).groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # FEW at most
    pairs = listed.select(F.explode(F.expr("flatten(transform(ids, (x, k) -> transform(slice(ids, k + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b").distinct()
    held = texts.select("id", "labels")
    pairs = pairs.join(held.select(F.col("id").alias("a"), F.col("labels").alias("labels_a")), "a").join(held.select(F.col("id").alias("b"), F.col("labels").alias("labels_b")), "b")
    blocks = F.ceil(F.col("m") / NODE_BLOCK).cast("long")
    crowded = placed.where(F.col("m") > FEW).select("node", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("block")).join(held, "id")
    dealt = crowded.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "labels")
    count = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _alike(pairs, least).unionByName(_alike_blocks(dealt.repartition(count, "node", "i", "j").sortWithinPartitions("node", "i", "j"), least))


def links_of(sets: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Which texts (sorted distinct shingles) have a Jaccard similarity of at least the threshold; none has to itself."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(values)))
    common = np.zeros(m * m, np.float64)
    for width in np.unique(counts[(counts > 1) & (counts <= 64)]):
        rows = starts[counts == width]
        step = max(1, 4_000_000 // int(width * width))
        for k in range(0, len(rows), step):
            held = owners[rows[k : k + step, None] + np.arange(width)]
            common += np.bincount((held[:, :, None] * m + held[:, None, :]).ravel(), minlength=m * m)
    common = common.reshape(m, m)
    many = np.flatnonzero(counts > 64)
    for k in range(0, len(many), 2048):
        grid = np.zeros((m, len(many[k : k + 2048])), np.float32)
        for c, g in enumerate(many[k : k + 2048]):
            grid[owners[starts[g] : starts[g] + counts[g]], c] = 1
        common += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - common
    found = (common * threshold[1] >= threshold[0] * union) & (union > 0)
    np.fill_diagonal(found, False)
    return found


def _parts(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each text's part under the links."""
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(found, least[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (new == least).all():
            return least
        least = new


def _verify(blocks: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Count links in each block pair (part, i, j); rows come sorted by it. Returns id, links, root, blocks."""

    def flush(rows: list) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        side = np.array([r[1] for r in rows])
        found = links_of([np.frombuffer(r[2], "<u8") for r in rows], threshold)
        if rows[0][4]:  # two different blocks, even if one is empty: links inside one are counted where it meets itself
            found &= side[:, None] != side[None, :]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(found.sum(1).astype(np.int64)), pa.array(_parts(found, ids)), pa.array(np.full(len(ids), rows[0][3], np.int64))], names=["id", "links", "root", "blocks"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for part, i, j, id_, side, held, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, i, j) != key and rows:
                    yield flush(rows)
                    rows = []
                key = (part, i, j)
                rows.append((id_, side, held, blocks, i != j))
        if rows:
            yield flush(rows)
        release()

    return blocks.select("part", "i", "j", "id", "side", "held", "blocks").mapInArrow(run, "id bigint, links bigint, root bigint, blocks bigint")


def _joined(docs: DataFrame, size: int, threshold: tuple[int, int], trees: int, label: int, recall: float) -> DataFrame:
    """doc_id, key, copy_of, class_id, n_links of each row with a doc_id, and whether its text stands for copy_of (own)."""
    spark = docs.sparkSession
    share = threshold[0] / threshold[1]
    signed = materialise(sign(docs.where("doc_id is not null"), size, trees, label), "signed")
    copies = signed.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    texts = materialise(copies.groupBy("id").agg(F.min(F.struct("key", "n", "labels")).alias("t")).select("id", "t.key", "t.n", "t.labels"), "texts")
    part = materialise(connected_components(alike(texts, share, trees, label, recall), "edges"), "parts")

    def distinct_shingles(ids, texts):
        return {"doc_id": ids, "held": [np.unique(shingles(t, size)).astype("<u8").tobytes() for t in texts]}

    wanted = part.join(texts.select(F.col("id").alias("node"), "key", "n"), "node")
    sums = wanted.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.greatest(F.least(F.ceil(F.col("m") / SMALL_BLOCK), F.lit(MOST_SMALL)), F.ceil(F.col("m") / BLOCK_TEXTS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long")
    placed = materialise(
        wanted.join(sums.select("component", blocks.alias("blocks")), "component").select(
            F.col("node").alias("doc_id"), "key", F.col("component").alias("part"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")
        ),
        "placed",
    )
    # Texts are dealt by doc_id whatever the number of candidates, so that the plan is one at every size.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = own.join(placed.select("doc_id", "key").hint("merge"), "doc_id").where(F.unhex(F.sha2("text", 256)) == F.col("key")).select("doc_id", "text")
    held = map_texts(chosen, distinct_shingles, "doc_id bigint, held binary").dropDuplicates(["doc_id"])
    dealt = (
        held.join(placed.select("doc_id", "part", "blocks", "block"), "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("doc_id").alias("id"), F.col("block").alias("side"), "held", "blocks")
    )
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = materialise(_verify(dealt.repartition(count, "part", "i", "j").sortWithinPartitions("part", "i", "j"), threshold), "counted")

    links = counted.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    across = connected_components(counted.where("blocks > 1").select(F.col("id").alias("a"), F.col("root").alias("b")), "classes")
    found = links.join(across.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "links", F.coalesce("component", "root").alias("root"))
    own = texts.select("key", F.lit(True).alias("own"))
    classes = copies.select("key", "id").join(own, "key", "left").join(found, "id", "left").select(
        "key", F.col("id").alias("copy_of"), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("own", F.lit(False)).alias("own")
    )
    return signed.select("doc_id", "key").join(materialise(classes, "classes"), "key")


def jaccard_join(docs: DataFrame, size: int = NGRAM, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> DataFrame:
    """doc_id, copy_of, class_id and n_links of each row of docs.

    copy_of is the smallest doc_id with the same text, n_links the number of different texts with a Jaccard
    similarity of at least the threshold (a fraction) to this one, class_id the smallest doc_id of all texts
    that such links connect. A null text is an empty one. Texts without a word have no links but are copies of
    an equal text. A row with a null doc_id takes no part: copy_of and class_id are null, n_links 0. Repeated
    rows are copies; where one doc_id has different texts, the one of the smallest hash stands for the id. A very long
    text is one text like any other; its distinct shingles have to fit into a task.
    Other columns are not read; an empty table gives an empty result.
    """
    out = _joined(docs, size, threshold, trees, label, recall)
    none = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.select("doc_id", "copy_of", "class_id", "n_links").unionByName(none)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is its class's; one row for each doc_id and text.

    Rows with a null doc_id stay, as nothing is known about them. Where one doc_id has different texts, those that do
    not stand for it were compared with none and stay, one row each. Equal rows are one; an empty table stays empty.
    """
    joined = _joined(docs, NGRAM, THRESHOLD, TREES, LABEL, RECALL)
    heads = joined.where("(own and doc_id = class_id) or (not own and doc_id = copy_of)").select(F.col("doc_id").alias("_head"), F.col("key").alias("_key")).distinct()
    keyed = docs.where("doc_id is not null").withColumn("_sha", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    kept = keyed.join(heads, (F.col("doc_id").cast("long") == F.col("_head")) & (F.col("_sha") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return kept.unionByName(docs.where("doc_id is null"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


#: The same join by an inverted list of shingles; exact.
SQL = rf"""
with recursive doc as (select doc_id, coalesce(text, '') as text from documents),
rep as (select text, min(doc_id) as copy_of from doc group by text),
word as (select copy_of, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from rep),
shingle as (
  select copy_of, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < {NGRAM} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' ')) end)) as s from word),
size as (select copy_of, count(*) as n from shingle group by copy_of),
common as (select a.copy_of as a, b.copy_of as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.copy_of <> b.copy_of group by all),
link as (select a, b from common join size x on a = x.copy_of join size y on b = y.copy_of where {THRESHOLD[1]} * c >= {THRESHOLD[0]} * (x.n + y.n - c)),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a, min(b) as m from reach group by a),
degree as (select a, count(*) as n from link group by a)
select doc.doc_id, rep.copy_of, least(rep.copy_of, coalesce(least.m, rep.copy_of)) as class_id, coalesce(degree.n, 0) as n_links
from doc join rep using (text) left join least on rep.copy_of = least.a left join degree on rep.copy_of = degree.a
"""
