"""The corpus pipeline: stages that turn documents into tokenized training rows.

Each stage takes all rows that the one before it kept. Documents that the quality classifier rejects go; of each
group of near duplicates one document stays; passages that an earlier document has too are cut out; sources are
mixed to their target weights; what is left is encoded. All but the last return the columns of documents, extra ones
included whatever their names; very long texts are taken whole, and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe, gam, lsh_forest, mixing, suffix_dedup
from cohortlens.llm.common import materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labelled ones among them, does not reject.

    A null or empty text is scored as one without words; rows with a null or repeated doc_id are rows like any other.
    """
    return gam.keep_good(docs, gam.fit_gam(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near duplicates.

    Rows with a null doc_id stay; of equal rows of one doc_id one stays; texts without a word are copies of an equal one.
    """
    return lsh_forest.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that a smaller doc_id has too; a character cut in two goes as a whole."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffix_dedup.remove_repeats(docs, carry=rest)
    text = F.when(F.col("n_removed") > 0, _decoded("kept")).otherwise(F.decode("kept", "UTF-8"))
    chars = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in rest else {}
    wide = out.select("doc_id", text.alias("text"), *(F.col("carried").getField(c).alias(c) for c in rest)).withColumns(chars)
    return wide.select(*docs.columns)


def _decoded(column: str):
    """The text of bytes, without the parts of characters that a cut has left."""
    return F.replace(F.make_valid_utf8(F.col(column).cast("string")), F.lit("\ufffd"), F.lit(""))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken to meet the target weights, once for each epoch that takes them.

    Tokens are words here, as the weights are about text; documents without a word have nothing to take.
    """
    return mixing.taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the digests of operator 5, for each row; a null text is an empty one."""
    import public_tokenizers

    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(coded, "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixed), ("tokens", tokens)]

#: SQL cannot express the learned and iterative stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
