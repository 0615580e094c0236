"""A training corpus from raw documents: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns the pieces of the packed sequences. An empty table gives an empty result in every
stage, and columns beside doc_id, text, lang and source are carried along under whatever name they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagebase.llm import near_copies as near
from passagebase.llm.common import crc32_mod, drop_rows, stash, table
from passagebase.llm.exact_dedup import exact_dedup, keep_one
from passagebase.llm.language_id import drop_unknown, identify, learn
from passagebase.llm.mixing import repeat_rows
from passagebase.llm.packing import pack
from passagebase.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters at all) go.

    Null and empty texts go with them; very long texts are read whole; without any labelled document all go, as none can be
    told. Rows are decided by doc_id and text, so repeated rows go or stay together and a null doc_id harms no other row.
    """
    predictions = stash(identify(docs, learn(docs.where(crc32_mod("doc_id", 5) != 0)), with_sha=True))
    return drop_unknown(docs, predictions)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays.

    Texts are equal when identical after lower-casing A-Z, whatever their length; null and empty texts are equal. A null
    doc_id is smaller than any other; of rows repeated with doc_id and text, one stays.
    """
    return keep_one(docs, stash(exact_dedup(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a similarity of 0.8 or more, the smallest doc_id stays.

    A text of fewer than five words is one shingle, so are null and empty texts; very long texts are compared whole. A null
    doc_id is larger than any other and ties go by the text's SHA-256; rows repeated with doc_id and text stay together.
    """
    return drop_rows(docs, stash(near.near_copies(docs, words=5, least=0.8)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document passed over twice is two rows.

    Null, empty and wordless texts pass once; a null source is a source of its own; ties in the seeded order are decided
    alike, so rows repeated with doc_id and text are taken alike.
    """
    return repeat_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens.

    Null and empty texts have the end id alone; very long texts are cut into blocks; repeated rows are packed each, a null
    doc_id like any other.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: No SQL: fingerprint components, flow and packing can't be written as one; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
