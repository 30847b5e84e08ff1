"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Rows travel as one struct, so further columns of documents may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm.common import durable, scratch, table, unpacked


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; null and empty texts, texts without a letter and those whose two best languages tie or nearly so go.

    Rows with a null id, language or source stay if their text is identified; rows that repeat stay or go together. An empty table gives an empty one.
    """
    from spanweave.llm.langid import identify_languages

    return unpacked(identify_languages(docs).where("NOT rejected"), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the quality threshold, a score equal to it included.

    Null texts score as empty ones; ids and labels decide no score, so repeated rows stay or go together, whatever their other columns hold. An empty table gives an empty one.
    """
    from spanweave.llm.quality import score_quality

    return unpacked(score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id.

    Null, empty and blank texts and rows with a null id are in no class and stay. Rows that repeat an id are one document and stay or go together. An empty table gives an empty one.
    """
    from spanweave.llm.bagminhash import near_duplicates

    return unpacked(near_duplicates(docs).where("kept"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources up to twice, so that sources have their tempered weights.

    A null source is a source of its own; null and empty texts have no tokens but are drawn as often as their source's others may be; a repeated row counts as often as it is there. An empty table gives an empty one.
    """
    from spanweave.llm.mixing import mix

    return unpacked(mix(docs, max_repeat=2.0), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is one piece, its closing id; a text longer than a sequence is several; a row that repeats is packed as often as it is there. An empty table gives no piece.
    """
    import public_tokenizers

    from spanweave.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Compression, BagMinHash and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
