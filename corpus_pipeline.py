"""The corpus pipeline: documents -> toxicity -> near duplicates -> decontamination -> personal data -> token ids.

Each stage works on all that its predecessor kept and is written to the shared folder between stages. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, common, decontaminate, jaccard_join, pii, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; the model learns from the labelled rows of the input.

    Null and empty texts get the base score and stay; a score equal to the threshold goes; repeated rows are judged alike; without
    labels the default weights hold; an empty table stays empty; columns of any name stay as they are.
    """
    return toxicity.reject_toxic(docs, common.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity of 0.8 or more) the smallest id stays.

    Null, empty and wordless texts have no component and all stay; rows without an id come last, then the smallest text hash, then
    the smallest row in JSON decides, so one of repeated rows stays; an empty table stays empty; columns of any name stay as they are.
    """
    return jaccard_join.drop_near_duplicates(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go; the others stay as they are.

    Null and empty texts are clean; exactly a twentieth goes; null items have no window; repeated rows are judged alike; an empty
    benchmark or table changes nothing; columns of any name stay as they are.
    """
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain or disguised, become marks of their kind; n_chars follows the text.

    A null text stays null, and no row goes; of overlapping identifiers the one that begins first, then the longer, names the mark;
    repeated rows change alike; an empty table stays empty; columns of any name stay as they are.
    """
    return pii.redact_pii(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, digests and the token ids of each text.

    Null and empty texts have no tokens; every row, repeated or not, is encoded; an empty table gives an empty result; other columns are left out.
    """
    return bpe.encode_texts(docs, keep=["doc_id"])


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_documents),
    ("pii", redact_personal_data),
    ("bpe", encode_tokens),
]

#: The learned toxicity model and the token ids cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
