"""The corpus pipeline: language ID, near duplicates, secrets, mixture, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a stage
returns as Parquet in the shared folder and rereads it for the next. All but the last return the columns of documents.
A row that a stage keeps stays as it is, but for the secrets that the third replaces in its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, language, mixing, packing, secrets

#: A text whose best language has less than this pooled probability is of none of those learned.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no letter, or are like none of the languages learned from the labelled ones, go. If none is labelled, all stay."""
    net = language.train(docs)
    if not net.languages:
        return docs
    # whole rows go through the operator, so that repeated rows and ids stay as they are
    others = [F.col(c) for c in docs.columns if c != "text"]
    told = language.predict(docs.select(F.struct(*others).alias("_row"), "doc_id", "text"), net, "_row", with_text=True)
    kept = told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, in one row: five-word shingles, a Jaccard similarity of 0.8 or more. Null, empty and wordless texts, and rows without an id, stay; an empty table stays empty."""
    return jaccard.one_of_each(docs, jaccard.Join(words=5, percent=80))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by their kinds. A null text stays null, repeated rows stay repeated; an empty table stays empty."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come to their target weights. Null labels are a value of their own; rows of one id, ties too, are drawn alike; a null or empty text is drawn by its cell; an empty table stays empty."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens. A null or empty text is its end mark; repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: The network, the join and the tokenizer can't be put in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
            if k:
                common.drop(before)
    return docs
