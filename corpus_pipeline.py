"""From documents to packed sequences: STAGES in order, each on all that the one before kept.

Every stage calls one operator of attestor.llm, returns the columns of documents (the last one: pieces in sequences), and
is written as Parquet before the next one reads it.

Defined results of every stage: an empty table stays empty; repeated rows are judged each (near_duplicates keeps one of
them); a null lang or source is a value of its own; extra columns of any name travel along.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import fertility, langid, mixing, packing, simhash
from attestor.llm.common import prepare, table, work_dir, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence. Null, empty and letterless texts have none and go; texts are read whole."""
    prepare(spark)
    found = langid.identify(docs, langid.learn(docs), carry=docs.columns)
    return found.filter(~F.col("rejected")).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fertility band of their language, or, where lang is null or has no band, of their script. Null and empty texts go."""
    prepare(spark)
    return fertility.judge(docs, carry=docs.columns).filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id; an id given to several texts keeps one row of each group; groups without any id keep their first text."""
    prepare(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated or cut as the sources' budgets say. Null sources are one source; a null text has size 0 and is never taken."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences. A null or empty text is the end token alone."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates), ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]

#: Language identification and packing are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{at}/stage{k}")
    return docs
