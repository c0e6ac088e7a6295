"""From raw documents to token files: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives the next documents.  ``run`` writes every stage's
result as Parquet into the shared folder, reads it back and drops what the stage has left there.  No SQL can say what the language model, the tokenizer and the pseudorandom
mix do, so ORACLE_SQL is None and the tests hold ``run`` against plain Python.

All stages take texts of any length whole, give an empty table for an empty one, and pass columns of any other name through (the last
one returns its own).  What they do with nulls, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontaminate, jaccard, language, mixture, tokens
from fathom.plans.staging import Workspace, scope

#: Five words and 0.8.
NEAR = jaccard.Link(words=5, up=4, down=9)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null text, and text without a letter.  The model rejects no other.

    Null languages and ids are not learnt from or are, as any other row; repeated rows are kept or go together; of two languages that fit
    alike the first by name is taken, which decides nothing here.
    """
    return language.drop_unidentified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked at ``NEAR`` the one with the smallest id stays.

    Null and empty texts are linked with nothing and stay.  A null id is the smallest, and one row of a group without ids stays; of two
    texts of the smallest id the one of the smaller hash stays; rows that repeat id and text of the kept one stay with it.
    """
    return jaccard.drop_linked(docs, link=NEAR)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.  Null and empty texts have no words and stay; repeated rows go or stay together; ids are not looked at."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, fractions rounded at random by a hash of the id.

    Null and empty texts have no words and go.  A null source is one of its own, the last; rows that repeat id and text, without an
    id too, come equally often.
    """
    return mixture.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids_crc32) as read back from the files.

    A row for every row: null texts give the end id alone, repeated rows are encoded one after the other, null ids come first.
    """
    return tokens.token_table(docs.select("doc_id", "text"))


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("decontaminate", remove_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope():
            docs = space.put(name, stage(spark, docs, sf_dir))
    return docs
