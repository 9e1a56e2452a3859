"""The training-data pipeline: from documents to token-id files, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of documents; the last returns the digests read back from its files. Between
stages the rows are written as Parquet and read again, so lineage is short and a lost executor
repeats one stage's work at most.

Defined cases: a null or empty text is never toxic by itself, is no near duplicate, holds no item,
has no words for the mix and is therefore not drawn; of rows that repeat a doc_id and a text one
stays; rows without doc_id pass the first two stages by their text alone and leave in the third if they
hold an item; further columns of any name are kept up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.llm import decontam, minhash, mixing, tokenids, toxicity
from vacantlens.llm.columns import free_name
from vacantlens.session import ship, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; fitted on rows that are not held out."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    name = free_name("score", docs.columns)
    return toxicity.scored(docs, model, docs.columns, name=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document's text is what the mix takes of it."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token-id files, read back."""
    return tokenids.encoded_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("minhash", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", encoded),
]

#: The classifier and the latent space have no SQL form; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
