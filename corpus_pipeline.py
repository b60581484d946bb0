"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, documents, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
one returns the pieces that it packs.

In every stage null and empty texts are empty documents and stay; rows without a doc_id stay, and decide nothing about others;
repeated rows are one document to line dedup and near-duplicates, so they go or stay together, and rows of their own elsewhere. Of
equal candidates the smallest doc_id counts. Texts of any length are read whole. Columns beyond those of documents are kept. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusweave.llm import lines, mixing, packing, simhash, toxicity
from locusweave.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half; the classifier is fitted on labelled rows of the whole documents table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two or more lines that an earlier document, or an earlier place, has."""
    return lines.dedup_passages(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints that links of at most three differing bits join."""
    return simhash.drop_linked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's weight, in a global random order."""
    mixed = mixing.mix_sources(docs)
    return mixed.select(*[mixed["doc"][c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix), ("packing", pack)]

#: Tokenizers, hashes and trained models are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each returns is written, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
