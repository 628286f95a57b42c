"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing and sharding over ``documents``.

Each stage works on all that the one before it kept. All but the last return the columns of documents, whatever the names
of those beside doc_id, text and source; the last adds shard and slot.

In every stage null, empty and blank texts, texts of any length, null and repeated ids and repeated rows are rows like any
other, and an empty table gives an empty table; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontamination, mixing, sharding, simhash, toxicity
from riskloom.llm.common import shielded, table
from riskloom.session import cut

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the network learns from the labelled rows that aren't held out.

    Texts without words score 0 and stay; copies share their text's fate. Without labels of both kinds all stay.
    """
    inner, back = shielded(docs, "doc_id", "text")
    net = toxicity.trained(inner, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.toxicity(inner, net).filter(f"score < {TOXIC}").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Texts without words are copies of each other. A group without any id keeps one of its rows.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark. Texts without words stay; so do all without items."""
    inner, back = shielded(docs, "doc_id", "text")
    out = decontamination.contamination(inner, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.filter("NOT contaminated").select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it, none to two times; texts without words too."""
    return mixing.mixed(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot; columns of these names are overwritten."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

#: The network's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
