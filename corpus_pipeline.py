"""From raw documents to shards: five stages, each a table of the next.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the
columns of ``documents``; the last one returns the shard and slot of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinery.llm import mixing, ngramjoin, sharding, simhash, tiling, toxicity
from skeinery.llm.common import scratch, table

#: Documents that score as much or more are rejected: stricter than the operator's own 0.3, to lose fewer clean ones.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; it learns from the labels of the training folds.

    Each row is judged by its text alone, so repeated rows fare alike; null, empty and
    wordless texts have no evidence and stay; with no toxic label nothing goes; an
    empty table stays empty.  A score of exactly TOXIC is rejected.
    """
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar five-word shingles (0.8 or more) stays.

    That of the smallest doc_id, a null one last; of several texts under it one (the
    least by key of the text), of repeated rows one.  Null and wordless texts are
    alike, so one of them stays; an empty table stays empty.  Fingerprints find the
    groups; what connects two of them and was not found is then joined exactly.
    """
    return simhash.keep_first(docs, 5, 0.8, complete=ngramjoin.missing_links)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words, in tiles of five or more, go.

    Exactly half is a leak.  Null and empty texts hold nothing and stay, repeated rows
    fare alike; without benchmark items, or with none that has words, nothing goes.
    """
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix in which every document is seen once at least and no source more than twice.

    A null source is a source of its own; rows equal in all columns are drawn
    together; wordless texts are seen once; an empty table stays empty.
    """
    return mixing.mix_rows(docs, entropy=None, repeats=2.0, epochs=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of the mix.

    Null texts are one group, as empty ones are; repeated rows have slots of their
    own; an empty table gives an empty result.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier and the fingerprint search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
