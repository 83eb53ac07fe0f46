"""A corpus pipeline of five stages, each working on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet
to the shared folder and reads again for the next. All but the last return the columns of
documents. A row is judged by itself and never goes because another has its id, so null and
repeated ids are safe; null texts count as empty and stay, but for all but one of them, which
are exact copies; an empty table gives none; further columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.decontamination import decontaminate
from keyloom.llm.exact_dedup import deduplicate
from keyloom.llm.ngram_join import drop_near_copies
from keyloom.llm.packing import grouped, pieces
from keyloom.llm.queries import table, tokenizer
from keyloom.llm.storage import materialize
from keyloom.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that score 0.5 or more; the labels are those of sf_dir."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest doc_id."""
    return deduplicate(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group that links connect."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out rows with a window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of up to 1024 tokens."""
    found = pieces(docs, tokenizer())
    narrow = found.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "tier_index")
    return grouped(materialize(narrow, "pieces"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: A trained model and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
