"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage is written as Parquet in the shared folder and read again as the
documents of the next. The stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from admitlens.llm import contamination, mixing, simhash, token_file, toxicity
from admitlens.llm.common import stored, table
from admitlens.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go (0.3 or more). Null and empty texts score the
    rate of texts without telling terms; repeated rows stay or go together."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id;
    of its repeated rows one. Null and empty texts are one group."""
    return simhash.without_near_duplicates(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of the benchmark in them go (a twentieth of their
    words). Null and empty texts have no words and stay, as all do without items."""
    return contamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them; equal rows stand
    or fall together. A null source is one of its own. Texts without words weigh
    nothing and come as often as all of their shard do."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts
    have their end id alone; no documents give no rows."""
    return token_file.token_file(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("decontamination", without_contaminated),
    ("mixing", mixed),
    ("token_output", tokens),
]

# Fingerprints, nearest examples and byte-pair encoding are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
