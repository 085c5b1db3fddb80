"""Five stages that make packed sequences of training text from documents.

Each stage takes (spark, docs, sf_dir) and returns the columns of `docs`, but
for the last, which returns the packed pieces. Toxic documents go, then all but
one document of each group of near copies, then documents that hold benchmark
passages; secrets are replaced in the texts of the rest, and these are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeflow.llm.common import Scratch, load, stage
from cladeflow.llm.decontamination import drop_contaminated
from cladeflow.llm.ngram_join import drop_near_copies
from cladeflow.llm.packing import pack_documents
from cladeflow.llm.secrets import redact
from cladeflow.llm.tokens import vocabulary
from cladeflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more; null and empty texts are scored too, repeated ids each by its own text."""
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the least id; texts without words all stay."""
    return drop_near_copies(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth of the words lies in benchmark windows; null and empty texts stay."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; null and empty texts are their end id alone, and an empty table has none."""
    return pack_documents(docs, vocabulary(), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("packing", packing),
]

#: The first stage searches nearest examples and the last tokenizes: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = scratch.keep(stage(step(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
