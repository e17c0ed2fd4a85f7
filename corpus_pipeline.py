"""From raw documents to token ids: quality filter, line dedup, near-duplicate removal, benchmark
decontamination, encoding. Every stage reads what its predecessor kept, written as Parquet; all but
the last return the columns of documents, with all others that the input has, whatever their names.

Defined cases of all stages: a null text is an empty one, and a null lang, source or n_chars is given
back as it is; an empty table gives an empty one. By stage:

* quality_filter: empty texts are scored like others; without labels of both kinds all stay; repeated
  rows stay or go alike, and a score of just 0.5 stays; a long text is scored whole.
* line_dedup: rows of one doc_id lose a line alike; the largest doc_id keeps it, so ties don't occur;
  rows without an id are one document smaller than all others; documents that lose all lines stay,
  empty.
* near_duplicates: the smallest doc_id of a group stays, of several texts with that id the one with the
  smallest hash, of rows equal in both one; rows without an id or without words stay, but equal rows
  without words are one.
* decontamination: empty texts are clean; repeated rows stay or go alike; an empty benchmark, or items
  without words, leave all.
* encoding: empty texts have no ids; repeated rows are each encoded; a null doc_id stays null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import bpe, common, decontaminate, jaccard, lines, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good, learnt from all labels."""
    return quality.kept(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), F.lit(False)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many others have."""
    return lines.applied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles alike by 0.8 or more."""
    return jaccard.deduplicated(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding them."""
    import public_tokenizers

    return bpe.round_trips(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Two stages learn or align, which SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, with files between them in the session's checkpoint folder. The
    result reads the last stage's files, which stay until the caller deletes them (inputFiles())."""
    top = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if k:  # what the stage before kept is read no more
            before = f"{top}/{k - 1}-{STAGES[k - 1][0]}"
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(before), True)
    return docs
