"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next stage's documents. All stages but
the last return the columns of ``documents``, whatever other columns ``docs``
has. Null and empty texts, null ids, repeated rows, ties, very long texts and
empty tables have a defined result in every stage; its function or the operator
that it calls says which.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.llm._spark import read_table, remove, shared_folder
from rulemesh.llm.mixing import whole_documents
from rulemesh.llm.packing import pack, tokenizer_path
from rulemesh.llm.pii import configured_key, pseudonymise
from rulemesh.llm.quality import keep_good, train
from rulemesh.llm.simhash import keep_one


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the boosted trees score 0.5 or more; they learn from the labels of ``docs``.

    A null text scores as an empty one; rows with a null or repeated id are
    scored each by its own text; without labels every score is 0.5 and all stay.
    """
    return keep_good(docs, train(docs, read_table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest id, null ids last; see ``keep_one``."""
    return keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced; ``n_chars`` is that of the new text, null for a null text. See ``pseudonymise``."""
    made = pseudonymise(docs, configured_key(spark))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times, in the order of its slots; see ``whole_documents``."""
    return whole_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; a null text has one token, its end. See ``pack``."""
    return pack(docs, str(tokenizer_path()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("surrogates", surrogates),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Only their folder is left; those of the stages before are deleted once they have been read."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs


#: Boosted trees, tokenizer and keyed hashes aren't SQL; tests compare each stage with a plain version.
ORACLE_SQL = None
