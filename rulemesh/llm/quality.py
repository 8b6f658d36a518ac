"""Quality classifier: boosted trees over document statistics.

The trees are fitted on the driver over the statistics of at most
``sample_rows`` labelled documents (a fixed bound, whatever the corpus holds);
only those documents' statistics reach the driver. Scoring is one pass over
all texts without a shuffle. Inputs of a score are statistics of the text
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import map_arrow, read_table
from ._text import slices, text_column
from .gbdt import Forest, fit
from .stats import FEATURES, features

#: Labelled documents that the trees are fitted on, at most; those of the lowest hashes.
SAMPLE_ROWS = 20_000


def held_out(id_col: str = "doc_id"):
    """True for the third of all ids that no model may learn from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values = features(text_column(part))
            label = part.column(1).cast(pa.float64())
            yield pa.RecordBatch.from_arrays([label, *map(pa.array, values.T)], names=["y", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on documents whose ids are not held out; rows with a null label or id don't take part."""
    sample = (
        labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample_rows)
    )
    # the sample has at most sample_rows rows of two numbers
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")
    found = map_arrow(rows, _statistics, ", ".join(f"{c} double" for c in ("y", *FEATURES))).toPandas()
    # rows arrive in no fixed order; sums of floats depend on it
    found = found.sort_values(list(found.columns), ignore_index=True)
    return fit(found[list(FEATURES)].to_numpy(), found["y"].to_numpy())


def score(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) of each row: how likely its label is 1. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = model.predict(features(text_column(part)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Forest, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns, whatever their names.

    Each row is scored by its own text: null texts as empty ones, null and
    repeated ids and repeated rows like any others; a score of just ``least``
    stays. A very long text is one step of its worker. An empty table gives an
    empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                good = model.predict(features(text_column(part, text_col))) >= least
                if good.any():
                    yield part.filter(pa.array(np.asarray(good)))

    return map_arrow(docs, run, docs.schema)


def op4_boosted_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Null and empty texts, null and repeated ids and ties all get a row each;
    without labels every score is 0.5; a very long text is one step of its
    worker. Other columns of the table are not read.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
