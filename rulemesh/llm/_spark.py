"""Small helpers on sessions, tables and checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    It comes from ``spark.checkpoint.dir`` or was set by the caller. Where
    neither is there, a session on one machine (tests) gets a temporary folder,
    and any other raises: executors of a cluster don't share such folders.
    Spark removes checkpoints that nothing refers to any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="rulemesh-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``docs`` needs to clash with it."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_marks(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Three hashes that tell rows of ``docs`` apart unless they are equal in all columns.

    The first two are of id and text together, 128 bits; the third is of all else.
    """
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return [
        F.xxhash64(F.lit(1), name.isNull(), name, text),
        F.xxhash64(F.lit(2), text, name.isNull(), name),
        F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long"),
    ]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with their ``place`` in ``order`` from 0 on, and the sums of ``values`` before them as ``before_`` and the name.

    Rows are dealt out by ranges and sorted; sums of ranges, as many as there
    are partitions, give what stands before each. Rows that tie stand in any
    order.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # fixed now: later steps must see the same ranges, whatever is computed anew
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_part"), nth.alias("_nth")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(v).alias(f"_sum_{v}") for v in values])
    sums = sums.select(
        F.col("_part"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", *(f"_sum_{v}" for v in values))]
    )
    own = [F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_own_{v}") for v in values]
    placed = dealt.select("*", *own).join(F.broadcast(sums), "_part")
    return placed.select(
        *rows.columns, (F.col("_rows") + F.col("_nth")).alias("place"), *[(F.col(f"_sum_{v}") + F.col(f"_own_{v}")).alias(f"before_{v}") for v in values]
    )


def release() -> None:
    """Give freed memory back; an idle Python worker otherwise keeps its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a Python worker keeps from one task to the next, by what it is for.
HELD: dict[str, object] = {}


def drop_others(keeps: str | None) -> None:
    """A function of the module, so that workers run it on their own HELD."""
    for name in HELD.keys() - {keeps}:
        del HELD[name]


def map_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str | None = None
) -> DataFrame:
    """``mapInArrow`` whose workers give their memory back at a task's end.

    Workers serve one operator after another; a task drops what others have
    left in HELD, all but ``keeps``.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)
