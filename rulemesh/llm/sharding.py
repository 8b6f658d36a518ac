"""Balanced contiguous shards from prefix sums of byte sizes.

Documents are dealt out by ranges of their ids and sorted; each part's total
bytes and rows give the part's place in the whole, a running sum inside the
part gives each document's, and the order is cut where the sum passes equal
targets. Only ids, sizes and checksums are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, partitions, read_table

SHARDS = 40
#: Bytes that a document costs besides its text.
OVERHEAD = 16


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD
) -> DataFrame:
    """(``id_col``, size, text_crc32, shard, slot, first_byte) of each row of ``docs``.

    Order: id (null first), then checksum and size, so repeated rows stand
    together. A document goes to the shard in which its middle byte falls, so a
    shard misses its target by less than one document on either side; with few
    or large documents some shards stay empty. ``slot`` counts from 0 within a
    shard. A null text is empty; a very long one may fill several shards' share,
    which then stay empty. Other columns, whatever their names, are not read; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = ["id", "text_crc32", "size"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # fixed now: later steps must see the same parts, whatever is computed anew
    dealt = cut(
        dealt.select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"),
        )
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    places = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are partitions
    placed = dealt.withColumn("own_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        F.broadcast(places), "part"
    )
    placed = placed.select(
        "id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.col("own_before")).alias("first_byte"),
        (F.col("rows_before") + F.col("nth")).alias("row"),
        "total",
    )
    middle = 2 * F.col("first_byte") + F.col("size")
    placed = placed.withColumn(
        "shard", F.floor(middle * F.lit(shards).cast("long") / (2 * F.col("total"))).cast("int")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    # as many rows as there are shards
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "first_byte"
    )


def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document; nulls, ties, repeated rows and long texts as in ``shard``."""
    return shard(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
