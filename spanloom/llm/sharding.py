"""Contiguous shards of near-equal bytes by a distributed prefix sum.

The law is ``bytes``. Documents are put in ascending ``doc_id`` order by a range
partitioning; every partition's total is summed, the totals' running sum gives
each partition its offset, and a document goes to the shard in whose equal slice
of the total its first byte falls. Only three numbers per row are shuffled,
never a text, and only one row per partition and per shard is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, shuffle_partitions

ROW_BYTES = 8


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and the ``carried`` columns for every row."""
    n = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        *carried,
    )
    slim = materialize(
        slim.repartitionByRange(n, "doc_id", "text_crc32", "size").withColumn("block", F.spark_partition_id()), "shards"
    )
    # One row per range partition: a single small task adds them up.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        slim.groupBy("block")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "block",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    within = Window.partitionBy("block").orderBy("doc_id", "text_crc32", "size")
    placed = (
        slim.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(offsets), "block")
        .withColumn("first_byte", F.col("byte_offset") + F.col("upto") - F.col("size"))
        .withColumn("nth", F.col("row_offset") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"cast(first_byte * {n_shards} div total as int)"))
    )
    heads = placed.groupBy("shard").agg(F.min("nth").alias("head"))
    return placed.join(F.broadcast(heads), "shard").withColumn("slot", (F.col("nth") - F.col("head")).cast("long"))


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    A null text has 0 bytes (size 8, CRC 0); a null id sorts first. Repeated rows
    each get a slot of their own, rows of one id in order of CRC and size. An
    empty table gives no rows. Other columns of ``docs`` are not read. A text
    larger than a shard's share leaves the next shards' slices short or empty,
    since texts are never cut.
    """
    return _placed(docs, n_shards, id_col, text_col).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as one folder ``shard_no=K`` per shard, rows in slot order within each file.

    Every row goes to the shard that ``assign_shards`` names for it, repeated rows
    and rows without id or text included; columns stay as they are, whatever their names (one
    called ``shard_no`` is an error). An empty table writes no folder.
    """
    if "shard_no" in (c.lower() for c in docs.columns):
        raise ValueError("shard_no names the folders")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    (
        _placed(docs, n_shards, id_col, text_col, row)
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("row.*", F.col("shard").alias("shard_no"))
        .write.partitionBy("shard_no")
        .parquet(path)
    )
