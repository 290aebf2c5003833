"""Sharding by longest-processing-time scheduling.

Groups that must stay together are sorted by size and each goes to the least loaded shard, found through a heap.
The heap runs over a bounded number of items: groups that weigh more than 1/1024 of a shard (at most 1024 a shard can
exist) go one by one; lighter groups are first gathered by hash in cells of nine sizes, each half the one before, so
that the last and smallest cells even out what the large ones leave.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A group above 1 / (shards * HEAVY) of all bytes is placed by itself.
HEAVY = 1024
#: Cells of each of the nine sizes.
CELLS = 1536
#: Rows of a shard that are numbered in one task.
NUMBERED = 100_000


def longest_first(sizes: list[tuple[int, object]], shards: int) -> dict:
    """Shard of each item: largest first, to the least loaded shard, ties by shard number and item."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_groups(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` to rows that have ``group_key`` (binary) and ``size``; rows of a key stay together."""
    spark = rows.sparkSession
    spread = F.pmod(F.xxhash64("group_key"), F.lit(256))
    level = F.floor(F.lit(8) - F.log2(spread + 1)).cast("int")
    cell = level * CELLS + F.pmod(F.xxhash64(F.lit(1), "group_key"), F.lit(CELLS)).cast("int")
    groups = cut(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")).withColumn("cell", cell), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") > F.lit(total // (shards * HEAVY))
    big = [(r.bytes, bytes(r.group_key)) for r in groups.filter(heavy).select("bytes", "group_key").collect()]
    small = [(r.bytes, r.cell) for r in groups.filter(~heavy).groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()]
    placed = longest_first([(n, (1, k)) for n, k in big] + [(n, (0, k)) for n, k in small], shards)
    # Both tables are bounded by constants: HEAVY * shards keys, 9 * CELLS cells.
    by_key = spark.createDataFrame([(k[1], s) for k, s in placed.items() if k[0]] or [], "group_key binary, key_shard int")
    by_cell = spark.createDataFrame([(k[1], s) for k, s in placed.items() if not k[0]], "cell int, cell_shard int")
    return (
        rows.withColumn("cell", cell)
        .join(F.broadcast(by_key), "group_key", "left")
        .join(F.broadcast(by_cell), "cell", "left")
        .withColumn("shard", F.coalesce("key_shard", "cell_shard"))
        .drop("cell", "key_shard", "cell_shard")
    )


def number_slots(rows: DataFrame, n: int, shards: int, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... without a gap in every shard.  Each shard is numbered in parts of bounded size."""
    parts = max(4, -(-n // (shards * NUMBERED)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order))
    return rows.withColumn("row", within).join(starts, ["shard", "part"]).withColumn("slot", F.col("begin") + F.col("row") - 1).drop("part", "row", "begin")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``bytes``.

    Documents of equal text stay together.  ``size`` is the UTF-8 bytes of the text plus 8.  Defined results: a null
    text has size 8, a null ``text_crc32`` of 0 and its own group, apart from empty texts; a null id is kept;
    repeated rows get a slot each; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(data) + 8).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(data, 256)), F.lit(b"")).alias("hash"),
            text.isNull().alias("no_text"),
        ).select("doc_id", "size", "text_crc32", F.when(F.col("no_text"), F.lit(b"")).otherwise(F.col("hash")).alias("group_key")),
        "shard-rows",
    )
    out = number_slots(shard_groups(rows, shards), rows.count(), shards, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
