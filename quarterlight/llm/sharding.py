"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global number 0..N-1 that depends on the rows alone (not on
files, partitions or the cluster), and a keyed Feistel network with cycle walking
permutes these numbers. The permuted number y gives shard ``y mod n`` and slot
``y div n``: shard sizes differ by one row at most and slots have no gaps. The
inverse network finds the row of any (shard, slot) without a lookup.

Equal rows (same id, size and checksum) are counted before any shuffle, so a
repeated row cannot overload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Row numbers are given bucket by bucket; the table of bucket offsets has this many rows.
BUCKETS = 4096
#: Bound of the inline walk. The domain has fewer than sqrt(N)+1 points outside 0..N-1,
#: so below 4096 rows the walk always ends within it, and above it the chance
#: that one does not is under 64**-64; such a row would raise an error.
WALK = 64
#: Cells of equal rows are spread out in two steps of at most this many.
SPREAD = 1 << 16


def _round_keys(seed: int, rounds: int) -> Column:
    return F.array(*[F.struct(F.lit(seed * 1_000_003 + 2 * i).alias("a"), F.lit(seed * 1_000_003 + 2 * i + 1).alias("b")) for i in range(rounds)])


def permute(x: Column, a: Column, b: Column, seed: int, rounds: int = 4) -> Column:
    """One pass of the network on 0..a*b-1: two half-rounds per key pair."""

    def step(state: Column, key: Column) -> Column:
        left = F.pmod(state["l"] + F.pmod(F.xxhash64(state["r"], key["a"]), a), a)
        right = F.pmod(state["r"] + F.pmod(F.xxhash64(left, key["b"]), b), b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    return F.aggregate(_round_keys(seed, rounds), start, step, lambda s: s["r"] * a + s["l"])


def walk(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The permutation of 0..n-1: apply the network until the value is inside."""
    first = permute(x, a, b, seed)
    rest = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), first,
        lambda y, _: F.when(y < n, y).otherwise(permute(y, a, b, seed)),
    )
    return F.when(first < n, first).otherwise(rest)


def shard_rows(df: DataFrame, n_shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``df``.

    size is the text's UTF-8 bytes plus 1 (a null text: 1, its checksum null). The law
    is ``rows``; adding a shard is not key-stable, so grown_shard is null. Null ids and
    repeated rows are ordinary rows; equal rows take consecutive row numbers. An empty
    table gives no rows. Other columns of ``df`` are not read.
    """
    text = F.col(text_col)
    cells = (
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)))
    )
    everything = Window.orderBy("bucket")
    offsets = (
        cells.groupBy("bucket")
        .agg(F.sum("m").alias("rows"))
        .select(
            "bucket",
            F.coalesce(F.sum("rows").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
            F.sum("rows").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        cells.withColumn("before", F.coalesce(F.sum("m").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")  # BUCKETS rows at most
        .withColumn("first", F.col("offset") + F.col("before"))
    )
    chunks = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / SPREAD).cast("long"))))
    rows = chunks.withColumn(
        "i", F.explode(F.sequence(F.col("chunk") * SPREAD, F.least(F.col("m"), (F.col("chunk") + 1) * SPREAD) - 1))
    )
    side = rows.withColumn("a", F.ceil(F.sqrt("n")).cast("long")).withColumn("b", F.ceil(F.col("n") / F.col("a")).cast("long"))
    placed = side.withColumn("y", walk(F.col("first") + F.col("i"), F.col("n"), F.col("a"), F.col("b"), seed))
    y = F.when(F.col("y") < F.col("n"), F.col("y")).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(y, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(y / F.lit(n_shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
