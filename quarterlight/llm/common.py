"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (space, \t, \n, \v, \f, \r).
BLANKS = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Frequent function words of the languages served.
FUNCTION_WORDS = (
    "the of and to in a is that for it on as with was be by this are or an from at not which "
    "de la le les et des un une du en dans que qui pour au sur par est pas plus "
    "der die das und den zu von mit im für auf ein eine nicht ist dem "
    "el los las y por con una para del se su al lo como no es"
).split()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the one named by ``spark.checkpoint.dir``; only a session on one machine
    that names none (as in tests) gets a temporary one, any other raises an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def packed_rows(df: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``df``, beside the columns in ``more``.

    Operators that return whole rows work on this, so none of their own columns can clash
    with one of the caller's; ``unpacked_rows`` gives the caller's columns back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def slices(batches, rows: int = 1024):
    """Arrow batches in parts of at most ``rows`` rows, so that a task holds the results of few rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: Keys that are spread over several tasks in a join, at most, and tasks for each of them.
HOT_KEYS, SHARES = 1024, 32


def join_hot(left: DataFrame, right: DataFrame, on: dict[str, str], weight: str, spread: list[str]) -> DataFrame:
    """Inner join on ``left`` columns = ``right`` columns, ``right`` having one row a key.

    ``right[weight]`` tells how many left rows a key has. The heaviest keys (HOT_KEYS at
    most, so they can be broadcast) are dealt over SHARES tasks each by ``spread``.
    """
    own = [F.col(r).alias(f"_hot_{i}") for i, r in enumerate(on.values())]
    hot = F.broadcast(right.orderBy(F.desc(weight), *on.values()).limit(HOT_KEYS).select(*own, F.lit(True).alias("_hot")))
    marks = [f"_hot_{i}" for i in range(len(on))]

    def meets(names) -> Column:
        out = F.lit(True)
        for name, mark in zip(names, marks, strict=True):
            out = out & (F.col(name) == F.col(mark))
        return out

    share = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SHARES)).cast("int")).otherwise(F.lit(0))
    shares = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, meets(on.keys()), "left").withColumn("_share", share).drop("_hot", *marks)
    b = right.join(hot, meets(on.values()), "left").withColumn("_part", F.explode(shares)).drop("_hot", *marks)
    same = F.col("_share") == F.col("_part")
    for x, y in on.items():
        same = same & (F.col(x) == F.col(y))
    return a.join(b, same).drop("_share", "_part")
