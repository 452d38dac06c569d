"""What the operators share: scratch tables, Arrow batches, table reading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch

#: Rows and bytes that an Arrow batch holds at most (a single longer text aside), so that a Python worker holds few texts at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 50_000


def scratch_path(spark: SparkSession, name: str) -> str:
    return scratch.fresh(spark, name)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there and a lost executor loses nothing."""
    return scratch.cut(df, name)


drop = scratch.drop


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input, as the optimizer estimates them, to a range of documents that one task writes.
RANGE_BYTES = 64 << 20


def ranges_for(df: DataFrame) -> int:
    """As many ranges as the session's shuffles have, or more where the tables that df reads are larger than that many tasks should handle.  Tables of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(partitions(df.sparkSession), -(-sum(x for x in sizes if x < 1 << 60) // RANGE_BYTES))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most so many rows, else as it is (Spark then shuffles and splits skewed keys)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of a sieve at least and at most, a power of two each, about 8 for a key: what is broadcast has a fixed bound.  With more keys than that serves, there is none.
SIEVE_BITS = (1 << 16, 1 << 26)


@dataclass(frozen=True)
class Sieve:
    """A one-hash Bloom filter of a column as rows (_word, _bits); words is None where it would let nearly everything through."""

    words: DataFrame | None
    bits: int

    def place(self, key):
        h = F.xxhash64(key, F.lit(11))
        return F.shiftrightunsigned(h, 6).bitwiseAND(self.bits // 64 - 1).cast("int"), h.bitwiseAND(63).cast("int")


def sieve(keys: DataFrame, column: str) -> Sieve:
    """The sieve of a column of a written table, sized by its rows and written once."""
    least, most = SIEVE_BITS
    bits = 1 << max(least.bit_length() - 1, (8 * keys.count()).bit_length())
    if bits > 2 * most:
        return Sieve(None, most)
    made = Sieve(None, min(bits, most))
    word, bit = made.place(F.col(column))
    words = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy("_word").agg(F.expr("bit_or(_bit)").alias("_bits"))
    return Sieve(table(words, "sieve"), made.bits)


def sift(df: DataFrame, column: str, by: Sieve, inside: bool = True) -> DataFrame:
    """The rows of df whose column may be among the sieve's keys: all that are, and few others; or, if not inside, all other rows.  Spares a shuffle the rows that would find no partner.  df has no column _word, _bits, _at or _bit."""
    if by.words is None:
        return df if inside else df.filter(F.lit(False))
    names = df.columns
    word, bit = by.place(F.col(column))
    held = df.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(by.words), F.col("_at") == F.col("_word"), "inner" if inside else "left")
    there = F.call_function("shiftright", F.coalesce("_bits", F.lit(0).cast("bigint")), F.col("_bit")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return held.filter(there if inside else ~there).select(*names)


def wrapped(df: DataFrame, **keys) -> DataFrame:
    """One column ``row`` with all of df's columns, whatever their names, and the named keys beside it."""
    return df.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in keys.items()))


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select("row.*")
