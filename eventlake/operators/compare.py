"""Do two tables hold the same rows?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.session import compute_once


def fingerprint(df: DataFrame, sums: list[str], counts: list[str], hashed: bool = False) -> DataFrame:
    """One row that equal tables share: row count, column sums and non-NULL counts.

    With `hashed`, also a sum of row hashes, which does not depend on row order."""
    measures = [F.count("*").alias("row_count")]
    # decimals: a sum of ids over very many rows does not fit a bigint
    measures += [F.sum(F.col(c).cast("decimal(20,0)")).alias(f"sum_{c}") for c in sums]
    measures += [F.count(c).alias(f"count_{c}") for c in counts]
    if hashed:
        columns = [F.col(c) for c in sorted(df.columns)]
        measures.append(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("row_hash"))
    return df.agg(*measures)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows one side has more often than the other, with all values as text.

    `surplus` is positive for the first table. One shuffle serves both directions, and equal
    rows are added up before it."""
    columns = a.columns
    if sorted(columns) != sorted(b.columns):
        raise ValueError(f"different columns: {sorted(columns)} and {sorted(b.columns)}")

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[F.col(c).cast("string").alias(c) for c in columns],
                         F.lit(sign).cast("bigint").alias("_n"))

    both = signed(a, 1).unionByName(signed(b, -1))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


#: Parts that the rows of a day are dealt to by hash, and parts that are looked into row by row, at most.
BUCKETS, HELD_BUCKETS = 4096, 200_000


def _hashes(df: DataFrame, columns: list[str], day: str, sign: int) -> DataFrame:
    texts = [F.col(c).cast("string") for c in sorted(columns)]
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(day).cast("string").alias("_day"), F.lit(sign).cast("bigint").alias("_n"),
                     F.xxhash64(*texts).alias("_h"), F.xxhash64(F.lit(1), *texts).alias("_g")).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int"))


def _unequal(both: DataFrame, *keys: str) -> DataFrame:
    """Keys whose rows differ: sums of row hashes, 128 bits of them, and of signs. Only one row per key and task is shuffled."""
    sums = [F.sum(F.col(c).cast("decimal(20,0)") * F.col("_n")) for c in ("_h", "_g")]
    out = both.groupBy(*keys).agg(F.sum("_n").alias("_rows"), *[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    return out.where("_rows <> 0 or _s0 <> 0 or _s1 <> 0").select(*keys)


def tree_differences(a: DataFrame, b: DataFrame, day: str, held_buckets: int = HELD_BUCKETS) -> DataFrame:
    """differences() of two tables that are nearly equal, by a tree of hashes: days whose sums of row hashes are equal are done with, the
    rows of the others are dealt to buckets by their hash, and only rows of unequal buckets are shuffled and compared.

    day: a column that both tables are read by, such as a day folder. With more unequal buckets than held_buckets all rows of
    the unequal days are compared. Rows differ unseen at odds of about one in 2^128 a bucket."""
    columns = a.columns
    if sorted(columns) != sorted(b.columns):
        raise ValueError(f"different columns: {sorted(columns)} and {sorted(b.columns)}")
    both = _hashes(a, columns, day, 1).unionByName(_hashes(b, columns, day, -1))
    days = [r[0] for r in _unequal(both, "_day").collect()]
    # days are few; the filter reaches the scan of tables that are partitioned by them
    known = [d for d in days if d is not None]
    inside = F.col(day).cast("string").isin(known) | (F.col(day).isNull() if None in days else F.lit(False))
    left = _hashes(a.where(inside), columns, day, 1).unionByName(_hashes(b.where(inside), columns, day, -1))
    buckets = compute_once(_unequal(left, "_day", "_bucket"))
    if buckets.limit(held_buckets + 1).count() <= held_buckets:
        b2 = F.broadcast(buckets.withColumnsRenamed({"_day": "_d", "_bucket": "_b"}))  # counted just now
        left = left.join(b2, F.col("_day").eqNullSafe(F.col("_d")) & (F.col("_bucket") == F.col("_b")), "left_semi")
    return left.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def same_answer(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()
