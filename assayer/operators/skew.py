"""Joins and per-group top-k that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import all_of, count_rows
from assayer.specs import SpecError

def hot_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys holding at least ``share`` of the rows: never more than 1/share of them.

    The rows are counted when this is called, once; the few keys found come back as a local table.
    """
    if not 0 < share <= 1:
        raise SpecError("skew share must be in (0, 1]")
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(count_rows().alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).scalar()
    known = all_of([F.col(n).isNotNull() for n in names])
    hot = counts.where(known & (F.col("_n") >= F.lit(share) * total)).drop("_n")
    return df.sparkSession.createDataFrame(hot.collect(), hot.schema)


def _hashable(data_type: T.DataType) -> bool:
    """Maps cannot be hashed, nor what holds them."""
    if isinstance(data_type, T.StructType):
        return all(_hashable(f.dataType) for f in data_type)
    if isinstance(data_type, T.ArrayType):
        return _hashable(data_type.elementType)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    pairs: list[tuple[str, str]],
    how: str,
    share: float = 0.05,
    salts: int = 64,
) -> DataFrame:
    """Inner or left equi join whose hot keys are spread over ``salts`` tasks.

    The left rows of a hot key get one of ``salts`` salts, and the right rows of that key
    are repeated once per salt. Cold keys are left alone. The list of hot keys is at most
    1/share rows, so broadcasting it is bounded by construction.
    """
    if how not in ("inner", "left"):
        raise SpecError(f"a salted join cannot be {how}")
    left_keys, right_keys = [p[0] for p in pairs], [p[1] for p in pairs]
    hot = hot_keys(left, left_keys, share).withColumn("_hot", F.lit(True))
    helpers = ["_hot", *[f"_k{i}" for i in range(len(pairs))]]
    zero = F.lit(0).cast("bigint")

    def marked(df: DataFrame, keys: list[str]) -> DataFrame:
        same = all_of([F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)])
        return df.join(F.broadcast(hot), same, "left")

    # The values and the input partition, so that copies spread too and a retried task computes
    # the same salt again. Maps cannot be hashed, and names a join repeats cannot be told apart.
    hashed = [F.col(k) for k in left_keys]
    once = [f for f in left.schema if _hashable(f.dataType) and left.columns.count(f.name) == 1]
    hashed += [F.col(f"`{f.name}`") for f in once]
    spread = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(salts))
    salted_left = (
        marked(left.withColumn("_lspread", spread), left_keys)
        .withColumn("_lsalt", F.when(F.col("_hot"), F.col("_lspread")).otherwise(zero))
        .drop("_lspread", *helpers)
    )
    every_salt = F.sequence(zero, F.lit(salts - 1).cast("bigint"))
    salted_right = (
        marked(right, right_keys)
        .withColumn("_rsalt", F.explode(F.when(F.col("_hot"), every_salt).otherwise(F.array(zero))))
        .drop(*helpers)
    )
    on = all_of([F.col(lk) == F.col(rk) for lk, rk in pairs] + [F.col("_lsalt") == F.col("_rsalt")])
    return salted_left.join(salted_right, on, how).drop("_lsalt", "_rsalt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group in the given order.

    A first pass takes the first k of every group and input partition, so a group with most of
    the rows is not sorted whole in one task; the second one takes the first k of those.
    """
    if k < 1:
        return df.limit(0)
    salted = df.withColumn("_salt", F.spark_partition_id())
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")
