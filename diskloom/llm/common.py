"""Helpers that several operators share: scratch tables, skew-proof joins, gapless ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.scratch import TEXT_ROWS, materialize, scratch_path, text_batches

__all__ = ["HEAVY", "TEXT_ROWS", "gapless_rank", "materialize", "scratch_path", "spread_join", "table", "text_batches", "utf8_bytes"]
#: A key is heavy if it holds at least one row in HEAVY: so there are never more than HEAVY heavy keys.
HEAVY = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on key, safe when few keys hold most rows of left.

    right: one row per key, with how many rows of left it has (weight); total: rows of left with a key.
    Keys with weight * HEAVY >= total are at most HEAVY, so they are broadcast; rows of left that found
    theirs there are dealt out by a hash of the whole row and meet no other in the second join.
    how: inner or left. weight is not in the result.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    heavy = right.where(F.col(weight) * HEAVY >= F.lit(total)).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values], F.lit(True).alias("_hit"))
    light = right.where(F.col(weight) * HEAVY < F.lit(total)).select(F.col(key).alias("_lk"), *[F.col(c).alias(f"_l_{c}") for c in values], F.lit(True).alias("_light"))
    kind = left.schema[key].dataType
    one = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    one = one.withColumn("_go", F.when(F.col("_hit"), F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]).cast(kind)).otherwise(F.col(key))).withColumn("_free", F.col("_hit").isNull())
    both = one.join(light, (F.col("_go") == F.col("_lk")) & (F.col("_free") == F.col("_light")), "left")
    if how == "inner":
        both = both.where(F.col("_hit") | F.col("_light"))
    return both.select(*[F.col(f"`{c}`") for c in left.columns], *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values])


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without a gap, no task seeing a whole group.

    Rows are dealt into hash buckets of the order columns; each (group, bucket) is numbered by a window and
    shifted by what the earlier buckets of its group hold. The order is that of (bucket, order columns):
    the same at every run, but not sorted. Counts have groups * buckets rows at most.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    on = F.col("_bucket") == F.col("_b")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = inside.join(before, on, "left")
    return out.select(*[F.col(c) for c in df.columns], (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
