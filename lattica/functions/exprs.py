"""Scalar expressions and order-independent accurate sums, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ieee_div(x: Column, y: Column) -> Column:
    """x / y as IEEE 754 has it: signed infinities and NaN for zero divisors, where ANSI mode would raise."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / y)


#: Bits of a digit of exact sums, and the exponent of the last bit a double can have.
DIGIT, LAST_BIT = 32, -1074


def _scaled(value: Column, place: Column, sign: int) -> Column:
    """value * 2 ** (sign * the exponent of the digit at a place), in two factors, as one may lie beyond the doubles."""
    exponents = [sign * (DIGIT * k + LAST_BIT) for k in range((1100 - LAST_BIT) // DIGIT)]
    clipped = [max(-1022, min(1023, e)) for e in exponents]
    factor = lambda es: F.get(F.array(*(F.lit(2.0**e) for e in es)), place)
    return value * factor(clipped) * factor([e - c for e, c in zip(exponents, clipped, strict=True)])


def accurate_sums(df: DataFrame, keys: list[str], value: Column, name: str = "v") -> DataFrame:
    """Exact sum of ``value`` for each group, rounded to within one unit in the last place: equal bits in any order.

    A double is cut at fixed powers of two into whole numbers, its digits of 32 bits, three at most from the one its
    exponent tells.  Digits of like place add up exactly as 64-bit integers, so the aggregation by keys and place
    combines map-side and merges in whatever order; a second one brings a group's few places together, carries,
    and adds the digits up from the lowest.  One pass over the input.  Groups with infinite or NaN values get the sum
    of these.  More than 2 ** 31 values of one key that share an exponent's digit raise an overflow; without keys
    each input partition is a group of its own first.
    """
    v, split = value.cast("double"), [F.spark_partition_id().alias("_part")] if not keys else []
    finite = F.abs(v) < float("inf")
    own = df.select(*keys, *split, v.alias("_v"), finite.alias("_finite")).where("_v IS NOT NULL")
    top = F.greatest(F.floor((F.log2(F.abs("_v")) - LAST_BIT) / DIGIT), F.lit(2)).cast("int")
    own = own.withColumn("_top", F.when(F.col("_finite"), F.when(F.col("_v") == 0, 2).otherwise(top)))
    rest, digits = F.when(F.col("_finite"), F.col("_v")).otherwise(0.0), []
    for k in range(3):
        place = F.coalesce(F.col("_top"), F.lit(2)) - k
        own = own.withColumn(f"_r{k}", rest).withColumn(f"_d{k}", _scaled(F.col(f"_r{k}"), place, -1).cast("bigint"))
        rest = F.col(f"_r{k}") - _scaled(F.col(f"_d{k}").cast("double"), place, 1)
        digits.append(F.sum(f"_d{k}").alias(f"_d{k}"))
    placed = own.groupBy(*keys, *(["_part"] if split else []), "_top").agg(*digits, F.sum(F.when(~F.col("_finite"), F.col("_v"))).alias("_odd"))
    merged = placed.groupBy(*keys).agg(F.collect_list(F.when(F.col("_top").isNotNull(), F.struct("_top", "_d0", "_d1", "_d2"))).alias("_p"), F.sum("_odd").alias("_odd"), F.min("_top").alias("_low"), F.max("_top").alias("_high"))
    at = lambda k: F.aggregate("_p", F.lit(0).cast("bigint"), lambda s, p: s + F.when(p._top == k, p._d0).when(p._top == k + 1, p._d1).when(p._top == k + 2, p._d2).otherwise(F.lit(0).cast("bigint")))
    places = F.sequence(F.col("_low") - 2, F.col("_high") + 2)  # room for the carries
    columns = F.transform(places, lambda k: F.struct(k.alias("k"), at(k).alias("s")))
    half, start = 1 << (DIGIT - 1), F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(0.0).alias("total"))

    def carry(acc: Column, c: Column) -> Column:
        up = F.shiftright(acc.carry + c.s + half, DIGIT)  # to the nearest, so that lower digits never cancel higher ones
        digit = acc.carry + c.s - F.shiftleft(up, DIGIT)
        return F.struct(up.alias("carry"), (acc.total + _scaled(digit.cast("double"), F.least(c.k, F.lit((1100 - LAST_BIT) // DIGIT - 1)), 1)).alias("total"))

    return merged.select(*keys, F.coalesce("_odd", F.aggregate(columns, start, carry, lambda acc: acc.total)).alias(name))
