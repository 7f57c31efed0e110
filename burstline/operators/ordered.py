"""Previous rows, running sums and values at ranks of a key's rows in order of time, with no task that sees a whole key.

A key's time is cut into buckets of ``WIDTH``, these into buckets of ``FAN`` of them, and so on.
Windows see one bucket; what it needs from before it (a last row, a sum) is carried from the buckets
before, found in the same way one level up. The last level is an array, with an entry for each 34 hours of signal time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 120.0
#: Bits of a bucket's number that one level takes away.
FAN_BITS = 10
LEVELS = 1
#: Bucket of null times, which come first.
_NO_TIME = -(1 << 60)


def _bucket(t: str) -> Column:
    return F.coalesce(F.floor(F.col(t) / WIDTH).cast("long"), F.lit(_NO_TIME))


def _carried(table: DataFrame, keys: tuple[str, ...], combine: Callable[[str, str], Column], before: Callable[[str, Window], Column], join: Callable[[Column, Column], Column], fold: Callable[[Column], Column], level: int = 0) -> DataFrame:
    """(keys, __b, __before) for ``table`` (keys, __b, __value): what comes from all buckets of the key before ``__b``.

    ``combine`` aggregates the values of buckets, ``before`` looks back inside a window, ``join`` adds
    what is carried from further back, ``fold`` gives the carried values of an ordered array of (b, value).
    """
    if level == LEVELS:
        rows = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__b").alias("b"), F.col("__value").alias("value")))).alias("all"))
        return rows.select(*keys, F.inline(fold(F.col("all"))))
    table = table.withColumn("__up", F.shiftright("__b", FAN_BITS))
    upper = table.groupBy(*keys, "__up").agg(combine("__value", "__b").alias("__value")).withColumnRenamed("__up", "__b")
    carried = _carried(upper, keys, combine, before, join, fold, level + 1).select(*keys, F.col("__b").alias("__up"), F.col("__before").alias("__far"))
    inside = table.withColumn("__near", before("__value", Window.partitionBy(*keys, "__up").orderBy("__b")))
    return inside.join(carried, [*keys, "__up"]).select(*keys, "__b", join(F.col("__near"), F.col("__far")).alias("__before"))


def with_previous(rows: DataFrame, columns: tuple[str, ...], name: str = "previous", keys: tuple[str, ...] = ("video_id",), t: str = "t", seq: str = "seq") -> DataFrame:
    """``rows`` with ``name``, a struct of ``columns`` of the key's previous row by ``t`` and ``seq``; null at its first.

    Keys must not be null. Null times come first.
    """
    rows = rows.withColumn("__b", _bucket(t))
    value = F.struct(*columns)
    lasts = rows.groupBy(*keys, "__b").agg(F.max_by(value, F.struct(t, seq)).alias("__value"))
    before = lambda v, w: F.lag(v).over(w)
    fold = lambda a: F.transform(a, lambda x, i: F.struct(x["b"].alias("__b"), F.when(i > 0, F.get(a, i - 1)["value"]).alias("__before")))
    carried = _carried(lasts, keys, lambda v, b: F.max_by(v, b), before, F.coalesce, fold)
    own = F.lag(value).over(Window.partitionBy(*keys, "__b").orderBy(t, seq))
    return rows.withColumn(name, own).join(carried, [*keys, "__b"]).withColumn(name, F.coalesce(name, "__before")).drop("__b", "__before")


def with_running_sum(rows: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("video_id",), t: str = "t", seq: str = "seq") -> DataFrame:
    """``rows`` with ``name``: the sum of the integers ``value`` over the key's rows up to each, by ``t`` and ``seq``."""
    rows = rows.withColumn("__b", _bucket(t)).withColumn("__v", F.coalesce(value.cast("long"), F.lit(0)))
    sums = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__value"))
    before = lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = lambda a, i: F.aggregate(F.slice(a, 1, i), F.lit(0).cast("long"), lambda s, x: s + x["value"])
    fold = lambda a: F.transform(a, lambda x, i: F.struct(x["b"].alias("__b"), total(a, i).alias("__before")))
    carried = _carried(sums, keys, lambda v, b: F.sum(v), before, lambda near, far: F.coalesce(near, F.lit(0)) + far, fold)
    own = F.sum("__v").over(Window.partitionBy(*keys, "__b").orderBy(t, seq).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, own).join(carried, [*keys, "__b"]).withColumn(name, F.col(name) + F.col("__before")).drop("__b", "__v", "__before")


def with_running_max(rows: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("video_id",), t: str = "t", seq: str = "seq") -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` over the key's rows up to each, by ``t`` and ``seq``; null while all are."""
    rows = rows.withColumn("__b", _bucket(t)).withColumn("__v", value)
    largest = rows.groupBy(*keys, "__b").agg(F.max("__v").alias("__value"))
    before = lambda v, w: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    upto = lambda a, i: F.array_max(F.transform(F.slice(a, 1, i), lambda x: x["value"]))
    fold = lambda a: F.transform(a, lambda x, i: F.struct(x["b"].alias("__b"), upto(a, i).alias("__before")))
    carried = _carried(largest, keys, lambda v, b: F.max(v), before, F.greatest, fold)
    own = F.max("__v").over(Window.partitionBy(*keys, "__b").orderBy(t, seq).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, own).join(carried, [*keys, "__b"]).withColumn(name, F.greatest(name, "__before")).drop("__b", "__v", "__before")


def count_windows(rows: DataFrame, size: int, keys: tuple[str, ...] = ("video_id",), t: str = "t", seq: str = "seq") -> DataFrame:
    """``rows`` with ``window``: every ``size`` rows of a key in a row, by ``t`` and ``seq``, from 0."""
    rows = with_running_sum(rows, F.lit(1), "window", keys, t, seq)
    return rows.withColumn("window", F.floor((F.col("window") - 1) / size).cast("long"))


def size_bin(value: Column, steps: int = 256) -> Column:
    """A bin that grows with ``value``: the octave of its size in ``steps`` parts, mirrored below 0."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    part = octave * steps + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * steps)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * (part + (1 << 20))).cast("long")


def values_at_ranks(rows: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], key: str = "video_id") -> DataFrame:
    """(key, m, one column for each of ``ranks``): the values at 1-based ranks by size among the key's ``m`` values.

    A rank is a function of ``m``. Equal values are counted before they are shuffled, so a very common one is a row for each
    task. Two passes: the values are counted by ``size_bin``, some thousands of bins at most, which shows the bin of each rank;
    then only the values of these bins are ranked. Null values aren't counted; a key with nulls alone has ``m`` 0 and nulls.
    """
    values = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v")).withColumn("bin", size_bin(F.col("v")))
    values = values.groupBy(key, "bin", "v").agg(F.count("*").alias("n"))
    bins = values.groupBy(key, "bin").agg(F.sum("n").alias("n")).groupBy(key).agg(F.sum("n").alias("m"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    place = "struct<bin:bigint,within:bigint>"

    def step(acc: Column, x: Column) -> Column:
        found = (F.coalesce(acc[name], F.when(acc["upto"] + x["n"] >= acc[f"rank_{name}"], F.struct(x["bin"].alias("bin"), (acc[f"rank_{name}"] - acc["upto"]).alias("within")))).cast(place).alias(name) for name in ranks)
        return F.struct((acc["upto"] + x["n"]).alias("upto"), *(acc[f"rank_{name}"].alias(f"rank_{name}") for name in ranks), *found)

    start = F.struct(F.lit(0).cast("long").alias("upto"), *(rank(F.col("m")).cast("long").alias(f"rank_{name}") for name, rank in ranks.items()), *(F.lit(None).cast(place).alias(name) for name in ranks))
    bins = bins.withColumn("found", F.aggregate("bins", start, step))
    wanted = bins.select(key, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"found.{name}.bin").alias("bin"), F.col(f"found.{name}.within").alias("within")) for name in ranks))).alias("w"))
    wanted = wanted.select(key, F.col("w.bin").alias("bin"), F.struct("w.name", "w.within").alias("w")).groupBy(key, "bin").agg(F.collect_list("w").alias("wanted"))
    upto = F.sum("n").over(Window.partitionBy(key, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    met = values.join(wanted, [key, "bin"]).withColumn("upto", upto).withColumn("hit", F.filter("wanted", lambda w: (F.col("upto") >= w["within"]) & (F.col("upto") - F.col("n") < w["within"])))
    met = met.where(F.size("hit") > 0).select(key, "v", F.explode("hit.name").alias("name"))
    picked = met.groupBy(key).agg(F.count("*").alias("__n"), *(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks)).drop("__n")
    every = rows.groupBy(key).agg(F.count(value).alias("m"))
    return every.join(picked, key, "left").select(key, "m", *ranks)
