"""Joins by nearness in time and by containment in intervals, rewritten as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.sources.scratch import written


def band_join(left: DataFrame, right: DataFrame, width: float, key: str = "video_id", left_t: str = "t", right_t: str = "t", offset: float = 0.0) -> DataFrame:
    """Pairs with |right_t - (left_t + offset)| <= width of the same key, with the time distance ``delta``.

    Times are cut into buckets of ``width``; the left row looks into its own and both neighbours,
    so the join is an equi-join on key and bucket and reads each pair once. Right columns come
    with the prefix ``r_``. Null times match nothing.
    """
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    left = left.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor((F.col(left_t) + offset) / width) + i)))
    right = right.withColumn("__rb", F.floor(F.col(f"r_{right_t}") / width))
    delta = F.abs(F.col(f"r_{right_t}") - (F.col(left_t) + offset))
    joined = left.join(right, (F.col(key) == F.col(f"r_{key}")) & (F.col("__b") == F.col("__rb")))
    return joined.withColumn("delta", delta).where(F.col("delta") <= width).drop("__b", "__rb", f"r_{key}")


def near(left: DataFrame, right: DataFrame, width: float, strict: bool = False, extra: Column | None = None, **how) -> DataFrame:
    """``left`` with ``is_near``: whether a right row lies within ``width``. Left rows are told apart by key and seq."""
    key = how.get("key", "video_id")
    pairs = band_join(left, right, width, **how)
    pairs = pairs.where(F.col("delta") < width) if strict else pairs
    pairs = pairs if extra is None else pairs.where(extra)
    found = pairs.select(key, "seq").distinct().withColumn("is_near", F.lit(True))
    return left.join(found, [key, "seq"], "left").fillna(False, ["is_near"])


def length_class(start: str, end: str, least: float) -> Column:
    """How often ``least`` must be doubled to be as long as the interval; 0 for shorter ones."""
    length = F.col(end) - F.col(start)
    return F.when(length <= least, 0).otherwise(F.ceil(F.log2(length / least))).cast("int")


def _classes(rows: DataFrame) -> list[int]:
    """The length classes there are: some dozens at most, as widths double."""
    return sorted(r[0] for r in rows.select("__class").distinct().collect())


def _width(level: Column, least: float) -> Column:
    return F.lit(least) * F.pow(F.lit(2.0), level)


def _touched(start: str, end: str, width: Column) -> Column:
    """The buckets of ``width`` that a closed interval touches; two at most (three by rounding) where it is no longer than one."""
    return F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))


def within_intervals(intervals: DataFrame, points: DataFrame, bucket: float, key: str = "video_id", start: str = "start", end: str = "end", t: str = "t") -> DataFrame:
    """Pairs of an interval and a point of the same key in it, both ends included.

    Intervals are dealt by length class: widths of buckets double from ``bucket`` on, and an interval goes to the two
    buckets at most that it touches among those at least as wide as it is long. A point goes to its bucket of every
    class that has intervals. So one very long interval is two rows, and rows are copied no more often than there are classes.
    """
    intervals = written(intervals.where(F.col(end) >= F.col(start)).withColumn("__class", length_class(start, end, bucket)), "intervals")
    classes = _classes(intervals)
    dealt = intervals.withColumn("__b", F.explode(_touched(start, end, _width(F.col("__class"), bucket))))
    points = points.select(*(F.col(c).alias(f"p_{c}") for c in points.columns))
    levels = F.array(*(F.lit(c) for c in classes)) if classes else F.array().cast("array<int>")
    points = points.withColumn("__pc", F.explode(levels)).withColumn("__pb", F.floor(F.col(f"p_{t}") / _width(F.col("__pc"), bucket)))
    same = (F.col(key) == F.col(f"p_{key}")) & (F.col("__class") == F.col("__pc")) & (F.col("__b") == F.col("__pb"))
    joined = dealt.join(points, same & F.col(f"p_{t}").between(F.col(start), F.col(end)))
    return joined.drop("__b", "__class", "__pb", "__pc", f"p_{key}")


def overlapping_pairs(rows: DataFrame, bucket: float, key: str = "video_id", number: str = "number", start: str = "start", end: str = "end") -> DataFrame:
    """(key, i, j) of pairs i < j of closed ranges of one key that overlap; numbers must differ within a key.

    A range waits in the buckets of its own length class (``within_intervals``) and looks for shorter or like ones there; it
    goes itself to the buckets of every longer class. A pair counts in the one bucket that holds the later start.
    """
    rows = written(rows.where(F.col(end) >= F.col(start)).select(key, number, start, end, length_class(start, end, bucket).alias("__class")), "ranges")
    classes = _classes(rows)
    levels = F.array(*(F.lit(c) for c in classes)) if classes else F.array().cast("array<int>")
    waits = rows.withColumn("__b", F.explode(_touched(start, end, _width(F.col("__class"), bucket))))
    goes = rows.withColumn("__level", F.explode(F.filter(levels, lambda c: c >= F.col("__class"))))
    goes = goes.withColumn("__b2", F.explode(_touched(start, end, _width(F.col("__level"), bucket))))
    goes = goes.select(F.col(key).alias("__k2"), F.col(number).alias("__n2"), F.col(start).alias("__s2"), F.col(end).alias("__e2"), F.col("__class").alias("__c2"), "__level", "__b2")
    same = (F.col(key) == F.col("__k2")) & (F.col("__class") == F.col("__level")) & (F.col("__b") == F.col("__b2"))
    once = (F.col("__c2") < F.col("__class")) | (F.col(number) < F.col("__n2"))
    later = F.floor(F.greatest(F.col(start), F.col("__s2")) / _width(F.col("__class"), bucket)) == F.col("__b")
    hit = same & once & (F.col(number) != F.col("__n2")) & (F.col(start) <= F.col("__e2")) & (F.col("__s2") <= F.col(end)) & later
    return waits.join(goes, hit).select(key, F.least(number, "__n2").alias("i"), F.greatest(number, "__n2").alias("j"))


def segments(intervals: DataFrame, length: float, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals dealt to every segment [i * length, (i + 1) * length) that they overlap, without touching ends."""
    last = F.ceil(F.col(end) / length) - 1
    return intervals.where(F.col(end) > F.col(start)).withColumn("segment", F.explode(F.sequence(F.floor(F.col(start) / length), last)))
