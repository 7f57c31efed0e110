"""Queries over a stored library: filters by category, statistics of parents, id sets, updates, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCITING = 70.0
LONG = 10.0
CATEGORIES = ("all", "favorites", "exciting", "long")


def in_category(name: str) -> Column:
    """Whether a highlight (is_favorite, score, duration) belongs to one of ``CATEGORIES``."""
    return {"all": F.lit(True), "favorites": F.col("is_favorite"), "exciting": F.col("score") >= EXCITING, "long": F.col("duration") > LONG}[name]


def category_counts(highlights: DataFrame) -> DataFrame:
    """One row per category, counted in one pass."""
    counts = highlights.agg(*(F.count_if(in_category(c)).alias(c) for c in CATEGORIES))
    return counts.select(F.stack(F.lit(len(CATEGORIES)), *(x for c in CATEGORIES for x in (F.lit(c), F.col(c)))).alias("category", "n"))


def parent_statistics(parents: DataFrame, children: DataFrame, key: str = "video_id") -> DataFrame:
    """Rallies, mean and longest duration, edited length, exciting count and whole-percent rate; zeros where there are none."""
    stats = children.groupBy(key).agg(
        F.count("*").alias("rallies"),
        F.avg("duration").alias("mean_duration"),
        F.max("duration").alias("max_duration"),
        F.sum("duration").alias("edited"),
        F.count_if(F.col("score") >= EXCITING).alias("exciting"),
    )
    joined = parents.join(stats, key, "left").fillna(0, ["rallies", "mean_duration", "max_duration", "edited", "exciting"])
    rate = F.when(F.col("rallies") > 0, F.floor(F.col("exciting") / F.col("rallies") * 100)).otherwise(0)
    return joined.withColumn("exciting_percent", rate)


def with_ids(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(ids, on, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Deletion as a rewrite: the rows that stay."""
    return rows.join(ids, on, "left_anti")


def toggle_favorites(rows: DataFrame, ids: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Selected rows of a parent become favourites unless all of them are already; then none is."""
    marked = rows.join(ids.withColumn("selected", F.lit(True)), on, "left").fillna(False, ["selected"])
    every = marked.where("selected").groupBy(key).agg(F.bool_and("is_favorite").alias("every"))
    joined = marked.join(every, key, "left")
    return joined.withColumn("is_favorite", F.when(F.col("selected"), ~F.col("every")).otherwise(F.col("is_favorite"))).drop("every")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Parents with new children lose all old ones; others keep theirs."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def keep_newest(rows: DataFrame, n: int, key: str, by: str, tie: str) -> DataFrame:
    """``keep``: whether a row is among its key's ``n`` newest."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), tie))
    return rows.withColumn("keep", rank <= n)


def schedule(slots: DataFrame) -> DataFrame:
    """Rows (slots, days) to one row per slot and day; no days means all seven. weekday: 1 is Sunday."""
    days = F.when(F.size("days") == 0, F.sequence(F.lit(1), F.lit(7))).otherwise(F.col("days"))
    each = slots.withColumn("slot", F.explode("slots")).withColumn("day", F.explode(days))
    return each.withColumn("weekday", F.when(F.col("day") == 7, 1).otherwise(F.col("day") + 1)).drop("slots", "days")


def monitored(rows: DataFrame, as_of: Column) -> DataFrame:
    """Items that are enabled, for this weekday (1 is Monday; none means all), and for this date or none."""
    day = F.weekday(as_of) + 1
    on_day = (F.size("days") == 0) | F.array_contains("days", day)
    return rows.where(F.col("enabled") & on_day & (F.col("target_date").isNull() | (F.col("target_date") == F.to_date(as_of))))


#: status -> (can cancel, analysed, stamps the time of processing). Fixed values.
STATUSES = {"分析中": (True, None, False), "已完成": (False, True, True), "失败": (False, None, False), "已取消": (False, None, False)}


def change_status(rows: DataFrame, status: Column, now: Column) -> DataFrame:
    """Rows (can_cancel, analysed, processed_at) after a change to ``status``; others than ``STATUSES`` change nothing else."""
    cancel, analysed, stamp = F.col("can_cancel"), F.col("analysed"), F.col("processed_at")
    for name, (can, done, stamps) in STATUSES.items():
        cancel = F.when(status == name, F.lit(can)).otherwise(cancel)
        analysed = analysed if done is None else F.when(status == name, F.lit(done)).otherwise(analysed)
        stamp = F.when(status == name, now).otherwise(stamp) if stamps else stamp
    return rows.withColumns({"status": status, "can_cancel": cancel, "analysed": analysed, "processed_at": stamp})


def append_export(exports: Column, entry: Column) -> Column:
    """A JSON list of strings with ``entry`` appended; what can't be read counts as empty."""
    return F.to_json(F.concat(F.coalesce(F.from_json(exports, "array<string>"), F.array().cast("array<string>")), F.array(entry)))


def exportable(start: Column, end: Column) -> Column:
    """Whether a clip's range can be exported: it begins at 0 or later and ends after it begins."""
    return (start >= 0) & (end > start)


def behaviour_scores(swipes: DataFrame, plays: DataFrame, now: DataFrame, key: str = "video_id", window: float = 60.0, most: int = 20) -> DataFrame:
    """(key, swipes, stay, score) of each row of ``now`` (key, now): how fast a user moves on, from 0 to 1.

    Of the last ``most`` swipes (key, t, seq) those of the last ``window`` seconds before now count, ten or more being fast;
    of the last ``most`` plays (key, t, seq, duration) the mean duration counts, ten seconds or more being slow and 10.0
    where there are none. A user without any swipe has 0.5.
    """

    def last(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("t"), F.desc("seq")))
        return rows.withColumn("__place", place).where(F.col("__place") <= most)

    moved = last(swipes).join(now, key).groupBy(key).agg(F.count_if(F.col("now") - F.col("t") < window).alias("swipes"))
    stayed = last(plays).groupBy(key).agg(F.avg("duration").alias("stay"))
    rows = now.join(moved, key, "left").join(stayed, key, "left").withColumn("stay", F.coalesce("stay", F.lit(10.0)))
    score = 0.6 * F.least(F.col("swipes") / 10, F.lit(1.0)) + 0.4 * F.greatest(1 - F.col("stay") / 10, F.lit(0.0))
    return rows.select(key, F.coalesce("swipes", F.lit(0)).alias("swipes"), "stay", F.coalesce(score, F.lit(0.5)).alias("score"))
