"""Formatting and parsing of names, times and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_seconds(seconds: Column) -> Column:
    """``m:ss`` of whole seconds."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def safe_name(name: Column, fallback: str = "file") -> Column:
    """A file name: runs of forbidden and control characters and spaces become ``_``, no ``.`` or ``_`` at the ends, 80 characters."""
    joined = F.array_join(F.filter(F.split(name, r'[\\/:?%*|"<>\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]'), lambda x: x != ""), "_")
    trimmed = F.regexp_replace(F.translate(joined, " ", "_"), "^[._]+|[._]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(fallback)).otherwise(F.substring(trimmed, 1, 80))


def export_name(title: Column, name: Column, index: Column, kind: str = "mp4") -> Column:
    """The file name of an exported clip: its video's title, its own name and its number, all made safe."""
    return F.concat_ws("_", safe_name(title, "video"), safe_name(name, "export"), F.concat(index.cast("string"), F.lit("." + kind)))


def slot_start(slot: Column) -> tuple[Column, Column]:
    """(hour, minute) of ``HH:mm-...``; what isn't a number counts as 0."""
    parts = F.split(F.substring_index(slot, "-", 1), ":")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return number(1), number(2)


def weekday_names(days: Column) -> Column:
    """Days (1 is Monday) in order; none means every day. Fixed values."""
    names = F.array(*(F.lit("周" + x) for x in "一二三四五六日"))
    return F.when(F.size(days) == 0, "每天").otherwise(F.array_join(F.transform(F.array_sort(days), lambda d: F.element_at(names, d.cast("int"))), ", "))


def preset_by_title(title: Column, words: tuple[str, ...] = ("手机", "现场", "mobile", "phone")) -> Column:
    low = F.lower(title)
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return F.when(found, "mobile").otherwise("default")


def display_name(nickname: Column, name: Column) -> Column:
    """The nickname, or the name where that is empty or null."""
    return F.coalesce(F.nullif(nickname, F.lit("")), name)


def nearly(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two numbers differ by less than ``tolerance``."""
    return F.abs(a - b) < tolerance


def report_line(name: Column, count: Column, share: Column) -> Column:
    """One line of a fixed-width report: a name, a count and a percentage."""
    return F.format_string("%-20s %8d %6.1f%%", name, count, 100 * share)
