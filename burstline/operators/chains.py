"""Passes along a key's rows of any length, as transitions of chunks composed with each other.

A pass has a state, and each row moves it. A chunk of ``CHUNK`` rows is summarised as a small function from
the state it is entered with to the state it is left with; the functions are composed along the key, which
gives each chunk its entry state; then chunks are passed over again, each on its own. No array and no task holds more
than one chunk of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.operators.ordered import with_running_sum
from burstline.sources.scratch import written

CHUNK = 4_096
#: Bits of a chunk's number that one level of composition takes away.
FAN_BITS = 8
_TABLE = "array<struct<exit:int,opens:bigint>>"


def split_by_length(rows: DataFrame, keys: tuple[str, ...], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``most`` rows, which one array may hold, and those of longer keys; None where all are short.

    ``most`` is ``CHUNK`` by default. ``rows`` must be a fixed table (``written``). Keys must not be null.
    """
    most = CHUNK if most is None else most
    long = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys)
    if long.isEmpty():
        return rows, None
    long = written(long, "long")
    return rows.join(long, list(keys), "left_anti"), rows.join(long, list(keys), "left_semi")


def in_chunks(rows: DataFrame, keys: tuple[str, ...], t: str, seq: str, size: int | None = None) -> DataFrame:
    """``rows``, written, with ``position`` (from 0) within their key by ``t`` and ``seq``, and ``chunk``."""
    rows = with_running_sum(rows, F.lit(1), "position", keys, t, seq).withColumn("position", F.col("position") - 1)
    return written(rows.withColumn("chunk", F.floor(F.col("position") / (size or CHUNK)).cast("long")), "chunks")


def _composed(tables: Column, states: int) -> Column:
    """The transition table of ``tables`` (an array in order), one after the other: exit state and openings by entry state."""
    start = F.array(*(F.struct(F.lit(s).cast("int").alias("exit"), F.lit(0).cast("long").alias("opens")) for s in range(states)))

    def follow(acc: Column, table: Column) -> Column:
        return F.transform(acc, lambda a: F.struct(F.get(table, a["exit"])["exit"].alias("exit"), (a["opens"] + F.get(table, a["exit"])["opens"]).alias("opens"))).cast(_TABLE)

    return F.aggregate(tables, start.cast(_TABLE), follow)


def _sorted(number: str, value: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def _entries(tables: DataFrame, keys: tuple[str, ...], states: int, first: int) -> DataFrame:
    """(keys, chunk, state, opened): the state that each chunk is entered with, and openings before it, of (keys, chunk, moves)."""
    if tables.where("chunk > 0").isEmpty():
        return tables.select(*keys, "chunk", F.lit(first).alias("state"), F.lit(0).cast("long").alias("opened"))
    tables = tables.withColumn("up", F.shiftright("chunk", FAN_BITS))
    upper = written(tables.groupBy(*keys, "up").agg(_composed(_sorted("chunk", "moves"), states).alias("moves")).withColumnRenamed("up", "chunk"), "composed")
    upper = _entries(upper, keys, states, first).withColumnRenamed("chunk", "up")
    lists = tables.groupBy(*keys, "up").agg(F.array_sort(F.collect_list(F.struct("chunk", "moves"))).alias("items")).join(upper, [*keys, "up"])
    entry = "struct<chunk:bigint,state:int,opened:bigint>"

    def follow(acc: Column, x: Column) -> Column:
        at = acc["at"]
        move = F.get(x["moves"], at["state"])
        mine = F.struct(x["chunk"].alias("chunk"), at["state"].alias("state"), at["opened"].alias("opened"))
        return F.struct(F.struct(move["exit"].alias("state"), (at["opened"] + move["opens"]).alias("opened")).alias("at"), F.concat(acc["out"], F.array(mine)).alias("out"))

    start = F.struct(F.struct(F.col("state").cast("int").alias("state"), F.col("opened").cast("bigint").alias("opened")).alias("at"), F.array().cast(f"array<{entry}>").alias("out"))
    found = F.aggregate("items", start, follow, lambda acc: acc["out"])
    return lists.select(*keys, F.inline(found))


def automaton(rows: DataFrame, moves: list[tuple[Column, Column]], first: int, keys: tuple[str, ...], t: str, seq: str, out: tuple[str, ...]) -> DataFrame:
    """(keys, ``out``, group) of every row: how many rows before it in its key, and itself, opened a group.

    ``moves`` has for each state, numbered from 0, the state that the row leads to and whether it opens a
    group there. ``first`` is the state before a key's first row.
    """
    states = len(moves)
    table = F.array(*(F.struct(to.cast("int").alias("exit"), opens.cast("long").alias("opens")) for to, opens in moves))
    rows = in_chunks(rows.withColumn("moves", table).select(*keys, *dict.fromkeys((t, seq, *out)), "moves"), keys, t, seq)
    tables = written(rows.groupBy(*keys, "chunk").agg(_composed(_sorted("position", "moves"), states).alias("moves")), "tables")
    entries = _entries(tables, keys, states, first)
    items = F.array_sort(F.collect_list(F.struct("position", F.struct(*out).alias("row"), "moves")))
    chunks = rows.groupBy(*keys, "chunk").agg(items.alias("items")).join(entries, [*keys, "chunk"])
    kinds = ",".join(f"`{c}`:{rows.schema[c].dataType.simpleString()}" for c in out)

    def follow(acc: Column, x: Column) -> Column:
        move = F.get(x["moves"], acc["state"])
        group = acc["opened"] + move["opens"]
        mine = F.struct(x["row"].alias("row"), group.alias("group"))
        return F.struct(move["exit"].alias("state"), group.alias("opened"), F.concat(acc["out"], F.array(mine)).alias("out"))

    start = F.struct(F.col("state").cast("int").alias("state"), F.col("opened").cast("bigint").alias("opened"), F.array().cast(f"array<struct<row:struct<{kinds}>,group:bigint>>").alias("out"))
    passed = chunks.select(*keys, F.explode(F.aggregate("items", start, follow, lambda acc: acc["out"])).alias("x"))
    return passed.select(*keys, "x.row.*", "x.group")


class MergeChain:
    """The chain of neighbouring ranges that become one: joined while near, and while the chain or the next range is short.

    A state is (start, end, members, group) of the chain so far. A chain with start s and end e goes on through a chunk
    up to the first row that breaks it. Which row that is depends on s and e alone, and only few rows of a chunk can be
    it: those that begin too late for all rows before them in the chunk, and long ones, up to the first that breaks any chain
    there can be. ``summary`` lists them, each with the state at the chunk's end after a break there.
    """

    def __init__(self, gap: float, short: float):
        self.gap, self.short = gap, short

    def breaks(self, s: float, e: float, start: float, end: float) -> bool:
        return not (start - e < self.gap and (e - s < self.short or end - start < self.short))

    def walk(self, state: tuple | None, ranges: Iterable[tuple[float, float]]) -> Iterable[tuple]:
        """The state after each range."""
        for start, end in ranges:
            if state is None:
                state = (start, end, 1, 0)
            elif self.breaks(state[0], state[1], start, end):
                state = (start, end, 1, state[3] + 1)
            else:
                state = (min(state[0], start), max(state[1], end), state[2] + 1, state[3])
            yield state

    def summary(self, ranges: list[tuple[float, float]], reach: float) -> tuple[list[tuple], float]:
        """(rows that may break a chain, largest end): a row as (position, start, end, largest end before it, state at the chunk's end).

        ``reach`` is the largest end of the rows before the chunk.
        """
        listed, largest = [], float("-inf")
        for i, (start, end) in enumerate(ranges):
            late, long = not start - largest < self.gap, not end - start < self.short
            if late or long:
                listed.append((i, start, end, largest))
                # later than anything before, or long where a chain with any start is long
                if not start - max(largest, reach) < self.gap or (long and not largest - ranges[0][0] < self.short):
                    break
            largest = max(largest, end)
        return [(*x, self._exit(x[0], ranges)) for x in listed], max(end for _, end in ranges)

    def _exit(self, at: int, ranges: list[tuple[float, float]]) -> tuple:
        *_, last = self.walk(None, ranges[at:])
        return last

    def carry(self, state: tuple | None, summary: tuple[list[tuple], float], rows: int, first: float) -> tuple:
        """The state after a chunk of ``rows`` rows, entered with ``state``; ``first`` is the chunk's first start."""
        found, largest = summary
        if state is None:
            return found[0][4]  # the first row is late for a chain that isn't there
        s, e, members, group = state
        for i, start, end, before, last in found:
            if self.breaks(s, max(e, before), start, end):
                return (*last[:3], group + 1 + last[3])
        return min(s, first), max(e, largest), members + rows, group


def merge_groups(rows: DataFrame, gap: float, short: float, keys: tuple[str, ...] = ("video_id",), start: str = "start", end: str = "end", seq: str = "cluster") -> DataFrame:
    """``rows``, in chunks, with ``group`` (from 0 in each key) and ``place`` (from 0 in its group), by ``MergeChain``."""
    chain = MergeChain(gap, short)
    rows = in_chunks(rows, keys, start, seq)
    names = list(keys)
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    row = "struct<at:long,start:double,end:double,before:double,s:double,e:double,members:long,group:long>"

    def summarise(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("position")
        ranges = list(zip(chunk[start], chunk[end], strict=True))
        reach = chunk["reach"].iloc[0]
        found, largest = chain.summary(ranges, float("-inf") if pd.isna(reach) else reach)
        listed = [{"at": i, "start": a, "end": b, "before": m, "s": last[0], "e": last[1], "members": last[2], "group": last[3]} for i, a, b, m, last in found]
        return pd.DataFrame({**{k: [chunk[k].iloc[0]] for k in (*names, "chunk")}, "breaks": [listed], "largest": [largest], "n": [len(ranges)], "first": [ranges[0][0]]})

    def entries(chunks: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for c in chunks.sort_values("chunk").itertuples():
            out.append(state or (None, None, None, None))
            found = [(x["at"], x["start"], x["end"], x["before"], (x["s"], x["e"], x["members"], x["group"])) for x in c.breaks]
            state = chain.carry(state, (found, c.largest), c.n, c.first)
        result = chunks.sort_values("chunk")[[*names, "chunk"]].reset_index(drop=True)
        for i, name in enumerate(("s", "e", "members", "group")):
            result[name] = pd.Series([x[i] for x in out], dtype="float64" if i < 2 else "Int64")
        return result

    def replay(key: tuple, chunk: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("position")
        e = entry.iloc[0]
        state = None if pd.isna(e["members"]) else (e["s"], e["e"], int(e["members"]), int(e["group"]))
        states = list(chain.walk(state, zip(chunk[start], chunk[end], strict=True)))
        out = chunk[[*names, "position"]].copy()
        out["group"] = [x[3] for x in states]
        out["place"] = [x[2] - 1 for x in states]
        return out

    narrow = rows.select(*keys, "chunk", "position", F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end))
    ends = narrow.groupBy(*keys, "chunk").agg(F.max(end).alias("end_"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # over a row a chunk
    reached = narrow.join(ends.select(*keys, "chunk", F.max("end_").over(before).alias("reach")), [*keys, "chunk"])
    summaries = reached.groupBy(*keys, "chunk").applyInPandas(summarise, f"{types}, chunk long, breaks array<{row}>, largest double, n long, first double")
    states = written(summaries.groupBy(*keys).applyInPandas(entries, f"{types}, chunk long, s double, e double, members long, group long"), "entries")
    placed = narrow.groupBy(*keys, "chunk").cogroup(states.groupBy(*keys, "chunk")).applyInPandas(replay, f"{types}, position long, group long, place long")
    return rows.join(placed, [*keys, "position"])
