"""Order-dependent passes over one key's rows, as folds of sorted arrays.

A fold sees one group in one array, so groups must be bounded. Passes of the detection that handles
segments of 120 signal seconds one by one are folded per video and segment. Debounce and the state machine
are folded per island, a stretch between rows at which the state is known. Merging and
exact sessions count a key's rows first; keys with more than ``chains.CHUNK`` are passed over in chunks
whose transitions are composed (``chains``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.config import FusionConfig
from burstline.operators import chains
from burstline.operators.ordered import with_previous, with_running_max, with_running_sum
from burstline.sources.scratch import written

KEYS = ("video_id", "segment")
VIDEO = ("video_id",)


def fold(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fields: tuple[str, ...], state: str, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, result): ``step`` applied to a state of SQL type ``state`` and each row, in ``order``.

    ``state`` is a ``struct<...>`` that starts with nulls, and empty arrays for array fields.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    empty = rows.sparkSession.createDataFrame([], state.removeprefix("struct<").removesuffix(">")).schema
    zero = F.struct(*((F.array() if f.dataType.typeName() == "array" else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.fields))
    grouped = rows.groupBy(*keys).agg(items.alias("items"))
    typed = lambda acc, x: step(acc, x).cast(empty)
    result = F.aggregate("items", zero.cast(empty), typed, finish) if finish else F.aggregate("items", zero.cast(empty), typed)
    return grouped.select(*keys, result.alias("result"))


_PEAK = "struct<t:double,confidence:double,seq:bigint>"


def _peak(x: Column) -> Column:
    return F.struct(x["t"].alias("t"), x["confidence"].alias("confidence"), x["seq"].alias("seq"))


def debounce(peaks: DataFrame, interval: float = 0.1, keys: tuple[str, ...] = VIDEO) -> DataFrame:
    """Of peaks within ``interval`` of the one that opened their group, the last more confident one stays.

    A replacement does not move the time that later peaks are measured from. A peak ``interval`` or
    more after its neighbour opens a group whatever came before, so the fold starts anew there.
    """
    rows = with_previous(peaks, ("t",), "__previous", keys)
    opens = F.when(F.col("t") - F.col("__previous.t") >= interval, 1).otherwise(0)
    islands = with_running_sum(rows, opens, "island", keys).drop("__previous")

    def step(acc, x):
        out, anchor = acc["out"], acc["anchor"]
        opens = anchor.isNull() | (x["t"] - anchor >= interval)
        better = x["confidence"] > F.element_at(out, -1)["confidence"]
        replaced = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(_peak(x)))
        return F.struct(F.when(opens, x["t"]).otherwise(anchor).alias("anchor"), F.when(opens, F.concat(out, F.array(_peak(x)))).when(better, replaced).otherwise(out).alias("out"))

    found = fold(islands, (*keys, "island"), ("t", "seq"), ("confidence",), f"struct<anchor:double,out:array<{_PEAK}>>", step, lambda acc: acc["out"])
    return found.select(*keys, F.inline("result"))


def post_process(peaks: DataFrame, interval: float = 0.25, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Peaks nearer than ``interval`` to the current one: both stay if both are over 0.55 and more than 0.1 apart, else the more confident."""

    def step(acc, x):
        out, cur = acc["out"], acc["cur"]
        apart = F.abs(x["t"] - cur["t"])
        both = (x["confidence"] > 0.55) & (cur["confidence"] > 0.55) & (apart > 0.10)
        emits = cur.isNotNull() & ((apart >= interval) | both)
        moves = cur.isNull() | emits | (x["confidence"] > cur["confidence"])
        return F.struct(F.when(moves, _peak(x)).otherwise(cur).alias("cur"), F.when(emits, F.concat(out, F.array(cur))).otherwise(out).alias("out"))

    found = fold(peaks, keys, ("t", "seq"), ("confidence",), f"struct<cur:{_PEAK},out:array<{_PEAK}>>", step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    return found.select(*keys, F.inline("result"))


def throttled(frames: DataFrame, interval: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A frame stays if it comes ``interval`` or more after the last that stayed."""

    def step(acc, x):
        keeps = acc["last"].isNull() | (x["t"] - acc["last"] >= interval)
        return F.struct(F.when(keeps, x["t"]).otherwise(acc["last"]).alias("last"), F.when(keeps, F.concat(acc["out"], F.array(x["seq"]))).otherwise(acc["out"]).alias("out"))

    found = fold(frames, keys, ("t", "seq"), (), "struct<last:double,out:array<bigint>>", step, lambda acc: acc["out"])
    return found.select(*keys, F.explode("result").alias("seq"))


def progress_updates(rows: DataFrame, keys: tuple[str, ...] = KEYS, seconds: float = 4.0, share: float = 0.05) -> DataFrame:
    """Rows (t, seq, progress) that are reported: ``seconds`` or ``share`` on from the last report."""

    def step(acc, x):
        emits = acc["t"].isNull() | (x["t"] - acc["t"] >= seconds) | (x["progress"] - acc["p"] >= share)
        pick = lambda new, old: F.when(emits, new).otherwise(old)
        return F.struct(pick(x["t"], acc["t"]).alias("t"), pick(x["progress"], acc["p"]).alias("p"), pick(F.concat(acc["out"], F.array(x["seq"])), acc["out"]).alias("out"))

    found = fold(rows, keys, ("t", "seq"), ("progress",), "struct<t:double,p:double,out:array<bigint>>", step, lambda acc: acc["out"])
    return found.select(*keys, F.explode("result").alias("seq"))


def closed_run(level: float = 0.4, least: float = 3.0) -> Callable[[Column], Column]:
    """Of buffered rows (t, v): the first run over ``level`` that lasts ``least`` or more and that a lower row ends, as (start, end); null without one."""

    def find(buf: Column) -> Column:
        def step(acc, x):
            on = x["v"] > level
            ends = ~on & (F.round(acc["last"] - acc["first"], 9) >= least)
            return F.struct(
                F.when(on, F.coalesce(acc["first"], x["t"])).alias("first"),
                F.when(on, x["t"]).alias("last"),
                F.coalesce(acc["found"], F.when(ends, F.struct(acc["first"].alias("start"), acc["last"].alias("end")))).alias("found"),
            )

        none = F.lit(None).cast("double")
        zero = F.struct(none.alias("first"), none.alias("last"), F.lit(None).cast("struct<start:double,end:double>").alias("found"))
        return F.aggregate(buf, zero, step, lambda acc: acc["found"])

    return find


def buffered_windows(rows: DataFrame, keys: tuple[str, ...] = KEYS, trigger: int = 20, most: int = 40, find: Callable[[Column], Column] | None = None) -> DataFrame:
    """Count windows (keys, start, end, n): with ``trigger`` or more rows buffered, ``find`` looks for a run among them.

    If it finds one, the run is emitted with the number of rows buffered, and the buffer is cleared;
    else, over ``most`` rows, the first ``trigger`` go. ``find`` is ``closed_run()`` by default.
    """
    find = find or closed_run()

    def step(acc, x):
        buf = F.concat(acc["buf"], F.array(F.struct(x["t"].alias("t"), x["intensity"].alias("v"))))
        found = F.when(F.size(buf) >= trigger, find(buf))
        window = F.struct(found["start"].alias("start"), found["end"].alias("end"), F.size(buf).alias("n"))
        left = F.when(F.size(buf) > most, F.slice(buf, trigger + 1, F.size(buf))).otherwise(buf)
        return F.struct(F.when(found.isNotNull(), F.slice(buf, 1, 0)).otherwise(left).alias("buf"), F.when(found.isNotNull(), F.concat(acc["out"], F.array(window))).otherwise(acc["out"]).alias("out"))

    state = "struct<buf:array<struct<t:double,v:double>>,out:array<struct<start:double,end:double,n:int>>>"
    return fold(rows, keys, ("t", "seq"), ("intensity",), state, step, lambda acc: acc["out"]).select(*keys, F.inline("result"))


def merge_clusters(clusters: DataFrame, gap: float = 2.0, small: int = 3, keys: tuple[str, ...] = VIDEO) -> DataFrame:
    """Clusters (keys, first, last, hits) less than ``gap`` apart become one where either has fewer than ``small`` hits, in a chain.

    The hits of what is merged so far count, so a chain of small clusters stops growing once it is
    large and meets another large one. Long keys: the state is how many hits the chain has, ``small`` at most.
    """
    r = "struct<first:double,last:double,hits:bigint>"
    short, long = chains.split_by_length(written(clusters.select(*keys, "first", "last", F.col("hits").cast("long").alias("hits")), "clusters"), keys)

    def step(acc, x):
        cur, out = acc["cur"], acc["out"]
        own = F.struct(x["first"].alias("first"), x["last"].alias("last"), x["hits"].cast("bigint").alias("hits"))
        joins = (F.round(x["first"] - cur["last"], 9) < gap) & ((cur["hits"] < small) | (x["hits"] < small))
        merged = F.struct(cur["first"].alias("first"), x["last"].alias("last"), (cur["hits"] + x["hits"]).cast("bigint").alias("hits"))
        fresh = F.coalesce(~joins, F.lit(True))
        return F.struct(F.when(fresh, own).otherwise(merged).alias("cur"), F.when(fresh & cur.isNotNull(), F.concat(out, F.array(cur))).otherwise(out).alias("out"))

    found = fold(short, keys, ("first", "last"), ("hits",), f"struct<cur:{r},out:array<{r}>>", step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    found = found.select(*keys, F.inline("result"))
    if long is None:
        return found
    rows = with_previous(long, ("last",), "previous", keys, "first", "last")
    near = F.coalesce(F.round(F.col("first") - F.col("previous.last"), 9) < gap, F.lit(False))
    capped = lambda hits: F.least(hits, F.lit(small))
    moves = []
    for had in range(small + 1):  # hits of the chain
        joins = near & ((F.lit(had) < small) | (F.col("hits") < small))
        moves.append((F.when(joins, capped(F.lit(had) + F.col("hits"))).otherwise(capped(F.col("hits"))), ~joins))
    grouped = chains.automaton(rows, moves, 0, keys, "first", "last", ("first", "last", "hits"))
    merged = grouped.groupBy(*keys, "group").agg(F.min("first").alias("first"), F.max_by("last", F.struct("first", "last")).alias("last"), F.sum("hits").alias("hits"))
    return found.unionByName(merged.drop("group"))


def exact_sessions(peaks: DataFrame, stats: DataFrame, key: str = "video_id", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Clusters with the clause for clusters of four or more: (keys, seq, cluster), clusters counted from 0.

    ``stats`` has boundary, max_interval and p90 of each video. Long keys: the state is the size of the
    cluster so far, four at most, as a row's gap is known from the row before.
    """
    rows = peaks.join(stats.select(key, "boundary", "max_interval", F.coalesce("p90", F.lit(5.0)).alias("p90")), key)
    short, long = chains.split_by_length(written(rows.select(*dict.fromkeys((*keys, key)), "t", "seq", "confidence", "boundary", "max_interval", "p90"), "peaks"), keys)

    def same(gap, before, large, x):
        m = x["max_interval"]
        stretched = large & (gap <= F.least(1.15 * m, x["p90"]))
        both = (before > 0.7) & (x["confidence"] > 0.7) & (gap <= 1.1 * m)
        return (gap <= 10) & ((gap < 0.3) | ((gap <= x["boundary"]) & ((gap <= m) | stretched | both)))

    def step(acc, x):
        opens = F.coalesce(~same(x["t"] - acc["t"], acc["c"], acc["size"] >= 4, x), F.lit(True))
        cluster = F.coalesce(acc["cluster"] + F.when(opens, 1).otherwise(0), F.lit(0))
        placed = F.struct(x["seq"].alias("seq"), cluster.cast("bigint").alias("cluster"))
        return F.struct(x["t"].alias("t"), x["confidence"].alias("c"), F.when(opens, 1).otherwise(acc["size"] + 1).cast("int").alias("size"), cluster.cast("int").alias("cluster"), F.concat(acc["out"], F.array(placed)).alias("out"))

    state = "struct<t:double,c:double,size:int,cluster:int,out:array<struct<seq:bigint,cluster:bigint>>>"
    found = fold(short, keys, ("t", "seq"), ("confidence", "boundary", "max_interval", "p90"), state, step, lambda acc: acc["out"]).select(*keys, F.inline("result"))
    if long is None:
        return found
    rows = with_previous(long, ("t", "confidence"), "previous", keys)
    row = {c: F.col(c) for c in ("max_interval", "p90", "confidence", "boundary")}
    moves = []
    for size in range(5):  # of the cluster so far, 0 before a key's first row
        joins = F.coalesce(same(F.col("t") - F.col("previous.t"), F.col("previous.confidence"), F.lit(size >= 4), row), F.lit(False))
        moves.append((F.when(joins, min(size + 1, 4)).otherwise(1), ~joins))
    grouped = chains.automaton(rows, moves, 0, keys, "t", "seq", ("seq",))
    return found.unionByName(grouped.select(*keys, "seq", (F.col("group") - 1).alias("cluster")))


#: What a rally may carry besides its bounds, intensities and hits; null where a column isn't there.
METADATA = {"has_peaks": "boolean", "pose_confidence": "double", "players": "int", "peak_times": "array<double>"}


def merge_adjacent(rallies: DataFrame, gap: float = 2.0, short: float = 5.0, keys: tuple[str, ...] = VIDEO) -> DataFrame:
    """Neighbours less than ``gap`` apart become one where either is shorter than ``short``, in a chain.

    A merged rally has the outer bounds, the larger peak intensity, the mean of the two mean intensities
    (and of the two pose confidences), the sum of hits, peaks if either has, the first number of players that is
    known, and the peak times of both in a row. Columns of ``METADATA`` that ``rallies`` lacks are null.

    Long keys are grouped in chunks (``chains.merge_groups``); a rally merged of k rallies weighs the first
    by 2^(1-k) and the i-th by 2^(i-1-k), which is the mean of two along the chain.
    """
    names = ("start", "end", "mean_intensity", "max_intensity", "hits", *METADATA)
    lacking = {c: F.lit(None).cast(kind) for c, kind in METADATA.items() if c not in rallies.columns}
    rows = rallies.withColumns(lacking).withColumn("hits", F.coalesce(F.col("hits").cast("long"), F.lit(0))).withColumns({c: F.col(c).cast(kind) for c, kind in METADATA.items()})
    few, many = chains.split_by_length(written(rows.select(*keys, "cluster", *names), "rallies"), keys)
    r = "struct<start:double,end:double,mean_intensity:double,max_intensity:double,hits:bigint," + ",".join(f"{c}:{kind}" for c, kind in METADATA.items()) + ">"

    def step(acc, x):
        cur, out = acc["cur"], acc["out"]
        own = F.struct(*(x[c].alias(c) for c in names))
        joins = (x["start"] - cur["end"] < gap) & ((cur["end"] - cur["start"] < short) | (x["end"] - x["start"] < short))
        merged = F.struct(
            F.least(cur["start"], x["start"]).alias("start"),
            F.greatest(cur["end"], x["end"]).alias("end"),
            ((cur["mean_intensity"] + x["mean_intensity"]) / 2).alias("mean_intensity"),
            F.greatest(cur["max_intensity"], x["max_intensity"]).alias("max_intensity"),
            (cur["hits"] + x["hits"]).cast("bigint").alias("hits"),
            (cur["has_peaks"] | x["has_peaks"]).alias("has_peaks"),
            ((cur["pose_confidence"] + x["pose_confidence"]) / 2).alias("pose_confidence"),
            F.coalesce(cur["players"], x["players"]).alias("players"),
            F.when(cur["peak_times"].isNull(), x["peak_times"]).otherwise(F.concat(cur["peak_times"], F.coalesce(x["peak_times"], F.array().cast("array<double>")))).alias("peak_times"),
        )
        fresh = F.coalesce(~joins, F.lit(True))
        return F.struct(F.when(fresh, own).otherwise(merged).alias("cur"), F.when(fresh & cur.isNotNull(), F.concat(out, F.array(cur))).otherwise(out).alias("out"))

    found = fold(few, keys, ("start", "cluster"), names[1:], f"struct<cur:{r},out:array<{r}>>", step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    found = found.select(*keys, F.inline("result"))
    if many is None:
        return found
    grouped = written(chains.merge_groups(many, gap, short, keys), "groups")
    sizes = grouped.groupBy(*keys, "group").agg((F.max("place") + 1).alias("k"))
    weight = F.pow(F.lit(2.0), F.when(F.col("place") == 0, F.lit(1)).otherwise(F.col("place")) - F.col("k"))
    at = F.col("place")
    merged = grouped.join(sizes, [*keys, "group"]).groupBy(*keys, "group").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum(F.col("mean_intensity") * weight).alias("mean_intensity"),
        F.max("max_intensity").alias("max_intensity"),
        F.sum("hits").alias("hits"),
        F.max("has_peaks").alias("has_peaks"),
        F.sum(F.col("pose_confidence") * weight).alias("pose_confidence"),
        F.min_by("players", F.when(F.col("players").isNotNull(), at)).alias("players"),
        F.array_sort(F.collect_list(F.when(F.col("peak_times").isNotNull(), F.struct(at.alias("at"), F.col("peak_times").alias("times"))))).alias("times"),
    )
    times = F.when(F.size("times") > 0, F.flatten(F.transform("times", lambda x: x["times"])))
    return found.unionByName(merged.withColumn("peak_times", times).select(*keys, *names))


IDLE, STARTING, IN_RALLY, ENDING = "idle", "starting", "inRally", "ending"


def with_islands(frames: DataFrame, config: FusionConfig = FusionConfig(), keys: tuple[str, ...] = VIDEO) -> DataFrame:
    """``frames`` (t, seq, active) with island, and followed: whether the island ends here and another comes.

    After an inactive frame ``max_pause`` or more after the last active one (or with none before), the
    machine is idle or ending, and takes the next frame alike: an island starts there.
    """
    # times go up, so the last active frame is the largest time of one
    rows = with_running_max(frames, F.when(F.col("active"), F.col("t")), "__last", keys)
    rests = F.coalesce(~F.col("active") & (F.col("__last").isNull() | (F.col("t") - F.col("__last") >= config.max_pause)), F.lit(False))
    rows = with_previous(rows.withColumn("followed", rests), ("followed",), "__previous", keys)
    rows = with_running_sum(rows, F.coalesce(F.col("__previous.followed"), F.lit(False)).cast("int"), "island", keys)
    ends = frames.groupBy(*keys).agg(F.max(F.struct("t", "seq")).alias("__end"))
    rows = rows.join(ends, list(keys)).withColumn("followed", F.col("followed") & (F.struct("t", "seq") < F.col("__end")))
    return rows.drop("__last", "__previous", "__end")


def hit_islands(islands: DataFrame, config: FusionConfig = FusionConfig(), keys: tuple[str, ...] = VIDEO, flush_ending: bool = False) -> DataFrame:
    """(keys, island, final, rallies): the machine over the rows of ``with_islands``; final is null but for a video's last island.

    Idle, starting (until enough frames in a row are active), in a rally (until none was active
    for ``max_pause``), ending (the rally is emitted at the next frame, if long enough, and an
    active one starts anew). At the end of the input only a rally still going on is emitted; with
    ``flush_ending`` one that is ending is too.
    """

    def step(acc, x):
        state = F.coalesce(acc["state"], F.lit(IDLE))
        active, t = x["active"], x["t"]
        start, last, n, out = acc["start"], acc["last"], acc["n"], acc["out"]
        emits = (state == ENDING) & (last - start >= config.min_duration)
        resting = state.isin(IDLE, ENDING)
        grown = F.coalesce(n, F.lit(0)) + 1
        new_state = (
            F.when(resting, F.when(active, STARTING).otherwise(IDLE))
            .when(state == STARTING, F.when(~active, IDLE).when(grown >= config.min_active, IN_RALLY).otherwise(STARTING))
            .otherwise(F.when(~active & (t - last >= config.max_pause), ENDING).otherwise(IN_RALLY))
        )
        return F.struct(
            new_state.alias("state"),
            F.when(resting, F.when(active, t)).when((state == STARTING) & ~active, F.lit(None).cast("double")).otherwise(start).alias("start"),
            F.when(active, t).otherwise(last).alias("last"),
            F.when(resting, 1).otherwise(grown).cast("int").alias("n"),
            x["followed"].alias("followed"),
            F.when(emits, F.concat(out, F.array(F.struct(start.alias("start"), last.alias("end"))))).otherwise(out).alias("out"),
        )

    def finish(acc):
        open_at_end = (acc["state"] == IN_RALLY) | ((acc["state"] == ENDING) & (F.lit(flush_ending) | acc["followed"]))
        emits = open_at_end & (acc["last"] - acc["start"] >= config.min_duration)
        rallies = F.when(emits, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["last"].alias("end"))))).otherwise(acc["out"])
        return F.struct(F.when(~acc["followed"], F.coalesce(acc["state"], F.lit(IDLE))).alias("final"), rallies.alias("rallies"))

    state = "struct<state:string,start:double,last:double,n:int,followed:boolean,out:array<struct<start:double,end:double>>>"
    found = fold(islands, (*keys, "island"), ("t", "seq"), ("active", "followed"), state, step, finish)
    return found.select(*keys, "island", "result.final", "result.rallies")


def hit_states(frames: DataFrame, config: FusionConfig = FusionConfig(), keys: tuple[str, ...] = VIDEO, flush_ending: bool = False) -> DataFrame:
    """(keys, final, rallies): ``hit_islands`` by video, for videos whose rallies fit in one row."""
    found = hit_islands(with_islands(frames, config, keys), config, keys, flush_ending)
    return found.groupBy(*keys).agg(F.max("final").alias("final"), F.array_sort(F.flatten(F.collect_list("rallies"))).alias("rallies"))
