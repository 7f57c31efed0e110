"""Queries over the stored library: orders as videos, their lines as highlights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.functions import scoring, text
from burstline.operators import library as L
from burstline.sources.tables import HIGHLIGHTS_SQL, SIGNAL_SQL, highlights, read, signal


def category_filter_counts(spark, sf_dir):
    return L.category_counts(highlights(spark, sf_dir))


def category_filter(spark, sf_dir):
    rows = highlights(spark, sf_dir)
    return rows.where(L.in_category("favorites") & L.in_category("exciting") & L.in_category("long")).select("video_id", "rally_number", "duration", F.round("score", 6).alias("score"))


def _videos(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"))


def parent_stats(spark, sf_dir):
    out = L.parent_statistics(_videos(spark, sf_dir), highlights(spark, sf_dir))
    return out.select("video_id", "rallies", F.round("mean_duration", 6).alias("mean_duration"), "max_duration", "edited", "exciting", F.col("exciting_percent").cast("long").alias("exciting_percent"))


def _selected(spark, sf_dir):
    """The ids selected: the first line of the orders of customers in the building segment."""
    customers = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    chosen = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left_semi")
    return chosen.select(F.col("o_orderkey").alias("video_id"), F.lit(1).alias("rally_number"))


SELECTED_SQL = """selected AS (
    SELECT o_orderkey AS video_id, 1 AS rally_number FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
)"""


def id_membership_semi(spark, sf_dir):
    return L.with_ids(highlights(spark, sf_dir), _selected(spark, sf_dir), ["video_id", "rally_number"]).select("video_id", "rally_number", "duration")


def delete_by_id_set(spark, sf_dir):
    left = L.without_ids(highlights(spark, sf_dir), _selected(spark, sf_dir), ["video_id", "rally_number"])
    return left.groupBy("video_id").agg(F.count("*").alias("left"), F.sum("duration").alias("edited"))


def toggle_all_favorite(spark, sf_dir):
    rows = L.toggle_favorites(highlights(spark, sf_dir), _selected(spark, sf_dir), "video_id", ["video_id", "rally_number"])
    return rows.groupBy("video_id").agg(F.count_if(F.col("is_favorite")).alias("favorites"), F.count_if(F.col("selected")).alias("selected"))


def replace_children(spark, sf_dir):
    rows = highlights(spark, sf_dir).select("video_id", "rally_number", "duration")
    fresh = rows.where(F.col("video_id") % 3 == 0).groupBy("video_id").agg(F.lit(1).alias("rally_number"), F.max("duration").alias("duration"))
    out = L.replace_children(rows, fresh, "video_id")
    return out.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("duration").alias("edited"))


def delete_parent_cascade(spark, sf_dir):
    gone = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("video_id"))
    return L.without_ids(highlights(spark, sf_dir), gone, ["video_id"]).groupBy("type").agg(F.count("*").alias("n"), F.sum("duration").alias("edited"))


def city_search(spark, sf_dir):
    """Courts (suppliers) of one country whose name holds a text, in either case."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey").where((F.col("n_regionkey") == 1) & F.lower("s_name").contains("supplier#0"))
    return rows.select("s_suppkey", "s_name", "n_name").orderBy("n_name", "s_suppkey")


def prefix_match(spark, sf_dir):
    """Scheduled items (orders) of a kind told by how their key begins."""
    return read(spark, sf_dir, "orders").where(F.concat(F.lit("order-"), "o_orderpriority").startswith("order-1-")).select("o_orderkey", "o_orderpriority")


def display_names(spark, sf_dir):
    """Each customer's segment as a nickname, empty in one segment, or else the name."""
    nickname = F.when(F.col("c_mktsegment") == "BUILDING", "").when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.display_name(nickname, F.col("c_name")).alias("shown"))


def approx_equal(spark, sf_dir):
    """Line items whose discount and tax are about equal."""
    rows = read(spark, sf_dir, "lineitem").withColumn("nearly", text.nearly(F.round("l_discount", 2), F.round(F.col("l_tax") + 0.004, 3)))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("nearly").alias("nearly"))


def report_lines(spark, sf_dir):
    """A fixed-width report of event types, their counts and shares, largest first."""
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    # the total over the few rows that are left, one for each kind of event
    rows = rows.select("event_type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
    return rows.select("event_type", text.report_line(F.col("event_type"), F.col("n"), F.round("share", 6)).alias("line"))


def lru_keep_newest(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = L.keep_newest(rows, 3, "o_custkey", "o_orderdate", "o_orderkey")
    return kept.groupBy("o_custkey").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("evicted"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("least_recent"))


def table_scan_sorted(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def notification_schedule_cross(spark, sf_dir):
    items = read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array(F.lit("18:00-20:00"), F.lit("07:30-08:00")).alias("slots"),
        F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("c_custkey") % 7 + 1).cast("int"), F.lit(7))).alias("days"),
    )
    hour, minute = text.slot_start(F.col("slot"))
    rows = L.schedule(items).select("c_custkey", "slot", "day", "weekday", hour.alias("hour"), minute.alias("minute"))
    return rows.groupBy("slot", "hour", "minute", "weekday").agg(F.count("*").alias("n"), F.sum("day").alias("days"))


def monitor_now(spark, sf_dir):
    as_of = F.lit("2024-05-15 10:00:00").cast("timestamp")
    items = read(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("c_custkey") % 7 + 1).cast("int"))).alias("days"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-05-16").cast("date")).alias("target_date"),
    )
    return L.monitored(items, as_of).select("c_custkey")


def state_filters(spark, sf_dir):
    """Recoverable, active and expired processing states, with mean progress; an order's month stands for its age."""
    as_of = F.lit("1998-08-01").cast("timestamp_ntz")
    rows = read(spark, sf_dir, "orders").select((F.col("o_totalprice") % 100).alias("current"), F.lit(60.0).alias("total"), (F.col("o_orderstatus") == "F").alias("error"), F.col("o_orderdate").alias("updated"))
    recoverable = F.col("current") < F.col("total")
    progress = F.when(F.col("total") > 0, F.least(F.col("current") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return rows.agg(
        F.count_if(recoverable).alias("recoverable"),
        F.count_if(recoverable & ~F.col("error")).alias("active"),
        F.count_if(F.col("updated") < as_of - F.expr("INTERVAL 7 DAYS")).alias("expired"),
        F.round(F.avg(progress), 6).alias("mean_progress"),
    )


def nested_json_sum(spark, sf_dir):
    """A field of JSON columns, absent ones as 0, summed by type."""
    rows = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.sum(F.coalesce("p.k", F.lit(0))).alias("hits"), F.count("p.k").alias("present"))


def append_json_list(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("not json")).when(F.col("event_id") % 3 == 1, F.lit('["a.mp4"]')).alias("exports"))
    grown = rows.withColumn("exports", L.append_export(F.col("exports"), F.concat(F.lit("clip"), F.col("event_id") % 10)))
    return grown.groupBy("exports").agg(F.count("*").alias("n"))


def status_transition(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(x) for x in ("分析中", "已完成", "失败", "已取消", "导入中"))), (F.col("video_id") % 5 + 1).cast("int"))
    rows = _videos(spark, sf_dir).withColumns({"can_cancel": F.col("video_id") % 2 == 0, "analysed": F.lit(False), "processed_at": F.lit(None).cast("timestamp_ntz")})
    out = L.change_status(rows, status, F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.groupBy("status", "can_cancel", "analysed").agg(F.count("*").alias("n"), F.count("processed_at").alias("stamped"))


def ladder_buckets(spark, sf_dir):
    rows = highlights(spark, sf_dir).select(scoring.score_color(F.col("score")).alias("color"), scoring.resolution(F.lit(640), (F.col("duration") * 50).cast("int")).alias("resolution"))
    return rows.groupBy("color", "resolution").agg(F.count("*").alias("n"))


def size_estimate(spark, sf_dir):
    """Bytes of an export at 1, 3, 8 and 20 MB a minute, whole bytes."""
    minutes = highlights(spark, sf_dir).groupBy("video_id").agg((F.sum("duration") / 60.0).alias("m"))
    rates = {"low": 1.0, "medium": 3.0, "high": 8.0, "original": 20.0}
    return minutes.select("video_id", *(F.floor(F.col("m") * rate * 1024 * 1024).alias(name) for name, rate in rates.items()))


def mmss_format(spark, sf_dir):
    return highlights(spark, sf_dir).groupBy("video_id").agg(F.sum("duration").alias("s")).select("video_id", text.minutes_seconds(F.col("s")).alias("text"))


def sanitize_name(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("page_id"), text.safe_name(F.concat(F.lit(" ._"), F.col("p_name"), F.lit("<>."))).alias("name"))
    return rows.unionByName(parts)


def export_names(spark, sf_dir):
    """File names of exported clips: title, export name and number."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    title = F.when(F.col("p_partkey") % 5 == 0, " . ").otherwise(F.col("p_name"))
    name = F.when(F.col("p_partkey") % 7 == 0, "??").otherwise(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")))
    return rows.select("p_partkey", text.export_name(title, name, F.col("p_size")).alias("name"))


def export_ranges(spark, sf_dir):
    """Clips cut out of orders' line items by days before shipping, of which only those with a valid range can be exported."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).alias("start"), (F.col("l_tax") * 300).alias("end"))
    return rows.where(L.exportable(F.col("start"), F.col("end"))).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


def timeslot_parse(spark, sf_dir):
    slot = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":"), F.when(F.col("o_orderkey") % 7 == 0, "xx").otherwise(F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")), F.lit("-23:59"))
    hour, minute = text.slot_start(slot)
    return read(spark, sf_dir, "orders").select("o_orderkey", hour.alias("hour"), minute.alias("minute"))


def weekday_labels(spark, sf_dir):
    days = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("c_custkey") % 7 + 1).cast("int"), (F.col("c_custkey") % 5 + 1).cast("int")))
    return read(spark, sf_dir, "customer").select("c_custkey", text.weekday_names(days).alias("days"))


def union_all_branches(spark, sf_dir):
    rows = highlights(spark, sf_dir).select("video_id", "duration", "type")
    both = rows.where("type = 'O'").unionByName(rows.where("type = 'F'")).unionByName(rows.where("duration > 45"))
    return both.groupBy("type").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


_SQL_SAFE = r"""CASE WHEN coalesce(x, '') = '' THEN 'file' ELSE left(x, 80) END"""


def _safe(expr: str) -> str:
    pattern = r"""[\\/:?%*|"<>\x00-\x1F\x7F]"""
    return f"regexp_replace(replace(array_to_string([p FOR p IN string_split_regex({expr}, '{pattern}') IF p <> ''], '_'), ' ', '_'), '^[._]+|[._]+$', '', 'g')"


def h(body: str) -> str:
    return f"WITH {HIGHLIGHTS_SQL} {body}"


QUERIES = {
    "category_filter_counts": (
        category_filter_counts,
        h("SELECT 'all' AS category, count(*) AS n FROM highlights UNION ALL SELECT 'favorites', count(*) FROM highlights WHERE is_favorite UNION ALL SELECT 'exciting', count(*) FROM highlights WHERE score >= 70 UNION ALL SELECT 'long', count(*) FROM highlights WHERE duration > 10"),
    ),
    "category_filter": (category_filter, h("SELECT video_id, rally_number, duration, round(score, 6) AS score FROM highlights WHERE is_favorite AND score >= 70 AND duration > 10")),
    "parent_stats": (
        parent_stats,
        h("""SELECT o_orderkey AS video_id, count(h.video_id) AS rallies, round(coalesce(avg(duration), 0), 6) AS mean_duration, coalesce(max(duration), 0) AS max_duration, coalesce(sum(duration), 0) AS edited,
             count(*) FILTER (score >= 70) AS exciting, CAST(CASE WHEN count(h.video_id) > 0 THEN floor(count(*) FILTER (score >= 70) / CAST(count(h.video_id) AS DOUBLE) * 100) ELSE 0 END AS BIGINT) AS exciting_percent
             FROM orders LEFT JOIN highlights AS h ON h.video_id = o_orderkey GROUP BY o_orderkey"""),
    ),
    "id_membership_semi": (id_membership_semi, f"WITH {HIGHLIGHTS_SQL}, {SELECTED_SQL} SELECT video_id, rally_number, duration FROM highlights WHERE (video_id, rally_number) IN (SELECT video_id, rally_number FROM selected)"),
    "delete_by_id_set": (delete_by_id_set, f"WITH {HIGHLIGHTS_SQL}, {SELECTED_SQL} SELECT video_id, count(*) AS \"left\", sum(duration) AS edited FROM highlights ANTI JOIN selected USING (video_id, rally_number) GROUP BY video_id"),
    "toggle_all_favorite": (
        toggle_all_favorite,
        f"""WITH {HIGHLIGHTS_SQL}, {SELECTED_SQL}, m AS (SELECT h.*, s.video_id IS NOT NULL AS sel FROM highlights AS h LEFT JOIN selected AS s ON s.video_id = h.video_id AND s.rally_number = h.rally_number),
        e AS (SELECT *, bool_and(is_favorite) FILTER (sel) OVER (PARTITION BY video_id) AS every FROM m)
        SELECT video_id, count(*) FILTER (CASE WHEN sel THEN NOT every ELSE is_favorite END) AS favorites, count(*) FILTER (sel) AS selected FROM e GROUP BY video_id""",
    ),
    "replace_children": (
        replace_children,
        h("SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN video_id % 3 = 0 THEN max(duration) ELSE sum(duration) END AS edited FROM highlights GROUP BY video_id"),
    ),
    "delete_parent_cascade": (delete_parent_cascade, h("SELECT type, count(*) AS n, sum(duration) AS edited FROM highlights WHERE video_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY type")),
    "city_search": (city_search, "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 AND contains(lower(s_name), 'supplier#0')"),
    "prefix_match": (prefix_match, "SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with('order-' || o_orderpriority, 'order-1-')"),
    "display_names": (display_names, "SELECT c_custkey, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END, ''), c_name) AS shown FROM customer"),
    "approx_equal": (approx_equal, "SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(round(l_discount, 2) - round(l_tax + 0.004::DOUBLE, 3)) < 0.01::DOUBLE) AS nearly FROM lineitem GROUP BY l_returnflag"),
    "report_lines": (
        report_lines,
        "SELECT event_type, printf('%-20s %8d %6.1f%%', event_type, count(*), 100 * round(count(*) / sum(count(*)) OVER (), 6)) AS line FROM events GROUP BY event_type",
    ),
    "lru_keep_newest": (
        lru_keep_newest,
        """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS o FROM orders)
        SELECT o_custkey, count(*) FILTER (r <= 3) AS kept, count(*) FILTER (r > 3) AS evicted, max(o_orderkey) FILTER (o = 1) AS least_recent FROM k GROUP BY o_custkey""",
    ),
    "table_scan_sorted": (table_scan_sorted, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50"),
    "notification_schedule_cross": (
        notification_schedule_cross,
        """WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN [1, 2, 3, 4, 5, 6, 7] ELSE [c_custkey % 7 + 1, 7] END AS days FROM customer), d AS (SELECT unnest(days) AS day FROM i)
        SELECT slot, CAST(hour AS INTEGER) AS hour, CAST(minute AS INTEGER) AS minute, CAST(CASE WHEN day = 7 THEN 1 ELSE day + 1 END AS INTEGER) AS weekday, count(*) AS n, CAST(sum(day) AS BIGINT) AS days
        FROM d CROSS JOIN (VALUES ('18:00-20:00', 18, 0), ('07:30-08:00', 7, 30)) AS s(slot, hour, minute) GROUP BY ALL""",
    ),
    "monitor_now": (
        monitor_now,
        "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (c_custkey % 4 = 0 OR c_custkey % 7 + 1 = isodow(DATE '2024-05-15')) AND NOT c_custkey % 5 = 0",
    ),
    "state_filters": (
        state_filters,
        """SELECT count(*) FILTER (o_totalprice % 100 < 60) AS recoverable, count(*) FILTER (o_totalprice % 100 < 60 AND o_orderstatus <> 'F') AS active,
        count(*) FILTER (o_orderdate < TIMESTAMP '1998-07-25') AS expired, round(avg(least(o_totalprice % 100 / 60.0::DOUBLE, 1.0::DOUBLE)), 6) AS mean_progress FROM orders""",
    ),
    "nested_json_sum": (
        nested_json_sum,
        "SELECT event_type, CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS hits, count(json_extract(props, '$.k')) AS present FROM events GROUP BY event_type",
    ),
    "append_json_list": (
        append_json_list,
        """SELECT CASE WHEN event_id % 3 = 1 THEN '["a.mp4","clip' ELSE '["clip' END || (event_id % 10) || '"]' AS exports, count(*) AS n FROM events GROUP BY ALL""",
    ),
    "status_transition": (
        status_transition,
        """WITH v AS (SELECT ['分析中', '已完成', '失败', '已取消', '导入中'][o_orderkey % 5 + 1] AS status, o_orderkey % 2 = 0 AS c FROM orders)
        SELECT status, CASE status WHEN '分析中' THEN true WHEN '导入中' THEN c ELSE false END AS can_cancel, status = '已完成' AS analysed, count(*) AS n, count(*) FILTER (status = '已完成') AS stamped FROM v GROUP BY ALL""",
    ),
    "ladder_buckets": (
        ladder_buckets,
        h("""SELECT CASE WHEN score >= 80 THEN 'red' WHEN score >= 60 THEN 'orange' WHEN score >= 40 THEN 'yellow' ELSE 'green' END AS color,
             CASE WHEN duration * 50 >= 2160 THEN '4K' WHEN duration * 50 >= 1440 THEN '2K' WHEN duration * 50 >= 1080 THEN '1080p' WHEN duration * 50 >= 720 THEN '720p' WHEN duration * 50 >= 480 THEN '480p'
                  ELSE '640×' || CAST(duration * 50 AS INTEGER) END AS resolution, count(*) AS n FROM highlights GROUP BY ALL"""),
    ),
    "size_estimate": (
        size_estimate,
        h("WITH m AS (SELECT video_id, sum(duration) / 60.0::DOUBLE AS m FROM highlights GROUP BY video_id) SELECT video_id, " + ", ".join(f"CAST(floor(m * {rate}.0::DOUBLE * 1024 * 1024) AS BIGINT) AS \"{name}\"" for name, rate in (("low", 1), ("medium", 3), ("high", 8), ("original", 20))) + " FROM m").replace(") WITH m AS", "), m AS"),
    ),
    "mmss_format": (mmss_format, h("SELECT video_id, CAST(floor(sum(duration)) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(sum(duration)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS text FROM highlights GROUP BY video_id")),
    "sanitize_name": (
        sanitize_name,
        f"""WITH n AS (SELECT page_id, {_safe('url')} AS x FROM pages UNION ALL SELECT p_partkey + 1000000, {_safe("' ._' || p_name || '<>.'")} FROM part) SELECT page_id, {_SQL_SAFE} AS name FROM n""",
    ),
    "timeslot_parse": (timeslot_parse, "SELECT o_orderkey, CAST(o_orderkey % 24 AS INTEGER) AS hour, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 60 END AS INTEGER) AS minute FROM orders"),
    "weekday_labels": (
        weekday_labels,
        """WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE list_sort([c_custkey % 7 + 1, c_custkey % 5 + 1]) END AS d FROM customer)
        SELECT c_custkey, CASE WHEN len(d) = 0 THEN '每天' ELSE array_to_string(['周' || ['一', '二', '三', '四', '五', '六', '日'][x] FOR x IN d], ', ') END AS days FROM d""",
    ),
    "union_all_branches": (
        union_all_branches,
        h("""SELECT type, count(*) AS n, sum(duration) AS total FROM (SELECT duration, type FROM highlights WHERE type = 'O' UNION ALL SELECT duration, type FROM highlights WHERE type = 'F' UNION ALL SELECT duration, type FROM highlights WHERE duration > 45) GROUP BY type"""),
    ),
}


def model_excitement(spark, sf_dir):
    """The fuller score: duration, intensity, audible hits, pose, ball speed and path."""
    one = F.lit(1.0)
    rows = highlights(spark, sf_dir).withColumns({"i": F.col("score") / 100, "v": F.col("duration") % 5 / 10, "dist": F.col("duration") % 4 / 2, "pose": F.col("score") % 10 / 10})
    total = (
        25 * F.least(F.col("duration") / 30, one)
        + 30 * F.col("i")
        + F.when(F.col("is_favorite"), 20.0).otherwise(0.0)
        + F.when(F.round("pose", 9) > 0.7, 10.0).otherwise(5.0)
        + 15 * (0.5 * F.least(F.col("v") / 0.3, one) + 0.5 * F.least(F.col("dist") / 2, one))
    )
    return rows.select("video_id", "rally_number", F.round(total, 8).alias("excitement"))


def behaviour_score(spark, sf_dir):
    """Clicks as swipes in the 60 seconds before each user's newest event, and views as plays."""
    rows = signal(spark, sf_dir).select("video_id", "t", "seq", "event_type", (F.col("value") % 20).alias("duration"))
    now = rows.groupBy("video_id").agg(F.max("t").alias("now"))
    found = L.behaviour_scores(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), now)
    return found.select("video_id", "swipes", F.round("stay", 6).alias("stay"), F.round("score", 6).alias("score"))


def progress_ratios(spark, sf_dir):
    """Guarded share done, progress within steps, and the share of a clip played, whole tens of percent too."""
    rows = highlights(spark, sf_dir).select("video_id", "rally_number", "duration", (F.col("duration") - 10).alias("total"))
    share = F.when(F.col("total") > 0, F.least(F.col("duration") / 2 / F.col("total"), F.lit(1.0))).otherwise(0.0)
    within = (F.col("rally_number") - 1 + 0.5) / 7
    played = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("duration") / 3 - 2) / F.greatest(F.col("duration") - 2, F.lit(0.01))))
    return rows.select("video_id", "rally_number", F.round(share, 6).alias("share"), F.round(within, 6).alias("within"), F.round(played, 6).alias("played"), F.floor(share * 10 + 0.5).alias("tens"))


def paging_window(spark, sf_dir):
    """Dots shown around the third of a video's rallies: two either side, all if there are five or fewer."""
    rows = highlights(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    first = F.when(F.col("n") <= 5, 0).otherwise(F.greatest(F.lit(0), F.lit(2) - 2))
    last = F.when(F.col("n") <= 5, F.col("n") - 1).otherwise(F.least(F.col("n") - 1, F.lit(2) + 2))
    return rows.select("video_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("dot"))


def cache_keys(spark, sf_dir):
    """How many events share a key of user and whole second of their kind."""
    rows = read(spark, sf_dir, "events").select(F.concat_ws("_", F.col("user_id"), F.floor(F.col("value")).cast("int"), F.lit("thumb")).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def array_set_ops(spark, sf_dir):
    """A video's selected rallies after adding and removing: union, difference, all of them, and times put together."""
    rows = highlights(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_set("rally_number")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("is_favorite"), F.col("rally_number")))).alias("chosen"))
    added = F.array_sort(F.array_union("chosen", F.array(F.lit(1), F.lit(2))))
    left = F.array_sort(F.array_except("all", "chosen"))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("video_id", text_of(added).alias("added"), text_of(left).alias("left"), (F.size("chosen") == F.size("all")).alias("every"), F.size(F.concat("all", "chosen")).alias("joined"))


def preset_sweep(spark, sf_dir):
    """Every rally preset on the same peaks: how many rallies each finds, and their hits."""
    from functools import reduce

    from burstline.config import RALLY_PRESETS
    from burstline.operators import detection as D
    from burstline.sources.tables import signal

    found = []
    for name, config in RALLY_PRESETS.items():
        rows = D.valid(D.rallies(D.fixed_gap_sessions(D.confident(signal(spark, sf_dir), config), config), config))
        found.append(rows.agg(F.count("*").alias("rallies"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).withColumn("preset", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), found)


def _sweep_sql() -> str:
    from burstline.config import RALLY_PRESETS
    from burstline.sources.tables import SIGNAL_SQL

    parts = []
    for name, c in RALLY_PRESETS.items():
        parts.append(f"""
            SELECT '{name}' AS preset, count(*) AS rallies, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits FROM (
                SELECT video_id, cluster, min(t) AS a, max(t) AS b, count(*) AS hits FROM (
                    SELECT *, sum(CASE WHEN gap > {c.max_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cluster FROM (
                        SELECT *, t - lag(t) OVER (PARTITION BY video_id ORDER BY t, seq) AS gap FROM signal WHERE confidence >= {c.min_confidence}::DOUBLE))
                GROUP BY video_id, cluster HAVING count(*) >= {c.min_hits})
            WHERE b - a + ({c.pre_padding}::DOUBLE + {c.post_padding}::DOUBLE) * CASE WHEN b - a < 5 THEN 0.9::DOUBLE WHEN b - a > 12 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END >= {c.min_duration}
              AND (b - a) / (hits - 1) BETWEEN 0.2::DOUBLE AND 10""")
    return f"WITH {SIGNAL_SQL} " + " UNION ALL ".join(parts)


QUERIES |= {
    "model_excitement": (
        model_excitement,
        h("""SELECT video_id, rally_number, round(25 * least(duration / 30, 1) + 30 * (score / 100) + CASE WHEN is_favorite THEN 20 ELSE 0 END + CASE WHEN round(score % 10 / 10, 9) > 0.7 THEN 10 ELSE 5 END
             + 15 * (0.5::DOUBLE * least(duration % 5 / 10 / 0.3::DOUBLE, 1) + 0.5::DOUBLE * least(duration % 4 / 2 / 2, 1)), 8) AS excitement FROM highlights"""),
    ),
    "behaviour_score": (
        behaviour_score,
        f"""WITH {SIGNAL_SQL}, n AS (SELECT video_id, max(t) AS now FROM signal GROUP BY video_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY video_id, event_type ORDER BY t DESC, seq DESC) AS place FROM signal WHERE event_type IN ('click', 'view')),
        s AS (SELECT video_id, count(*) FILTER (now - t < 60) AS swipes FROM k JOIN n USING (video_id) WHERE event_type = 'click' AND place <= 20 GROUP BY video_id),
        p AS (SELECT video_id, avg(value % 20) AS stay FROM k WHERE event_type = 'view' AND place <= 20 GROUP BY video_id)
        SELECT video_id, coalesce(swipes, 0) AS swipes, round(coalesce(stay, 10.0::DOUBLE), 6) AS stay,
               round(CASE WHEN swipes IS NULL THEN 0.5::DOUBLE ELSE 0.6::DOUBLE * least(swipes / 10.0::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * greatest(1 - coalesce(stay, 10.0::DOUBLE) / 10, 0.0::DOUBLE) END, 6) AS score
        FROM n LEFT JOIN s USING (video_id) LEFT JOIN p USING (video_id)""",
    ),
    "export_names": (
        export_names,
        """WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN ' . ' ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN '??' ELSE p_type || '/' || p_size END AS name FROM part),
        c AS (SELECT p_partkey, p_size, regexp_replace(translate(array_to_string([x FOR x IN string_split_regex(title, '[\\/:?%*|"<>\x00-\x1F\x7F]') IF x <> ''], '_'), ' ', '_'), '^[._]+|[._]+$', '', 'g') AS t,
                     regexp_replace(translate(array_to_string([x FOR x IN string_split_regex(name, '[\\/:?%*|"<>\x00-\x1F\x7F]') IF x <> ''], '_'), ' ', '_'), '^[._]+|[._]+$', '', 'g') AS n FROM r)
        SELECT p_partkey, CASE WHEN t = '' THEN 'video' ELSE substr(t, 1, 80) END || '_' || CASE WHEN n = '' THEN 'export' ELSE substr(n, 1, 80) END || '_' || p_size || '.mp4' AS name FROM c""",
    ),
    "export_ranges": (
        export_ranges,
        """SELECT l_linenumber, count(*) AS n, round(sum(l_tax * 300 - (l_quantity - 5)), 3) AS seconds FROM lineitem WHERE l_quantity - 5 >= 0 AND l_tax * 300 > l_quantity - 5 GROUP BY l_linenumber""",
    ),
    "progress_ratios": (
        progress_ratios,
        h("""SELECT video_id, rally_number, round(CASE WHEN duration - 10 > 0 THEN least(duration / 2 / (duration - 10), 1) ELSE 0 END, 6) AS share, round((rally_number - 1 + 0.5::DOUBLE) / 7, 6) AS "within",
             round(greatest(0, least(1, (duration / 3 - 2) / greatest(duration - 2, 0.01::DOUBLE))), 6) AS played,
             CAST(floor(CASE WHEN duration - 10 > 0 THEN least(duration / 2 / (duration - 10), 1) ELSE 0 END * 10 + 0.5::DOUBLE) AS BIGINT) AS tens FROM highlights"""),
    ),
    "paging_window": (paging_window, h(", n AS (SELECT video_id, count(*) AS n FROM highlights GROUP BY video_id) SELECT video_id, unnest(range(0, least(n, 5))) AS dot FROM n").replace(") , n AS", "), n AS")),
    "cache_keys": (cache_keys, "SELECT user_id || '_' || CAST(floor(value) AS INTEGER) || '_thumb' AS key, count(*) AS n FROM events GROUP BY ALL"),
    "array_set_ops": (
        array_set_ops,
        h(""", g AS (SELECT video_id, list(DISTINCT rally_number) AS a, coalesce(list(DISTINCT rally_number) FILTER (is_favorite), []) AS c FROM highlights GROUP BY video_id)
        SELECT video_id, array_to_string(list_sort(list_distinct(list_concat(c, [1, 2]))), ',') AS added, coalesce(array_to_string(list_sort([x FOR x IN a IF NOT list_contains(c, x)]), ','), '') AS "left", len(a) = len(c) AS every, CAST(len(a) + len(c) AS INTEGER) AS joined FROM g"""),
    ),
    "preset_sweep": (preset_sweep, _sweep_sql()),
}
