"""Label files, directory scans with their labels, and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_SCHEMA = "video string, rallies array<struct<startTime:double,endTime:double,excitementScore:double,notes:string>>, metadata map<string,string>"
MEDIA = ("mp4", "mov", "m4v")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled rally of label files (one JSON document each): video, number, start, end, score, notes."""
    rows = spark.read.schema(LABEL_SCHEMA).json(path, multiLine=True)
    return rows.select("video", F.posexplode("rallies").alias("number", "r")).select("video", "number", F.col("r.startTime").alias("start"), F.col("r.endTime").alias("end"), F.col("r.excitementScore").alias("score"), "r.notes")


def write_labels(labels: DataFrame, path: str) -> None:
    """Label rows (video, start, end, score, notes) to one JSON line per video, rallies in order of start."""
    r = F.struct(F.col("start").alias("startTime"), F.col("end").alias("endTime"), F.col("score").alias("excitementScore"), "notes")
    labels.groupBy("video").agg(F.array_sort(F.collect_list(r)).alias("rallies")).write.mode("overwrite").json(path)


def label_templates(media: DataFrame, name: str = "media") -> DataFrame:
    """(video, rallies, metadata): for each media file a label document with one example rally to replace."""
    # field names and example numbers are fixed values of the format
    example = F.struct(F.lit(10.0).alias("startTime"), F.lit(25.5).alias("endTime"), F.lit(80.0).alias("excitementScore"), F.lit("An example; put a rally of the video here").alias("notes"))
    about = {"annotator": F.lit("(who labelled it)"), "date": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "notes": F.lit("Rallies as a person sees them")}
    metadata = F.create_map(*(x for key, value in about.items() for x in (F.lit(key), value)))
    return media.select(F.regexp_extract(name, "([^/]+)$", 1).alias("video"), F.array(example).alias("rallies"), metadata.alias("metadata"))


COURT_SCHEMA = "struct<courts:array<struct<id:string,name:string,city:string,address:string,court_count:int,surface_type:string,price_range:string>>,total:int>"


def read_courts(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """Courts of saved service answers (one JSON text a file), one row each; of one city, if given.

    An answer that isn't JSON gives none; fields that it lacks are null.
    """
    answers = spark.read.text(path, wholetext=True).select(F.from_json("value", COURT_SCHEMA).alias("answer"))
    rows = answers.select(F.inline("answer.courts"))
    return rows if city is None else rows.where(F.col("city") == city)


def media_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, media, label): media files of a folder by extension, each with the JSON file of its name if there is one."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"))
    media = named.where(F.col("kind").isin(*MEDIA)).select("stem", F.col("path").alias("media"))
    labels = named.where("kind = 'json'").select("stem", F.col("path").alias("label"))
    return media.join(labels, "stem", "left")


def in_key_order(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of structs and the keys of maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        ordered = F.struct(*(in_key_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), ordered)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), in_key_order(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def report_json(rows: DataFrame, pretty: bool = False) -> Column:
    """The columns of ``rows`` as one JSON text: keys in order at every depth, times as ISO dates in UTC."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "timeZone": "UTC", "pretty": str(pretty).lower()}
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(in_key_order(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), options)


def write_report(rows: DataFrame, path: str, pretty: bool = False) -> None:
    """Nested rows as JSON (``report_json``), replacing what was there; ``pretty`` indents."""
    rows.select(report_json(rows, pretty).alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def diagnostic_report(candidates: DataFrame, key: str, passed: str, reason: str, detail: list[str], most_detail: int = 100) -> DataFrame:
    """One nested row per key: totals, counts by reason, and the first ``most_detail`` candidates by time as detail."""
    from pyspark.sql import Window

    totals = candidates.groupBy(key).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    reasons = candidates.where(F.col(reason).isNotNull()).groupBy(key, reason).count().groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "count")))).alias("reasons"))
    first = candidates.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("t", "seq"))).where(F.col("__r") <= most_detail)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "seq", *detail))).alias("candidates"))
    return totals.join(reasons, key, "left").join(listed, key, "left")


def analysis_report(rallies: DataFrame, peaks: DataFrame, stats: DataFrame, points: DataFrame, configuration: dict[str, dict[str, float]], key: str = "video_id", exciting: float = 70.0, most_detail: int = 1_000) -> DataFrame:
    """One nested row a video, the whole of its analysis: videoInfo, rallies, hitEvents, intervalStatistics, changePoints, configuration.

    ``rallies`` has cluster, start, end, hits, score, type, mean_confidence and the intensities; ``peaks`` those of
    rallies (cluster, t, confidence, amplitude); ``stats`` one row a video (``interval_statistics``); ``points`` (t, probability,
    run_length, is_change). Counts and sums are over all rows; lists are in order of time, of the first ``most_detail`` each, so
    that a document stays readable. Videos without rallies are left out; what a video lacks is null or empty.
    """
    from pyspark.sql import Window

    duration = F.col("end") - F.col("start")
    count = F.count("*")
    info = rallies.groupBy(key).agg(
        F.struct(
            count.alias("rallyCount"),
            F.sum("hits").alias("totalHitCount"),
            F.avg(duration).alias("averageRallyDuration"),
            F.max(duration).alias("longestRallyDuration"),
            F.count_if(F.col("score") >= exciting).alias("excitingRallyCount"),
            (F.count_if(F.col("score") >= exciting) / count).alias("excitementRate"),
        ).alias("videoInfo")
    )

    def listed(rows: DataFrame, order: tuple[str, ...], name: str, **fields: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        first = rows.withColumn("index", place).where(F.col("index") <= most_detail)
        item = F.struct("index", *(value.alias(c) for c, value in fields.items()))
        return first.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))

    c = F.col
    about = F.struct(c("max_intensity").alias("maxMovementIntensity"), c("mean_intensity").alias("avgMovementIntensity"), (c("hits") > 0).alias("hasAudioPeaks"), c("mean_confidence").alias("poseConfidenceAvg"))
    found = listed(rallies, ("start", "cluster"), "rallies", startTime=c("start"), endTime=c("end"), duration=duration, hitCount=c("hits"), excitementScore=c("score"), detectionConfidence=c("mean_confidence"), type=c("type"), metadata=about)
    hits = listed(peaks.join(rallies.select(key, "cluster"), [key, "cluster"]), ("t", "seq"), "hitEvents", time=c("t"), confidence=c("confidence"), amplitude=c("amplitude"), rally=c("cluster"))
    changes = listed(points, ("t", "seq"), "changePoints", time=c("t"), probability=c("probability"), runLength=c("run_length"), isChangePoint=c("is_change"))
    names = {"mean": "mean", "sd": "stdDev", "median": "median", "p75": "percentile75", "p90": "percentile90", "p95": "percentile95", "boundary": "rallyBoundaryThreshold", "max_interval": "maxHitInterval", "n": "totalPeaks"}
    spread = stats.select(key, F.struct(*(c(a).alias(b) for a, b in names.items())).alias("intervalStatistics"))
    settings = F.struct(*(F.struct(*(F.lit(v).alias(k) for k, v in part.items())).alias(name) for name, part in configuration.items()))
    rows = info.join(found, key).join(hits, key, "left").join(spread, key, "left").join(changes, key, "left")
    return rows.withColumn("configuration", settings)
