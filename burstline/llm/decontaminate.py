"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.tables import join_small, written

#: Tokens of a template window.
WINDOW = 8
#: Share of an item's windows that a document must hold, in percent, to be contaminated by it.
LEAST_PERCENT = 50
#: Units of measure that become ``<unit>`` after a number. Fixed values.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hr", "hrs", "hours", "minutes", "seconds", "days", "weeks", "years", "miles", "mile", "feet", "foot", "inches", "inch", "yards", "pounds", "lb", "lbs", "oz", "dollars", "cents", "euros", "usd", "eur", "percent", "kmh", "mph", "degrees", "watts", "volts")
_TRIM = ".,;:!?\"'()[]{}<>|*#%&$-_/\\"


def _once(value: Column) -> Column:
    """``value`` as a column that is computed once a row, also where a lambda refers to it."""
    return F.explode(F.array(value))


def templates(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with arrays ``raw`` and ``token`` of equal length instead of the text.

    ``raw`` has the words without the punctuation around them, ``token`` the template: ``<num>``
    for what has a digit first, ``<unit>`` for a unit of measure after a number, ``<name>`` for a
    capitalised word inside a sentence, else the word in lower case. Words of punctuation alone
    are dropped. Null text: empty arrays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(text, "[\\r\\n]+", " . "), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    rows = rows.withColumn("__w", _once(F.transform(words, lambda w: F.struct(F.btrim(w, F.lit(_TRIM)).alias("core"), F.substring(w, -1, 1).isin(".", "!", "?").alias("ends")))))
    ended = F.concat(F.array(F.lit(True)), F.transform("__w", lambda w: w["ends"]))
    rows = rows.withColumn("__w", _once(F.filter(F.zip_with("__w", F.slice(ended, 1, F.size("__w")), lambda w, e: F.struct(w["core"].alias("core"), e.alias("first"))), lambda w: w["core"] != "")))
    rows = rows.withColumn("raw", _once(F.transform("__w", lambda w: w["core"])))
    before = F.slice(F.concat(F.array(F.lit("")), F.col("raw")), 1, F.size("raw"))

    def token(w: Column, previous: Column) -> Column:
        core = w["core"]
        low = F.lower(core)
        digit = F.substring(core, 1, 1).between("0", "9")
        unit = F.substring(previous, 1, 1).between("0", "9") & low.isin(*UNITS)
        letter = F.substring(core, 1, 1)
        return F.when(digit, "<num>").when(unit, "<unit>").when(~w["first"] & (letter != F.lower(letter)), "<name>").otherwise(low)

    return rows.withColumn("token", _once(F.zip_with("__w", before, token))).drop("__w", text_col)


def _hashed(rows: DataFrame, n: Column, keep: list[str], words: Column) -> DataFrame:
    """``keep``, ``n``, ``at`` and ``hash``: one row for each window of ``n`` of the ``words``; none where they are fewer."""
    rows = rows.withColumn("__h", _once(F.transform(words, lambda x: F.xxhash64(x)))).withColumn("n", n).where(F.size("__h") >= F.col("n"))
    starts = F.sequence(F.lit(0), F.size("__h") - F.col("n"))
    return rows.select(*keep, "n", F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice("__h", i + 1, F.col("n"))))).alias("at", "hash"))


def _lengths(items: DataFrame, width: int) -> Column:
    """The lengths of windows that ``items`` need: one value a row, exploded where there are more."""
    lengths = sorted(r[0] for r in items.select(F.least(F.size("token"), F.lit(width))).distinct().collect())
    return F.explode(F.array(*(F.lit(x) for x in lengths))) if len(lengths) > 1 else F.lit(lengths[0] if lengths else width)


def _held_whole(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(id, key, item, found, windows, substituted): documents that hold all words of an item in a row."""
    raw = F.transform("raw", lambda x: F.lower(x))
    own = written(_hashed(items, F.least(F.size("raw"), F.lit(width)), ["item"], raw).distinct(), "whole")
    totals = own.groupBy("item").agg(F.count_distinct("at").alias("places"), F.count_distinct("hash").alias("windows"))
    hits = join_small(_hashed(templates(rows), _lengths(items, width), ["id", "key"], raw).withColumnRenamed("at", "doc_at"), own.drop("n"), "hash")
    found = hits.groupBy("id", "key", "item", (F.col("doc_at") - F.col("at")).alias("shift")).agg(F.count_distinct("at").alias("held"))
    found = join_small(found, totals, "item").where("held = places")
    return found.select("id", "key", "item", F.col("windows").alias("found"), "windows", F.lit(False).alias("substituted")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(id, item, windows, found, share, substituted, text_hash): every document that holds an item's template.

    Both sides are brought to templates, and windows of ``width`` tokens are joined by hash. A
    found window counts if its slots are consistent: over all found windows of one occurrence of the
    item in the document, each value of a slot in the item stands for one value in the document, and
    each raw word that isn't a slot agrees. Occurrences are told apart by alignment, the place in the
    document less that in the item: windows of one alignment, of alignments with steps of ``width``
    tokens at most (words put in or left out), and of the whole document (an item in distant pieces)
    are each judged, and the best counts, of equals the one without a slot that differs. ``windows`` is the number of the item's different windows,
    ``found`` how many of them the document holds, ``substituted`` whether any slot differs, so
    that the question is re-parameterised and not copied. A document is contaminated by an item if
    100 * found >= ``least_percent`` * windows.

    Items with fewer than ``width`` tokens are one window of their own length, anywhere in a document.
    Windows of which less than half are plain words are not compared as templates; an item that has
    no others is held by a document with all its words, as they are but for case, in a row. Null
    texts hold nothing; null ids are kept; repeated rows answer alike, once for each id and text, whose hash is ``text_hash``.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    items = written(templates(items).where(F.size("token") > 0), "items")
    plain = lambda tokens: F.size(F.filter(tokens, lambda x: ~x.startswith("<")))
    own = _hashed(items, F.least(F.size("token"), F.lit(width)), ["item", "raw", "token"], F.col("token"))
    own = own.select("item", "hash", F.col("at").alias("item_at"), F.slice("raw", F.col("at") + 1, F.col("n")).alias("item_raw"), F.slice("token", F.col("at") + 1, F.col("n")).alias("item_token"))
    own = own.where(2 * plain(F.col("item_token")) >= F.size("item_token")).withColumn("window", F.col("hash")).withColumn("inside", F.lit(False))
    # the one window of a short item also as it reads inside a sentence, where its capital makes a name
    start = F.substring(F.element_at("item_raw", 1), 1, 1)
    inside = own.where((F.size("item_token") < width) & ~F.element_at("item_token", 1).startswith("<") & (start != F.lower(start))).withColumn("inside", F.lit(True))
    inside = inside.withColumn("item_token", _once(F.concat(F.array(F.lit("<name>")), F.slice("item_token", 2, width)))).withColumn("hash", F.xxhash64(F.transform("item_token", lambda x: F.xxhash64(x))))
    own = written(own.unionByName(inside).distinct(), "windows")
    totals = own.groupBy("item").agg(F.count_distinct("window").alias("windows"))
    by_template = items.join(totals.select("item"), "item", "left_semi")
    dense = written(items.join(totals.select("item"), "item", "left_anti"), "dense")

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    hits = join_small(_hashed(templates(rows), _lengths(by_template, width), ["id", "key"], F.col("token")), own.select("hash").distinct(), "hash", "left_semi").distinct()
    hits = written(hits.groupBy("id", "key").agg(F.collect_list(F.struct("at", "n", "hash")).alias("hits")), "hits")
    # only documents with a hit are read again, for their words
    again = templates(join_small(rows, hits.withColumnRenamed("id", "hit_id"), "key", elements="hits").where(F.col("id").eqNullSafe(F.col("hit_id"))).drop("hit_id").dropDuplicates(["id", "key"]))
    again = again.withColumn("hit", F.explode("hits")).select("id", "key", F.col("hit.at").alias("doc_at"), F.col("hit.hash").alias("hash"), F.slice("raw", F.col("hit.at") + 1, F.col("hit.n")).alias("doc_raw"), F.slice("token", F.col("hit.at") + 1, F.col("hit.n")).alias("doc_token"))
    pairs = written(join_small(again, own, "hash", elements="item_raw").where(F.col("doc_token") == F.col("item_token")).where(~F.col("inside") | (F.lower(F.element_at("doc_raw", 1)) == F.lower(F.element_at("item_raw", 1)))), "pairs")

    slots = F.filter(F.zip_with(F.arrays_zip("item_token", "item_raw"), "doc_raw", lambda i, d: F.when(i["item_token"].startswith("<"), F.struct(F.concat_ws(" ", i["item_token"], F.lower(i["item_raw"])).alias("slot"), F.lower(d).alias("value")))), lambda x: x.isNotNull())
    pairs = pairs.select("id", "key", "item", "window", (F.col("doc_at") - F.col("item_at")).alias("shift"), slots.alias("slots"))
    order = Window.partitionBy("id", "key", "item").orderBy("shift")
    pairs = pairs.withColumn("step", F.col("shift") - F.lag("shift").over(order))
    near = F.sum(F.when(F.col("step") > width, 1).otherwise(0)).over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")
    occurrences = F.array(*(F.struct(F.lit(level).alias("level"), group.alias("group")) for level, group in enumerate((F.col("shift"), F.col("near"), F.lit(0)))))
    pairs = written(pairs.withColumn("near", near).select("id", "key", "item", "window", "slots", F.explode(occurrences).alias("part")), "occurrences")
    filled = pairs.select("id", "key", "item", "part", F.explode("slots").alias("s")).groupBy("id", "key", "item", "part", "s").agg(F.count("*").alias("n"))
    # the value that fills a slot most often; windows that fill it otherwise are inconsistent
    chosen = filled.groupBy("id", "key", "item", "part", F.col("s.slot").alias("slot")).agg(F.max(F.struct("n", "s.value")).alias("best"))
    chosen = chosen.groupBy(F.col("id").alias("c_id"), F.col("key").alias("c_key"), F.col("item").alias("c_item"), F.col("part").alias("c_part")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "best.value"))).alias("values"))
    judged = pairs.join(chosen, (F.col("key") == F.col("c_key")) & F.col("id").eqNullSafe(F.col("c_id")) & (F.col("item") == F.col("c_item")) & (F.col("part") == F.col("c_part")), "left")
    judged = judged.where(F.forall("slots", lambda s: s["value"] == F.element_at("values", s["slot"])))
    changed = F.exists("slots", lambda s: F.substring_index(s["slot"], " ", -1) != s["value"])
    found = judged.groupBy("id", "key", "item", "part").agg(F.count_distinct("window").alias("found"), F.max(changed).alias("substituted"))
    found = found.groupBy("id", "key", "item").agg(F.max(F.struct("found", (~F.col("substituted")).alias("same"))).alias("best"))
    found = found.select("id", "key", "item", "best.found", (~F.col("best.same")).alias("substituted"))
    found = join_small(found, totals, "item").where(100 * F.col("found") >= least_percent * F.col("windows"))
    found = found.select("id", "key", "item", "found", "windows", "substituted")
    if not dense.isEmpty():
        found = found.unionByName(_held_whole(rows, dense, width))
    found = found.groupBy("id", "key", "item").agg(F.max("windows").alias("windows"), F.max("found").alias("found"), F.max(F.col("found") / F.col("windows")).alias("share"), F.max("substituted").alias("substituted"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "windows", "found", "share", "substituted", F.col("key").alias("text_hash"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated documents.

    A document is an id with a text: texts that share an id, or have none, are judged apart, and rows that
    repeat both go or stay together. Null and empty texts stay. The columns are those of ``docs``.
    """
    bad = contaminated(docs, benchmark, id_col, text_col, **how).select(F.col(id_col).alias("id"), "text_hash").distinct()
    bad = written(bad.select(F.struct("id", "text_hash").alias("gone")), "contaminated")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("pair"), F.struct(*docs.columns).alias("row"))
    return join_small(rows, bad, F.col("pair") == F.col("gone"), "left_anti").select("row.*")
