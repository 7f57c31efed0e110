"""Removal of repeated runs of lines by winnowed fingerprints, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.tables import written

#: Lines of a fingerprint, and of the window whose least fingerprint is selected.
GRAM = 2
WINDOW = 2


def _hash(text):
    """60 bits of the MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _once(value):
    """``value`` as a column that is computed once a row, also where a lambda refers to it."""
    return F.explode(F.array(value))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, at, print, before, after, contexts): the selected positions of each text, once each.

    Each ``gram`` filled lines in a row are hashed, and of each ``window`` such hashes in a row the
    least is selected (the last of equals). A position that several windows select is one row: ``at`` is its
    first line among the filled ones, ``print`` its hash; ``before`` and ``after`` are the hashes of the ``window`` - 1 lines
    on either side, nearest first, and ``contexts`` has for each window that selects it the hash of all the window's lines, which
    tells apart what surrounds equal fingerprints.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _once(F.transform(lines, lambda x: F.xxhash64(x))).alias("h"))
    rows = rows.where(F.size("h") >= gram + window - 1)
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.xxhash64(F.slice("h", i + 1, gram)))
    rows = rows.withColumn("g", _once(grams))

    def of_window(i):
        # the negative place makes the least struct the last of equal hashes
        least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda j: F.struct(F.element_at("g", i + j + 1).alias("g"), (-j).alias("at"))))
        return F.struct((i - least["at"]).alias("at"), F.xxhash64(F.slice("h", i + 1, gram + window - 1)).alias("context"))

    rows = rows.withColumn("w", _once(F.transform(F.sequence(F.lit(0), F.size("g") - window), of_window)))
    # selected places never go back, so those of a position stand in a row: it opens where the place before differs
    opens = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1)["at"] != x["at"]), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("opens", _once(opens))
    ends = F.concat(F.slice("opens", 2, F.size("opens")), F.array(F.size("w")))
    parts = F.zip_with("opens", ends, lambda a, b: F.struct(F.get("w", a)["at"].alias("at"), F.transform(F.slice("w", a + 1, b - a), lambda x: x["context"]).alias("contexts")))
    rows = rows.select("id", "text_hash", "g", "h", F.explode(parts).alias("p")).select("id", "text_hash", "g", "h", "p.at", "p.contexts")
    near = F.least(F.col("at"), F.lit(window - 1))
    before = F.reverse(F.slice("h", F.col("at") - near + 1, near))
    after = F.slice("h", F.col("at") + gram + 1, window - 1)
    return rows.select("id", "text_hash", "at", F.element_at("g", F.col("at") + 1).alias("print"), before.alias("before"), after.alias("after"), "contexts")


def _common(a, b):
    """How many elements two arrays share from their beginning on."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(differs == 0, n).otherwise(differs - 1).cast("int")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, at, n): stretches of ``n`` lines from ``at`` on that stand earlier too, each by a joined position extended both ways.

    Positions whose fingerprint stands nowhere else go first. Those that are left are told apart by context, and each meets the
    first holder of each of its contexts. From there the match is extended line by line to both sides, as far as the
    fingerprint's windows reach; a longer run is the union of its positions' stretches.
    """
    marks = written(fingerprints(docs, id_col, text_col, gram, window), "fingerprints")
    shared = written(marks.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "shared")
    marks = marks.join(shared.hint("merge"), "print", "left_semi").select("id", "text_hash", "at", "before", "after", F.explode("contexts").alias("context"))
    marks = written(marks, "positions")
    place = F.struct("id", "text_hash", "at", "before", "after")
    first = marks.groupBy("context").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    earlier = F.struct("first.id", "first.text_hash", "first.at")
    later = marks.join(written(first, "first").hint("merge"), "context").where(F.struct("id", "text_hash", "at") > earlier)
    left, right = _common(F.col("before"), F.col("first.before")), _common(F.col("after"), F.col("first.after"))
    return later.select("id", "text_hash", (F.col("at") - left).alias("at"), (left + gram + right).alias("n")).distinct()


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, run): positions, among a text's filled lines, of the lines to delete.

    Lines are compared without spaces around them; lines of spaces alone don't count. A run of
    ``gram + window - 1`` lines or more that stands anywhere earlier in the corpus, by id, then
    hash of the text, then position, is a repeat, and its lines are deleted.

    Texts that share so many lines share a selected fingerprint at the same place of them (``fingerprints``), with the same
    context. Positions are joined to the first holder of each context and extended (``matches``); the stretches of a text together
    are its runs. No earlier partner is left out, as a context's first holder has all lines of its window.

    Joins are hinted to be shuffles, so they are the same plan at every size. A very frequent context is counted before the join
    and is one short row per position in it, which adaptive execution splits.
    """
    found = matches(docs, id_col, text_col, gram, window)
    lines = found.groupBy("id", "text_hash").agg(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("runs"))
    return lines.select("id", "text_hash", F.array_sort(F.array_distinct(F.flatten("runs"))).alias("run"))


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text that is left, and columns n_lines and n_deleted (filled lines).

    The first occurrence of every run stays. Null texts stay null with no lines; texts with fewer
    filled lines than a run are left as they are; rows with the same id and text are treated alike;
    null ids come first. A text whose lines are all deleted becomes empty. Texts of any length are
    read whole, one row at a time; they are shuffled once, by id and hash, to meet their runs. Columns of ``docs`` named like the added ones are replaced.
    """
    runs = repeated_runs(docs, id_col, text_col, gram, window).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("run").alias("__run"))
    same = F.col("__at").eqNullSafe(F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id"))
    joined = docs.withColumn("__at", F.xxhash64(text_col)).join(written(runs, "runs").hint("merge"), same, "left")
    joined = joined.withColumn("__lines", _once(F.split(F.col(text_col), "\n", -1)))
    places = F.filter(F.transform("__lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    joined = joined.withColumn("__places", _once(places))
    gone = F.transform("__run", lambda i: F.element_at("__places", (i + 1).cast("int")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    text = F.when(F.col("__run").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n"))
    added = {text_col: text, "n_lines": F.greatest(F.size("__places"), F.lit(0)).cast("long"), "n_deleted": F.greatest(F.size("__run"), F.lit(0)).cast("long")}
    names = [*docs.columns, *(c for c in ("n_lines", "n_deleted") if c not in docs.columns)]
    return joined.select(*((added[c].alias(c) if c in added else F.col(c)) for c in names))
