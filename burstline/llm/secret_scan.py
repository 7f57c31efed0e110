"""Secret scanning by patterns and by corpus-wide ownership of the candidates, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.tables import join_small, written

#: Base kinds, in the order that breaks ties of equal starts: (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What may be a credential though no base pattern says so: a long run that holds letters and digits.
CANDIDATE = r"[A-Za-z0-9_-]{20,}"
#: A candidate is live-looking if at most so many owners and repositories hold it; copied examples are in more.
MOST_OWNERS = 1
MOST_REPOSITORIES = 2


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """All leftmost non-overlapping matches as structs (gap, own, value): code points before, within, and the group."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    lengths = F.zip_with(gaps, whole, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("own")))
    pieces = F.zip_with(lengths, F.regexp_extract_all(text, regex, F.lit(group)), lambda n, value: F.struct(n["gap"].alias("gap"), n["own"].alias("own"), value.alias("value")))
    return F.when(F.regexp_like(text, regex), pieces).otherwise(F.array().cast("array<struct<gap:int,own:int,value:string>>"))


def _spans(rows: DataFrame) -> DataFrame:
    """(row, owner, repository, m) of the matches that count, ``m`` being (start, kind, end, value), end exclusive.

    Ends are running sums over a text's matches of a kind, and what overlaps a base span is told by
    running extremes over its matches by place, so the work grows with the matches and not with their pairs.
    """
    least = F.element_at(F.array(*(F.lit(n) for *_, n in BASE), F.lit(0)), F.col("kind") + 1)
    each = rows.select("row", "owner", "repository", F.posexplode("kinds").alias("kind", "pieces")).select("row", "owner", "repository", "kind", F.posexplode("pieces").alias("n", "piece"))
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    each = each.repartition("row").withColumn("end", F.sum(F.col("piece.gap") + F.col("piece.own")).over(so_far).cast("int"))
    each = each.select("row", "owner", "repository", "kind", (F.col("end") - F.col("piece.own")).alias("start"), "end", F.col("piece.value").alias("value")).where(F.length("value") >= least)
    of_text, base = Window.partitionBy("row"), F.col("kind") < len(BASE)
    before = F.max(F.when(base, F.col("end"))).over(of_text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(of_text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("before", before).withColumn("after", after)
    apart = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    looks = F.regexp_like("value", F.lit("[0-9]")) & F.regexp_like("value", F.lit("[A-Za-z]"))
    return each.where(base | (apart & looks)).select("row", "owner", "repository", F.struct("start", "kind", "end", "value").alias("m"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(kind) for kind, *_ in BASE), F.lit("owned"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Every row of ``docs`` with its secrets: one row per row, with counts, spans and ownership.

    Columns: the id, n_assign, n_access, n_hex (base spans of each kind), base_sha256 (of the base
    spans as ``kind:start:end`` joined by commas), spans (those and the added ones), n_owned (added
    spans), n_example (base spans whose value is widely copied), found (structs with the values).

    Base spans are always kept. Other candidates (long runs of letters and digits) are hashed and
    counted over the whole corpus by distinct owners and repositories; one held by at most
    ``most_owners`` and ``most_repositories`` is live-looking and added, where it overlaps no base
    span. A base value in more than these counts as a copied example, and stays. ``owner`` is the
    source by default, ``repository`` the source and language. Null texts are empty; a null owner
    or repository is one of its own; rows without spans have empty strings and the hash of none;
    ids may be null or repeat, as each row is scanned for itself. Texts of any length are read whole;
    the matches of one text are sorted together, which spills.
    """
    owner = F.coalesce(F.col("source") if owner is None else owner, F.lit(""))
    repository = F.coalesce(F.concat_ws("/", "source", "lang") if repository is None else repository, F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), text.alias("text"))
    kinds = F.array(*(_pieces(F.col("text"), pattern, group) for _, pattern, group, _ in BASE), _pieces(F.col("text"), CANDIDATE, 0))
    rows = rows.select("id", "owner", "repository", kinds.alias("kinds"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "secrets")

    each = _spans(rows.where(F.exists("kinds", lambda k: F.size(k) > 0))).withColumn("hash", F.sha2(F.col("m.value"), 256))
    each = written(each, "spans")
    held = each.groupBy("hash", "owner", "repository").count()
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = join_small(each, held, "hash").withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    m = F.struct("m.start", "m.kind", "m.end", "m.value", "live", "owners", "repositories")
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(m)).alias("all"))
    out = rows.select("id", "row").join(judged, "row", "left")
    spans = F.coalesce(F.filter("all", lambda s: (s["kind"] < len(BASE)) | s["live"]), F.array().cast("array<struct<start:int,kind:int,end:int,value:string,live:boolean,owners:bigint,repositories:bigint>>"))
    out = out.select("id", spans.alias("found"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        *(count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count(len(BASE)).alias("n_owned"),
        F.size(F.filter("found", lambda s: (s["kind"] < len(BASE)) & ~s["live"])).cast("long").alias("n_example"),
        "found",
    )
