"""URL filtering by rules and by gradient-boosted trees on lexical features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.llm.tables import join_small, written

#: Words in host names by which URLs of the training sample are labelled as unwanted. Fixed values.
UNWANTED_WORDS = ("spam", "pills", "casino", "bets", "ads", "porn", "viagra", "lottery", "phish", "malware", "crack", "warez", "xxx", "payday", "replica")
#: The bounded training sample, rows by a hash of the URL.
SAMPLE_ROWS = 20_000
#: URLs of the usual rate that each suffix is given beside its own.
PRIOR = 5
TREES = 12
DEPTH = 4
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share", "hyphens", "entropy", "parameters", "query_length", "fragment_length", "secure", "longest_label", "vowel_share", "suffix_rate")


def parts(url: Column) -> dict[str, Column]:
    """host, path, query and fragment of ``url``; host and path are empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "host": F.translate(host, upper, upper.lower()),
        "path": path,
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(rest, "(?s)^[^#]*#(.*)$", 1),
    }


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    return pages.withColumn("url", F.col(url_col)).withColumns(parts(F.col("url")))


def rule_for(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, both null where none does."""
    fits = []
    for verdict, host, path in rules:
        on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append((len(host + path), verdict, host + path, on_host & F.col("path").startswith(path)))
    fits.sort(key=lambda x: (-x[0], x[2]))
    pick = lambda at: F.coalesce(*(F.when(cond, F.lit(row[at])) for row in fits for cond in [row[3]]))
    return pick(2), pick(1)


def _entropy(text: Column) -> Column:
    """Bits a character of ``text`` carries, over letters and digits of ASCII."""
    n = F.length(text)
    terms = []
    for c in "abcdefghijklmnopqrstuvwxyz0123456789-.":
        share = (n - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.greatest(n, F.lit(1))
        terms.append(F.when(share > 0, -share * F.log2(share)).otherwise(0.0))
    return reduce(lambda a, b: a + b, terms)


def _suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def with_features(rows: DataFrame, suffix_rates: DataFrame, usual_rate: float) -> DataFrame:
    """``rows`` with a column for each of ``FEATURES``; suffixes without a rate have the usual one."""
    named = rows.withColumn("__suffix", _suffix(F.col("host")))
    known = suffix_rates.select(F.col("suffix").alias("__suffix"), F.col("rate").alias("__rate"))
    rows = join_small(named, known, "__suffix", "left").drop("__suffix")
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    n = lambda c: F.length(c).cast("double")
    count = lambda text, pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    share = lambda text, drop: F.when(F.length(text) > 0, count(text, drop) / F.length(text)).otherwise(0.0)
    url = F.concat(host, path, query)
    features = {
        "length": n(url),
        "host_length": n(host),
        "path_length": n(path),
        "depth": count(path, "[^/]"),
        "labels": count(host, "[^.]"),
        "digit_share": share(url, "[^0-9]"),
        "host_digit_share": share(host, "[^0-9]"),
        "hyphens": count(host, "[^-]"),
        "entropy": _entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "[^&]") + 1),
        "query_length": n(query),
        "fragment_length": n(F.col("fragment")),
        "secure": F.coalesce(F.col("url").startswith("https"), F.lit(False)).cast("double"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, "[.]"), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "vowel_share": share(host, "[^aeiou]"),
        "suffix_rate": F.coalesce("__rate", F.lit(usual_rate)),
    }
    return rows.withColumns({f"f_{name}": value for name, value in features.items()}).drop("__rate")


def labelled(rows: DataFrame) -> DataFrame:
    """``label``: 1 where a word of the host name is in ``UNWANTED_WORDS``, else 0."""
    words = F.split("host", "[^a-z]+")
    return rows.where("host <> ''").withColumn("label", F.arrays_overlap(words, F.array(*(F.lit(w) for w in UNWANTED_WORDS))).cast("double"))


class UrlModel:
    """The fitted trees, with the block rate of each suffix (its last two labels)."""

    def __init__(self, trees, suffix_rates: DataFrame, usual_rate: float):
        self.trees, self.suffix_rates, self.usual_rate = trees, suffix_rates, usual_rate

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with parts) and ``p_block``, the trees' probability that the URL is unwanted."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        if self.trees is None:
            return rows.withColumn("p_block", F.lit(self.usual_rate))
        featured = with_features(rows, self.suffix_rates, self.usual_rate)
        scored = self.trees.transform(VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(featured))
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p_block"))


def train(labels: DataFrame, most_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Boosted trees from rows with url, its parts and ``label`` (0 or 1): a sample of ``most_rows`` different URLs, by hash.

    Suffix statistics are block rates over all different labelled URLs, drawn to the usual rate by
    ``PRIOR`` URLs, so that a rare suffix has no extreme one. Repeated URLs count once, with the larger
    label; null URLs are left out. A sample with one kind of label alone gives a model that answers
    its rate.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = ("url", "host", "path", "query", "fragment")
    different = written(labels.where("url IS NOT NULL").groupBy(*names).agg(F.max("label").alias("label")), "labels")
    usual = different.agg(F.avg("label")).first()[0] or 0.0
    rates = different.groupBy(_suffix(F.col("host")).alias("suffix")).agg(((F.sum("label") + PRIOR * usual) / (F.count("*") + PRIOR)).alias("rate"))
    rates = written(rates, "suffixes")
    sample = written(different.orderBy(F.xxhash64("url"), "url").limit(most_rows), "urls")
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return UrlModel(None, rates, kinds[0] if kinds else 0.0)
    featured = with_features(sample, rates, usual)
    rows = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(featured).select("features", "label")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, maxMemoryInMB=64).fit(rows.coalesce(4))
    return UrlModel(fitted, rates, usual)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, p_block) of every row: the rule's verdict, else the trees'.

    ``model``: by default one trained on ``pages`` labelled by words of their host names. Host and
    path are empty for null URLs and those without ``://``; such rows get the trees' verdict for
    empty parts. Repeated rows are judged each; null ids are kept.
    """
    rows = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    model = train(labelled(rows)) if model is None else model
    rule, verdict = rule_for(rules)
    scored = model.score(rows)
    by_trees = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "p_block")
