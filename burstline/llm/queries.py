"""The queries of the operators of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm import decontaminate, hard_negatives, importance, language_id, line_dedup, lm_score, neardup, packing, secret_scan, sentence_pieces, substring_dedup, topk_search, url_filter
from burstline.llm.tables import read


#: (verdict, host, path) of op4. Fixed values.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents")).drop("found")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = lm_score.word_counts(docs)
    vocabulary = lm_score.vocabulary(counts)
    coded = lm_score.encoded(docs, vocabulary)
    return lm_score.score(coded, lm_score.train(coded, vocabulary), counts)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.delete_repeated_lines(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_parts(read(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.decode(sentence_pieces.encode(read(spark, sf_dir, "documents"), path), path)
    decimals = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, orders=(1, 1), buckets=10_000, least_words=20, seed=2024)
    return drawn.drop("n_words")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, positives=5, negatives=5, lo_percent=80, hi_percent=100, scale=256, label=label)


def _secrets_sql() -> str:
    """Matches of each pattern with their places, then the owners of each value, then the digests."""
    parts = [*secret_scan.BASE, ("owned", secret_scan.CANDIDATE, 0, 20)]
    found = []
    for i, (_, pattern, group, least) in enumerate(parts):
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""
            SELECT r, {i} AS kind, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN w[1:i - 1]]), 0) AS BIGINT) AS s, length(w[i]) AS n, v[i] AS value
            FROM (SELECT r, w, v, g, unnest(range(1, len(w) + 1)) AS i FROM (
                SELECT r, regexp_extract_all(text, {p}, 0) AS w, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS g
                FROM t WHERE regexp_matches(text, {p})))
            WHERE length(v[i]) >= {least}""")
    n = len(secret_scan.BASE)
    names = "[" + ", ".join(f"'{kind}'" for kind, *_ in parts) + "]"
    return f"""
        WITH t AS (
            SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(source, '') AS owner,
                   concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text
            FROM documents
        ), f AS ({" UNION ALL ".join(found)}
        ), m AS (
            SELECT f.*, owner, repository, sha256(value) AS hash FROM f JOIN t USING (r)
            WHERE kind < {n} OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
              AND NOT EXISTS (SELECT 1 FROM f AS b WHERE b.r = f.r AND b.kind < {n} AND b.s < f.s + f.n AND f.s < b.s + b.n))
        ), held AS (
            SELECT hash, count(DISTINCT owner) <= {secret_scan.MOST_OWNERS} AND count(DISTINCT owner || chr(10) || repository) <= {secret_scan.MOST_REPOSITORIES} AS live
            FROM m GROUP BY hash
        ), j AS (
            SELECT r, kind, live, s, {names}[kind + 1] || ':' || s || ':' || (s + n) AS span
            FROM m JOIN held USING (hash) WHERE kind < {n} OR live
        ), d AS (
            SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                   count(*) FILTER (kind = {n}) AS n_owned, count(*) FILTER (kind < {n} AND NOT live) AS n_example,
                   string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {n}) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
            FROM j GROUP BY r
        )
        SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               CAST(coalesce(n_owned, 0) AS BIGINT) AS n_owned, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
        FROM t LEFT JOIN d USING (r)
    """


def _line_dedup_sql() -> str:
    """By the definition: lines of a run that stands earlier anywhere, on the lines themselves."""
    least = line_dedup.GRAM + line_dedup.WINDOW - 1
    return f"""
        WITH a AS (
            SELECT doc_id, [trim(x, ' ') FOR x IN string_split(text, chr(10)) IF trim(x, ' ') <> ''] AS ls FROM documents
        ), w AS (
            SELECT doc_id, ls, unnest(range(1, len(ls) - {least - 2})) AS pos FROM a
        ), r AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY ls[pos:pos + {least - 1}] ORDER BY doc_id, pos) AS nth FROM w
        ), g AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + {least})) AS n FROM r WHERE nth > 1
        ), q AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM documents
        ), c AS (
            SELECT *, CASE WHEN trim(line, ' ') <> '' THEN count(*) FILTER (trim(line, ' ') <> '') OVER (PARTITION BY doc_id ORDER BY place) END AS n FROM q
        )
        SELECT c.doc_id, CAST(count(c.n) AS BIGINT) AS n_lines, CAST(count(g.n) AS BIGINT) AS n_deleted,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (g.n IS NULL), '')) AS kept_sha256
        FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.n = c.n GROUP BY c.doc_id
    """


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

def _near_dedup_sql(k: int, percent: int) -> str:
    grams = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE [{grams} FOR i IN range(1, len(w) - {k - 2})] END) AS g FROM d
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id AS node, doc_id AS root FROM n
            UNION
            SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
        ), m AS (
            SELECT node, min(root) AS root FROM r GROUP BY node
        )
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = doc_id
    """


def _importance_sql() -> str:
    """CRC-32 by its bytewise table, once for each distinct word."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH RECURSIVE bits AS (
            SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS r(i)
            UNION ALL
            SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
        ), tab AS (
            SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
        ), d AS (
            SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {words} AS w FROM documents
        ), x AS (
            SELECT r, unnest(w) AS word FROM d
        ), y AS (
            SELECT unnest({words}) AS word FROM benchmark
        ), u AS (
            SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM x UNION SELECT word FROM y)
        ), b AS (
            SELECT word, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(CAST('0x' || h[2 * i - 1:2 * i] AS INTEGER) AS BIGINT) FOR i IN range(1, len(h) // 2 + 1)],
                   lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1])), 4294967295) % 10000 AS bucket
            FROM u, tab
        ), s AS (
            SELECT bucket, count(*) AS s FROM x JOIN b USING (word) GROUP BY bucket
        ), t AS (
            SELECT bucket, count(*) AS t FROM y JOIN b USING (word) GROUP BY bucket
        ), g AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM x) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM y) + 10000)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), f AS (
            SELECT r, count(*) AS n, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM x JOIN b USING (word) JOIN g USING (bucket) GROUP BY r
        ), z AS (
            SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN f USING (r)
        ), k AS (
            SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n >= 20) OVER () AS eligible FROM z
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM k
    """


SQL: dict[str, str] = {
    "op12_importance_resampling": _importance_sql(),
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
            FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op5_minhash_near_dedup": _near_dedup_sql(3, 85),
    "op2_secret_scan": _secrets_sql(),
    "op7_line_dedup": _line_dedup_sql(),
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), c AS (
            SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM c AS q JOIN c ON q.d = c.d AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
            GROUP BY ALL
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
}
