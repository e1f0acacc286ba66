"""Text, retrieval, linkage, graph and domain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.ranges import numbered
from millrace.operators import domain as D, linkage as K, text as X
from millrace.plans.tables import sql, table


def chunks(spark, d):
    return X.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 500, 50).select("doc_id", "chunk_index", "start", F.md5("chunk").alias("digest"))


def sentence_chunks(spark, d):
    return X.sentence_chunks(table(spark, d, "conversations"), "text", 200).select("conv_id", "turn", "chunk_index", F.length("chunk").alias("size"))


def recursive_chunks(spark, d):
    return X.recursive_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 400).select("doc_id", "chunk_index", F.length("chunk").alias("size"))


def redacted(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("digest"))


def bm25(spark, d):
    out = X.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"), F.round(F.sum("score"), 2).alias("total"))


def nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    out = X.vector_top_k(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"), "vec_id", "embedding", "q", "embedding", 10)
    return out.select("query_id", "vec_id", F.round("score", 4).alias("score"))


def fused(spark, d):
    v = table(spark, d, "embeddings").selectExpr("vec_id", "vec_id % 97 AS a", "(vec_id * 31) % 89 AS b")
    rank = lambda by: numbered(v, [by, "vec_id"], "n").select("vec_id", (F.col("n") - 1).alias("r"))
    return X.reciprocal_rank_fusion(rank("a").union(rank("b")), "vec_id", "r").withColumn("score", F.round("score", 8))


def shared_tokens(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return X.group_by_shared_tokens(c, "id", "text", 0.15).withColumn("similarity", F.round("similarity", 8))


def near_duplicates(spark, d):
    return X.near_duplicate_groups(table(spark, d, "documents"), "doc_id", "text", 0.6).withColumnRenamed("id", "doc_id")


def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(X.html_to_text("html")).alias("size"))


def pruned(spark, d):
    return X.prune_conversation(table(spark, d, "conversations"), "conv_id", "turn", "text", 1500, "role").select("conv_id", "turn")


def chunk_changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    now = X.fixed_chunks(docs.where("lang <> 'de'"), "text", 1000)
    old = X.fixed_chunks(docs.where("lang <> 'es'"), "text", 1000).select("doc_id", F.sha2("chunk", 256).alias("digest"))
    return X.new_chunks(now, old, "doc_id", "chunk")


def fuzzy(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return K.fuzzy_deduplicate(p, "id", "p_name", 2, 0.6)


def fuzzy_jaro(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return K.fuzzy_pairs(p, "id", "p_name", 1, 0.85, "jaro_winkler").withColumn("score", F.round("score", 6))


def fuzzy_brands(spark, d):
    """Names with their brands: some thousand values in blocks of very different sizes."""
    p = sql(spark, d, "SELECT p_name || ' ' || p_brand AS v, min(p_partkey) AS id FROM part GROUP BY 1", "part")
    return K.fuzzy_pairs(p, "id", "v", 1, 0.9).withColumn("score", F.round("score", 6))


def candidates(spark, d):
    a = sql(spark, d, "SELECT s_suppkey AS id, s_nationkey AS nation, floor(s_acctbal / 100) AS band, s_suppkey % 7 AS digit FROM supplier", "supplier")
    b = sql(spark, d, "SELECT c_custkey AS id, c_nationkey AS nation, nullif(floor(c_acctbal / 100), 3) AS band, c_custkey % 7 AS digit FROM customer", "customer")
    out = K.link_candidates(a, b, [K.Field("nation", 0.9, 0.1), K.Field("band", 0.8, 0.2), K.Field("digit", 0.7, 0.2)], ("id", "id"), 6.0, 2.9)
    return out.withColumn("score", F.round("score", 6))


def linked(spark, d):
    a = sql(spark, d, "SELECT s_suppkey AS id, s_nationkey AS nation, floor(s_acctbal / 1000) AS band FROM supplier", "supplier")
    b = sql(spark, d, "SELECT c_custkey AS id, c_nationkey AS nation, nullif(floor(c_acctbal / 1000), 3) AS band FROM customer", "customer")
    out = K.link(a, b, [K.Field("nation", 0.9, 0.1), K.Field("band", 0.8, 0.2)], ("id", "id"), 4.0, 0.0)
    return out.withColumn("score", F.round("score", 6))


def walk(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b"))
    start = spark.createDataFrame([(1_000_003,)], "id long")
    return K.breadth_first(edges, start, 3, undirected=True).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def components(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") + 1_000_000_000).alias("b"))
    v = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    return K.connected(e, v).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_LIFE = "SELECT user_id, CAST(max(event_id) % 400 AS BIGINT) AS days, max(event_id) % 3 = 0 AS died, user_id % 2 AS arm FROM events GROUP BY user_id"


def survival(spark, d):
    out = D.survival_curve(sql(spark, d, _LIFE, "events"), "days", "died", ["arm"], ["user_id"])
    return out.select("user_id", "at_risk", F.round("survival", 8).alias("survival"))


def declines(spark, d):
    e = table(spark, d, "events").withColumn("rate", F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value") + 0.5))
    return D.decline_rate(e, ["user_id"], "event_id", "rate").select("user_id", F.round("decline", 6).alias("decline"), "n")


def allocated(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return D.allocate(i, ["l_orderkey"], "l_quantity", "o_totalprice").select("l_orderkey", "l_linenumber", F.floor(F.col("allocated") * 100 + 0.3).cast("long").alias("cents"))


def matched(spark, d):
    left = sql(spark, d, "SELECT event_id, user_id % 5 AS g, value FROM events WHERE event_type = 'view'", "events")
    right = sql(spark, d, "SELECT user_id % 5 AS g, value AS place, event_id AS other FROM events WHERE event_type = 'click'", "events")
    out = D.nearest_match(left, right, ["g"], "value", "place", 0.05, "event_id", ["other"])
    return out.where("distance IS NOT NULL").select("event_id", F.round("distance", 6).alias("distance"), "matched_at")


def despiked(spark, d):
    out = D.spikes(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value", 2, 3.0)
    return out.select("event_id", F.round("median", 6).alias("median"), "is_spike")


def running_total(spark, d):
    out = D.cumulative(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")
    return out.select("event_id", F.round("cumulative", 4).alias("cumulative"))


def mapped(spark, d):
    codes = spark.createDataFrame([("view", "V"), ("click", "C")], "code string, meaning string")
    return D.map_codes(table(spark, d, "events").select("event_id", "event_type"), "event_type", codes, "code", "meaning", "short")


def signal_levels(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(D.root_mean_square(F.col("embedding")), 5).alias("rms"), D.zero_crossings(F.col("embedding")).alias("crossings"))


def signal_spectra(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return v.select("vec_id", F.size(D.spectrum("x")).alias("bins"), F.round(F.array_max(D.median_filter("x", 3)), 5).alias("peak"), F.size(D.power_density("x", 64.0, 32)).alias("density_bins"), F.size(D.fir_filter("x", D.low_pass_taps(8.0, 64.0, 9))).alias("filtered"), F.size(D.resample_linear("x", 64.0, 16.0)).alias("resampled"))


_CHUNK = "SELECT doc_id, sha256(text[s + 1:s + 1000]) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 1000, 0) / 1000) AS BIGINT) + 1)) * 1000 AS s FROM documents WHERE length(text) > 0 AND {0})"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_NAMES = "SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1"

QUERIES = {
    "chunk_fixed": (chunks, "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 450 AS INTEGER) AS start, md5(text[i * 450 + 1:i * 450 + 500]) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 500, 0) / 450) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)"),
    "chunk_sentences": (
        sentence_chunks,
        r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0) AS s FROM conversations),
f AS (SELECT conv_id, turn, string_split(list_reduce(s, lambda a, x: CASE WHEN length(string_split(a, chr(2))[-1]) + 1 + length(x) <= 200 THEN a || ' ' || x ELSE a || chr(2) || x END), chr(2)) AS c FROM s WHERE len(s) > 0)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(length(c[i]) AS INTEGER) AS size FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM f)""",
    ),
    "chunk_recursive": (recursive_chunks, None),
    "redact_personal_data": (redacted, "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '" + "', '<redacted>', 'g'), '".join(X.PII.values()) + "', '<redacted>', 'g')) AS digest FROM documents"),
    "bm25": (
        bm25,
        f"""WITH d AS (SELECT doc_id, {_TOK.format("text")} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL), i AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))) AS score FROM q JOIN c USING (term) JOIN i USING (term), n GROUP BY ALL)
SELECT query_id, count(*) AS n, round(max(score), 4) AS best, round(sum(score), 2) AS total FROM s GROUP BY query_id""",
    ),
    **{name: (nearest_vectors, "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) <= 10") for name in ("vector_top_k", "vector_top_k_whole")},
    "rank_fusion": (fused, "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id % 97, vec_id) - 1 AS r FROM embeddings UNION ALL SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 31) % 89, vec_id) - 1 FROM embeddings) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM r GROUP BY 1"),
    "near_duplicate_tokens": (shared_tokens, f"WITH s AS (SELECT conv_id * 1000 + turn AS id, list_distinct({_TOK.format('text')}) AS t FROM conversations) SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 8) AS similarity FROM s x JOIN s y ON x.id < y.id AND len(x.t) > 0 AND len(y.t) > 0 WHERE len(list_intersect(x.t, y.t)) >= 0.15 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))"),
    "near_duplicate_documents": (
        near_duplicates,
        f"""WITH RECURSIVE s AS (SELECT doc_id, list_distinct({_TOK.format("text")}) AS t FROM documents), p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.t, y.t)) AS c, len(x.t) + len(y.t) AS n FROM s x JOIN s y ON x.doc_id <> y.doc_id),
e AS (SELECT a, b FROM p WHERE n = 0 OR c / (n - c) >= 0.6), r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
SELECT doc_id, (SELECT min(c) FROM r WHERE id = doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS links FROM s""",
    ),
    "html_to_text": (page_texts, None),
    "prune_conversation": (pruned, "WITH c AS (SELECT *, role = 'system' AS f FROM conversations), s AS (SELECT *, coalesce(sum(length(text)) FILTER (f) OVER (PARTITION BY conv_id), 0) AS used, sum(CASE WHEN f THEN 0 ELSE length(text) END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c) SELECT conv_id, turn FROM s WHERE f OR used + back <= 1500"),
    "chunk_changes": (chunk_changes, f"WITH n AS (SELECT DISTINCT * FROM ({_CHUNK.format("lang <> 'de'")})), o AS (SELECT DISTINCT * FROM ({_CHUNK.format("lang <> 'es'")})) SELECT *, 'add' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"),
    "fuzzy_deduplicate": (
        fuzzy,
        f"""WITH RECURSIVE n AS ({_NAMES}), e AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.p_name[1:2] = y.p_name[1:2] AND x.id <> y.id AND 1 - levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name)) >= 0.6),
r AS (SELECT id, id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a) SELECT p_name, id FROM n WHERE id = (SELECT min(c) FROM r WHERE r.id = n.id)""",
    ),
    "fuzzy_pairs_jaro_winkler": (
        fuzzy_jaro,
        f"WITH n AS ({_NAMES}) SELECT x.id AS a, y.id AS b, round(jaro_winkler_similarity(lower(x.p_name), lower(y.p_name)), 6) AS score FROM n x JOIN n y ON x.p_name[1] = y.p_name[1] AND x.id < y.id WHERE jaro_winkler_similarity(lower(x.p_name), lower(y.p_name)) >= 0.85",
    ),
    "fuzzy_pairs_brands": (
        fuzzy_brands,
        "WITH n AS (SELECT lower(p_name || ' ' || p_brand) AS v, min(p_partkey) AS id FROM part GROUP BY 1), s AS (SELECT x.id AS a, y.id AS b, 1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v)) AS score FROM n x JOIN n y ON x.v[1] = y.v[1] AND x.id < y.id) SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.9",
    ),
    "link_candidates": (
        candidates,
        """WITH p AS (SELECT s_suppkey AS left_id, c_custkey AS right_id, s_nationkey = c_nationkey AS n, coalesce(floor(s_acctbal / 100) = nullif(floor(c_acctbal / 100), 3), false) AS b, s_suppkey % 7 = c_custkey % 7 AS g FROM supplier, customer),
s AS (SELECT left_id, right_id, CASE WHEN n THEN log2(0.9 / 0.1) ELSE log2(0.1 / 0.9) END + CASE WHEN b THEN log2(0.8 / 0.2) ELSE log2(0.2 / 0.8) END + CASE WHEN g THEN log2(0.7 / 0.2) ELSE log2(0.3 / 0.8) END AS score FROM p)
SELECT left_id, right_id, round(score, 6) AS score, CASE WHEN score >= 6 THEN 'match' ELSE 'review' END AS status FROM s WHERE score >= 2.9""",
    ),
    "probabilistic_link": (
        linked,
        """WITH p AS (SELECT s_suppkey AS left_id, c_custkey AS right_id, s_nationkey = c_nationkey AS n, coalesce(floor(s_acctbal / 1000) = nullif(floor(c_acctbal / 1000), 3), false) AS s FROM supplier, customer),
w AS (SELECT *, CASE WHEN n THEN log2(9.0) ELSE log2(0.1 / 0.9) END + CASE WHEN s THEN log2(4.0) ELSE log2(0.25) END AS x FROM p WHERE n OR s) SELECT left_id, right_id, round(x, 6) AS score, CASE WHEN x >= 4 THEN 'match' WHEN x >= 0 THEN 'review' ELSE 'non_match' END AS status FROM w""",
    ),
    "graph_breadth_first": (
        walk,
        """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey + 1000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 1000003::BIGINT AS id, 0 AS d UNION SELECT u.b, r.d + 1 FROM r JOIN u ON r.id = u.a WHERE r.d < 3) SELECT CAST(d AS INTEGER) AS distance, count(*) AS n FROM (SELECT id, min(d) AS d FROM r GROUP BY id) GROUP BY d""",
    ),
    "graph_components": (components, "SELECT min(o_orderkey) AS component, count(*) + 1 AS n FROM orders GROUP BY o_custkey"),
    "survival_curve": (survival, f"WITH l AS ({_LIFE}), r AS (SELECT *, count(*) OVER (PARTITION BY arm) - row_number() OVER (PARTITION BY arm ORDER BY days, user_id) + 1 AS at_risk FROM l) SELECT user_id, at_risk, round(product(1 - died::INT / at_risk) OVER (PARTITION BY arm ORDER BY days, user_id), 8) AS survival FROM r"),
    "decline_rate": (declines, "WITH r AS (SELECT user_id, ln(value + 0.5) AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE event_type <> 'error') SELECT user_id, round(-regr_slope(y, i), 6) AS decline, count(*) AS n FROM r GROUP BY 1"),
    "allocate": (allocated, "SELECT l_orderkey, l_linenumber, CAST(floor(o_totalprice * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100 + 0.3) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "nearest_match": (matched, "WITH l AS (SELECT event_id, user_id % 5 AS g, value FROM events WHERE event_type = 'view'), r AS (SELECT user_id % 5 AS g, value AS place FROM events WHERE event_type = 'click') SELECT event_id, round(min(abs(value - place)), 6) AS distance, arg_min(place, (abs(value - place), place)) AS matched_at FROM l JOIN r USING (g) WHERE abs(value - place) <= 0.05 GROUP BY event_id"),
    "despike": (despiked, "WITH m AS (SELECT event_id, value, list(value) OVER w AS a, median(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), o AS (SELECT *, list_median(list_transform(a, lambda x: abs(x - m))) AS o FROM m) SELECT event_id, round(m, 6) AS median, o > 0 AND abs(value - m) > 3 * 1.4826 * o AS is_spike FROM o"),
    "cumulative": (running_total, "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS cumulative FROM events"),
    "map_codes": (mapped, "SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' ELSE '' END AS short FROM events"),
    "signal_levels": (signal_levels, "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 5) AS rms, CAST(len(list_filter(range(1, len(embedding)), lambda i: (embedding[i] < 0) <> (embedding[i + 1] < 0))) AS INTEGER) AS crossings FROM embeddings"),
    "signal_spectra": (signal_spectra, None),
}
