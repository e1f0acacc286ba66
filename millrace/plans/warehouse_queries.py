"""Loads of dimensions, histories and vaults over tables derived from customer, orders and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import warehouse as W
from millrace.plans.tables import HISTORY, NEW, OLD, as_text, customer_history, day, new_customers, old_customers, sql, table

_ALL = ["segment", "nation"]


def upsert(spark, d):
    return W.merge_upsert(old_customers(spark, d), new_customers(spark, d), ["id"], _ALL)


def upsert_counts(spark, d):
    return W.upsert_counts(old_customers(spark, d), new_customers(spark, d), ["id"], _ALL)


def sync(spark, d):
    target = old_customers(spark, d).selectExpr("*", "nation < 8 AS is_deleted", "CASE WHEN nation < 8 THEN DATE '2022-01-01' END AS deleted_at")
    return as_text(W.delete_safe_sync(target, new_customers(spark, d), ["id"], _ALL, day()), "deleted_at")


def history(spark, d):
    return as_text(W.scd2(customer_history(spark, d), new_customers(spark, d), ["id"], _ALL, day()), "valid_from", "valid_to")


def previous_value(spark, d):
    target = old_customers(spark, d).selectExpr("*", "'P' AS segment_previous", "CAST(0 AS INT) AS nation_previous")
    out = W.scd3(target, new_customers(spark, d), ["id"], _ALL)
    return out.withColumn("nation_previous", F.col("nation_previous").cast("string"))


def mini(spark, d):
    known = sql(spark, d, "SELECT CAST(row_number() OVER (ORDER BY segment, nation) AS BIGINT) AS mini_sk, segment, nation FROM (SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_nationkey < 5) m", "customer")
    dim = W.mini_dimension(new_customers(spark, d), known, _ALL)
    return W.attach_mini(new_customers(spark, d), dim, _ALL, names=("mini_sk", "current_mini_sk"))


def hybrid(spark, d):
    out = W.scd6(customer_history(spark, d), new_customers(spark, d), ["id"], ["segment"], day())
    return as_text(out, "valid_from", "valid_to")


_HIST7 = f"SELECT h.*, CAST(row_number() OVER (ORDER BY id, valid_from) AS BIGINT) AS scd_id, segment AS current_segment FROM ({HISTORY}) h"


def keyed_history(spark, d):
    out = W.scd7(sql(spark, d, _HIST7, "customer"), new_customers(spark, d), ["id"], ["segment"], day())
    return as_text(out, "valid_from", "valid_to")


def digest_snapshot(spark, d):
    target = sql(spark, d, f"SELECT h.id, h.segment, md5(segment) AS row_hash, valid_from, valid_to, is_current FROM ({HISTORY}) h", "customer")
    return as_text(W.snapshot_by_digest(target, new_customers(spark, d), ["id"], ["segment"], day()), "valid_from", "valid_to")


def hub(spark, d):
    known = sql(spark, d, "SELECT md5(CAST(c_custkey AS STRING)) AS hk, c_custkey, DATE '2020-01-01' AS load_date, 'old' AS record_source FROM customer WHERE c_mktsegment = 'BUILDING'", "customer")
    source = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return as_text(W.load_hub(known, source, ["c_custkey"], day(), "orders"), "load_date")


def link_rows(spark, d):
    known = sql(spark, d, "SELECT md5(concat_ws('|', md5(CAST(o_custkey AS STRING)), md5(CAST(o_orderkey AS STRING)))) AS link_hk, md5(CAST(o_custkey AS STRING)) AS customer_hk, md5(CAST(o_orderkey AS STRING)) AS order_hk, DATE '2020-01-01' AS load_date, 'old' AS record_source FROM orders WHERE o_orderstatus = 'F'", "orders")
    return as_text(W.load_link(known, table(spark, d, "orders"), {"customer_hk": ["o_custkey"], "order_hk": ["o_orderkey"]}, day(), "orders"), "load_date")


_SAT = f"SELECT md5(CAST(id AS STRING)) AS hk, segment, md5(segment) AS hash_diff, valid_from AS load_date, valid_to AS load_end_date FROM ({HISTORY}) h"


def satellite(spark, d):
    out = W.load_satellite(sql(spark, d, _SAT, "customer"), new_customers(spark, d), ["id"], ["segment"], day())
    return as_text(out, "load_date", "load_end_date")


def point_in_time(spark, d):
    spine = sql(spark, d, f"SELECT md5(CAST(id AS STRING)) AS hk, s AS snapshot_date FROM ({OLD}) o LATERAL VIEW explode(array(DATE '2018-06-01', DATE '2019-06-01', DATE '2021-06-01')) x AS s", "customer")
    sat = sql(spark, d, _SAT, "customer")
    short = sql(spark, d, f"SELECT md5(CAST(id AS STRING)) AS hk, DATE '2019-01-01' AS load_date, CAST(CASE WHEN id % 2 = 0 THEN DATE '2020-01-01' END AS DATE) AS load_end_date FROM ({OLD}) o", "customer")
    return as_text(W.point_in_time(spine, {"a": sat, "b": short}), "snapshot_date", "a_load_date", "b_load_date")


def vault_bridge(spark, d):
    link = table(spark, d, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("link_hk"), F.md5(F.col("o_custkey").cast("string")).alias("customer_hk"))
    hub = table(spark, d, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("hk"), "c_name", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    return W.vault_bridge(link, {"customer_hk": (hub, ["c_name"])})


def weights(spark, d):
    return W.bridge_table(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).withColumn("weight", F.round("weight", 8))


def dates(spark, d):
    return as_text(W.date_dimension(spark, "2019-12-25", "2024-03-05", 4), "date")


def dimension(spark, d):
    target = sql(spark, d, f"SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS sk, id, segment, nation FROM ({OLD}) o", "customer")
    return W.load_dimension(target, new_customers(spark, d), ["id"], _ALL)


def facts(spark, d):
    customers = sql(spark, d, f"SELECT id, id + 1000 AS sk FROM ({OLD}) o", "customer")
    return W.load_fact(table(spark, d, "orders"), {"customer": (customers, ["o_custkey"], ["id"], "sk")}, ["o_orderkey", "o_totalprice"])


def increment(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return W.newer_than(o, o.where("o_orderdate < '1999-06-01'"), "o_orderdate").select("o_orderkey")


def silver_layer(spark, d):
    raw = sql(spark, d, "SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 9 = 0 THEN 'bad' ELSE CAST(c_acctbal AS STRING) END AS balance, c_custkey % 400 AS part FROM customer", "customer")
    bronze = W.bronze(raw, "customer.parquet", F.lit("2024-01-01"))
    return W.silver(bronze, {"id": "bigint", "balance": "double"}, "balance IS NOT NULL AND balance > 0", ["part"], ["id"])


_CHANGES = """SELECT o_orderkey AS offset, o_custkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'd' WHEN o_orderkey % 3 = 0 THEN 'u' ELSE 'c' END AS op, CAST(o_totalprice AS BIGINT) AS amount FROM orders"""


def changes(spark, d):
    target = sql(spark, d, "SELECT c_custkey AS id, CAST(1 AS BIGINT) AS amount FROM customer", "customer")
    return W.apply_changes(target, sql(spark, d, _CHANGES, "orders"), ["id"], ["amount"])


def envelopes(spark, d):
    raw = sql(spark, d, f"""SELECT offset, CASE WHEN offset % 97 = 0 THEN '{{broken' WHEN op = 'd' THEN to_json(named_struct('op', op, 'before', named_struct('id', id, 'amount', amount)))
      ELSE to_json(named_struct('op', op, 'after', named_struct('id', id, 'amount', amount))) END AS value FROM ({_CHANGES}) c""", "orders")
    good, bad = W.parse_changes(raw, "value", "id bigint, amount bigint")
    return good.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).union(bad.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("malformed"), "n", F.lit(0).cast("long")))


_FULL = f"FROM ({OLD}) t FULL JOIN ({NEW}) s ON t.id = s.id"
_PICK = "CASE WHEN s.id IS NOT NULL THEN s.{0} ELSE t.{0} END AS {0}"
_PICKED = ", ".join(_PICK.format(c) for c in ("id", "segment", "nation"))
_SCD2 = f"""h AS ({HISTORY}), s AS ({NEW}), j AS (SELECT h.id, h.segment, h.nation, h.valid_from, h.valid_to, s.id AS sid, s.segment AS sseg, s.nation AS snat FROM h LEFT JOIN s ON h.id = s.id WHERE h.is_current),
two AS (SELECT id, segment, nation, valid_from, valid_to, false AS is_current FROM h WHERE NOT is_current
 UNION ALL SELECT id, segment, nation, valid_from, CASE WHEN sid IS NOT NULL AND (segment <> sseg OR nation <> snat) THEN DATE '2024-01-01' ELSE valid_to END, NOT (sid IS NOT NULL AND (segment <> sseg OR nation <> snat)) FROM j
 UNION ALL SELECT s.id, s.segment, s.nation, DATE '2024-01-01', NULL, true FROM s LEFT JOIN j ON s.id = j.id WHERE j.id IS NULL OR j.segment <> s.segment OR j.nation <> s.nation)"""
_DATES2 = "CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, is_current"
_DSAT = _SAT.replace("STRING", "VARCHAR")
_DCHANGES = _CHANGES.replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)")

QUERIES = {
    "merge_upsert": (upsert, f"SELECT {_PICKED} {_FULL}"),
    "upsert_counts": (upsert_counts, f"SELECT CASE WHEN t.id IS NULL THEN 'inserted' WHEN s.id IS NULL THEN 'kept' WHEN t.segment = s.segment AND t.nation = s.nation THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS rows {_FULL} GROUP BY 1"),
    "delete_safe_sync": (sync, f"SELECT {_PICKED}, s.id IS NULL AS is_deleted, CASE WHEN s.id IS NULL THEN CASE WHEN t.nation < 8 THEN '2022-01-01' ELSE '2024-01-01' END END AS deleted_at {_FULL}"),
    "scd_type_2": (history, f"WITH {_SCD2} SELECT id, segment, nation, {_DATES2} FROM two"),
    "scd_type_3": (
        previous_value,
        f"""WITH j AS (SELECT t.id AS tid, s.id AS sid, t.segment AS ts, t.nation AS tn, s.segment AS ss, s.nation AS sn, t.id IS NOT NULL AND s.id IS NOT NULL AND (t.segment <> s.segment OR t.nation <> s.nation) AS ch {_FULL})
SELECT coalesce(sid, tid) AS id, CASE WHEN sid IS NULL THEN ts ELSE ss END AS segment, CASE WHEN sid IS NULL THEN tn ELSE sn END AS nation,
 CASE WHEN ch THEN ts WHEN tid IS NOT NULL THEN 'P' END AS segment_previous, CAST(CASE WHEN ch THEN tn WHEN tid IS NOT NULL THEN 0 END AS VARCHAR) AS nation_previous FROM j""",
    ),
    "scd_type_5_mini_dimension": (
        mini,
        f"""WITH s AS ({NEW}), m AS (SELECT row_number() OVER (ORDER BY segment, nation) AS sk, segment, nation FROM (SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_nationkey < 5)),
x AS (SELECT sk, segment, nation FROM m UNION ALL SELECT (SELECT max(sk) FROM m) + row_number() OVER (ORDER BY segment, nation), segment, nation FROM (SELECT DISTINCT segment, nation FROM s EXCEPT SELECT segment, nation FROM m))
SELECT s.id, s.segment, s.nation, x.sk AS mini_sk, x.sk AS current_mini_sk FROM s JOIN x USING (segment, nation)""",
    ),
    "scd_type_6": (
        hybrid,
        f"""WITH h AS ({HISTORY}), s AS ({NEW}), j AS (SELECT h.id, h.segment, h.valid_from, h.valid_to, s.id AS sid, s.segment AS sseg FROM h LEFT JOIN s ON h.id = s.id WHERE h.is_current),
two AS (SELECT id, segment, valid_from, valid_to, false AS is_current FROM h WHERE NOT is_current
 UNION ALL SELECT id, segment, valid_from, CASE WHEN sid IS NOT NULL AND segment <> sseg THEN DATE '2024-01-01' ELSE valid_to END, NOT (sid IS NOT NULL AND segment <> sseg) FROM j
 UNION ALL SELECT s.id, s.segment, DATE '2024-01-01', NULL, true FROM s LEFT JOIN j ON s.id = j.id WHERE j.id IS NULL OR j.segment <> s.segment)
SELECT id, segment, {_DATES2}, arg_max(segment, is_current::INT * 100000 + epoch(two.valid_from)::BIGINT // 86400) OVER (PARTITION BY id) AS current_segment, lag(segment) OVER (PARTITION BY id ORDER BY two.valid_from) AS previous_segment FROM two""",
    ),
    "scd_type_7": (
        keyed_history,
        f"""WITH h AS (SELECT x.*, row_number() OVER (ORDER BY id, valid_from) AS scd_id FROM ({HISTORY}) x), s AS ({NEW}), j AS (SELECT h.*, s.id AS sid, s.segment AS sseg FROM h LEFT JOIN s ON h.id = s.id WHERE h.is_current),
n AS (SELECT s.id, s.segment FROM s LEFT JOIN j ON s.id = j.id WHERE j.id IS NULL OR j.segment <> s.segment),
two AS (SELECT scd_id, id, segment, valid_from, valid_to, false AS is_current FROM h WHERE NOT is_current
 UNION ALL SELECT scd_id, id, segment, valid_from, CASE WHEN sid IS NOT NULL AND segment <> sseg THEN DATE '2024-01-01' ELSE valid_to END, NOT (sid IS NOT NULL AND segment <> sseg) FROM j
 UNION ALL SELECT (SELECT max(scd_id) FROM h) + row_number() OVER (ORDER BY id), id, segment, DATE '2024-01-01', NULL, true FROM n)
SELECT scd_id, id, segment, {_DATES2}, arg_max(segment, is_current::INT * 100000 + epoch(two.valid_from)::BIGINT // 86400) OVER (PARTITION BY id) AS current_segment FROM two""",
    ),
    "snapshot_by_digest": (
        digest_snapshot,
        f"""WITH h AS ({HISTORY}), s AS ({NEW}), j AS (SELECT h.id, h.segment, h.valid_from, h.valid_to, s.id AS sid, s.segment AS sseg FROM h LEFT JOIN s ON h.id = s.id WHERE h.is_current)
SELECT id, segment, md5(segment) AS row_hash, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, is_current FROM (SELECT id, segment, valid_from, valid_to, false AS is_current FROM h WHERE NOT is_current
 UNION ALL SELECT id, segment, valid_from, CASE WHEN sid IS NOT NULL AND segment <> sseg THEN DATE '2024-01-01' ELSE valid_to END, NOT (sid IS NOT NULL AND segment <> sseg) FROM j
 UNION ALL SELECT s.id, s.segment, DATE '2024-01-01', NULL, true FROM s LEFT JOIN j ON s.id = j.id WHERE j.id IS NULL OR j.segment <> s.segment)""",
    ),
    "vault_hub": (hub, "SELECT md5(CAST(k AS VARCHAR)) AS hk, k AS c_custkey, CASE WHEN o THEN '2020-01-01' ELSE '2024-01-01' END AS load_date, CASE WHEN o THEN 'old' ELSE 'orders' END AS record_source FROM (SELECT k, bool_or(o) AS o FROM (SELECT c_custkey AS k, true AS o FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT o_custkey, false FROM orders) GROUP BY k)"),
    "vault_link": (link_rows, "SELECT md5(md5(CAST(o_custkey AS VARCHAR)) || '|' || md5(CAST(o_orderkey AS VARCHAR))) AS link_hk, md5(CAST(o_custkey AS VARCHAR)) AS customer_hk, md5(CAST(o_orderkey AS VARCHAR)) AS order_hk, CASE WHEN o_orderstatus = 'F' THEN '2020-01-01' ELSE '2024-01-01' END AS load_date, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'orders' END AS record_source FROM orders"),
    "vault_satellite": (
        satellite,
        f"""WITH t AS ({_DSAT}), s AS (SELECT md5(CAST(id AS VARCHAR)) AS hk, segment, md5(segment) AS hash_diff FROM ({NEW}) n), j AS (SELECT t.*, s.hash_diff AS sh FROM t LEFT JOIN s USING (hk) WHERE t.load_end_date IS NULL)
SELECT hk, segment, hash_diff, CAST(load_date AS VARCHAR) AS load_date, CAST(load_end_date AS VARCHAR) AS load_end_date FROM (SELECT hk, segment, hash_diff, load_date, load_end_date FROM t WHERE load_end_date IS NOT NULL
 UNION ALL SELECT hk, segment, hash_diff, load_date, CASE WHEN sh <> hash_diff THEN DATE '2024-01-01' END FROM j
 UNION ALL SELECT s.hk, s.segment, s.hash_diff, DATE '2024-01-01', NULL FROM s LEFT JOIN j USING (hk) WHERE j.hk IS NULL OR j.hash_diff <> s.hash_diff)""",
    ),
    "vault_point_in_time": (
        point_in_time,
        f"""WITH a AS ({_DSAT}), b AS (SELECT md5(CAST(id AS VARCHAR)) AS hk, DATE '2019-01-01' AS load_date, CASE WHEN id % 2 = 0 THEN DATE '2020-01-01' END AS load_end_date FROM ({OLD}) o),
p AS (SELECT md5(CAST(id AS VARCHAR)) AS hk, s FROM ({OLD}) o, (VALUES (DATE '2018-06-01'), (DATE '2019-06-01'), (DATE '2021-06-01')) v(s))
SELECT p.hk, CAST(p.s AS VARCHAR) AS snapshot_date, CAST((SELECT max(load_date) FROM a WHERE a.hk = p.hk AND load_date <= p.s AND (load_end_date > p.s OR load_end_date IS NULL)) AS VARCHAR) AS a_load_date,
 CAST((SELECT max(load_date) FROM b WHERE b.hk = p.hk AND load_date <= p.s AND (load_end_date > p.s OR load_end_date IS NULL)) AS VARCHAR) AS b_load_date FROM p""",
    ),
    "vault_bridge": (vault_bridge, "SELECT md5(CAST(o_orderkey AS VARCHAR)) AS link_hk, md5(CAST(o_custkey AS VARCHAR)) AS customer_hk, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey"),
    "bridge_weights": (weights, "SELECT l_orderkey, l_linenumber, l_partkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey), 8) AS weight FROM lineitem"),
    "date_dimension": (
        dates,
        """SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_key, strftime(x, '%Y-%m-%d') AS date, CAST(year(x) AS INTEGER) AS year, CAST(quarter(x) AS INTEGER) AS quarter, CAST(month(x) AS INTEGER) AS month, CAST(weekofyear(x) AS INTEGER) AS week, CAST(day(x) AS INTEGER) AS day,
 CAST(isodow(x) AS INTEGER) AS day_of_week, isodow(x) > 5 AS is_weekend, CAST(year(x) + CASE WHEN month(x) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM range(DATE '2019-12-25', DATE '2024-03-06', INTERVAL 1 DAY) r(x)""",
    ),
    "dimension_load": (
        dimension,
        f"""WITH t AS (SELECT row_number() OVER (ORDER BY id) AS sk, * FROM ({OLD}) o), s AS ({NEW})
SELECT t.sk, t.id, CASE WHEN s.id IS NULL THEN t.segment ELSE s.segment END AS segment, t.nation FROM t LEFT JOIN s ON t.id = s.id
UNION ALL SELECT (SELECT max(sk) FROM t) + row_number() OVER (ORDER BY s.id), s.id, s.segment, s.nation FROM s ANTI JOIN t ON s.id = t.id""",
    ),
    "fact_load": (facts, "SELECT o_orderkey, o_totalprice, CASE WHEN c_nationkey <> 7 THEN o_custkey + 1000 ELSE -1 END AS customer_sk, c_nationkey = 7 AS is_late FROM orders JOIN customer ON o_custkey = c_custkey"),
    "incremental_extract": (increment, "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01')"),
    "silver_layer": (silver_layer, "SELECT c_custkey AS id, c_acctbal AS balance, c_custkey % 400 AS part, '2024-01-01' AS ingested_at, 'customer.parquet' AS source_uri FROM customer WHERE c_custkey % 9 <> 0 AND c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey % 400 ORDER BY c_custkey) = 1"),
    "change_capture": (changes, f"""WITH l AS (SELECT * FROM ({_DCHANGES}) c QUALIFY row_number() OVER (PARTITION BY id ORDER BY "offset" DESC) = 1)
SELECT coalesce(l.id, t.id) AS id, coalesce(l.amount, t.amount) AS amount FROM (SELECT c_custkey AS id, 1::BIGINT AS amount FROM customer) t FULL JOIN l ON t.id = l.id WHERE l.op IS NULL OR l.op <> 'd'""".replace("AS offset", 'AS "offset"')),
    "change_envelopes": (envelopes, f"""WITH c AS ({_DCHANGES}) SELECT CASE WHEN "offset" % 97 = 0 THEN 'malformed' ELSE op END AS op, count(*) AS n, CAST(sum(CASE WHEN "offset" % 97 = 0 THEN 0 ELSE amount END) AS BIGINT) AS amount FROM c GROUP BY 1""".replace("AS offset", 'AS "offset"')),
}
