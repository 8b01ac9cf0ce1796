"""Relational and time-window queries over the star schema: extensions, said the same way to both engines where they can be."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import counts

TABLES = "region nation customer supplier part orders lineitem events documents conversations embeddings".split()


def _sql(text: str):
    def query(spark, d):
        found = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
        return spark.sql(text, **found)

    import re

    return query, re.sub(r"\{(\w+)\}", r"\1", text)


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


ALL = {
    "rel_pricing_summary": _sql("""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""),
    "rel_three_way_join": _sql("""
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name"""),
    "rel_semi_join": _sql("SELECT c_custkey, c_mktsegment FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    "rel_anti_join": _sql("SELECT c_custkey, c_mktsegment FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)"),
    "rel_rollup": _sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "rel_cube": _sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "rel_rank_window": _sql("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) AS t WHERE r <= 3"),
    "rel_lag_window": _sql("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS step FROM {orders}"),
    "rel_set_operations": _sql("SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier} UNION SELECT n_nationkey AS k FROM {nation} WHERE n_regionkey = 1"),
    "rel_top_parts": _sql("SELECT p_brand, p_partkey, q FROM (SELECT p_brand, p_partkey, sum(l_quantity) AS q, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, p_partkey) AS r FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, p_partkey) AS t WHERE r <= 2"),
    "rel_conversation_turns": _sql("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, length(text) AS n FROM {conversations}"),
    "rel_tumbling": (
        lambda s, d: counts.tumbling(_events(s, d)).select("start", "event_type", "n", F.round("v", 4).alias("v")),
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL",
    ),
    "rel_sessions": (
        lambda s, d: counts.sessions(_events(s, d)),
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
           k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k.k""",
    ),
    "ml_embedding": (
        lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("m")),
        "SELECT label, i, round(avg(x::DOUBLE), 5) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL",
    ),
}
