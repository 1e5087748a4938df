"""Queries: layout scores of placed nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import layout as L
from workload import views as V
from workload.registry import query

KEY = ["program_id"]

_SIZE = "CASE WHEN {0}.type IN ('in', 'out') THEN {1} WHEN {0}.type = 'instance' THEN {2} ELSE {3} END"
_W = {t: _SIZE.format(t, "100.0", "200.0", "120.0") for t in "ab"}
_H = {t: _SIZE.format(t, "50.0", "100.0", "60.0") for t in "ab"}
_OVERLAP = f"""NOT (a.x + {_W['a']} / 2 < b.x - {_W['b']} / 2 OR a.x - {_W['a']} / 2 > b.x + {_W['b']} / 2
    OR a.y + {_H['a']} / 2 < b.y - {_H['b']} / 2 OR a.y - {_H['a']} / 2 > b.y + {_H['b']} / 2)"""

_FLAGS = f"""n AS (SELECT *, row_number() OVER (ORDER BY program_id, type, x, y) AS i FROM placed_nodes),
    hit AS (SELECT DISTINCT a.i FROM n a JOIN n b ON a.program_id = b.program_id AND a.i <> b.i WHERE {_OVERLAP}),
    flags AS (SELECT n.*, n.i IN (SELECT i FROM hit) AS overlapping FROM n)"""
_PAIRS = """pairs AS (SELECT program_id, sum(CASE WHEN k = 'l' THEN (ax < bx)::INT ELSE (bx < ax)::INT END)::BIGINT AS correct_pairs,
        count(*) AS total_pairs FROM (
        SELECT a.program_id, 'l' AS k, a.x AS ax, b.x AS bx FROM placed_nodes a JOIN placed_nodes b
            ON a.program_id = b.program_id AND a.type = 'in' AND b.type = 'instance'
        UNION ALL SELECT a.program_id, 'r', a.x, b.x FROM placed_nodes a JOIN placed_nodes b
            ON a.program_id = b.program_id AND a.type = 'out' AND b.type = 'instance') GROUP BY program_id),
    flow AS (SELECT p.program_id, coalesce(correct_pairs, 0) AS correct_pairs, coalesce(total_pairs, 0) AS total_pairs,
        coalesce(correct_pairs / total_pairs, 1.0) AS flow_score FROM (SELECT DISTINCT program_id FROM placed_nodes) p
        LEFT JOIN pairs USING (program_id))"""
_OVER = "over AS (SELECT program_id, count(*) AS nodes, avg((NOT overlapping)::INT) AS overlap_score FROM flags GROUP BY program_id)"


def _nodes(spark, d):
    return V.view(spark, d, "placed_nodes")


@query("in_main_out_pairs", f"WITH {_PAIRS} SELECT program_id, correct_pairs, total_pairs FROM flow", ("placed_nodes",))
def in_main_out_pairs(spark, d):
    return L.flow_pairs(_nodes(spark, d), KEY)


@query("flow_direction_score", f"WITH {_PAIRS} SELECT program_id, round(flow_score, 6) AS flow_score FROM flow", ("placed_nodes",))
def flow_direction_score(spark, d):
    scored = L.flow_direction_score(L.flow_pairs(_nodes(spark, d), KEY))
    return scored.select("program_id", F.round("flow_score", 6).alias("flow_score"))


_LINKS = f"""n AS (SELECT *, row_number() OVER (ORDER BY program_id, type, x, y) AS i FROM {{nodes}}),
    linked AS (SELECT a.i, count(*) AS links FROM n a JOIN n b ON a.program_id = b.program_id AND a.i <> b.i WHERE {_OVERLAP} GROUP BY a.i)
    SELECT program_id, type, x, y, count(*) AS copies, coalesce(any_value(links), 0) AS links, coalesce(any_value(links), 0) > 0 AS overlapping
    FROM n LEFT JOIN linked USING (i) GROUP BY program_id, type, x, y"""


@query("overlap_pairs", f"WITH {_LINKS.format(nodes='placed_nodes')}", ("placed_nodes",))
def overlap_pairs(spark, d):
    return L.overlap_links(_nodes(spark, d), KEY)


@query("overlap_pairs_crowded", f"WITH crowded AS (SELECT * REPLACE (program_id % 200 AS program_id) FROM placed_nodes), {_LINKS.format(nodes='crowded')}", ("placed_nodes",))
def overlap_pairs_crowded(spark, d):
    """Programs of hundreds of nodes: all nodes of many programs in 200."""
    return L.overlap_links(_nodes(spark, d).withColumn("program_id", F.col("program_id") % 200), KEY)


@query("overlap_score", f"WITH {_FLAGS}, {_OVER} SELECT program_id, nodes, round(overlap_score, 6) AS overlap_score FROM over", ("placed_nodes",))
def overlap_score(spark, d):
    scored = L.overlap_score(_nodes(spark, d), KEY)
    return scored.withColumn("overlap_score", F.round("overlap_score", 6))


@query("layout_score", f"""
    WITH {_FLAGS}, {_OVER}, {_PAIRS}
    SELECT program_id, round(0.3 * flow_score + 0.7 * overlap_score, 6) AS layout_score FROM flow JOIN over USING (program_id)""",
       ("placed_nodes",))
def layout_score(spark, d):
    scored = L.layout_score(_nodes(spark, d), KEY)
    return scored.select("program_id", F.round("layout_score", 6).alias("layout_score"))


@query("nodes_at_flow", f"""
    WITH {_FLAGS}, {_OVER}, {_PAIRS}, s AS (
        SELECT o_orderstatus AS run, o_custkey AS task_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN
            0.3 * flow_score + 0.7 * overlap_score END AS score
        FROM orders JOIN flow ON o_orderkey = flow.program_id JOIN over ON o_orderkey = over.program_id),
    t AS (SELECT run, task_id, avg(score) AS m FROM s GROUP BY run, task_id)
    SELECT run, round(coalesce(avg(m), 0.0), 6) AS nodes_at_flow FROM t GROUP BY run""", ("placed_nodes",))
def nodes_at_flow(spark, d):
    programs = V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS program_id", "o_orderstatus AS run", "o_custkey AS task_id", "o_orderpriority <> '1-URGENT' AS valid")
    scored = programs.join(L.layout_score(_nodes(spark, d), KEY), "program_id").withColumn(
        "layout_score", F.when(F.col("valid"), F.col("layout_score")))
    return L.nodes_at_flow(scored, ["run"]).withColumn("nodes_at_flow", F.round("nodes_at_flow", 6))
