"""Registered queries over measurements: distributions, selections, comparisons; each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection, stats
from ..sources import views as V
from .route_queries import query

QUANTILES = [0.5, 0.9, 0.95]


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 6) AS q250, round(quantile_cont(o_totalprice, 0.5), 6) AS q500, round(quantile_cont(o_totalprice, 0.95), 6) AS q950 FROM orders GROUP BY o_orderpriority")
def linear_quantiles(spark, sf_dir):
    """Exact linear quantiles by group."""
    rows = V.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    found = stats.linear_quantiles(rows, ["priority"], "o_totalprice", [0.25, 0.5, 0.95])
    return found.select("priority", "n", *[F.round(q, 6).alias(q) for q in ("q250", "q500", "q950")])


LOSS_SQL = "loss_v AS (SELECT event_type, CASE WHEN user_id % 11 = 0 THEN CAST('infinity' AS DOUBLE) WHEN user_id % 13 = 0 THEN NULL ELSE value END AS loss FROM events)"


@query("SELECT event_type, count(loss) AS evaluations, count(*) FILTER (isfinite(loss)) AS finite_evaluations, count(*) FILTER (isinf(loss)) AS infinite_evaluations, round(max(loss) FILTER (isfinite(loss)), 6) AS worst_finite, bool_or(isinf(loss)) AS worst_is_infinite, round(quantile_cont(loss, 0.5) FILTER (isfinite(loss)), 6) AS q500, round(quantile_cont(loss, 0.9) FILTER (isfinite(loss)), 6) AS q900, round(quantile_cont(loss, 0.95) FILTER (isfinite(loss)), 6) AS q950 FROM loss_v GROUP BY event_type", LOSS_SQL)
def loss_distribution(spark, sf_dir):
    """Infinity-aware distribution: infinite losses are counted, never pooled with finite ones."""
    loss = F.when(F.col("user_id") % 11 == 0, float("inf")).when(F.col("user_id") % 13 != 0, F.col("value"))
    found = stats.distribution(V.table(spark, sf_dir, "events").select("event_type", loss.alias("loss")), ["event_type"], "loss", QUANTILES)
    return found.select("event_type", "evaluations", "finite_evaluations", "infinite_evaluations", "worst_is_infinite", *[F.round(c, 6).alias(c) for c in ("worst_finite", "q500", "q900", "q950")])


@query("SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS weighted_mean FROM lineitem GROUP BY l_returnflag")
def weighted_price(spark, sf_dir):
    """Weighted mean by group."""
    lines = V.table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("n"))
    return stats.weighted_mean(lines, ["l_returnflag"], "cents", "n")


@query("SELECT o_orderkey, CAST(cents * count(*) OVER (PARTITION BY o_custkey) - sum(cents) OVER (PARTITION BY o_custkey) AS BIGINT) AS over_mean_times_n FROM (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)")
def price_over_mean(spark, sf_dir):
    """Group transform: the group's mean back on its rows."""
    cents = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    rows = stats.with_group_sums(cents, ["o_custkey"], "cents")
    return rows.select("o_orderkey", (F.col("cents") * F.col("group_n") - F.col("group_sum")).alias("over_mean_times_n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def line_value_counts(spark, sf_dir):
    """Value counts over several columns."""
    return V.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(DISTINCT (cx, cy)) AS cells, count(*) AS points, min(x) AS low_x, max(x) AS high_x, min(y) AS low_y, max(y) AS high_y, round(var_pop(x), 3) AS var_x, sum(CASE WHEN x % 5 = 0 THEN 1 ELSE 0 END) * 1000000 // count(*) AS null_ppm FROM (SELECT p.*, e.label, CAST(floor(x / 5000.0) AS BIGINT) AS cx, CAST(floor(y / 5000.0) AS BIGINT) AS cy FROM points_v p JOIN embeddings e ON e.vec_id = p.id) GROUP BY label", V.POINTS_SQL)
def label_extents(spark, sf_dir):
    """Distinct cells, bounding box, variance and share of nulls by group."""
    labels = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    cell = lambda c: F.floor(F.col(c) / 5000.0).cast("long")
    p = V.points(spark, sf_dir).join(labels, "id").withColumns({"cell": F.struct(cell("x"), cell("y")), "some": F.when(F.col("x") % 5 != 0, F.col("x"))})
    made = p.groupBy("label").agg(F.count_distinct("cell").alias("cells"), F.count(F.lit(1)).alias("points"), F.min("x").alias("low_x"), F.max("x").alias("high_x"), F.min("y").alias("low_y"), F.max("y").alias("high_y"), F.round(F.var_pop("x"), 3).alias("var_x"), F.count("some").alias("n"))
    return made.withColumn("null_ppm", F.expr("(points - n) * 1000000 div points")).drop("n")


@query("SELECT nation, place, key FROM (SELECT *, CAST(row_number() OVER (PARTITION BY nation ORDER BY later, p, key) AS INTEGER) AS place FROM (SELECT c_nationkey AS nation, c_custkey AS key, -CAST(floor(c_acctbal * 100) AS BIGINT) AS p, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY -CAST(floor(c_acctbal * 100) AS BIGINT), c_custkey) > 1 AS later FROM customer)) WHERE place <= 8")
def one_of_each_segment(spark, sf_dir):
    """One of each class first, then the best of all until a group is full."""
    rows = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_mktsegment", F.col("c_custkey").alias("key"), (-F.floor(F.col("c_acctbal") * 100).cast("long")).alias("p"))
    return selection.one_of_each(rows, ["nation"], "c_mktsegment", ["p", "key"], 8).select("nation", "place", "key")


@query("SELECT segment, band, n, CAST(coalesce(sum(n) OVER (PARTITION BY segment ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT c_mktsegment AS segment, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, count(*) AS n FROM customer GROUP BY ALL)")
def bands_before(spark, sf_dir):
    """Cumulative sum of earlier bands."""
    bands = V.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 1000).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return stats.running_counts(bands, ["segment"], ["band"], "upto").select("segment", "band", "n", (F.col("upto") - F.col("n")).alias("before"))


@query("SELECT coalesce(a.event_id, b.event_id) AS ordinal, CASE WHEN a.event_id IS NULL THEN 'extra' WHEN b.event_id IS NULL THEN 'missing' ELSE 'differs' END AS fault FROM events a FULL JOIN (SELECT event_id + CASE WHEN event_id % 997 = 3 THEN 1000000000 ELSE 0 END AS event_id, CASE WHEN event_id % 991 = 5 THEN -user_id - 1 ELSE user_id END AS user_id, event_type FROM events) b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.user_id <> b.user_id OR a.event_type <> b.event_type")
def lockstep_faults(spark, sf_dir):
    """Row i of one table against row i of another: missing, extra and differing rows are planted in a copy."""
    rows = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), "user_id", "event_type")
    copy = rows.select((F.col("ordinal") + F.when(F.col("ordinal") % 997 == 3, 1_000_000_000).otherwise(0)).alias("ordinal"), F.when(F.col("ordinal") % 991 == 5, -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"), "event_type")
    return selection.lockstep(rows, copy, "ordinal")


@query("SELECT o_orderkey AS decision, CASE WHEN o_custkey % 17 = 0 THEN 'absent' WHEN o_totalprice < 2000 THEN 'pruned' WHEN o_orderpriority LIKE '5%' THEN 'unrelated' WHEN o_orderstatus = 'F' THEN 'known' WHEN o_custkey % 3 = 0 THEN 'reliability' ELSE 'fallback' END AS gate FROM orders")
def decision_gates(spark, sf_dir):
    """the first gate that applies."""
    gates = {"absent": F.col("o_custkey") % 17 == 0, "pruned": F.col("o_totalprice") < 2000, "unrelated": F.col("o_orderpriority").startswith("5"), "known": F.col("o_orderstatus") == "F", "reliability": F.col("o_custkey") % 3 == 0}
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision"), selection.first_gate(gates, "fallback").alias("gate"))


@query()
def selected_candidates(spark, sf_dir):
    """Candidates of every group, the best of each anchor, dealt round robin over stratum and effect."""
    part = V.table(spark, sf_dir, "part")
    effects = F.create_map(*[x for k, c in V.CAPABILITIES.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    sites = part.select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("site"), (F.col("p_partkey") * 7 % 400).alias("anchor"), effects[F.split("p_type", " ")[0]].alias("effects"), (F.col("p_partkey") * 31 % 4).alias("stratum"), F.col("p_size").cast("long").alias("detour"))
    return selection.round_robin(selection.best_per_anchor(sites.where("effects IS NOT NULL"), ["domain"]), ["domain"], 24)


@query("SELECT CAST(site_key AS BIGINT) AS site, offset_class, CAST(near_key AS BIGINT) AS near FROM (SELECT s_suppkey AS site_key, CASE WHEN n.c_custkey IS NOT NULL THEN 'own' WHEN r.c_custkey IS NOT NULL THEN 'region' ELSE 'all' END AS offset_class, coalesce(n.c_custkey, r.c_custkey, g.c_custkey) AS near_key FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) n ON n.c_nationkey = s_nationkey LEFT JOIN (SELECT n_regionkey, min(c_custkey) AS c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) r ON r.n_regionkey = nation.n_regionkey CROSS JOIN (SELECT min(c_custkey) AS c_custkey FROM customer) g)")
def first_with_fallback(spark, sf_dir):
    """Choice with fallbacks: own nation, else the region, else all."""
    nation = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    rich = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("near")).join(nation, "nation")
    sites = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("nation")).join(nation, "nation")
    return selection.with_fallback(sites, rich, [("own", ["nation"]), ("region", ["region"]), ("all", [])], "near").select("site", F.col("level").alias("offset_class"), "near")


@query("SELECT p_brand AS brand, p_partkey AS site, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey % 40 ORDER BY p_size, p_partkey) AS place FROM part) WHERE place = 1")
def best_of_anchor(spark, sf_dir):
    """Dedup per anchor: the preferred site of every anchor."""
    place = F.row_number().over(Window.partitionBy("p_brand", F.col("p_partkey") % 40).orderBy("p_size", "p_partkey"))
    return V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("site"), place.alias("place")).where("place = 1")


_NOW = "c_custkey % 37 + CASE WHEN c_custkey % 5 = 0 THEN c_nationkey % 3 * 100 ELSE 0 END + CASE WHEN c_custkey % 37 > 30 THEN 30 - c_custkey % 37 ELSE 0 END"


@query(
    """SELECT common, now - common AS new_members, old - common AS removed_members, round((together - l * r / every) / ((l + r) / 2 - l * r / every), 9) AS adjusted_rand, round(overlap, 9) AS overlap, regions - r_regions AS new_regions, split_regions, merged_regions
       FROM (SELECT CAST(sum(n) AS BIGINT) AS common, sum(n * (n - 1) / 2) AS together, CAST(sum(n) AS DOUBLE) * (sum(n) - 1) / 2 AS every FROM cells_v),
            (SELECT sum(held * (held - 1) / 2) AS l, count(*) FILTER (met > 1) AS split_regions FROM (SELECT CAST(sum(n) AS DOUBLE) AS held, count(*) AS met FROM cells_v GROUP BY l)),
            (SELECT sum(held * (held - 1) / 2) AS r, count(*) FILTER (met > 1) AS merged_regions, count(*) AS r_regions FROM (SELECT CAST(sum(n) AS DOUBLE) AS held, count(*) AS met FROM cells_v GROUP BY r)),
            (SELECT avg(best) AS overlap FROM (SELECT c.l, max(c.n / CAST(h.held + f.held - c.n AS DOUBLE)) AS best FROM cells_v c JOIN (SELECT l, sum(n) AS held FROM cells_v GROUP BY l) h USING (l) JOIN (SELECT region, count(*) AS held FROM after_v GROUP BY region) f ON f.region = c.r GROUP BY c.l)),
            (SELECT count(*) AS old FROM before_v), (SELECT count(*) AS now, count(DISTINCT region) AS regions FROM after_v)""",
    "before_v AS (SELECT c_custkey AS id, c_custkey % 37 AS region FROM customer WHERE c_custkey % 11 <> 0)", f"after_v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 4 = 0 THEN 5000 + c_nationkey ELSE {_NOW} END AS region FROM customer WHERE c_custkey % 13 <> 0)",
    "cells_v AS (SELECT b.region AS l, a.region AS r, count(*) AS n FROM before_v b JOIN after_v a USING (id) GROUP BY ALL)",
)
def region_stability(spark, sf_dir):
    """How regions changed from one envelope to the next: index, overlap, splits, merges, new ones."""
    customers = V.table(spark, sf_dir, "customer")
    before = customers.where("c_custkey % 11 <> 0").selectExpr("c_custkey AS id", "c_custkey % 37 AS region")
    after = customers.where("c_custkey % 13 <> 0").selectExpr("c_custkey AS id", f"CASE WHEN c_custkey % 11 = 0 AND c_custkey % 4 = 0 THEN 5000 + c_nationkey ELSE {_NOW} END AS region")
    found = stats.stability(before, after)
    return found.withColumns({c: F.round(c, 9) for c in ("adjusted_rand", "overlap")})
