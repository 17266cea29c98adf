"""Deterministic projections of the standard tables onto graphs, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.graph import Model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce(spark: SparkSession, sf_dir: str) -> Model:
    """Regions hold nations, nations hold customers (classes) and suppliers (interfaces), customers hold orders (methods).

    An order's few lines are gathered in one aggregation on its key, so all its counts of
    distinct values come from one shuffle of the line items.
    """
    def read(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    region = read("region").select(F.col("r_regionkey").cast("string").alias("project_id"), F.col("r_name").alias("name"))
    nation = read("nation").select(F.col("n_regionkey").cast("string").alias("project_id"), F.col("n_nationkey").cast("string").alias("ns_id"), F.col("n_name").alias("ns_name"))
    by_nation = read("nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("project_id"), F.col("n_nationkey").cast("string").alias("ns_id"))
    customer = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read("supplier").select("s_suppkey", "s_nationkey").join(by_nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = customer.select("project_id", "ns_id", F.concat(F.lit("c:"), "c_custkey").alias("type_id"), F.concat("n_name", F.lit(".c:"), "c_custkey").alias("full_name"), "c_custkey", (F.col("c_mktsegment") == "MACHINERY").alias("is_abstract"))
    supplier = supplier.select("project_id", "ns_id", F.concat(F.lit("s:"), "s_suppkey").alias("type_id"), F.concat("n_name", F.lit(".s:"), "s_suppkey").alias("full_name"), "s_suppkey")

    lines = read("lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("sloc"), F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_suppkey").alias("suppliers"),
        F.max("l_linenumber").alias("nbd"), F.collect_set("l_partkey").alias("parts"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("accessed"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    def size(c: str):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("int")

    methods = orders.select(
        F.concat(F.lit("c:"), "o_custkey").alias("type_id"), F.col("o_orderkey").cast("string").alias("method_id"), F.concat(F.lit("o:"), "o_orderkey").alias("full_name"),
        size("parts").alias("parameters"), F.coalesce("sloc", F.lit(0)).cast("int").alias("sloc"), size("flags").alias("decision_points"), F.coalesce("nbd", F.lit(0)).cast("int").alias("max_nesting"),
        size("suppliers").alias("calls"), (F.col("o_orderstatus") == "O").alias("is_public"), F.coalesce("accessed", F.array().cast("array<string>")).alias("accessed_fields"))
    fields = methods.select("type_id", F.explode("accessed_fields").alias("f")).groupBy("type_id").agg(F.array_sort(F.collect_set("f")).alias("fields"))

    brands = read("part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("b:"), "p_brand").alias("target"))
    used = orders.select("o_custkey", F.explode("parts").alias("part")).join(brands, "part").select("o_custkey", "target")
    pairs = orders.select("o_custkey", F.explode("suppliers").alias("s_suppkey")).distinct().join(supplier.select("s_suppkey", F.col("full_name").alias("target")), "s_suppkey")
    depends = used.unionByName(pairs.select("o_custkey", "target")).groupBy("o_custkey").agg(F.array_sort(F.collect_set("target")).alias("depends_on"))
    empty = F.array().cast("array<string>")
    classes = customer.join(fields, "type_id", "left").join(depends, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "project_id", "ns_id", "type_id", "full_name", F.lit("Class").alias("kind"), "is_abstract", F.coalesce("fields", empty).alias("fields"), F.coalesce("depends_on", empty).alias("depends_on"))
    interfaces = supplier.select("project_id", "ns_id", "type_id", "full_name", F.lit("Interface").alias("kind"), F.lit(False).alias("is_abstract"), empty.alias("fields"), empty.alias("depends_on"))
    edges = pairs.join(customer.select("c_custkey", F.col("full_name").alias("src")), F.col("o_custkey") == F.col("c_custkey")).select("src", F.col("target").alias("dst"))
    return Model(region, nation, classes.unionByName(interfaces), methods, edges, methods.select("method_id"))


COMMERCE_SQL = """
with lines as (
    select l_orderkey, count(*) as sloc, count(distinct l_returnflag) as dp, count(distinct l_suppkey) as calls, max(l_linenumber) as nbd, count(distinct l_partkey) as params
    from lineitem group by 1),
methods as (
    select 'c:' || o_custkey as type_id, o_orderkey as order_key, coalesce(sloc, 0) as sloc, coalesce(dp, 0) as dp, coalesce(calls, 0) as calls,
        coalesce(nbd, 0) as nbd, coalesce(params, 0) as params, o_orderstatus = 'O' as is_public
    from orders left join lines on o_orderkey = l_orderkey),
accessed as (
    select distinct 'c:' || o_custkey as type_id, o_orderkey as order_key, l_returnflag || l_linestatus as f
    from orders join lineitem on o_orderkey = l_orderkey),
fields as (select distinct type_id, f from accessed),
customers as (
    select 'c:' || c_custkey as type_id, n_name || '.c:' || c_custkey as full_name, c_custkey, n_name, n_regionkey, 'Class' as kind, c_mktsegment = 'MACHINERY' as is_abstract
    from customer join nation on c_nationkey = n_nationkey),
suppliers as (
    select 's:' || s_suppkey as type_id, n_name || '.s:' || s_suppkey as full_name, s_suppkey, n_name, n_regionkey, 'Interface' as kind, false as is_abstract
    from supplier join nation on s_nationkey = n_nationkey),
types as (
    select type_id, full_name, n_name, n_regionkey, kind, is_abstract from customers
    union all select type_id, full_name, n_name, n_regionkey, kind, is_abstract from suppliers),
edges as (
    select distinct c.full_name as src, s.full_name as dst from orders join lineitem on o_orderkey = l_orderkey
    join customers c on c_custkey = o_custkey join suppliers s on s_suppkey = l_suppkey),
depends as (
    select src as full_name, dst as target from edges
    union select c.full_name, 'b:' || p_brand from orders join lineitem on o_orderkey = l_orderkey join customers c on c_custkey = o_custkey join part on p_partkey = l_partkey),
sizes as (
    select t.type_id, coalesce(sum(m.sloc), 0)::bigint as sloc, count(m.order_key)::bigint as nom,
        coalesce(sum(case when m.is_public then 1 else 0 end), 0)::bigint as npm, coalesce(sum(m.dp + 1), 0)::bigint as wmc
    from types t left join methods m using (type_id) group by 1),
ns_edges as (
    select distinct regexp_extract(src, '^(.+)\\.[^.]*$', 1) as src_ns, regexp_extract(dst, '^(.+)\\.[^.]*$', 1) as dst_ns from edges
    where regexp_extract(src, '^(.+)\\.[^.]*$', 1) <> regexp_extract(dst, '^(.+)\\.[^.]*$', 1))
"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State transitions of users: (src, dst) between ``user-event_type`` nodes, for all events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    rows = events.select(node.alias("src"), F.lead(node).over(order).alias("dst"))
    return rows.where("dst is not null and src <> dst").select("src", "dst").distinct()


SESSIONS_SQL = """
with recursive steps as (
    select user_id || '-' || event_type as src, lead(user_id || '-' || event_type) over (partition by user_id order by ts, event_id) as dst from events),
e as (select distinct src, dst from steps where dst is not null and src <> dst)
"""


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation-to-nation steps between following orders of one priority and status, for all orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    # months are in the partition, so that no few groups hold all orders
    order = Window.partitionBy("o_orderpriority", "o_orderstatus", F.month("o_orderdate"), F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    rows = rows.select(F.col("n_name").alias("src"), F.lead("n_name").over(order).alias("dst"))
    return rows.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


ORDER_FLOW_SQL = """
with recursive steps as (
    select n_name as src, lead(n_name) over (partition by o_orderpriority, o_orderstatus, month(o_orderdate), year(o_orderdate) order by o_orderdate, o_orderkey) as dst
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
e as (select distinct src, dst from steps where dst is not null and src <> dst)
"""

CYCLES_SQL = """,
reach(a, b) as (select src, dst from e union select reach.a, e.dst from reach join e on reach.b = e.src),
mutual as (select r.a as node, least(r.a, min(r.b)) as root from reach r join reach s on r.a = s.b and r.b = s.a where r.a <> r.b group by r.a)
"""
