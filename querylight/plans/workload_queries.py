"""Query shapes of the workload, over the test tables; ties in top-n are broken by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylight.plans.registry import query, table


@query("wl_count", "select count(*) as n from orders")
def wl_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@query("wl_order_by", "select c_name, c_acctbal from customer order by c_acctbal desc, c_name")
def wl_order_by(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_name")


@query(
    "wl_three_way_join",
    """select c_name, o_orderkey, l_linenumber, l_extendedprice
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    where c_mktsegment = 'BUILDING' and l_quantity > 45 order by l_extendedprice desc""",
)
def wl_three_way_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    buyers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        buyers, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select("c_name", "o_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"))


@query(
    "wl_count_distinct_top2",
    """select c_nationkey, count(distinct o_custkey) as n_buyers from customer join orders on c_custkey = o_custkey
    group by c_nationkey order by n_buyers desc, c_nationkey limit 2""",
)
def wl_count_distinct_top2(spark, sf_dir):
    """A buyer counts once whatever the orders, so the buyers are made distinct before the join."""
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    found = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(buyers, "c_custkey")
    counts = found.groupBy("c_nationkey").agg(F.count("*").alias("n_buyers"))
    return counts.orderBy(F.desc("n_buyers"), "c_nationkey").limit(2)


IN_RANGE = "o_orderdate between timestamp '1996-03-01' and timestamp '1998-04-30'"
# The column has no time zone; a literal without one keeps the filter in the scan.
SCAN_RANGE = IN_RANGE.replace("timestamp '", "timestamp_ntz '")


@query(
    "wl_sum_top3",
    f"""select o_orderpriority, round(sum(o_totalprice), 2) as total from orders where {IN_RANGE}
    group by o_orderpriority order by total desc limit 3""",
)
def wl_sum_top3(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").filter(SCAN_RANGE).groupBy("o_orderpriority").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return sums.orderBy(F.desc("total")).limit(3)


@query(
    "wl_having",
    f"""select o_custkey, round(sum(o_totalprice), 2) as total from orders where {IN_RANGE}
    group by o_custkey having sum(o_totalprice) > 1000000""",
)
def wl_having(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").filter(SCAN_RANGE).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return sums.filter("s > 1000000").select("o_custkey", F.round("s", 2).alias("total"))


@query(
    "wl_recent_top1",
    """select c_nationkey, count(*) as n from orders join customer on o_custkey = c_custkey
    where year(o_orderdate) > (select max(year(o_orderdate)) from orders) - 2
    group by c_nationkey order by n desc, c_nationkey limit 1""",
)
def wl_recent_top1(spark, sf_dir):
    """The last two years up to the newest order; the bound on the date itself reaches the scan."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max("o_orderdate").alias("d"))
    bound = newest.select(F.trunc("d", "year").cast("timestamp_ntz") - F.expr("interval 1 year")).scalar()
    recent = orders.filter(F.col("o_orderdate") >= bound).select("o_custkey")
    joined = recent.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "c_nationkey").limit(1)


@query("wl_range_avg", f"select round(avg(o_totalprice), 4) as mean_price, count(*) as n from orders where {IN_RANGE}")
def wl_range_avg(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(SCAN_RANGE).agg(
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count("*").alias("n")
    )


@query(
    "graph_one_hop",
    """select n_name, s_suppkey, s_name from nation join supplier on s_nationkey = n_nationkey
    where n_name in ('NATION_3', 'NATION_7')""",
)
def graph_one_hop(spark, sf_dir):
    """(nation)-[home of]->(supplier) from given nations."""
    start = table(spark, sf_dir, "nation").filter(F.col("n_name").isin("NATION_3", "NATION_7"))
    reached = table(spark, sf_dir, "supplier")
    return start.join(reached, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_suppkey", "s_name")


@query(
    "graph_two_hop_top5",
    """select c_custkey, o_orderkey, l_linenumber, l_extendedprice
    from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
    where c_mktsegment = 'MACHINERY' order by l_extendedprice desc, o_orderkey, l_linenumber limit 5""",
)
def graph_two_hop_top5(spark, sf_dir):
    """(customer)-[placed]->(order)-[holds]->(line), the five dearest lines."""
    start = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'")
    placed = start.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    lines = placed.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    kept = lines.select("c_custkey", "o_orderkey", "l_linenumber", "l_extendedprice")
    return kept.orderBy(F.desc("l_extendedprice"), "o_orderkey", "l_linenumber").limit(5)


@query(
    "graph_reverse_hop",
    """select p_partkey, count(*) as n_lines, round(sum(l_quantity), 2) as quantity
    from part join lineitem on l_partkey = p_partkey where p_brand = 'Brand#7' group by p_partkey""",
)
def graph_reverse_hop(spark, sf_dir):
    """(part)<-[of]-(line) against the direction of the key; lines are summed before they meet the parts."""
    start = table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("q")
    )
    return start.join(lines, "p_partkey").select("p_partkey", "n_lines", F.round("q", 2).alias("quantity"))
