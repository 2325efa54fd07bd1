"""Relational shapes over the sales tables: joins, windows, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import query, table


@query("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP '1998-09-02'"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), revenue.alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("rel_region_revenue", "SELECT r_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def rel_region_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # Region and nation have five and twenty-five rows.
    where = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    who = t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return t("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("rel_top_parts", "SELECT l_suppkey, l_partkey, qty FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 3")
def rel_top_parts(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
