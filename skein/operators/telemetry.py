"""Ordered and time-based operators over events: rolling rules, as-of state, windows, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.tables import table

def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def rolling_drift(spark, sf_dir):
    """Per user the share of errors in the last 20 events; drift if there are 10 or more and it is over a quarter."""
    w = by_user().rowsBetween(-19, 0)
    e = events(spark, sf_dir).withColumns({"share": F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).over(w), 6), "n": F.count(F.lit(1)).over(w)})
    return e.select("event_id", "share", ((F.col("n") >= 10) & (F.col("share") > 0.25)).alias("drift"))


def lag_delta(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("before", F.lag("value").over(by_user()))
    return e.where("before is not null").select("event_id", F.round(F.col("value") - F.col("before"), 6).alias("delta"))


def linear_extrapolation(spark, sf_dir):
    w = by_user().rowsBetween(-15, 0)
    e = events(spark, sf_dir).withColumns({"n": F.count(F.lit(1)).over(w), "first": F.first("value").over(w)})
    return e.where("n > 1").select("event_id", F.round(F.col("value") + (F.col("value") - F.col("first")) / (F.col("n") - 1), 6).alias("next_value"))


def asof_state(spark, sf_dir):
    """Each user's last event up to the middle of January."""
    e = events(spark, sf_dir).where("ts <= timestamp '2024-01-15 00:00:00'")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("s"), F.count(F.lit(1)).alias("n")).select("user_id", "s.event_id", "s.event_type", F.round("s.value", 6).alias("value"), "n")


def asof_join(spark, sf_dir):
    """For each purchase the user's last view before it: one sort of the union instead of a range join."""
    e = events(spark, sf_dir).where("event_type in ('purchase', 'view')")
    w = by_user().rowsBetween(Window.unboundedPreceding, -1)
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


def threshold_crossing(spark, sf_dir):
    """Users whose sum of values crosses 1000 between two times."""
    e = events(spark, sf_dir)
    s = e.groupBy("user_id").agg(*(F.round(F.sum(F.when(F.col("ts") <= F.lit(t).cast("timestamp"), F.col("value")).otherwise(0.0)), 3).alias(n) for n, t in (("early", "2024-01-10 00:00:00"), ("late", "2024-01-20 00:00:00"))))
    return s.where("early < 1000 and late >= 1000")


def trend_labels(spark, sf_dir):
    """Change of each user's count of events between two halves of the month."""
    e = events(spark, sf_dir).withColumn("late", F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp"))
    c = e.groupBy("user_id").agg(F.sum(F.when(F.col("late"), 1).otherwise(-1)).cast("long").alias("change"))
    return c.select("user_id", "change", F.when(F.col("change") > 5, "growing").when(F.col("change") < -5, "shrinking").otherwise("stable").alias("trend"))


def tumbling_heat(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("heat"))
    return e.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "heat")


def sliding_counts(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.unix_timestamp("w.start").alias("start"), "n")


def session_users(spark, sf_dir):
    """Sessions by gaps of four hours."""
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_user()))) >= 4 * 3600
    s = events(spark, sf_dir).withColumn("session", F.sum(F.when(gap, 1).otherwise(0)).over(by_user().rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low_id"))


def query_stats_case_avg(spark, sf_dir):
    size = F.when(F.col("value") < 30, "small").when(F.col("value") < 70, "medium").otherwise("large")
    return events(spark, sf_dir).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("mean_view"), F.count_if(F.col("event_type") == "error").alias("errors"))


def value_percentiles(spark, sf_dir, at=(50, 95, 99)):
    """The element at floor(n * p / 100) of each type's sorted values. Rows are sorted in ranges and written once; the counts of
    ranges say in which range, and where in it, each element stands, so no task sees a whole type."""
    e = events(spark, sf_dir).where("event_type is not null and value is not null").select("event_type", "value")
    r = e.repartitionByRange("event_type", "value").sortWithinPartitions("event_type", "value")
    r = scratch.staged(r.withColumns({"part": F.spark_partition_id(), "seat": F.monotonically_increasing_id() % (1 << 33)}), "ranges")
    held = sorted(map(tuple, r.groupBy("event_type", "part").agg(F.count(F.lit(1)), F.min("seat")).collect()))  # a row for each range of a type
    wanted = []
    for kind in sorted({h[0] for h in held}):
        own = [h for h in held if h[0] == kind]
        n = sum(h[2] for h in own)
        for p in at:
            k = min(n * p // 100, n - 1)
            for _, part, rows, first in own:
                if k < rows:
                    wanted.append((kind, p, part, first + k))
                    break
                k -= rows
    w = spark.createDataFrame(wanted, "event_type string, p int, part int, seat long")
    return r.join(F.broadcast(w), ["event_type", "part", "seat"]).groupBy("event_type").agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in at))  # three rows a type


def value_regression(spark, sf_dir):
    x = F.unix_timestamp("ts") / 3600.0 - 473352.0
    e = events(spark, sf_dir).select("event_type", "value", x.alias("x"))
    return e.groupBy("event_type").agg(F.round(F.regr_slope("value", "x"), 5).alias("slope"), F.round(F.regr_r2("value", "x"), 5).alias("r2"))


def funnel_sets(spark, sf_dir):
    """Users that viewed and bought but never had an error above 40."""
    e = events(spark, sf_dir)
    u = {k: e.where(F.col("event_type") == k).select("user_id") for k in ("view", "purchase")}
    return u["view"].intersect(u["purchase"]).exceptAll(e.where("event_type = 'error' and value > 40").select("user_id").distinct()).distinct()


def order_cube(spark, sf_dir):
    o = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


def metadata_join(spark, sf_dir):
    """Left join of kept rows with their metadata."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.where("o_orderdate >= timestamp '1995-01-01'").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


U = "PARTITION BY user_id ORDER BY ts, event_id"
QUERIES = {
    "rolling_drift": (rolling_drift, f"WITH e AS (SELECT event_id, round(avg((event_type = 'error')::INT) OVER w, 6) AS share, count(*) OVER w AS n FROM events WINDOW w AS ({U} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT event_id, share, n >= 10 AND share > 0.25 AS drift FROM e"),
    "lag_delta": (lag_delta, f"SELECT event_id, round(value - lag(value) OVER ({U}), 6) AS delta FROM events QUALIFY lag(value) OVER ({U}) IS NOT NULL"),
    "linear_extrapolation": (linear_extrapolation, f"SELECT event_id, round(value + (value - first(value) OVER w) / (count(*) OVER w - 1), 6) AS next_value FROM events WINDOW w AS ({U} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w > 1"),
    "asof_state": (asof_state, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, round(arg_max(value, (ts, event_id)), 6) AS value, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1"),
    "asof_join": (asof_join, f"WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER ({U} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events WHERE event_type IN ('purchase', 'view')) SELECT event_id, user_id, view_id FROM e WHERE event_type = 'purchase'"),
    "threshold_crossing": (threshold_crossing, "WITH s AS (SELECT user_id, round(sum(CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN value ELSE 0 END), 3) AS early, round(sum(CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN value ELSE 0 END), 3) AS late FROM events GROUP BY 1) SELECT * FROM s WHERE early < 1000 AND late >= 1000"),
    "trend_labels": (trend_labels, "WITH c AS (SELECT user_id, sum(CASE WHEN ts > TIMESTAMP '2024-01-15' THEN 1 ELSE -1 END)::BIGINT AS change FROM events GROUP BY 1) SELECT *, CASE WHEN change > 5 THEN 'growing' WHEN change < -5 THEN 'shrinking' ELSE 'stable' END AS trend FROM c"),
    "tumbling_heat": (tumbling_heat, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 3) AS heat FROM events GROUP BY 1, 2"),
    "sliding_counts": (sliding_counts, "SELECT s AS start, count(*) AS n FROM (SELECT unnest([epoch(date_trunc('hour', ts))::BIGINT, epoch(date_trunc('hour', ts))::BIGINT - 3600]) AS s FROM events) GROUP BY 1"),
    "session_users": (session_users, f"WITH g AS (SELECT *, (floor(epoch(ts)) - floor(epoch(lag(ts) OVER ({U}))) >= 14400)::INT AS gap FROM events), s AS (SELECT *, coalesce(sum(gap) OVER ({U}), 0)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, min(event_id) AS low_id FROM s GROUP BY 1, 2"),
    "query_stats_case_avg": (query_stats_case_avg, "SELECT CASE WHEN value < 30 THEN 'small' WHEN value < 70 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS mean_view, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1"),
    "value_percentiles": (value_percentiles, "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL) SELECT event_type, max(CASE WHEN r = least(n * 50 // 100, n - 1) THEN value END) AS p50, max(CASE WHEN r = least(n * 95 // 100, n - 1) THEN value END) AS p95, max(CASE WHEN r = least(n * 99 // 100, n - 1) THEN value END) AS p99 FROM e GROUP BY 1"),
    "value_regression": (value_regression, "SELECT event_type, round(regr_slope(value, floor(epoch(ts)) / 3600.0 - 473352.0), 5) AS slope, round(regr_r2(value, floor(epoch(ts)) / 3600.0 - 473352.0), 5) AS r2 FROM events GROUP BY 1"),
    "funnel_sets": (funnel_sets, "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 40"),
    "order_cube": (order_cube, "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "metadata_join": (metadata_join, "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
}
