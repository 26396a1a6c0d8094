"""Joins, set operations, keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..operators import joins, service, store
from ..sources.testdata import READINGS_SQL, readings, table
from .registry import query, r4


@query(f"""WITH {READINGS_SQL}, p AS (SELECT station_id, event_id, t FROM readings WHERE rain IS NOT NULL), s AS (SELECT station_id, t, max(press) AS press FROM readings WHERE press IS NOT NULL GROUP BY 1, 2)
    SELECT p.station_id, event_id, p.t AS t, {r4('press')} AS press, s.t AS press_t FROM p ASOF LEFT JOIN s ON p.station_id = s.station_id AND p.t >= s.t""")
def asof_backward(spark, sf_dir):
    """The latest pressure at or before each shower."""
    r = readings(spark, sf_dir)
    s = r.filter("press is not null").groupBy("station_id", F.col("t").alias("press_t")).agg(F.max("press").alias("press"))
    out = joins.as_of(r.filter("rain is not null").select("station_id", "event_id", "t"), s, ["station_id"], "t", "press_t", ["press", "press_t"])
    return out.withColumn("press", half_up(F.col("press"), 4))


@query(f"""WITH {READINGS_SQL}, p AS (SELECT station_id, event_id, t FROM readings WHERE rain IS NOT NULL), s AS (SELECT station_id, t AS st, max(temp) AS temp FROM readings WHERE temp IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT p.station_id, event_id, t, temp, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - st), st) AS k FROM p LEFT JOIN s ON p.station_id = s.station_id AND abs(t - st) <= 900)
    SELECT station_id, event_id, {r4('temp')} AS temp FROM j WHERE k = 1""")
def nearest_within_tol(spark, sf_dir):
    """The nearest temperature within a quarter of an hour of each shower."""
    r = readings(spark, sf_dir)
    s = r.filter("temp is not null").groupBy("station_id", F.col("t").alias("st")).agg(F.max("temp").alias("temp"))
    out = joins.nearest(r.filter("rain is not null").select("station_id", "event_id", "t"), s, ["station_id"], 900, "t", "st", "temp")
    return out.select("station_id", "event_id", half_up(F.col("temp"), 4).alias("temp"))


SPANS_SQL = """spans AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS start, max(epoch_us(l_shipdate)) // 86400000000 AS "end"
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate
    HAVING max(epoch_us(l_shipdate)) // 86400000000 > epoch_us(o_orderdate) // 86400000000)"""


def spans(spark, sf_dir):
    """Orders as intervals of days, from the order to its last shipment."""
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("end"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("start"))
    return o.join(last, o["o_orderkey"] == last["l_orderkey"]).filter(F.col("end") > F.col("start")).drop("l_orderkey")


@query(f"""WITH {SPANS_SQL} SELECT a.o_custkey AS o_custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order, least(a."end", b."end") - greatest(a.start, b.start) AS days
    FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.start < b."end" AND b.start < a."end" """)
def interval_overlap(spark, sf_dir):
    """Orders of a customer that were open at the same time."""
    s = spans(spark, sf_dir)
    a = s.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = s.select("o_custkey", F.col("o_orderkey").alias("second_order"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    both = joins.overlap(a, b, ["o_custkey"], ("s1", "e1"), ("s2", "e2"), width=365).filter("first_order < second_order")
    return both.select("o_custkey", "first_order", "second_order", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("days"))


@query(f"""WITH {SPANS_SQL}, at AS (SELECT c_custkey, 9500 + c_custkey % 300 AS day FROM customer)
    SELECT c_custkey, day, count(o_orderkey) AS open_orders FROM at LEFT JOIN spans ON c_custkey = o_custkey AND start <= day AND day < "end" GROUP BY 1, 2""".replace(", at AS", ", instants AS").replace("FROM at LEFT", "FROM instants LEFT"))
def state_at_instant(spark, sf_dir):
    """What holds at an instant."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (9500 + F.col("c_custkey") % 300).alias("day"))
    s = spans(spark, sf_dir)
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("start") <= F.col("day")) & (F.col("day") < F.col("end"))
    return c.join(s, on, "left").groupBy("c_custkey", "day").agg(F.count("o_orderkey").alias("open_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_rules(spark, sf_dir):
    """Owners of at least one rule of a kind."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')")
def anti_fired(spark, sf_dir):
    """Those for whom nothing has fired since a date."""
    fired = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").join(fired, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def sessions_users(spark, sf_dir):
    """Sessions with their users, here orders with customers and nations."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query(f"""WITH {READINGS_SQL}, a AS (SELECT station_id, t // 3600 AS hour, avg(temp) AS measured FROM readings WHERE temp IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT station_id, t // 3600 + 6 AS hour, max(temp) AS forecast FROM readings WHERE temp IS NOT NULL GROUP BY 1, 2)
    SELECT station_id, hour, {r4('measured')} AS measured, {r4('forecast')} AS forecast FROM a FULL JOIN b USING (station_id, hour)""")
def full_outer_chart(spark, sf_dir):
    """Measured and forecast by time, either of which may be missing."""
    r = readings(spark, sf_dir).filter("temp is not null").withColumn("hour", F.floor(F.col("t") / 3600))
    a = r.groupBy("station_id", "hour").agg(half_up(F.avg("temp"), 4).alias("measured"))
    b = r.groupBy("station_id", (F.col("hour") + 6).alias("hour")).agg(half_up(F.max("temp"), 4).alias("forecast"))
    return a.join(b, ["station_id", "hour"], "full")


@query("""SELECT event_type, coalesce(d.offset_c, 0.0)::DOUBLE AS offset_c, count(*) AS n FROM events LEFT JOIN (VALUES ('click', 1.0), ('view', -1.0), ('error', -2.5)) d(kind, offset_c) ON event_type = kind GROUP BY 1, 2""")
def dimension_default(spark, sf_dir):
    """A small dimension, with a default where it has no row."""
    d = spark.createDataFrame([("click", 1.0), ("view", -1.0), ("error", -2.5)], "event_type string, offset_c double")
    e = table(spark, sf_dir, "events").join(F.broadcast(d), "event_type", "left").fillna(0.0, ["offset_c"])
    return e.groupBy("event_type", "offset_c").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, o_orderkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'general' ELSE c_mktsegment END AS rule FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR (c_mktsegment = 'HOUSEHOLD' AND o_orderstatus = 'F') OR (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND o_orderstatus = 'O')""")
def rules_owners_plans(spark, sf_dir):
    """Rules with their owners' plans; a general rule takes every plan, others those of their kind."""
    c = table(spark, sf_dir, "customer").withColumn("rule", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "general").otherwise(F.col("c_mktsegment")))
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("rule") == "HOUSEHOLD", F.lit("F")).otherwise("O")
    on = (F.col("c_custkey") == F.col("o_custkey")) & ((F.col("rule") == "general") | (F.col("o_orderstatus") == kind))
    return c.join(o, on).select("c_custkey", "o_orderkey", "rule")


@query("""WITH old AS (SELECT c_custkey AS id, c_acctbal AS value, 0 AS version FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, c_acctbal + 1 AS value, 1 AS version FROM customer WHERE c_custkey % 2 = 0)
    SELECT id, value, version FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def upsert_latest(spark, sf_dir):
    """K5, K6: rows replaced by key."""
    c = table(spark, sf_dir, "customer")
    row = lambda k, v: [F.col("c_custkey").alias("id"), k.alias("value"), F.lit(v).alias("version")]
    old = c.filter("c_custkey % 3 <> 0").select(*row(F.col("c_acctbal"), 0))
    return store.upsert(old, c.filter("c_custkey % 2 = 0").select(*row(F.col("c_acctbal") + 1, 1)), ["id"], "version")


@query("SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def insert_ignore(spark, sf_dir):
    """K7: only rows of new keys are added."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    old, new = c.filter("id % 3 <> 0").withColumn("origin", F.lit("old")), c.filter("id % 2 = 0").withColumn("origin", F.lit("new"))
    return store.insert_ignore(old, new, ["id"])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def delete_listed(spark, sf_dir):
    """K8: rows whose key is in a list go."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return store.delete_listed(c.select(F.col("c_custkey").alias("id")), s.select(F.col("s_suppkey").alias("id")), ["id"])


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS last_result FROM orders
    UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey), o_orderpriority || ' copy', NULL FROM orders WHERE o_orderkey % 1000 = 0""")
def plan_store(spark, sf_dir):
    """Q39 to Q41: a changed plan loses its saved result; copies get new ids after the highest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("last_result"))
    changed = o.withColumn("last_result", store.clear_if(F.col("o_orderkey") % 5 == 0, "last_result"))
    copies = o.filter("o_orderkey % 1000 = 0").withColumns({"o_orderpriority": F.concat("o_orderpriority", F.lit(" copy")), "last_result": F.lit(None).cast("double")})
    return store.append_numbered(changed, copies, "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first(spark, sf_dir):
    """The newest rows."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ')")
def keyword_search(spark, sf_dir):
    """A word in a label or in keywords."""
    p = table(spark, sf_dir, "part")
    return p.filter(F.lower("p_name").contains("ring") | F.lower("p_type").contains("econ")).select("p_partkey", "p_name")


@query(f"""SELECT n_name, {r4('avg(c_acctbal)')} AS mean, {r4('avg(c_acctbal) - avg(avg(c_acctbal)) OVER ()')} AS anomaly FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def county_anomaly(spark, sf_dir):
    """Each place against the mean of places."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    means = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    # one row a place by now
    anomaly = F.col("m") - F.avg("m").over(Window.partitionBy())
    return means.select("n_name", half_up(F.col("m"), 4).alias("mean"), half_up(anomaly, 4).alias("anomaly"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events), n AS (SELECT max(t) - 86400 AS now FROM e), r AS (SELECT user_id FROM e, n WHERE t >= now - 3600 AND t <= now),
    o AS (SELECT user_id, count(*) AS own FROM r GROUP BY 1), x AS (SELECT DISTINCT user_id, coalesce(own, 0) AS own_last_hour, (SELECT count(*) FROM r) AS all_last_hour FROM e LEFT JOIN o USING (user_id))
    SELECT *, CASE WHEN all_last_hour >= 100 THEN 'global' WHEN own_last_hour >= 1 THEN 'address' ELSE 'ok' END AS cap FROM x""")
def email_cap(spark, sf_dir):
    """Mails of the last hour to each user and to all, and the cap that stops one more."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    now = e.agg(F.max("t")).first()[0]
    until = F.lit((now or 0) - 86400)
    return service.mail_caps(e.filter(F.col("t") <= until), e.select("user_id").distinct(), "user_id", until, per_user=1, overall=100)
