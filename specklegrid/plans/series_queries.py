"""Queries over the stream and relational tables: series, selections, joins by time, histograms and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import schedules as S
from ..operators import aggregate as G
from ..sources import text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6) + 0.0


@query("running_mean_500", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS running, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) + 0.0 AS delta FROM events")
def running_mean_500(spark, sf_dir):
    x = G.running_mean(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return x.select("event_id", F.round(F.col("running") + 1e-9, 6).alias("running"), r6(F.col("delta")).alias("delta"))


@query("missing_interpolate", "WITH e AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events), w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, lead(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM e) SELECT event_id, round(coalesce(v, CASE WHEN b IS NULL THEN a END, (a + b) / 2, b), 6) + 0.0 AS filled FROM w")
def missing_interpolate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return G.interpolate_missing(e, "user_id", ["ts", "event_id"], "v").select("event_id", r6(F.col("filled")).alias("filled"))


@query("curve_decimate", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, value FROM k WHERE k % greatest(ceil(n / 20.0)::BIGINT, 1) = 0")
def curve_decimate(spark, sf_dir):
    return G.decimate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("newest_per_category", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def newest_per_category(spark, sf_dir):
    return G.newest(table(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts"), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "value")


@query("asof_checkpoint", "WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT l.event_id, (SELECT arg_max(r.value, (r.ts, r.event_id)) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS paid FROM l".replace("arg_max(r.value, (r.ts, r.event_id))", "max_by(r.value, r.ts)"))
def asof_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    return G.asof(left, right, "user_id", "ts", "paid").select("event_id", "paid")


@query("pulse_join", "WITH m AS (SELECT event_id, user_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'), c AS (SELECT user_id AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view') SELECT m.event_id, c.value FROM m LEFT JOIN c USING (t, k)")
def pulse_join(spark, sf_dir):
    """Equal stamps are consumed in order on both sides."""
    e = table(spark, sf_dir, "events")
    master = e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("ts"), F.col("event_id").alias("seq"))
    shots = e.where("event_type = 'view'").select(F.col("user_id").alias("ts"), "value", F.col("event_id").alias("seq"))
    return text.pulses(master, shots).select("event_id", "value")


@query("tumbling_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("session_windows", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("histogram", "SELECT floor(l_quantity)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    return G.histogram(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("exposure_merge", "SELECT l_partkey, round(coalesce(sum(CASE WHEN l_quantity < 45 THEN (l_quantity - l_tax) / nullif(1 + l_discount, 0) END) / nullif(sum(CASE WHEN l_quantity < 45 THEN 1 ELSE 0 END), 0), 90), 6) + 0.0 AS re, (CASE WHEN sum(CASE WHEN l_quantity < 45 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END)::BIGINT AS mask FROM lineitem GROUP BY l_partkey")
def exposure_merge(spark, sf_dir):
    shots = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("v"), F.col("l_tax").alias("back"), (1 + F.col("l_discount")).alias("time"), F.lit(45.0).alias("saturation"))
    return G.weighted_merge(shots, "l_partkey").select("l_partkey", r6(F.col("re")).alias("re"), F.col("mask").cast("long").alias("mask"))


@query("pairwise_ratio", "WITH p AS (SELECT o_custkey, o_totalprice / nullif(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS q FROM orders) SELECT o_custkey, round(avg(q), 6) + 0.0 AS ratio FROM p WHERE q IS NOT NULL GROUP BY o_custkey")
def pairwise_ratio(spark, sf_dir):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    q = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / F.nullif(before, F.lit(0.0))).alias("q"))
    return q.where("q is not null").groupBy("o_custkey").agg(r6(F.avg("q")).alias("ratio"))


@query("select_by_error", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND o_totalprice < 150000 AND o_orderstatus <> 'F'")
def select_by_error(spark, sf_dir):
    """The last log line of each run, if it passes both limits."""
    last = G.newest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return last.where("o_totalprice < 150000 and o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")


@query("schedule_lookup", "WITH k AS (SELECT unnest(range(0, 201)) AS k) SELECT k::BIGINT AS k, round(0.5 + (0.9 - 0.5) / (exp((k - 100) / 0.2) + 1), 6) AS fermi, round(0.75 + 0.25 * (1 - exp(-pow(k / 50.0, 3))), 6) AS beta, round((6 - 1.5) * exp(-(k * k) / 10000.0) + 1.5, 6) AS gaussian, round(greatest(6 * pow(0.25, k / 100.0), 1.5), 6) AS geometric, round(0.1 + (0.035 - 0.1) * least(k / 150.0, 1), 6) AS area FROM k")
def schedule_lookup(spark, sf_dir):
    k = F.col("id").cast("double")
    return spark.range(201).select(
        F.col("id").alias("k"), F.round(S.fermi(k, 100.0, 0.2, 0.5, 0.9), 6).alias("fermi"), F.round(S.dynamic_beta(k, 0.75, 50.0), 6).alias("beta"),
        F.round(S.decay(k, 6.0, 1.5, 100.0), 6).alias("gaussian"), F.round(S.decay(k, 6.0, 1.5, 100.0, "geometric"), 6).alias("geometric"), F.round(S.linear_area(k, 0.1, 0.035, 150.0), 6).alias("area"),
    )


@query("sphere_form_factor", "WITH q AS (SELECT k, 6.283185307179586 * (k / 100.0::DOUBLE) * 2 AS s FROM (SELECT unnest(range(0, 200)) AS k)) SELECT k::BIGINT AS k, round(CASE WHEN s = 0 THEN 0 ELSE (sin(s) / nullif(s * s, 0) - cos(s) / nullif(s, 0)) * 4 * 3.141592653589793 * 8 / nullif(s, 0) END, 6) + 0.0 AS f FROM q")
def sphere_form_factor(spark, sf_dir):
    return spark.range(200).select(F.col("id").alias("k"), r6(S.sphere_form_factor(F.col("id") / 100.0, 2.0)).alias("f"))


@query("spheres_phantom", "WITH v AS (SELECT i % 20 AS x, (i // 20) % 20 AS y, i // 400 AS z, i FROM (SELECT unnest(range(8000)) AS i)), s(cx, cy, cz, r2, density) AS (VALUES (6, 6, 6, 9, 1.0), (13, 13, 13, 16, 2.0), (6, 13, 10, 4, 0.5), (13, 6, 10, 9, 1.5)) SELECT i::BIGINT AS i, sum(density)::DOUBLE AS re FROM v JOIN s ON (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) < r2 GROUP BY i")
def spheres_phantom(spark, sf_dir):
    """Four spheres in a cube: a range predicate on the squared distance, over a handful of literals."""
    v = spark.range(8000).select(F.col("id").alias("i"), (F.col("id") % 20).alias("x"), (F.floor(F.col("id") / 20) % 20).alias("y"), F.floor(F.col("id") / 400).alias("z"))
    spheres = [(6, 6, 6, 9, 1.0), (13, 13, 13, 16, 2.0), (6, 13, 10, 4, 0.5), (13, 6, 10, 9, 1.5)]
    part = lambda cx, cy, cz, r2, d: F.when((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 + (F.col("z") - cz) ** 2 < r2, d).otherwise(0.0)
    return v.select("i", sum((part(*s) for s in spheres), F.lit(0.0)).alias("re")).where("re > 0")
