"""Batch twins of the streaming windows (an addition: the builder model has no streams)."""

from pyspark.sql import functions as F

from ..streaming import windows as w
from .registry import query


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    return w.tumbling(t.events, "1 hour", ("event_type",)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 2) AS total
FROM events, (SELECT unnest([0, 1]) AS k) x GROUP BY 1""")
def sliding_windows(t):
    return w.sliding(t.events, "1 hour", "30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 2).alias("total"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(t):
    return w.sessions(t.events, "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_once(t):
    return w.once(t.events.select("user_id", "event_type"), ["user_id", "event_type"])
