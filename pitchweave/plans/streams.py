"""Event windows and sessions over the ``events`` table, in batch; the same operators run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchweave.sources.tables import table
from pitchweave.streaming.windows import sessions, sliding_counts


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sliding_counts(events(spark, sf), time="ts", keys=["event_type"], length="3600 seconds", step="1800 seconds")
    return rows.select("event_type", "start", "n", F.round("total", 4).alias("total"))


def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sliding_counts(events(spark, sf), time="ts", keys=["event_type"], length="3600 seconds", step="3600 seconds")
    return rows.select("event_type", "start", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions(events(spark, sf), time="ts", keys=["user_id"], gap="21600 seconds")
    return rows.select("user_id", "start", "n", F.round("total", 4).alias("total"))


def event_payload(spark: SparkSession, sf: str) -> DataFrame:
    """JSON payloads parsed, counted by key value and type."""
    rows = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


def late_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Detections received more than a day after the first of their match, per match."""
    rows = table(spark, sf, "detections").select("match_id", "box_id", "received").distinct()
    first = rows.groupBy("match_id").agg(F.min("received").alias("first"))
    late = rows.join(first, "match_id").where(F.unix_micros("received") - F.unix_micros("first") > 86_400_000_000)
    return late.groupBy("match_id").agg(F.count("*").alias("n"), F.max(F.unix_micros("received") - F.unix_micros("first")).alias("most_us"))


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    """Latest match of each status, with the number of matches in it."""
    age = F.coalesce(-F.unix_micros("created"), F.lit(2**63 - 1))
    newest = F.min(F.struct(age.alias("age"), "match_id"))
    return table(spark, sf, "futsal_matches").groupBy("status").agg(newest.alias("m"), F.count("*").alias("n")).select("status", "m.match_id", "n")


QUERIES = {f.__name__: f for f in (sliding_windows, tumbling_windows, user_sessions, event_payload, late_arrivals, latest_status)}

SQL = {
    "sliding_windows": """WITH e AS (SELECT event_type, value, CAST(floor(epoch(ts)) AS BIGINT) s FROM events), w AS (SELECT event_type, value, s - s % 1800 - o start FROM e, (VALUES (0), (1800)) x(o))
SELECT event_type, CAST(start AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""",
    "tumbling_windows": "SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": """WITH e AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000 AS INT), 0) b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) g FROM e)
SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, g""",
    "event_payload": "SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL",
    "late_arrivals": """WITH r AS (SELECT DISTINCT match_id, box_id, received FROM detections), f AS (SELECT match_id, min(received) first FROM r GROUP BY ALL)
SELECT match_id, count(*) AS n, max(epoch_us(received) - epoch_us(first)) AS most_us FROM r JOIN f USING (match_id) WHERE epoch_us(received) - epoch_us(first) > 86400000000 GROUP BY ALL""",
    "latest_status": "SELECT status, match_id, n FROM (SELECT status, match_id, row_number() OVER (PARTITION BY status ORDER BY created DESC, match_id) r, count(*) OVER (PARTITION BY status) n FROM futsal_matches) WHERE r = 1",
}
