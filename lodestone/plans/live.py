"""Queries of the live job over events: views rate up, clicks down, sign-ups are quotes, purchases payments."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import table
from lodestone.streaming import late, ordered
from lodestone.streaming import live as ops

LIMIT = 1
SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; in local mode one of our own where none is named."""
    found = spark.conf.get(SHARED, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED} must name a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ratings(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin("view", "click")).select("ts", F.when(F.col("event_type") == "view", "up").otherwise("down").alias("rating"), F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))).alias("mode"))


def feedback_tallies(spark: SparkSession, d: str) -> DataFrame:
    return ops.tallies(_ratings(_events(spark, d)), "1 day")


def feedback_totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(_ratings(_events(spark, d)))


def live_feedback_tallies(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream."""
    return ops.drained(ops.tallies(_ratings(ops.event_stream(spark, f"{d}/events.parquet")), "1 day"), "update", ["window_start", "mode"], shared_folder(spark))


def request_bursts(spark: SparkSession, d: str) -> DataFrame:
    return ops.bursts(_events(spark, d), LIMIT, "10 minutes")


def live_request_bursts(spark: SparkSession, d: str) -> DataFrame:
    return ops.drained(ops.bursts(ops.event_stream(spark, f"{d}/events.parquet"), LIMIT, "10 minutes"), "update", ["user_id", "window_start"], shared_folder(spark))


def _quotes_and_payments(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    quotes = e.filter("event_type = 'signup'").select(F.col("event_id").alias("quote_id"), "user_id", F.col("ts").alias("quoted_at"))
    return quotes, e.filter("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), "user_id", F.col("ts").alias("paid_at"))


def quote_payments(spark: SparkSession, d: str) -> DataFrame:
    return ops.matched_payments(*_quotes_and_payments(_events(spark, d)), 600)


def live_quote_payments(spark: SparkSession, d: str) -> DataFrame:
    """A join of two streams: the quotes that were paid in time."""
    quotes, payments = _quotes_and_payments(ops.event_stream(spark, f"{d}/events.parquet"))
    return ops.drained(ops.matched_payments(quotes, payments, 600, "inner"), "append", ["quote_id", "payment_id"], shared_folder(spark))


def reused_transactions(spark: SparkSession, d: str) -> DataFrame:
    p = _events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), F.get_json_object("props", "$.k").alias("txid"), F.col("ts").alias("paid_at"))
    return ops.reused(p)


def _changes(e: DataFrame) -> DataFrame:
    step = F.when(F.col("event_type") == "signup", "quoted").when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "view", "delivered").when(F.col("event_type") == "error", "failed").otherwise("refunded")
    return e.select(F.col("user_id").alias("key"), step.alias("status"), "ts", F.col("event_id").alias("change_id"))


def latest_states(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest_state(_changes(_events(spark, d)))


def _ordered_changes(e: DataFrame) -> DataFrame:
    return _changes(e).withColumnRenamed("change_id", "id")


def purchase_states(spark: SparkSession, d: str) -> DataFrame:
    """Each key's state by time and id, up to ten minutes before the newest change."""
    events = _events(spark, d)
    return ordered.walked_batch(_ordered_changes(events), ordered.Purchase, ordered.watermark(events))


def live_purchase_states(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream, whose watermark ends there."""
    own = ordered.stateful_session(spark)
    rows = ordered.walked_stream(_ordered_changes(ops.event_stream(own, f"{d}/events.parquet")), ordered.Purchase)
    return ops.drained(rows, "append", ["key"], shared_folder(spark), "steps")


def _payment_events(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "quote").otherwise("payment")
    rows = e.filter(F.col("event_type").isin("signup", "purchase"))
    return rows.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), (F.col("value") / F.when(F.col("event_type") == "signup", 4.0).otherwise(1.0)).alias("amount"), F.get_json_object("props", "$.k").alias("txid"))


def settled_payments(spark: SparkSession, d: str) -> DataFrame:
    """Each payment with its reason and each quote that nobody paid."""
    rows = _payment_events(_events(spark, d))
    return ordered.walked_batch(rows, ordered.Payments, ordered.watermark(rows))


def live_settled_payments(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream: timers end the quotes that nobody pays."""
    own = ordered.stateful_session(spark)
    rows = ordered.walked_stream(_payment_events(ops.event_stream(own, f"{d}/events.parquet")), ordered.Payments)
    return ops.drained(rows, "append", ["key", "quote_id", "payment_id"], shared_folder(spark))


#: How late an event comes, in days, by its id: one of eleven a day late, one of 23 three days.
LAG = 11, 23


def live_late_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed in order of arrival, three days a file, some of them late: what came in time, by day, and what didn't."""
    e = _events(spark, d)
    lag = F.when(F.col("event_id") % LAG[1] == 0, 3).when(F.col("event_id") % LAG[0] == 0, 1).otherwise(0)
    arrival = F.floor((F.unix_date(F.to_date("ts")) + lag) / 3).cast("int")
    return late.late_counts(late.split_late(late.replayed(e, arrival, shared_folder(spark)), 86_400_000, shared_folder(spark)))


def answers_within_ttl(spark: SparkSession, d: str) -> DataFrame:
    return ops.first_within_ttl(_changes(_events(spark, d)))


def text_prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ops.price(F.length("text"), 50.0).alias("price"))


QUERIES = {f.__name__: f for f in (feedback_tallies, feedback_totals, live_feedback_tallies, request_bursts, live_request_bursts, quote_payments, live_quote_payments, reused_transactions, latest_states, purchase_states, live_purchase_states, settled_payments, live_settled_payments, live_late_counts, answers_within_ttl, text_prices)}

RATINGS = "r AS (SELECT ts, event_type = 'view' AS up, CASE WHEN user_id % 4 > 0 THEN 'm' || (user_id % 4) END AS mode FROM events WHERE event_type IN ('view', 'click'))"
TALLIES = f"WITH {RATINGS} SELECT (date_trunc('day', ts))::TIMESTAMPTZ AS window_start, mode, count(*) FILTER (up) AS up, count(*) FILTER (NOT up) AS down FROM r GROUP BY ALL"
BURSTS = f"SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts)::TIMESTAMPTZ AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > {LIMIT}"
STATES = """WITH RECURSIVE e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  CASE event_type WHEN 'signup' THEN 'quoted' WHEN 'purchase' THEN 'paid' WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'failed' ELSE 'refunded' END AS step
  FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM events)),
s AS (SELECT DISTINCT key, 0::BIGINT AS steps, NULL::VARCHAR AS status, 0::BIGINT AS rejected FROM e
  UNION ALL SELECT key, n, CASE WHEN ok THEN step ELSE status END, rejected + (NOT ok)::INT FROM (SELECT s.key, e.n, e.step, s.status, s.rejected,
    coalesce(CASE s.status WHEN 'quoted' THEN step IN ('paid', 'failed') WHEN 'paid' THEN step IN ('delivered', 'refunded') WHEN 'delivered' THEN step = 'refunded' WHEN 'failed' THEN false WHEN 'refunded' THEN false ELSE step = 'quoted' END, false) AS ok
    FROM s JOIN e ON e.key = s.key AND e.n = s.steps + 1))
SELECT key, status, rejected, steps FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY steps DESC) = 1"""
SETTLED = """WITH RECURSIVE a AS (SELECT * FROM events WHERE event_type IN ('signup', 'purchase')), w AS (SELECT epoch_ms(max(ts)) - 600000 AS until FROM a),
e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts, event_id AS id, event_type = 'signup' AS quote, CASE WHEN event_type = 'signup' THEN value / 4 ELSE value END AS amount,
  json_extract_string(props, '$.k') AS txid FROM a, w WHERE epoch_ms(ts) < until),
s AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS quote_id, NULL::DOUBLE AS price, NULL::TIMESTAMP AS made, 'none' AS status, []::VARCHAR[] AS known, NULL::BIGINT AS ended, NULL::VARCHAR AS ended_reason, NULL::BIGINT AS payment_id, NULL::VARCHAR AS reason FROM e
  UNION ALL SELECT key, n, CASE WHEN quote THEN id ELSE quote_id END, CASE WHEN quote THEN amount ELSE price END, CASE WHEN quote THEN ts ELSE made END,
    CASE WHEN quote THEN 'open' WHEN reason = 'paid' THEN 'paid' ELSE st END, CASE WHEN reason = 'paid' AND txid IS NOT NULL THEN list_append(known, txid) ELSE known END,
    CASE WHEN over OR quote AND st = 'open' THEN quote_id END, CASE WHEN over THEN 'unpaid' WHEN quote AND st = 'open' THEN 'replaced' END, CASE WHEN NOT quote THEN id END, reason
  FROM (SELECT *, CASE WHEN quote THEN NULL WHEN st = 'none' THEN 'unknown' WHEN st = 'paid' THEN 'used' WHEN st = 'expired' THEN 'expired' WHEN amount < price THEN 'underpaid'
      WHEN coalesce(list_contains(known, txid), false) THEN 'reused' ELSE 'paid' END AS reason
    FROM (SELECT e.*, s.quote_id, s.price, s.made, s.known, s.status = 'open' AND e.ts > s.made + INTERVAL 600 MINUTE AS over, CASE WHEN s.status = 'open' AND e.ts > s.made + INTERVAL 600 MINUTE THEN 'expired' ELSE s.status END AS st
      FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))),
z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
SELECT key, ended AS quote_id, NULL::BIGINT AS payment_id, ended_reason AS reason FROM s WHERE ended IS NOT NULL
UNION ALL SELECT key, quote_id, payment_id, reason FROM s WHERE payment_id IS NOT NULL
UNION ALL SELECT key, quote_id, NULL, 'unpaid' FROM z, w WHERE status = 'open' AND epoch_us(made) + 36000000000 < until * 1000"""
ORACLE_SQL = {
    "purchase_states": STATES,
    "live_purchase_states": STATES,
    "settled_payments": SETTLED,
    "live_settled_payments": SETTLED,
    "live_late_counts": f"""WITH e AS (SELECT ts, floor((datediff('day', DATE '1970-01-01', ts::DATE) + CASE WHEN event_id % {LAG[1]} = 0 THEN 3 WHEN event_id % {LAG[0]} = 0 THEN 1 ELSE 0 END) / 3) AS arrival FROM events),
b AS (SELECT arrival, dense_rank() OVER (ORDER BY arrival) - 1 AS batch, max(epoch_ms(ts)) AS newest FROM e GROUP BY arrival), k AS (SELECT arrival, batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM b)
SELECT ts::DATE AS day, count(*) FILTER (NOT coalesce(epoch_ms(ts) < known - 86400000, false)) AS kept, count(*) FILTER (coalesce(epoch_ms(ts) < known - 86400000, false)) AS late, max(batch) AS newest_batch FROM e JOIN k USING (arrival) GROUP BY ALL""",
    "feedback_tallies": TALLIES,
    "live_feedback_tallies": TALLIES,
    "feedback_totals": f"WITH {RATINGS} SELECT mode, count(*) FILTER (up) AS up, count(*) FILTER (NOT up) AS down FROM r WHERE mode IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, count(*) FILTER (up), count(*) FILTER (NOT up) FROM r",
    "request_bursts": BURSTS,
    "live_request_bursts": BURSTS,
    "quote_payments": "SELECT q.event_id AS quote_id, q.user_id, p.event_id AS payment_id FROM (SELECT * FROM events WHERE event_type = 'signup') q LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON q.user_id = p.user_id AND p.ts BETWEEN q.ts AND q.ts + INTERVAL 600 MINUTE",
    "live_quote_payments": "SELECT q.event_id AS quote_id, q.user_id, p.event_id AS payment_id FROM (SELECT * FROM events WHERE event_type = 'signup') q JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON q.user_id = p.user_id AND p.ts BETWEEN q.ts AND q.ts + INTERVAL 600 MINUTE",
    "reused_transactions": "SELECT event_id AS payment_id, json_extract_string(props, '$.k') AS txid FROM events WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY ts, event_id) > 1",
    "latest_states": "SELECT user_id AS key, arg_max(CASE event_type WHEN 'signup' THEN 'quoted' WHEN 'purchase' THEN 'paid' WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'failed' ELSE 'refunded' END, {'ts': ts, 'i': event_id}) AS status, count(*) AS changes FROM events GROUP BY ALL",
    "answers_within_ttl": """WITH RECURSIVE k AS (SELECT user_id, arg_min(event_id, {'t': ts, 'i': event_id}) AS change_id, min(ts) AS ts FROM events GROUP BY ALL
UNION ALL SELECT user_id, event_id, ts FROM (SELECT e.user_id, e.event_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS r FROM k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOUR) WHERE r = 1) SELECT change_id FROM k""",
    "text_prices": "SELECT doc_id, ceil(greatest(length(text), 100)::DOUBLE * 0.0001::DOUBLE / (50.0::DOUBLE * 0.9::DOUBLE) * 1e8::DOUBLE)::BIGINT AS price FROM documents",
}
