"""Queries over histories: gaps, cuts, latest values, change-only rows, deduplication, overlaps, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coverage, history, integrity
from tidemark.plans.common import table

FLOOR = 3


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: a user's week is one visit of a bucket (the event type)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("bucket"), F.date_trunc("week", "ts").cast("date").alias("captured_on"), F.col("ts").cast("date").alias("day"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), "ts")


CAPTURES = """c AS (SELECT event_id, user_id AS key, event_type AS bucket, CAST(date_trunc('week', ts) AS DATE) AS captured_on,
                    CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS cents, ts FROM events)"""
GAPS = f"""{CAPTURES},
    b AS (SELECT key, bucket, captured_on, count(*) AS rows_written, min(day) AS batch_oldest, max(day) AS batch_newest FROM c GROUP BY ALL),
    q AS (SELECT *, row_number() OVER w AS seq, max(rows_written) OVER (PARTITION BY key, bucket) AS est_page_cap,
                 max(batch_newest) OVER (PARTITION BY key, bucket ORDER BY captured_on ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known,
                 lag(captured_on) OVER w AS prev_visit FROM b WINDOW w AS (PARTITION BY key, bucket ORDER BY captured_on)),
    g AS (SELECT *, CASE WHEN bucket = 'view' THEN greatest(est_page_cap, {FLOOR}) ELSE {FLOOR} END AS page_cap FROM q WHERE seq > 1)"""
CUTS = f"""{GAPS}, k AS (SELECT DISTINCT ON (key) key, batch_oldest AS cut_at FROM g
    WHERE rows_written >= page_cap AND batch_oldest > last_known ORDER BY key, captured_on DESC, batch_oldest DESC)"""


def _candidates(spark, sf_dir):
    return coverage.gap_candidates(_captures(spark, sf_dir), ["key", "bucket"], "captured_on", "day", "bucket", "view", FLOOR)


def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = coverage.gap_audit(_captures(spark, sf_dir), ["key", "bucket"], "captured_on", "day", "bucket", "view", FLOOR)
    return audit.select("key", "bucket", "captured_on", "prev_visit", "rows_written", F.col("seq").cast("bigint").alias("seq"), "batch_oldest", "batch_newest", "last_known", "page_cap", "verdict")


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap audit with the names of users (as customers) and their nations."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("group_id"))
    groups = table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 6").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"))
    return coverage.gap_report(_candidates(spark, sf_dir), "key", "captured_on", names, groups)


def history_cut_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.cut_plan(_captures(spark, sf_dir), coverage.cut_list(_candidates(spark, sf_dir), "key", "captured_on"), "key", "day")


def history_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = coverage.cut_list(_candidates(spark, sf_dir), "key", "captured_on")
    return coverage.after_cut(_captures(spark, sf_dir), cuts, "key", "day").select("event_id", "key", "day")


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_by_key(_captures(spark, sf_dir), ["key", "bucket"], "ts", "cents", "event_id")


def _daily(spark, sf_dir):
    return _captures(spark, sf_dir).groupBy("key", "bucket", "day").agg(F.max("cents").alias("cents"))


def change_only_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.change_only_history(_daily(spark, sf_dir), ["key", "bucket"], "day", "cents")


def change_only_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    before, today = daily.filter("day < date'2024-01-20'"), daily.filter("day >= date'2024-01-20'")
    first = history.last_rows(today, ["key", "bucket"], [F.asc("day")])
    return history.change_only_plan(first, history.latest_by_key(before, ["key", "bucket"], "day", "cents"), ["key", "bucket"], "cents")


def delta_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.delta_history(_daily(spark, sf_dir), ["key", "bucket"], "day", "cents")


_LINE = ["l_orderkey", "l_linenumber"]


def _line_order():
    return [F.asc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_LINE, "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


def _first_lines(df: DataFrame) -> DataFrame:
    return history.dedup_rows(df, _LINE, [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])


def dedup_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_lines(_lines(spark, sf_dir))


def dedup_append_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    old, new = lines.filter("l_shipdate < timestamp_ntz'1995-01-01'"), lines.filter("l_shipdate >= timestamp_ntz'1995-01-01'")
    added = history.dedup_append(old, new, _LINE, [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return added.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("appended"), F.min("l_shipdate").cast("date").alias("first_ship"))


def upsert_touch_vs_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return history.upsert_actions(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["hash"])


def _overlaps(spark, sf_dir):
    e = _captures(spark, sf_dir)
    before, after = e.filter("day < date'2024-01-20'"), e.filter("day < date'2024-01-25'")
    page = e.filter("day >= date'2024-01-18' and day < date'2024-01-25'").withColumn("pos", -F.col("event_id"))
    return coverage.page_margins(page, coverage.overlap(before, after, ["key", "bucket"]), ["key"], "bucket", ["event_id"], "pos")


_OVERLAP = f"""{CAPTURES},
    o AS (SELECT key, bucket, count(*) FILTER (WHERE day < DATE '2024-01-20') AS held_before, count(*) AS n_after FROM c WHERE day < DATE '2024-01-25' GROUP BY ALL),
    p AS (SELECT key, bucket, count(DISTINCT event_id) AS distinct_on_page, min(-event_id) AS first_pos FROM c
          WHERE day >= DATE '2024-01-18' AND day < DATE '2024-01-25' GROUP BY ALL),
    m AS (SELECT p.*, coalesce(held_before, 0) AS held_before, greatest(coalesce(n_after, 0) - coalesce(held_before, 0), 0) AS newly_written FROM p LEFT JOIN o USING (key, bucket))"""


def bucket_overlap_at_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.at_cap_buckets(_overlaps(spark, sf_dir), ["key"], "bucket")


def narrowest_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.narrowest_margin(_overlaps(spark, sf_dir), ["key"], "bucket", full_page=2)


def burst_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = coverage.burst_rate(_captures(spark, sf_dir), "key", "bucket", "day", F.lit("2024-01-30").cast("date"), ["event_id"])
    return rates.select("key", F.round("rate", 9).alias("rate"))


def _tasks(spark: SparkSession, rows: int, most: int = 250_000) -> int:
    """Tasks for an exchange of so many rows, at most about ``most`` each, but no fewer than Spark's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def cap_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.lit("").alias("stream"), F.col("l_partkey").alias("position"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_partkey").alias("row_id")
    )
    return integrity.cap_classification(lines, ["key"], "stream", "position", "cents", "day", ["row_id"], run_gap=3, partitions=_tasks(spark, lines.count()))


def _priority():
    return F.substring("o_orderpriority", 1, 1).cast("int")


def monotonicity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), _priority().alias("tier"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return integrity.monotonicity_violations(o.groupBy("month", "tier").agg(F.max("cents").alias("cents")), ["month"], "tier", "cents")


def restatement_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _captures(spark, sf_dir).groupBy("key", "captured_on").agg(F.count(F.lit(1)).alias("n"))
    d = history.delta_history(counts, ["key"], "captured_on", "n").withColumn("previous", F.col("n") - F.col("delta"))
    return d.withColumn("anomaly", integrity.restatement(F.col("previous"), F.col("n"), spike_times=2)).filter("anomaly is not null").select("key", "captured_on", "previous", "n", "anomaly")


def parse_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.failure_spike(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error", threshold=0.1).withColumn("share", F.round("share", 9))


def rolling_brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"))
    return integrity.rolling_brake(e, "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"))


def acceptance_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return (
        integrity.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders without customer")
        .unionByName(integrity.orphans(t("nation"), t("region"), "n_regionkey", "r_regionkey", "nations without region"))
        .unionByName(integrity.duplicate_keys(t("lineitem"), _LINE, "line keys that repeat"))
    )


QUERIES = {f.__name__: f for f in (gap_audit, gap_report, history_cut_plan, history_after_cut, latest_by_key, change_only_history, change_only_plan, delta_history, dedup_natural_key, dedup_append_counts, upsert_touch_vs_insert, bucket_overlap_at_cap, narrowest_margin, burst_rate, cap_classification, monotonicity_violations, restatement_anomalies, parse_failure_rate, rolling_brake, acceptance_invariants)}

_DAILY = f"{CAPTURES}, y AS (SELECT key, bucket, day, max(cents) AS cents FROM c GROUP BY ALL)"
_FIRST = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1"

ORACLES = {
    "gap_audit": f"""WITH {GAPS} SELECT key, bucket, captured_on, prev_visit, rows_written, seq, batch_oldest, batch_newest, last_known, page_cap,
        CASE WHEN rows_written >= page_cap AND batch_oldest > last_known THEN 'GAP' WHEN rows_written >= page_cap AND batch_oldest = last_known THEN 'BOUNDARY'
             WHEN rows_written >= page_cap THEN 'FULL' ELSE 'OK' END AS verdict FROM g""",
    "gap_report": f"""WITH {GAPS} SELECT key, c_name AS name, n_name AS group_name, bucket, captured_on, rows_written AS new_rows, page_cap, last_known AS blind_from, batch_oldest AS blind_to,
        CAST(date_diff('day', prev_visit, captured_on) AS DOUBLE) AS visit_gap_days, CASE WHEN batch_oldest <= last_known THEN 'reached back' ELSE 'GAP' END AS verdict
        FROM g JOIN customer ON c_custkey = key JOIN nation ON n_nationkey = c_nationkey WHERE rows_written >= page_cap AND n_nationkey % 7 <> 6""",
    "history_cut_plan": f"""WITH {CUTS} SELECT key, cut_at, (SELECT count(*) FROM c WHERE c.key = k.key AND day < cut_at) AS to_delete,
        (SELECT count(*) FROM c WHERE c.key = k.key AND day >= cut_at) AS to_keep FROM k""",
    "history_after_cut": f"WITH {CUTS} SELECT event_id, c.key, day FROM c LEFT JOIN k USING (key) WHERE cut_at IS NULL OR day >= cut_at",
    "latest_by_key": f"WITH {CAPTURES} SELECT key, bucket, cents, ts FROM c QUALIFY row_number() OVER (PARTITION BY key, bucket ORDER BY ts DESC, event_id DESC) = 1",
    "change_only_history": f"WITH {_DAILY} SELECT * FROM y QUALIFY cents <> coalesce(lag(cents) OVER (PARTITION BY key, bucket ORDER BY day), 0)",
    "change_only_plan": f"""WITH {_DAILY}, l AS (SELECT key, bucket, cents AS last FROM y WHERE day < DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY key, bucket ORDER BY day DESC) = 1),
        n AS (SELECT * FROM y WHERE day >= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY key, bucket ORDER BY day) = 1)
        SELECT key, bucket, day, cents FROM n LEFT JOIN l USING (key, bucket) WHERE cents <> coalesce(last, 0)""",
    "delta_history": f"WITH {_DAILY} SELECT *, cents - lag(cents) OVER (PARTITION BY key, bucket ORDER BY day) AS delta FROM y",
    "dedup_natural_key": f"SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY {_FIRST}",
    "dedup_append_counts": f"""WITH n AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' QUALIFY {_FIRST})
        SELECT l_linenumber, count(*) AS appended, CAST(min(l_shipdate) AS DATE) AS first_ship FROM n WHERE NOT EXISTS (SELECT 1 FROM lineitem o
        WHERE o.l_shipdate < TIMESTAMP '1995-01-01' AND o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber) GROUP BY l_linenumber""",
    "upsert_touch_vs_insert": """WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents)
        SELECT DISTINCT hash, CASE WHEN hash IN (SELECT hash FROM h WHERE doc_id % 2 = 0) THEN 'touched' ELSE 'inserted' END AS action FROM h WHERE doc_id % 2 = 1""",
    "bucket_overlap_at_cap": f"WITH {_OVERLAP} SELECT key, bucket FROM m WHERE held_before > 0 AND newly_written >= distinct_on_page QUALIFY row_number() OVER (PARTITION BY key ORDER BY first_pos, bucket) = 1",
    "narrowest_margin": f"""WITH {_OVERLAP} SELECT key, bucket, distinct_on_page - newly_written AS margin FROM m WHERE held_before > 0 AND distinct_on_page >= 2
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY distinct_on_page - newly_written, first_pos, bucket) = 1""",
    "burst_rate": f"""WITH {CAPTURES}, r AS (SELECT key, bucket, date_diff('day', day, DATE '2024-01-30') AS age, row_number() OVER (PARTITION BY key, bucket ORDER BY day DESC, event_id) AS k
             FROM c WHERE day > DATE '2024-01-30' - 30),
        p AS (SELECT key, bucket, greatest(count(*) / 30.0, max(CASE WHEN k >= 3 THEN k / CAST(greatest(age, 1) AS DOUBLE) END)) AS rate FROM r GROUP BY ALL)
        SELECT key, round(coalesce(max(rate), 0.0), 9) AS rate FROM (SELECT DISTINCT key FROM c) LEFT JOIN p USING (key) GROUP BY key""",
    "cap_classification": """WITH d AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS pos, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_shipdate AS DATE) AS day FROM lineitem),
        g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 3 THEN 1 ELSE 0 END AS brk FROM d WINDOW w AS (PARTITION BY key ORDER BY pos, cents, day)),
        i AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY pos, cents, day ROWS UNBOUNDED PRECEDING) AS run FROM g),
        r AS (SELECT key, sum(n) AS run_rows FROM (SELECT key, run, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 3) GROUP BY key),
        p AS (SELECT key, max(n) AS price_rows FROM (SELECT key, cents, count(*) AS n FROM d GROUP BY ALL) GROUP BY key),
        y AS (SELECT key, max(n) AS day_rows FROM (SELECT key, day, count(*) AS n FROM d GROUP BY ALL) GROUP BY key),
        t AS (SELECT key, count(*) AS rows FROM d GROUP BY key)
        SELECT key, rows, CAST(coalesce(run_rows, 0) AS BIGINT) AS run_rows, price_rows, day_rows,
               CASE WHEN rows < 30 THEN 'recomposed' WHEN 2 * coalesce(run_rows, 0) >= rows OR (2 * price_rows >= rows AND 2 * day_rows >= rows) THEN 'bulk' ELSE 'organic' END AS cap_class
        FROM t LEFT JOIN r USING (key) JOIN p USING (key) JOIN y USING (key)""",
    "monotonicity_violations": """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(substr(o_orderpriority, 1, 1) AS INT) AS tier, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL),
        p AS (SELECT month, lag(tier) OVER w AS lower_tier, tier AS upper_tier, lag(cents) OVER w AS lower_value, cents AS upper_value FROM m WHERE cents <> 0 WINDOW w AS (PARTITION BY month ORDER BY tier))
        SELECT * FROM p WHERE upper_value < lower_value""",
    "restatement_anomalies": f"""WITH {CAPTURES}, n AS (SELECT key, captured_on, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY key ORDER BY captured_on) AS previous FROM n),
        a AS (SELECT key, captured_on, previous, n, CASE WHEN previous - n >= 2 AND previous - n >= previous * 0.2 THEN 'decrease' WHEN previous >= 10 AND n > previous * 2 THEN 'spike' END AS anomaly FROM p)
        SELECT * FROM a WHERE anomaly IS NOT NULL""",
    "parse_failure_rate": """WITH r AS (SELECT event_type = 'error' AS bad FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
        SELECT count(*) AS samples, count(*) FILTER (WHERE bad) AS failures, round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE, 9) AS share,
               count(*) >= 20 AND count(*) FILTER (WHERE bad) / count(*)::DOUBLE > 0.1 AS spike FROM r""",
    "rolling_brake": """SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-29 12:00:00') AS stops, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-29 12:00:00') >= 10 AS braked
        FROM events WHERE event_type = 'error'""",
    "acceptance_invariants": """SELECT 'orders without customer' AS name, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'nations without region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
        UNION ALL SELECT 'line keys that repeat', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
}
