"""The event feed, bound to ``events`` and ``conversations``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import day_seed
from ..operators import events as ev
from ..sources.catalogue import table
from ..streaming import feed as stream
from ..streaming.replay import durable


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def feed_rate_limit(spark, sf_dir):
    """Users by how many of their events pass one a minute and three a day."""
    rows = ev.rate_limited(_events(spark, sf_dir), "user_id", "ts", ["event_id"], 1, 3)
    return rows.groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))


_RATE = """SELECT user_id, count(*) FILTER (WHERE m <= 1 AND d <= 3) AS n_allowed, count(*) FILTER (WHERE NOT (m <= 1 AND d <= 3)) AS n_refused FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS d FROM events) GROUP BY 1"""


def feed_dedupe_anchored(spark, sf_dir):
    """Events that open a day-long window of their user and type."""
    return ev.anchored_dedupe(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 86_400)


_ANCHORED = """WITH RECURSIVE r AS (
    SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
    UNION ALL SELECT r.user_id, r.event_type, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts >= r.ts + INTERVAL 86400 SECOND) FROM r WHERE r.ts IS NOT NULL)
    SELECT e.user_id, e.event_type, e.event_id FROM r JOIN events e USING (user_id, event_type, ts)"""


def feed_latest(spark, sf_dir):
    """The newest five hundred events."""
    rows = _events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return rows.select("event_id", "user_id", "event_type")


def history_state(spark, sf_dir):
    """Each user's types: times seen, first and last."""
    rows = ev.state(_events(spark, sf_dir), ["user_id", "event_type"], "ts")
    return rows.select("user_id", "event_type", "times", F.to_date("first_at").alias("first_day"), F.to_date("last_at").alias("last_day"))


_STATE = "SELECT user_id, event_type, count(*) AS times, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events GROUP BY 1, 2"


def history_totals(spark, sf_dir):
    """Users' totals over their types, and the type they return to most."""
    rows = ev.state(_events(spark, sf_dir), ["user_id", "event_type"], "ts")
    return rows.groupBy("user_id").agg(F.sum("times").alias("total"), F.min_by("event_type", F.struct(-F.col("times"), "event_type")).alias("most"), F.max("times").alias("most_times"))


_TOTALS = f"SELECT user_id, sum(times)::BIGINT AS total, arg_min(event_type, (-times, event_type)) AS most, max(times) AS most_times FROM ({_STATE}) GROUP BY 1"


def throttle_sliding(spark, sf_dir):
    """Events that are the fourth or later of their user in a sliding six hours."""
    return ev.throttled(_events(spark, sf_dir), "user_id", "ts", 21_600, 3).where("throttled").select("event_id", "user_id", "recent")


_THROTTLE = "SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 3"


def _entries(spark, sf_dir):
    """Feed entries made of events: some codes are short, some owners malformed, some notes are links or places."""
    return _events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.expr("substr('4006381333931', 1, cast(13 - (event_id % 9) AS int))").alias("code"),
        F.expr("IF(user_id % 10 = 0, 'Bad Owner', concat('user', user_id))").alias("owner"),
        F.expr("CASE event_id % 6 WHEN 0 THEN 'see www.shop.example' WHEN 1 THEN 'at 42.6629, 21.1655' ELSE event_type END").alias("note"),
    )


def feed_validation(spark, sf_dir):
    """Entries by their first fault."""
    fault = ev.entry_fault(F.col("code"), F.col("owner"), F.col("note"))
    return _entries(spark, sf_dir).groupBy(F.coalesce(fault, F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


_VALIDATION = """SELECT CASE WHEN event_id % 9 > 5 THEN 'code' WHEN user_id % 10 = 0 THEN 'owner' WHEN event_id % 6 < 2 THEN 'note' ELSE 'none' END AS fault, count(*) AS n, min(event_id) AS "first" FROM events GROUP BY 1"""


def feed_public(spark, sf_dir):
    """What the public sees of accepted entries: a monthly pseudonym instead of the owner, and a day seed."""
    ok = _entries(spark, sf_dir).where(ev.entry_fault(F.col("code"), F.col("owner"), F.col("note")).isNull())
    return ok.select("event_id", "code", ev.pseudonym(F.col("owner"), F.date_format("ts", "yyyy-MM")).alias("who"), day_seed(F.col("ts")).alias("day"))


_PUBLIC = """SELECT event_id, substr('4006381333931', 1, (13 - event_id % 9)::INT) AS code, substr(sha256('user' || user_id || ':' || strftime(ts, '%Y-%m')), 1, 6) AS who, epoch_ms(ts) // 86400000 AS day
    FROM events WHERE event_id % 9 <= 5 AND user_id % 10 <> 0 AND event_id % 6 >= 2"""


def event_props(spark, sf_dir):
    """Figures inside the events' JSON, by type."""
    k = F.from_json("props", "k int")["k"]
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


_PROPS = "SELECT event_type, count((props->>'k')::INT) AS n, sum((props->>'k')::INT)::BIGINT AS total, max((props->>'k')::INT) AS most FROM events GROUP BY 1"


def turn_guard(spark, sf_dir):
    """Conversation turns with numbers of two or more digits that the turn before did not have."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{2,})"))).alias("numbers"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("numbers").alias("said"))
    stray = F.array_except("numbers", F.coalesce("said", F.array().cast("array<string>")))
    rows = turns.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.sort_array(stray).alias("stray"))
    return rows.select("conv_id", "turn", F.size("stray").cast("bigint").alias("n_stray"), F.array_join("stray", ",").alias("stray"))


_GUARD = """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '([0-9]{2,})')) AS numbers FROM conversations),
    s AS (SELECT t.conv_id, t.turn, list_sort(list_filter(t.numbers, lambda x: NOT list_contains(coalesce(b.numbers, []), x))) AS stray FROM t LEFT JOIN t b ON b.conv_id = t.conv_id AND b.turn + 1 = t.turn)
    SELECT conv_id, turn, len(stray) AS n_stray, array_to_string(stray, ',') AS stray FROM s"""


#: How late an event may be, and how long after the last one a run closes the stream: longer than any window in use.
LATE, CLOSE = "1 hour", "10 days"


def run_stream(spark, sf_dir, rule):
    """What ``rule`` makes of the events' file read as a stream, with a last mark behind it that closes the stream."""
    from ..sources.shared import shared_dir

    durable(spark)
    run = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    columns = ["event_id", "ts", "user_id", "event_type"]
    rows = table(spark, sf_dir, "events").select(*columns)
    end = rows.agg((F.max(F.col("ts").cast("timestamp")) + F.expr(f"INTERVAL {LATE}") + F.expr(f"INTERVAL {CLOSE}")).alias("ts"))
    end.select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type")).write.parquet(f"{run}/end")
    read = lambda path, schema: spark.readStream.schema(schema).parquet(path).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    source = read(f"{sf_dir}/events.parquet*", rows.schema).union(read(f"{run}/end", spark.read.parquet(f"{run}/end").schema))
    # the mark moves the watermark and is left out after that
    marked = source.withWatermark("ts", LATE).where((F.col("event_id") >= 0) | F.col("ts").isNull())
    query = rule(marked).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{run}/out")


def feed_dedupe_stream(spark, sf_dir):
    """The anchored dedupe as a stream over the events' file, run until the input is used up."""
    return run_stream(spark, sf_dir, lambda rows: stream.anchored_dedupe_stream(rows, 86_400)).select("user_id", "event_type", "event_id")


def feed_rate_limit_stream(spark, sf_dir):
    """The feed's limits as a stream: users by how many of their events pass."""
    rows = run_stream(spark, sf_dir, lambda rows: stream.rate_limited_stream(rows, "user_id", 1, 3))
    return rows.groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))


def throttle_sliding_stream(spark, sf_dir):
    """The sliding throttle as a stream: the events that are too many."""
    return run_stream(spark, sf_dir, lambda rows: stream.throttled_stream(rows, "user_id", 21_600, 3)).where("throttled").select("event_id", "user_id", "recent")


def limited_dedupe_stream(spark, sf_dir):
    """An intake in one stream: events within their user's limits that open a window of their user."""

    def both(rows):
        kept = stream.rate_limited_stream(rows, "user_id", 2, 4)
        return stream.replayed(kept.where("allowed"), ["user_id"], "ts", "event_id", stream.Anchored(21_600))

    return run_stream(spark, sf_dir, both).select("user_id", "event_id")


_BOTH = """WITH RECURSIVE a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS d FROM events) WHERE m <= 2 AND d <= 4),
    r AS (SELECT user_id, min(ts) AS ts FROM a GROUP BY 1
    UNION ALL SELECT r.user_id, (SELECT min(a.ts) FROM a WHERE a.user_id = r.user_id AND a.ts >= r.ts + INTERVAL 21600 SECOND) FROM r WHERE r.ts IS NOT NULL)
    SELECT a.user_id, a.event_id FROM r JOIN a USING (user_id, ts)"""


def feed_minutes(spark, sf_dir):
    """Events of each type and minute, by the function that the stream uses."""
    return stream.minute_counts_stream(_events(spark, sf_dir))


_MINUTES = "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def feed_ingest(spark, sf_dir):
    """What becomes of every entry: its first fault, over the rate, inside the window of an earlier one, or kept among the newest."""
    rows = _entries(spark, sf_dir).withColumn("fault", ev.entry_fault(F.col("code"), F.col("owner"), F.col("note")))
    valid = ev.rate_limited(rows.where("fault IS NULL"), "owner", "ts", ["event_id"], 1, 3)
    first = ev.anchored_dedupe(valid.where("allowed"), ["owner", "code"], "ts", "event_id", 86_400 * 3).select("event_id")
    kept = valid.select("event_id", "ts").join(first, "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", F.lit(True).alias("kept"))
    status = valid.select("event_id", "allowed").join(first.withColumn("first", F.lit(True)), "event_id", "left").join(kept, "event_id", "left")
    outcome = F.when(F.col("fault").isNotNull(), F.col("fault")).when(~F.col("allowed"), "rate").when(F.col("first").isNull(), "window").when(F.col("kept").isNull(), "old").otherwise("kept")
    return rows.join(status, "event_id", "left").select("event_id", outcome.alias("outcome"))


_INGEST = """WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_id % 9 AS code, CASE WHEN event_id % 9 > 5 THEN 'code' WHEN user_id % 10 = 0 THEN 'owner' WHEN event_id % 6 < 2 THEN 'note' END AS fault FROM events),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AND row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS allowed FROM e WHERE fault IS NULL),
    a AS (SELECT * FROM v WHERE allowed),
    r AS (SELECT user_id, code, min(ts) AS ts FROM a GROUP BY 1, 2 UNION ALL SELECT r.user_id, r.code, (SELECT min(a.ts) FROM a WHERE a.user_id = r.user_id AND a.code = r.code AND a.ts >= r.ts + INTERVAL 259200 SECOND) FROM r WHERE r.ts IS NOT NULL),
    f AS (SELECT a.event_id, row_number() OVER (ORDER BY a.ts DESC, a.event_id DESC) AS place FROM r JOIN a USING (user_id, code, ts))
    SELECT e.event_id, coalesce(e.fault, CASE WHEN NOT v.allowed THEN 'rate' WHEN f.event_id IS NULL THEN 'window' WHEN place > 500 THEN 'old' ELSE 'kept' END) AS outcome FROM e LEFT JOIN v USING (event_id) LEFT JOIN f ON f.event_id = e.event_id"""


QUERIES = {f.__name__: f for f in (feed_rate_limit, feed_dedupe_anchored, feed_latest, history_state, history_totals, throttle_sliding, feed_validation, feed_public, event_props, turn_guard, feed_dedupe_stream, feed_rate_limit_stream, throttle_sliding_stream, limited_dedupe_stream, feed_minutes, feed_ingest)}
ORACLES = dict(zip(QUERIES, (_RATE, _ANCHORED, "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500", _STATE, _TOTALS, _THROTTLE, _VALIDATION, _PUBLIC, _PROPS, _GUARD, _ANCHORED, _RATE, _THROTTLE, _BOTH, _MINUTES, _INGEST), strict=True))
