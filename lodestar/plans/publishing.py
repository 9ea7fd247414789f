"""Publishing, the stored queue and the sinks of the feed, bound to the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import evaluate, gates
from ..sources import published, queue
from ..sources.catalogue import _BODY, _check, products, sql, table
from ..sources.shared import shared_dir
from ..streaming import sinks
from .judging import _EVALUATION, _LIFECYCLE_CTES, _judged, answer_evaluation


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def published_catalogue(spark, sf_dir):
    """The catalogue by shelf as it is published after a second candidate that lost a third of its rows was refused, and the gates that refused it."""
    path, rows = _folder(spark, "catalogue"), products(spark, sf_dir).select("pid", "code", "category", "price")
    first, _ = published.publish(rows, path)
    floor = published.read(spark, path).agg(F.count(F.lit(1)).alias("before"))

    def judge(candidate):
        figures = candidate.agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced")).crossJoin(floor)  # one row beside one row
        return gates.as_rows(figures, [gates.gate("rows", F.col("n") >= F.col("before") * 0.9, F.col("n")), gates.gate("priced", F.col("priced") == F.col("n"), F.col("priced"))])

    second, judged = published.publish(rows.where("pid % 3 <> 0"), path, judge)
    failed = ",".join(sorted(r["gate"] for r in judged if not r["ok"]))
    shown = published.read(spark, path).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"))
    return shown.select("*", F.lit(failed).alias("refused_by"), F.lit(second is None and first == 0).alias("unmoved"))


_CATALOGUE = sql("product", "SELECT category, count(*) AS n, sum(round(price * 100)::BIGINT)::BIGINT AS cents, 'rows' AS refused_by, true AS unmoved FROM product GROUP BY 1")


def evaluation_gates(spark, sf_dir):
    """Whether the answers may be published: none of another family on any shelf, no lie."""
    return evaluate.answer_gates(answer_evaluation(spark, sf_dir))


_GATES = f"""SELECT unnest(['sets', 'wrong_family', 'lies']) AS gate, unnest([sets > 0, wrong = 0, lies = 0]) AS ok, unnest([sets, wrong, lies])::DOUBLE AS detail
    FROM (SELECT count(*) AS sets, max(n_wrong) AS wrong, sum(n_lie) AS lies FROM ({_EVALUATION}))"""


def queue_moves(spark, sf_dir):
    """The stored queue of proposals after two batches of decisions, the first of them moved twice."""
    path = _folder(spark, "queue")
    queue.append(_judged(spark, sf_dir).where("outcome = 'queued'").drop("outcome", "alt_key"), path)
    waits = queue.waiting(spark, path)
    first = waits.where("id % 3 <> 0 AND id % 15 <> 1").selectExpr("id", "at", "IF(id % 5 = 0, 'rejected', 'accepted') AS verdict")
    second = waits.where("id % 15 = 1").selectExpr("id", "at", "'accepted' AS verdict").unionByName(waits.where("id % 15 = 1").selectExpr("id", "at + INTERVAL 1 DAY AS at", "'rejected' AS verdict"))
    # decisions are written before the queue under them moves
    given = [_folder(spark, "decisions") for _ in range(2)]
    for decisions, at in zip((first, second), given, strict=True):
        published.publish(decisions, at)
    for batch, at in ((1, given[0]), (1, given[0]), (2, given[1])):
        queue.move(published.read(spark, at), path, batch)
    return queue.decided(spark, path).select("id", "status", "batch").unionByName(queue.waiting(spark, path).select("id", F.lit("pending").alias("status"), F.lit(None).cast("bigint").alias("batch")))


_MOVES = f"WITH RECURSIVE {_LIFECYCLE_CTES} SELECT id, status, CASE WHEN id % 15 = 1 THEN 2 WHEN id % 3 <> 0 THEN 1 END::BIGINT AS batch FROM d"


def _run(spark, sf_dir, columns, sink):
    """The events' files as a stream into ``sink``, a few files a batch, until the input is used up."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 256).parquet(f"{sf_dir}/events.parquet*")
    shown = source.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*columns)
    shown.writeStream.foreachBatch(sink).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()


def feed_latest_stream(spark, sf_dir):
    """The newest five hundred events, kept by a stream."""
    sink = sinks.newest(_folder(spark, "latest"), "ts", "event_id")
    _run(spark, sf_dir, ["event_id", "ts", "user_id", "event_type"], sink)
    return sink.read(spark).select("event_id", "user_id", "event_type")


def history_stream(spark, sf_dir):
    """Each user's types as a stream keeps them, of each user the two met last."""
    sink = sinks.history(_folder(spark, "history"), "user_id", "event_type", "ts")
    _run(spark, sf_dir, ["user_id", "event_type", "ts"], sink)
    return sinks.capped(sink.read(spark), "user_id", "event_type", 2).select("user_id", "event_type", "times", F.to_date("first_at").alias("first_day"), F.to_date("last_at").alias("last_day"))


_HISTORY = """SELECT user_id, event_type, times, first_day, last_day FROM (SELECT user_id, event_type, count(*) AS times, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day,
    row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events GROUP BY 1, 2) WHERE place <= 2"""


def feed_enriched_stream(spark, sf_dir):
    """Feed items with what the pool knows of their code: every batch reads the pool that is published then."""
    pool, out = _folder(spark, "pool"), _folder(spark, "enriched")
    shown = products(spark, sf_dir).where("pid % 4 <> 0").selectExpr("code", "name", "brand", "IF(pid % 3 = 0, NULL, concat(pid, '.png')) AS image", "cast(size AS string) AS quantity")
    published.publish(shown, pool)
    number = F.expr("event_id % 1500 + 1")
    body = F.concat(F.lpad(((number * 7919 + 381) % 1000).cast("string"), 3, "0"), F.lpad(number.cast("string"), 9, "0"))
    write = sinks.enriching(out, pool)
    columns = ["event_id", "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('seen ', event_id) END AS name", "IF(event_id % 2 = 0, 'said', NULL) AS brand"]
    _run(spark, sf_dir, columns, lambda batch, n: write(batch.withColumn("code", codes.with_check_digit(body)), n))
    return published.read(spark, out, published.versions(spark, out)).select("event_id", "code", "name", "brand", "image", "quantity")


_ENRICHED = sql("product", """+i AS (SELECT event_id, event_id % 1500 + 1 AS pid, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'seen ' || event_id END AS name, CASE WHEN event_id % 2 = 0 THEN 'said' END AS brand FROM events),
    c AS (SELECT event_id % 1500 + 1 AS p_partkey FROM events GROUP BY 1),
    k AS (SELECT p_partkey AS pid, BODY || CHECK AS code FROM c)
    SELECT event_id, k.code, CASE WHEN p.pid IS NULL THEN i.name ELSE coalesce(nullif(i.name, ''), p.name) END AS name, CASE WHEN p.pid IS NULL THEN i.brand ELSE coalesce(nullif(i.brand, ''), p.brand) END AS brand,
        CASE WHEN p.pid % 3 <> 0 THEN p.pid || '.png' END AS image, p.size::VARCHAR AS quantity
    FROM i JOIN k USING (pid) LEFT JOIN (SELECT * FROM product WHERE pid % 4 <> 0) p ON p.code = k.code""").replace("BODY", _BODY).replace("CHECK", _check(_BODY))


QUERIES = {f.__name__: f for f in (published_catalogue, evaluation_gates, queue_moves, feed_latest_stream, history_stream, feed_enriched_stream)}
_LATEST = "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"
ORACLES = dict(zip(QUERIES, (_CATALOGUE, _GATES, _MOVES, _LATEST, _HISTORY, _ENRICHED), strict=True))
