"""Queries of streams that come in several batches, close behind a watermark and drop what is late; logs that grow.

The oracles say what a batch can still change: a row of batch b is late if it lies behind the
watermark of two batches before, and what the last watermark hasn't passed isn't given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightlens.plans import binary_logs, files, views
from flightlens.plans.catalog import query
from flightlens.session import shared_dir
from flightlens.sources import binary, binary_files
from flightlens.streaming import frames, jobs

_B = "CASE WHEN {late} THEN 3 ELSE least(3, (day({ts}) - 1) // 8) END"


def _late(rows: str, late: str, delay: str, key: str = "") -> str:
    """Rows with their batch, and w2, the watermark that tells which of them are late."""
    return f"""b AS (SELECT *, CAST({_B.format(late=late, ts="ts")} AS INTEGER) AS b FROM {rows}),
wm AS (SELECT k, (SELECT max(ts) FROM b WHERE b.b <= k - 2) - INTERVAL {delay} AS w2 FROM range(4) ks(k)),
final AS (SELECT max(ts) - INTERVAL {delay} AS w FROM b)"""


@query(
    "late_windows",
    f"""WITH {views.TELEMETRY}, {_late("tel", "seq % 89 = 0", "2 DAY")}, k AS (SELECT b.*, date_trunc('day', ts) AS start_ts FROM b JOIN wm ON wm.k = b.b WHERE w2 IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > w2)
SELECT case_id, CAST(start_ts AS TIMESTAMP) AS start_ts, CAST(start_ts + INTERVAL 1 DAY AS TIMESTAMP) AS end_ts, count(*) AS samples, max(altitude_m) AS max_altitude_m FROM k WHERE start_ts + INTERVAL 1 DAY <= (SELECT w FROM final) GROUP BY case_id, start_ts""",
)
def late_windows(spark, sf_dir):
    return jobs.run_late_windows(spark, sf_dir, "2 days").drop("avg_speed_mps")


@query(
    "late_flights",
    f"""WITH {views.TELEMETRY}, {_late("tel", "seq % 89 = 0 AND day(ts) < 9", "2 DAY")}, r AS (SELECT b.* FROM b JOIN wm ON wm.k = b.b WHERE w2 IS NULL OR ts + INTERVAL 30 MINUTE > w2),
g AS (SELECT case_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY case_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT case_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS points FROM s GROUP BY case_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT w FROM final)""",
)
def late_flights(spark, sf_dir):
    return jobs.run_late_flights(spark, sf_dir, "30 minutes", "2 days")


@query(
    "late_media",
    f"""WITH {views.MEDIA}, mb AS (SELECT *, CAST({_B.format(late="media_id % 7 = 0", ts="ts")} AS INTEGER) AS b FROM med), tb AS (SELECT *, CAST({_B.format(late="seq % 11 = 0", ts="ts")} AS INTEGER) AS b FROM trk),
wm AS (SELECT k, least((SELECT max(ts) FROM mb WHERE b <= k - 2), (SELECT max(ts) FROM tb WHERE b <= k - 2)) - INTERVAL 2 DAY AS w2 FROM range(4) ks(k)),
m AS (SELECT mb.* FROM mb JOIN wm ON wm.k = mb.b WHERE w2 IS NULL OR ts > w2), t AS (SELECT tb.* FROM tb JOIN wm ON wm.k = tb.b WHERE w2 IS NULL OR ts > w2)
SELECT m.case_id, m.media_id, t.seq FROM m JOIN t ON t.case_id = m.case_id AND epoch_us(t.ts) - epoch_us(m.ts) BETWEEN
  CASE WHEN coalesce(duration_sec, 0) > 0 THEN -15000000 ELSE -600000000 END AND CASE WHEN coalesce(duration_sec, 0) > 0 THEN 45000000 ELSE 600000000 END""",
)
def late_media(spark, sf_dir):
    return jobs.run_late_media(spark, sf_dir, 600, "2 days").select("case_id", "media_id", "seq")


@query(
    "late_dedupe",
    """WITH f AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha256, doc_id % 6 AS day FROM documents), one AS (SELECT sha256, min(day) AS day FROM f GROUP BY sha256),
two AS (SELECT f.sha256, min(f.day) AS day FROM f JOIN one ON one.sha256 = f.sha256 AND f.day >= one.day + 3 GROUP BY f.sha256)
SELECT sha256, CAST(day AS INTEGER) AS day FROM one UNION ALL SELECT sha256, CAST(day AS INTEGER) FROM two""",
)
def late_dedupe(spark, sf_dir):
    return jobs.run_late_dedupe(spark, sf_dir).select("sha256", "day")


@query("growing_radio_logs", binary_logs._TEL + " SELECT case_id, 33 AS msg_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS checksum FROM e GROUP BY 1 UNION ALL SELECT case_id, 24, count(*), CAST(sum(id % 12) AS BIGINT) FROM e WHERE id % 3 = 0 GROUP BY 1")
def growing_radio_logs(spark, sf_dir):
    """Logs that grow to a third, two thirds and the whole of their rows while a stream reads them."""
    base = f"{shared_dir(spark)}/growing/{uuid.uuid4().hex}"
    rows = binary_logs.pieces(spark, sf_dir, "flight.tlog", binary_logs._numbered_radio_rows)
    places = rows.groupBy("file").agg(F.max("ord").alias("n"))
    stream = frames.stream_radio_frames(spark, f"{base}/logs", binary_logs.RANGE)
    writer = stream.select("file", "off", "msg_id", F.element_at("numbers", "boot_ms").alias("boot_ms"), F.element_at("numbers", "sats").alias("sats")).writeStream
    running = None
    for third in (1, 2, 3):
        part = rows.join(places, "file").filter(F.col("ord") * 3 <= F.col("n") * third)
        binary_files.write_files(part.select("file", "ord", "data"), f"{base}/logs")
        if running is None:
            running = writer.format("parquet").option("checkpointLocation", f"{base}/state").start(f"{base}/out")
        running.processAllAvailable()
    running.stop()
    found = files.of_case(spark.read.parquet(f"{base}/out")).filter(F.col("msg_id").isin(binary.POSITION, binary.RAW_GPS))
    return found.groupBy("case_id", "msg_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("boot_ms", "sats")).cast("long").alias("checksum"))
