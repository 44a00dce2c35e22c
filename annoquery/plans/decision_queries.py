"""Registered queries of decisions on a worklist, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import table
from ..streaming import decisions
from .queries import query

_EVENTS = """WITH w AS (SELECT DISTINCT 'u' || user_id AS image_path, sha256('u' || user_id) AS sha FROM events WHERE user_id % 10 <> 9),
    e AS (SELECT 'u' || user_id AS image_path, event_id, ts, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE sha256('u' || user_id) END AS given,
      CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'archived' ELSE 'eligible' END AS status, 'r' || event_id % 4 AS by, event_id % 4 AS k, event_id % 3 AS z, event_id % 5 AS reason FROM events),
    f AS (SELECT e.*, sha, CASE WHEN sha IS NULL THEN 'unknown_image' WHEN given <> sha THEN 'identity' WHEN status = 'archived' THEN 'status' WHEN status = 'pending' THEN NULL
      WHEN k = 0 THEN 'reviewer' WHEN status = 'eligible' AND z = 0 THEN 'no_region' WHEN status = 'eligible' AND reason = 0 THEN 'reason_given' WHEN status = 'eligible' AND k > z THEN 'weak_over_region'
      WHEN status = 'rejected' AND reason <> 0 THEN 'no_reason' WHEN status = 'rejected' AND z <> 0 THEN 'counts_kept' WHEN status = 'rejected' THEN 'counts_kept' END AS fault FROM e LEFT JOIN w USING (image_path)),
    o AS (SELECT *, CASE WHEN sha IS NOT NULL THEN coalesce(last_value(CASE WHEN fault IS NULL THEN status END IGNORE NULLS) OVER (PARTITION BY image_path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'pending') END AS before FROM f),
    v_out AS (SELECT image_path, event_id, fault, before, CASE WHEN fault IS NULL THEN status ELSE before END AS after FROM o)"""


def worklist_and_decisions(spark, sf_dir):
    """Users as images, nine in ten of them in the worklist, and their events as decisions of all kinds."""
    events = table(spark, sf_dir, "events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    worklist = events.where("user_id % 10 <> 9").select(path.alias("image_path")).distinct().withColumn("image_sha256", F.sha2("image_path", 256))
    return worklist, decisions_of(events)


def decisions_of(events):
    path, i = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id")
    kind = F.col("event_type")
    counts = lambda name, n: F.when(n == 0, F.create_map().cast("map<string,int>")).otherwise(F.create_map(F.lit(name), n.cast("int")))
    status = F.when(kind == "view", "pending").when(kind == "error", "rejected").when(kind == "signup", "archived").otherwise("eligible")
    return events.select(
        path.alias("image_path"), i.alias("event_id"), "ts", F.when(i % 13 == 0, "x").otherwise(F.sha2(path, 256)).alias("image_sha256"), status.alias("status"), counts("pocket", i % 3).alias("regions"),
        counts("pocket", i % 4).alias("weak"), F.when(i % 5 == 0, "blurred").alias("reason"), F.when(i % 4 > 0, F.concat(F.lit("r"), (i % 4).cast("string"))).alias("screened_by"), F.lit(None).cast("string").alias("notes"),
    )


@query(_EVENTS + " SELECT * FROM v_out")
def decision_outcomes(spark, sf_dir):
    return decisions.outcomes(*worklist_and_decisions(spark, sf_dir)).drop("ts")


@query(_EVENTS + ", n AS (SELECT image_path, coalesce((SELECT arg_max(after, event_id) FROM v_out o WHERE o.image_path = w.image_path AND after IS NOT NULL), 'pending') AS status FROM w) SELECT status, count(*) AS n FROM n GROUP BY 1")
def screening_progress(spark, sf_dir):
    worklist, made = worklist_and_decisions(spark, sf_dir)
    return decisions.progress(worklist, decisions.outcomes(worklist, made))
