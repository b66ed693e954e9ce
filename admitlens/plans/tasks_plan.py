"""Registered queries: the task stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitlens.operators import incremental as I
from admitlens.plans.applicants_view import applicant_records, applicants_view, with_av
from admitlens.plans.listing import BASE_URL, render_listing, stored_listing
from admitlens.plans.questions_plan import SQL_LONG
from admitlens.plans.registry import register
from admitlens.session import read_table, scratch_path
from admitlens.sources.tables import ApplicantsTable
from admitlens.streaming import handlers as H
from admitlens.streaming import messages as M
from admitlens.streaming import tasks as T


# ----------------------------------------------------------------- T1
_ISO = ("CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END")


@register("encode_tasks", f"""
SELECT event_id, CAST(json_object('kind', event_type, 'ts', {_ISO}, 'payload', json(props))
  AS VARCHAR) AS value FROM events""")
def q_encode_tasks(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type", "ts", "props")
    return ev.select("event_id", T.task_message(F.col("event_type"), F.col("ts"),
                                                F.col("props")).alias("value"))


# ----------------------------------------------------------------- T2 .. T4
def _message_files(spark, sf) -> str:
    """Events as task message files: every 17th line broken, every 23rd a
    JSON array (valid JSON, not an object)."""
    ev = read_table(spark, sf, "events")
    k = F.col("event_id")
    good = T.task_message(F.col("event_type"), F.col("ts"),
                          F.to_json(F.struct(k.alias("event_id"))))
    line = (F.when(k % 17 == 0, F.concat(F.lit('{"kind": "'), F.col("event_type"),
                                         F.lit('", broken')))
            .when(k % 23 == 0, F.lit("[1, 2]"))
            .otherwise(good))
    path = scratch_path(spark, "tasks-in")
    ev.select(line.alias("value")).repartition(4).write.mode("overwrite").text(path)
    return path


_BAD = "(event_id % 17 = 0 OR event_id % 23 = 0)"


@register("decode_tasks", f"""
SELECT CASE WHEN {_BAD} THEN NULL ELSE event_id END AS event_id,
  CASE WHEN {_BAD} THEN 'malformed' ELSE 'ok' END AS status,
  CASE WHEN {_BAD} THEN NULL ELSE event_type END AS kind FROM events""")
def q_decode_tasks(spark, sf):
    src = _message_files(spark, sf)
    out = scratch_path(spark, "decoded")

    def sink(batch, batch_id):
        T.decode_tasks(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (T.read_task_stream(spark, src, None).writeStream.foreachBatch(sink)
         .option("checkpointLocation", scratch_path(spark, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    d = spark.read.parquet(out)
    return d.select(F.try_variant_get(F.try_parse_json("payload"), "$.event_id", "bigint")
                    .alias("event_id"), "status", "kind")


_ROUTE_SQL = f"""
SELECT CASE WHEN {_BAD} THEN 'malformed' WHEN event_type IN ('click', 'view', 'error')
  THEN event_type ELSE 'unknown_kind' END AS route, COUNT(*) AS n FROM events GROUP BY 1"""


@register("route_tasks", _ROUTE_SQL)
def q_route_tasks(spark, sf):
    src = _message_files(spark, sf)
    decoded = T.decode_tasks(spark.read.text(src))
    return T.route_tasks(decoded, ["click", "view", "error"]).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"))


def _message_log(spark, sf, pace_kinds: bool = True) -> str:
    """Events in order as a message log; their kinds come in stretches of 500 ids."""
    ev = read_table(spark, sf, "events").select("event_id")
    k = F.col("event_id")
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "view", "purchase")])
    kind = F.get(kinds, (F.floor(k / 500) % 4).cast("int")) if pace_kinds else F.lit("click")
    good = F.to_json(F.struct(kind.alias("kind"), F.struct(k.alias("event_id")).alias("payload")))
    line = (F.when(k % 17 == 0, F.lit('{"kind": "click", broken')).when(k % 23 == 0, F.lit("[1, 2]")).otherwise(good))
    path = scratch_path(spark, "message-log")
    M.append_messages(ev.select(k, line.alias("value")), path, ["event_id"])
    return path


def _sometimes_failing(messages, _batch_id):
    k = F.try_variant_get(F.try_parse_json("payload"), "$.event_id", "bigint")
    if not messages.where(k % 49999 == 750).isEmpty():
        raise RuntimeError("handler failed on purpose")


_MIXED = "floor(event_id / 500) % 4"


@register("dead_letters", f"""
SELECT CASE WHEN {_BAD} THEN 'malformed' WHEN {_MIXED} = 1 THEN 'handler_failed'
  ELSE 'unknown_kind' END AS reason, COUNT(*) AS n
FROM events WHERE {_BAD} OR {_MIXED} = 3 OR ({_MIXED} = 1 AND event_id % 49999 = 750) GROUP BY 1""")
def q_dead_letters(spark, sf):
    """Runs of messages: of a run that fails only the messages that fail alone go."""
    dead = scratch_path(spark, "dead")
    handlers = {"click": lambda df, b: None, "view": lambda df, b: None, "error": _sometimes_failing}
    T.consume_log(spark, _message_log(spark, sf), handlers, dead, scratch_path(spark, "ckpt"), pace=20_000)
    return spark.read.parquet(dead).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- T5 / T6 / T7
def _one_message_per_region(spark, sf, kind: str) -> str:
    reg = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    msgs = reg.select(F.to_json(F.struct(F.lit(kind).alias("kind"),
                                         F.lit("2025-01-01T00:00:00").alias("ts"),
                                         F.struct(F.col("r_name").alias("region"))
                                         .alias("payload"))).alias("value"))
    path = scratch_path(spark, "tasks-in")
    msgs.repartition(5).write.mode("overwrite").text(path)
    return path


@register("handle_ingest", with_av("""
, b AS (SELECT p_id, url, (p_id % 5 = 0 OR p_id >= (SELECT floor(max(p_id) * 3 / 4) FROM av_rec))
  AS is_known, CAST(floor(p_id / 80) AS BIGINT) AS page_id FROM av_rec),
nov AS (SELECT page_id, COUNT(*) FILTER (WHERE NOT is_known) AS new, COUNT(*) AS total
  FROM b GROUP BY page_id),
stop AS (SELECT min(page_id) FILTER (WHERE total > 0 AND new = 0) AS s FROM nov),
tab AS (SELECT p_id, url FROM b WHERE is_known),
fresh AS (SELECT url, ROW_NUMBER() OVER (ORDER BY page_id, p_id) AS rn FROM b
  WHERE NOT is_known AND ((SELECT s FROM stop) IS NULL OR page_id < (SELECT s FROM stop)))
SELECT p_id, url FROM tab
UNION ALL
SELECT CAST((SELECT greatest(COUNT(*), max(p_id)) FROM tab) + rn AS BIGINT), url FROM fresh"""))
def q_handle_ingest(spark, sf):
    """Scrape tasks drive extract -> new -> enrich -> load; the same task
    files are consumed twice (a replay with a fresh checkpoint): the table
    ends up the same."""
    recs = applicant_records(spark, sf)
    t = recs.agg(F.floor(F.max("p_id") * 3 / 4).alias("t")).first()["t"]
    known = recs.filter((F.col("p_id") % 5 == 0) | (F.col("p_id") >= F.lit(t)))
    table = ApplicantsTable(spark, scratch_path(spark, "applicants"))
    table.append(known.select(*[c for c in applicants_view(spark, sf).columns]))
    pages = stored_listing(render_listing(recs))
    handler = H.ingest_handler(table, lambda: pages, BASE_URL)
    src = _one_message_per_region(spark, sf, "scrape_new_data")
    for _ in range(2):
        T.consume(spark, src, {"scrape_new_data": handler}, scratch_path(spark, "dead"),
                  scratch_path(spark, "ckpt"), max_files_per_trigger=None)
    return table.scan().select("p_id", "url")


@register("handle_refresh", with_av(SQL_LONG.replace("WITH av_rec AS (SELECT 1), ", ", ")
                                    + "\nSELECT * FROM answers"))
def q_handle_refresh(spark, sf):
    table = ApplicantsTable(spark, scratch_path(spark, "applicants"))
    table.append(applicants_view(spark, sf))
    report = scratch_path(spark, "report")
    src = _one_message_per_region(spark, sf, "recompute_analytics")
    T.consume(spark, src, {"recompute_analytics": H.refresh_handler(table, report)},
              scratch_path(spark, "dead"), scratch_path(spark, "ckpt"), max_files_per_trigger=None)
    return spark.read.parquet(report).drop("batch_id")


@register("paced_consume", """
SELECT CAST(floor((rn - 1) / 5000) AS BIGINT) AS batch_id, COUNT(*) AS num_input_rows
FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1""")
def q_paced_consume(spark, sf):
    """A message per event, 5000 messages a batch, however they lie in files: the
    consumer's own progress table lists every batch."""
    progress = scratch_path(spark, "progress")
    T.consume_log(spark, _message_log(spark, sf, False), {"click": lambda df, b: None}, scratch_path(spark, "dead"),
                  scratch_path(spark, "ckpt"), pace=5000, progress_path=progress)
    return T.read_progress(spark, progress)
