"""Source health, run status and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.operators import health as H
from noticegrid.operators import profile as P
from noticegrid.plans.registry import query
from noticegrid.plans.views import DOCUMENT_NOTICES, HEALTH, NOTICES, with_views
from noticegrid.sources import tables as T


def events_health(spark, sf_dir):
    return H.source_health(T.health_from_events(spark, sf_dir))


@query("source_health", with_views(HEALTH, body="""
SELECT key, status, reason, scanned, CASE WHEN status = 'ok' THEN n ELSE 0 END AS count,
       CASE WHEN status = 'ok' AND scanned <> n THEN scanned - n END AS not_relevant FROM health"""))
def source_health(spark, sf_dir):
    return events_health(spark, sf_dir).orderBy("rank").select(
        "key", "status", "reason", "scanned", "count", "not_relevant"
    )


@query("source_health_layers", with_views(NOTICES, body="""
SELECT portal AS key, count(*) AS scanned, count(*) FILTER (WHERE drop_reason IS NULL) AS count,
       arg_min(notice_type, id) FILTER (WHERE drop_reason IS NULL) AS layer FROM reasoned GROUP BY portal"""))
def source_health_layers(spark, sf_dir):
    from noticegrid.plans.notices import POLICY, RUN
    from noticegrid.operators import filters

    judged = filters.judge(T.notices_from_orders(spark, sf_dir), POLICY, RUN)
    outcomes = judged.groupBy(F.col("portal").alias("key")).agg(
        F.count("*").alias("scanned"), F.lit(None).cast("string").alias("reason")
    )
    kept = filters.survivors(judged).withColumn("layer", F.col("notice_type"))
    return H.source_health(outcomes, kept).select("key", "scanned", "count", "layer")


_STATUS = """
, t AS (SELECT count(*) FILTER (WHERE status NOT IN ('unconfigured', 'no listing')) AS total,
               count(*) FILTER (WHERE status = 'unavailable') AS broken,
               (SELECT count(*) FROM events WHERE event_type = 'purchase') AS reported FROM health)
SELECT total, broken, total - broken AS ok, reported,
  CASE WHEN broken = total THEN 'ACTION NEEDED' WHEN broken > 0 THEN 'partial' WHEN reported = 0 THEN 'quiet' ELSE 'normal' END AS state,
  CASE WHEN broken > 0 THEN 'Notices - ' || reported || ' new opportunities, ' || broken || ' of ' || total || ' portals unavailable'
       ELSE 'Notices - ' || reported || ' new opportunities' END AS subject,
  CASE WHEN broken > 0 THEN reported || '-opportunities-' || broken || '-of-' || total || '-portals-unavailable'
       ELSE reported || '-opportunities' END AS slug,
  CASE WHEN broken > 0 THEN reported || ' opportunities found. ' || broken || ' of ' || total || ' portals were unavailable, so this is a partial picture.'
       ELSE reported || ' new opportunities found. All ' || total || ' portals were read successfully.' END AS sentence,
  CASE WHEN broken >= 1 THEN broken || ' of ' || total || ' portals unavailable' END AS alert_reason
FROM t"""


@query("run_status", with_views(HEALTH, body=_STATUS))
def run_status(spark, sf_dir):
    bought = T.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    reported = bought.agg(F.count("*").alias("reported"))
    return H.run_status(events_health(spark, sf_dir), reported, alert_threshold=1)


@query("alert_table", with_views(HEALTH, body="SELECT key, reason FROM health WHERE status = 'unavailable'"))
def alert_table(spark, sf_dir):
    return H.alert_table(events_health(spark, sf_dir))


@query("page_failures", """
WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' OR user_id % 10 = 3 THEN 'error ' || event_type END AS reason,
     row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_no FROM events)
SELECT 's' || user_id AS key, CASE WHEN bool_and(reason IS NOT NULL)
   THEN string_agg('u' || user_id || ': ' || reason, ' | ' ORDER BY page_no) END AS reason
FROM (SELECT user_id, event_type AS page_no, max(CASE WHEN user_id % 10 = 3 THEN 'error ' || event_type
        WHEN event_type = 'error' THEN 'error ' || event_type END) AS reason
      FROM events GROUP BY 1, 2) GROUP BY user_id""")
def page_failures(spark, sf_dir):
    failed = (F.col("user_id") % 10 == 3) | (F.col("event_type") == "error")
    pages = T.table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("page_no")).agg(
        F.max(F.when(failed, F.concat_ws(" ", F.lit("error"), "event_type"))).alias("reason")
    )
    source = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return H.combine_pages(pages.select(
        source.alias("key"), "page_no", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), "reason"
    ))


@query("field_anatomy", """
WITH kv AS (
  SELECT event_id, unnest(['k', 'type_url', 'value', 'blank']) AS key,
         unnest([json_extract_string(props, '$.k'), CASE WHEN event_type = 'click' THEN 'http://' || event_type END,
                 CASE WHEN user_id % 2 = 0 THEN event_type END, '']) AS value FROM events)
SELECT key, count(*) AS filled, arg_min(value, event_id) AS sample,
  key = 'type_url' OR starts_with(arg_min(value, event_id), 'http') AS url_like
FROM kv WHERE value IS NOT NULL AND value <> '' GROUP BY key""")
def field_anatomy(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    parsed = F.from_json("props", "map<string,string>")
    more = F.create_map(
        F.lit("type_url"), F.when(F.col("event_type") == "click", F.concat(F.lit("http://"), "event_type")),
        F.lit("value"), F.when(T.every("user_id", 2), F.col("event_type")),
        F.lit("blank"), F.lit(""),
    )
    items = events.select("event_id", F.map_concat(parsed, more).alias("fields"))
    return P.field_anatomy(items, "fields", "event_id")


@query("duplicate_titles", with_views(DOCUMENT_NOTICES, body="""
, g AS (SELECT lower(trim(title)) AS title, count(*) AS n, count(DISTINCT title) AS t,
  count(DISTINCT portal) AS portal, count(DISTINCT description) AS description, count(DISTINCT language) AS language,
  count(DISTINCT posted_date) AS posted_date, count(DISTINCT coalesce(eligibility, 'None')) AS eligibility,
  count(DISTINCT coalesce(notice_type, 'None')) AS notice_type
  FROM doc_notices WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT title, n, concat_ws(',', CASE WHEN description > 1 THEN 'description' END,
  CASE WHEN eligibility > 1 THEN 'eligibility' END, CASE WHEN language > 1 THEN 'language' END,
  CASE WHEN notice_type > 1 THEN 'notice_type' END, CASE WHEN portal > 1 THEN 'portal' END,
  CASE WHEN posted_date > 1 THEN 'posted_date' END, CASE WHEN t > 1 THEN 'title' END) AS differing
FROM g"""))
def duplicate_titles(spark, sf_dir):
    found = P.duplicate_titles(T.notices_from_documents(spark, sf_dir))
    return found.withColumn("differing", F.array_join("differing", ","))


@query("value_tally", """
SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def value_tally(spark, sf_dir):
    nation = T.table(spark, sf_dir, "nation")
    rows = T.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return P.tally(rows, "n_name")


@query("read_completeness", """
SELECT o_orderpriority AS portal, count(*) AS read, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS unlinked,
  CASE WHEN o_orderpriority <> '5-LOW' THEN 3000 END AS reported_total,
  CASE WHEN o_orderpriority = '5-LOW' THEN count(*) = 10000 ELSE count(*) < 3000 END AS truncated
FROM orders GROUP BY 1""")
def read_completeness(spark, sf_dir):
    notices = T.notices_from_orders(spark, sf_dir)
    totals = notices.select("portal").distinct().withColumn(
        "reported_total", F.when(F.col("portal") != "5-LOW", F.lit(3000))
    )
    return P.read_completeness(notices.select("portal", "url"), totals, cap=10_000)


@query("largest_responses", """
SELECT page_id, url, length(html) AS bytes FROM pages ORDER BY length(html) DESC, url LIMIT 12""")
def largest_responses(spark, sf_dir):
    log = T.table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("bytes"))
    return P.largest_responses(log)
