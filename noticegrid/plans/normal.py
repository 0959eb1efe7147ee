"""Queries that normalise raw fields: dates, values and API payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions import dates, money
from noticegrid.operators import normalise, relevance
from noticegrid.plans.registry import query
from noticegrid.plans.views import with_views
from noticegrid.sources import payloads
from noticegrid.sources import tables as T

_GERMAN = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
_ENGLISH = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_ARABIC = ("كانون الثاني", "شباط", "آذار", "نيسان", "أيار", "حزيران", "تموز", "آب", "أيلول", "تشرين الأول", "تشرين الثاني", "كانون الأول")


def _name(names, when):
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(when))


@query("dates_parse", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed,
       CAST(o_orderkey % 8 AS INTEGER) AS shape FROM orders
UNION ALL SELECT o_orderkey, NULL, 8 FROM orders""")
def dates_parse(spark, sf_dir):
    orders = T.heavy(spark, sf_dir, "orders")
    when = F.col("o_orderdate")
    day, year = F.dayofmonth(when).cast("string"), F.year(when).cast("string")
    shapes = [
        F.date_format(when, "yyyy-MM-dd'T'09:00:00'Z'"),
        F.date_format(when, "'Deadline: 'dd/MM/yyyy"),
        F.date_format(when, "dd. MM. yyyy"),
        F.concat(day, F.lit(". "), _name(_GERMAN, when), F.lit(" "), year),
        F.concat(_name(_ENGLISH, when), F.lit(" "), day, F.lit(", "), year, F.lit(" in Amman")),
        F.translate(F.concat(day, F.lit(" "), _name(_ARABIC, when), F.lit(" "), year), "0123456789", "٠١٢٣٤٥٦٧٨٩"),
        F.concat(day, F.lit("-"), F.substring(_name(_ENGLISH, when), 1, 3), F.lit("-"), year, F.lit(" 19:00 (GMT +3.00)")),
        F.date_format(when, "yyyy/MM/dd"),
    ]
    shape = F.pmod("o_orderkey", F.lit(8)).cast("int")
    rendered = F.element_at(F.array(*shapes), shape + 1)
    never = F.concat(F.lit("Expires in "), day, F.lit(" days"))
    rows = orders.select("o_orderkey", F.explode(F.array(
        F.struct(rendered.alias("raw"), shape.alias("shape")),
        F.struct(never.alias("raw"), F.lit(8).alias("shape")),
    )).alias("r")).select("o_orderkey", "r.raw", "r.shape")
    parsed = dates.parse_date(F.col("raw"), T.ORDERS_RUN_DATE)
    return rows.select("o_orderkey", parsed.cast("string").alias("parsed"), "shape")


@query("values_parse", """
SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS shape, round(CASE o_orderkey % 7
   WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 1.09e0
   WHEN 2 THEN round(o_totalprice, 0) * 1e3 WHEN 3 THEN floor(o_totalprice) * 1.41e0
   WHEN 4 THEN floor(o_totalprice) * 2 * 1.27e0 WHEN 5 THEN NULL
   ELSE floor(o_totalprice) * 0.0064e0 END, 2) AS usd FROM orders""")
def values_parse(spark, sf_dir):
    orders = T.heavy(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    whole = F.floor(price).cast("string")
    english = F.format_number(price, 2)
    german = F.translate(english, ",.", ".,")
    shapes = [
        F.concat(F.lit("USD "), english),
        F.concat(F.lit("EUR "), german),
        F.concat(F.format_number(F.round(price, 0), 0), F.lit("k USD")),
        F.concat(F.translate(whole, "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit(" دينار أردني")),
        F.concat(F.lit("GBP 50 per day, total £"), F.format_number(F.floor(price) * 2, 0)),
        F.concat(F.lit("Published 01 August 2026, lot "), whole),
        F.concat(whole, F.lit(" JPY")),
    ]
    shape = F.pmod("o_orderkey", F.lit(7)).cast("int")
    rows = orders.select("o_orderkey", shape.alias("shape"), F.element_at(F.array(*shapes), shape + 1).alias("raw"))
    return rows.select("o_orderkey", "shape", money.parse_value_usd(F.col("raw")).alias("usd"))


_NATIONS = S.CountryTerms(latin=("france", "jordan", "japan", "germany"), substrings=(), tld=None, codes=("fra",))


def worldbank_payloads(spark, sf_dir):
    """Orders of each customer as one landed response in the list or the keyed form."""
    orders = T.in_parts(T.notices_from_orders(spark, sf_dir), spark, sf_dir, "orders")
    nation = F.regexp_extract("title", r"#\d+ (.*)$", 1)
    item = F.struct(
        F.concat(F.lit("OP"), F.lpad(F.col("id"), 8, "0")).alias("id"),
        F.when(T.every("id", 4), F.col("url")).alias("url"),
        F.concat(F.lit("Notice "), F.col("id")).alias("bid_description"),
        F.col("title").alias("project_name"),
        F.date_format("posted_date", "dd-MMM-yyyy").alias("noticedate"),
        F.date_format("closing_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("submission_deadline_date"),
        F.col("estimated_value_usd").cast("decimal(20,2)").cast("string").alias("contract_value"),
        F.when(~T.every("id", 3), nation).alias("project_ctry_name"),
        F.col("notice_type").alias("notice_type"), F.col("contact").alias("contact_email"),
    )
    text = F.to_json(F.struct(F.array(item).alias("procnotices"), F.lit(1).alias("total")))
    keyed = F.to_json(F.struct(F.struct(item.alias("k1"), F.lit("x").alias("note")).alias("notices")))
    return orders.select(F.when(T.every("id", 2), text).otherwise(keyed).alias("payload"))


@query("payload_normalise", """
WITH o AS (
  SELECT o_orderkey AS k, c_name, n_name, CAST(o_orderdate AS DATE) AS due, o_totalprice, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), r AS (
  SELECT k, 'Notice ' || k || ' (' || c_name || ' ' || n_name || ')' AS title,
    CASE WHEN k % 4 = 0 AND k % 9 <> 0 THEN 'https://notices.example/' || k
         ELSE 'https://projects.worldbank.org/en/projects-operations/procurement-detail/OP' || lpad(CAST(k AS VARCHAR), 8, '0') END AS url,
    CASE WHEN k % 11 <> 0 THEN due - CAST(k % 200 AS INTEGER) END AS posted_date,
    CASE WHEN k % 7 <> 0 THEN due END AS closing_date,
    CASE WHEN k % 97 = 0 THEN round(o_totalprice * 1e6, 2) WHEN k % 5 <> 0 THEN o_totalprice END AS value,
    CASE WHEN k % 3 <> 0 THEN n_name END AS country, c_name, o_orderstatus,
    'worldbank-' || substr(sha256('worldbank|OP' || lpad(CAST(k AS VARCHAR), 8, '0')), 1, 16) AS id
  FROM o
)
SELECT id, title, url, CAST(posted_date AS VARCHAR) AS posted_date, CAST(closing_date AS VARCHAR) AS closing_date,
  value AS estimated_value_usd, country AS raw_country, c_name AS contact, o_orderstatus AS notice_type,
  regexp_matches(lower(coalesce(country, title)), '(^|[^a-z])(france|jordan|japan|germany)([^a-z]|$)') AS relevant
FROM r""")
def payload_normalise(spark, sf_dir):
    raw = payloads.worldbank(worldbank_payloads(spark, sf_dir), _NATIONS)
    marked = normalise.build_records(raw, T.ORDERS_RUN_DATE, keep=("verdict",))
    terms = relevance.text_match(_NATIONS, cleaned=True)
    country = F.when(F.col("verdict").isNotNull(), F.regexp_extract("title", r"#\d+ (.*)\)$", 1))
    return marked.select(
        "id", "title", "url", F.col("posted_date").cast("string").alias("posted_date"),
        F.col("closing_date").cast("string").alias("closing_date"), "estimated_value_usd",
        country.alias("raw_country"), "contact", "notice_type",
        F.coalesce("verdict", terms).alias("relevant"),
    )


@query("payload_releases", with_views("""
o AS (
  SELECT o_orderkey AS k, c_name, n_name, CAST(o_orderdate AS DATE) AS due, floor(o_totalprice) AS price, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)""", body="""
SELECT 'fcdo-' || substr(sha256('fcdo|ocds-' || k), 1, 16) AS id, 'Works ' || k AS title,
  CASE WHEN k % 2 = 0 THEN 'https://docs.example/' || k ELSE 'https://www.find-tender.service.gov.uk/Notice/ocds-' || k END AS url,
  CAST(due AS VARCHAR) AS closing_date,
  CASE WHEN k % 5 <> 0 THEN round(price * CASE WHEN k % 3 = 0 THEN 1.09e0 ELSE 1.27e0 END, 2) END AS estimated_value_usd,
  c_name AS contact, CASE WHEN k % 4 = 0 THEN o_orderstatus ELSE o_orderpriority END AS notice_type
FROM o"""))
def payload_releases(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    customer = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = T.in_parts(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    amount = F.when(~T.every("o_orderkey", 5), F.floor("o_totalprice"))
    release = F.struct(
        F.concat(F.lit("ocds-"), key).alias("ocid"),
        F.struct(
            F.concat(F.lit("Works "), key).alias("title"),
            F.when(T.every("o_orderkey", 4), F.col("o_orderstatus")).alias("mainProcurementCategory"),
            F.struct(amount.alias("amount"), F.when(T.every("o_orderkey", 3), "EUR").alias("currency")).alias("value"),
            F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'17:00:00-04:00").alias("endDate")).alias("tenderPeriod"),
            F.when(T.every("o_orderkey", 2), F.array(F.struct(F.concat(F.lit("https://docs.example/"), key).alias("url")))).alias("documents"),
        ).alias("tender"),
        F.array(F.col("o_orderpriority")).alias("tag"),
        F.array(
            F.struct(F.lit("Nobody").alias("name"), F.array(F.lit("supplier")).alias("roles")),
            F.struct(F.col("c_name").alias("name"), F.array(F.lit("buyer")).alias("roles")),
        ).alias("parties"),
    )
    landed = joined.select(F.to_json(F.struct(F.array(release).alias("releases"))).alias("payload"))
    notices = normalise.build_records(payloads.fcdo(landed), T.ORDERS_RUN_DATE)
    return notices.select(
        "id", "title", "url", F.col("closing_date").cast("string").alias("closing_date"),
        "estimated_value_usd", "contact", "notice_type",
    )


_ORDERS = """
o AS (
  SELECT o_orderkey AS k, c_name, c_custkey, n_name, CAST(o_orderdate AS DATE) AS due, 1000 * floor(o_totalprice) AS price, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def _placed_orders(spark, sf_dir):
    customer = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = T.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = T.table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    placed = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return T.in_parts(placed, spark, sf_dir, "orders").withColumns({
        "k": F.col("o_orderkey").cast("string"), "price": (1000 * F.floor("o_totalprice")).cast("string")})


@query("payload_ted", with_views(_ORDERS, body="""
SELECT 'ted-' || substr(sha256('ted|' || k || '-1998'), 1, 16) AS id,
  CASE WHEN k % 5 = 0 THEN 'Austria – Licence ' || k WHEN k % 2 = 0 THEN 'Works ' || k || ' for ' || c_name ELSE 'Travaux ' || k END AS title,
  CASE WHEN k % 4 <> 0 THEN 'https://t.example/' || k ELSE 'https://ted.europa.eu/en/notice/-/detail/' || k || '-1998' END AS url,
  CAST(due AS VARCHAR) AS posted_date, CASE WHEN k % 7 <> 0 THEN CAST(due AS VARCHAR) END AS closing_date,
  CASE WHEN k % 11 <> 0 THEN round(price * 1.09e0, 2) END AS estimated_value_usd, c_name AS contact, o_orderstatus AS notice_type,
  CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 OR k % 5 = 0 THEN false END AS verdict
FROM o"""))
def payload_ted(spark, sf_dir):
    """Orders as notices with multilingual fields, one landed response each."""
    number = F.concat("k", F.lit("-1998"))
    zoned = F.date_format("o_orderdate", "yyyy-MM-dd'+02:00'")
    several = F.create_map(F.lit("eng"), F.array(F.concat(F.lit("Works "), "k"), F.concat(F.lit("for "), "c_name")), F.lit("fra"), F.array(F.lit("Travaux")))
    title = F.when(T.every("o_orderkey", 5), F.concat(F.lit("Austria – Licence "), "k")).when(
        T.every("o_orderkey", 2), F.to_json(several)).otherwise(F.to_json(F.create_map(F.lit("fra"), F.array(F.concat(F.lit("Travaux "), "k")))))
    country = F.when(T.every("o_orderkey", 3), F.array(F.lit("JOR"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("FRA")))
    rest = F.struct(
        number.alias("publication-number"), country.alias("buyer-country"), zoned.alias("publication-date"),
        F.when(~T.every("o_orderkey", 7), F.array(zoned)).alias("deadline-receipt-tender-date-lot"),
        F.when(~T.every("o_orderkey", 11), F.create_map(F.lit("eng"), F.array("price"))).alias("total-value"),
        F.create_map(F.lit("eng"), F.array("c_name")).alias("buyer-name"), F.col("o_orderstatus").alias("notice-type"),
        F.when(~T.every("o_orderkey", 4), F.create_map(F.lit("html"), F.create_map(F.lit("ENG"), F.concat(F.lit("https://t.example/"), "k")))).alias("links"))
    quoted = F.when(title.startswith("{"), title).otherwise(F.concat(F.lit('"'), title, F.lit('"')))
    body = F.concat(F.lit('{"notices": [{"notice-title": '), quoted, F.lit(", "), F.expr("substring(body, 2)"), F.lit("]}"))
    landed = _placed_orders(spark, sf_dir).withColumn("body", F.to_json(rest)).select(body.alias("payload"))
    built = normalise.build_records(payloads.ted(landed), T.ORDERS_RUN_DATE, keep=("verdict",))
    day = lambda c: F.col(c).cast("string").alias(c)
    return built.select("id", "title", "url", day("posted_date"), day("closing_date"), "estimated_value_usd", "contact", "notice_type", "verdict")


@query("payload_samgov", with_views(_ORDERS, body="""
SELECT 'samgov-' || substr(sha256('samgov|s' || k), 1, 16) AS id, 'Repair ' || k AS title, 'https://s.example/' || k AS url,
  CAST(due AS VARCHAR) AS posted_date, CASE WHEN k % 7 <> 0 THEN CAST(due AS VARCHAR) END AS closing_date,
  CASE WHEN k % 11 <> 0 THEN CAST(price AS DOUBLE) END AS estimated_value_usd,
  c_name || CASE WHEN k % 2 = 0 THEN ' c' || c_custkey || '@x.example' ELSE '' END AS contact,
  CASE WHEN k % 3 = 0 THEN n_name ELSE 'Text ' || k END AS description, o_orderstatus AS notice_type
FROM o WHERE k % 10 <> 0"""))
def payload_samgov(spark, sf_dir):
    """Orders as opportunities; each tenth response is empty, which is legal."""
    deadline = F.when(~T.every("o_orderkey", 7), F.date_format("o_orderdate", "yyyy-MM-dd'T17:00:00-04:00'"))
    name = F.when(T.every("o_orderkey", 2), F.lit("responseDeadLine")).otherwise(F.lit("responseDeadline"))
    one = F.struct(
        F.concat(F.lit("s"), "k").alias("noticeId"), F.concat(F.lit("Repair "), "k").alias("title"), F.concat(F.lit("https://s.example/"), "k").alias("uiLink"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("postedDate"), F.col("o_orderstatus").alias("type"),
        F.when(~T.every("o_orderkey", 3), F.concat(F.lit("Text "), "k")).alias("description"),
        F.when(~T.every("o_orderkey", 11), F.struct(F.col("price").alias("amount"))).alias("award"),
        F.array(F.struct(F.col("c_name").alias("fullName"), F.when(T.every("o_orderkey", 2), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.example"))).alias("email"))).alias("pointOfContact"),
        F.when(T.every("o_orderkey", 3), F.struct(F.struct(F.col("n_name").alias("name")).alias("country"))).alias("placeOfPerformance"))
    due = F.when(deadline.isNull(), "").otherwise(F.concat(F.lit('"'), name, F.lit('": "'), deadline, F.lit('", ')))
    full = F.concat(F.lit('{"opportunitiesData": [{'), due, F.expr("substring(body, 2)"), F.lit("]}"))
    landed = _placed_orders(spark, sf_dir).withColumn("body", F.to_json(one)).select(
        F.when(T.every("o_orderkey", 10), '{"opportunitiesData": []}').otherwise(full).alias("payload"))
    built = normalise.build_records(payloads.samgov(landed), T.ORDERS_RUN_DATE)
    day = lambda c: F.col(c).cast("string").alias(c)
    return built.select("id", "title", "url", day("posted_date"), day("closing_date"), "estimated_value_usd", "contact", "description", "notice_type")


@query("relevance_multi", with_views(_ORDERS, body="""
SELECT CAST(k AS VARCHAR) AS id FROM o WHERE k % 6 = 0 OR regexp_matches(lower(n_name), '(^|[^a-z])(france|jordan|japan|germany)([^a-z]|$)')"""))
def relevance_multi(spark, sf_dir):
    notices = _placed_orders(spark, sf_dir).select(
        F.col("k").alias("id"), F.concat_ws(" ", "c_name", "n_name").alias("title"), F.concat(F.lit("https://m.example/"), "k").alias("url"),
        F.when(T.every("o_orderkey", 6), "To Multiple  Destinations").alias("description"), F.lit(None).cast("string").alias("eligibility"))
    return relevance.relevant_or_multi(notices, _NATIONS).select("id")


@query("detail_enrich", """
WITH n AS (
  SELECT o_orderkey AS k, o_orderpriority AS portal, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS closing FROM orders
), chosen AS (
  SELECT portal, k FROM n WHERE closing IS NULL
), d AS (
  SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS due, floor(sum(l_quantity)) AS q FROM lineitem GROUP BY 1
)
SELECT CAST(n.k AS VARCHAR) AS id, n.portal, CAST(coalesce(n.closing, d.due) AS VARCHAR) AS closing_date,
       d.q * 1.09e0 * 1e3 AS value
FROM n LEFT JOIN chosen c ON n.k = c.k AND n.portal = c.portal LEFT JOIN d ON d.k = c.k""")
def detail_enrich(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    notices = orders.select(
        key.alias("id"), F.col("o_orderpriority").alias("portal"), F.concat(F.lit("u/"), key).alias("url"),
        F.when(T.every("o_orderkey", 2), F.col("o_orderdate").cast("date")).alias("closing_date"),
        F.lit(None).cast("double").alias("estimated_value_usd"), F.lit(None).cast("string").alias("description"),
    )
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("due"), F.sum("l_quantity").alias("q")
    )
    details = lines.select(
        F.concat(F.lit("u/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.date_format("due", "dd.MM.yyyy").alias("closing_text"),
        F.concat(F.lit("EUR "), F.floor("q").cast("string"), F.lit("k")).alias("value_text"),
        F.lit("landed detail").alias("description"),
    )
    filled = normalise.fill_from_details(notices, details, T.ORDERS_RUN_DATE)
    return filled.select(
        "id", "portal", F.col("closing_date").cast("string").alias("closing_date"),
        F.col("estimated_value_usd").alias("value"),
    )


@query("first_per_identity", """
SELECT l_partkey AS part, l_suppkey AS supplier, min(l_orderkey * 10 + l_linenumber) AS first_row
FROM lineitem GROUP BY 1, 2""")
def first_per_identity(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_partkey").alias("portal"), F.col("l_suppkey").alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
    )
    first = normalise.first_per_identity(rows, "row_no")
    return first.select(F.col("portal").alias("part"), F.col("id").alias("supplier"), F.col("row_no").alias("first_row"))
