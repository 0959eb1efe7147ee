"""Inventory and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.operators import inventory as I
from noticegrid.operators import quality as Q
from noticegrid.plans.registry import query
from noticegrid.plans.views import UNITS, with_views
from noticegrid.session import next_round
from noticegrid.sources import tables as T

SEARCH = I.UnitQuery(min_beds=2, min_area=10, max_price=1500.0, status="available", sort="floorAsc")
SELLABLE = "(status = 'available' AND coalesce(price, 0) <> 0)"


def units(spark, sf_dir):
    return T.units_from_parts(spark, sf_dir)


def projects(spark, sf_dir):
    return T.projects_from_parts(spark, sf_dir)


def sql(body):
    return with_views(UNITS, body=body)


@query("unit_search", sql("""
SELECT id, floor, price, status, area FROM units
WHERE beds >= 2 AND area >= 10 AND coalesce(price, 0) <= 1500 AND status = 'available'"""))
def unit_search(spark, sf_dir):
    return I.search(units(spark, sf_dir), SEARCH).select("id", "floor", "price", "status", "area")


@query("unit_search_count", sql("""
SELECT count(*) AS n FROM units WHERE district = 'd1' AND type = 'ECONOMY' AND orientation = 'east'"""))
def unit_search_count(spark, sf_dir):
    q = I.UnitQuery(district="d1", type="ECONOMY", orientation="east")
    return I.matching(units(spark, sf_dir), q).agg(F.count("*").alias("n"))


@query("unit_facets", sql("""
SELECT 'floor' AS facet, CAST(floor AS VARCHAR) AS value, count(*) AS n, min(ordinal) AS first_seen
FROM units GROUP BY floor
UNION ALL SELECT 'orientation', orientation, count(*), min(ordinal) FROM units GROUP BY orientation"""))
def unit_facets(spark, sf_dir):
    return I.facets(units(spark, sf_dir))


@query("unit_scarcity", sql(f"""
SELECT id, NOT {SELLABLE} AS sold,
  CASE WHEN coalesce(price, 0) <> 0 THEN CAST(floor(price / area + 0.5) AS BIGINT) END AS price_per_area,
  CASE WHEN NOT {SELLABLE} THEN NULL WHEN left_n = 1 THEN 'last in project'
       WHEN at_area = 1 THEN 'last at this size'
       WHEN left_n <= 3 THEN 'only ' || left_n || ' of ' || total || ' left' END AS scarcity
FROM (SELECT *, count(*) FILTER (WHERE {SELLABLE}) OVER (PARTITION BY project_id) AS left_n,
        count(*) FILTER (WHERE {SELLABLE}) OVER (PARTITION BY project_id, area) AS at_area,
        count(*) OVER (PARTITION BY project_id) AS total FROM units)"""))
def unit_scarcity(spark, sf_dir):
    return I.scarcity(units(spark, sf_dir)).select("id", "sold", "price_per_area", "scarcity")


@query("project_cards", sql(f"""
SELECT p.id, p.status, count(u.id) AS units,
  count(*) FILTER (WHERE u.status = 'available') AS available,
  count(*) FILTER (WHERE u.status = 'available' AND coalesce(price, 0) <> 0) AS sellable,
  min(price) FILTER (WHERE u.status = 'available' AND coalesce(price, 0) <> 0) AS price_from,
  min(area) AS min_area, max(area) AS max_area,
  CASE WHEN p.status = 'selling' AND count(u.id) > 0
        AND count(*) FILTER (WHERE u.status = 'available' AND coalesce(price, 0) <> 0) = 0
       THEN 'soldout' ELSE p.status END AS shown_status,
  CASE p.status WHEN 'delivered' THEN 0 WHEN 'selling' THEN 1 WHEN 'upcoming' THEN 2 ELSE 9 END AS status_rank
FROM projects p LEFT JOIN units u ON u.project_id = p.id GROUP BY p.id, p.status"""))
def project_cards(spark, sf_dir):
    cards = I.by_status(I.project_cards(projects(spark, sf_dir), units(spark, sf_dir)))
    return cards.select(
        "id", "status", "units", "available", "sellable", "price_from", "min_area", "max_area",
        "shown_status", "status_rank",
    )


@query("project_index", sql("SELECT id FROM projects WHERE status = 'delivered'"))
def project_index(spark, sf_dir):
    return I.with_status(projects(spark, sf_dir), "delivered").select("id")


@query("featured_projects", sql("""
SELECT project_id AS id, count(*) FILTER (WHERE status = 'available') AS available
FROM units GROUP BY 1 ORDER BY 2 DESC, min(ordinal) LIMIT 3"""))
def featured_projects(spark, sf_dir):
    cards = I.project_cards(projects(spark, sf_dir), units(spark, sf_dir))
    return I.featured_projects(cards).select("id", "available")


@query("inventory_totals", sql("""
SELECT (SELECT count(*) FROM projects) AS projects, count(*) AS units,
  count(*) FILTER (WHERE status = 'available') AS available,
  count(*) FILTER (WHERE status = 'reserved') AS reserved, count(*) FILTER (WHERE status = 'sold') AS sold,
  min(price) FILTER (WHERE price > 0) AS lowest_price FROM units"""))
def inventory_totals(spark, sf_dir):
    return I.dashboard(projects(spark, sf_dir), units(spark, sf_dir))


@query("unit_top_value", sql("""
SELECT id, price, area FROM units WHERE status = 'available'
ORDER BY CASE WHEN coalesce(price, 0) = 0 THEN CAST('infinity' AS DOUBLE) ELSE area / price END DESC, ordinal LIMIT 3"""))
def unit_top_value(spark, sf_dir):
    return I.featured_units(units(spark, sf_dir)).select("id", "price", "area")


_PLACES = """row_number() OVER (PARTITION BY project_id
    ORDER BY status = 'sold', coalesce(price, 0), ordinal)"""


@query("unit_list", sql(f"""
SELECT project_id, id, place FROM (SELECT *, {_PLACES} AS place FROM units) WHERE place <= 9"""))
def unit_list(spark, sf_dir):
    return I.unit_list(units(spark, sf_dir)).select("project_id", "id", "place")


@query("unit_list_pinned", sql(f"""
SELECT project_id, id, place FROM (
  SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY
      CASE WHEN id = (SELECT max(id) FROM units WHERE project_id = 'Brand#1' AND status = 'sold')
             AND base > 9 THEN 0 ELSE base END) AS place
  FROM (SELECT *, {_PLACES} AS base FROM units)) WHERE place <= 9"""))
def unit_list_pinned(spark, sf_dir):
    everything = units(spark, sf_dir)
    wanted = everything.where((F.col("project_id") == "Brand#1") & (F.col("status") == "sold"))
    target = wanted.agg(F.max("id")).first()[0]
    return I.unit_list(everything, pinned=target).select("project_id", "id", "place")


@query("unit_matrix", sql("""
SELECT project_id, floor, count(*) AS cells, count(*) FILTER (WHERE status = 'available') AS available,
  count(*) FILTER (WHERE status = 'reserved') AS reserved, count(*) FILTER (WHERE status = 'sold') AS sold,
  min(ordinal) AS first_ordinal FROM units GROUP BY 1, 2"""))
def unit_matrix(spark, sf_dir):
    return I.availability(units(spark, sf_dir))


@query("unit_matrix_cells", sql(f"""
SELECT project_id, floor, code, area, price, status, NOT {SELLABLE} AS disabled, ordinal FROM units"""))
def unit_matrix_cells(spark, sf_dir):
    return I.matrix_cells(units(spark, sf_dir))


@query("unit_plans", sql("""
SELECT project_id, plan, count(*) AS units, min(ordinal) AS first_ordinal,
       arg_min(area, ordinal) AS area, arg_min(code, ordinal) AS first_code
FROM units WHERE plan IS NOT NULL GROUP BY 1, 2"""))
def unit_plans(spark, sf_dir):
    return I.plans(units(spark, sf_dir))


@query("unit_plan_codes", sql("SELECT project_id, plan, code, ordinal FROM units WHERE plan IS NOT NULL"))
def unit_plan_codes(spark, sf_dir):
    return I.plan_codes(units(spark, sf_dir))


@query("unit_images", sql("""
SELECT u.id, CASE (u.ordinal % 3) WHEN 0 THEN 'img-' || n WHEN 1 THEN 'g1-' || n ELSE 'g2-' || n END AS image
FROM (SELECT *, substr(project_id, 7) AS n FROM units) u"""))
def unit_images(spark, sf_dir):
    number = F.substring("id", 7, 9)
    pools = projects(spark, sf_dir).select(
        F.col("id").alias("project_id"),
        F.array(*[F.concat_ws("-", F.lit(p), number) for p in ("img", "g1", "g2")]).alias("pool"),
    )
    return I.unit_image(units(spark, sf_dir), pools).select("id", "image")


_SETS = "CAST(ordinal // 3 AS BIGINT)"


@query("unit_compare", sql(f"""
, chosen AS (
  SELECT * FROM (SELECT *, {_SETS} AS unit_set, count(*) OVER (PARTITION BY {_SETS}) AS n
                 FROM units WHERE {SELLABLE.replace("status = 'available' AND", '')}) WHERE n BETWEEN 2 AND 3
), long AS (
  SELECT unit_set, id AS unit_id, 'project' AS attribute, project_id || ' ' || code AS value, NULL::DOUBLE AS k FROM chosen
  UNION ALL SELECT unit_set, id, 'price', CAST(price AS VARCHAR), price FROM chosen
  UNION ALL SELECT unit_set, id, 'price_per_area', CAST(CAST(floor(price / area + 0.5) AS DOUBLE) AS VARCHAR), floor(price / area + 0.5) FROM chosen
  UNION ALL SELECT unit_set, id, 'area', CAST(area AS VARCHAR), NULL FROM chosen
  UNION ALL SELECT unit_set, id, 'outdoor', CAST(outdoor AS VARCHAR), NULL FROM chosen
  UNION ALL SELECT unit_set, id, 'total_area', CAST(area + outdoor AS VARCHAR), -(area + outdoor) FROM chosen
  UNION ALL SELECT unit_set, id, 'beds', CAST(beds AS VARCHAR), NULL FROM chosen
  UNION ALL SELECT unit_set, id, 'baths', CAST(baths AS VARCHAR), NULL FROM chosen
  UNION ALL SELECT unit_set, id, 'floor', CAST(floor AS VARCHAR), NULL FROM chosen
  UNION ALL SELECT unit_set, id, 'orientation', orientation, NULL FROM chosen
  UNION ALL SELECT unit_set, id, 'type', type, NULL FROM chosen
), agg AS (
  SELECT unit_set, attribute, count(DISTINCT value) AS n_values, min(k) AS best FROM long GROUP BY 1, 2
)
SELECT l.unit_set, l.attribute, l.unit_id, l.value,
  coalesce(l.k = a.best AND (SELECT count(*) FROM long m WHERE m.unit_set = l.unit_set
     AND m.attribute = l.attribute AND m.k = a.best) = 1, false) AS winner
FROM long l JOIN agg a ON l.unit_set = a.unit_set AND l.attribute = a.attribute
WHERE n_values > 1 OR l.attribute IN ('project', 'price', 'area')"""))
def unit_compare(spark, sf_dir):
    # Neighbouring units of the schedule form the sets; all are offered for comparison.
    offered = units(spark, sf_dir).withColumns({
        "unit_set": F.expr("ordinal div 3"), "status": F.lit("available"),
    })
    return I.compare(offered)


def _later(u):
    """A second snapshot: sold units leave, reserved ones get sold, some prices move."""
    return u.where(F.col("status") != "sold").withColumns({
        "status": F.when(F.col("status") == "reserved", "sold").otherwise(F.col("status")),
        "price": F.when(F.col("area") > 40, F.col("price") + 1).otherwise(F.col("price")),
    })


@query("snapshot_diff", sql("""
SELECT id, CASE WHEN status = 'sold' THEN 'removed' ELSE 'moved' END AS change,
  price AS old_price, CASE WHEN status <> 'sold' THEN CASE WHEN area > 40 THEN price + 1 ELSE price END END AS price,
  status AS old_status, CASE status WHEN 'sold' THEN NULL WHEN 'reserved' THEN 'sold' ELSE status END AS status
FROM units WHERE status IN ('sold', 'reserved') OR (area > 40 AND price IS NOT NULL)"""))
def snapshot_diff(spark, sf_dir):
    before = units(spark, sf_dir)
    return I.snapshot_changes(before, _later(before))


@query("snapshot_same", sql("""
, b AS (SELECT id, price, status FROM units),
a AS (SELECT id, CASE WHEN area > 40 THEN price + 1 ELSE price END AS price, CASE status WHEN 'reserved' THEN 'sold' ELSE status END AS status
      FROM units WHERE status <> 'sold'),
undone AS (SELECT id, CASE WHEN area > 40 THEN price + 1 - 1 ELSE price END AS price, status FROM units ORDER BY id DESC)
SELECT NOT EXISTS ((FROM b EXCEPT ALL FROM undone) UNION ALL (FROM undone EXCEPT ALL FROM b)) AS same,
       NOT EXISTS ((FROM b EXCEPT ALL FROM a) UNION ALL (FROM a EXCEPT ALL FROM b)) AS same_later,
       NOT EXISTS ((FROM b EXCEPT ALL (FROM b UNION ALL (FROM b LIMIT 1))) UNION ALL ((FROM b UNION ALL (FROM b LIMIT 1)) EXCEPT ALL FROM b)) AS same_repeated"""))
def snapshot_same(spark, sf_dir):
    """The inventory against itself in another order, against a later snapshot, and against itself with one row twice."""
    u = units(spark, sf_dir)
    before, after = (df.select("id", "price", "status") for df in (u, _later(u)))
    twice = before.unionByName(before.limit(1))
    return before.agg(F.count("*").alias("n")).select(
        I.same_rows(before, before.repartition(3).orderBy(F.desc("id"))).scalar().alias("same"),
        I.same_rows(before, after).scalar().alias("same_later"), I.same_rows(before, twice).scalar().alias("same_repeated"))


# ----------------------------------------------------------------------- nested content


def _order_logs(spark, sf_dir):
    """Orders as projects with a dated log and nearby groups built from their lines."""
    lines = T.table(spark, sf_dir, "lineitem")
    entry = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_linenumber").alias("line"),
    )
    undated = F.struct(F.lit(None).cast("string").alias("date"), F.col("l_linenumber").alias("line"))
    item = F.struct(F.col("l_partkey").alias("name"), F.col("l_quantity").alias("mins"))
    by_flag = lines.groupBy("l_orderkey", "l_returnflag").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("i")))).alias("s"),
        F.collect_list(F.when(F.col("l_linestatus") == "O", entry).otherwise(undated)).alias("log"),
    )
    items = F.transform("s", lambda x: x["i"])
    return by_flag.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("group"), items.alias("items")))).alias("nearby"),
        F.flatten(F.collect_list("log")).alias("progress"),
    )


@query("nested_nearby", """
SELECT l_orderkey AS id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS group_no,
  l_returnflag AS place_group,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS item_no,
  l_partkey AS place, l_quantity AS mins FROM lineitem""")
def nested_nearby(spark, sf_dir):
    return I.nearby(_order_logs(spark, sf_dir))


@query("nested_progress", """
SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) - 1 AS position,
       strftime(l_shipdate, '%Y-%m-%d') AS logged FROM lineitem WHERE l_linestatus = 'O'""")
def nested_progress(spark, sf_dir):
    return I.progress(_order_logs(spark, sf_dir)).select("id", "position", F.col("entry.date").alias("logged"))


@query("nested_related", sql("""
SELECT p.id, o.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY o.ordinal) - 1 AS position
FROM projects p JOIN projects o ON p.id <> o.id
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY o.ordinal) <= 3"""))
def nested_related(spark, sf_dir):
    return I.related(projects(spark, sf_dir)).select("id", "other", "position")


@query("nested_gallery", sql("""
SELECT 'u-' || ordinal AS image, CASE WHEN ordinal % 2 = 0 THEN 'View of ' || code ELSE project_id || ' — ' || (floor + 1) END AS caption
FROM units WHERE contains('u-' || ordinal, '1')"""))
def nested_gallery(spark, sf_dir):
    u = units(spark, sf_dir)
    name = F.concat_ws("-", F.lit("u"), "ordinal")
    images = u.select(name.alias("image"), F.col("project_id").alias("project"), F.col("floor").alias("position"))
    captions = u.where(F.col("ordinal") % 2 == 0).select(
        name.alias("image"), F.concat_ws(" ", F.lit("View of"), "code").alias("caption")
    )
    return I.gallery(images, captions, "1").select("image", "caption")


@query("published_quotes", """
SELECT doc_id, lang = 'de' AS german, format('{:,}', CAST(floor(n_chars / 2e0 + 0.5) AS BIGINT)) AS half
FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true)""")
def published_quotes(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    shown = I.published(docs.withColumn("published", F.col("quality") == 1))
    pair = F.struct((F.col("lang") == "de").alias("ar"), F.lit(False).alias("en"))
    return shown.select("doc_id", I.pick(pair, "ar").alias("german"), I.number(F.col("n_chars") / 2.0).alias("half"))


@query("nested_first_entries", """
SELECT id, position, place FROM (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS position, l_partkey AS place FROM lineitem)
WHERE position < 3""")
def nested_first_entries(spark, sf_dir):
    return I.first_entries(_order_lines(spark, sf_dir), "lines", 3).select("id", "position", F.col("entry.l_partkey").alias("place"))


def _order_lines(spark, sf_dir):
    """Orders with their lines as a list."""
    entry = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("lines"))


@query("units_flattened", """
SELECT l_orderkey || CASE WHEN l_linenumber = 5 THEN '' ELSE '-' || l_linenumber END AS id, CAST(l_orderkey AS VARCHAR) AS project_id,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0e0 END AS outdoor, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS unit_ordinal FROM lineitem""")
def units_flattened(spark, sf_dir):
    """Orders as projects, their lines as units; one unit of some has no code."""
    none = F.lit(None).cast("string")
    unit = lambda u: F.struct(
        F.when(u["l_linenumber"] != 5, u["l_linenumber"].cast("string")).alias("code"), F.lit(0).alias("floor"), none.alias("floor_label"),
        none.alias("orientation"), u["l_quantity"].alias("area"), F.when(u["l_linenumber"] % 2 == 0, u["l_quantity"]).alias("outdoor"),
        F.lit(1).alias("beds"), F.lit(1).alias("baths"), none.alias("type"), none.alias("plan"),
        F.when(u["l_returnflag"] != "R", u["l_extendedprice"]).alias("price"), F.lit("available").alias("status"))
    projects_ = _order_lines(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.lit("d").alias("district"), F.col("id").alias("ordinal"), F.transform("lines", unit).alias("units"))
    return I.flatten_projects(projects_).select("id", "project_id", "outdoor", "price", "unit_ordinal")


@query("company_gaps", """
WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 5 = 0 THEN 'founding year' END, CASE WHEN c_custkey % 7 = 0 THEN 'office address' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'enquiry capture' END, CASE WHEN coalesce(f, 0) = 0 THEN 'testimonial' END,
  CASE WHEN coalesce(p, 0) = 0 THEN 'track record' END) AS gaps
FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def company_gaps(spark, sf_dir):
    counts = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("published_testimonials"), F.count_if(F.col("o_orderstatus") == "P").alias("stats"))
    customer = T.table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    companies = customer.withColumns({
        "founded": F.when(~T.every("c_custkey", 5), 1990), "address_ar": F.when(~T.every("c_custkey", 7), "عمان").otherwise(" "),
        "form_key": F.when(~T.every("c_custkey", 3), "key")})
    return I.gaps(companies, "c_custkey").select("c_custkey", F.array_join("gaps", ", ").alias("gaps"))


# ------------------------------------------------------------------------------ quality

TYPES = ("ECONOMY", "STANDARD", "PROMO", "roof")
FACES = ("north", "east", "south")
DISTRICTS = ("d0", "d1", "d2")


def _faulty(u):
    """Units with seeded faults on key patterns; every unit stays in the table."""
    key = F.col("ordinal")
    return u.withColumns({
        "code": F.when(key % 53 != 0, F.col("code")),
        "area": F.when(key % 47 == 0, F.lit(-1.0)).otherwise(F.col("area")),
        "outdoor": F.when(key % 43 == 0, F.lit(-2.0)).otherwise(F.col("outdoor")),
        "beds": F.when(key % 41 == 0, F.lit(0)).otherwise(F.col("beds")),
        "floor": F.when(key % 37 != 0, F.col("floor")),
        "type": F.when(key % 31 == 0, F.lit("roof")).otherwise(F.col("type")),
        "status": F.when(key % 29 == 0, F.lit("gone")).otherwise(F.col("status")),
        "id": F.when(key % 59 == 0, F.col("project_id")).otherwise(F.col("id")),
    })


_FAULTY = """, f AS (SELECT project_id, district, orientation, price, baths, plan,
  CASE WHEN ordinal % 53 <> 0 THEN code END AS code,
  CASE WHEN ordinal % 47 = 0 THEN -1e0 ELSE area END AS area,
  CASE WHEN ordinal % 43 = 0 THEN -2e0 ELSE outdoor END AS outdoor,
  CASE WHEN ordinal % 41 = 0 THEN 0 ELSE beds END AS beds,
  CASE WHEN ordinal % 37 <> 0 THEN floor END AS floor,
  CASE WHEN ordinal % 31 = 0 THEN 'roof' ELSE type END AS type,
  CASE WHEN ordinal % 29 = 0 THEN 'gone' ELSE status END AS status,
  CASE WHEN ordinal % 59 = 0 THEN project_id ELSE id END AS id FROM units)"""


@query("quality_rules", sql(_FAULTY + """
SELECT id AS entity, 'code' AS rule, 'a unit has no code' AS message FROM f WHERE code IS NULL
UNION ALL SELECT id, 'district', 'district ' || district || ' has no label' FROM f WHERE district NOT IN ('d0', 'd1', 'd2')
UNION ALL SELECT id, 'orientation', 'orientation ' || orientation || ' has no label' FROM f WHERE orientation NOT IN ('north', 'east', 'south')
UNION ALL SELECT id, 'type', 'type ' || type || ' has no label' FROM f WHERE type NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'roof')
UNION ALL SELECT id, 'status', 'status ' || status || ' is unknown' FROM f WHERE status NOT IN ('available', 'reserved', 'sold')
UNION ALL SELECT id, 'floor', 'floor is not a whole number' FROM f WHERE floor IS NULL
UNION ALL SELECT id, 'area', 'area is ' || area FROM f WHERE area <= 0
UNION ALL SELECT id, 'outdoor', 'outdoor is ' || outdoor FROM f WHERE outdoor < 0
UNION ALL SELECT id, 'rooms', 'beds/baths are ' || beds || ' ' || baths FROM f WHERE beds <= 0
UNION ALL SELECT id, 'priced', 'is available but carries no price' FROM f WHERE status = 'available' AND coalesce(price, 0) <= 0
UNION ALL SELECT id, 'roof', 'is typed roof but has no outdoor area' FROM f WHERE type = 'roof' AND outdoor <= 0"""))
def quality_rules(spark, sf_dir):
    return Q.unit_rules(_faulty(units(spark, sf_dir)), TYPES, FACES, DISTRICTS)


@query("quality_projects", sql("""
SELECT id AS entity, 'id' AS rule, 'id must be lower-case letters, digits and hyphens' AS message
  FROM projects WHERE NOT regexp_matches(id, '^[a-z0-9-]+$')
UNION ALL SELECT id, 'district', 'district ' || district || ' has no label' FROM projects WHERE district = 'd3'
UNION ALL SELECT id, 'status', 'status ' || status || ' has no label' FROM projects WHERE status = 'planned'
UNION ALL SELECT id, 'image', 'has no cover image' FROM projects WHERE image IS NULL"""))
def quality_projects(spark, sf_dir):
    return Q.project_rules(projects(spark, sf_dir), DISTRICTS)


@query("quality_unique", sql(_FAULTY + """
SELECT id AS entity, 'unique' AS rule, count(*) || ' rows share this id' AS message FROM f GROUP BY id HAVING count(*) > 1"""))
def quality_unique(spark, sf_dir):
    return Q.repeated_ids(_faulty(units(spark, sf_dir)))


@query("quality_vocabulary", """
SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'priority' AS rule, o_orderpriority || ' has no label' AS message
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def quality_vocabulary(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    values = orders.select(F.col("o_orderkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("value"))
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "value string")
    return Q.outside_vocabulary(values, allowed, "priority")


@query("quality_amenities", """
SELECT CAST(l_orderkey AS VARCHAR) AS entity, 'amenity' AS rule, l_returnflag || ' has no label' AS message
FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""")
def quality_amenities(spark, sf_dir):
    """The amenities of every project, a list in its row, against their labels."""
    listed = _order_lines(spark, sf_dir).select(F.col("id").cast("string").alias("entity"), F.explode("lines.l_returnflag").alias("value"))
    return Q.outside_vocabulary(listed, spark.createDataFrame([("A",), ("N",)], "value string"), "amenity")


_CONTENT = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS torn, o_orderkey % 11 = 0 AS flat, o_orderkey % 7 = 0 AS keyed FROM orders),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i
      FROM lineitem WHERE l_orderkey % 13 <> 0 AND l_orderkey % 11 <> 0),
placed AS (SELECT *, k || ' projects.' || CASE WHEN k % 7 = 0 THEN 'p' ELSE '0' END || '.units.' || i AS place FROM l)
"""


@query("quality_content", _CONTENT + """
SELECT CAST(k AS VARCHAR) AS entity, 'readable' AS rule, 'the content cannot be read' AS message FROM o WHERE torn
UNION ALL SELECT CAST(k AS VARCHAR), 'object', 'the content is not an object' FROM o WHERE flat AND NOT torn
UNION ALL SELECT CAST(k AS VARCHAR), 'projects', 'projects is not a list' FROM o WHERE keyed AND NOT torn AND NOT flat
UNION ALL SELECT place || '.label', 'both languages', 'bilingual text is missing en' FROM placed WHERE p % 3 = 0
UNION ALL SELECT place || '.label', 'both filled', 'one language is filled in and the other is empty' FROM placed WHERE p % 3 = 1 AND p % 4 = 0
UNION ALL SELECT place || '.notes.0.deep.0.text', 'both languages', 'bilingual text is missing ar' FROM placed WHERE n % 2 = 0""")
def quality_content(spark, sf_dir):
    """Orders as JSON contents with bilingual texts some levels down: some torn, some of another shape."""
    unit = lambda u: F.struct(
        F.struct(F.lit("نص").alias("ar"), F.when(u["l_partkey"] % 3 != 0, F.when(u["l_partkey"] % 4 == 0, F.when(u["l_partkey"] % 3 == 2, "text").otherwise(" ")).otherwise("text")).alias("en")).alias("label"),
        F.when(u["l_linenumber"] % 2 == 0, F.array(F.struct(F.array(F.struct(F.struct(F.lit("only").alias("en")).alias("text"))).alias("deep")))).alias("notes"))
    units_ = F.struct(F.transform("lines", unit).alias("units"))
    ignored = F.struct(F.struct(F.lit("x").alias("ar")).alias("side")).alias("company")
    listed = F.to_json(F.struct(F.array(units_).alias("projects"), ignored))
    keyed = F.to_json(F.struct(F.struct(units_.alias("p")).alias("projects"), ignored))
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    body = F.when(F.col("id") % 13 == 0, '{"projects": [').when(F.col("id") % 11 == 0, "[1, 2]").when(F.col("id") % 7 == 0, keyed).otherwise(listed)
    written = next_round(orders.join(_order_lines(spark, sf_dir), "id", "left").select(F.col("id").cast("string").alias("entity"), body.alias("body")))
    content = T.in_parts(written, spark, sf_dir, "orders")
    return Q.content_rules(content).unionByName(Q.bilingual_content(content, ("projects",)))


@query("quality_thin_images", sql("""
SELECT 'plan-' || ordinal AS image FROM units WHERE area * 20 < 800"""))
def quality_thin_images(spark, sf_dir):
    files = units(spark, sf_dir).select(
        F.explode(F.array(F.lit(20), F.col("area").cast("int") * 20)).alias("w"), "ordinal").select(F.format_string("plan-%d-%d.webp", "ordinal", "w").alias("file"))
    return Q.thin_images(Q.manifest(files))


@query("quality_dependencies", sql(_FAULTY + """
SELECT project_id || '/' || plan AS entity, 'plan area' AS rule,
  'shared by ' || count(DISTINCT area) || ' areas from ' || min(area) || ' to ' || max(area) AS message
FROM f WHERE plan IS NOT NULL GROUP BY project_id, plan HAVING count(DISTINCT area) > 1
UNION ALL SELECT id, 'selling', 'is marked selling but no unit is available' FROM projects p
WHERE status = 'selling' AND NOT EXISTS (SELECT 1 FROM f WHERE f.project_id = p.id AND f.status = 'available')"""))
def quality_dependencies(spark, sf_dir):
    f = _faulty(units(spark, sf_dir))
    return Q.plan_area_dependency(f).unionByName(Q.selling_without_units(projects(spark, sf_dir), f))


@query("quality_images", sql("""
, wanted AS (SELECT DISTINCT plan AS image, true AS is_plan FROM units WHERE plan IS NOT NULL),
  made AS (SELECT plan AS image, list_sort(list(DISTINCT CASE WHEN beds = 4 THEN 1280 ELSE beds * 400 END)) AS widths
           FROM units WHERE plan IS NOT NULL AND area % 5 <> 0 GROUP BY 1),
  files AS (SELECT DISTINCT image || '-' || unnest(widths) || '.webp' AS file FROM made)
SELECT image AS entity, 'listed' AS rule, 'is not in the manifest' AS message FROM wanted WHERE image NOT IN (SELECT image FROM made)
UNION ALL SELECT image || '-' || w || '.webp', 'plan size', 'is not on disk'
FROM wanted, (VALUES (800), (1280)) t(w) WHERE image || '-' || w || '.webp' NOT IN (SELECT file FROM files)"""))
def quality_images(spark, sf_dir):
    u = units(spark, sf_dir).where(F.col("plan").isNotNull())
    width = F.when(F.col("beds") == 4, 1280).otherwise(F.col("beds") * 400)
    files = u.where(F.col("area") % 5 != 0).select(F.format_string("%s-%d.webp", "plan", width).alias("file")).distinct()
    referenced = u.select(F.col("plan").alias("image"), F.lit(True).alias("is_plan"))
    return Q.missing_images(referenced, Q.manifest(files), files)


@query("quality_manifest", sql("""
, made AS (SELECT project_id AS image, list_sort(list(DISTINCT CAST(area AS INTEGER))) AS widths FROM units GROUP BY 1),
  stored AS (SELECT project_id AS image, list_sort(list(DISTINCT CAST(area AS INTEGER))) AS widths FROM units
             WHERE status <> 'sold' GROUP BY 1)
SELECT image, array_to_string(made.widths, ',') AS on_disk, array_to_string(stored.widths, ',') AS listed
FROM made FULL JOIN stored USING (image) WHERE made.widths IS DISTINCT FROM stored.widths"""))
def quality_manifest(spark, sf_dir):
    def listing(u):
        return Q.manifest(u.select(F.format_string("%s-%d.webp", "project_id", F.col("area").cast("int")).alias("file")))

    u = units(spark, sf_dir)
    stale = Q.stale_entries(listing(u), listing(u.where(F.col("status") != "sold")))
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("on_disk", "listed")}
    return stale.withColumns(joined)


@query("quality_bilingual", """
WITH pairs AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS ar,
     CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS en FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS entity, 'both languages' AS rule, 'is missing a language' AS message
FROM pairs WHERE (ar IS NULL) <> (en IS NULL)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'both filled', 'one language is filled in and the other is empty'
FROM pairs WHERE ar IS NOT NULL AND en IS NOT NULL AND (trim(ar) = '') <> (trim(en) = '')""")
def quality_bilingual(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    en = F.when(T.every("doc_id", 7), None).when(T.every("doc_id", 3), " ").otherwise(F.col("text"))
    pairs = docs.select(
        F.col("doc_id").cast("string").alias("path"), F.when(~T.every("doc_id", 5), F.col("lang")).alias("ar"), en.alias("en")
    )
    return Q.bilingual(pairs)


@query("quality_notes", """
SELECT CAST(doc_id AS VARCHAR) AS entity, 'note' AS rule, 'the note on ' || source || ' would end its comment early' AS message
FROM documents WHERE contains(CASE WHEN lang = 'es' THEN text || ' */' ELSE text END, '*/')
UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 'quote', 'published with an empty quote in one language'
FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND lang = 'fr'
UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 'name', 'published with no attribution'
FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 1""")
def quality_notes(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    body = F.when(F.col("lang") == "es", F.concat("text", F.lit(" */"))).otherwise(F.col("text"))
    noted = Q.notes(docs.select(F.col("doc_id").cast("string").alias("entity"), F.col("source").alias("field"), body.alias("note")))

    def pair(ar, en):
        return F.struct(ar.alias("ar"), en.alias("en"))

    quoted = docs.join(T.table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("published"),
        pair(F.col("source"), F.when(F.col("lang") != "fr", F.col("text"))).alias("quote"),
        pair(F.when(F.col("toxic") == 0, F.col("source")), F.col("lang")).alias("name"),
    )
    return noted.unionByName(Q.testimonials(quoted))


@query("quality_unfinished", """
SELECT CAST(doc_id AS VARCHAR) AS entity, 'note' AS severity,
  trim(regexp_replace('/* «REPLACE» ' || source || ' ' || lang, '^\\s*/?\\*+\\s*', '')) AS message
FROM documents WHERE contains(text, 'license') OR contains(text, 'License')""")
def quality_unfinished(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    marked = F.col("text").contains("license") | F.col("text").contains("License")
    line = F.when(marked, F.concat(F.lit("/* «REPLACE» "), "source", F.lit(" "), "lang")).otherwise(F.col("text"))
    return Q.unfinished(docs.select(F.col("doc_id").cast("string").alias("entity"), line.alias("line")))


@query("quality_sitemap", r"""
WITH locs AS (SELECT DISTINCT regexp_extract(url, '^https?://[^?#]*') AS loc FROM pages),
     paths AS (SELECT DISTINCT '/en/' || page_id AS path FROM pages)
SELECT loc AS entity, 'domain' AS rule, 'is not on the domain' AS message FROM locs WHERE NOT starts_with(loc, 'https://blog.')
UNION ALL SELECT path, 'covered', 'is not in the sitemap' FROM paths WHERE 'https://blog.' || path NOT IN (SELECT loc FROM locs)""")
def quality_sitemap(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages")
    locs = pages.select(F.regexp_extract("url", r"^https?://[^?#]*", 0).alias("loc")).distinct()
    paths = pages.select(F.concat(F.lit("/en/"), F.col("page_id").cast("string")).alias("path")).distinct()
    return Q.sitemap(locs, paths, "https://blog.")


@query("lead_rules", r"""
WITH leads AS (
  SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'ab' ELSE c_name END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'call ' || c_custkey WHEN c_custkey % 7 = 0 THEN NULL
         ELSE '+962 7' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
    CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@mail' WHEN c_custkey % 3 = 1 THEN 'c' || c_custkey || '@mail.example' END AS email,
    c_acctbal >= 0 AS consent, CASE WHEN c_custkey % 13 = 0 THEN 'x' END AS trap FROM customer)
SELECT c_custkey AS entity, 'name' AS rule, 'name is too short' AS message FROM leads WHERE length(name) < 3
UNION ALL SELECT c_custkey, 'phone', 'phone number is not valid' FROM leads WHERE phone IS NULL OR NOT regexp_matches(phone, '^[+()\d\s-]{8,20}$')
UNION ALL SELECT c_custkey, 'email', 'e-mail address is not valid' FROM leads WHERE email IS NOT NULL AND NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]{2,}$')
UNION ALL SELECT c_custkey, 'consent', 'consent is required' FROM leads WHERE NOT consent
UNION ALL SELECT c_custkey, 'trap', 'automated submission' FROM leads WHERE trap IS NOT NULL""")
def lead_rules(spark, sf_dir):
    key = F.col("c_custkey")
    text = key.cast("string")
    leads = T.table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.when(T.every("c_custkey", 11), "ab").otherwise(F.col("c_name")).alias("name"),
        F.when(T.every("c_custkey", 5), F.concat(F.lit("call "), text)).when(T.every("c_custkey", 7), None)
        .otherwise(F.concat(F.lit("+962 7"), F.lpad(text, 8, "0"))).alias("phone"),
        F.when(key % 3 == 0, F.concat(F.lit("c"), text, F.lit("@mail")))
        .when(key % 3 == 1, F.concat(F.lit("c"), text, F.lit("@mail.example"))).alias("email"),
        (F.col("c_acctbal") >= 0).alias("consent"),
        F.when(T.every("c_custkey", 13), "x").alias("trap"),
    )
    return Q.lead_rules(leads)
