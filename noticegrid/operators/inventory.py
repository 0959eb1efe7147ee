"""Unit inventory: search, scarcity, cards, comparison and snapshots.

A missing price behaves as 0 in comparisons and orderings, as the inventory's users are
used to; ``ordinal`` (schedule position) makes every order total.

Per-project figures are grouped with map-side combine and looked up by a plain join: the
engine broadcasts the grouped side when it measures it small and splits skewed keys
otherwise, so a project holding a third of all units does not land in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.text import filled


def price_or_zero() -> Column:
    return F.coalesce("price", F.lit(0.0))


def sellable() -> Column:
    """Available and priced."""
    return F.coalesce((F.col("status") == "available") & (price_or_zero() != 0), F.lit(False))


def flatten_projects(projects: DataFrame) -> DataFrame:
    """Nested projects to one row per unit, in schedule order."""
    rows = projects.select(
        F.col("id").alias("project_id"), "district", F.col("ordinal").alias("project_ordinal"),
        F.posexplode("units").alias("unit_ordinal", "u"),
    )
    return rows.select(
        F.concat_ws("-", "project_id", "u.code").alias("id"), "project_id", "district",
        "u.code", "u.floor", "u.floor_label", "u.orientation", "u.area",
        F.coalesce("u.outdoor", F.lit(0.0)).alias("outdoor"), "u.beds", "u.baths", "u.type",
        "u.plan", "u.price", "u.status", "project_ordinal", "unit_ordinal",
    )


@dataclass(frozen=True)
class UnitQuery:
    """Conjunctive search; every criterion is optional."""

    project: str | None = None
    district: str | None = None
    min_beds: int | None = None
    type: str | None = None
    floor: int | None = None
    orientation: str | None = None
    min_area: float | None = None
    max_price: float | None = None
    status: str | None = None
    sort: str = "priceAsc"


def matching(units: DataFrame, q: UnitQuery) -> DataFrame:
    """Units that pass every given criterion. An unpriced unit passes a price limit."""
    tests = [
        (q.project, lambda v: F.col("project_id") == v),
        (q.district, lambda v: F.col("district") == v),
        (q.min_beds, lambda v: F.col("beds") >= v),
        (q.type, lambda v: F.col("type") == v),
        (q.floor, lambda v: F.col("floor") == v),
        (q.orientation, lambda v: F.col("orientation") == v),
        (q.min_area, lambda v: F.col("area") >= v),
        (q.max_price, lambda v: price_or_zero() <= v),
        (q.status, lambda v: F.col("status") == v),
    ]
    for value, test in tests:
        if value is not None:
            units = units.where(test(value))
    return units


def unit_order(sort: str) -> list[Column]:
    orders = {
        "priceAsc": [price_or_zero().asc()],
        "priceDesc": [price_or_zero().desc()],
        "areaDesc": [F.desc("area")],
        "floorAsc": [F.asc("floor"), price_or_zero().asc()],
    }
    return orders.get(sort, orders["priceAsc"]) + [F.asc("ordinal")]


def search(units: DataFrame, q: UnitQuery) -> DataFrame:
    return matching(units, q).orderBy(*unit_order(q.sort))


def facets(units: DataFrame) -> DataFrame:
    """Distinct floors upwards and orientations in first-seen order, with counts."""
    faced = units.select("ordinal", F.explode(F.array(
        F.struct(F.lit("floor").alias("facet"), F.col("floor").cast("string").alias("value")),
        F.struct(F.lit("orientation").alias("facet"), F.col("orientation").alias("value")),
    )).alias("f"))
    return faced.groupBy("f.facet", "f.value").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("first_seen")
    )


def scarcity(units: DataFrame) -> DataFrame:
    """Units with the remaining counts behind a scarcity label, literally true ones only."""
    per_area = units.groupBy("project_id", "area").agg(
        F.count("*").alias("at_area"), F.count_if(sellable()).alias("left_at_area")
    )
    per_project = per_area.groupBy("project_id").agg(
        F.sum("at_area").alias("total"), F.sum("left_at_area").alias("left")
    )
    counted = units.join(per_area.withColumnsRenamed({"project_id": "_project", "area": "_area"}), F.col("project_id").eqNullSafe(
        F.col("_project")) & F.col("area").eqNullSafe(F.col("_area")), "left").drop("_project", "_area").join(per_project, "project_id", "left")
    label = (
        F.when(~sellable(), F.lit(None))
        .when(F.col("left") == 1, "last in project")
        .when(F.col("left_at_area") == 1, "last at this size")
        .when(F.col("left") <= 3, F.concat_ws(" ", F.lit("only"), F.col("left"), F.lit("of"), F.col("total"), F.lit("left")))
    )
    return counted.withColumns({
        "scarcity": label, "sold": ~sellable(), "price_per_area": price_per_area(),
    }).drop("at_area", "left_at_area", "total", "left")


def price_per_area() -> Column:
    """Rounded half up; NULL without a price."""
    return F.when(price_or_zero() != 0, F.floor(F.col("price") / F.col("area") + 0.5))


def project_cards(projects: DataFrame, units: DataFrame) -> DataFrame:
    """Per project: unit counts, price and area ranges, inferred sold-out status."""
    facts = units.groupBy("project_id").agg(
        F.count("*").alias("units"),
        F.count_if(F.col("status") == "available").alias("available"),
        F.count_if(sellable()).alias("sellable"),
        F.min(F.when(sellable(), F.col("price"))).alias("price_from"),
        F.min("area").alias("min_area"), F.max("area").alias("max_area"),
    )
    cards = projects.join(facts, projects["id"] == facts["project_id"], "left").drop("project_id")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("units", "available", "sellable")}
    gone = (F.col("units") > 0) & (F.col("sellable") == 0) & (F.col("status") == "selling")
    order = F.when(F.col("status") == "delivered", 0).when(F.col("status") == "selling", 1).when(
        F.col("status") == "upcoming", 2).otherwise(9)
    return cards.withColumns(counts).withColumns({
        "shown_status": F.when(gone, "soldout").otherwise(F.col("status")), "status_rank": order,
    })


def by_status(cards: DataFrame) -> DataFrame:
    return cards.orderBy("status_rank", "ordinal")


def with_status(cards: DataFrame, status: str | None) -> DataFrame:
    return cards if not status else cards.where(F.col("status") == status)


def featured_projects(cards: DataFrame, n: int = 3) -> DataFrame:
    return cards.orderBy(F.desc("available"), "ordinal").limit(n)


def featured_units(units: DataFrame, n: int = 3) -> DataFrame:
    """Most area for the money among available units.

    Without a price the quotient is infinite, so unpriced units lead, as they always did.
    """
    per_price = F.when(price_or_zero() == 0, F.lit(float("inf"))).otherwise(F.col("area") / F.col("price"))
    return units.where(F.col("status") == "available").orderBy(per_price.desc(), "ordinal").limit(n)


def unit_list(units: DataFrame, n: int = 9, pinned: str | None = None) -> DataFrame:
    """The first ``n`` units of each project, unsold and cheap first.

    A requested unit that would be cut takes the first place instead of the last one.
    The bounded rank is applied in map tasks first, so no project is sorted whole.
    """
    order = [(F.col("status") == "sold").cast("int"), price_or_zero().asc(), F.asc("ordinal")]
    place = Window.partitionBy("project_id").orderBy(*order)
    head = units.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    if pinned is None:
        return head
    wanted = units.where(F.col("id") == pinned).withColumn("place", F.lit(0))
    both = wanted.unionByName(head.where(F.col("id") != pinned)).unionByName(
        head.where(F.col("id") == pinned)
    )
    once = both.groupBy("project_id", "id").agg(F.max_by(F.struct(*units.columns, "place"), "place").alias("r"))
    final = Window.partitionBy("project_id").orderBy("r.place")
    return once.select("r.*", F.row_number().over(final).alias("rank")).where(F.col("rank") <= n).drop(
        "place").withColumnRenamed("rank", "place")


def availability(units: DataFrame) -> DataFrame:
    """Matrix rows: per project and floor, counts by status and the spread of prices.

    Cells stay rows of ``matrix_cells``; a floor of any size is never packed into one value.
    """
    return units.groupBy("project_id", "floor").agg(
        F.count("*").alias("cells"),
        *[F.count_if(F.col("status") == s).alias(s) for s in S.UNIT_STATUS],
        F.min("ordinal").alias("first_ordinal"),
    )


def matrix_cells(units: DataFrame) -> DataFrame:
    """Cells of the matrix in reading order: floors downwards, units across."""
    return units.select("project_id", "floor", "code", "area", "price", "status", (~sellable()).alias("disabled"), "ordinal").orderBy(
        "project_id", F.desc("floor"), "ordinal"
    )


def plans(units: DataFrame) -> DataFrame:
    """Distinct plans of a project: first position, units using it, area of the first."""
    return units.where(F.col("plan").isNotNull() & (F.col("plan") != "")).groupBy("project_id", "plan").agg(
        F.min("ordinal").alias("first_ordinal"), F.count("*").alias("units"),
        F.min_by("area", "ordinal").alias("area"), F.min_by("code", "ordinal").alias("first_code"),
    )


def plan_codes(units: DataFrame) -> DataFrame:
    """Unit codes of each plan in schedule order, one row each."""
    return units.where(F.col("plan").isNotNull() & (F.col("plan") != "")).select(
        "project_id", "plan", "code", "ordinal"
    ).orderBy("project_id", "plan", "ordinal")


def unit_image(units: DataFrame, pools: DataFrame) -> DataFrame:
    """Assign each unit an image of its project's pool by its numeric code."""
    number = F.coalesce(F.col("code").try_cast("int"), F.lit(0))
    joined = units.join(pools, "project_id", "left")
    at = F.pmod(number, F.size("pool")) + 1
    return joined.withColumn("image", F.when(F.size("pool") > 0, F.element_at("pool", at))).drop("pool")


# ----------------------------------------------------------------------- nested content


def nearby(projects: DataFrame) -> DataFrame:
    """Nearby places: group and item positions kept."""
    groups = projects.select("id", F.posexplode("nearby").alias("group_no", "g"))
    return groups.select(
        "id", "group_no", F.col("g.group").alias("place_group"), F.posexplode("g.items").alias("item_no", "i")
    ).select("id", "group_no", "place_group", "item_no", F.col("i.name").alias("place"), F.col("i.mins").alias("mins"))


def progress(projects: DataFrame, column: str = "progress") -> DataFrame:
    """Dated log entries, newest first by date text, one row per entry."""
    dated = F.filter(F.col(column), lambda e: F.coalesce(e["date"], F.lit("")) != "")
    ordered = F.array_sort(dated, lambda a, b: F.when(a["date"] > b["date"], -1).when(a["date"] < b["date"], 1).otherwise(0))
    return projects.select("id", F.posexplode(ordered).alias("position", "entry"))


def related(projects: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` other projects in order for every project.

    Only the first ``n + 1`` projects can be anyone's neighbours, so each project is
    matched against that bounded head instead of against all others.
    """
    head = projects.orderBy("ordinal").limit(n + 1).select(
        F.struct("ordinal", F.col("id").alias("other")).alias("o")
    ).agg(F.sort_array(F.collect_list("o")).alias("head"))
    others = F.slice(F.filter("head", lambda h: h["other"] != F.col("id")), 1, n)
    return projects.select("id", head.scalar().alias("head")).select("id", F.posexplode(others).alias("position", "o")).select(
        "id", "position", F.col("o.other").alias("other")
    )


def gallery(images: DataFrame, captions: DataFrame, contains: str = "") -> DataFrame:
    """Gallery rows whose name contains a text, captioned or named after the project."""
    shown = images if not contains else images.where(F.col("image").contains(contains))
    caption = F.coalesce("caption", F.concat(F.col("project"), F.lit(" — "), F.col("position") + 1))
    return shown.join(captions, "image", "left").withColumn("caption", caption)


def published(rows: DataFrame, column: str = "published") -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit(True)))


def first_entries(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` entries of a list, a row each with its ``position``."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.posexplode(F.slice(column, 1, n)).alias("position", "entry"))


def pick(pair: Column, language: str) -> Column:
    """One side of a bilingual pair."""
    return pair["ar"] if language == "ar" else pair["en"]


def number(c: Column) -> Column:
    """Whole number with separators, halves rounded up."""
    return F.format_number(F.floor(c + 0.5), 0)


# -------------------------------------------------------------------------- comparison


def compare(units: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Comparison rows of chosen units: ``unit_set, attribute, unit_id, value, winner``.

    ``units`` carries a ``unit_set``; a set of two or three available, priced units is
    comparable. The best price, total area and price per area is marked only when one
    unit alone has it; attributes on which all units agree are left out, except the
    project, the price and the area.
    """
    picked = units.where(sellable())
    sizes = picked.groupBy("unit_set").agg(F.count("*").alias("n")).where(F.col("n").between(2, 3))
    chosen = picked.join(sizes.select("unit_set"), "unit_set")
    total = F.col("area") + F.coalesce("outdoor", F.lit(0.0))
    per_area = F.floor(F.col("price") / F.col("area") + 0.5).cast("double")

    def row(name: str, shown: Column, key: Column | None = None):
        # ``key`` orders the attribute; the smallest is the best.
        return F.struct(
            F.lit(name).alias("attribute"), shown.cast("string").alias("value"),
            (key if key is not None else F.lit(None).cast("double")).alias("key"),
        )

    rows = chosen.select("unit_set", F.col("id").alias("unit_id"), F.explode(F.array(
        row("project", F.concat_ws(" ", "project_id", "code")),
        row("price", F.col("price"), F.col("price")),
        row("price_per_area", per_area, per_area),
        row("area", F.col("area")),
        row("outdoor", F.col("outdoor")),
        row("total_area", total, -total),
        row("beds", F.col("beds")),
        row("baths", F.col("baths")),
        row("floor", F.col("floor")),
        row("orientation", F.col("orientation")),
        row("type", F.col("type")),
    )).alias("r")).select("unit_set", "unit_id", "r.*")
    # A set has at most three units, so these groups are tiny by construction.
    group = Window.partitionBy("unit_set", "attribute")
    marked = rows.withColumns({
        "lo": F.min("value").over(group), "hi": F.max("value").over(group),
        "best": F.min("key").over(group),
    }).withColumn("n_best", F.count_if(F.col("key") == F.col("best")).over(group))
    useful = (F.col("lo") != F.col("hi")) | F.col("attribute").isin(S.KEY_ATTRIBUTES)
    winner = F.coalesce((F.col("key") == F.col("best")) & (F.col("n_best") == 1), F.lit(False))
    return marked.where(useful).select("unit_set", "attribute", "unit_id", "value", winner.alias("winner"))


# ------------------------------------------------------------------ totals and snapshots


def dashboard(projects: DataFrame, units: DataFrame) -> DataFrame:
    """Totals over the whole inventory in one row."""
    counts = units.select("status", "price", F.lit(0).alias("p")).unionByName(
        projects.select(F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("price"), F.lit(1).alias("p"))
    )
    return counts.agg(
        F.sum("p").alias("projects"), F.count_if(F.col("p") == 0).alias("units"),
        *[F.count_if(F.col("status") == s).alias(s) for s in S.UNIT_STATUS],
        F.min(F.when(F.col("price") > 0, F.col("price"))).alias("lowest_price"),
    )


def gaps(company: DataFrame, *by: str) -> DataFrame:
    """Facts nobody has supplied yet, as an ordered list; ``by`` names columns to keep."""
    def missing(name: str) -> Column:
        return filled(F.col(name).cast("string")).isNull()

    return company.select(*by, F.array_compact(F.array(
        F.when(missing("founded"), "founding year"),
        F.when(missing("address_ar"), "office address"),
        F.when(missing("form_key"), "enquiry capture"),
        F.when(F.coalesce("published_testimonials", F.lit(0)) == 0, "testimonial"),
        F.when(F.coalesce("stats", F.lit(0)) == 0, "track record"),
    )).alias("gaps"))


#: Buckets of a table's digest.
DIGEST_BUCKETS = 4096


def table_digest(df: DataFrame, *by: str) -> DataFrame:
    """Per bucket of ``by`` (all columns if none) the number of rows and two sums of row hashes, in no order."""
    # As JSON, so that any column type counts and a null differs from a missing text.
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    hashed = df.select(bucket_of_row(df, *by).alias("bucket"), F.xxhash64(row).alias("one"), F.xxhash64(F.lit("two"), row).alias("two"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return hashed.groupBy("bucket").agg(F.count("*").alias("n"), exact("one"), exact("two"))


def bucket_of_row(df: DataFrame, *by: str) -> Column:
    return F.pmod(F.xxhash64(F.to_json(F.struct(*(by or df.columns)), {"ignoreNullFields": "false"})), F.lit(DIGEST_BUCKETS)).cast("int")


def differing_buckets(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """``bucket`` of those in which two tables of the same columns differ; ``DIGEST_BUCKETS`` at most."""
    a, b = table_digest(left, *by), table_digest(right, *by).toDF("b", "n_b", "one_b", "two_b")
    same = F.col("n").eqNullSafe(F.col("n_b")) & F.col("one").eqNullSafe(F.col("one_b")) & F.col("two").eqNullSafe(F.col("two_b"))
    return a.join(b, F.col("bucket") == F.col("b"), "full_outer").where(~same).select(F.coalesce("bucket", "b").alias("bucket"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units added, removed, or with another price or status. Only buckets of ids whose digests differ are joined."""
    before, after = before.select("id", "price", "status"), after.select("id", "price", "status")
    moving = F.broadcast(differing_buckets(before, after, "id"))
    part = lambda df: df.withColumn("bucket", bucket_of_row(df, "id")).join(moving, "bucket", "left_semi").drop("bucket")
    b = part(before).select("id", F.col("price").alias("old_price"), F.col("status").alias("old_status"), F.lit(1).alias("b"))
    a = part(after).select("id", "price", "status", F.lit(1).alias("a"))
    moved = ~F.col("price").eqNullSafe(F.col("old_price")) | ~F.col("status").eqNullSafe(F.col("old_status"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(moved, "moved")
    return b.join(a, "id", "full_outer").withColumn("change", change).where(F.col("change").isNotNull()).select(
        "id", "change", "old_price", "price", "old_status", "status"
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: ``same``, whether two tables hold the same rows, counting repeats, in any order."""
    return differing_buckets(left, right).agg((F.count("*") == 0).alias("same"))
