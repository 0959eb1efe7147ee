"""Declarative data-quality rules.

Every rule yields ``(entity, rule, message)`` rows. Row rules are evaluated together in
one projection over the table and exploded; the rules that need a second look (uniqueness,
dependencies, references) are grouped aggregates or anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.text import filled
from noticegrid.session import evaluated, next_round

ID_PATTERN = r"^[a-z0-9-]+$"
PHONE_PATTERN = r"^[+()\d\s-]{8,20}$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"


def check_rows(df: DataFrame, entity: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Violations of row rules: ``(name, holds, message)``; an unknown outcome fails."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("rule"), message.alias("message")))
        for name, holds, message in rules
    ]))
    return df.select(entity.alias("entity"), F.explode(broken).alias("v")).select("entity", "v.rule", "v.message")


def _member(c: str, vocabulary) -> Column:
    return F.coalesce(F.col(c).isin(list(vocabulary)), F.lit(False))


def _said(*parts) -> Column:
    return F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def unit_rules(units: DataFrame, types, orientations, districts) -> DataFrame:
    """Vocabulary, required fields, numeric domains and conditional rules of units."""
    price, outdoor = F.coalesce("price", F.lit(0.0)), F.coalesce("outdoor", F.lit(0.0))
    available, roof = F.col("status") == "available", F.col("type") == "roof"
    return check_rows(units, F.col("id"), [
        ("code", filled(F.col("code")).isNotNull(), _said("a unit has no code")),
        ("district", _member("district", districts), _said("district", _shown("district"), "has no label")),
        ("orientation", _member("orientation", orientations), _said("orientation", _shown("orientation"), "has no label")),
        ("type", _member("type", types), _said("type", _shown("type"), "has no label")),
        ("status", _member("status", S.UNIT_STATUS), _said("status", _shown("status"), "is unknown")),
        ("floor", F.col("floor").isNotNull(), _said("floor is not a whole number")),
        ("area", F.col("area") > 0, _said("area is", _shown("area"))),
        ("outdoor", outdoor >= 0, _said("outdoor is", _shown("outdoor"))),
        ("rooms", (F.col("beds") > 0) & (F.col("baths") > 0), _said("beds/baths are", _shown("beds"), _shown("baths"))),
        ("priced", ~available | (price > 0), _said("is available but carries no price")),
        ("roof", ~roof | (outdoor > 0), _said("is typed roof but has no outdoor area")),
    ])


def project_rules(projects: DataFrame, districts) -> DataFrame:
    return check_rows(projects, F.col("id"), [
        ("id", F.col("id").rlike(ID_PATTERN), _said("id must be lower-case letters, digits and hyphens")),
        ("district", _member("district", districts), _said("district", _shown("district"), "has no label")),
        ("status", F.col("status").isNull() | _member("status", S.PROJECT_STATUS), _said("status", _shown("status"), "has no label")),
        ("image", filled(F.col("image")).isNotNull(), _said("has no cover image")),
    ])


def repeated_ids(df: DataFrame, column: str = "id", rule: str = "unique") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        F.col(column).alias("entity"), F.lit(rule).alias("rule"),
        _said(F.col("n").cast("string"), "rows share this id").alias("message"),
    )


def outside_vocabulary(values: DataFrame, vocabulary: DataFrame, rule: str) -> DataFrame:
    """Exploded ``(entity, value)`` rows whose value is not in the vocabulary table."""
    return values.join(vocabulary, "value", "left_anti").select(
        "entity", F.lit(rule).alias("rule"), _said(F.col("value"), "has no label").alias("message")
    )


def plan_area_dependency(units: DataFrame) -> DataFrame:
    """Plans shared by units of different areas.

    Distinct areas are found before the list is built; the list shows a few of them and
    their number, so one plan used everywhere cannot grow a value without bound.
    """
    areas = units.where(filled(F.col("plan")).isNotNull()).groupBy("project_id", "plan", "area").agg(F.count("*"))
    spread = areas.groupBy("project_id", "plan").agg(
        F.count("*").alias("n"), F.min("area").alias("lo"), F.max("area").alias("hi")
    ).where(F.col("n") > 1)
    return spread.select(
        F.concat_ws("/", "project_id", "plan").alias("entity"), F.lit("plan area").alias("rule"),
        _said("shared by", F.col("n").cast("string"), "areas from", F.col("lo").cast("string"), "to", F.col("hi").cast("string")).alias("message"),
    )


def selling_without_units(projects: DataFrame, units: DataFrame) -> DataFrame:
    selling = projects.where(F.col("status") == "selling")
    offered = units.where(F.col("status") == "available").select(F.col("project_id").alias("id"))
    return selling.join(offered, "id", "left_anti").select(
        F.col("id").alias("entity"), F.lit("selling").alias("rule"),
        _said("is marked selling but no unit is available").alias("message"),
    )


def bilingual(pairs: DataFrame) -> DataFrame:
    """Pairs ``(path, ar, en)`` with a missing side, or only one side filled."""
    blank = lambda c: F.trim(c) == ""
    return check_rows(pairs, F.col("path"), [
        ("both languages", F.col("ar").isNull() == F.col("en").isNull(), _said("is missing a language")),
        ("both filled", F.coalesce(blank(F.col("ar")) == blank(F.col("en")), F.lit(True)),
         _said("one language is filled in and the other is empty")),
    ])


_EMPTY = r"^[\s\p{Z}]*$"


def content_rules(content: DataFrame, lists: tuple[str, ...] = ("projects",)) -> DataFrame:
    """JSON texts ``(entity, body)`` must be readable objects whose named parts are lists.

    An object that repeats a name is not readable.
    """
    read = evaluated(content.select("entity", F.try_parse_json("body").alias("node")))
    # Taken as an object without fields, or as a list of such: null for any other shape, and nothing below is looked into.
    of_shape = lambda path, shape: F.try_variant_get("node", path, shape).isNotNull()
    judged = evaluated(read.select("entity", F.col("node").isNotNull().alias("readable"), of_shape("$", "struct<>").alias("object"),
                                   *[of_shape(f"$['{n}']", "array<struct<>>").alias(f"list_{i}") for i, n in enumerate(lists)]))
    return check_rows(judged, F.col("entity"), [
        ("readable", F.col("readable"), _said("the content cannot be read")),
        ("object", ~F.col("readable") | F.col("object"), _said("the content is not an object")),
        *[(n, ~F.col("object") | F.col(f"list_{i}"), _said(n, "is not a list")) for i, n in enumerate(lists)],
    ])


#: Levels of JSON texts that are gone down before the rows are written.
LEVELS_AT_ONCE = 12


def _one_level_down(level: DataFrame, roots: tuple[str, ...] | None = None) -> DataFrame:
    """Rows ``entity, path, sides, node``: a value found (``sides``) stays, any other node gives a row for each of its parts."""
    spark = level.sparkSession
    looked = level.withColumn("sides", F.coalesce("sides", F.try_variant_get("node", "$", "struct<ar: variant, en: variant>")))
    found = F.col("sides.ar").isNotNull() | F.col("sides.en").isNotNull()
    parts = looked.withColumn("node", F.when(~F.coalesce(found, F.lit(False)), F.col("node"))).lateralJoin(
        spark.tvf.variant_explode_outer(F.col("node").outer()))
    wanted = F.col("value").isNotNull() if roots is None else F.col("key").isin(list(roots))
    step = F.coalesce("key", F.col("pos").cast("string"))
    kept = F.col("value").isNull()
    return parts.where(found | wanted).select(
        "entity", F.when(kept, F.col("path")).when(F.col("path") == "", step).otherwise(F.concat_ws(".", "path", step)).alias("path"),
        F.when(kept, F.col("sides")).alias("sides"), F.col("value").alias("node"))


def bilingual_pairs(content: DataFrame, roots: tuple[str, ...] | None = None) -> DataFrame:
    """Bilingual values of JSON texts ``(entity, body)`` at any depth: ``entity, path, ar, en, has_ar, has_en``.

    An object with a side in one language is a value and not looked into; ``ar`` and ``en`` are null unless text. ``roots``
    names the top parts to walk. All texts go down ``LEVELS_AT_ONCE`` levels in one pass over them, whose rows are written;
    what lies deeper goes on in the next pass, whatever the number of texts. Unreadable texts give nothing here.
    """
    text = lambda n: F.when(F.schema_of_variant(f"sides.{n}") == "STRING", F.try_variant_get(f"sides.{n}", "$", "string"))
    sides = F.lit(None).cast("struct<ar: variant, en: variant>")
    level = content.select("entity", F.lit("").alias("path"), sides.alias("sides"), F.try_parse_json("body").alias("node"))
    found = None
    while True:
        for _ in range(LEVELS_AT_ONCE):
            level, roots = _one_level_down(level, roots), None
        walked = next_round(level.select("entity", "path", text("ar").alias("ar"), text("en").alias("en"),
                                         F.col("sides.ar").isNotNull().alias("has_ar"), F.col("sides.en").isNotNull().alias("has_en"), "node"))
        pairs, deeper = walked.where(F.col("node").isNull()).drop("node"), walked.where(F.col("node").isNotNull())
        found = pairs if found is None else found.unionByName(pairs)
        if deeper.isEmpty():
            return found
        level = deeper.select("entity", "path", sides.alias("sides"), "node")


def bilingual_content(content: DataFrame, roots: tuple[str, ...] | None = None) -> DataFrame:
    """Values with a missing language, or with one language filled in alone, named with their path."""
    blank = lambda c: F.col(c).rlike(_EMPTY)
    missing = F.when(F.col("has_ar"), "en").otherwise("ar")
    return check_rows(bilingual_pairs(content, roots), F.concat_ws(" ", "entity", "path"), [
        ("both languages", F.col("has_ar") & F.col("has_en"), _said("bilingual text is missing", missing)),
        ("both filled", F.coalesce(blank("ar") == blank("en"), F.lit(True)), _said("one language is filled in and the other is empty")),
    ])


def notes(rows: DataFrame) -> DataFrame:
    """Notes ``(entity, field, note)`` must be text without a comment terminator."""
    return check_rows(rows, F.col("entity"), [
        ("note", F.col("note").isNotNull() & ~F.col("note").contains("*/"), _said("the note on", F.col("field"), "would end its comment early")),
    ])


def testimonials(rows: DataFrame) -> DataFrame:
    """Published testimonials need quote and name in both languages."""
    def both(column: str) -> Column:
        return filled(F.col(column)["ar"]).isNotNull() & filled(F.col(column)["en"]).isNotNull()

    shown = rows.where(F.coalesce("published", F.lit(True)))
    return check_rows(shown, F.col("id").cast("string"), [
        ("quote", both("quote"), _said("published with an empty quote in one language")),
        ("name", both("name"), _said("published with no attribution")),
    ])


def structure(content: DataFrame, required: dict[str, str]) -> list[str]:
    """Structural problems of a table: missing columns or other types."""
    types = dict(content.dtypes)
    problems = []
    for name, wanted in required.items():
        if name not in types:
            problems.append(f"{name} is missing")
        elif not types[name].startswith(wanted):
            problems.append(f"{name} is not {wanted}")
    return problems


# ------------------------------------------------------------------------------ images


def manifest(files: DataFrame) -> DataFrame:
    """Image names with their sorted widths, out of file names like ``name-800.webp``."""
    pattern = r"^(.+)-(\d+)\.webp$"
    parts = files.select(
        F.regexp_extract("file", pattern, 1).alias("image"),
        F.regexp_extract("file", pattern, 2).try_cast("int").alias("width"),
    ).where(F.col("image") != "")
    return parts.groupBy("image").agg(F.array_sort(F.collect_set("width")).alias("widths"))


def thin_images(made: DataFrame, below: int = 800) -> DataFrame:
    return made.where(F.array_max("widths") < below).select("image")


def stale_entries(made: DataFrame, stored: DataFrame) -> DataFrame:
    """Images whose stored widths differ from the files."""
    m = made.select("image", F.col("widths").alias("on_disk"))
    s = stored.select("image", F.col("widths").alias("listed"))
    return m.join(s, "image", "full_outer").where(~F.col("on_disk").eqNullSafe(F.col("listed")))


def missing_images(referenced: DataFrame, made: DataFrame, files: DataFrame, plan_widths=(800, 1280)) -> DataFrame:
    """References no manifest lists, listed widths without a file, and missing plan sizes.

    ``referenced`` has ``image`` and ``is_plan``.
    """
    wanted = referenced.select("image", "is_plan").distinct()
    unlisted = wanted.join(made, "image", "left_anti").select(
        F.col("image").alias("entity"), F.lit("listed").alias("rule"), _said("is not in the manifest").alias("message"))
    promised = made.join(wanted.select("image").distinct(), "image").select("image", F.explode("widths").alias("w"), F.lit("on disk").alias("rule"))
    plan = wanted.where("is_plan").select("image", F.explode(F.array(*[F.lit(w) for w in plan_widths])).alias("w"), F.lit("plan size").alias("rule"))
    needed = promised.unionByName(plan).select(F.format_string("%s-%d.webp", "image", "w").alias("file"), "rule")
    absent = needed.join(files.select("file"), "file", "left_anti").select(
        F.col("file").alias("entity"), "rule", _said("is not on disk").alias("message"))
    return unlisted.unionByName(absent)


def sitemap(locations: DataFrame, pages: DataFrame, domain: str) -> DataFrame:
    """Locations outside the domain, and pages no location covers."""
    foreign = locations.where(~F.col("loc").startswith(domain)).select(
        F.col("loc").alias("entity"), F.lit("domain").alias("rule"), _said("is not on the domain").alias("message"))
    path = F.concat(F.lit(domain.rstrip("/")), F.col("path"))
    uncovered = pages.withColumn("loc", path).join(locations.select("loc"), "loc", "left_anti").select(
        F.col("path").alias("entity"), F.lit("covered").alias("rule"), _said("is not in the sitemap").alias("message"))
    return foreign.unionByName(uncovered)


def unfinished(lines: DataFrame, marker: str = "«REPLACE»") -> DataFrame:
    """Lines that carry an unfinished marker, as notes."""
    return lines.where(F.col("line").contains(marker)).select(
        F.col("entity"), F.lit("note").alias("severity"), F.trim(F.regexp_replace("line", r"^\s*/?\*+\s*", "")).alias("message")
    )


# ------------------------------------------------------------------------------- leads


def lead_rules(leads: DataFrame) -> DataFrame:
    """First problem of each field of an enquiry; a filled trap field rejects it."""
    name, phone, email = (F.trim(F.coalesce(c, F.lit(""))) for c in ("name", "phone", "email"))
    checks = [
        ("name", F.length(name) >= 3, _said("name is too short")),
        ("phone", (phone != "") & phone.rlike(PHONE_PATTERN), _said("phone number is not valid")),
        ("email", (email == "") | email.rlike(EMAIL_PATTERN), _said("e-mail address is not valid")),
        ("consent", F.col("consent"), _said("consent is required")),
        ("trap", F.trim(F.coalesce("trap", F.lit(""))) == "", _said("automated submission")),
    ]
    return check_rows(leads, F.col("id"), checks)
